"""Training-order materialisation of token ids in binary shards.

Texts become token ids (uint16, or uint32 for larger vocabularies), an end-of-text id and sequences of fixed length,
the last one of a document padded.  A document can't have more tokens than bytes, so the lengths in bytes alone give
each document a range of candidate numbers; texts are tokenised once.  A keyed Feistel network over the next power of
four, cycle-walking back into range, permutes these numbers without any sort key or permutation table; a sequence's
slot is the rank of its permuted number among those that exist.  A range of permuted numbers is a shard: a file of equal
strides in slot order.  With the counts of the shards (the manifest), slot s is at byte (s - first slot) * stride of its
shard, and training reads sequentially and resumes at any slot.

The numbering needs two scans of the input in which partitions are equal (a scan of files is); each task checks its
counts against the first scan's.  Other inputs are written once and scanned from there.

Null and empty texts are one sequence of end-of-text and padding.  Repeated rows are sequences of their own; an empty
table gives no shards.
"""

from __future__ import annotations

import base64
import bisect
import importlib.util
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, fresh_path, mixed, modest_batches, store, with_fields, written

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class Feistel:
    """A keyed permutation of range(n)."""

    def __init__(self, n: int, key: int, rounds: int = 6) -> None:
        self.n, self.half = n, max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.keys = mixed(np.arange(1, rounds + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(key & (1 << 64) - 1))

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        mask = U64((1 << self.half) - 1)
        left, right = x >> U64(self.half), x & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        return left << U64(self.half) | right

    def slots(self, index: np.ndarray) -> np.ndarray:
        """Where each index goes; values that land beyond n walk on until they are back."""
        x = self._once(index.astype(U64), self.keys)
        while (out := x >= U64(self.n)).any():
            x[out] = self._once(x[out], self.keys)
        return x.astype(np.int64)

    def index(self, slots: np.ndarray) -> np.ndarray:
        """The inverse of slots."""
        mask = U64((1 << self.half) - 1)

        def back(x):
            left, right = x >> U64(self.half), x & mask
            for k in self.keys[::-1]:
                left, right = right ^ (mixed(left + k) & mask), left
            return left << U64(self.half) | right

        x = back(slots.astype(U64))
        while (out := x >= U64(self.n)).any():
            x[out] = back(x[out])
        return x.astype(np.int64)


class Tokenizer:
    """A public byte-level BPE; read on the driver and shipped (about 1 MB), built where it is used."""

    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> None:
        spec = importlib.util.spec_from_file_location("vocabulary_files", f"{folder}/__init__.py")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        self.pattern = module.PATTERN
        with open(f"{folder}/{vocabulary}", "rb") as f:
            self.raw = f.read()
        self.end = self.raw.count(b"\n")  # the id behind the last rank is free
        self.dtype = "<u2" if self.end < 1 << 16 else "<u4"

    def ready(self):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in self.raw.splitlines() if x)}
        coder = tiktoken.Encoding("public", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        end = max(ranks.values()) + 1

        def encode(text: str) -> np.ndarray:
            ids = coder.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)
            return np.append(ids.astype(self.dtype), np.array(end, self.dtype))

        return encode, end


def shards_written(docs: DataFrame, folder: str, sequence: int = 512, shard_bytes: int = 32 << 20, key: int = 2026, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Write the shards below folder; one row per sequence: doc_id, sequence (its number in the document), slot, shard,
    byte_offset, n_tokens (without padding).  ``shard_bytes`` is what a shard holds at half a token per byte."""
    modest_batches(docs.sparkSession)
    tokenizer = tokenizer or Tokenizer()
    if not docs.inputFiles() or "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = written(docs, "order")
    docs = docs.select("doc_id", "text")

    bound = F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / sequence) + 1
    counts = {r.part: (r.rows, r.n) for r in docs.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.sum(bound).alias("n")).collect()}
    first, total = {}, 0
    for part in sorted(counts):
        first[part] = total
        total += counts[part][1]
    stride = sequence * np.dtype(tokenizer.dtype).itemsize
    span = max(1, 2 * shard_bytes // stride)
    shards = max(1, -(-total // span))
    order = Feistel(max(1, total), key)

    def cut(batches):
        encode, end = tokenizer.ready()
        part = TaskContext.get().partitionId()
        at, rows = first.get(part, 0), 0
        for batch in batches:
            ids, numbers, sizes, index, payload = [], [], [], [np.zeros(0, np.int64)], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                tokens = encode(text)
                n = -(-len(tokens) // sequence)
                full = np.full(n * sequence, end, tokenizer.dtype)
                full[: len(tokens)] = tokens
                raw = full.tobytes()
                payload += [raw[i * stride : (i + 1) * stride] for i in range(n)]
                sizes += [min(sequence, len(tokens) - i * sequence) for i in range(n)]
                ids += [doc_id] * n
                numbers += range(n)
                index.append(np.arange(at, at + n))
                at += len(text.encode()) // sequence + 1
                rows += 1
            places = order.slots(np.concatenate(index))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(numbers, pa.int64()), pa.array(places, pa.int64()), pa.array((places // span).astype(np.int32)), pa.array(sizes, pa.int32()), pa.array(payload, pa.binary())], ["doc_id", "sequence", "place", "shard", "n_tokens", "payload"])
        if (rows, at - first.get(part, 0)) != counts.get(part, (0, 0)):
            raise RuntimeError("the input's partitions differ from those that were counted")

    schema = with_fields(docs.select("doc_id").schema, "sequence long, place long, shard int, n_tokens int")
    payload = docs.mapInArrow(cut, with_fields(schema, "payload binary"))

    def write(batches):
        fs, base = store(folder)
        fs.create_dir(base)
        out, now, row = None, -1, 0
        attempt = TaskContext.get().taskAttemptId()

        def close():
            if out is not None:
                out.close()
                fs.move(f"{base}/.shard-{now:08d}-{attempt}", f"{base}/shard-{now:08d}.bin")

        for batch in batches:
            inside = []
            for shard, raw in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if shard != now:
                    close()
                    now, row = shard, 0
                    out = fs.open_output_stream(f"{base}/.shard-{now:08d}-{attempt}")
                out.write(raw)
                inside.append(row)
                row += 1
            columns = [*batch.columns[:2], pa.array(inside, pa.int64()), *batch.columns[3:5]]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())
        close()

    placed = written(payload.repartitionById(shards, F.col("shard")).sortWithinPartitions("place").mapInArrow(write, schema), "placed")
    held = {r.shard: r[1] for r in placed.groupBy("shard").count().collect()}
    starts, at = [], 0
    for shard in range(shards):
        starts.append((shard, at))
        at += held.get(shard, 0)
    fs, base = store(folder)
    fs.create_dir(base)
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"sequence": sequence, "dtype": tokenizer.dtype, "starts": [s for _, s in starts], "total": at}).encode())
    known = docs.sparkSession.createDataFrame(starts, "shard int, start long")
    return placed.join(F.broadcast(known), "shard").select("doc_id", "sequence", (F.col("start") + F.col("place")).alias("slot"), "shard", (F.col("place") * stride).alias("byte_offset"), "n_tokens")


def read_slots(folder: str, start: int, count: int) -> np.ndarray:
    """``count`` sequences in training order from slot ``start`` on (fewer at the end), by sequential reads."""
    fs, base = store(folder)
    with fs.open_input_file(f"{base}/manifest.json") as f:
        known = json.loads(f.read())
    sequence, dtype, starts = known["sequence"], known["dtype"], [*known["starts"], known["total"]]
    stride = sequence * np.dtype(dtype).itemsize
    out = [np.zeros((0, sequence), dtype)]
    while count > 0 and start < known["total"]:
        shard = bisect.bisect_right(starts, start) - 1
        n = min(count, starts[shard + 1] - start)
        with fs.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            out.append(np.frombuffer(f.read_at(n * stride, (start - starts[shard]) * stride), dtype).reshape(-1, sequence))
        start, count = start + n, count - n
    return np.concatenate(out)


def training_order(docs: DataFrame, sequence: int = 512) -> DataFrame:
    """The rows of shards_written, in a fresh folder of the shared directory."""
    return shards_written(docs, fresh_path(docs.sparkSession, "tokens"), sequence)
