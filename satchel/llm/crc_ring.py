"""Importance resampling towards a target distribution, over hashed n-grams.

One scan of a text keeps a ring of running zlib states, one for each of the last n words as a start; every new word extends
each of them by a space and itself, and each state is then the crc32 of an n-gram that ends here.  So n-grams are hashed
without being put together, a word is read once for each of its n-grams, and a text is read in slices: beyond a slice
only the ring is kept.

Three passes over texts, none of which shuffles them: each task counts the buckets of its documents (a row per bucket leaves
it), the counts of corpus and target give every bucket a gain, and each document sums the gains of its features.  A draw
without replacement by these weights is the highest sums of weight and keyed Gumbel noise; ranks come from range partitions
and their counts, so no task and no window sees all documents.  The driver holds a number per bucket and per partition.

Null and empty texts have no features and weight 0; a null doc_id has the noise of an empty one; repeated rows are documents
of their own with equal scores, and ranks among rows that are equal in everything are any of theirs.  Ties go to the
smaller doc_id, a null one first.  An empty target gives T = 0 and an empty table an empty result.  Further columns are
not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import modest_batches, numbered, text_bytes, written

#: Bytes of words as they are hashed: A-Z become a-z, all that is in no word becomes a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SLICE = 1 << 20


def slices(raw: bytes, most: int = SLICE):
    """The words of a text as lists, about ``most`` bytes at a time; a longer word is in one list."""
    at, n = 0, len(raw)
    while at < n:
        to = min(n, at + most)
        part = raw[at:to].translate(LETTERS)
        if to < n:
            cut = part.rfind(b" ")
            if cut < 0:  # a word that goes on: up to its end
                found = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").search(raw, to)
                to = found.start() if found else n
                part = raw[at:to].translate(LETTERS)
            else:
                to, part = at + cut + 1, part[:cut]
        yield part.split()
        at = to


def crcs(raw: bytes, most: int, each: int = SLICE):
    """(number of words, crc32 of every run of 1 to ``most`` words that ends in them), a slice at a time."""
    crc, ring = zlib.crc32, []
    for found in slices(raw, each):
        out: list[int] = []
        for word in found:
            ring = [crc(word), *[crc(word, crc(b" ", state)) for state in ring[: most - 1]]]
            out += ring
        yield len(found), np.array(out, np.uint32)


def bucket_counts(texts: DataFrame, buckets: int, most: int) -> dict[int, int]:
    """How many features of a table's column ``text`` fall into each bucket; a row per task and bucket is shuffled."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for _, found in crcs(data[a:b].tobytes(), most):
                    total += np.bincount(found % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        for part in range(0, len(used), 1 << 16):
            some = used[part : part + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], ["bucket", "n"])

    modest_batches(texts.sparkSession)
    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r.bucket: r.n for r in rows.collect()}  # a row per bucket


def bucket_gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, in doubles."""
    s, t = float(sum(raw.values())), float(sum(target.values()))
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * (s + buckets) / ((raw.get(b, 0) + 1.0) * (t + buckets)))) for b in range(buckets)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, most: int) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of its features' gains) of each document."""
    modest_batches(docs.sparkSession)
    size = len(gains)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def weigh(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out = np.zeros((3, len(batch)), np.int64)
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                for n, found in crcs(data[a:b].tobytes(), most):
                    out[:, i] += n, len(found), gains[found % size].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """floor(1000 times a standard Gumbel number), drawn by the hash of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resampled(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score and rank: 1, 2, ... for the ``percent`` of the documents of ``least_words`` words
    or more that are drawn, null for all others."""
    gains = bucket_gains(bucket_counts(docs, buckets, most), bucket_counts(target, buckets, most), buckets)
    scored = weighed(docs, gains, most)
    scored = written(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    able = numbered(scored.where(F.col("n_words") >= least_words), [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "n_features", "weight"], "place")
    drawn = percent * able.count() // 100
    able = able.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return able.drop("place").unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def brute_force(docs: list[tuple], target: list, most: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> list[tuple]:
    """What resampled must return, from plain loops over n-grams that are put together (for tests)."""
    from collections import Counter

    low = {c: c + 32 for c in range(65, 91)}

    def cut(text):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(low))

    def of(w):
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    raw, aim = (Counter(b for t in texts for b in of(cut(t))) for texts in ((t for _, t in docs), target))
    s, t_ = sum(raw.values()), sum(aim.values())
    rows = []
    for i, text in docs:
        w = cut(text)
        weight = sum(math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t_ + buckets)))) for b in of(w))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(of(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    drawn = percent * len(able) // 100
    return [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if r[4] < least_words]
