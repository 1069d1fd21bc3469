"""Suffix-array dedup with a column-wise multi-document construction.

Removes every byte that is covered by a string of ``length`` bytes which starts at another place too, in the same or
another document.

Collections.  The construction needs short strings, one symbol of each per round.  So texts are cut by minimizers: in
every window of 200 bytes the least hash of a 48-byte string marks an anchor, and consecutive windows with one anchor
form a segment (at most 352 bytes).  Equal windows have their anchor at the same place, so they can only meet among
segments whose anchors are equal; those are a collection, aligned at the anchor.  Segments that are equal as a whole
repeat as a whole and need no construction; anchors that occur once can't repeat.
Collections with too many different segments are split by longer common strings, each window into one part, so that no
task holds more than a bounded number of them.

Construction.  Round by round, from the last column to the first, one symbol of each segment is put before its suffix:
the Burrows-Wheeler column in the order so far is sorted stably, which is the order of the longer suffixes, and the
common prefixes of neighbours grow by one where their symbols agree (else they are 0), over the least common prefix
between their old places.  A segment's suffix that has at least ``length`` symbols in common with a neighbour is a
window that repeats.  The columns of a large construction lie in a file of the shared folder that is written in sequence,
last column first, and read once in the same order; then only the order and the common prefixes are in memory.

Texts are equal by 128 bits (MD5), segments of one anchor by 64 bits of a hash of their 48-byte strings; windows are
compared symbol by symbol within collections.

Defined cases: null text counts as empty; texts under ``length`` bytes lose nothing; repeated rows of a text of at
least ``length`` bytes lose all of it, in every row, and only one of the rows is cut; ties don't occur; an empty table
gives an empty table; matches never cross documents.  A long text is cut in slices.  Columns other than doc_id and text
don't matter.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import MADE, U64, forget, light, looked_up, mixed, modest_batches, modest_broadcasts, pieces, removed_file, shared_dir, sieved, sifted, store, text_bytes, unused, with_fields, written

ANCHOR = 48
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
IN_MEMORY = 64 << 20  # bytes of columns; beyond them, a file of the shared folder holds them
GROUP = 4 << 20  # bytes of columns that are written or read at once
SLICE = 8 << 20
PIECE = 1 << 20
CROWD = 16_384  # different segments of a collection, at most about 6 MB
CUT = np.dtype([("anchor", "<i8"), ("first", "<i4"), ("windows", "<i4"), ("left", "<i4")])


class Segmenter:
    """Cuts texts into segments of windows with one anchor."""

    def __init__(self, length: int, anchor: int = ANCHOR) -> None:
        self.length, self.anchor = length, min(anchor, length)
        self.values = np.random.Generator(np.random.PCG64(21)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.up = self.down = np.ones(0, U64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """(document, first window start, last window start, anchor place, anchor hash, content hash), places in data."""
        n, w = len(data), self.length - self.anchor + 1
        empty = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, U64),) * 2
        if n < self.length:
            return empty
        if len(self.up) < n:
            m = max(n, 1 << 16)
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(m, base, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum(self.values[data] * self.up[:n], out=total[1:])
        k = n - self.anchor + 1
        grams = mixed((total[self.anchor :] - total[:k]) * self.down[:k])
        low = U64((1 << 24) - 1)
        keyed = (grams & ~low) | np.arange(k, dtype=U64)  # leftmost of equal hashes
        # least of each w neighbours: suffix minima of blocks against prefix minima of the next
        pad = -k % w
        block = np.concatenate([keyed, np.full(pad, ~U64(0))]).reshape(-1, w)
        ahead = np.minimum.accumulate(block, 1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
        windows = n - self.length + 1
        place = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & low).astype(np.int64)
        start = np.arange(windows)
        lengths = np.diff(offsets)
        end = np.repeat(offsets[1:] - offsets[0], lengths)[:windows]
        valid = start + self.length <= end
        new = np.empty(windows, bool)
        new[0] = True
        new[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
        # a document's first window is new even where the one before has the same anchor
        firsts = offsets[:-1] - offsets[0]
        new[firsts[firsts < windows]] = True
        first = np.flatnonzero(new & valid)
        if not len(first):
            return empty
        stop = np.flatnonzero(np.append(new | ~valid, True))
        last = stop[np.searchsorted(stop, first, "right")] - 1
        to = last + self.length
        # of all strings of the anchor's length that cover it, without gaps: no sum of powers over a longer string
        content = mixed(grams[to - self.anchor] + (to - first).astype(U64) * U64(0xD6E8FEB86659FD93))
        for j in range(int((to - first).max()) // self.anchor):
            at = first + j * self.anchor
            inside = at + self.anchor <= to
            content[inside] = mixed(content[inside] + grams[at[inside]])
        doc = np.searchsorted(offsets - offsets[0], first, "right") - 1
        return doc, first, last, place[first], grams[place[first]], content


def _segments(docs: DataFrame, length: int) -> DataFrame:
    """text_key, anchor, content, first, windows, left (bytes before the anchor) of every segment."""
    names = ["text_key", "anchor", "content", "first", "windows", "left"]

    def rows(batches):
        cut = Segmenter(length)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            keys = batch.column(0)
            for a, b in pieces(offsets, PIECE):
                # a text beyond SLICE is cut into slices that share length - 1 bytes: each window is in one of them
                for at in range(int(offsets[a]), max(int(offsets[a]) + 1, int(offsets[b]) - length + 1), SLICE) if b - a == 1 else [int(offsets[a])]:
                    to = min(int(offsets[b]), at + SLICE + length - 1) if b - a == 1 else int(offsets[b])
                    bounds = np.clip(offsets[a : b + 1], at, to)
                    doc, first, last, place, anchor, content = cut(data[at:to], bounds)
                    shift = at - offsets[a:b][doc]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc + a)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array((first + shift).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array((place - first).astype(np.int32))], names)

    return docs.select("text_key", "text").mapInArrow(rows, "text_key binary, anchor long, content long, first int, windows int, left int")


def _columns(strings: list[bytes], left: np.ndarray, before: int, width: int, folder: str | None):
    """The columns of aligned strings from the last to the first: 1 + byte, or 0 where a string has none.

    They are made in groups of columns; if there are many, the groups are written one after another to a file of the
    shared folder and read back in that order.
    """
    m, sizes = len(strings), np.array([len(s) for s in strings])
    flat = np.frombuffer(b"".join(strings), np.uint8)
    starts = np.cumsum(sizes) - sizes
    at_once = max(1, GROUP // (2 * m))

    def groups():
        for last in range(width, 0, -at_once):
            first = max(0, last - at_once)
            place = np.arange(first, last)[:, None] - (before - left)[None]
            inside = (place >= 0) & (place < sizes[None])
            yield np.where(inside, flat[np.where(inside, starts[None] + place, 0)].astype(np.int16) + 1, np.int16(0))

    if folder is None or 2 * m * width <= IN_MEMORY:
        for group in groups():
            yield from group[::-1]
        return
    name = f"{folder}/columns-{uuid.uuid4().hex}"
    fs, path = store(name)
    heights = []
    try:
        with fs.open_output_stream(path, compression=None) as f:
            for group in groups():
                heights.append(len(group))
                f.write(np.ascontiguousarray(group[::-1]).tobytes())
        with fs.open_input_stream(path, compression=None) as f:
            for n in heights:
                yield from np.frombuffer(f.read(2 * n * m), np.int16).reshape(n, m)
    finally:
        removed_file(name)


def repeated_windows(strings: list[bytes], left: np.ndarray, length: int, folder: str | None = None) -> np.ndarray:
    """Of strings aligned at their anchors (``left`` bytes before it): (string, offset) of windows that occur twice."""
    m = len(strings)
    before = int(left.max())
    width = before + int((np.array([len(s) for s in strings]) - left).max())
    order, common = np.arange(m), np.zeros(m, np.int32)  # common[i]: with the string before, in order
    found = []
    for c, column in zip(range(width - 1, -1, -1), _columns(strings, left, before, width, folder), strict=True):
        symbol = column[order]
        move = np.argsort(symbol, kind="stable")
        sorted_symbol = symbol[move]
        same = np.zeros(m, bool)
        same[1:] = (sorted_symbol[1:] == sorted_symbol[:-1]) & (sorted_symbol[1:] != 0)
        grown = np.zeros(m, np.int32)
        if same.any():
            i = np.flatnonzero(same)
            near = move[i] - move[i - 1] == 1
            grown[i[near]] = common[move[i[near]]] + 1
            far = i[~near]
            if len(far):
                bounds = np.empty(2 * len(far), np.int64)
                bounds[0::2], bounds[1::2] = move[far - 1] + 1, move[far] + 1
                grown[far] = np.minimum.reduceat(np.append(common, 0), bounds)[0::2] + 1
        order, common = order[move], grown
        hit = common >= length
        hit[:-1] |= common[1:] >= length
        if hit.any():
            s = order[hit]
            found.append(np.stack([s, c - (before - left[s])], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Sorted distinct numbers as (from, to) runs."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.append(0, cut + 1)].tolist(), places[np.append(cut, len(places) - 1)].tolist(), strict=True))


def _constructed(open_: DataFrame, length: int, most_bytes: int = 8 << 20) -> DataFrame:
    """text_key, first, last: runs of repeated windows among segments (anchor, text_key, first, left, raw)."""
    names = ["text_key", "first", "last"]
    folder = shared_dir(open_.sparkSession)

    def rows(batches):
        held: list[tuple] = []
        size, now = 0, None

        def done():
            hits = repeated_windows([h[3] for h in held], np.array([h[2] for h in held]), length, folder)
            hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
            cut = np.searchsorted(hits[:, 0], np.arange(len(held) + 1))
            out = [(held[i][0], held[i][1] + a, held[i][1] + b) for i in np.unique(hits[:, 0]).tolist() for a, b in _runs(hits[cut[i] : cut[i + 1], 1])]
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32()), strict=True)], names)

        for batch in batches:
            for anchor, key, first, left, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != now and size >= most_bytes:  # collections of different anchors may share a construction
                    yield done()
                    held, size = [], 0
                now = anchor
                held.append((key, first, left, raw))
                size += len(raw)
        if held:
            yield done()

    ready = open_.select("anchor", "text_key", "first", "left", "raw").repartition("anchor").sortWithinPartitions("anchor")
    return ready.mapInArrow(rows, "text_key binary, first int, last int")


def _small(df: DataFrame) -> bool:
    return light(df) is not df


def text_key(text: str = "text"):
    """128 bits by which texts are told apart."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _once(texts: DataFrame, copied: DataFrame, total: int) -> DataFrame:
    """text_key and text of rows (text_key, doc_id, text): one row of each text.

    copied: the text_key of each text of several rows, their number, the doc_id of one, and how many rows share that.
    """
    def others(rows: DataFrame, known: DataFrame) -> DataFrame:
        known = known.select(F.col("text_key").alias("ck"), "one", "same")
        return rows.join(known, (F.col("text_key") == F.col("ck")) & ((F.col("same") > 1) | ~F.col("doc_id").eqNullSafe(F.col("one"))), "left_anti")

    hot = F.col("rows") > max(1, total // 1000)  # fewer than a thousand texts
    once = others(others(texts, F.broadcast(copied.where(hot))), light(copied) if _small(copied) else copied.where(~hot)).select("text_key", "text")
    twins = copied.where("same > 1")
    if twins.isEmpty():
        return once
    # rows with equal ids and texts: any of them, reduced before the shuffle
    keys = twins.select("text_key", "rows")
    found = texts.join(light(keys), "text_key") if _small(twins) else looked_up(texts, keys, "text_key", "rows", total)
    return once.union(found.groupBy("text_key").agg(F.min("text").alias("text")))


def repeated_spans(docs: DataFrame, length: int = 200, most: int = CROWD) -> DataFrame:
    """text_key, spans: runs (first, last) of starts of repeated windows, packed, and rows, how many rows have the text; only
    texts that have any.  Collections of more than ``most`` different segments are split before they are constructed."""
    modest_batches(docs.sparkSession)
    modest_broadcasts(docs.sparkSession)
    since = len(MADE)
    texts = docs.where(F.octet_length("text") >= length).select(text_key().alias("text_key"), "doc_id", "text")
    same = texts.groupBy("text_key", "doc_id").agg(F.count(F.lit(1)).alias("same"), F.min(F.octet_length("text")).alias("size"))
    counts = same.groupBy("text_key").agg(F.sum("same").alias("rows"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "same")).alias("one"), F.min("size").alias("size"))
    copied = written(counts.where("rows > 1").select("text_key", "rows", F.col("one.doc_id").alias("one"), "one.same", "size"), "copied")
    total = copied.agg(F.sum("rows")).first()[0] or 0
    once = _once(texts, copied, total)
    segments = written(_segments(once, length), "segments")
    # an anchor that occurs once can't repeat; one whose segments are all equal needs no construction
    anchors = segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("content") == F.max("content")).alias("alike"))
    anchors = written(anchors.where("n > 1"), "anchors")
    met = written(_met(segments, anchors, "anchor").drop("n"), "met")
    forget(docs.sparkSession, since, keep=(copied, met))
    # of equal segments one takes part
    distinct = met.where("not alike").groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text_key", "first", "windows", "left")).alias("s"))
    distinct = written(distinct.select("anchor", "content", "n", "s.*"), "contents")
    twice = written(distinct.where("n > 1").select("anchor", "content", "n"), "twice")
    whole = met.where("alike").select("text_key", "first", "windows").union(_met(met.where("not alike"), twice, "anchor", "content").select("text_key", "first", "windows"))
    crowded = light(written(distinct.groupBy("anchor").count().where(F.col("count") > most).select("anchor"), "crowded"))
    columns = ("text_key", "anchor", "first", "windows", "left")
    calm = written(_packed(distinct.join(crowded, "anchor", "left_anti").select(*columns)), "cuts")
    found = _constructed(_raw(once, calm, length), length)
    if not crowded.isEmpty():
        hot = written(_packed(distinct.join(crowded, "anchor", "left_semi").select(*columns)), "cuts")
        found = found.union(_split(_raw(once, hot, length), length, most))
    whole = whole.select("text_key", "first", (F.col("first") + F.col("windows") - 1).cast("int").alias("last"))
    full = copied.select("text_key", F.lit(0).alias("first"), (F.col("size") - length).cast("int").alias("last"))
    spans = written(_merged(whole.union(found).union(full)), "spans")
    counts = copied.select(F.col("text_key").alias("ck"), "rows")
    spans = written(spans.join(counts, F.col("text_key") == F.col("ck"), "left").select("text_key", "spans", F.coalesce("rows", F.lit(1)).alias("rows")), "spans")
    forget(docs.sparkSession, since)
    return spans


def _met(rows: DataFrame, known: DataFrame, *key: str) -> DataFrame:
    """rows joined with a written table of unique keys and the number n of rows of each.  The plan is the same for tables of
    any size: rows without a partner are sieved out, others shuffled, those of hot keys looked up."""
    total = known.agg(F.sum("n")).first()[0] or 0
    return looked_up(sieved(rows, known, *key), known.withColumn("weight", F.col("n")).hint("merge"), list(key), "weight", total)


def _halves(parts: DataFrame, length: int, anchor: int) -> DataFrame:
    """Each part's windows that reach half of the missing bytes or more before the common string, and the others, which
    reach far behind it: two parts with longer common strings, by which their new collections are named."""
    common = F.lit(anchor) + F.col("before") + F.col("after")
    more = F.floor((F.lit(length) - common + 1) / 2).cast("int")
    start, last = F.col("left") - F.col("before"), F.col("windows") - 1

    def half(low, high, ahead, behind):
        key = F.xxhash64("anchor", ahead, F.substring("raw", start - ahead + 1, common + ahead + behind))
        raw = F.substring("raw", low + 1, high - low + length)
        return F.struct(key.alias("anchor"), "text_key", (F.col("first") + low).alias("first"), (high - low + 1).alias("windows"), (F.col("left") - low).alias("left"), (F.col("before") + ahead).alias("before"), (F.col("after") + behind).alias("after"), raw.alias("raw"))

    zero = F.lit(0)
    both = F.array(half(zero, F.least(last, start - more), more, zero), half(F.greatest(zero, start - more + 1), last, zero, F.lit(length) - common - more + 1))
    return parts.select(F.explode(both).alias("h")).select("h.*").where("windows > 0")


def _split(raw: DataFrame, length: int, most: int) -> DataFrame:
    """text_key, first, last: runs of repeated windows among the segments of crowded anchors.

    Such a collection is split by longer common strings until none holds more than ``most`` different segments, so no
    task gets more.  Every window is in one part at each level; after at most nine levels a part is a single window.
    """
    anchor, found = min(ANCHOR, length), []
    zero = F.lit(0)
    parts = raw.withColumns({"windows": F.octet_length("raw") - length + 1, "before": zero, "after": zero})
    run = ("text_key", "first", (F.col("first") + F.col("windows") - 1).cast("int").alias("last"))
    while True:
        parts = written(_halves(parts, length, anchor).withColumn("content", F.xxhash64("raw", "left")), "halves")
        distinct = parts.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text_key", "first")).alias("one"))
        distinct = written(distinct, "contents")
        twice = light(written(distinct.where("n > 1").select("anchor", "content"), "twice"))
        found.append(parts.join(twice, ["anchor", "content"], "left_semi").select(*run))
        several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        stand = light(written(distinct.join(several, "anchor").select("anchor", "content", "one", (F.col("k") > most).alias("crowded")), "stand"))
        left = parts.join(stand, ["anchor", "content"]).where(F.struct("text_key", "first") == F.col("one")).drop("one")
        found.append(_constructed(left.where("not crowded"), length))
        parts = left.where("crowded").drop("crowded", "content")
        if stand.where("crowded").isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _packed(cuts: DataFrame) -> DataFrame:
    """text_key and its cuts as one binary of 20 bytes each, so that they stay small in a join."""

    def rows(batches):
        for batch in batches:
            packed = []
            for cuts in batch.column(1).to_pylist():
                x = np.empty(len(cuts), CUT)
                for i, c in enumerate(cuts):
                    x[i] = (c["anchor"], c["first"], c["windows"], c["left"])
                packed.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["text_key", "cuts"])

    grouped = cuts.groupBy("text_key").agg(F.collect_list(F.struct("anchor", "first", "windows", "left")).alias("cuts"))
    return grouped.mapInArrow(rows, "text_key binary, cuts binary")


def _merged(spans: DataFrame) -> DataFrame:
    """text_key and spans: the runs of (first, last), merged where they touch, as a binary of two int32 each."""

    def rows(batches):
        for batch in batches:
            packed = []
            for spans in batch.column(1).to_pylist():
                out: list[list[int]] = []
                for s in sorted((s["first"], s["last"]) for s in spans):
                    if out and s[0] <= out[-1][1] + 1:
                        out[-1][1] = max(out[-1][1], s[1])
                    else:
                        out.append(list(s))
                packed.append(np.array(out, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["text_key", "spans"])

    grouped = spans.groupBy("text_key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return grouped.mapInArrow(rows, "text_key binary, spans binary")


def _raw(once: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted segments."""
    names = ["anchor", "text_key", "first", "left", "raw"]

    def rows(batches):
        for batch in batches:
            out = []
            for key, text, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                out += [(anchor, key, first, left, raw[first : first + windows - 1 + length]) for anchor, first, windows, left in np.frombuffer(cuts, CUT).tolist()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names)

    # one row a text: no hot key; texts without wanted segments aren't shuffled
    joined = sieved(once, wanted, "text_key").join(wanted.hint("merge"), "text_key").select("text_key", "text", "cuts")
    return joined.mapInArrow(rows, "anchor long, text_key binary, first int, left int, raw binary")


def without_repeats(docs: DataFrame, length: int = 200, keep: tuple[str, ...] = ("doc_id",), most: int = CROWD) -> DataFrame:
    """The columns ``keep``, n_bytes, n_removed, n_spans and kept (binary: the bytes that remain); these names get
    underscores behind them where ``keep`` has such columns."""
    spans = repeated_spans(docs.select("doc_id", "text"), length, most)
    said = unused(list(keep), "n_bytes", "n_removed", "n_spans", "kept")
    schema = with_fields(docs.select(*keep).schema, ", ".join(f"`{n}` {k}" for n, k in zip(said, ("long", "long", "long", "binary"), strict=True)))

    def rows(batches):
        for batch in batches:
            n, removed, runs, kept = [], [], [], []
            for text, found in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True):
                raw = (text or "").encode()
                out, at, cut, parts = [], 0, 0, 0
                end = -1
                for s in [(a, b + length) for a, b in np.frombuffer(found or b"", "<i4").reshape(-1, 2).tolist()]:
                    if s[0] > end:
                        parts += 1
                        out.append(raw[at : s[0]])
                        cut += s[1] - s[0]
                    else:
                        cut += max(0, s[1] - end)
                    end = max(end, s[1])
                    at = end
                out.append(raw[at:])
                n.append(len(raw))
                removed.append(cut)
                runs.append(parts)
                kept.append(b"".join(out))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], schema.fieldNames())

    # texts that are too short have keys of their own, which match nothing and spread evenly
    own = F.concat(F.lit("short"), F.monotonically_increasing_id().cast("string")).cast("binary")
    key = F.when(F.octet_length("text") >= length, text_key()).otherwise(own)
    keyed = docs.select(F.struct(*keep).alias("row"), F.col("text").alias("text"), key.alias("text_key"))
    touched, whole = sifted(keyed, spans, "text_key")  # texts that keep all their bytes aren't shuffled
    joined = looked_up(touched, spans.hint("merge"), "text_key", "rows", spans.agg(F.sum("rows")).first()[0] or 0, "left")
    joined = joined.unionByName(whole.withColumn("spans", F.lit(None).cast("binary")))
    return joined.select("row.*", F.col("text").alias("text_key"), "spans").mapInArrow(rows, schema)


def repeats_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int = 200) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, from a table of all windows (for tests)."""
    raws = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(r) else 0
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out
