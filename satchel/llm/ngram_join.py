"""N-gram Jaccard self-join by vertical partitioning.

A document's set holds the distinct shingles of its words, as 64-bit hashes; the global order of shingles is the order
of these hashes, and the order is cut into fragments (ranges).

Candidates.  If two sets of sizes n and m have a Jaccard similarity of at least t, they differ in at most
d = (n + m)(1 - t) / (1 + t) shingles.  Sizes fall in classes (horizontal partitioning), and each class cuts the order
into more than d fragments, so that one fragment at least is equal in both sets.  Sets are grouped by equal fragments;
those that share fewer fragments with others than any of their links would need have no links and leave first.

Overlaps.  Sets that share equal fragments, directly or through others, form a cluster; clusters are cut into blocks of
bounded size by bands of set sizes and by hashes, and each pair of blocks whose sizes allow links is compared by fragments of
the global order: one task counts the partial overlaps of a pair of blocks in one fragment (as a product of 0/1 matrices),
and the partial counts of all fragments are summed per pair; a pair is linked if 100 * overlap >= percent * union.

Large clusters.  All members of a cluster of several blocks are compared with one of them first.  Those linked to it are
in one component already, so blocks of them need not be compared with each other, only with the rest.

Copies.  Equal sets are one node.  Pairs live only as matrix entries inside a task; what leaves it is one row per linked
set with a representative of its component, so groups of near copies aren't expanded and no link is lost.  Sets with a
large share of the rows are looked up by broadcast, all others by a shuffle.

Defined cases: null text, empty text and text without words have an empty set, no links, and are components of their
own.  Ties and repeated rows: equal sets are linked; the component's id is its smallest doc_id (null if all are null).
Every input row gives a row.  An empty table gives an empty table.  Shingles have 64 bits, of hashes that are sums of
random numbers per place and byte; sets are told apart by 128 bits.  A long text takes about 30 bytes of memory a word.
Further columns don't matter, or are kept as they are, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import MADE, SPACED, U64, WordHasher, bounded, forget, joined, light, mixed, modest_batches, modest_broadcasts, pieces, sieved, text_bytes, unused, with_fields, written

FRAGMENTS = 4  # fragments of the order of shingles, each with a task of its own for a pair of blocks
COLUMNS = 4096  # shingles of a fragment that are counted at once
BLOCK_TOKENS, ROW_TOKENS = 1 << 20, 1024  # a block holds about so many tokens, each set counting as so many more
BAND = 1.25  # ratio of set sizes in a band of a large cluster
SPREAD = 1.5  # ratio of the bounds of a size class
BROADCAST_ROWS = 50_000
PEELS = 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    _, _, words, at = hasher(data, offsets)
    out = []
    m = max(0, len(words) - width + 1)
    joined = np.zeros(m, U64)
    for k in range(width):
        joined = mixed(joined * U64(0x9FB21C651E98DF25) + words[k : k + m])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(joined[a : b - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            h = np.zeros(1, U64)
            for k in range(a, b):
                h = mixed(h * U64(0x9FB21C651E98DF25) + words[k : k + 1])
            out.append(mixed(h + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


class Classes:
    """Size classes and how many fragments each has."""

    def __init__(self, percent: int) -> None:
        self.t = percent / 100
        self.bounds = [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, math.ceil(self.bounds[-1] * max(SPREAD, 1 / self.t))))

    def differ(self, n: int, m: int) -> int:
        """The most shingles in which linked sets of these sizes can differ."""
        return int(math.floor((n + m) * (1 - self.t) / (1 + self.t) + 1e-9))

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """The classes of a set of size n: (class, fragments, most differences)."""
        k = int(np.searchsorted(self.bounds, n, "right")) - 1
        out = []
        for c in (k, k + 1):
            top = self.bounds[c + 1] - 1
            if c == k or math.floor(n / self.t + 1e-9) >= self.bounds[c]:
                d = self.differ(top, top)
                out.append((c, d + 1 if d == 0 else math.ceil((d + 1) * 1.1) + 3, self.differ(n, min(top, math.floor(n / self.t + 1e-9)))))
        return out


def fragment_keys(s: np.ndarray, classes: Classes) -> list[tuple[np.ndarray, int]]:
    """By class (one or two): a hash per fragment, empty fragments only where the others might be too few, and how many
    of them a linked set of that class must have too."""
    out = []
    for c, fragments, differ in classes.of(len(s)):
        f = ((s >> U64(32)) * U64(fragments)) >> U64(32)
        starts = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
        which = f[starts]
        total = np.add.reduceat(mixed(s ^ U64(0xA0761D6478BD642F)), starts)
        if len(starts) <= differ:
            empty = np.setdiff1d(np.arange(fragments, dtype=U64), which)
            which, total = np.concatenate([which, empty]), np.concatenate([total, np.zeros(len(empty), U64)])
        out.append((mixed(total + mixed(which * U64(1024) + U64(c))), max(1, len(starts) - differ)))
    return out


def set_id(s: np.ndarray) -> tuple[int, int]:
    """Two independent hashes of a set."""
    if not len(s):
        return 0, 0
    n = len(s) * 0x589965CC75374CC3 & (1 << 64) - 1
    one, two = np.add.reduce(mixed(s + U64(0x8EBC6AF09C88C6E3))), np.add.reduce(mixed(mixed(s ^ U64(0x2545F4914F6CDD1D)) + U64(0xA24BAED4963EE407)))
    return int(one ^ U64(n)), int(two ^ U64(n))


def _signed(values) -> np.ndarray:
    return np.asarray(values, U64).view(np.int64)


ROW_KEY = ("doc_id", "text")  # what a row is told apart by (as 64 bits, next to the hashes of its set)


def _described(docs: DataFrame, width: int, classes: Classes) -> DataFrame:
    """doc_id, row_key, n, sid, check of each row; the fragment keys in its first and second class, and how many must be shared."""
    schema = with_fields(docs.select("doc_id").schema, "row_key long, n long, sid long, `check` long, keys1 array<long>, keys2 array<long>, need1 int, need2 int")

    def rows(batches):
        hasher = WordHasher(SPACED)
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            n, sid, needs, none = [], [], ([], []), (np.zeros(0, U64), 0)
            keys, ends = ([none[0]], [none[0]]), ([0], [0])
            for a, b in pieces(offsets):
                for s in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hasher, width):
                    n.append(len(s))
                    sid.append(set_id(s))
                    found = [*(fragment_keys(s, classes) if len(s) else ()), none, none]
                    for k in (0, 1):
                        keys[k].append(found[k][0])
                        ends[k].append(ends[k][-1] + len(found[k][0]))
                        needs[k].append(found[k][1])
            lists = [pa.ListArray.from_arrays(pa.array(np.array(ends[k], np.int32)), pa.array(_signed(np.concatenate(keys[k])))) for k in (0, 1)]
            ids = [pa.array(_signed([x[k] for x in sid])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *ids, *lists, *(pa.array(x, pa.int32()) for x in needs)], schema.fieldNames())

    return docs.select("doc_id", F.xxhash64(*ROW_KEY).alias("row_key"), "text").mapInArrow(rows, schema)


def _tokens(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """sid, fragment, n and part: the sorted shingles of each chosen set (row_key, sid, check, copies) by fragments of their
    order, all fragments of each set; a repeated row repeats its set."""
    names = ["sid", "fragment", "n", "part"]
    cuts = np.arange(1, FRAGMENTS, dtype=U64) * U64((1 << 64) // FRAGMENTS)

    def rows(batches):
        hasher = WordHasher(SPACED)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            want = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for a, b in pieces(offsets):
                out = []
                for k, s in enumerate(shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hasher, width), a):
                    if int(_signed([set_id(s)[1]])[0]) == want[k][1]:  # else another row with the same key
                        at = [0, *np.searchsorted(s, cuts).tolist(), len(s)]
                        out += [(want[k][0], f, len(s), s[at[f] : at[f + 1]].tobytes()) for f in range(FRAGMENTS)]
                columns = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names)

    keyed = docs.select("text", F.xxhash64(*ROW_KEY).alias("row_key"))
    found = joined(keyed, written(chosen.select("row_key", "sid", "check", "copies"), "chosen"), "row_key", "copies").select("text", "sid", "check")
    return found.mapInArrow(rows, "sid long, fragment int, n long, part binary")


def partial_overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many shingles each set of left has in common with each of right (None: of left), within one fragment."""
    sets = left + (right or [])
    n = len(left)
    rest = slice(0, n) if right is None else slice(n, len(sets))
    overlap = np.zeros((n, len(sets[rest])), np.int32)
    tokens = np.concatenate(sets)
    if not len(tokens):
        return overlap
    _, at, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts > 1
    keep = shared[at]
    row, column = row[keep], (np.cumsum(shared) - 1)[at][keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(shared.sum()), COLUMNS):
        part = slice(*np.searchsorted(column, [first, first + COLUMNS]))
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[row[part], column[part] - first] = 1
        overlap += (x[:n] @ x[rest].T).astype(np.int32)  # whole numbers below 2^24
    return overlap


def linked(overlap: np.ndarray, left: np.ndarray, right: np.ndarray | None, percent: int) -> np.ndarray:
    """Links from whole overlaps and set sizes, as a symmetric boolean matrix over the sets of left and of right."""
    n = len(left)
    other, rest = (left, slice(0, n)) if right is None else (right, slice(n, n + len(right)))
    union = left[:, None] + other[None] - overlap
    links = np.zeros((max(n, rest.stop),) * 2, bool)
    links[:n, rest] = 100 * overlap.astype(np.int64) >= percent * union
    return links | links.T


def roots(links: np.ndarray) -> np.ndarray:
    """The first member of each row's component in a symmetric boolean matrix."""
    label = np.arange(len(links))
    while True:
        low = np.minimum(label, np.where(links, label[None], len(links)).min(1, initial=len(links)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _grouped(batches, width: int):
    """Rows of sorted batches by their first ``width`` columns: (group, rows), one group at a time."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != now:
                if held:
                    yield now, held
                now, held = row[:width], []
            held.append(row[width:])
    if held:
        yield now, held


def _compared(tasks: DataFrame, percent: int) -> DataFrame:
    """(a, b): linked sets and the representative of their component in a pair of blocks, of rows (cluster, i, j, block, sid,
    fragment, n, part)."""
    kind = "cluster long, i long, j long, fragment int, left int, sids binary, sizes binary, counts binary"
    names = [x.split()[0] for x in kind.split(", ")]

    def counted(batches):
        for (cluster, i, j, fragment), held in _grouped(batches, 4):
            sets = {(block != i, sid): (n, np.frombuffer(raw, U64)) for block, sid, n, raw in held}
            order = sorted(sets)  # the same in every fragment
            split = sum(not k[0] for k in order)
            parts = [sets[k][1] for k in order]
            if i != j and split in (0, len(order)):
                continue
            counts = partial_overlaps(parts[:split], parts[split:] if i != j else None)
            sids, sizes = (np.array([k[1] for k in order], np.int64), np.array([sets[k][0] for k in order], np.int64)) if fragment == 0 else (np.zeros(0, np.int64),) * 2
            row = [cluster, i, j, fragment, split, sids.tobytes(), sizes.tobytes(), zlib.compress(counts.tobytes(), 1)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(),) * 3 + (pa.int32(),) * 2 + (pa.binary(),) * 3, strict=True)], names)

    def summed(batches):
        for (_, i, j), held in _grouped(batches, 3):
            total = 0
            for fragment, split, sids, sizes, raw in held:
                if fragment == 0:
                    n, ids, size = split, np.frombuffer(sids, np.int64), np.frombuffer(sizes, np.int64)
                total = total + np.frombuffer(zlib.decompress(raw), np.int32)
            overlap = total.reshape(n, -1)
            found = roots(linked(overlap, size[:n], size[n:] if i != j else None, percent))
            far = np.flatnonzero(found != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[found[far]])], ["a", "b"])

    parts = tasks.select("cluster", "i", "j", "fragment", "block", "sid", "n", "part")
    parts = parts.repartition("cluster", "i", "j", "fragment").sortWithinPartitions("cluster", "i", "j", "fragment").mapInArrow(counted, kind)
    return parts.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "fragment").mapInArrow(summed, "a long, b long")


SIZE = f"n + {ROW_TOKENS}"  # of a set in a block


def _blocked(nodes: DataFrame) -> DataFrame:
    """cluster, sid, n and block of rows (cluster, sid, n, large, met): a small cluster is one block; a large one is cut into bands of
    set sizes and a large band by hashes, apart for ``met`` and the rest.  No task sees a cluster's rows in order."""
    band = F.when(F.col("large"), F.floor(F.log(F.col("n")) / math.log(BAND)) + 1 + F.when(F.col("met"), 1 << 20).otherwise(0)).otherwise(0).cast("long")
    banded = written(nodes.withColumn("band", band), "bands")
    cuts = written(banded.groupBy("cluster", "band").agg(F.ceil(F.sum(F.expr(SIZE)) / BLOCK_TOKENS).alias("cuts"), F.count(F.lit(1)).alias("rows")), "cuts")
    part = F.pmod(F.xxhash64("sid"), F.col("cuts"))
    return written(joined(banded, cuts, ["cluster", "band"], "rows").select("cluster", "sid", "n", F.shiftleft("band", 32).bitwiseOR(part).alias("block")), "blocks")


def _tasks(blocked: DataFrame, percent: int) -> DataFrame:
    """(cluster, i, j, block, sid): the pairs of blocks in which each set takes part."""
    bounds = written(blocked.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("rows")), "bounds")
    one, two = bounds.drop("rows").toDF("cluster", "i", "li", "hi"), bounds.drop("rows").toDF("cluster", "j", "lj", "hj")
    met = F.lit(1 << 52)  # the bit of a block whose sets are linked to one set
    pairs = one.join(two, "cluster").where("i <= j").where((F.col("hi") * 100 >= F.col("lj") * percent) & (F.col("hj") * 100 >= F.col("li") * percent)).where(F.col("i").bitwiseAND(F.col("j")).bitwiseAND(met) == 0)
    sides = pairs.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return blocked.join(bounds.select("cluster", "block"), ["cluster", "block"]).join(sides, ["cluster", "block"]).select("cluster", "i", "j", "block", "sid")


def _edges(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links by which the sets of each cluster fall into their components; nodes: (sid, n, cluster, row_key, check, copies)."""
    def compared(tasks: DataFrame, members: DataFrame) -> DataFrame:
        tasks = written(tasks, "tasks")
        return written(_compared(_tokens(docs, members, width).join(bounded(tasks, BROADCAST_ROWS), "sid"), percent), "links")

    stand = F.min(F.struct(F.xxhash64("sid").alias("h"), "sid"))["sid"].alias("stand")
    whole = written(nodes.groupBy("cluster").agg((F.sum(F.expr(SIZE)) > BLOCK_TOKENS).alias("large"), stand, F.count(F.lit(1)).alias("rows")), "clusters")
    known = written(joined(nodes, whole, "cluster", "rows").withColumn("met", F.lit(False)), "known")
    large, edges = known.where("large"), None
    if not whole.where("large").isEmpty():  # all of a large cluster against one of it
        blocked = _blocked(large.select("cluster", "sid", "n", "large", "met"))
        alone = F.lit(-1).cast("long")
        sides = blocked.select("cluster", F.col("block").alias("i"), alone.alias("j"), "block", "sid")
        heads = blocked.select("cluster", F.col("block").alias("i")).distinct().join(whole.where("large").select("cluster", "stand"), "cluster")
        heads = heads.select("cluster", "i", alone.alias("j"), alone.alias("block"), F.col("stand").alias("sid"))
        edges = compared(sides.join(light(whole.select(F.col("stand").alias("sid"))), "sid", "left_anti").unionByName(heads), large)
        near = written(edges.select("a").union(edges.select("b")).distinct().withColumnRenamed("a", "sid"), "near")
        known = known.join(light(near.withColumn("linked", F.lit(True))), "sid", "left").withColumn("met", F.coalesce("linked", F.lit(False)) & F.col("large"))
    blocked = _blocked(known.select("cluster", "sid", "n", "large", "met"))
    rest = compared(_tasks(blocked, percent), nodes)
    return rest if edges is None else edges.union(rest)


def _sets(described: DataFrame) -> DataFrame:
    """One row per distinct set: sid, check, n, what must be shared, the number of its rows, and the row that stands for it
    (its fields come from one aggregate; a null doc_id is the last choice) with the number of copies of that row."""
    same = described.where("n > 0").groupBy("sid", "check", "n", "doc_id", "row_key").agg(F.first("need1").alias("need1"), F.first("need2").alias("need2"), F.count(F.lit(1)).alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("least"), "row_key", "copies")).alias("first")
    sets = same.groupBy("sid", "check", "n").agg(first, F.first("need1").alias("need1"), F.first("need2").alias("need2"), F.sum("copies").alias("rows"))
    return written(sets.select("sid", "check", "n", "first.least", "first.row_key", "first.copies", "need1", "need2", "rows"), "distinct")


def _linked(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The described rows of docs (doc_id, text), their distinct sets, and (node, component) of the sets with links."""
    modest_batches(docs.sparkSession)
    modest_broadcasts(docs.sparkSession)
    classes = Classes(percent)
    described = written(_described(docs, width, classes), "sets")
    sets = _sets(described)
    while True:  # different sets with one sid (hardly ever) get new ones from their second hash
        twice = written(sets.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sid", F.lit(True).alias("again")), "twice")
        if twice.isEmpty():
            break
        described = written(described.join(light(twice), "sid", "left").withColumn("sid", F.when(F.col("again"), F.xxhash64("sid", "check")).otherwise(F.col("sid"))).drop("again"), "sets")
        sets = _sets(described)
    # all rows of a set have equal keys: one of them is enough
    several = written(sets.where("rows > 1").select("sid", F.col("row_key").alias("stand"), "rows"), "several")
    extra = joined(described.where("n > 0").select("sid", "row_key"), several, "sid", "rows").where("row_key != stand").select("sid", "row_key").distinct()
    extra = written(extra, "extra")
    one = described.where("n > 0").join(bounded(extra, BROADCAST_ROWS), ["sid", "row_key"], "left_anti")
    tagged = F.concat(F.transform("keys1", lambda k: F.struct(k.alias("key"), F.lit(1).cast("byte").alias("of"))), F.transform("keys2", lambda k: F.struct(k.alias("key"), F.lit(2).cast("byte").alias("of"))))
    keyed = one.select("sid", F.explode(tagged).alias("k")).select("sid", "k.*")
    bounds = (F.min("sid").alias("low"), F.max("sid").alias("high"), F.count(F.lit(1)).alias("rows"))
    shared = written(keyed.groupBy("key").agg(*bounds).where("low != high").select("key", "rows"), "shared")
    # most fragments are in one set only: they aren't shuffled again
    members = written(joined(sieved(keyed, shared, "key"), shared, "key", "rows").select("key", "of", "sid").distinct(), "members")
    for _ in range(PEELS):  # a set with too few shared fragments has no link; without it, others may have too few
        enough = members.groupBy("sid", "of").count().join(sets.select("sid", "need1", "need2"), "sid").where(F.col("count") >= F.when(F.col("of") == 1, F.col("need1")).otherwise(F.col("need2"))).select("sid", "of")
        members = members.select("key", "of", "sid").join(enough, ["sid", "of"], "left_semi")
        lone = written(members.groupBy("key").agg(*bounds).where("low != high").select("key", "low", "rows"), "lone")
        members = written(joined(members, lone, "key", "rows").select("key", "of", "sid", "low"), "members")
    stars = written(members.where("low != sid").select(F.col("low").alias("a"), F.col("sid").alias("b")).distinct(), "stars")
    nodes = connected_components(stars).select(F.col("node").alias("sid"), F.col("component").alias("cluster"))
    nodes = written(nodes.join(sets, "sid").select("sid", "n", "cluster", "row_key", "check", "copies"), "nodes")
    return described, sets, written(connected_components(_edges(docs, nodes, width, percent)), "reached")


def components_by_similarity(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    since = len(MADE)
    described, sets, reached = _linked(docs.select("doc_id", "text"), width, percent)
    smallest = reached.join(sets, F.col("node") == F.col("sid")).groupBy("component").agg(F.min("least").alias("small"))
    mapped = reached.join(smallest, "component").select(F.col("node").alias("sid"), "small")
    to = written(sets.join(mapped, "sid", "left").select("sid", "rows", F.coalesce("small", "least").alias("component_id")), "to")
    forget(docs.sparkSession, since, keep=(described, to))
    rows = described.select("doc_id", F.col("n").alias("n_shingles"), "sid")
    found = joined(rows.where("n_shingles > 0"), to, "sid", "rows").select("doc_id", "n_shingles", "component_id")
    return found.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when one document of each component is kept: that whose doc_id is the component's.

    Rows without words are all kept.  Of several rows with that doc_id one is kept; without any doc_id, one row.
    """
    since = len(MADE)
    described, sets, reached = _linked(docs.select("doc_id", "text"), width, percent)
    # components are told apart by a set of theirs, as a doc_id (or null) can be in several
    of = sets.join(reached.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    first = of.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("unnamed"), "least", "row_key", "copies")).alias("first"))
    stay_key, weight = unused(docs.columns, "stay_key", "copies")
    # a row without words has the same key as its repeats, which all stay
    wordless = described.where("n = 0").groupBy("row_key").agg(F.lit(False), F.count(F.lit(1)))
    stay = written(first.select(F.col("first.row_key").alias(stay_key), (F.col("first.copies") > 1).alias("repeated"), F.col("first.copies").alias(weight)).union(wordless), "stay")
    forget(docs.sparkSession, since)
    keyed = docs.withColumn(stay_key, F.xxhash64(*ROW_KEY))

    def chosen(repeated: bool) -> DataFrame:
        return joined(keyed, stay.where(F.col("repeated") == repeated).drop("repeated"), stay_key, weight).select(*docs.columns)

    if stay.where("repeated").isEmpty():
        return chosen(False)
    # by their text, as columns of any type (maps have no order) are kept
    whole = F.struct(*docs.columns)
    one = chosen(True).groupBy(F.xxhash64(*ROW_KEY)).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return chosen(False).union(one.select("row.*"))
