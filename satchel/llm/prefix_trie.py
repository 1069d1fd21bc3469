"""The prefix trie of conversations: which beginnings are shared, by whom, and how many characters that saves.

A conversation is a path of turns (role, text); a node is a distinct beginning.  A node's id is a running hash of its path,
two sums modulo 2^61 - 1 whose pieces can be put together, so a conversation may be cut anywhere: turns are sorted into
range partitions, each task hashes its part of a conversation, and the last state of a partition is carried into the
next (a row per partition is all that the driver sees).  So no task has to hold or even read a whole long conversation.

Each task combines its turns into a partial trie of bounded size and emits its nodes; partial tries are merged by node in two
rounds of hash-keyed sums, salted at first.  End lists are merged as sorted pieces of bounded size: range partitions by node
and conversation make them, and the pieces of a node are hashed in order as they stream by (a hash of one text is
sequential, and this is all that one task does for a popular node).  The rollup goes from the bottom up by doubling: after
round k each node has the sums of 2^k levels below it, so a depth of d takes log2(d) rounds.

Null roles and texts are empty ones; a null conv_id names no conversation, so its rows belong to none; turns of a
conversation that tie in ``turn`` are ordered by role and text, and repeated rows are turns of their own; texts enter as
hashes and lengths, however long they are.  An empty table has no nodes.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranks
from . import shared
from .shared import forget, joined, written

MOST_HEAD = 6  # h is below
FAMILY = 100  # conversations c - c % FAMILY to that + FAMILY - 1 share a head
PRIME = (1 << 61) - 1
BASES = (0x1D8E4E27C47D124F % PRIME, 0x0B4A5B21F3A9C663 % PRIME)
ROOT = bytes(16)
TRIE_NODES = 50_000  # of a partial trie, before it is emitted
PIECE = 1 << 16  # bytes of a piece of an end list


def appended(state: tuple[int, int, int], more: tuple[int, int, int]) -> tuple[int, int, int]:
    """The state (turns, two sums) of a path, of those of its beginning and of the rest."""
    n = more[0]
    return state[0] + n, (state[1] * pow(BASES[0], n, PRIME) + more[1]) % PRIME, (state[2] * pow(BASES[1], n, PRIME) + more[2]) % PRIME


def name(state: tuple[int, int, int]) -> bytes:
    return struct.pack(">QQ", state[1], state[2]) if state[0] else ROOT


def placed_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, p, digest, chars), p being the place of the turn in its conversation; and (conv_id, first, n)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))).withColumn("chars", F.length("text").cast("long"))
    turns = ranks.numbered(rows, ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"], "place", lambda x: written(x.drop("turn", "role", "text"), "turns"))
    convs = written(turns.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "convs")
    placed = joined(turns, convs, "conv_id", "n").select("conv_id", (F.col("place") - F.col("first")).alias("p"), "digest", "chars")
    return written(placed, "placed"), convs


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, p, digest, chars) of the rebuilt conversations, ordered by p; and all conv_id.

    Conversation c begins with the first h turns of c - c % FAMILY and goes on with its own behind its first h, h being
    crc32(c) % MOST_HEAD."""
    placed, convs = placed_turns(conversations)
    h = F.crc32(F.col("conv_id").cast("string")) % MOST_HEAD
    own = placed.where(F.col("p") >= h)
    heads = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("p") < MOST_HEAD - 1)).withColumnRenamed("conv_id", "base")
    first = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.alias("h")).join(heads, "base").where("p < h")
    return own.unionByName(first.select("conv_id", "p", "digest", "chars")), convs.select("conv_id")


STEPS = "conv_id long, part int, lead boolean, n long, a long, b long, before_a long, before_b long, chars long"


def hashed_steps(turns: DataFrame) -> DataFrame:
    """STEPS of each turn: partition, whether it belongs to the partition's first conversation, and the running state of the
    conversation in this partition, with and without the turn."""

    def run(batches):
        part, conv, lead, state = TaskContext.get().partitionId(), None, True, (0, 0, 0)
        for batch in batches:
            out = []
            for c, digest, chars in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if c != conv:
                    lead, conv, state = conv is None, c, (0, 0, 0)
                x, y = struct.unpack(">QQ", digest)
                before, state = state, (state[0] + 1, (state[1] * BASES[0] + x % PRIME + 1) % PRIME, (state[2] * BASES[1] + y % PRIME + 1) % PRIME)
                out.append((c, part, lead, *state, *before[1:], chars))
            columns = list(zip(*out, strict=True)) if out else [[]] * 9
            kinds = (pa.int64(), pa.int32(), pa.bool_(), *(pa.int64(),) * 6)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], STEPS.replace(",", "").split()[::2])

    return turns.repartitionByRange("conv_id", "p").sortWithinPartitions("conv_id", "p").select("conv_id", "p", "digest", "chars").mapInArrow(run, STEPS)


def carried(steps: DataFrame) -> dict[int, tuple[int, int, int]]:
    """For partitions that begin inside a conversation: its state at their beginning."""
    last = F.max(F.struct("conv_id", "n", "a", "b"))
    out, open_conv, state = {}, None, (0, 0, 0)
    for part, first, end in sorted(tuple(r) for r in steps.groupBy("part").agg(F.min("conv_id"), last).collect()):  # a row per partition
        mine = tuple(end)[1:]
        if first == open_conv:
            out[part] = state
        goes_on = first == open_conv and end[0] == first  # the whole partition is inside it
        open_conv, state = end[0], appended(state, mine) if goes_on else mine
    return out


def partial_tries(steps: DataFrame, carry: dict, trie_nodes: int = TRIE_NODES) -> DataFrame:
    """Nodes (node, parent, depth, chars, conv_id, n, part) of tries that tasks combine from their turns."""
    schema = "node binary, parent binary, depth long, chars long, conv_id long, n long, part int"
    kinds = (pa.binary(), pa.binary(), *(pa.int64(),) * 4, pa.int32())

    def combine(batches):
        part = TaskContext.get().partitionId()
        trie: dict[bytes, list] = {}

        def emitted():
            rows = [(k, *v, part) for k, v in trie.items()]
            trie.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema.replace(",", "").split()[::2])

        for batch in batches:
            for c, p, lead, n, a, b, before_a, before_b, chars in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                state, before = (n, a, b), (n - 1, before_a, before_b)
                if lead and p in carry:
                    state, before = appended(carry[p], state), appended(carry[p], before)
                found = trie.get(key := name(state))
                if found is None:
                    trie[key] = [name(before), state[0], chars, c, 1]
                else:
                    found[3], found[4] = min(found[3], c), found[4] + 1
            if len(trie) >= trie_nodes:
                yield emitted()
        if trie:
            yield emitted()

    return steps.mapInArrow(combine, schema)


def merged(partial: DataFrame) -> DataFrame:
    """Partial tries summed by node, first for each of 16 groups of them."""
    def summed(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy("node", *keys).agg(*(F.first(c).alias(c) for c in ("parent", "depth", "chars")), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"))

    some = summed(partial.withColumn("salt", F.col("part") % 16).drop("part"), "salt")
    return summed(some.drop("salt"))


def ends(steps: DataFrame, carry: dict, convs: DataFrame) -> DataFrame:
    """(node, conv_id): where each conversation ends, the root for those without turns."""
    last = steps.groupBy("conv_id").agg(F.max(F.struct("part", "n", "a", "b", "lead")).alias("s")).select("conv_id", "s.*")

    def named(batches):
        for batch in batches:
            out = []
            for p, n, a, b, lead in zip(*(x.to_pylist() for x in batch.columns[1:]), strict=True):
                out.append(name(appended(carry[p], (n, a, b)) if lead and p in carry else (n, a, b)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(0)], ["node", "conv_id"])

    found = last.mapInArrow(named, "node binary, conv_id long")
    return found.unionByName(convs.join(last, "conv_id", "left_anti").select(F.lit(ROOT).alias("node"), "conv_id"))


def end_digests(rows: DataFrame, piece_bytes: int = PIECE) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): the SHA-256 of the conv_ids in ascending order, comma-joined."""

    def pieces(batches):
        node, first, held, size = None, 0, [], 0

        def piece():
            return [(node, first, ",".join(held).encode())] if held else []

        for batch in batches:
            out = []
            for k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if k != node or size >= piece_bytes:
                    out += piece()
                    node, first, held, size = k, c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
            if out:
                yield _batch(out, (pa.binary(), pa.int64(), pa.binary()), ["node", "first", "piece"])
        if held:
            yield _batch(piece(), (pa.binary(), pa.int64(), pa.binary()), ["node", "first", "piece"])

    def digests(batches):
        node, running = None, None
        for batch in batches:
            out = []
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != node:
                    if running is not None:
                        out.append((node, running.hexdigest()))
                    node, running = k, hashlib.sha256(piece)
                else:
                    running.update(b"," + piece)
            if out:
                yield _batch(out, (pa.binary(), pa.string()), ["node", "ends_sha256"])
        if running is not None:
            yield _batch([(node, running.hexdigest())], (pa.binary(), pa.string()), ["node", "ends_sha256"])

    cut = rows.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pieces, "node binary, first long, piece binary")
    return cut.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node binary, ends_sha256 string")


def _batch(rows: list, kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def rolled_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """node and the sums over its subtree, itself included, of (node, parent, *sums); a root's parent is null."""
    left = written(nodes.select("node", F.col("parent").alias("up"), *sums), "rollup")
    while True:
        since = len(shared.MADE)
        add = left.where("up is not null").groupBy("up").agg(*(F.sum(c).alias(f"{c}_") for c in sums), F.count(F.lit(1)).alias("n"))
        hop = left.select(F.col("node").alias("up"), F.col("up").alias("next"))
        known = written(add.join(hop, "up"), "above")
        if known.isEmpty():
            forget(nodes.sparkSession, since, 0)
            return left.select("node", *sums)
        more = left.join(known.select(F.col("up").alias("node"), *(f"{c}_" for c in sums)), "node", "left").select("node", "up", *((F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c) for c in sums))
        higher = joined(more.where("up is not null"), known.select("up", "next", "n"), "up", "n")
        higher = higher.select("node", F.col("next").alias("up"), *sums)
        left = written(higher.unionByName(more.where("up is null")), "rollup")
        forget(nodes.sparkSession, since, 1)


def prefix_trie(conversations: DataFrame, trie_nodes: int = TRIE_NODES, piece_bytes: int = PIECE) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    since = len(shared.MADE)
    turns, convs = rebuilt(conversations)
    steps = written(hashed_steps(turns), "steps")
    carry = carried(steps)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("conv_id").alias("n")).where("n > 0")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "conv_id", "n")
    nodes = written(merged(partial_tries(steps, carry, trie_nodes)).unionByName(root), "nodes")
    kids = written(nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")), "kids")
    full = nodes.join(kids.withColumnRenamed("parent", "node"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = written(full, "trie")
    sums = rolled_up(full.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    parents = written(full.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children"), "parents")
    digests = end_digests(ends(steps, carry, convs), piece_bytes)
    below = joined(full.where("parent is not null").withColumnRenamed("n_children", "children"), parents, "parent", "n_children")
    top = full.where("parent is null").withColumnRenamed("n_children", "children").withColumn("parent_conv_id", F.lit(None).cast("long"))
    every = below.unionByName(top).join(sums, "node").join(digests, "node", "left")
    out = every.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    out = written(out, "prefixes")
    forget(conversations.sparkSession, since, 1)
    return out


def brute_force(rows: list[tuple]) -> list[tuple]:
    """What prefix_trie must return of (conv_id, turn, role, text), from plain loops (for tests)."""
    import zlib
    from collections import defaultdict

    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    members, ends_, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in own:
        h = zlib.crc32(str(c).encode()) % MOST_HEAD
        path = tuple(own.get(c - c % FAMILY, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                kids[path[: d - 1]].add(path[:d])
        ends_[path].append(c)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = sum(saved[k] for k in kids[path]) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    sha = lambda v: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(ends_[p])) for p, m in members.items()]
