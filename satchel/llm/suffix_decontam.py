"""Benchmark decontamination with suffix arrays over the training documents.

Each shard (some megabytes of documents) gets a suffix array over its words, by prefix doubling until the order of the
suffixes is settled to the window's length at least.  Every suffix of every benchmark item is binary-searched in the
array of every shard, one word at a time: the interval of suffixes that agree so far narrows with each word, and suffixes
whose interval is empty are dropped, so that most are done after a word or two.  Suffixes with the same window have the same
interval, so places are read once for a window, however many items share it: what is kept is the words that are hit, the
set of items of each document, and its longest verbatim match.  That one is found in the order of the items' own suffixes,
where the longest match of a place is next to it; lengths are searched by halves with sums of hashes, not word by word.  So
the work grows with texts and hits, and not with occurrences times items.

The benchmark is written in blocks of bounded size to the shared folder.  A task reads one block at a time, for as many
documents as a shard holds: there is one pass over the documents and one Python worker a task, and neither a task nor the
driver holds more than one block.

Words are told apart by 64 bits (windows are found by half of them and then compared by sums of all).  Null and empty texts
have no words and are clean; items without words match nothing; repeated items and documents are all reported (of matches
of equal length the first in the document, then the first item, is the longest); an empty benchmark leaves every document
clean.  A long text is cut into slices that overlap by a window.  Columns of docs that have names of the result's get
underscores behind those of the result.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM, U64, WordHasher, fresh_path, modest_batches, pieces, store, text_bytes, unused, with_fields

SHARD_BYTES = 16 << 20  # documents of a shard
SHARD_WORDS = 2 << 20  # suffixes of a suffix array
RESULT = ("decon_words", "decon_hit", "decon_longest", "decon_longest_at", "decon_longest_item", "decon_items", "decon_spans")
BASE = U64(0x9E3779B97F4A7C15)  # odd; sums of hashes are taken modulo 2^64


class Sums:
    """Sums of hashes times powers, from which equal runs of words are told in one step."""

    def __init__(self, hashes: np.ndarray, powers: np.ndarray) -> None:
        self.upto, self.powers = np.concatenate([[U64(0)], np.cumsum(hashes * powers[: len(hashes)], dtype=np.uint64)]), powers

    def of(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of the n words from ``at``; comparable after a product with the power of the other side's place."""
        return self.upto[at + n] - self.upto[at]


def powers(n: int) -> np.ndarray:
    return np.concatenate([[U64(1)], np.cumprod(np.full(max(0, n - 1), BASE), dtype=np.uint64)])


class Block:
    """The suffixes of a block of items, ready to be searched, and in their own order."""

    def __init__(self, ids: list[str], texts: list[str], window: int) -> None:
        self.window, self.ids = window, np.array(ids, object)
        data, offsets = text_bytes(pa.array(texts, pa.large_string()))
        _, _, self.hashes, at = WordHasher(ALNUM)(data, offsets)
        counts = np.diff(at)
        need = np.minimum(window, counts)
        n = np.where(counts > 0, counts - need + 1, 0)
        #: of each suffix that is searched: its item, first word and length
        self.items = np.repeat(np.arange(len(ids)), n)
        self.position = np.repeat(at[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.lengths = need[self.items]
        #: of each word: its item and that one's end; all suffixes in their order, and the different words
        self.owner, self.stop = np.repeat(np.arange(len(ids)), counts), np.repeat(at[1:], counts)
        self.known, numbers = np.unique(self.hashes, return_inverse=True)
        self.numbers = 2 * numbers.astype(np.int64) + 2  # words of documents lie between, where they aren't known
        self.order = suffix_array(self.numbers.astype(np.uint64), self.stop, int(counts.max(initial=1)))
        self.rank = np.empty(len(ids), np.int64)  # of the item ids as strings
        self.rank[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))

    FIELDS = ("hashes", "items", "position", "lengths", "owner", "stop", "known", "numbers", "order", "rank")

    def packed(self) -> bytes:
        out = io.BytesIO()
        ids = "\n".join(i.replace("\\", "\\\\").replace("\n", "\\n") for i in self.ids)
        np.savez(out, ids=np.frombuffer(ids.encode() or b"", np.uint8), n=np.array([len(self.ids), self.window]), **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def unpacked(cls, raw: bytes) -> Block:
        out = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as found:
            for f in cls.FIELDS:
                setattr(out, f, found[f])
            n, out.window = found["n"].tolist()
            ids = found["ids"].tobytes().decode().split("\n") if n else []
        out.ids = np.array([_unescaped(i) for i in ids], object)
        return out


def _unescaped(s: str) -> str:
    return "\\".join(part.replace("\\n", "\n") for part in s.split("\\\\"))


def word_numbers(hashes: np.ndarray) -> np.ndarray:
    """Words by the upper half of their hash, never 0; words that agree in it are told apart when matches are compared."""
    return np.maximum(hashes >> U64(32), U64(1))


def suffix_array(words: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """The positions in the order of the words from there to the end of their document, settled to ``depth`` words at least.

    Prefix doubling: a sort by two words, then by what is known of the suffixes k words on, of those alone that are not
    yet settled.  Beyond the end of a document stands 0, so a prefix comes first.
    """
    n = len(words)
    key = words << U64(32)
    key[:-1] |= np.where(np.arange(1, n) < end[:-1], words[1:], U64(0))
    order = np.argsort(key)
    found = key[order]
    new = np.append(True, found[1:] != found[:-1])
    rank = np.empty(n, np.int64)  # the place in the order where those that agree so far begin
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    k, open_ = 2, np.flatnonzero(~new | ~np.append(new[1:], True))
    while k < depth and len(open_):
        mine = order[open_]
        after = mine + k
        key = rank[mine] * (n + 1) + np.where(after < end[mine], rank[np.minimum(after, n - 1)] + 1, 0)
        move = np.argsort(key)
        mine, key = mine[move], key[move]
        order[open_] = mine
        new = np.append(True, key[1:] != key[:-1])
        rank[mine] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~new | ~np.append(new[1:], True)]
        k *= 2
    return order


def intervals(words: np.ndarray, end: np.ndarray, array: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's suffixes that occur, and for each the interval of the suffix array that begins with its words."""
    firsts, known = words[array], word_numbers(block.hashes)
    alive = np.arange(len(block.position))
    key = known[block.position]
    low, high = np.searchsorted(firsts, key, "left"), np.searchsorted(firsts, key, "right")
    done = []
    for d in range(1, block.window + 1):
        some = high > low
        alive, low, high = alive[some], low[some], high[some]
        over = block.lengths[alive] <= d
        done.append((alive[over], low[over], high[over]))
        alive, low, high = alive[~over], low[~over], high[~over]
        if not len(alive):
            break
        key = known[block.position[alive] + d]

        def bound(after: bool) -> np.ndarray:
            a, z = low.copy(), high.copy()
            while (open_ := np.flatnonzero(a < z)).size:
                mid = (a[open_] + z[open_]) // 2
                at = array[mid] + d
                word = np.where(at < end[array[mid]], words[np.minimum(at, len(words) - 1)], U64(0))
                less = word <= key[open_] if after else word < key[open_]
                a[open_[less]] = mid[less] + 1
                z[open_[~less]] = mid[~less]
            return a

        low, high = bound(False), bound(True)
    return tuple(np.concatenate([x[i] for x in done]) if done else np.zeros(0, np.int64) for i in range(3))


class Hits:
    """Where windows of a block occur in the words of a shard.

    ``starts``, ``lengths`` and ``group``: each place once for each different window, in order; ``members``: the items of
    each window."""

    def __init__(self, block: Block, hashes: np.ndarray, at: np.ndarray) -> None:
        self.block, self.at, total, words = block, at, len(hashes), word_numbers(hashes)
        self.hashes, self.ends = hashes, np.repeat(at[1:], np.diff(at))
        self.powers = powers(max(total, len(block.hashes)) + 1)
        self.sums, self.own = Sums(hashes, self.powers), Sums(block.hashes, self.powers)
        keys, found = self._windows(), [(np.zeros(0, np.int64),) * 2]
        for first in range(0, max(0, total), SHARD_WORDS):
            last = min(total, first + SHARD_WORDS + block.window - 1)
            end = np.minimum(self.ends[first:last], last) - first
            array = suffix_array(words[first:last], end, block.window)
            suffix, low, high = intervals(words[first:last], end, array, block)
            # suffixes with one window have one interval
            window, one = np.unique(keys[suffix], return_index=True)
            low, n = low[one], (high - low)[one]
            place = array[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] + first
            found.append((np.repeat(window, n), place))
        pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)][::-1], 1), axis=0)
        self.starts, self.group = pairs[:, 0], pairs[:, 1]
        one = self.example[self.group]
        self.lengths, q = block.lengths[one], block.position[one]
        same = self.sums.of(self.starts, self.lengths) * self.powers[q] == self.own.of(q, self.lengths) * self.powers[self.starts]
        self.starts, self.group, self.lengths = self.starts[same], self.group[same], self.lengths[same]
        self.doc = np.searchsorted(at, self.starts, "right") - 1

    def _windows(self) -> np.ndarray:
        """A number of each suffix's window; keeps the suffixes of each, in the order of windows."""
        b = self.block
        value = (self.own.of(b.position, b.lengths) * self.powers[len(b.hashes) - b.position]) if len(b.position) else np.zeros(0, np.uint64)
        order = np.lexsort((value, b.lengths))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(b.lengths[order]) != 0) | (value[order][1:] != value[order][:-1])
        numbers = np.empty(len(order), np.int64)
        numbers[order] = np.cumsum(new) - 1
        self.members, self.member_at = order, np.append(np.flatnonzero(new), len(order))
        self.example = order[np.flatnonzero(new)]
        return numbers

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of words that are hit: document, first word in it, and the word behind the last."""
        if not len(self.starts):
            return (np.zeros(0, np.int64),) * 3
        stops = self.starts + self.lengths
        upto = np.maximum.accumulate(stops)
        # a run doesn't cross documents, as no window does; runs that touch are one
        new = np.append(True, (self.starts[1:] > upto[:-1]) | (self.doc[1:] != self.doc[:-1]))
        first = np.flatnonzero(new)
        stop = np.maximum.reduceat(stops, first)
        return self.doc[first], self.starts[first] - self.at[self.doc[first]], stop - self.at[self.doc[first]]

    def items(self) -> dict[int, np.ndarray]:
        """The items of each document that is hit."""
        pairs = np.unique(np.stack([self.doc, self.group], 1), axis=0)
        out: dict[int, np.ndarray] = {}
        for d, groups in _grouped(pairs):
            out[d] = np.unique(self.block.items[np.concatenate([self.members[self.member_at[g] : self.member_at[g + 1]] for g in groups])])
        return out

    def _common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many words of the shard from p and of the items from q agree."""
        low, high = np.zeros(len(p), np.int64), np.minimum(self.ends[p] - p, self.block.stop[q] - q)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.sums.of(p, mid) * self.powers[q] == self.own.of(q, mid) * self.powers[p]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def _found(self, p: np.ndarray, goes_left) -> np.ndarray:
        """For each place the first suffix in the items' order that goes_left(place number, suffix, common) doesn't put before."""
        low, high = np.zeros(len(p), np.int64), np.full(len(p), len(self.block.order))
        while len(some := np.flatnonzero(low < high)):
            mid = (low[some] + high[some]) // 2
            q = self.block.order[mid]
            before = goes_left(some, q, self._common(p[some], q))
            low[some[before]], high[some[~before]] = mid[before] + 1, mid[~before]
        return low

    def longest(self) -> list[tuple[int, int, int, int]]:
        """(document, first word in it, words, item): of each document the longest verbatim match of a window or more, the
        first one of equal length, and the item that comes first of those with it."""
        return [m for m in self._matches(True)]

    def _matches(self, one: bool) -> list[tuple[int, int, int, int]]:
        """Longest matches by place, without those that are the end of the match of the place before; or one for each
        document."""
        b = self.block
        if not len(self.starts):
            return []
        # of windows that begin at one place the longest
        last = np.append(self.starts[1:] != self.starts[:-1], True)
        first = np.append(0, np.flatnonzero(last)[:-1] + 1)
        p, words = self.starts[last], np.maximum.reduceat(self.lengths, first)
        full = np.flatnonzero(words >= b.window)
        place = p[full]
        spot = np.minimum(np.searchsorted(b.known, self.hashes), max(0, len(b.known) - 1))
        numbers = 2 * spot + 2 + np.where(b.known[spot] == self.hashes, 0, np.where(b.known[spot] < self.hashes, 1, -1))

        def before(some, q, n):  # whether the items' suffix comes before the place's
            ended = q + n >= b.stop[q]
            over = ~ended & (place[some] + n >= self.ends[place[some]])
            mine = numbers[np.minimum(place[some] + n, len(numbers) - 1)]
            return ended | (~over & (b.numbers[np.minimum(q + n, len(b.numbers) - 1)] < mine))

        at = self._found(place, before)
        for k in (at - 1, at):
            able = (k >= 0) & (k < len(b.order))
            n = np.zeros(len(k), np.int64)
            n[able] = self._common(place[able], b.order[k[able]])
            words[full] = np.maximum(words[full], n)
        doc = np.searchsorted(self.at, p, "right") - 1
        if one:
            order = np.lexsort((p, -words, doc))
            pick = order[np.append(True, doc[order][1:] != doc[order][:-1])]
        else:
            pick = np.flatnonzero(~np.append(False, (doc[1:] == doc[:-1]) & (p[1:] == p[:-1] + 1) & (words[1:] == words[:-1] - 1)))
        items = self._first_items(p[pick], words[pick])
        return list(zip(doc[pick].tolist(), (p[pick] - self.at[doc[pick]]).tolist(), words[pick].tolist(), items, strict=True))

    def _first_items(self, p: np.ndarray, words: np.ndarray) -> list[int]:
        """Of the items that hold so many words from each place the first by its id; below a window, of whole short items."""
        b, out, seen = self.block, [], {}
        far = words >= b.window
        place, least = p[far], words[far]
        spot = np.minimum(np.searchsorted(b.known, self.hashes), max(0, len(b.known) - 1))
        numbers = 2 * spot + 2

        def bound(after: bool) -> np.ndarray:
            def goes(some, q, n):
                n = np.minimum(n, least[some])
                whole = n >= least[some]
                ended = ~whole & (q + n >= b.stop[q])
                smaller = b.numbers[np.minimum(q + n, len(b.numbers) - 1)] < numbers[np.minimum(place[some] + n, len(numbers) - 1)]
                return np.where(whole, after, ended | smaller)

            return self._found(place, goes)

        low, high = bound(False), bound(True)
        ranks = b.rank[b.owner[b.order]]
        back = np.argsort(b.rank)
        for x, z in zip(low.tolist(), high.tolist(), strict=True):
            if (x, z) not in seen:
                seen[x, z] = int(back[ranks[x:z].min()])
            out.append(seen[x, z])
        found = iter(out)
        short = {}
        if not far.all():
            for start, n, g in zip(self.starts.tolist(), self.lengths.tolist(), self.group.tolist(), strict=True):
                if n < b.window:
                    mine = b.items[self.members[self.member_at[g] : self.member_at[g + 1]]]
                    short[start, n] = int(back[b.rank[mine].min()])
        return [next(found) if f else short[s, n] for f, s, n in zip(far.tolist(), p.tolist(), words.tolist(), strict=True)]


def _grouped(pairs: np.ndarray):
    """(key, values) of sorted pairs."""
    if len(pairs):
        cut = np.flatnonzero(np.append(True, pairs[1:, 0] != pairs[:-1, 0]))
        for a, z in zip(cut, np.append(cut[1:], len(pairs)), strict=True):
            yield int(pairs[a, 0]), pairs[a:z, 1]


def matches(block: Block, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, first word in it, words, item): the longest verbatim match of each place, of a window at least, without those
    that are the end of the one before."""
    return Hits(block, hashes, at)._matches(False)


def _blocks(benchmark: DataFrame, window: int, block_items: int, block_chars: int):
    """Blocks of at most so many items and characters (a longer item is a block of its own)."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        if ids and (len(ids) >= block_items or size + len(r.t) > block_chars):
            yield Block(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append("" if r.i is None else r.i)
        texts.append(r.t)
        size += len(r.t)
    yield Block(ids, texts, window)


def _stored(benchmark: DataFrame, window: int, block_items: int, block_chars: int) -> list[str]:
    """The blocks as files of the shared folder; their paths."""
    folder = fresh_path(benchmark.sparkSession, "benchmark")
    fs, base = store(folder)
    fs.create_dir(base)
    out = []
    for i, block in enumerate(_blocks(benchmark, window, block_items, block_chars)):
        out.append(f"{folder}/block-{i:06d}.npz")
        with fs.open_output_stream(f"{base}/block-{i:06d}.npz", compression=None) as f:
            f.write(block.packed())
    return out


class Found:
    """What the blocks have shown of one document: runs of hit words, items, and the longest match."""

    def __init__(self) -> None:
        self.runs, self.items, self.best = [], set(), None

    def row(self) -> tuple:
        """hit, longest, its first word, its item, items, spans."""
        total, spans = 0, []
        for first, stop in sorted(self.runs):
            if spans and first <= spans[-1][1]:
                total += max(0, stop - spans[-1][1])
                spans[-1][1] = max(spans[-1][1], stop)
            else:
                total += stop - first
                spans.append([first, stop])
        words, first, item = (-self.best[0], *self.best[1:]) if self.best else (0, None, None)
        return total, words, first, item, sorted(self.items), [{"first": a, "last": z - 1} for a, z in spans]


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_items: int = 20_000, block_chars: int = 4_000_000) -> DataFrame:
    """All columns of docs, then the number of words, of words inside occurring windows, the length of the longest verbatim
    match, its first word and item, the item ids sorted as strings, and the spans of hit words (first word, last word)."""
    modest_batches(docs.sparkSession)
    names = docs.columns
    text_at = names.index("text")
    said = unused(names, *RESULT)
    kinds = ("int", "int", "int", "int", "string", "array<string>", "array<struct<first:int,last:int>>")
    schema = with_fields(docs.schema, ", ".join(f"`{n}` {k}" for n, k in zip(said, kinds, strict=True)))
    types = [*(pa.int32(),) * 4, pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))]
    files = _stored(benchmark, window, block_items, block_chars)

    def rows(batches):
        hasher, now, block, none = WordHasher(ALNUM), None, None, Found()

        def searched(held: list[pa.RecordBatch]):
            nonlocal now, block
            words, found, parts, row = [], {}, [], 0
            for batch in held:
                data, offsets = text_bytes(batch.column(text_at))
                for a, b in pieces(offsets, SHARD_BYTES):
                    mine = data[offsets[a] : offsets[b]]
                    _, _, hashes, at = hasher(mine, offsets[a : b + 1])
                    parts.append((row + a, hashes, at))
                    words.append(np.diff(at))
                row += len(batch)
            # from the block that the last shard ended with, so that the last one isn't read again
            for name in sorted(files, key=lambda f: f != now):
                if name != now:
                    fs, path = store(name)
                    with fs.open_input_stream(path, compression=None) as f:
                        block = Block.unpacked(f.read())
                    now = name
                for first, hashes, at in parts:
                    hits = Hits(block, hashes, at)
                    for d, a, z in zip(*(x.tolist() for x in hits.runs()), strict=True):
                        found.setdefault(first + d, Found()).runs.append((a, z))
                    for d, items in hits.items().items():
                        found[first + d].items.update(block.ids[items].tolist())
                    for d, p, n, i in hits.longest():
                        mine = (-n, p, block.ids[i])
                        found[first + d].best = min(found[first + d].best or mine, mine)
            counts = np.concatenate(words) if words else np.zeros(0, np.int64)
            row = 0
            for batch in held:
                own = [found.get(i, none).row() for i in range(row, row + len(batch))]
                columns = list(zip(*own, strict=True)) if own else [[]] * 6
                said_columns = [counts[row : row + len(batch)].astype(np.int32), *columns]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(said_columns, types, strict=True))], schema.fieldNames())
                row += len(batch)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(text_at).nbytes
            if size >= SHARD_BYTES:
                yield from searched(held)
                held, size = [], 0
        if held:
            yield from searched(held)

    return docs.mapInArrow(rows, schema)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the documents that hold a window of the benchmark."""
    found = decontaminated(docs, benchmark, window)
    hit = found.columns[len(docs.columns) + RESULT.index("decon_hit")]
    return found.where(F.col(hit) == 0).select(*docs.columns)


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; and the words of the longest verbatim
    match, its first word (null: none) and its item."""
    found = decontaminated(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    joined = F.concat_ws(",", "decon_items")
    return found.select("doc_id", F.col("decon_words").cast("long").alias("n_words"), F.col("decon_hit").cast("long").alias("n_hit"), F.size("decon_items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (F.col("decon_hit") > 0).alias("contaminated"), F.col("decon_longest").cast("long").alias("longest"), F.col("decon_longest_at").cast("long").alias("longest_at"), F.col("decon_longest_item").alias("longest_item"))


def brute_force(docs: list[tuple], items: list[tuple], window: int = 10) -> dict:
    """What decontamination_report must return, from plain loops (for tests)."""
    import re

    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = {c: c + 32 for c in range(65, 91)}
    cut = lambda t: pattern.findall((t or "").translate(low))
    out = {}
    for doc_id, text in docs:
        words = cut(text)
        hit, ids, best = set(), set(), (0, 0, "")
        for item_id, item in items:
            w, name = cut(item), "" if item_id is None else str(item_id)
            n = min(window, len(w))
            for q in range(len(w) - n + 1 if w else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == w[q : q + n]:
                        hit |= set(range(p, p + n))
                        ids.add(name)
                        to = n
                        while p + to < len(words) and q + to < len(w) and words[p + to] == w[q + to]:
                            to += 1
                        best = min(best, (-to, p, name))
        longest = (-best[0], best[1], best[2]) if hit else (0, None, None)
        out[doc_id] = (len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit), *longest)
    return out
