"""What the operators have in common: the shared folder, cut lineage, and numpy views of Arrow text.

Everything an operator keeps between jobs is written below ``spark.checkpoint.dir``, which all executors and the
driver see.  Only where that setting is missing and the master is local (tests, one machine) is a temporary folder set
in its place; on a cluster a missing setting is an error.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ranks

U64 = np.uint64
#: Paths of the tables that written() has made and nothing has removed.
MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="satchel-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a short lineage that outlives any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared folder, if it is there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def with_fields(schema: T.StructType, ddl: str) -> T.StructType:
    """A copy of schema with the fields of a DDL string behind its own."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def store(uri: str):
    """The file system and path of a URI, as executors see it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def removed_file(uri: str) -> None:
    """Delete a file of the shared folder from where it was made, if it is there."""
    fs, path = store(uri)
    try:
        fs.delete_file(path)
    except FileNotFoundError:
        pass


def modest_batches(spark: SparkSession, rows: int = 1000, most_bytes: int = 16 << 20) -> None:
    """Texts can be long: hand Python workers at most so many rows, and near so many bytes, at once.

    These are settings of the session that plans read when they run, so they stay lowered; a row beyond the bytes is a
    batch of its own.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", most_bytes)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name, None)
        if not (now or "").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores appended until none is a column (whatever its case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def forget(spark: SparkSession, since: int, keep: int | tuple[DataFrame, ...] = 1) -> None:
    """Delete the written tables from number ``since`` on, but for the last ``keep``, or those that are read by plans of
    ``keep``."""
    if isinstance(keep, int):
        stay = set(MADE[len(MADE) - keep :]) if keep else set()
    else:
        files = {f for df in keep for f in df.inputFiles()}
        stay = {path for path in MADE[since:] if any(path.rsplit("/", 1)[1] in f for f in files)}
    for path in MADE[since:]:
        if path not in stay:
            removed(spark, path)
    MADE[since:] = [path for path in MADE[since:] if path in stay]


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with ``name``: 0, 1, 2, ... in this order, from range partitions and their counts; rows that tie are numbered in any
    order."""
    return ranks.numbered(df, order, name, lambda x: written(x, name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one uint8 array, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    buffers = column.buffers()
    if not n or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges (from, to) of rows whose bytes together stay near ``most``; one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place of nothing: a bijection that spreads the bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class WordHasher:
    """64-bit hashes of the words of many texts at once.

    A word's hash is the sum of a random number per place and byte, so two different words agree with a chance of 2^-64
    whatever they look like.  ``inside`` tells for each byte whether it belongs to words; A-Z count as a-z.  Texts are read in
    slices, and a word may span several of them: beyond the words themselves, memory doesn't grow with the text.
    """

    PLACES, SLICE = 64, 1 << 20

    def __init__(self, inside: np.ndarray) -> None:
        self.inside = inside.astype(bool)
        g = np.random.Generator(np.random.PCG64(20))
        near = g.integers(0, 1 << 64, (self.PLACES, 256), dtype=np.uint64)
        near[:, 65:91] = near[:, 97:123]
        self.near, self.far = near.ravel(), near[0] ^ near[1]

    def _cuts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, starts, ends, before = len(data), [], [], False
        kind = np.int32 if n < 1 << 31 else np.int64
        for a in range(0, n, self.SLICE):
            z = min(n, a + self.SLICE)
            inside = self.inside[data[a : min(n, z + 1)]]
            inside = np.append(inside, False) if z == n else inside
            first = np.zeros(z - a + 1, bool)
            first[bounds[np.searchsorted(bounds, a) : np.searchsorted(bounds, z, "right")] - a] = True
            now = inside[:-1]
            starts.append((np.flatnonzero(now & (~np.append(before, now[:-1]) | first[:-1])) + a).astype(kind))
            ends.append((np.flatnonzero(now & (~inside[1:] | first[1:])) + a + 1).astype(kind))
            before = bool(now[-1])
        return np.concatenate(starts), np.concatenate(ends)

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """Of texts data[offsets[i]:offsets[i + 1]]: word starts and ends in data, hashes, and n + 1 offsets into them."""
        n, bounds = len(data), offsets - offsets[0]
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, U64), np.zeros(len(offsets), np.int64)
        starts, ends = self._cuts(data, bounds)
        hashes = np.zeros(len(starts), U64)
        for a in range(0, n, self.SLICE):
            z = min(n, a + self.SLICE)
            w = slice(np.searchsorted(ends, a, "right"), np.searchsorted(starts, z, "left"))
            first, last = starts[w], np.minimum(ends[w], z) - a
            if not len(first):
                continue
            letter = data[a:z]
            begin = np.full(z - a, -(1 << 30), np.int32)  # of the word that a byte is in; negative for one from a slice before
            begin[np.maximum(first - a, 0)] = first - a
            place = np.arange(z - a, dtype=np.int32) - np.maximum.accumulate(begin)
            part = self.near[(np.minimum(place, self.PLACES - 1) << 8) | letter]
            late = np.flatnonzero(place >= self.PLACES)
            if len(late):
                part[late] = mixed(self.far[letter[late]] + place[late].astype(U64) * U64(0x9E3779B97F4A7C15))
            edges = np.stack([np.maximum(first - a, 0), last], 1).ravel()
            hashes[w] += np.add.reduceat(np.append(part, U64(0)), edges)[::2]
        return starts, ends, mixed(hashes + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)), np.searchsorted(starts, bounds)


#: Words are runs of bytes other than space and \t \n \v \f \r.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words are runs of 0-9, A-Z, a-z and all bytes beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def bounded(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (it should be written); otherwise df as it is, to be shuffled."""
    return F.broadcast(df) if df.count() <= most_rows else df


#: Bytes of files up to which a table is broadcast.  The driver builds its hash table, which takes ten times as much and
#: more (hashes don't compress), and several at a time.
LIGHT = 2 << 20


def modest_broadcasts(spark: SparkSession, most_bytes: int = LIGHT) -> None:
    """Spark's own choice of broadcasts reads the sizes of files too: bound it like ours, for the session."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now > most_bytes:
        spark.conf.set(name, str(most_bytes))


def light(df: DataFrame, most_bytes: int = LIGHT) -> DataFrame:
    """A written df with a broadcast hint if its files are small; otherwise df as it is, to be shuffled."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most_bytes else df


def looked_up(rows: DataFrame, known: DataFrame, key: str | list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with a written table of unique keys, whose column ``weight`` counts the rows of each (it is dropped).

    A key with more than a thousandth of ``total`` rows is hot: there can be fewer than a thousand of them, so these are
    broadcast; all others are shuffled.
    """
    most = max(1, total // 1000)
    hot = F.broadcast(known.where(F.col(weight) > most).drop(weight))
    rest = rows.join(hot.select(key), key, "left_anti").join(known.where(F.col(weight) <= most).drop(weight), key, how)
    return rows.join(hot, key).unionByName(rest)


def joined(rows: DataFrame, known: DataFrame, key: str | list[str], weight: str, how: str = "inner") -> DataFrame:
    """looked_up, with the sum of the weights as the total; by one broadcast where the written table is small."""
    if light(known) is not known:
        return rows.join(light(known.drop(weight)), key, how)
    return looked_up(rows, known, key, weight, known.agg(F.sum(weight)).first()[0] or 0, how)


#: Bits of a sieve, at most (16 MB), and for each key.
SIEVE, SIEVE_EACH = 1 << 27, 32


def sifted(rows: DataFrame, known: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is among those of a written table, with few others (some 3 %; more where ``known`` has millions of
    keys), and the rest: to be used before a join by shuffle, so that rows without a partner aren't moved.

    One bit of a hash of each key is set in lists of 64 words, which are broadcast; their size is bounded however many keys
    there are.
    """
    most = min(SIEVE, 1 << max(12, (SIEVE_EACH * known.count() - 1).bit_length()))
    slot, row, word = F.xxhash64(*key).bitwiseAND(F.lit(most - 1).cast("long")), "sieve_row", "sieve_word"

    def low(c):
        return F.col(c).bitwiseAND(F.lit(63).cast("long")).cast("int")

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), low("slot"))
    words = known.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias(word)).agg(F.bit_or(bit).alias("bits"))
    lists = words.groupBy(F.shiftright(word, 6).alias(row)).agg(F.map_from_entries(F.collect_list(F.struct(low(word), "bits"))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(63))
    lists = written(lists.select(row, F.transform(places, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias(word)), "sieve")
    at = F.shiftright(slot, 6).bitwiseAND(F.lit(63).cast("long")).cast("int")
    is_set = F.getbit(F.get(word, at), slot.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
    found = (F.shiftright(slot, 12) == F.col(row)) & is_set
    return rows.join(F.broadcast(lists), found, "left_semi"), rows.join(F.broadcast(lists), found, "left_anti")


def sieved(rows: DataFrame, known: DataFrame, *key: str) -> DataFrame:
    """The first part of sifted."""
    return sifted(rows, known, *key)[0]
