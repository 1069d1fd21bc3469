"""WARC archives with a two-level capture index.

``write_archives`` writes one record per page, each a gzip member of its own, into one archive per task.
``build_index`` sorts the captures by reversed-host URL key and record id into range shards; a shard is a file of
compressed blocks of lines that ends with its sparse directory (first key, offset and length of each block).
``lookup`` finds captures: the shard by its first key, the block by binary search in the shard's directory, one range
read, then binary search in the block.  ``read_records`` range-reads the records themselves, in archive order.

Of pages with equal payloads of at least ``revisit_bytes`` bytes, that with the largest page_id is the response and the
others revisit it; smaller payloads are all responses.  Null html is an empty payload.  A null page_id counts as the
smallest; rows that tie for the largest page_id are all responses; repeated rows are captures of their own.  Null and
unparsable URLs are keys as they stand (null: empty).  An empty table gives empty archives and indexes.

Files are written under names of their own for each task attempt, and the index holds the names that the successful
attempts reported, so lost executors and repeated tasks leave at worst files that nothing refers to.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, modest_batches, store, written

BLOCK_LINES = 1000
MAGIC = b"2LCI"
_SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*://"


def url_key(url: Column) -> Column:
    """``http://blog.a.com:80/x?q#f`` becomes ``com,a,blog:80)/x?q``."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, rf"^{_SCHEME}(?:[^/?#@]*@)?([^/?#:]*)", 1))
    port = F.regexp_extract(url, rf"^{_SCHEME}[^/?#]*?(:[0-9]+)?(?:[/?#]|$)", 1)
    rest = F.regexp_extract(url, rf"^{_SCHEME}[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), port, F.lit(")"), rest)
    return F.translate(F.when(F.length(host) > 0, key).otherwise(url), "\t\n\r", "   ")


def digest_text(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(page_id: str, url: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response or revisit record as one gzip member."""
    clean = " ".join(url.split())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = http if refers_to else http + payload
    head += [f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + squeeze.flush()


def parse_record(raw: bytes) -> dict:
    """Header fields (lower case), and payload (None in a revisit), of a gzip member; checks the lengths."""
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    out: dict = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(out["content-length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length")
    http, _, payload = body.partition(b"\r\n\r\n")
    out["http_length"] = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    out["payload"] = payload if out["warc-type"] == "response" else None
    return out


def _attempt_name(prefix: str, suffix: str) -> str:
    at = TaskContext.get()
    return f"{prefix}-{at.partitionId():06d}-{at.taskAttemptId()}{suffix}"


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 0, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Write the archives of pages (page_id, url, html); the captures (url_key, record_id, file, offset, length)."""
    modest_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select("page_id", F.col("url"), payload.alias("html"), url_key(F.col("url")).alias("url_key"), F.unhex(F.sha1(payload)).alias("sha"))
    groups = known.where(F.octet_length("html") >= revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").drop("n")
    copied = written(groups, "copies")
    marked = known.join(copied, "sha", "left").where("true").select("page_id", "url", "url_key", "html", F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")).alias("refers_to"))

    def write(batches):
        fs, base = store(folder)
        fs.create_dir(base)
        name = _attempt_name("pages", ".warc.gz")
        at = 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in batches:
                rows = []
                for page_id, url, key, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    raw = html.encode()
                    one = record("null" if page_id is None else str(page_id), url or "", raw, digest_text(raw), None if refers is None else str(refers), date)
                    out.write(one)
                    rows.append((key, "null" if page_id is None else str(page_id), name, at, len(one)))
                    at += len(one)
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["url_key", "record_id", "file", "offset", "length"])

    return marked.mapInArrow(write, "url_key string, record_id string, file string, offset long, length long")


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, str, str]]:
    """Write the index shards; (first key, first record id, file) of each, in order: one entry per range partition."""

    def write(batches):
        fs, base = store(folder)
        fs.create_dir(base)
        name, out, directory, at, block, first = _attempt_name("index", ".cdx"), None, [], 0, [], None

        def flush():
            nonlocal at, block
            if block:
                packed = zlib.compress("".join(block).encode(), 6)
                out.write(packed)
                directory[-1] += [at, len(packed)]
                at, block = at + len(packed), []

        for batch in batches:
            for key, ident, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, first = fs.open_output_stream(f"{base}/{name}", compression=None), (key, ident)
                if not block:
                    directory.append([key, ident])
                block.append(f"{key}\t{ident}\t{file}\t{offset}\t{length}\n")
                if len(block) >= block_lines:
                    flush()
        if out is not None:
            flush()
            tail = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(tail + len(tail).to_bytes(8, "big") + MAGIC)
            out.close()
            yield pa.RecordBatch.from_pydict({"key": [first[0]], "ident": [first[1]], "file": [name]}, schema=pa.schema([("key", pa.string()), ("ident", pa.string()), ("file", pa.string())]))

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.select("url_key", "record_id", "file", "offset", "length").repartitionByRange(n, "url_key", "record_id").sortWithinPartitions("url_key", "record_id", "file", "offset")
    return sorted(tuple(r) for r in ranged.mapInArrow(write, "key string, ident string, file string").collect())


class Index:
    """Searches index shards; keeps the directory and block that it read last."""

    def __init__(self, folder: str, shards: list[tuple[str, str, str]]) -> None:
        self.fs, self.base = store(folder)
        self.starts, self.files = [s[:2] for s in shards], [s[2] for s in shards]
        self.shard, self.directory, self.block, self.lines = -1, [], (-1, -1), []
        self.range_reads = 0

    def _open(self, shard: int) -> None:
        if self.shard != shard:
            path = f"{self.base}/{self.files[shard]}"
            size = self.fs.get_file_info(path).size
            with self.fs.open_input_file(path) as f:
                end = f.read_at(12, size - 12)
                if end[8:] != MAGIC:
                    raise ValueError(f"{path} is no index shard")
                n = int.from_bytes(end[:8], "big")
                self.directory = json.loads(zlib.decompress(f.read_at(n, size - 12 - n)))
            self.shard, self.keys = shard, [(d[0], d[1]) for d in self.directory]

    def _lines(self, shard: int, block: int) -> list[list[str]]:
        if self.block != (shard, block):
            offset, length = self.directory[block][2:]
            with self.fs.open_input_file(f"{self.base}/{self.files[shard]}") as f:
                text = zlib.decompress(f.read_at(length, offset)).decode()
            self.range_reads += 1
            self.block, self.lines = (shard, block), [x.split("\t") for x in text.split("\n")[:-1]]
        return self.lines

    def find(self, key: str, ident: str | None = None) -> list[tuple[str, str, str, int, int]]:
        """All captures of a URL key, or of that key and record id."""
        want = (key, ident or "")
        out = []
        shard = max(0, bisect.bisect_left(self.starts, want) - 1)
        while shard < len(self.files) and self.starts[shard] <= (key, ident or "\U0010ffff"):
            self._open(shard)
            block = max(0, bisect.bisect_left(self.keys, want) - 1)
            while block < len(self.keys) and self.keys[block] <= (key, ident or "\U0010ffff"):
                lines = self._lines(shard, block)
                at = bisect.bisect_left(lines, want, key=lambda x: (x[0], x[1]))
                while at < len(lines) and lines[at][0] == key and ident in (None, lines[at][1]):
                    out.append((key, lines[at][1], lines[at][2], int(lines[at][3]), int(lines[at][4])))
                    at += 1
                block += 1
            shard += 1
        return out


def lookup(wanted: DataFrame, folder: str, shards: list[tuple[str, str, str]]) -> DataFrame:
    """Captures of distinct (url_key, record_id) rows; each task searches the few shards that its key range meets."""
    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def find(batches):
        index = Index(folder, shards)
        for batch in batches:
            rows = [x for key, ident in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in index.find(key, ident)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["url_key", "record_id", "file", "offset", "length"])

    asked = wanted.select("url_key", "record_id").distinct().repartitionByRange(n, "url_key", "record_id").sortWithinPartitions("url_key", "record_id")
    return asked.mapInArrow(find, "url_key string, record_id string, file string, offset long, length long")


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """Range-read each capture: record_id, url, payload_bytes, payload_digest, record_type, refers_to, html (null in a revisit)."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, html string"
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches):
        fs, base = store(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for ident, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{base}/{file}")
                found = parse_record(source.read_at(length, offset))
                said, payload = found["warc-payload-digest"].removeprefix("sha1:"), found["payload"]
                if payload is not None and (digest_text(payload) != said or len(payload) != found["http_length"]):
                    raise ValueError(f"record {ident} of {file} is damaged")
                refers = found.get("warc-refers-to")
                rows.append((ident, found["warc-target-uri"], found["http_length"], said, found["warc-type"], refers and refers[len("<urn:page:") : -1], None if payload is None else payload.decode()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 2 else pa.string()) for k, c in enumerate(columns)], names)

    ordered = captures.select("record_id", "file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """Write all pages, index them, look every page up and read its record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    captures = written(write_archives(pages, f"{folder}/archives", revisit_bytes), "captures")
    shards = build_index(captures, f"{folder}/index")
    wanted = pages.select(url_key(F.col("url")).alias("url_key"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("record_id"))
    read = read_records(lookup(wanted, f"{folder}/index", shards), f"{folder}/archives")
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast("long").alias(c)
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))
