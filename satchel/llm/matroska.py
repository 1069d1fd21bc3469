"""Media columns: Matroska.

``mux`` stores a payload losslessly as 8-bit PCM packets in a Matroska file (EBML header, Segment, Info, Tracks,
Clusters of laced SimpleBlocks, Cues); ``parse`` reads any such bytes back into packet and cue tables: variable-length
EBML ids and sizes, known and unknown sizes, SimpleBlocks and BlockGroups, no, Xiph, fixed-size and EBML lacing.  Laced
frames follow each other by the track's default duration, or else share the block's duration (its time, if it has none).
``packet_table`` is the DataFrame operator: a binary media column in, one row per packet with track, timestamp,
keyframe flag and byte range out.

Null media counts as empty; bytes that aren't Matroska, or are cut off, give the packets before the damage and
``damaged`` true.  Equal bytes give equal rows; an empty table gives an empty table.  A long text takes about four times
its bytes.  Further columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import modest_batches, with_fields

# Element ids of the public Matroska specification.
EBML, VOID, CRC32 = 0x1A45DFA3, 0xEC, 0xBF
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION = 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
BLOCK_DURATION, REFERENCE_BLOCK = 0x9B, 0xFB
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PARENTS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
#: What ends a cluster (or segment) of unknown size.
TOP = {CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS, SEGMENT, EBML}

FRAME, RATE, LACED, BLOCKS = 576, 8000, 8, 16
#: A tick is one frame: 576 samples at 8000 a second, in nanoseconds.
TICK_NS = FRAME * 1_000_000_000 // RATE


def _size(n: int, width: int = 0) -> bytes:
    """An EBML size; the shortest form unless a width is given.  All ones is kept for "unknown"."""
    if not width:
        width = 1
        while n >= (1 << (7 * width)) - 1:
            width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEADER = _element(EBML, b"".join([_uint(EBML_VERSION, 1), _uint(EBML_READ_VERSION, 1), _uint(EBML_MAX_ID, 4), _uint(EBML_MAX_SIZE, 8), _element(DOCTYPE, b"matroska"), _uint(DOCTYPE_VERSION, 4), _uint(DOCTYPE_READ_VERSION, 2)]))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, b"".join([_uint(TRACK_NUMBER, 1), _uint(TRACK_UID, 1), _uint(TRACK_TYPE, 2), _uint(FLAG_LACING, 1), _uint(DEFAULT_DURATION, TICK_NS), _element(CODEC_ID, b"A_PCM/INT/LIT"), _element(AUDIO, _element(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))])))


def _lace(kind: int, frames: list[bytes]) -> bytes:
    """The head of a laced block after its flags: count and sizes of all frames but the last."""
    out = bytearray([len(frames) - 1])
    if kind == 1:
        for f in frames[:-1]:
            out += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif kind == 3:
        out += _size(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            d, width = len(b) - len(a), 1
            while not -(1 << (7 * width - 1)) < d < 1 << (7 * width - 1):
                width += 1
            out += _size(d + (1 << (7 * width - 1)) - 1, width)
    return bytes(out)


def mux(payload: bytes) -> bytes:
    """A Matroska file of the payload in frames of 576 bytes, eight to a block (lacing kinds take turns), 16 blocks to a cluster."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = _element(INFO, _uint(TIMESTAMP_SCALE, TICK_NS) + _element(DURATION, struct.pack(">d", len(frames))) + _element(MUXING_APP, b"satchel") + _element(WRITING_APP, b"satchel"))
    body, cues = bytearray(info + _TRACKS), bytearray()
    for first in range(0, len(frames), LACED * BLOCKS):
        here = len(body)
        cluster = [_uint(TIMESTAMP, first)]
        for b, at in enumerate(range(first, min(first + LACED * BLOCKS, len(frames)), LACED)):
            group = frames[at : at + LACED]
            kind = (1, 2, 3)[b % 3] if len(group) > 1 else 0
            if kind == 2 and len({len(f) for f in group}) > 1:
                kind = 3
            head = b"\x81" + struct.pack(">hB", at - first, 0x80 | kind << 1)
            cluster.append(_element(SIMPLE_BLOCK, head + (_lace(kind, group) if kind else b"") + b"".join(group)))
        body += _element(CLUSTER, b"".join(cluster))
        cues += _element(CUE_POINT, _uint(CUE_TIME, first) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, here)))
    body += _element(CUES, bytes(cues))
    return _HEADER + _element(SEGMENT, bytes(body))


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    cluster: int
    block: int
    lacing: int
    keyframe: bool
    start: int
    end: int


class Media(NamedTuple):
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time in ns, track, byte position of the cluster
    tracks: dict[int, str]  # codec by track number
    damaged: bool


def _number(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """An EBML id (with its marker) or size at a position, and the position behind it; size -1 is unknown."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("no EBML number")
    n = int.from_bytes(data[at : at + width], "big")
    if not keep_marker:
        n -= 1 << (7 * width)
        if n == (1 << (7 * width)) - 1:
            n = -1
    return n, at + width


def _frames(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    if kind == 0:
        return [(at, end)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif kind == 3 and count > 1:
        n, at = _number(data, at, False)
        sizes.append(n)
        for _ in range(count - 2):
            before = at
            d, at = _number(data, at, False)
            width = at - before
            if d == -1:  # all ones is a difference here
                d = (1 << (7 * width)) - 1
            sizes.append(sizes[-1] + d - ((1 << (7 * width - 1)) - 1))
    else:
        sizes = [(end - at) // count] * (count - 1)
    out = []
    for n in sizes:
        if n < 0 or at + n > end:
            raise ValueError("lacing beyond the block")
        out.append((at, at + n))
        at += n
    return [*out, (at, end)]


def parse(data: bytes) -> Media:
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    tracks: dict[int, str] = {}
    scale, base, number, cue, segment, clusters, blocks = 1_000_000, 0, 0, [0, 0], 0, -1, 0
    durations: dict[int, int] = {}  # nanoseconds of a frame by track, where the track says so
    group = 0  # the first packet of the open block group
    stack: list[int] = [len(data)]  # ends of open parents
    kinds: list[int] = [0]
    at, damaged = 0, not data
    try:
        while at < len(data):
            while len(stack) > 1 and at >= stack[-1]:
                stack.pop()
                kinds.pop()
            ident, body = _number(data, at, True)
            size, body = _number(data, body, False)
            if at == 0 and ident != EBML:
                raise ValueError("no EBML header")
            while kinds[-1] == CLUSTER and ident in TOP:  # ends a cluster of unknown size
                stack.pop()
                kinds.pop()
            end = stack[-1] if size == -1 else body + size
            if end > len(data):
                raise ValueError("element beyond the data")
            if ident in PARENTS:
                stack.append(end)
                kinds.append(ident)
                if ident == SEGMENT:
                    segment = body
                elif ident == CLUSTER:
                    clusters, blocks = clusters + 1, 0
                elif ident == BLOCK_GROUP:
                    group = len(packets)
                at = body
                continue
            value = data[body:end] if size <= 64 else b""
            if ident == TIMESTAMP_SCALE:
                scale = int.from_bytes(value, "big")
            elif ident == TIMESTAMP:
                base = int.from_bytes(value, "big")
            elif ident == TRACK_NUMBER:
                number = int.from_bytes(value, "big")
                tracks.setdefault(number, "")
            elif ident == CODEC_ID:
                tracks[number] = value.decode("ascii", "replace")
            elif ident == DEFAULT_DURATION:
                durations[number] = int.from_bytes(value, "big")
            elif ident == REFERENCE_BLOCK:  # a block that refers to another is no keyframe
                packets[group:] = [p._replace(keyframe=False) for p in packets[group:]]
            elif ident == BLOCK_DURATION:  # of all frames of the block
                n = int.from_bytes(value, "big") * scale
                packets[group:] = [p if p.track in durations else p._replace(timestamp_ns=p.timestamp_ns + i * n // (len(packets) - group)) for i, p in enumerate(packets[group:])]
            elif ident == CUE_TIME:
                cue = [int.from_bytes(value, "big") * scale, 0]
            elif ident == CUE_TRACK:
                cue[1] = int.from_bytes(value, "big")
            elif ident == CUE_CLUSTER:
                cues.append((cue[0], cue[1], segment + int.from_bytes(value, "big")))
            elif ident in (SIMPLE_BLOCK, BLOCK):
                track, p = _number(data, body, False)
                relative, flags = struct.unpack(">hB", data[p : p + 3])
                kind = flags >> 1 & 3
                spans = _frames(data, p + 3, end, kind)
                for i, (a, b) in enumerate(spans):
                    packets.append(Packet(track, (base + relative) * scale + i * durations.get(track, 0), clusters, blocks, kind, ident == BLOCK or bool(flags & 128), a, b))
                blocks += 1
            at = end
    except (ValueError, IndexError, struct.error):
        damaged = True
    return Media(packets, cues, tracks, damaged)


def packet_table(df: DataFrame, media: str = "media", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per packet of the binary column ``media``, with the key columns of its row."""
    kinds = ("int", "long", "int", "int", "int", "boolean", "long", "long", "boolean")
    schema = with_fields(df.select(*keys).schema, ", ".join(f"packet_{n} {k}" for n, k in zip((*Packet._fields, "damaged"), kinds, strict=True)))

    def rows(batches):
        for batch in batches:
            at, packets = [], []
            for i, raw in enumerate(batch.column(len(keys)).to_pylist()):
                found = parse(raw or b"")
                at += [i] * len(found.packets)
                packets += [(*p, found.damaged) for p in found.packets]
            columns = list(zip(*packets, strict=True)) if packets else [[]] * (len(schema) - len(keys))
            kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], schema.fieldNames())

    return df.select(*keys, media).mapInArrow(rows, schema)


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 bytes, and those bytes with 255 appended up to a positive multiple of 576."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (FRAME - len(raw) if len(raw) < FRAME else -len(raw) % FRAME)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column of every text."""
    modest_batches(docs.sparkSession)

    def rows(batches):
        for batch in batches:
            pairs = [padded(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in pairs], pa.int64()), pa.array([mux(p) for _, p in pairs], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(rows, with_fields(docs.select("doc_id").schema, "n_bytes long, media binary"))


def level(payload: bytes) -> int:
    """The mean of all bytes, rounded down."""
    return int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64)) // max(1, len(payload))


def media_features(docs: DataFrame) -> DataFrame:
    """Per document: the payload read back from its Matroska bytes, digests, and features of the packet table."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = with_fields(docs.select("doc_id").schema, ", ".join(f"{n} {'string' if 'sha' in n or n == 'feature' else 'long'}" for n in names[1:]))

    def rows(batches):
        for batch in batches:
            out = []
            for raw in batch.column(2).to_pylist():
                found = parse(raw)
                view = memoryview(raw)
                payload = b"".join(view[p.start : p.end] for p in found.packets)
                feature = f"{found.tracks.get(1, '')};packets={len(found.packets)};blocks={len({(p.cluster, p.block) for p in found.packets})};clusters={len({p.cluster for p in found.packets})};cues={len(found.cues)};ms={len(found.packets) * TICK_NS // 1_000_000};level={level(payload)}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return stored(docs).mapInArrow(rows, schema)
