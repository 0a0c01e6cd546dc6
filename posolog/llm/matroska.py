"""Matroska media columns: a writer for 8-bit PCM and a reader that turns any file into a packet table."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from posolog.llm.common import mapped, pieces, quoted, raw_texts, released, shape

FRAME = 576
RATE = 8000
FRAME_MS = 1000 * FRAME // RATE
FRAMES_IN_BLOCK = 16
BLOCKS_IN_CLUSTER = 24
PAD = b"\xff"

# Element ids of the format.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that end a cluster or a segment of unknown size.
TOP_LEVEL = frozenset((INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367))
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 2, 4, 6


def vint(n: int, width: int = 0) -> bytes:
    """n as a variable-length integer, in `width` bytes or as few as hold it."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], lacing: int) -> bytes:
    """A block's frames behind the lacing's table of sizes."""
    if lacing == NO_LACING:
        return frames[0]
    count, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if lacing == FIXED_LACING:
        return count + b"".join(frames)
    if lacing == XIPH_LACING:
        return count + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1]) + b"".join(frames)
    table = vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):  # noqa: B905
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        table += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return count + table + b"".join(frames)


def pack(payload: bytes) -> bytes:
    """A file with one track of unsigned 8-bit samples: FRAME samples a frame, laced blocks, clusters and cues."""
    frames = [payload[k : k + FRAME] for k in range(0, len(payload), FRAME)]
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOCTYPE, b"matroska") + number(DOCTYPE_VERSION, 4) + number(DOCTYPE_READ_VERSION, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(frames) * FRAME_MS)) + element(MUXING_APP, b"posolog") + element(WRITING_APP, b"posolog"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    per_cluster = FRAMES_IN_BLOCK * BLOCKS_IN_CLUSTER
    for c in range(0, len(frames), per_cluster):
        blocks = [number(TIMESTAMP, c * FRAME_MS)]
        for k, b in enumerate(range(c, min(c + per_cluster, len(frames)), FRAMES_IN_BLOCK)):
            some = frames[b : min(b + FRAMES_IN_BLOCK, c + per_cluster)]
            lacing = (EBML_LACING, FIXED_LACING, XIPH_LACING)[k % 3] if len(some) > 1 else NO_LACING
            blocks.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", (b - c) * FRAME_MS, 0x80 | lacing) + _laced(some, lacing)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, c * FRAME_MS) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


class Packet(NamedTuple):
    """A frame: its track, time in ms, byte range in the file, whether it is a key frame."""

    track: int
    ms: float
    offset: int
    size: int
    key: bool


class Parsed(NamedTuple):
    packets: list[Packet]
    #: (time in ms, track, place of the cluster in the file)
    cues: list[tuple[float, int, int]]
    #: {track: (type, codec, ms of a frame or None)}
    tracks: dict[int, tuple[int, str, float | None]]


def _vint_at(data: bytes, at: int, marked: bool = False) -> tuple[int | None, int]:
    """The integer at `at` and the place behind it; marked keeps the length bit; all ones is None."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError("the file ends within an integer")
    n = int.from_bytes(data[at : at + width], "big")
    if marked:
        return n, at + width
    n -= 1 << 7 * width
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def _children(data: bytes, at: int, end: int, within: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, begin, end) of the elements from at to end. An unknown size runs to the parent's next sibling."""
    while at < end:
        ident, at = _vint_at(data, at, True)
        size, at = _vint_at(data, at)
        stop = end if size is None else at + size
        if stop > end:
            raise ValueError("an element is longer than its parent")
        if size is None and ident == CLUSTER:
            stop = at
            while stop < end:
                inner, k = _vint_at(data, stop, True)
                if inner in TOP_LEVEL:
                    break
                n, k = _vint_at(data, k)
                stop = end if n is None else k + n
        yield ident, at, stop
        at = stop


def _frame_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and the place of the first."""
    if lacing == NO_LACING:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    if lacing == FIXED_LACING:
        if (end - at) % count:
            raise ValueError("fixed lacing with unequal frames")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for k in range(count - 1):
        if lacing == XIPH_LACING:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        elif k == 0:
            n, at = _vint_at(data, at)
        else:
            width = 9 - data[at].bit_length()
            step, at = _vint_at(data, at)
            n = sizes[-1] + (step if step is not None else (1 << 7 * width) - 1) - ((1 << 7 * width - 1) - 1)
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are longer than their block")
    return sizes, at


def _whole(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _real(data: bytes, at: int, end: int) -> float:
    return struct.unpack(">f" if end - at == 4 else ">d", data[at:end])[0] if end - at in (4, 8) else 0.0


def parse(data: bytes) -> Parsed:
    """Packets, cues and tracks of a file; ValueError where it is broken."""
    packets: list[Packet] = []
    cues: list[tuple[float, int, int]] = []
    tracks: dict[int, tuple[int, str, float | None]] = {}
    scale = 1.0

    def block(at: int, end: int, base: int, key: bool | None) -> None:
        track, at = _vint_at(data, at)
        shift, flags = struct.unpack_from(">hB", data, at)
        sizes, at = _frame_sizes(data, at + 3, end, flags & 6)
        step = tracks.get(track, (0, "", None))[2] or (FRAME_MS if tracks.get(track, (0, "", None))[1].startswith("A_PCM") else 0)
        for k, n in enumerate(sizes):
            packets.append(Packet(track, (base + shift) * scale + k * step, at, n, bool(flags & 0x80) if key is None else key))
            at += n

    for top, a, b in _children(data, 0, len(data)):
        if top != SEGMENT:
            continue
        segment = a
        for ident, at, end in _children(data, a, b):
            if ident == INFO:
                scale = next((_whole(data, x, y) for i, x, y in _children(data, at, end) if i == TIMESTAMP_SCALE), 1_000_000) / 1e6
            elif ident == TRACKS:
                for i, x, y in _children(data, at, end):
                    if i == TRACK_ENTRY:
                        got = {j: (p, q) for j, p, q in _children(data, x, y)}
                        span = got.get(0x23E383)
                        tracks[_whole(data, *got[TRACK_NUMBER])] = (_whole(data, *got[TRACK_TYPE]), data[slice(*got[CODEC_ID])].decode("ascii", "replace"), _whole(data, *span) / 1e6 if span else None)
            elif ident == CLUSTER:
                base = 0
                for i, x, y in _children(data, at, end):
                    if i == TIMESTAMP:
                        base = _whole(data, x, y)
                    elif i == SIMPLE_BLOCK:
                        block(x, y, base, None)
                    elif i == BLOCK_GROUP:
                        inside = list(_children(data, x, y))
                        for j, p, q in inside:
                            if j == BLOCK:
                                block(p, q, base, all(m != REFERENCE_BLOCK for m, _, _ in inside))
            elif ident == CUES:
                for i, x, y in _children(data, at, end):
                    if i != CUE_POINT:
                        continue
                    when = 0.0
                    for j, p, q in _children(data, x, y):
                        if j == CUE_TIME:
                            when = _whole(data, p, q) * scale
                        elif j == CUE_TRACK_POSITIONS:
                            got = {m: _whole(data, r, s) for m, r, s in _children(data, p, q)}
                            cues.append((when, got.get(CUE_TRACK, 0), segment + got.get(CUE_CLUSTER_POSITION, 0)))
    return Parsed(packets, cues, tracks)


def features(parsed: Parsed, payload: bytes) -> str:
    """Frames, clusters, end in ms, mean, deviation and zero crossings of the samples as one line."""
    samples = np.frombuffer(payload, np.uint8)
    n = max(1, len(samples))
    total, squares = int(samples.sum(dtype=np.int64)), int(np.square(samples, dtype=np.uint16).sum(dtype=np.int64))
    above = samples >= 128
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    end = max((p.ms for p in parsed.packets), default=-FRAME_MS) + FRAME_MS
    return f"frames={len(parsed.packets)};clusters={len(parsed.cues)};ms={end:.0f};mean={total / n:.4f};deviation={max(0.0, squares / n - (total / n) ** 2) ** 0.5:.4f};crossings={crossings}"


def padded(raw: bytes | None) -> bytes:
    """A text's bytes with 255 appended up to a positive multiple of FRAME; null counts as empty."""
    raw = raw or b""
    return raw + PAD * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))


def payload_of(data: bytes, packets: list[Packet]) -> bytes:
    return b"".join([data[p.offset : p.offset + p.size] for p in packets])


def _parsed(data: bytes | None) -> Parsed | None:
    """parse(), None for no file and for a broken one."""
    try:
        return None if data is None else parse(data)
    except (ValueError, IndexError, KeyError, struct.error):
        return None


def to_media(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Adds media_col: the text's UTF-8 bytes, padded with 255 to a positive multiple of FRAME, as a file.

    A null text is an empty one; an empty one is a frame of padding. A text of any length is one file, held in memory by
    itself. Equal texts, repeated rows among them, give equal files whatever else is in the row; an empty table gives an
    empty one. Other columns stay, whatever their names; one named media_col is replaced.
    """
    return mapped(df, text_col, [(media_col, "binary")], lambda texts: [pa.array([pack(padded(raw)) for raw in raw_texts(texts)], pa.binary())])


def read_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds payload (all frames in order) and feature, both null where the file is null or broken.

    Other columns stay, whatever their names; columns named payload and feature are replaced.
    """

    def work(media: pa.Array) -> list[pa.Array]:
        payloads, lines = [], []
        for data in media.to_pylist():
            parsed = _parsed(data)
            payloads.append(None if parsed is None else payload_of(data, parsed.packets))
            lines.append(None if parsed is None else features(parsed, payloads[-1]))
        return [pa.array(payloads, pa.binary()), pa.array(lines, pa.string())]

    return mapped(df, media_col, [("payload", "binary"), ("feature", "string")], work)


#: What round_trip() adds.
TRIP = [("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")]


def round_trip(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds TRIP: each text is written as to_media() does, the stored bytes are read back as read_media() does, and sizes
    and digests of both are kept, so that no file leaves the worker. Rows and columns are treated as there."""

    def work(texts: pa.Array) -> list[pa.Array]:
        rows = []
        for raw in raw_texts(texts):
            media = pack(padded(raw))
            parsed = parse(media)
            payload = payload_of(media, parsed.packets)
            rows.append((len(raw or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(parsed, payload)))
        columns = list(zip(*rows, strict=True)) or [[]] * len(TRIP)
        return [pa.array(c, pa.int64() if kind == "bigint" else pa.string()) for c, (_, kind) in zip(columns, TRIP, strict=True)]

    return mapped(df, text_col, TRIP, work)


def packet_table(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Rows (id, packet, track, ms, offset, size, key) for every frame of every file; null or broken files have none."""
    kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.bool_())

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            for k, data in enumerate(batch.column(1).to_pylist()):
                parsed = _parsed(data)
                if parsed is not None and parsed.packets:
                    columns = list(zip(*parsed.packets, strict=True))
                    ids = pa.array([batch.column(0)[k].as_py()] * len(parsed.packets), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(range(len(parsed.packets)), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [id_col, "packet", "track", "ms", "offset", "size", "key"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(quoted(id_col), quoted(media_col)).mapInArrow(run, f"{shape([(id_col, kind)])}, packet int, track int, ms double, offset bigint, size int, key boolean")
