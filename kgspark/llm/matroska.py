"""Media columns in Matroska: a muxer, a demuxer to packet tables, and text stored as 8-bit sound.

The demuxer reads EBML's variable-length ids and sizes, walks segments,
clusters and blocks (simple blocks and block groups), undoes all three kinds of
lacing, and gives each packet's track, timestamp and byte range; cues are read
as well. Each file is handled within its row, so there is no shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kgspark.session import exact_ids, workers_import_this

#: Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: Of the sound that holds a text: bytes a unit, sampling rate, bytes a packet, packets a block, blocks a cluster.
UNIT, RATE, PACKET, LACED, BLOCKS = 192, 8000, 960, 8, 32


# --- reading ---


def vint(data: bytes, at: int, marker: bool = False) -> tuple[int, int, bool]:
    """Value, width, and whether all value bits are ones (an unknown size). marker keeps the length marker, as ids do."""
    if at >= len(data) or not data[at]:
        raise ValueError("no variable-length integer here")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError("the data ends within an integer")
    raw = int.from_bytes(data[at : at + width], "big")
    ones = (1 << (7 * width)) - 1
    return (raw if marker else raw & ones), width, raw & ones == ones


def elements(data: bytes, at: int, end: int, stop: frozenset[int] = frozenset(), m: Media | None = None) -> Iterator[tuple[int, int, int]]:
    """(id, first byte of content, end of content) of each element in data[at:end]; a truncated one ends with the data, and m is told so.

    An element of unknown size reaches to the next one in `stop`, or to the end.
    """
    while at < end:
        try:
            ident, a, _ = vint(data, at, True)
            size, b, unknown = vint(data, at + a)
        except ValueError:
            if m:
                m.complete = False
            return
        body = at + a + b
        if m and not unknown and body + size > end:
            m.complete = False
        if unknown:
            at = next((p for p, i in _starts(data, body, end) if i in stop), end) if stop else end
        else:
            at = min(body + size, end)
        yield ident, body, at


def _starts(data: bytes, at: int, end: int) -> Iterator[tuple[int, int]]:
    while at < end:
        try:
            ident, a, _ = vint(data, at, True)
            size, b, unknown = vint(data, at + a)
        except ValueError:
            return
        yield at, ident
        at += a + b + (0 if unknown else size)


def uint(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def number(data: bytes, at: int, end: int) -> float:
    return struct.unpack({4: ">f", 8: ">d"}[end - at], data[at:end])[0] if end - at in (4, 8) else 0.0


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp in ns, first byte, length, keyframe, cluster, place in its lacing)."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: int = 0
    complete: bool = True


def laced(data: bytes, at: int, end: int, kind: int) -> tuple[int, list[int]]:
    """First byte and sizes of the frames in a block's content."""
    if kind == NO_LACING:
        return at, [end - at]
    n = data[at] + 1
    at += 1
    if kind == FIXED:
        return at, [(end - at) // n] * n
    sizes: list[int] = []
    for k in range(n - 1):
        if kind == XIPH:
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            size += data[at]
            at += 1
        else:
            value, width, _ = vint(data, at)
            at += width
            size = value if k == 0 else sizes[-1] + value - ((1 << (7 * width - 1)) - 1)
        sizes.append(size)
    return at, [*sizes, end - at - sum(sizes)]


def _block(m: Media, data: bytes, at: int, end: int, time: int, simple: bool, key: bool) -> None:
    track, width, _ = vint(data, at)
    rel, flags = struct.unpack(">hB", data[at + width : at + width + 3])
    body, sizes = laced(data, at + width + 3, end, flags >> 1 & 3)
    step = m.tracks.get(track, {}).get("default_duration", 0)
    start, t = body, (time + rel) * m.scale
    for k, size in enumerate(sizes):
        if size < 0 or start + size > end:
            raise ValueError("a laced frame reaches beyond its block")
        m.packets.append((track, t + k * step, start, size, bool(flags & 0x80) if simple else key, m.clusters - 1, k))
        start += size


def demux(data: bytes) -> Media:
    """Everything a file holds; a truncated or broken file gives the packets before the fault and complete = False."""
    m = Media()
    try:
        seen = False
        for ident, at, end in elements(data, 0, len(data), m=m):
            if ident == EBML:
                seen = True
            elif ident == SEGMENT and seen:
                _segment(m, data, at, end)
        m.complete = m.complete and seen
    except (ValueError, IndexError, struct.error):
        m.complete = False
    return m


def _segment(m: Media, data: bytes, at: int, end: int) -> None:
    last = at
    for ident, a, e in elements(data, at, end, frozenset(TOP_LEVEL), m):
        last = e
        if ident == INFO:
            for i, x, y in elements(data, a, e):
                if i == TIMESTAMP_SCALE:
                    m.scale = uint(data, x, y)
                elif i == DURATION:
                    m.duration = number(data, x, y)
        elif ident == TRACKS:
            for i, x, y in elements(data, a, e):
                if i == TRACK_ENTRY:
                    t = {}
                    for j, p, q in elements(data, x, y):
                        if j in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
                            t[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration"}[j]] = uint(data, p, q)
                        elif j == CODEC_ID:
                            t["codec"] = data[p:q].decode("ascii", "replace")
                        elif j == AUDIO:
                            for k, f, g in elements(data, p, q):
                                if k in (CHANNELS, BIT_DEPTH):
                                    t["channels" if k == CHANNELS else "bits"] = uint(data, f, g)
                                elif k == SAMPLING_FREQUENCY:
                                    t["rate"] = number(data, f, g)
                    m.tracks[t.get("number", 0)] = t
        elif ident == CLUSTER:
            m.clusters += 1
            time = 0
            for i, x, y in elements(data, a, e):
                if i == TIMESTAMP:
                    time = uint(data, x, y)
                elif i == SIMPLE_BLOCK:
                    _block(m, data, x, y, time, True, False)
                elif i == BLOCK_GROUP:
                    inner = {j: (p, q) for j, p, q in elements(data, x, y)}
                    if BLOCK in inner:
                        _block(m, data, *inner[BLOCK], time, False, REFERENCE_BLOCK not in inner)
        elif ident == CUES:
            for i, x, y in elements(data, a, e):
                if i == CUE_POINT:
                    point = {j: (p, q) for j, p, q in elements(data, x, y)}
                    where = {j: uint(data, p, q) for j, p, q in elements(data, *point.get(CUE_TRACK_POSITIONS, (0, 0)))}
                    m.cues.append((uint(data, *point.get(CUE_TIME, (0, 0))), where.get(CUE_TRACK, 0), at + where.get(CUE_CLUSTER_POSITION, 0)))
    m.complete = m.complete and last >= end


# --- writing ---


def size_of(n: int) -> bytes:
    width = next(w for w in range(1, 9) if n < (1 << (7 * w)) - 1)
    return ((1 << (7 * width)) | n).to_bytes(width, "big")


def element(ident: int, body: bytes | int | float | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, float):
        body = struct.pack(">d", body)
    elif isinstance(body, str):
        body = body.encode("ascii")
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_of(len(body)) + body


def lace(frames: list[bytes], kind: int) -> bytes:
    """A block's content after its header. kind must suit the frames: FIXED needs equal sizes."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames[:-1]]
    if kind == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes)
    elif kind == EBML_LACING:
        head += size_of(sizes[0])
        for a, b in zip(sizes, sizes[1:]):
            d = b - a
            width = next(w for w in range(1, 9) if abs(d) < (1 << (7 * w - 1)) - 1)
            head += ((1 << (7 * width)) | (d + (1 << (7 * width - 1)) - 1)).to_bytes(width, "big")
    return head + b"".join(frames)


def block(track: int, rel: int, frames: list[bytes], key: bool = True) -> bytes:
    """Content of a simple block; equal frames get fixed lacing, others EBML lacing, one none."""
    kind = NO_LACING if len(frames) == 1 else FIXED if len({len(f) for f in frames}) == 1 else EBML_LACING
    return size_of(track) + struct.pack(">hB", rel, 0x80 * key | kind << 1) + lace(frames, kind)


HEADER = element(EBML, b"".join([element(0x4286, 1), element(0x42F7, 1), element(0x42F2, 4), element(0x42F3, 8), element(0x4282, "matroska"), element(0x4287, 4), element(0x4285, 2)]))


def mux(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """A Matroska file with one track of 8-bit mono PCM that holds payload, a cluster every BLOCKS blocks, and a cue for each."""
    ms = packet * 1000 // rate
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, float(rate)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))
    entry = [element(TRACK_NUMBER, 1), element(TRACK_UID, 1), element(TRACK_TYPE, 2), element(CODEC_ID, "A_PCM/INT/LIT"), element(DEFAULT_DURATION, ms * 1_000_000), audio]
    info = element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, len(payload) * 1000 / rate) + element(0x4D80, "kgspark") + element(0x5741, "kgspark"))
    parts = [info, element(TRACKS, element(TRACK_ENTRY, b"".join(entry)))]
    at, cues = sum(map(len, parts)), []
    per = packet * LACED
    for c in range(0, len(payload), per * BLOCKS):
        time = c // packet * ms
        body = [element(TIMESTAMP, time)]
        for b in range(c, min(c + per * BLOCKS, len(payload)), per):
            stop = min(b + per, len(payload))
            frames = [payload[f : min(f + packet, stop)] for f in range(b, stop, packet)]
            body.append(element(SIMPLE_BLOCK, block(1, (b - c) // packet * ms, frames)))
        parts.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE_POINT, element(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, at))))
        at += len(parts[-1])
    return HEADER + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def read_back(data: bytes, m: Media | None = None, track: int = 1) -> bytes:
    """The bytes of a track's packets, joined."""
    m = m or demux(data)
    return b"".join(data[p[2] : p[2] + p[3]] for p in m.packets if p[0] == track)


def payload_of(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    """UTF-8 with spaces appended up to a positive multiple of unit; and the length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % unit if raw else unit), len(raw)


def feature(payload: bytes, m: Media) -> str:
    """Packets, clusters, milliseconds, and mean, deviation, crossings of the mid level and entropy of the samples."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    v = np.arange(256)
    mean = float((v * n).sum()) / len(x)
    dev = max(0.0, float((v * v * n).sum()) / len(x) - mean * mean) ** 0.5
    high = x >= 96
    cross = int((high[1:] != high[:-1]).sum())
    return f"packets={len(m.packets)};clusters={m.clusters};cues={len(m.cues)};ms={len(x) * 1000 // RATE};mean={mean:.4f};dev={dev:.4f};cross={cross};entropy={-(p * np.log2(p)).sum():.4f}"


def text_media(docs: DataFrame, emit_media: bool = False) -> DataFrame:
    """Store each text as sound in a Matroska file, read it back from the file, and compute features.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (and media, the file).
    A null text counts as empty and is stored as one unit of spaces; repeated rows stay; other columns are ignored.
    """
    workers_import_this(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", media binary" if emit_media else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                payload, n = payload_of(text)
                media = mux(payload)
                m = demux(media)
                back = read_back(media, m)
                row = (doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, m))
                rows.append((*row, media) if emit_media else row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return exact_ids(docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string")).mapInPandas(run, schema.replace("doc_id long", "doc_id string")))


PACKETS = "track long, timestamp_ns long, byte_start long, byte_length long, keyframe boolean, cluster long, lace long"


def packet_table(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per packet of each Matroska file: key, track, timestamp, byte range, keyframe, cluster, place in its lacing.

    Null, empty and broken files give the packets before the fault, maybe none.
    """
    workers_import_this(files.sparkSession)
    names = [c.split()[0] for c in PACKETS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, data in zip(b[key], b[media]):
                packets = demux(bytes(data or b"")).packets
                if packets:
                    yield pd.DataFrame(packets, columns=names).assign(**{key: k})[[key, *names]]

    return files.select(key, media).mapInPandas(run, f"`{key}` {files.schema[key].dataType.simpleString()}, {PACKETS}")
