"""Media columns: Matroska files as packet tables.

``parse`` reads variable-length EBML elements, clusters, blocks with any lacing, and cues;
``encode`` writes 8-bit PCM samples as one audio track.  ``packet_table`` turns a column of files
into rows of track, timestamp, duration, byte range and key flag, one for each frame.  A file
that can't be read has no packets and an error; a null file has neither.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import ship

# Identifiers of the Matroska elements that are read or written.
EBML, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, NUMBER, UID, TYPE, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, RATE, CHANNELS, DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, READ_VERSION = 0x4282, 0x4287, 0x4285
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

FRAME, LACED, CLUSTER_BYTES, SAMPLE_RATE = 512, 8, 32_768, 8000


def vint(data, at: int) -> tuple[int, int, bool]:
    """Value without its marker, next place, and whether all value bits are set (unknown size)."""
    first = data[at]
    if not first:
        raise ValueError(f"no length marker at byte {at}")
    n = 9 - first.bit_length()
    if at + n > len(data):
        raise ValueError(f"a number goes over the end at byte {at}")
    value = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return value, at + n, value == (1 << 7 * n) - 1


def to_vint(value: int, n: int = 0) -> bytes:
    n = n or next(k for k in range(1, 9) if value < (1 << 7 * k) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + to_vint(len(body)) + body


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float | None = None
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)  # track, timestamp, cluster, lacing, start, size, key
    cues: list[tuple] = field(default_factory=list)  # time, track, place of the cluster in the segment
    clusters: list[tuple] = field(default_factory=list)  # timestamp, place in the segment


def _children(data, at: int, end: int):
    """name, body's start and end of each element; one of unknown size ends at a sibling or parent of its kind."""
    while at < end:
        n = 9 - data[at].bit_length() if data[at] else 0
        if not 1 <= n <= 4 or at + n > end:
            raise ValueError(f"no element identifier at byte {at}")
        name = int.from_bytes(data[at : at + n], "big")
        size, body, unknown = vint(data, at + n)
        if unknown:
            stop = end if name == SEGMENT else _unknown_end(data, body, end)
        else:
            stop = body + size
        if stop > end:
            raise ValueError(f"element {name:X} at byte {at} goes over its parent's end")
        yield name, at, body, stop
        at = stop


def _unknown_end(data, at: int, end: int) -> int:
    while at < end:
        n = 9 - data[at].bit_length() if data[at] else 9
        if n > 4 or int.from_bytes(data[at : at + n], "big") in (CLUSTER, CUES, TRACKS, INFO, SEGMENT):
            return at
        size, body, _ = vint(data, at + n)
        at = body + size
    return end


def _uint(data, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _float(data, at: int, end: int) -> float:
    return float(np.frombuffer(bytes(data[at:end]), f">f{end - at}")[0]) if end - at in (4, 8) else 0.0


def block(data, at: int, end: int) -> tuple[int, int, int, int, list[tuple[int, int]]]:
    """track, relative time, flags, lacing, and each frame's start and size."""
    track, at, _ = vint(data, at)
    if at + 3 > end:
        raise ValueError("a block is shorter than its head")
    time = int.from_bytes(data[at : at + 2], "big", signed=True)
    flags, at = data[at + 2], at + 3
    lacing = flags >> 1 & 3
    if lacing == NO_LACING:
        return track, time, flags, lacing, [(at, end - at)]
    count, at = data[at] + 1, at + 1
    if lacing == FIXED:
        size, rest = divmod(end - at, count)
        if rest:
            raise ValueError("frames of fixed size don't fill the block")
        sizes = [size] * count
    else:
        sizes = []
        for k in range(count - 1):
            if lacing == XIPH:
                size = 0
                while True:
                    x, at = data[at], at + 1
                    size += x
                    if x < 255:
                        break
            else:
                before = at
                x, at, _ = vint(data, at)
                size = x if not k else sizes[-1] + x - ((1 << 7 * (at - before) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are larger than their block")
    frames = []
    for size in sizes:
        frames.append((at, size))
        at += size
    return track, time, flags, lacing, frames


def parse(data: bytes) -> Media:
    """All packets and cues; ValueError where the file breaks the format."""
    out, seen = Media(), False
    for name, _, body, end in _children(data, 0, len(data)):
        if name == EBML:
            seen = True
        elif name == SEGMENT and seen:
            _segment(data, body, end, out)
    if not seen:
        raise ValueError("no EBML head")
    return out


def _segment(data, start: int, stop: int, out: Media) -> None:
    for name, at, body, end in _children(data, start, stop):
        if name == INFO:
            for n, _, b, e in _children(data, body, end):
                if n == SCALE:
                    out.scale = _uint(data, b, e)
                elif n == DURATION:
                    out.duration = _float(data, b, e)
        elif name == TRACKS:
            for n, _, b, e in _children(data, body, end):
                if n == TRACK:
                    track = {"frame_ns": 0, "codec": "", "type": 0}
                    for m, _, x, y in _children(data, b, e):
                        if m in (NUMBER, TYPE, DEFAULT_DURATION):
                            track[{NUMBER: "number", TYPE: "type", DEFAULT_DURATION: "frame_ns"}[m]] = _uint(data, x, y)
                        elif m == CODEC:
                            track["codec"] = bytes(data[x:y]).decode("ascii", "replace").rstrip("\0")
                    out.tracks[track.get("number", 0)] = track
        elif name == CLUSTER:
            base = 0
            for n, _, b, e in _children(data, body, end):
                if n == TIMESTAMP:
                    base = _uint(data, b, e)
                elif n == SIMPLE:
                    _packets(data, b, e, base, len(out.clusters), None, out)
                elif n == GROUP:
                    inner = {m: (x, y) for m, _, x, y in _children(data, b, e)}
                    if BLOCK in inner:
                        _packets(data, *inner[BLOCK], base, len(out.clusters), REFERENCE not in inner, out)
            out.clusters.append((base, at - start))
        elif name == CUES:
            for n, _, b, e in _children(data, body, end):
                if n != CUE_POINT:
                    continue
                time, places = 0, []
                for m, _, x, y in _children(data, b, e):
                    if m == CUE_TIME:
                        time = _uint(data, x, y)
                    elif m == CUE_PLACES:
                        inside = {k: _uint(data, p, q) for k, _, p, q in _children(data, x, y)}
                        places.append((inside.get(CUE_TRACK, 0), inside.get(CUE_CLUSTER, 0)))
                out.cues += [(time, *p) for p in places]


def _packets(data, at: int, end: int, base: int, cluster: int, key: bool | None, out: Media) -> None:
    track, time, flags, lacing, frames = block(data, at, end)
    step = out.tracks.get(track, {}).get("frame_ns", 0) / out.scale
    key = bool(flags & 0x80) if key is None else key
    out.packets += [(track, base + time + round(k * step), cluster, lacing, a, n, key) for k, (a, n) in enumerate(frames)]


def encode(samples: bytes, frame: int = FRAME, laced: int = LACED, cluster_bytes: int = CLUSTER_BYTES, rate: int = SAMPLE_RATE) -> bytes:
    """One track of unsigned 8-bit PCM: clusters of laced blocks, then cues.  Equal samples give equal bytes."""
    scale = 1_000_000
    head = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(READ_VERSION, 2))
    length = len(samples) * 1000 / rate
    info = element(INFO, number(SCALE, scale) + element(DURATION, np.array([length], ">f8").tobytes()))
    audio = element(AUDIO, element(RATE, np.array([rate], ">f8").tobytes()) + number(CHANNELS, 1) + number(DEPTH, 8))
    entry = number(NUMBER, 1) + number(UID, 1) + number(TYPE, 2) + number(DEFAULT_DURATION, frame * 1_000_000_000 // rate)
    tracks = element(TRACKS, element(TRACK, entry + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for c in range(0, len(samples), cluster_bytes):
        piece = samples[c : c + cluster_bytes]
        base = c * 1000 // rate
        body = [number(TIMESTAMP, base)]
        for b in range(0, len(piece), frame * laced):
            frames = [piece[i : i + frame] for i in range(b, min(b + frame * laced, len(piece)), frame)]
            time = ((c + b) * 1000 // rate - base).to_bytes(2, "big", signed=True)
            body.append(element(SIMPLE, b"\x81" + time + _laced(frames)))
        whole = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, number(CUE_TIME, base) + element(CUE_PLACES, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(whole)
        at += len(whole)
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def _laced(frames: list[bytes]) -> bytes:
    """Flags, lace head and frames: equal frames as fixed size, a shorter last one by EBML numbers."""
    if len(frames) == 1:
        return b"\x80" + frames[0]
    count = bytes([len(frames) - 1])
    if len({len(x) for x in frames}) == 1:
        return bytes([0x80 | FIXED << 1]) + count + b"".join(frames)
    sizes = [len(x) for x in frames[:-1]]
    lace = to_vint(sizes[0])
    for a, b in zip(sizes, sizes[1:]):
        n = next(k for k in range(1, 9) if abs(b - a) < (1 << 7 * k - 1) - 1)
        lace += to_vint(b - a + (1 << 7 * n - 1) - 1, n)
    return bytes([0x80 | EBML_LACING << 1]) + count + lace + b"".join(frames)


def read_samples(data: bytes, media: Media, track: int = 1) -> bytes:
    """The frames of a track in file order."""
    return b"".join(data[p[4] : p[4] + p[5]] for p in media.packets if p[0] == track)


PACKETS = pa.list_(pa.struct([("track", pa.int32()), ("timestamp", pa.int64()), ("cluster", pa.int32()), ("lacing", pa.int32()), ("start", pa.int64()), ("size", pa.int64()), ("key", pa.bool_())]))


def packet_table(media: DataFrame, key: str, data: str) -> DataFrame:
    """key, file error, and one row for each packet; a file without packets has one row with nulls."""
    ship(media.sparkSession)

    def run(batches):
        for batch in batches:
            lists, errors = [], []
            for x in batch["data"].to_pylist():
                try:
                    found = parse(x).packets if x is not None else None
                    lists.append(None if found is None else [dict(zip([f.name for f in PACKETS.value_type], p, strict=True)) for p in found])
                    errors.append(None)
                except (ValueError, IndexError) as e:
                    lists.append(None)
                    errors.append(str(e) or "the file ends early")
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(errors, pa.string()), pa.array(lists, PACKETS)], ["key", "error", "packets"])

    kind = media.schema[key].dataType.simpleString()
    rows = media.select(F.col(key).alias("key"), F.col(data).alias("data")).mapInArrow(run, f"key {kind}, error string, packets array<struct<track:int,timestamp:long,cluster:int,lacing:int,start:long,size:long,key:boolean>>")
    return rows.select(F.col("key").alias(key), "error", F.explode_outer("packets").alias("p")).select(key, "error", "p.*")


def features(samples: bytes, media: Media) -> str:
    """Tracks, clusters, cues, packets, last timestamp, and mean, deviation, mean step and entropy of the samples."""
    x = np.frombuffer(samples, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    some = share[share > 0]
    mean = float((share * np.arange(256)).sum())
    spread = float((share * np.arange(256) ** 2).sum() - mean**2) ** 0.5 if len(x) else 0.0
    step = float(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64)) / len(x)
    entropy = float(-(some * np.log2(some)).sum())
    return f"{len(media.tracks)}:{len(media.clusters)}:{len(media.cues)}:{len(media.packets)}:{media.packets[-1][1]}:{mean:.4f}:{spread:.4f}:{step:.4f}:{abs(entropy):.4f}"


UNIT = 64
STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media of each text (null: empty): UTF-8, then zeros up to a positive multiple of 64, as samples."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [(x or "").encode() for x in batch["text"].to_pylist()]
            files = [encode(x + bytes(-len(x) % UNIT or (0 if x else UNIT))) for x in texts]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) for x in texts], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_digest(media: DataFrame) -> DataFrame:
    """Reads every file of text_media back by its packet table; STORED."""
    ship(media.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for doc, n, data in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"].to_pylist(), strict=True):
                m = parse(data)
                x = read_samples(data, m)
                rows.append((doc, n, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), features(x, m)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in STORED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names)

    return media.mapInArrow(run, STORED)


def op6_matroska(spark, sf_dir: str) -> DataFrame:
    """Every text as a Matroska file, read back by its packets."""
    return media_digest(text_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
