"""Media columns: Matroska files as a binary column, parsed into packet tables.

`mux` lays bytes out as an uncompressed 8-bit mono track: EBML header, one segment with info, tracks, clusters of
laced simple blocks, and cues. `packets` parses any such column: variable-length ids and sizes, clusters, all
four kinds of lacing, cues; one row per frame with track, timestamp and byte range.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, utf8

FRAME = 192
FRAMES_PER_BLOCK = 64
BLOCKS_PER_CLUSTER = 8
RATE = 8000
#: The element ids of the format.
EBML, SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, CUES, CUE_POINT, CUE_PLACES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0x1C53BB6B, 0xBB, 0xB7
GROUP, BLOCK, SIMPLE, TIMESTAMP, SCALE, CUE_TIME, CUE_TRACK, CUE_AT = 0xA0, 0xA1, 0xA3, 0xE7, 0x2AD7B1, 0xB3, 0xF7, 0xF1
NUMBER, UID, TYPE, CODEC, SAMPLING, CHANNELS, DEPTH, DURATION = 0xD7, 0x73C5, 0x83, 0x86, 0xB5, 0x9F, 0x6264, 0x23E383
DOC_TYPE, VERSION, READ_VERSION, DOC_VERSION, DOC_READ, MAX_ID, MAX_SIZE, MUXER, WRITER = 0x4282, 0x4286, 0x42F7, 0x4287, 0x4285, 0x42F2, 0x42F3, 0x4D80, 0x5741
MASTERS = {SEGMENT, CLUSTER, GROUP, CUES, CUE_POINT, CUE_PLACES, TRACKS, ENTRY, INFO, AUDIO}


def vint(n: int) -> bytes:
    size = 1
    while n >= (1 << 7 * size) - 1:
        size += 1
    return (n | 1 << 7 * size).to_bytes(size, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes(-(-kind.bit_length() // 8), "big") + vint(len(body)) + body


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, -(-n.bit_length() // 8)), "big"))


HEAD = element(EBML, uint(VERSION, 1) + uint(READ_VERSION, 1) + uint(MAX_ID, 4) + uint(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ, 2))
ABOUT = element(INFO, uint(SCALE, 1_000_000) + element(MUXER, b"lumenlake") + element(WRITER, b"lumenlake"))
TRACK = element(TRACKS, element(ENTRY, uint(NUMBER, 1) + uint(UID, 1) + uint(TYPE, 2) + uint(DURATION, FRAME * 1_000_000_000 // RATE) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """A Matroska file of a payload whose length is a positive multiple of FRAME."""
    clusters, cues, place = [], [], len(ABOUT) + len(TRACK)
    per_block, per_cluster = FRAME * FRAMES_PER_BLOCK, FRAME * FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for at in range(0, len(payload), per_cluster):
        time = at * 1000 // RATE
        blocks = []
        for b in range(at, min(at + per_cluster, len(payload)), per_block):
            part = payload[b : b + per_block]
            frames = len(part) // FRAME
            relative = struct.pack(">h", b * 1000 // RATE - time)
            blocks.append(element(SIMPLE, b"\x81" + relative + (b"\x84" + bytes([frames - 1]) if frames > 1 else b"\x80") + part))  # 0x04: fixed-size lacing
        cluster = element(CLUSTER, uint(TIMESTAMP, time) + b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_PLACES, uint(CUE_TRACK, 1) + uint(CUE_AT, place))))
        clusters.append(cluster)
        place += len(cluster)
    return HEAD + element(SEGMENT, ABOUT + TRACK + b"".join(clusters) + element(CUES, b"".join(cues)))


def read_vint(data, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """Value, next place, and whether it says unknown size."""
    first = data[at]
    if not first:
        raise ValueError("longer than eight bytes")
    size = 9 - first.bit_length()
    raw = int.from_bytes(data[at : at + size], "big")
    value = raw if keep_marker else raw & (1 << 7 * size) - 1
    return value, at + size, not keep_marker and value == (1 << 7 * size) - 1


def frames_of(data, at: int, end: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Track, relative timestamp and byte ranges of the frames of a block."""
    track, at, _ = read_vint(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, relative, [(at, end)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 1:  # Xiph: sums of bytes, 255 goes on
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == 3:  # EBML: the first size, then signed differences
        for k in range(n - 1):
            before = at
            value, at, _ = read_vint(data, at)
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1))
    if lacing == 2:
        sizes = [(end - at) // n] * n
    else:
        sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    if at != end or min(sizes) < 0:
        raise ValueError("lacing does not fill its block")
    return track, relative, out


def parse(data) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, bool]]]:
    """Frames (track, timestamp, from, to) and cues (timestamp, place in the file, whether a cluster of that time starts there).

    Timestamps are in units of the file's scale. The frames of a laced block follow each other by the default duration of their track. Elements
    of unknown size end with their parent; a file that breaks off gives what is whole.
    """
    frames, cues, base, cue_time, scale = [], [], 0, 0, 1_000_000
    entries: list[dict] = []
    clusters: dict[int, int] = {}
    todo, time, cluster = [(0, len(data))], 0, 0
    while todo:
        at, end = todo.pop()
        if at >= end:
            continue
        try:
            kind, body, _ = read_vint(data, at, True)
            size, body, unknown = read_vint(data, body)
            stop = end if unknown else body + size
            if stop > end:
                if kind not in MASTERS:
                    continue
                stop = end
            todo.append((stop, end))
            number = lambda: int.from_bytes(data[body:stop], "big")  # noqa: B023, E731
            if kind in MASTERS:
                base = body if kind == SEGMENT else base
                cluster = at if kind == CLUSTER else cluster
                if kind == ENTRY:
                    entries.append({})
                todo.append((body, stop))
            elif kind == TIMESTAMP:
                time = clusters[cluster] = number()
            elif kind == SCALE:
                scale = number() or scale
            elif kind in (NUMBER, DURATION) and entries:
                entries[-1][kind] = number()
            elif kind in (SIMPLE, BLOCK):
                track, relative, ranges = frames_of(data, body, stop)
                frames += [(track, time + relative, k, a, b) for k, (a, b) in enumerate(ranges)]
            elif kind == CUE_TIME:
                cue_time = number()
            elif kind == CUE_AT:
                cues.append((cue_time, base + number()))
        except (IndexError, ValueError, struct.error):
            continue
    steps = {e.get(NUMBER): e.get(DURATION, 0) for e in entries}
    timed = [(track, start + k * steps.get(track, 0) // scale, a, b) for track, start, k, a, b in frames]
    return timed, [(t, place, clusters.get(place) == t) for t, place in cues]


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text in UTF-8, padded with spaces to a positive multiple of FRAME.

    Null text: empty, that is FRAME spaces. Row by row: repeated rows and null ids stay; other columns are not read.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf("n_bytes long, media binary")
    def store(texts: pd.Series) -> pd.DataFrame:
        raw = [utf8(t) for t in texts]
        return pd.DataFrame({"n_bytes": [len(x) for x in raw], "media": [mux(x.ljust(max(1, -(-len(x) // FRAME)) * FRAME)) for x in raw]})

    return docs.select("doc_id", store("text").alias("m")).select("doc_id", "m.n_bytes", "m.media")


def packets(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """The packet table: key, packet, track, timestamp, start, size. Null or broken files: what is whole of them."""

    @F.pandas_udf("array<struct<track:int,timestamp:long,start:long,size:long>>")
    def of(column: pd.Series) -> pd.Series:
        return pd.Series([[(t, s, a, b - a) for t, s, a, b in parse(x or b"")[0]] for x in column])

    out = files.select(key, of("media").alias("found")).select(key, F.posexplode("found").alias("packet", "p"))
    return out.select(key, "packet", "p.track", "p.timestamp", "p.start", "p.size")


def digests(files: DataFrame) -> DataFrame:
    """What is read back from each media file: its payload's figures and a feature string."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, packets long")
    def of(column: pd.Series) -> pd.DataFrame:
        rows = []
        for data in column:
            frames, cues = parse(data)
            payload = b"".join([data[a:b] for _, _, a, b in frames])
            x = np.frombuffer(payload, np.uint8)
            shape = np.bincount(x >> 5, minlength=8)
            feature = f"{len(frames)}:{sum(fine for _, _, fine in cues)}:{frames[-1][1] if frames else 0}:{int(x.sum(dtype=np.int64))}:" + ".".join(map(str, shape))
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(frames)))
        return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "packets"])

    return files.withColumn("d", of("media")).select(*[c for c in files.columns if c != "media"], "d.*")


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(media(table(spark, sf_dir, "documents")))
