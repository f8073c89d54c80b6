"""Matroska columns: texts as lossless 8-bit audio, and packet tables of Matroska files.

A file is a tree of elements, each an identifier, a variable-length size and a
body. ``mux`` writes one audio track of unsigned 8-bit samples in laced blocks
with cues; ``packets`` reads any element tree back into rows of
(track, timestamp, byte range).

Nulls and edge cases: a null text counts as the empty text, which is stored as one
frame of spaces; texts of any length are stored whole; repeated rows give equal results, as
equal texts give equal bytes; an empty table gives an empty result; extra columns are
ignored. ``packet_table`` gives no rows for null media and those of the packets before the
damage for a file that is cut off or broken.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 192
RATE = 8000
FRAME_MS = FRAME * 1000 // RATE
FRAMES_PER_BLOCK = 16
BLOCKS_PER_CLUSTER = 64

# Element identifiers of the public Matroska specification.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
FLAG_LACING, DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x9C, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
TOP_LEVEL = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 2, 4, 6


# ---- writing -----------------------------------------------------------------


def vint(value: int, width: int = 0) -> bytes:
    """A size: a length marker bit, then the value; all ones are kept for 'unknown'."""
    while not width or value >= (1 << 7 * width) - 1:
        width += 1
    return (value | 1 << 7 * width).to_bytes(width, "big")


def _id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def element(number: int, body: bytes) -> bytes:
    return _id(number) + vint(len(body)) + body


def _uint(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], mode: int) -> bytes:
    """The frames of one block behind their lacing header."""
    if mode == NO_LACING:
        return b"".join(frames)
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if mode == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif mode == EBML_LACING and len(frames) > 1:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = 1
            while not -(1 << 7 * width - 1) < b - a < 1 << 7 * width - 1:
                width += 1
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def simple_block(track: int, relative_ms: int, frames: list[bytes], mode: int) -> bytes:
    return element(SIMPLE_BLOCK, vint(track) + struct.pack(">hB", relative_ms, 0x80 | mode) + _lace(frames, mode))


def mux(payload: bytes, frame: int = FRAME, lacing: int = FIXED) -> bytes:
    """One track of unsigned 8-bit samples: ``payload`` in frames, blocks, clusters and cues."""
    header = element(
        EBML,
        _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8)
        + element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2),
    )
    per_frame_ms = frame * 1000 // RATE
    total_ms = -(-len(payload) // frame) * per_frame_ms
    info = element(
        INFO,
        _uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", total_ms))
        + element(MUXING_APP, b"shelfmark") + element(WRITING_APP, b"shelfmark"),
    )
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    tracks = element(
        TRACKS,
        element(
            TRACK_ENTRY,
            _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1)
            + element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, per_frame_ms * 1_000_000) + audio,
        ),
    )
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    block, cluster = frame * FRAMES_PER_BLOCK, frame * FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for start in range(0, len(payload), cluster):
        start_ms = start // frame * per_frame_ms
        body = [_uint(TIMESTAMP, start_ms)]
        for b in range(start, min(start + cluster, len(payload)), block):
            piece = payload[b : min(b + block, start + cluster)]
            frames = [piece[i : i + frame] for i in range(0, len(piece), frame)]
            mode = lacing if len(frames) > 1 else NO_LACING
            if mode == FIXED and len(frames[-1]) != len(frames[0]):
                mode = EBML_LACING
            body.append(simple_block(1, b // frame * per_frame_ms - start_ms, frames, mode))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, start_ms) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    return header + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


# ---- reading -----------------------------------------------------------------


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """Value, position behind it, and whether it is the reserved 'unknown'."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - first.bit_length()
    raw = int.from_bytes(data[at : at + width], "big")
    mask = (1 << 7 * width) - 1
    return (raw if keep_marker else raw & mask), at + width, raw & mask == mask


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(identifier, first byte of the body, byte behind it), parents before children.

    An element of unknown size lasts until a top-level identifier or the end.
    """
    while at < end:
        number, body, _ = read_vint(data, at, keep_marker=True)
        size, body, unknown = read_vint(data, body)
        stop = end if unknown else min(body + size, end)
        yield number, body, stop
        at = body if number in MASTERS else stop


def _uint_at(data: bytes, start: int, stop: int) -> int:
    return int.from_bytes(data[start:stop], "big")


def lace_sizes(data: bytes, at: int, stop: int, mode: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first begins."""
    if mode == NO_LACING:
        return [stop - at], at
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if mode == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif mode == EBML_LACING and n > 1:
        size, at, _ = read_vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            step, at, _ = read_vint(data, at)
            sizes.append(sizes[-1] + step - (1 << 7 * width - 1) + 1)
    elif mode == FIXED:
        sizes = [(stop - at) // n] * (n - 1)
    return [*sizes, stop - at - sum(sizes)], at


def packets(data: bytes, out: list | None = None) -> list[tuple[int, int, int, int, bool]]:
    """(track, timestamp in ms, first byte, size, key frame) of every frame, in file order; appended to ``out`` as they are found."""
    out = [] if out is None else out
    base, scale = 0, 1_000_000
    step: dict[int, int] = {}
    track_number = 1
    group, refers = 0, False  # a block of a group that refers to other frames is no key frame
    for number, start, stop in elements(data, 0, len(data)):
        if number == TIMESTAMP_SCALE:
            scale = _uint_at(data, start, stop)
        elif number == TRACK_NUMBER:
            track_number = _uint_at(data, start, stop)
        elif number == DEFAULT_DURATION:
            step[track_number] = _uint_at(data, start, stop)
        elif number == TIMESTAMP:
            base = _uint_at(data, start, stop)
        elif number == BLOCK_GROUP:
            group, refers = len(out), False
        elif number == REFERENCE_BLOCK:
            refers, out[group:] = True, [(*packet[:4], False) for packet in out[group:]]
        elif number in (SIMPLE_BLOCK, BLOCK):
            track, at, _ = read_vint(data, start)
            relative, flags = struct.unpack_from(">hB", data, at)
            sizes, at = lace_sizes(data, at + 3, stop, flags & 6)
            first_ns = (base + relative) * scale
            for i, size in enumerate(sizes):
                out.append((track, (first_ns + i * step.get(track, 0)) // 1_000_000, at, size, not refers if number == BLOCK else bool(flags & 0x80)))
                at += size
    return out


def readable_packets(data: bytes) -> list[tuple[int, int, int, int, bool]]:
    """The packets of a file up to where it is cut off or cannot be read; those that end within it."""
    out: list[tuple[int, int, int, int, bool]] = []
    try:
        packets(data, out)
    except (IndexError, ValueError, struct.error):
        pass
    return [p for p in out if p[3] >= 0 and p[2] + p[3] <= len(data)]


def cue_points(data: bytes) -> list[tuple[int, int, int]]:
    """(time in ms, track, position of the cluster in the segment)."""
    out, time, track = [], 0, 0
    for number, start, stop in elements(data, 0, len(data)):
        if number == CUE_TIME:
            time = _uint_at(data, start, stop)
        elif number == CUE_TRACK:
            track = _uint_at(data, start, stop)
        elif number == CUE_CLUSTER_POSITION:
            out.append((time, track, _uint_at(data, start, stop)))
    return out


def read_payload(data: bytes, track: int = 1) -> bytes:
    return b"".join(data[at : at + size] for t, _, at, size, _ in packets(data) if t == track)


# ---- columns -----------------------------------------------------------------


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8, padded with spaces to a positive multiple of the frame; and the bytes before padding."""
    raw = (text or "").encode("utf-8")
    return raw + b" " * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw)), len(raw)


def features(samples: bytes, table: list[tuple[int, int, int, int, bool]], cues: int) -> str:
    """What a listener's index would hold: packets, length, level, peak, crossings of the mean."""
    wave = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    level = int(round(1000 * float(np.sqrt(np.mean(wave.astype(np.float64) ** 2)))))
    above = wave > wave.mean()
    return f"packets={len(table)};ms={table[-1][1] + FRAME_MS};cues={cues};rms={level};peak={int(np.abs(wave).max())};crossings={int(np.count_nonzero(above[1:] != above[:-1]))}"


def to_media(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``media``: the text stored as a Matroska file."""

    @F.pandas_udf("binary")
    def media(texts):
        return texts.map(lambda t: mux(payload_of(t)[0]))

    return df.withColumn("media", media(F.col(text)))


def packet_table(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row per packet: key, packet, track, timestamp_ms, byte_start, byte_length, keyframe. Null media give none, broken ones those before the damage."""
    kind = "array<struct<track:int,timestamp_ms:long,byte_start:long,byte_length:long,keyframe:boolean>>"

    @F.pandas_udf(kind)
    def parsed(files):
        return files.map(lambda f: [] if f is None else [dict(zip(("track", "timestamp_ms", "byte_start", "byte_length", "keyframe"), p)) for p in readable_packets(bytes(f))])

    rows = df.select(F.col(key), F.posexplode(parsed(F.col(media))).alias("packet", "p"))
    return rows.select(key, "packet", "p.*")


def media_digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: sizes and digests of the payload as read back from the stored file, and its features."""
    key_type = df.select(key).schema[0].dataType.simpleString()
    schema = f"{key} {key_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def digest(batches):
        for batch in batches:
            rows = []
            for t in batch.column(1):
                payload, n = payload_of(t.as_py())
                stored = mux(payload)
                found = packets(stored)
                back = b"".join(stored[at : at + size] for _, _, at, size, _ in found)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back, found, len(cue_points(stored)))))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return df.select(key, text).mapInArrow(digest, schema)
