"""Media columns: AVI files with motion-JPEG frames, held in a binary column.

Storing.  A payload becomes 8-bit grey rows of 192 samples, up to 16 rows a frame.  Each
frame is a lossless JPEG (process 14, SOF3, left-neighbour predictor).  Its Huffman table
gives category s a code of 9 - s bits, so a code and its s extra bits always fill 9 bits:
a valid table by which numpy packs and unpacks whole frames, with no loop over bits.  (The
lossy DCT of common motion-JPEG could not return the stored bytes.)  Frames lie in the movi
list of a RIFF/AVI file with an idx1 index.

Reading.  The RIFF chunks are parsed, idx1 locates the frames, every frame is decoded by
itself; lossless frames with other Huffman tables, predictors and widths are read as well, one
sample at a time.  Shots: the 16-bin histogram difference between neighbouring frames is held against
an adaptive threshold, mean plus three deviations of the preceding differences of the shot;
each shot is a clip with its times.

Defined results: a null text is the empty payload; payloads are padded with bytes 32 to a
positive multiple of 192; equal texts give equal files (they hold no times or ids); repeated
rows give repeated results; null media gives no frames; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

WIDTH, ROWS, FPS, BINS = 192, 16, 25, 16
#: Shot rule: differences of the shot that the threshold looks back on, deviations, floor.
LOOK_BACK, DEVIATIONS, FLOOR = 24, 3.0, 0.08


def _words() -> np.ndarray:
    """9-bit word of each difference from -255 to 255."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        out[d + 255] = (((1 << (8 - s)) - 1) << 1 << s) | (d if d >= 0 else d + (1 << s) - 1)
    return out


WORD = _words()
DIFFERENCE = np.zeros(512, np.int16)
DIFFERENCE[WORD] = np.arange(-255, 256)
HUFFMAN = b"\0" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))


def _pack(samples: np.ndarray) -> np.ndarray:
    """Rows of 192 samples to rows of 216 coded bytes; frames start at every ROWS-th row."""
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, 1:] = x[:, 1:] - x[:, :-1]
    d[1:, 0] = x[1:, 0] - x[:-1, 0]
    d[::ROWS, 0] = x[::ROWS, 0] - 128
    w = WORD[d + 255].reshape(-1, 8)
    out = np.empty((len(w), 9), np.uint8)
    for i in range(9):  # byte i holds the low bits of word i-1 and the high bits of word i
        high = w[:, i] >> (i + 1) if i < 8 else 0
        out[:, i] = ((w[:, i - 1] << (8 - i)) & 255 | high) if i else high
    return out.reshape(len(samples), -1)


def _unpack(coded: np.ndarray) -> np.ndarray:
    b = coded.reshape(-1, 9).astype(np.uint16)
    w = np.empty((len(b), 8), np.uint16)
    for i in range(8):
        w[:, i] = (b[:, i] << (i + 1) | b[:, i + 1] >> (7 - i)) & 511
    d = DIFFERENCE[w].reshape(-1, WIDTH).astype(np.int32)
    first = d[:, 0].cumsum()
    base = np.repeat(np.concatenate(([0], first[ROWS - 1 :: ROWS]))[: -(-len(d) // ROWS)], ROWS)[: len(d)]
    d[:, 0] = first - base + 128
    return (d.cumsum(axis=1) & 255).astype(np.uint8)


def _jpeg(rows: int, coded: bytes) -> bytes:
    return (
        b"\xff\xd8" + b"\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, rows, WIDTH, 1, 1, 0x11, 0)
        + b"\xff\xc4" + struct.pack(">H", 2 + len(HUFFMAN)) + HUFFMAN
        + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0) + coded.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
    )


def _chunk(kind: bytes, data: bytes) -> bytes:
    return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def pad(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def avi(payload: bytes) -> bytes:
    """An AVI file of lossless JPEG frames with the payload, a positive multiple of 192 bytes."""
    coded = _pack(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))
    frames = [_jpeg(len(x), x.tobytes()) for x in (coded[i : i + ROWS] for i in range(0, len(coded), ROWS))]
    chunks, index, at = [], [], 4
    for f in frames:
        chunks.append(c := _chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, WIDTH, ROWS, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4h", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0, 0, 0, 0, WIDTH, ROWS)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, ROWS, 1, 8, b"MJPG", WIDTH * ROWS, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", b"".join(index)))


def _parts(data: bytes, at: int, end: int):
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, at)
        yield kind, at + 8, size
        at += 8 + size + (size & 1)


def _scan(frame: bytes) -> tuple[int, int, int, list[tuple[bytes, bytes]], bytes]:
    """Rows, width and predictor of a lossless frame of one component, its Huffman tables (id and
    definition) and its coded bytes."""
    at, rows, width, tables = 2, 0, 0, []
    while frame[at + 1] != 0xDA:
        kind, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        if kind == 0xC3:
            bits, rows, width, parts = struct.unpack_from(">BHHB", frame, at + 4)
            if bits != 8 or parts != 1:
                raise ValueError("not an 8-bit frame of one component")
        elif kind in (0xC0, 0xC1, 0xC2, *range(0xC5, 0xC8), *range(0xC9, 0xD0), 0xDD):
            raise ValueError(f"not a lossless Huffman frame without restarts: marker {kind:#x}")
        elif kind == 0xC4:
            place, end = at + 4, at + 2 + size
            while place < end:
                n = 17 + sum(frame[place + 1 : place + 17])
                tables.append((frame[place : place + 1], frame[place + 1 : place + n]))
                place += n
        at += 2 + size
    if not rows or not tables:
        raise ValueError("not a lossless JPEG frame")
    used, predictor = frame[at + 6] >> 4, frame[at + 7]
    at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    coded = frame[at:-2].replace(b"\xff\x00", b"\xff")
    return rows, width, predictor, [(k, d) for k, d in tables if k[0] & 15 == used][-1:], coded


def _plain(rows: int, width: int, predictor: int, table: bytes, coded: bytes) -> np.ndarray:
    """Samples of a frame with any Huffman table and predictor, bit by bit."""
    symbol, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            symbol[length, code] = table[at]
            code, at = code + 1, at + 1
        code <<= 1
    bits = np.unpackbits(np.frombuffer(coded, np.uint8)).tolist()
    x, place = np.zeros((rows, width), np.int32), 0
    for r in range(rows):
        for c in range(width):
            length, code = 1, bits[place]
            while (length, code) not in symbol:
                code = code << 1 | bits[place + length]
                length += 1
            s, place, value = symbol[length, code], place + length, 0
            for bit in bits[place : place + s]:
                value = value << 1 | bit
            place += s
            d = value if not s or value >> (s - 1) else value - (1 << s) + 1
            left, up, corner = (int(x[r, c - 1]) if c else 0), (int(x[r - 1, c]) if r else 0), (int(x[r - 1, c - 1]) if r and c else 0)
            if not c:
                guess = up if r else 128
            elif not r:
                guess = left
            else:
                guess = (0, left, up, corner, left + up - corner, left + (up - corner >> 1), up + (left - corner >> 1), left + up >> 1)[predictor]
            x[r, c] = guess + d & 255
    return x.astype(np.uint8)


def read_avi(data: bytes) -> tuple[np.ndarray, np.ndarray, float]:
    """Samples (rows of the frames' width), the first row of each frame, frames a second.  Frames
    as this module writes them are decoded together, others one by one."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, fps = 0, b"", float(FPS)
    for kind, at, size in _parts(data, 12, len(data)):
        if kind == b"LIST" and data[at : at + 4] == b"movi":
            movi = at
        elif kind == b"LIST" and data[at : at + 4] == b"hdrl":
            for inner, where, _ in _parts(data, at + 4, at + size):
                if inner == b"avih":
                    fps = 1e6 / struct.unpack_from("<I", data, where)[0]
        elif kind == b"idx1":
            index = data[at : at + size]
    frames = [_scan(data[movi + offset + 8 : movi + offset + 8 + size]) for _, _, offset, size in struct.iter_unpack("<4sIII", index)]
    starts = np.cumsum([0, *(f[0] for f in frames[:-1])])
    own = all(w == WIDTH and p == 1 and t[0][1] == HUFFMAN[1:] for _, w, p, t, _ in frames) and all(f[0] == ROWS for f in frames[:-1])
    if own:
        return _unpack(np.frombuffer(b"".join(f[4] for f in frames), np.uint8)), starts, fps
    return np.concatenate([_plain(r, w, p, t[0][1], c) for r, w, p, t, c in frames]), starts, fps


def histograms(samples: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A histogram of BINS bins for each frame."""
    frame = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(samples))) * samples.shape[1])
    return np.bincount(frame * BINS + (samples.ravel() >> 4), minlength=len(starts) * BINS).reshape(-1, BINS)


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot."""
    share = hist / hist.sum(axis=1, keepdims=True)
    diff = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    out, first, seen = [], 0, []
    for i, d in enumerate(diff.tolist(), 1):
        if len(seen) >= 2:
            near = seen[-LOOK_BACK:]
            mean = sum(near) / len(near)
            limit = mean + DEVIATIONS * (sum((x - mean) ** 2 for x in near) / len(near)) ** 0.5
            if d > max(limit, FLOOR):
                out.append((first, i))
                first, seen = i, []
                continue
        seen.append(d)
    return [*out, (first, len(hist))]


def feature(samples: np.ndarray, starts: np.ndarray) -> str:
    hist = histograms(samples, starts)
    return f"frames={len(hist)};shots={len(shots(hist))};levels={'-'.join(map(str, hist.sum(axis=0).tolist()))}"


def to_media(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and media binary: the AVI file of each text."""
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def work(chunk):
        return [*(chunk.column(i) for i in range(len(keep))), [avi(pad((t or "").encode())) for t in chunk.column(len(keep)).to_pylist()]]

    return map_rows(docs, [*keep, text_col], f"{kept}, media binary", work)


def read_media(media: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """The kept columns with digests and features of what the media column's files hold."""
    kept = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)

    def work(chunk):
        out = []
        for m in chunk.column(len(keep)).to_pylist():
            samples, starts, _ = read_avi(m)
            raw = samples.tobytes()
            out.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(samples, starts)))
        return [*(chunk.column(i) for i in range(len(keep))), *map(list, zip(*out, strict=True))]

    return map_rows(media.where(F.col(media_col).isNotNull()), [*keep, media_col], f"{kept}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", work)


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, clip, start_s, end_s, frames, mean_level) for each shot of each file."""

    def work(chunk):
        out = []
        for i, m in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), strict=True):
            samples, starts, fps = read_avi(m)
            rows = [*starts.tolist(), len(samples)]
            for k, (a, b) in enumerate(shots(histograms(samples, starts))):
                out.append((i, k, a / fps, b / fps, b - a, float(samples[rows[a] : rows[b]].mean())))
        return list(map(list, zip(*out, strict=True)))

    return map_rows(media.where(F.col(media_col).isNotNull()), [id_col, media_col], f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, clip int, start_s double, end_s double, frames int, mean_level double", work)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return read_media(to_media(docs, ["doc_id", "n_bytes"]), ["doc_id", "n_bytes"])


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips of every document's file."""
    return clips(to_media(table(spark, sf_dir, "documents"), ["doc_id"]))
