"""Media columns: bytes stored as 8-bit PNG, read back with every check, and a low-frequency hash.

store() packs a text's UTF-8, padded with zero bytes to rows of 64 samples, into a greyscale PNG: signature,
IHDR, IDAT chunks of bounded size, IEND, each chunk with its CRC. load() walks the chunks, tests lengths and
CRCs, inflates, undoes the row filters with numpy and hashes: the samples are averaged onto a 32 x 32 grid, and
the signs of the lowest 8 x 8 coefficients of its cosine transform against their median are the hash's 64 bits.
Equal bytes give equal files and features.

Null and empty texts become one row of 64 zeros. A file that fails a check raises an error, so damage is never
passed on; null media give null columns. Only named columns are read. Rows are independent of each other."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewheel.llm._shared import beside, column_list, in_arrow, slices_of, text_bytes

#: Fixed values of the format: signature, colour type to channels.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: Samples in a row, and bytes of an IDAT chunk at most.
WIDTH, CHUNK = 64, 1 << 20
#: Sides of the averaged grid and of the square of coefficients.
GRID, LOW = 32, 8


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(samples: np.ndarray, level: int = 6) -> bytes:
    """A greyscale PNG of a matrix of bytes; every row has filter 0 or, where that leaves fewer different bytes apart, filter 2 (up)."""
    height, width = samples.shape
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = samples
    rise = samples.copy()
    rise[1:] -= samples[:-1]
    cost = [np.abs(x.view(np.int8).astype(np.int16)).sum(1) for x in (samples, rise)]
    up = cost[1] * 4 < cost[0]
    rows[up, 0] = 2
    rows[up, 1:] = rise[up]
    packed = zlib.compress(rows.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + b"".join(chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)) + chunk(b"IEND", b"")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The chunks of a PNG, each after its tests."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at = len(SIGNATURE)
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(data):
            raise ValueError("a chunk is cut off")
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} has a wrong checksum")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            if at != len(data):
                raise ValueError("bytes follow the last chunk")
            return
    raise ValueError("the last chunk is missing")


def decode_png(data: bytes) -> np.ndarray:
    """The samples (height, width, channels) of an 8-bit PNG that isn't interlaced and has no palette."""
    head, body = None, []
    for kind, x in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", x)
        elif kind == b"IDAT":
            body.append(x)
    if head is None or head[2] != 8 or head[3] not in CHANNELS or any(head[4:]):
        raise ValueError("unsupported kind of PNG")
    width, height, n = head[0], head[1], CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != height * (width * n + 1):
        raise ValueError("wrong number of samples")
    rows = raw.reshape(height, width * n + 1)
    return unfilter(rows[:, 0], rows[:, 1:], n).reshape(height, width, n)


def unfilter(kinds: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Undo row filters. Runs of rows without a filter or with filter 2 are done at once: those are running sums
    down the columns, modulo 256; filter 1 is a running sum along the row; 3 and 4 go sample by sample."""
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    if not kinds.any():
        return rows
    out = np.empty_like(rows)
    edges = [0, *(np.flatnonzero((kinds[1:] != 2) | (kinds[:-1] > 2)) + 1).tolist(), len(kinds)]
    above = np.zeros(rows.shape[1], np.uint8)
    for a, b in zip(edges, edges[1:], strict=False):
        kind = kinds[a]
        if kind in (0, 2):
            block = rows[a:b].copy()
            if kind == 2:
                block[0] += above
            out[a:b] = np.cumsum(block, axis=0, dtype=np.uint8)
        else:
            line = rows[a].reshape(-1, n)
            if kind == 1:
                out[a] = np.cumsum(line, axis=0, dtype=np.uint8).ravel()
            else:
                out[a] = one_by_one(kind, line.astype(int).tolist(), above.reshape(-1, n).astype(int).tolist(), n)
            if b > a + 1:
                rest = rows[a + 1 : b].copy()
                rest[0] += out[a]
                out[a + 1 : b] = np.cumsum(rest, axis=0, dtype=np.uint8)
        above = out[b - 1]
    return out


def one_by_one(kind: int, line: list[list[int]], above: list[list[int]], n: int) -> list[int]:
    """A row with filter 3 (average) or 4 (nearest of left, up, upper left)."""
    out, left, corner = [], [0] * n, [0] * n
    for x, up in zip(line, above, strict=True):
        now = []
        for k in range(n):
            if kind == 3:
                guess = (left[k] + up[k]) // 2
            else:
                p = left[k] + up[k] - corner[k]
                guess = min((abs(p - left[k]), 0, left[k]), (abs(p - up[k]), 1, up[k]), (abs(p - corner[k]), 2, corner[k]))[2]
            now.append((x[k] + guess) & 255)
        out += now
        left, corner = now, up
    return out


@lru_cache(1)
def cosines() -> np.ndarray:
    """The first LOW rows of the cosine transform of GRID samples."""
    k, x = np.arange(LOW)[:, None], np.arange(GRID)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * GRID))


def averaged(samples: np.ndarray, axis: int) -> np.ndarray:
    """GRID means along an axis, each over its share of the samples, fractions of a sample counted."""
    n = samples.shape[axis]
    total = np.cumsum(samples, axis=axis, dtype=np.int64).astype(float)
    total = np.concatenate([np.zeros_like(np.take(total, [0], axis)), total], axis)
    at = np.arange(GRID + 1) * n / GRID
    low = np.minimum(at.astype(int), n - 1)
    shape = [1] * samples.ndim
    shape[axis] = -1
    part = (at - low).reshape(shape)
    sums = np.take(total, low, axis) * (1 - part) + np.take(total, low + 1, axis) * part
    return np.diff(sums, axis=axis) * GRID / n


def low_frequency_hash(samples: np.ndarray) -> str:
    """16 hexadecimal digits: the signs of the low coefficients against their median, row by row."""
    grey = samples.reshape(samples.shape[0], samples.shape[1], -1).mean(2) if samples.ndim == 3 and samples.shape[2] > 1 else samples.reshape(samples.shape[:2])
    rows = np.round(averaged(grey, 0) * 4096) if grey.shape[0] > 1 else np.repeat(grey.astype(float) * 4096, GRID, 0)
    grid = averaged(rows.astype(np.int64), 1)
    c = cosines()
    low = np.round(c @ grid @ c.T / 64).ravel()
    return np.packbits(low > np.median(low)).tobytes().hex()


def store(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_bytes (of the text in UTF-8) and media (the PNG)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_of(batch, len(keep)):
                texts = text_bytes(part.column(len(keep)))
                media = [encode_png(np.frombuffer(x.ljust(max(1, -(-len(x) // WIDTH)) * WIDTH, b"\0"), np.uint8).reshape(-1, WIDTH)) for x in texts]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return df.select(*keep, beside(keep, text)).transform(in_arrow, run, f"{column_list(df, keep)}, n_bytes bigint, media binary")


def load(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",), payload: bool = False) -> DataFrame:
    """`keep`, width, height, feature (the hash) and, if asked for, payload (the samples)."""
    names = [*keep, "width", "height", "feature", *["payload"] * payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_of(batch, len(keep)):
                read = [None if x is None else decode_png(x) for x in part.column(len(keep)).to_pylist()]
                made = [pa.array([None if x is None else x.shape[k] for x in read], pa.int32()) for k in (1, 0)]
                made.append(pa.array([None if x is None else low_frequency_hash(x) for x in read], pa.string()))
                if payload:
                    made.append(pa.array([None if x is None else x.tobytes() for x in read], pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=names)

    return df.select(*keep, beside(keep, media)).transform(in_arrow, run, f"{column_list(df, keep)}, width int, height int, feature string" + ", payload binary" * payload)
