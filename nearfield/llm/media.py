"""Media columns: texts as PNG images in binary columns, read back with checks, and hashed.

A payload of bytes becomes an 8-bit RGB image of 64 pixels (192 bytes) a row. The writer gives
each row the filter with the smallest sum of absolute values (none, left or upper neighbour;
their inverses are running sums) and makes the signature and IHDR, IDAT and IEND chunks with
their CRC-32; the reader checks every
chunk's CRC, inflates, undoes all five row filters with numpy, and returns the samples. The
feature is a perceptual hash: grey levels averaged down to 32 x 32, a two-dimensional cosine
transform, and the signs of its 8 x 8 lowest frequencies against their median, 64 bits.

Defined cases: null text counts as empty and gives 192 spaces; a null doc_id is kept; very long
texts give tall images (one image is worked on at a time, memory is a few times one text); rows
may repeat; equal texts give equal bytes and features; an empty table gives an empty table;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearfield.llm import textgrid as tg
from nearfield.llm.storage import map_arrow

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
LEVEL = 1
GREY, RGB = 0, 2


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filtered(samples: np.ndarray, filters: np.ndarray, bpp: int) -> np.ndarray:
    """Rows of samples after the given filter of each row (0 none, 1 sub, 2 up, 3 average, 4 Paeth)."""
    x = samples.astype(np.int16)
    up = np.vstack([np.zeros((1, x.shape[1]), np.int16), x[:-1]])
    left = np.pad(x, ((0, 0), (bpp, 0)))[:, :-bpp]
    corner = np.pad(up, ((0, 0), (bpp, 0)))[:, :-bpp]
    guess = np.stack([np.zeros_like(x), left, up, (left + up) // 2, _paeth(left, up, corner)])
    return (x - guess[filters, np.arange(len(x))]).astype(np.uint8)


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def best_filters(samples: np.ndarray, bpp: int) -> tuple[np.ndarray, np.ndarray]:
    """(filters, filtered rows): for each row none, left or upper neighbour (0, 1, 2), whichever leaves the
    least sum of absolute values as signed bytes; the lower number on ties."""
    left, up = samples.copy(), samples.copy()
    left[:, bpp:] -= samples[:, :-bpp]
    up[1:] -= samples[:-1]
    rows = np.stack([samples, left, up])
    filters = np.abs(rows.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0).astype(np.uint8)
    return filters, rows[filters, np.arange(len(samples))]


def unfiltered(rows: np.ndarray, filters: np.ndarray, bpp: int) -> np.ndarray:
    """The samples of filtered rows.

    Rows without neighbours (none) and with the left one (sub) are done at once; runs of up
    rows are running sums. Average and Paeth need the left, upper and corner sample, so they
    go by anti-diagonals: all pixels whose column plus row is the same.
    """
    h, w = rows.shape
    out = rows.copy()
    if filters.max(initial=0) > 4:
        raise ValueError("a row has an unknown filter")
    if not (filters > 2).any():
        sub = filters == 1
        if sub.any():
            out[sub] = np.cumsum(rows[sub].reshape(-1, w // bpp, bpp), axis=1, dtype=np.uint8).reshape(-1, w)
        if (filters == 2).any():
            starts = np.flatnonzero(filters != 2)
            for a, b in zip([*([] if filters[0] != 2 else [0]), *starts], [*(starts if filters[0] == 2 else starts[1:]), h], strict=True):
                if b - a > 1:
                    out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        return out
    pixels = w // bpp
    x = np.zeros((h + 1, pixels + 1, bpp), np.int16)
    raw = rows.reshape(h, pixels, bpp).astype(np.int16)
    for t in range(h + pixels - 1):
        r = np.arange(max(0, t - pixels + 1), min(h, t + 1))
        c = t - r
        a, b, d = x[r + 1, c], x[r, c + 1], x[r, c]
        f = filters[r][:, None]
        guess = np.select([f == 1, f == 2, f == 3, f == 4], [a, b, (a + b) // 2, _paeth(a, b, d)], 0)
        x[r + 1, c + 1] = (raw[r, c] + guess) & 255
    return x[1:, 1:].reshape(h, w).astype(np.uint8)


def encode_png(samples: np.ndarray, filters: np.ndarray | None = None) -> bytes:
    """A PNG of (height, width, channels) 8-bit samples, 1 or 3 channels; ``filters`` by row, or the best of three."""
    h, w, channels = samples.shape
    rows = samples.reshape(h, w * channels)
    if filters is None:
        filters, rows = best_filters(rows, channels)
    elif filters.any():
        rows = filtered(rows, filters, channels)
    data = zlib.compress(np.hstack([filters[:, None].astype(np.uint8), rows]).tobytes(), LEVEL)
    head = struct.pack(">IIBBBBB", w, h, 8, RGB if channels == 3 else GREY, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", data) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) samples; ValueError where a checksum or the form is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"the checksum of {kind!r} is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended, at = kind == b"IEND", at + 12 + n
    if head is None or not ended or head[2] != 8 or head[3] not in (GREY, RGB) or head[6]:
        raise ValueError("not an 8-bit grey or RGB image without interlacing")
    w, h, channels = head[0], head[1], 3 if head[3] == RGB else 1
    flat = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if len(flat) != h * (w * channels + 1):
        raise ValueError("too few or too many samples")
    rows = flat.reshape(h, w * channels + 1)
    return unfiltered(rows[:, 1:], rows[:, 0], channels).reshape(h, w, channels)


SIDE, LOW = 32, 8
_K = np.arange(SIDE)
COSINES = np.cos(np.pi * (2 * _K[None, :] + 1) * _K[:LOW, None] / (2 * SIDE))


def _shrunk(x: np.ndarray, n: int) -> np.ndarray:
    """Means over n nearly equal parts of the first axis; a short axis is repeated first."""
    if len(x) < n:
        x = np.repeat(x, -(-n // len(x)), axis=0)
    edge = np.arange(n + 1) * len(x) // n
    return np.add.reduceat(x, edge[:-1], axis=0) / np.diff(edge)[:, None]


def cosine_hash(samples: np.ndarray) -> bytes:
    """8 bytes: which of the 8 x 8 lowest frequencies are above their median (the constant one aside)."""
    grey = samples.mean(axis=2)
    small = _shrunk(_shrunk(grey, SIDE).T, SIDE).T
    low = np.round(COSINES @ small @ COSINES.T, 6).reshape(-1)
    return np.packbits(low > np.median(low[1:])).tobytes()


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the binary column media: every whole text as a PNG."""

    def run(batches):
        for batch in batches:
            for rows in tg.blocks(batch, "text"):
                data, o = tg.buffers(rows.column("text"))
                media = []
                for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True):
                    payload = np.full(max(1, -(-(b - a) // ROW)) * ROW, 32, np.uint8)
                    payload[: b - a] = data[a:b]
                    media.append(encode_png(payload.reshape(-1, WIDTH, CHANNELS)))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(np.diff(o), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What the stored images hold: sizes, digests and hashes. A broken image fails the job."""

    def run(batches):
        for batch in batches:
            for rows in tg.blocks(batch, "media"):
                out = []
                for data in rows.column("media").to_pylist():
                    samples = decode_png(data)
                    payload = samples.tobytes()
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples).hex()))
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_bytes"), *map(pa.array, zip(*out, strict=True))], names=["doc_id", "n_bytes", *names])

    return map_arrow(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1(spark, sf_dir):
    return media_features(with_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ORACLE_SQL = None
