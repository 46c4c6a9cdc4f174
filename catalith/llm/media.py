"""Media columns: Netpbm and BMP images decoded to arrays, resized, tiled and hashed.

``decode_image`` reads P5 (grey) and P6 (colour) Netpbm with one byte a sample
and uncompressed 8-bit (palette) or 24-bit BMP.  ``area_resize`` averages the
area below each target pixel, fractions included, from an integral image.
``npy_tiles`` cuts an image into NPY files, ``difference_hash`` compares
neighbouring pixels of an 8 by 9 reduction.

``as_media`` stores texts losslessly as images: the UTF-8 bytes, filled with
zeros to a positive multiple of 64, become the samples of a grey image 64 wide
(P5, or BMP on request).

Edge cases: a null or empty text is one row of 64 zeros; null ids stay null;
repeated rows each give a row with the same values; an empty table gives none;
other columns are not read.  A broken image raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from catalith.llm.common import id_and_text, rowwise

WIDTH = 64
_PNM = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def encode_pnm(pixels: np.ndarray) -> bytes:
    """P5 for a matrix, P6 for height x width x 3; samples are bytes."""
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """8-bit grey for a matrix, 24-bit for height x width x 3 (rows bottom up, filled to 4 bytes)."""
    grey = pixels.ndim == 2
    height, width = pixels.shape[:2]
    lines = pixels[::-1] if grey else pixels[::-1, :, ::-1].reshape(height, width * 3)
    lines = np.pad(np.ascontiguousarray(lines, np.uint8), ((0, 0), (0, -lines.shape[1] % 4)))
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8) if grey else np.empty(0, np.uint8)
    offset = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", offset + lines.size, 0, 0, offset)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, lines.size, 2835, 2835, 256 if grey else 0, 0)
    return head + info + palette.tobytes() + lines.tobytes()


def decode_image(data: bytes) -> np.ndarray:
    """Height x width, or height x width x 3, of bytes."""
    if m := _PNM.match(data):
        width, height, most = (int(x) for x in m.groups()[1:])
        shape = (height, width) if m[1] == b"5" else (height, width, 3)
        if not 0 < most < 256 or len(data) - m.end() < int(np.prod(shape)):
            raise ValueError("Netpbm image is cut short or has wide samples")
        return np.frombuffer(data, np.uint8, int(np.prod(shape)), m.end()).reshape(shape)
    if data[:2] == b"BM" and len(data) >= 54:
        offset = struct.unpack_from("<I", data, 10)[0]
        size, width, height, _, bits, packed, _, _, _, colours, _ = struct.unpack_from("<IiiHHIIiiII", data, 14)
        stride = (width * bits + 31) // 32 * 4
        if bits not in (8, 24) or packed or len(data) < offset + stride * abs(height):
            raise ValueError("BMP is cut short, packed or of another depth")
        lines = np.frombuffer(data, np.uint8, stride * abs(height), offset).reshape(abs(height), stride)
        lines = lines[::-1] if height > 0 else lines
        if bits == 24:
            return lines[:, : width * 3].reshape(-1, width, 3)[:, :, ::-1]
        palette = np.frombuffer(data, np.uint8, (colours or 256) * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        pixels = palette[lines[:, :width]]
        return pixels[:, :, 0] if (pixels == pixels[:, :, :1]).all() else pixels
    raise ValueError("neither Netpbm nor BMP")


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area below each target pixel, from a summed-area table."""
    grey = pixels if pixels.ndim == 2 else pixels.mean(axis=2)
    table = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=table[1:, 1:])

    def lines(a: np.ndarray, n: int) -> np.ndarray:
        edge = np.linspace(0, a.shape[0] - 1, n + 1)
        low = np.minimum(edge.astype(int), a.shape[0] - 2)
        part = (edge - low)[:, None]
        return np.diff(a[low] * (1 - part) + a[low + 1] * part, axis=0)

    area = grey.shape[0] * grey.shape[1] / (height * width)
    return lines(lines(table, height).T, width).T / area


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as 16 hex digits: is each pixel of an 8 x 9 reduction darker than its right neighbour?"""
    small = area_resize(pixels, 8, 9)
    return np.packbits(np.diff(np.round(small, 6), axis=1) > 0).tobytes().hex()


def npy_tiles(pixels: np.ndarray, side: int = 256) -> list[bytes]:
    """NPY files of the tiles, row by row; tiles at the right and lower edge may be smaller."""
    out = []
    for y in range(0, pixels.shape[0], side):
        for x in range(0, pixels.shape[1], side):
            np.save(to := io.BytesIO(), np.ascontiguousarray(pixels[y : y + side, x : x + side]), allow_pickle=False)
            out.append(to.getvalue())
    return out


def untile(tiles: list[bytes], width: int) -> np.ndarray:
    """The image that ``npy_tiles`` cut."""
    rows, row, have = [], [], 0
    for tile in (np.load(io.BytesIO(t), allow_pickle=False) for t in tiles):
        row.append(tile)
        have += tile.shape[1]
        if have == width:
            rows.append(np.concatenate(row, axis=1))
            row, have = [], 0
    return np.concatenate(rows)


def _pixels(text: str | None) -> tuple[np.ndarray, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    filled = data + bytes(-len(data) % WIDTH if data else WIDTH)
    return np.frombuffer(filled, np.uint8).reshape(-1, WIDTH), len(data)


_CODECS = {"pgm": encode_pnm, "bmp": encode_bmp}


def as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: str = "pgm", side: int = 256) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``media`` (the stored image), ``tiles`` (NPY files
    of the decoded image), ``thumbnail`` (8 x 9 means, row by row), ``feature`` (difference hash)."""
    encode = _CODECS[codec]
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(parts):
        for part in (p.slice(at, 256) for p in parts for at in range(0, p.num_rows, 256)):
            media, sizes, tiles, small, marks = [], [], [], [], []
            for text in part.column(1).to_pylist():
                pixels, n = _pixels(text)
                stored = encode(pixels)
                read = decode_image(stored)
                media.append(stored)
                sizes.append(n)
                tiles.append(npy_tiles(read, side))
                small.append(area_resize(read, 8, 9).ravel())
                marks.append(difference_hash(read))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(tiles, pa.list_(pa.binary())), pa.array(small, pa.list_(pa.float64())), pa.array(marks, pa.string())], names=["doc_id", "n_bytes", "media", "tiles", "thumbnail", "feature"])

    kinds = (("doc_id", T.LongType()), ("n_bytes", T.LongType()), ("media", T.BinaryType()), ("tiles", T.ArrayType(T.BinaryType())), ("thumbnail", T.ArrayType(T.DoubleType())), ("feature", T.StringType()))
    return id_and_text(docs, id_col, text_col).mapInArrow(run, T.StructType([T.StructField(*k) for k in kinds]))


def media_digests(media: DataFrame) -> DataFrame:
    """Digests of stored images, from their bytes and their tiles read back."""

    def one(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tiles", "feature")}
        for doc_id, n, stored, tiles, feature in zip(*(rows[c] for c in ("doc_id", "n_bytes", "media", "tiles", "feature")), strict=True):
            payload = np.ascontiguousarray(decode_image(stored)).tobytes()
            if untile(tiles, WIDTH).tobytes() != payload:
                raise ValueError(f"tiles of {doc_id} differ from its image")
            for k, v in zip(out, (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), len(tiles), feature), strict=True):
                out[k].append(v)
        return out

    return rowwise(media.select("doc_id", "n_bytes", "media", "tiles", "feature"), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tiles long, feature string", one, 256)
