"""Media columns: Netpbm and BMP bytes to numpy arrays, area-resized tiles in NPY form, and difference hashes.

Resizing averages areas exactly: the integral image of a plane is read, with linear interpolation, at the borders of
each target cell, so a cell's mean is four reads whatever its area, and shrinking and growing are the same formula.

Defined results: a null text is the empty text; every payload has at least one row of samples, so no image is empty;
equal texts give equal values; bytes that are no supported image raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tidewatch.llm.common import map_batches, plain

#: Samples of a stored row: 64 pixels of three channels.
ROW = 192
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_ppm(pixels: np.ndarray) -> bytes:
    """Binary Netpbm: P6 for (h, w, 3), P5 for (h, w), 8 bits a sample."""
    h, w = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if pixels.ndim == 3 else 5, w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed 24-bit BMP, rows bottom-up, each padded to four bytes."""
    h, w, _ = pixels.shape
    pad = -3 * w % 4
    rows = np.zeros((h, 3 * w + pad), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h = head[:2]
    depth = 3 if kind in (3, 6) else 1
    n = w * h * depth
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1), axis=1)[:, :w]
        return (1 - bits) * np.uint8(255)
    if kind == 1:
        flat = np.array([c - 48 for c in re.sub(rb"#[^\n]*|\s", b"", data[at:])[:n]], np.uint8)
        return ((1 - flat) * np.uint8(255)).reshape(h, w)
    top = head[2]
    if not 0 < top < 256:
        raise ValueError("only 8-bit samples are read")
    flat = np.array(data[at:].split()[:n], np.uint8) if kind < 4 else np.frombuffer(data, np.uint8, n, at + 1)
    return flat.reshape((h, w, 3) if depth == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    start = struct.unpack_from("<I", data, 10)[0]
    size, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only uncompressed 8, 24 and 32-bit BMP are read")
    step = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * step, start).reshape(abs(h), step)
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        n = struct.unpack_from("<I", data, 46)[0] or 256
        colours = np.frombuffer(data, np.uint8, 4 * n, 14 + size).reshape(n, 4)[:, 2::-1]
        return colours[rows[:, :w]]
    return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """Image bytes to a uint8 array, (h, w) or (h, w, 3)."""
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of ``height`` x ``width`` equal areas of a plane, from its integral image."""
    h, w = plane.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(plane, 0, dtype=np.float64), 1, out=total[1:, 1:])

    def at(table: np.ndarray, n: int, parts: int) -> np.ndarray:
        edge = np.arange(parts + 1) * (n / parts)
        low = np.minimum(edge.astype(int), n - 1)
        return table[low] + (table[low + 1] - table[low]) * (edge - low)[:, None]

    corner = at(at(total, h, height).T, w, width).T
    return np.diff(np.diff(corner, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(grey: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 cells is darker than its right neighbour, as 16 hex digits."""
    small = area_resize(grey, 8, 9)
    return np.packbits((small[:, :-1] < small[:, 1:] - 1e-9).ravel()).tobytes().hex()


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels.mean(2) if pixels.ndim == 3 else pixels.astype(float)


def npy_tile(pixels: np.ndarray, height: int = 32, width: int = 32) -> bytes:
    """The area-resized tile as the bytes of an NPY file."""
    planes = [pixels] if pixels.ndim == 2 else [pixels[:, :, k] for k in range(pixels.shape[2])]
    tile = np.stack([area_resize(p, height, width) for p in planes], 2)
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(tile), 0, 255).astype(np.uint8))
    return out.getvalue()


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW)


def media_columns(docs: DataFrame, form: str = "ppm", tile: tuple[int, int] = (32, 32), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media, tile, dhash): each text as an image file (``ppm`` or ``bmp``), its NPY tile and hash."""

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"n_bytes": [], "media": [], "tile": [], "dhash": []}
            for text in b["text"].to_pylist():
                media = encode_text(text, form)
                image = decode(media)
                for k, v in zip(out, (len(text.encode()), media, npy_tile(image, *tile), difference_hash(grey(image))), strict=True):
                    out[k].append(v)
            yield {"id": b["id"]} | out

    rows = docs.select(docs[id_col].alias("id"), plain(text_col).alias("text"))
    return map_batches(rows, f"id {dict(docs.dtypes)[id_col]}, n_bytes long, media binary, tile binary, dhash string", work)


def encode_text(text: str, form: str) -> bytes:
    pixels = np.frombuffer(payload(text), np.uint8).reshape(-1, ROW // 3, 3)
    return encode_ppm(pixels) if form == "ppm" else encode_bmp(pixels)


def media_digests(docs: DataFrame, form: str = "ppm", tile: tuple[int, int] = (8, 8)) -> DataFrame:
    """The digest columns of ``media_columns``: the media bytes stay inside the task that makes them."""

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for text in b["text"].to_pylist():
                media = encode_text(text, form)
                image = decode(media)
                back = image.tobytes()
                feature = difference_hash(grey(image)) + ":" + hashlib.sha256(npy_tile(image, *tile)).hexdigest()[:16]
                row = (len(text.encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            yield {"doc_id": b["doc_id"]} | out

    rows = docs.select("doc_id", plain("text").alias("text"))
    return map_batches(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", work)
