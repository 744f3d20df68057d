"""Media columns: Netpbm and BMP to arrays, area resizing by integral images, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventloom.llm.common import rows_as

TILE, CHANNELS = 8, 3
UNIT = TILE * TILE * CHANNELS


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of a Netpbm (P1 to P6) or uncompressed 8 or 24 bit BMP; uint8, or uint16 where the maximum is over 255."""
    if data[:2] == b"BM":
        return _bmp(data)
    if len(data) < 2 or data[:1] != b"P" or data[1:2] not in b"123456":
        raise ValueError("neither Netpbm nor BMP")
    kind, fields, at = int(data[1:2]), [], 2
    while len(fields) < (2 if kind in (1, 4) else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    w, h, most = (*fields, 1)[:3]
    depth = 3 if kind in (3, 6) else 1
    if kind == 1:
        flat = np.frombuffer(re.sub(rb"#[^\n]*\n|\s", b"", data[at:]), np.uint8)[: w * h] - ord("0")
    elif kind in (2, 3):
        flat = np.array(re.sub(rb"#[^\n]*\n", b" ", data[at:]).split()[: w * h * depth], np.uint16)
    elif kind == 4:
        flat = np.unpackbits(np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1), axis=1)[:, :w]
    else:
        flat = np.frombuffer(data, ">u2" if most > 255 else np.uint8, w * h * depth, at + 1)
    if kind in (1, 4):
        flat = (1 - flat) * 255
    return flat.reshape(h, w, depth).astype(np.uint16 if most > 255 else np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    le = lambda at, n: int.from_bytes(data[at : at + n], "little", signed=n == 4)
    start, head, w, h, bits, packed = le(10, 4), le(14, 4), le(18, 4), le(22, 4), le(28, 2), le(30, 4)
    if bits not in (8, 24) or packed:
        raise ValueError("only uncompressed BMP of 8 or 24 bits")
    row = (w * bits // 8 + 3) // 4 * 4
    pixels = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * bits // 8]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, (le(46, 4) or 256) * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        pixels = palette[pixels]
    else:
        pixels = pixels.reshape(abs(h), w, 3)[:, :, ::-1]
    return np.ascontiguousarray(pixels[::-1] if h > 0 else pixels)


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target pixel's area, fractions of pixels included, from one integral image."""
    h, w = pixels.shape[:2]
    total = np.zeros((h + 1, w + 1, pixels.shape[2]))
    total[1:, 1:] = pixels.cumsum(0, dtype=np.float64).cumsum(1)

    def at(line: np.ndarray, n: int, to: int, axis: int) -> np.ndarray:
        edge = np.arange(to + 1) * n / to
        low = np.minimum(edge.astype(int), n - 1)
        part = (edge - low).reshape([-1 if k == axis else 1 for k in range(3)])
        return line.take(low, axis) * (1 - part) + line.take(low + 1, axis) * part

    cut = at(at(total, h, height, 0), w, width, 1)
    return np.diff(np.diff(cut, axis=0), axis=1) / (h / height * w / width)


def difference_hash(pixels: np.ndarray) -> str:
    """16 hexadecimal digits: whether each of 8 x 8 areas is brighter than the one to its right."""
    grey = resize(pixels, 8, 9).mean(axis=2)
    return np.packbits((grey[:, :-1] > grey[:, 1:]).ravel()).tobytes().hex()


def to_npy(pixels: np.ndarray) -> bytes:
    """One NPY file: a stack of 8 x 8 tiles (tiles, 8, 8, channels), row by row; edges are padded with zeros."""
    h, w, c = pixels.shape
    full = np.zeros((-(-h // TILE) * TILE, -(-w // TILE) * TILE, c), pixels.dtype)
    full[:h, :w] = pixels
    tiles = full.reshape(full.shape[0] // TILE, TILE, full.shape[1] // TILE, TILE, c).swapaxes(1, 2).reshape(-1, TILE, TILE, c)
    out = io.BytesIO()
    np.save(out, tiles, allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    """The tiles of an NPY file."""
    return np.load(io.BytesIO(data), allow_pickle=False)


def payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the text as UTF-8, padded with spaces to a positive multiple of 192."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(-(-len(raw) // UNIT), 1) * UNIT)


def tiles(images: DataFrame, id_col: str = "doc_id", data_col: str = "image") -> DataFrame:
    """(doc_id, media): each Netpbm or BMP file decoded and stored as NPY tiles; a null or broken file gives null."""

    def one(data):
        try:
            return None if data is None else to_npy(decode(data))
        except (ValueError, IndexError, OverflowError, MemoryError):
            return None

    def batches(rows):
        for b in rows:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(x.as_py()) for x in b.column(1)], pa.binary())], ["doc_id", "media"])

    return rows_as(images, doc_id=id_col, image=data_col).mapInArrow(batches, f"doc_id {dict(images.dtypes)[id_col]}, media binary")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a PPM picture 8 pixels wide, decoded and stored as NPY tiles.

    A null text counts as empty: one tile of spaces. Equal texts give equal bytes; repeated rows stay; extra
    columns are ignored; an empty table gives an empty result.
    """

    def batches(rows):
        for b in rows:
            ids, sizes, media = b.column(0), [], []
            for t in b.column(1):
                n, data = payload(t.as_py())
                picture = b"P6 %d %d 255\n" % (TILE, len(data) // (TILE * CHANNELS)) + data
                sizes.append(n)
                media.append(to_npy(decode(picture)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kept = rows_as(docs, doc_id=id_col, text=text_col)
    return kept.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(batches, "doc_id long, n_bytes long, media binary")


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(media: DataFrame) -> DataFrame:
    """What the stored bytes say when read back: the payload's size and digests, the media's, and the difference hash. A null media has nulls."""

    def batches(rows):
        for b in rows:
            out = []
            for i, n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                m = m.as_py()
                if m is None:
                    out.append((i, n, *[None] * 6))
                    continue
                back = from_npy(m)
                data = back.tobytes()
                picture = back.reshape(-1, TILE, back.shape[3])
                out.append((i, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), hashlib.sha256(m).hexdigest(), difference_hash(picture)))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            kinds = [pa.string() if " string" in c else pa.int64() for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 8, kinds)], names)

    return media.mapInArrow(batches, SCHEMA)
