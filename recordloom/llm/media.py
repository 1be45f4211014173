"""Media columns: Netpbm and BMP images as numpy arrays, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import materialize, small_batches, text_bytes

#: Width in samples of the image that stores a text's bytes.
WIDTH = 64
#: Height and width of the tile that stands for an image.
TILE = (32, 32)


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    """A binary greyscale Netpbm image of 8-bit samples; the payload is a positive multiple of the width."""
    if not payload or len(payload) % width:
        raise ValueError("the payload has to be a positive multiple of the width")
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def encode_bmp(payload: bytes, width: int = WIDTH) -> bytes:
    """An uncompressed 8-bit BMP with a grey palette, rows from the bottom up; the payload as for encode_pgm()."""
    if not payload or len(payload) % width or width % 4:
        raise ValueError("the payload has to be a positive multiple of the width, and that of 4")
    height, start = len(payload) // width, 54 + 1024
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    head = b"BM" + struct.pack("<IHHI", start + len(payload), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, len(payload), 0, 0, 256, 0)
    return head + palette.tobytes() + np.frombuffer(payload, np.uint8).reshape(height, width)[::-1].tobytes()


_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """Rows x columns (x 3 for pixmaps) of samples; P1 to P6, 8 or 16 bits."""
    kind, at, fields = data[:2], 2, []
    if kind not in {b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"}:
        raise ValueError("not a Netpbm image")
    bitmap = kind in {b"P1", b"P4"}
    for _ in range(2 if bitmap else 3):
        found = _FIELD.match(data, at)
        if not found:
            raise ValueError("a Netpbm header breaks off")
        fields.append(int(found[1]))
        at = found.end()
    width, height, most = (*fields, 1)[:3]
    channels = 3 if kind in {b"P3", b"P6"} else 1
    n = width * height * channels
    dtype = np.dtype(np.uint8 if most < 256 else ">u2")
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        out = 1 - np.unpackbits(rows, axis=1)[:, :width]
    elif kind in {b"P5", b"P6"}:
        out = np.frombuffer(data, dtype, n, at + 1)
    else:
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        digits = [int(x) for x in (re.findall(rb"[01]", body) if bitmap else body.split())[:n]]
        if len(digits) < n:
            raise ValueError("a Netpbm image breaks off")
        out = np.array(digits, dtype.newbyteorder("="))
        out = 1 - out if bitmap else out
    return out.reshape((height, width, 3) if channels == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Rows x columns x 3 (red, green, blue) of an uncompressed BMP with 8, 24 or 32 bits a pixel; rows x columns if a palette is the 256 greys."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing not in {0, 3} or bits not in {8, 24, 32} or width <= 0:
        raise ValueError("this kind of BMP isn't supported")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, start - 14 - size, 14 + size).reshape(-1, 4)
        if len(palette) == 256 and (palette[:, :3] == np.arange(256)[:, None]).all():
            return rows
        return palette[rows][:, :, 2::-1]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    return image @ np.array([0.299, 0.587, 0.114]) if image.ndim == 3 else image


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area, by an integral image that is read at fractional corners."""
    integral = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=integral[1:, 1:])

    def at(edges: np.ndarray, table: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(int), len(table) - 2)
        part = (edges - low).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] * (1 - part) + table[low + 1] * part

    rows = at(np.linspace(0, image.shape[0], height + 1), integral)
    corners = at(np.linspace(0, image.shape[1], width + 1), rows.T).T
    sums = np.diff(np.diff(corners, axis=0), axis=1)
    return sums / (image.shape[0] / height * (image.shape[1] / width))


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: for 8 x 9 mean cells, a bit for each cell that is darker than its right neighbour."""
    cells = np.rint(area_resize(grey(image), 8, 9) * 256).astype(np.int64)  # float noise must not decide ties
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, image, allow_pickle=False)
    return out.getvalue()


def tile(image: np.ndarray) -> bytes:
    """The image's grey TILE as the bytes of an NPY file of 8-bit samples."""
    return npy(np.clip(np.rint(area_resize(grey(image), *TILE)), 0, 255).astype(np.uint8))


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    return data + bytes(unit - len(data) if not data else -len(data) % unit)


#: Bytes from which on a text is stored as BMP, whose palette takes a kilobyte, instead of PGM.
BMP_FROM = 16 << 10


def encode(payload: bytes) -> bytes:
    """PGM, or BMP for long payloads: the format follows from the payload alone."""
    return encode_bmp(payload) if len(payload) >= BMP_FROM else encode_pgm(payload)


def _store(batches):
    import pyarrow as pa

    for batch in batches:
        texts = text_bytes(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([encode(pad(x)) for x in texts], pa.binary())], names=["id", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's UTF-8 bytes, padded by zero bytes, as an image in a table of the shared folder: id, n_bytes, media.

    Null counts as empty; an empty text makes one row of zeros. A text of any length is one image. Rows are
    independent, so ties, repeated rows and an empty table need no rule. Only the two named columns are read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(_store, "id long, n_bytes long, media binary"), "media", "zstd")


def _features(batches):
    import pyarrow as pa

    for batch in batches:
        kept = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile")}
        for media in batch.column(2).to_pylist():
            image = decode(media)
            payload = image.tobytes()
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), tile(image))
            for column, value in zip(kept.values(), row, strict=True):
                column.append(value)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(kept.values(), types, strict=True))], names=["id", "n_bytes", *kept])


FEATURES = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(stored: DataFrame) -> DataFrame:
    """Decode stored images; one row for each: sizes and digests of payload and media, difference hash, NPY tile."""
    return stored.select("id", "n_bytes", "media").mapInArrow(_features, f"{FEATURES}, tile binary")


def store_tiles(features: DataFrame) -> DataFrame:
    """media_features() written to a table of the shared folder, tiles as NPY files' bytes."""
    return materialize(features, "media-tiles", "zstd")


def _load_tiles(batches):
    import pyarrow as pa

    for batch in batches:
        tiles = [np.load(io.BytesIO(x), allow_pickle=False) for x in batch.column(batch.num_columns - 1).to_pylist()]
        digests = pa.array([hashlib.sha256(t.tobytes()).hexdigest() for t in tiles], pa.string())
        means = pa.array([float(t.mean()) for t in tiles], pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], digests, means], names=[*batch.schema.names[:-1], "tile_sha256", "tile_mean"])


def tile_digests(tiles: DataFrame) -> DataFrame:
    """store_tiles()'s rows with their tiles read back: the samples' SHA-256 and mean in place of the tile."""
    return tiles.mapInArrow(_load_tiles, f"{FEATURES}, tile_sha256 string, tile_mean double")
