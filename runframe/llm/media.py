"""Media columns: Netpbm and BMP images, area resizing by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, table

WIDTH = 64
#: Grid of the difference hash: HASH_ROWS rows of HASH_COLS + 1 cells.
HASH_ROWS, HASH_COLS = 8, 8
TILE = 64


def encode_pgm(samples: bytes, width: int = WIDTH) -> bytes:
    """Binary PGM (P5, 8 bits) of ``samples``, whose length is a positive multiple of ``width``."""
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def encode_bmp(samples: bytes, width: int = WIDTH) -> bytes:
    """Top-down 8-bit grey BMP; ``width`` is a multiple of 4."""
    palette = b"".join(bytes((v, v, v, 0)) for v in range(256))
    start = 14 + 40 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + len(samples), 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, width, -(len(samples) // width), 1, 8, 0, len(samples), 0, 0, 256, 0) + palette + samples


def decode(media: bytes) -> np.ndarray:
    """(height, width[, 3]) uint8 array of a PGM or PPM (P2, P3, P5, P6, maxval up to 255) or of an uncompressed 8- or 24-bit BMP.

    Raises ValueError for anything else: other forms, broken or cut off headers and samples, images without pixels.
    """
    try:
        pixels = _decode_bmp(media) if media[:2] == b"BM" else _decode_netpbm(media)
    except (struct.error, OverflowError, IndexError) as broken:
        raise ValueError("broken image") from broken
    if not pixels.size:
        raise ValueError("no pixels")
    return pixels


def _decode_netpbm(media: bytes) -> np.ndarray:
    if media[:2] not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError("neither Netpbm nor BMP")
    fields, at = [], 2
    while len(fields) < 3:
        while media[at : at + 1].isspace():
            at += 1
        if media[at : at + 1] == b"#":
            at = media.index(b"\n", at)
            continue
        end = at
        while media[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        fields.append(int(media[at:end]))
        at = end
    width, height, top = fields
    if not 0 < top < 256:
        raise ValueError("only 8-bit samples")
    planes = 3 if media[1:2] in b"36" else 1
    n = width * height * planes
    if media[1:2] in b"23":
        pixels = np.array(list(map(int, media[at:].split()[:n])), dtype=np.int64)
        if len(pixels) < n or n and (pixels.min() < 0 or pixels.max() > top):
            raise ValueError("broken samples")
        pixels = pixels.astype(np.uint8)
    else:
        pixels = np.frombuffer(media, np.uint8, n, at + 1)
    return pixels.reshape((height, width, 3) if planes == 3 else (height, width))


def _decode_bmp(media: bytes) -> np.ndarray:
    (start,) = struct.unpack_from("<I", media, 10)
    size, width, height, _, depth, packed, _, _, _, colours, _ = struct.unpack_from("<IiiHHIIiiII", media, 14)
    if packed or depth not in (8, 24) or width <= 0 or not height:
        raise ValueError("only uncompressed 8- and 24-bit BMP")
    stride = (width * depth + 31) // 32 * 4
    rows = np.frombuffer(media, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows if height < 0 else rows[::-1]
    if depth == 24:
        return rows[:, : width * 3].reshape(abs(height), width, 3)[:, :, ::-1]
    palette = np.frombuffer(media, np.uint8, (colours or 256) * 4, 14 + size).reshape(-1, 4)
    grey = (palette[:, 0] == palette[:, 1]) & (palette[:, 1] == palette[:, 2])
    index = rows[:, :width]
    if grey.all():
        return index if np.array_equal(palette[:, 0], np.arange(len(palette))) else palette[:, 0][index]
    return palette[:, 2::-1][index]


def grey(pixels: np.ndarray) -> np.ndarray:
    """Mean of the colour planes, as float64."""
    return pixels.mean(axis=2) if pixels.ndim == 3 else pixels


def area_resize(pixels: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Exact area average on a rows x cols grid: the integral image is read at fractional edges."""
    pixels = grey(pixels)

    def along(a: np.ndarray, cells: int) -> np.ndarray:
        total = np.concatenate([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0, dtype=np.float64)])
        edges = np.arange(cells + 1) * (len(a) / cells)
        low = np.minimum(edges.astype(np.int64), len(a) - 1)
        part = (edges - low)[:, None]
        at = total[low] * (1 - part) + total[low + 1] * part
        return np.diff(at, axis=0) * (cells / len(a))

    return along(along(pixels, rows).T, cols).T


def difference_hash(pixels: np.ndarray) -> str:
    """Hex of HASH_ROWS x HASH_COLS bits: whether each cell of the small grid is darker than its right neighbour."""
    small = area_resize(pixels, HASH_ROWS, HASH_COLS + 1)
    return np.packbits(np.diff(small, axis=1) > 1e-9).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = TILE) -> bytes:
    """The image resized to side x side, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(pixels, side, side)).astype(np.uint8))
    return out.getvalue()


def encode_texts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), form: str = "pgm") -> DataFrame:
    """``keep``, n_bytes and media: each whole text (null: empty) as UTF-8, filled with bytes 0 up to a positive multiple of 64.

    One output row for each input row. ``form`` is ``pgm`` or ``bmp``.
    """
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[form]
    kept = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_bytes"))

    def pack(batches):
        for batch in batches:
            raw = batch.column("_bytes").to_pylist()
            media = [encode(x.ljust(max(WIDTH, -(-len(x) // WIDTH) * WIDTH), b"\0")) for x in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], [*batch.schema.names[:-1], "n_bytes", "media"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return map_batches(kept, pack, f"{schema}, n_bytes long, media binary")


def media_features(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",), payload: bool = True, tiles: bool = True) -> DataFrame:
    """``keep``, payload (the decoded samples), tile (an NPY file) and feature (the difference hash).

    Null media or media in no known form gives null in all three.
    """
    kept = media.select(*keep, F.col(media_col).alias("_media"))

    def read(batches):
        for batch in batches:
            samples, small, hashes = [], [], []
            for raw in batch.column("_media").to_pylist():
                try:
                    pixels = decode(raw or b"")
                except ValueError:
                    pixels = None
                samples.append(pixels.tobytes() if pixels is not None and payload else None)
                small.append(npy_tile(pixels) if pixels is not None and tiles else None)
                hashes.append(difference_hash(pixels) if pixels is not None else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(samples, pa.binary()), pa.array(small, pa.binary()), pa.array(hashes, pa.string())], [*batch.schema.names[:-1], "payload", "tile", "feature"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return map_batches(kept, read, f"{schema}, payload binary, tile binary, feature string")


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    """All documents stored as PGM images, read back, with digests of both forms and of the NPY tile."""
    stored = encode_texts(table(spark, sf_dir, "documents"))
    stored = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    back = media_features(stored, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    size = F.octet_length("payload")
    return back.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -WIDTH, WIDTH)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        F.octet_length("tile").cast("long").alias("tile_bytes"),
        F.sha2("tile", 256).alias("tile_sha256"),
    )
