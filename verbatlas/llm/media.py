"""Media columns: Netpbm and BMP images as numpy arrays, area-resized by integral images, cut into NPY tiles.

decode() reads P1 to P6 and uncompressed BMP of 8, 24 or 32 bits; encode_netpbm() and encode_bmp() write
them without loss. area_resize() takes box averages from an integral image, exact at fractional edges.
npy_tiles() gives NPY bytes of fixed tiles, difference_hash() 128 bits of brightness steps. The query stores every
text as an image and every image's tiles with their hashes, and reports on both from what it reads back.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.llm import common

UNIT = 192  # bytes of one 8 x 8 RGB square
TILE = 32
DEEPEST = 255
LEVEL = 9  # of zstd; images and tiles hold the texts twice over


def encode_netpbm(image: np.ndarray) -> bytes:
    """Binary P5 (two axes) or P6 (three axes, RGB) of 8-bit samples."""
    kind = b"P6" if image.ndim == 3 else b"P5"
    return b"%s\n%d %d\n%d\n" % (kind, image.shape[1], image.shape[0], DEEPEST) + np.ascontiguousarray(image, np.uint8).tobytes()


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """count numbers after the magic, comments skipped, and the offset behind the one white space that ends them."""
    at, numbers = 2, []
    while len(numbers) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                while at < len(data) and data[at] != 10:
                    at += 1
            at += 1
        start = at
        while at < len(data) and data[at : at + 1].isdigit():
            at += 1
        if start == at:
            raise ValueError("broken Netpbm header")
        numbers.append(int(data[start:at]))
    return numbers, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8: two axes for bitmaps and grey, three for colour. Samples of two bytes are scaled to 8 bits."""
    kind = data[:2]
    if kind in (b"P1", b"P4"):
        (w, h), at = _header(data, 2)
        if kind == b"P1":
            bits = np.frombuffer(bytes(c for c in data[at - 1 :] if c in b"01"), np.uint8)[: w * h] - 48
        else:
            row = (w + 7) // 8
            bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at).reshape(h, row), axis=1)[:, :w]
        return np.where(bits.reshape(h, w), 0, 255).astype(np.uint8)
    if kind not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    (w, h, top), at = _header(data, 3)
    shape = (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    n = int(np.prod(shape))
    if kind in (b"P2", b"P3"):
        samples = np.array(data[at - 1 :].split()[:n], np.int64)
    else:
        samples = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at)
    if samples.size != n:
        raise ValueError("Netpbm data ends early")
    if top != 255:
        samples = (samples.astype(np.int64) * 255 + top // 2) // top
    return samples.astype(np.uint8).reshape(shape)


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit BMP, bottom row first, rows padded to four bytes; grey images are written as equal channels."""
    rgb = image if image.ndim == 3 else np.repeat(image[:, :, None], 3, axis=2)
    h, w = rgb.shape[:2]
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, w * 3)
    body = rows.tobytes()
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def decode_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    start, size, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, compression {packed}")
    row = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)[:, 2::-1]
        return palette[rows]
    return np.ascontiguousarray(rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _at(total: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Rows of an integral image at fractional positions."""
    low = np.minimum(cuts.astype(np.int64), total.shape[0] - 2)
    return total[low] + (cuts - low)[:, None] * (total[low + 1] - total[low])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Box averages of a grey image (float64)."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1)
    rows = _at(total, np.linspace(0, h, height + 1))
    boxes = _at(np.ascontiguousarray(rows.T), np.linspace(0, w, width + 1)).T
    return np.diff(np.diff(boxes, axis=0), axis=1) * (height * width / (h * w))


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([299, 587, 114]) // 1000


def difference_hash(image: np.ndarray) -> str:
    """64 bits of steps to the right and 64 of steps downwards, as 32 hex digits."""
    plane = grey(image)
    small = np.round(area_resize(plane, 9, 9), 6)
    bits = np.concatenate([(small[:8, 1:] > small[:8, :-1]).ravel(), (small[1:, :8] > small[:-1, :8]).ravel()])
    return np.packbits(bits).tobytes().hex()


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def npy_tiles(image: np.ndarray, tile: int = TILE) -> Iterator[tuple[int, int, bytes]]:
    """(row, column, NPY bytes) of each tile; those at the right and bottom edge may be smaller."""
    for y in range(0, image.shape[0], tile):
        for x in range(0, image.shape[1], tile):
            yield y // tile, x // tile, npy_bytes(image[y : y + tile, x : x + tile])


def thumbnail(image: np.ndarray, side: int = TILE) -> np.ndarray:
    return np.clip(np.rint(area_resize(grey(image), side, side)), 0, 255).astype(np.uint8)


def text_image(payload: bytes) -> np.ndarray:
    """Bytes, a positive multiple of 192, as RGB squares of 8 x 8 below each other."""
    return np.frombuffer(payload, np.uint8).reshape(-1, 8, 3)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "text"):
        media, sizes = [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            sizes.append(len(text))
            media.append(encode_netpbm(text_image(text + b" " * (-len(text) % UNIT if text else UNIT))))
        yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), batch.column("image")], ["doc_id", "n_bytes", "media", "image"])


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, image): every whole text as a P6 image in a table of the shared folder.

    image numbers the rows of the stored table, as doc_ids may be repeated or null.
    Null texts are empty; an empty text is one square of spaces. Rows are kept as they are, repeated and
    null ids too; an empty table gives an empty table; other columns are ignored.
    """
    common.ship(docs.sparkSession)
    numbered = common.id_and_text(docs).withColumn("image", F.monotonically_increasing_id())
    media = numbered.mapInArrow(_store, "doc_id bigint, n_bytes bigint, media binary, image bigint")
    return common.stored(media, "media", level=LEVEL)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "media"):
        out: list[tuple] = []
        for media in batch.column("media").to_pylist():
            image = decode(media)
            payload = image.tobytes()
            tile = npy_bytes(thumbnail(image))
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), zlib.crc32(tile)))
        cols = list(zip(*out))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *map(pa.array, cols, kinds), batch.column("image")], [*NAMES, "image"])


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "thumbnail_crc32"]


def _numbered_features(media: DataFrame) -> DataFrame:
    common.ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media", "image").mapInArrow(_features, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, thumbnail_crc32 bigint, image bigint")


def media_features(media: DataFrame) -> DataFrame:
    """One row for each stored image, from its bytes alone: digests, difference hash, crc32 of its NPY thumbnail."""
    return _numbered_features(media).drop("image")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "media"):
        ids, rows, cols, tiles, hashes, numbers = [], [], [], [], [], []
        for i, media, number in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "media", "image"))):
            image = decode(media)
            for y, x, data in npy_tiles(image):
                ids.append(i)
                numbers.append(number)
                rows.append(y)
                cols.append(x)
                tiles.append(data)
                hashes.append(difference_hash(image[y * TILE : (y + 1) * TILE, x * TILE : (x + 1) * TILE]))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(hashes, pa.string()), pa.array(tiles, pa.binary()), pa.array(numbers, pa.int64())], ["doc_id", "tile_row", "tile_column", "hash", "npy", "image"])


def media_tiles(media: DataFrame) -> DataFrame:
    """(doc_id, tile_row, tile_column, hash, npy, image): every image cut into NPY tiles with their difference hashes."""
    common.ship(media.sparkSession)
    return media.select("doc_id", "media", "image").mapInArrow(_tiles, "doc_id bigint, tile_row int, tile_column int, hash string, npy binary, image bigint")


def tile_digests(tiles: DataFrame) -> DataFrame:
    """(image, n_tiles, tiles_digest): the exclusive or of the SHA-256 of each tile, 64 hex digits.

    A tile's SHA-256 is over "row,column,hash," and its NPY bytes. Its place is part of it, so tiles that are
    equal don't cancel out and tiles in other places show; and machines sum up before they exchange.
    """
    place = F.concat_ws(",", "tile_row", "tile_column", "hash", F.lit(""))
    shas = tiles.select("image", F.sha2(F.concat(place.cast("binary"), "npy"), 256).alias("sha"))
    words = [F.bit_xor(F.conv(F.substring("sha", 8 * k + 1, 8), 16, 10).cast("bigint")).alias(f"w{k}") for k in range(8)]
    found = shas.groupBy("image").agg(F.count("*").alias("n_tiles"), *words)
    return found.select("image", "n_tiles", F.lower(F.concat(*(F.lpad(F.hex(f"w{k}"), 8, "0") for k in range(8)))).alias("tiles_digest"))


def media_report(docs: DataFrame) -> DataFrame:
    """media_features() of every row's stored image, with n_tiles and tiles_digest of its stored tiles."""
    media = store_texts(docs)
    tiles = common.stored(media_tiles(media), "tiles", level=LEVEL)
    return _numbered_features(media).join(tile_digests(tiles), "image", "left").drop("image")


def query(spark, sf_dir: str) -> DataFrame:
    return media_report(common.read(spark, sf_dir, "documents"))
