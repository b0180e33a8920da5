"""Media columns: Netpbm and BMP images to numpy arrays, area-resized tiles as NPY, and difference hashes.

Images are arrays of height x width x channels, 8 or 16 bits a sample. Resizing averages each target pixel's area
through an integral image, exact also where pixels are cut. The difference hash has a bit for each pair of neighbours
of a 9 x 8 grey tile.

Defined cases: bytes that are no image of a known format, or are cut short, decode to None, and their tile and hash
are null. Null content is such a case, and so are BMP of 1, 4 or 16 bits, run lengths, bit fields and the 12-byte header, which aren't read. As payload, a
null or empty text is one row of blanks. Very long texts are one image, integrated strip by strip. Repeated rows get equal values, a null doc_id stays
null, an empty table gives no rows. Ties of neighbours give a 0 bit. ``text_media`` ignores columns other than doc_id and text, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, blobs, by_size, doc_rows

ROW_BYTES = 192  # 64 pixels of 3 samples
_HEADER = re.compile(rb"(?:\s*#[^\n]*\n)*\s*(\d+)")


def encode_netpbm(image: np.ndarray) -> bytes:
    height, width, channels = image.shape
    depth, kind = (65535, ">u2") if image.dtype.itemsize == 2 else (255, "u1")
    return b"P%d\n%d %d\n%d\n" % (6 if channels == 3 else 5, width, height, depth) + image.astype(kind).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """24 bits a pixel, rows from the bottom up, each padded to 4 bytes."""
    height, width, _ = image.shape
    pad = -3 * width % 4
    rows = np.zeros((height, 3 * width + pad), np.uint8)
    rows[:, : 3 * width] = image[::-1, :, ::-1].reshape(height, 3 * width)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray | None:
    kind, at, numbers = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _HEADER.match(data, at)
        if not m:
            return None
        numbers.append(int(m[1]))
        at = m.end()
    width, height, depth = *numbers[:2], numbers[2] if len(numbers) > 2 else 1
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if not n or not 0 < depth < 65536:
        return None
    if kind == 1:
        found = np.frombuffer(re.sub(rb"[^01]", b"", data[at:]), np.uint8)[:n]
        return None if len(found) < n else ((49 - found) * 255).astype(np.uint8).reshape(height, width, 1)
    if kind in (2, 3):
        found = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], dtype=np.int64)
    elif kind == 4:
        stride = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=at + 1)[: stride * height]
        if len(raw) < stride * height:
            return None
        return ((1 - np.unpackbits(raw.reshape(height, stride), axis=1)[:, :width]) * 255).astype(np.uint8).reshape(height, width, 1)
    else:
        size = n * (2 if depth > 255 else 1)
        if len(data) - at - 1 < size:
            return None
        found = np.frombuffer(data, ">u2" if depth > 255 else np.uint8, n, at + 1)
    if len(found) < n:
        return None
    return found.astype(np.uint16 if depth > 255 else np.uint8).reshape(height, width, channels)


def _bmp(data: bytes) -> np.ndarray | None:
    if len(data) < 54:
        return None
    offset, head, width, height, _, bits, packed = struct.unpack_from("<I I i i H H I", data, 10)
    top_down, height = height < 0, abs(height)
    stride = (width * bits + 31) // 32 * 4
    if packed or bits not in (8, 24, 32) or width <= 0 or not height or len(data) < offset + stride * height:
        return None
    rows = np.frombuffer(data, np.uint8, stride * height, offset).reshape(height, stride)
    rows = rows if top_down else rows[::-1]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        if len(data) < 14 + head + 4 * used:
            return None
        palette = np.zeros((256, 3), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(-1, 4)[:, 2::-1]
        return palette[rows[:, :width]]
    return rows[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1]


def decode(data: bytes | None) -> np.ndarray | None:
    """The image as height x width x channels; None if it can't be read."""
    if not data or len(data) < 8:
        return None
    try:
        if data[:1] == b"P" and data[1:2] in b"123456" and data[2:3].isspace():
            return _netpbm(data)
        return _bmp(data) if data[:2] == b"BM" else None
    except (ValueError, struct.error):
        return None


#: Rows of an image that are summed at a time.
STRIP = 4096


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target pixel's area, by integral images; float64. Tall images are integrated strip by strip, so memory doesn't depend on their height."""

    def at(edges: np.ndarray, table: np.ndarray) -> np.ndarray:  # along the first axis, linear between pixels
        low = np.minimum(edges.astype(np.int64), len(table) - 2)
        part = (edges - low).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] * (1 - part) + table[low + 1] * part

    tall = image.shape[0]
    edges = np.arange(height + 1) * (tall / height)
    upto = np.zeros((height + 1, *image.shape[1:]))
    above = np.zeros((1, *image.shape[1:]))
    for start in range(0, tall, STRIP):
        end = min(start + STRIP, tall)
        table = np.concatenate((above, above + np.cumsum(image[start:end], axis=0, dtype=np.float64)))
        here = (edges >= start) & ((edges < end) | (end == tall))
        upto[here] = at(edges[here] - start, table)
        above = table[-1:]
    rows = np.diff(upto, axis=0)
    total = np.zeros((rows.shape[1] + 1, rows.shape[0], rows.shape[2]))
    np.cumsum(rows.swapaxes(0, 1), axis=0, out=total[1:])
    cells = np.diff(at(np.arange(width + 1) * (image.shape[1] / width), total), axis=0).swapaxes(0, 1)
    return cells / (tall / height * (image.shape[1] / width))


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.shape[2] == 1 else (image[:, :, :3] @ np.array([0.299, 0.587, 0.114]))[:, :, None]


def difference_hash(image: np.ndarray) -> int:
    tile = np.round(grey(area_resize(image, 8, 9))[:, :, 0], 6)
    return int.from_bytes(np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes(), "big")


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def tile(image: np.ndarray, side: int) -> np.ndarray:
    top = 65535 if image.dtype.itemsize == 2 else 255
    return np.clip(np.round(area_resize(image, side, side)), 0, top).astype(image.dtype)


def tiles(images: DataFrame, content: str = "content", side: int = 16) -> DataFrame:
    """All columns but the content, and height, width, channels, tile (NPY bytes) and dhash (16 hex digits).

    Works on what ``spark.read.format("binaryFile")`` gives; write the result as any table.
    """
    rest = [f for f in images.schema.fields if f.name != content]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "height int, width int, channels int, tile binary, dhash string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, b.schema.names.index(content), 16 << 20):
                rows = []
                for data in blobs(part.column(content)):
                    image = decode(data)
                    rows.append((None,) * 5 if image is None else (*image.shape, npy(tile(image, side)), f"{difference_hash(image):016x}"))
                more = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                kept = [part.column(f.name) for f in rest]
                yield pa.RecordBatch.from_arrays([*kept, *more], names=[*(f.name for f in rest), "height", "width", "channels", "tile", "dhash"])

    return images.select(*[F.col(f"`{f.name}`") for f in rest], F.col(f"`{content}`")).mapInArrow(run, ddl)


def text_image(body: bytes) -> tuple[np.ndarray, str]:
    """The padded text as rows of 64 pixels, and the format that it's stored in: by the parity of its length."""
    payload = body + b" " * (-len(body) % ROW_BYTES or (0 if body else ROW_BYTES))
    return np.frombuffer(payload, np.uint8).reshape(-1, 64, 3), "bmp" if len(body) % 2 else "ppm"


def text_media(docs: DataFrame, keep_media: bool = True, side: int = 16) -> DataFrame:
    """Every whole text stored as an image, read back, and its features.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, format, and with
    ``keep_media`` also media and tile (NPY). payload_* come from the decoded image.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("format", pa.string())]
    fields += [("media", pa.binary()), ("tile", pa.binary())] if keep_media else []
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, format string" + ", media binary, tile binary" * keep_media
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, 1, 4 << 20):
                rows = []
                for doc_id, body in zip(part.column(0).to_pylist(), blobs(part.column(1))):
                    image, kind = text_image(body)
                    media = encode_bmp(image) if kind == "bmp" else encode_netpbm(image)
                    image = decode(media)
                    payload, small = image.tobytes(), npy(tile(image, side))
                    feature = f"{difference_hash(image):016x}:{hashlib.md5(small).hexdigest()}"
                    row = (doc_id, len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, kind)
                    rows.append(row + (media, small) if keep_media else row)
                yield batch(schema, *zip(*rows))

    return doc_rows(docs).mapInArrow(run, ddl)
