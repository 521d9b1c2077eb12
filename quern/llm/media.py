"""Media columns: Netpbm and BMP images in binary columns.

Images are decoded to numpy arrays, resized by area with integral images and
written as NPY tiles with a difference hash. Each image is handled on its own in
an Arrow batch, so there is no shuffle and a task holds one batch at a time.

Defined cases: null bytes are an empty payload; an image that cannot be decoded (damaged,
cut short, without samples, with a header that asks for more than the file holds or
samples over their maximum) gives null tile columns and its error message; repeated rows
give equal rows; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import arrow_map, batch_of, texts_of

SAMPLE_WIDTH = 64
TILE = 16
#: Digits of a number in a Netpbm header or plain sample at most.
HEADER_DIGITS = 9
_SPACE_OR_COMMENT = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*")
_COMMENT = re.compile(rb"#[^\n\r]*")
_DIGITS = re.compile(rb"\d+")


def _netpbm_header(data: bytes, many: int) -> tuple[list[int], int]:
    """The numbers after the magic, and where they end; ValueError unless each has HEADER_DIGITS digits at most."""
    found, at = [], 2
    for _ in range(many):
        at = _SPACE_OR_COMMENT.match(data, at).end()
        digits = _DIGITS.match(data, at)
        if digits is None or len(digits[0]) > HEADER_DIGITS:
            raise ValueError("bad Netpbm header")
        found.append(int(digits[0]))
        at = digits.end()
    return found, at


def _plain_samples(data: bytes, count: int, top: int, single: bool) -> np.ndarray:
    """The samples of a plain Netpbm image as int64: words of digits, or single digits for bitmaps."""
    bare = _COMMENT.sub(b"", data)
    words = list(re.sub(rb"\s", b"", bare)[:count]) if single else bare.split(None, count)[:count]
    if single:
        out = np.array(words, np.int64) - 48
    else:
        if any(len(w) > HEADER_DIGITS or not w.isdigit() for w in words):
            raise ValueError("bad Netpbm sample")
        out = np.array([int(w) for w in words], np.int64)
    if out.size < count:
        raise ValueError("Netpbm image is cut short")
    if out.size and (out.min() < 0 or out.max() > top):
        raise ValueError("Netpbm sample is over its maximum")
    return out


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as a (height, width) or (height, width, 3) array, uint8 up to maxval 255, else uint16. P1 and P4: 1 is black.

    ValueError for a header that asks for no samples or for more than the file can hold (a plain
    sample takes a byte at least), for samples over the maximum and for a file that is cut short.
    """
    if not re.match(rb"P[1-6]\s", data):
        raise ValueError("not a Netpbm image")
    kind = data[1] - 48
    header, at = _netpbm_header(data, 2 if kind in (1, 4) else 3)
    width, height, top = header[0], header[1], header[2] if len(header) > 2 else 1
    if not 0 < top < 65536:
        raise ValueError("bad Netpbm maxval")
    if not width or not height:
        raise ValueError("Netpbm image has no samples")
    channels = 3 if kind in (3, 6) else 1
    count, shape = width * height * channels, (height, width, 3) if channels == 3 else (height, width)
    kind_of = np.dtype(np.uint8) if top < 256 else np.dtype(">u2")
    line = (width + 7) // 8
    if (line * height if kind == 4 else count * (kind_of.itemsize if kind > 4 else 1)) > len(data) - at:
        raise ValueError("Netpbm image is cut short")
    if kind < 4:
        return _plain_samples(data[at:], count, top, kind == 1).astype(kind_of.newbyteorder("=")).reshape(shape)
    if at + 1 > len(data) or not data[at : at + 1].isspace():
        raise ValueError("bad Netpbm header")
    if kind == 4:
        rows = np.frombuffer(data, np.uint8, line * height, at + 1).reshape(height, line)
        return np.unpackbits(rows, axis=1)[:, :width]
    out = np.frombuffer(data, kind_of, count, at + 1).reshape(shape)
    if top not in (255, 65535) and out.max() > top:
        raise ValueError("Netpbm sample is over its maximum")
    return out


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary PGM with maxval 255 of a (height, width) uint8 array."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits as (height, width, 3) RGB; rows run up or down."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if bits not in (8, 24, 32) or packed not in (0, 3) or width <= 0 or not height:
        raise ValueError(f"BMP of {bits} bits, compression {packed}, {width} x {height}: not handled")
    line, rows = (width * bits + 31) // 32 * 4, abs(height)
    if start + line * rows > len(data):
        raise ValueError("BMP image is cut short")
    raw = np.frombuffer(data, np.uint8, line * rows, start).reshape(rows, line)
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        if used > 256 or 14 + head + 4 * used > len(data):
            raise ValueError("bad BMP palette")
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1]
        if raw[:, :width].max() >= used:
            raise ValueError("BMP sample is not in its palette")
        out = palette[raw[:, :width]]
    else:
        out = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    return out if height < 0 else out[::-1]


def encode_bmp(rgb: np.ndarray) -> bytes:
    """A 24-bit BMP, rows bottom first, of a (height, width, 3) uint8 array."""
    height, width = rgb.shape[:2]
    line = (width * 3 + 3) // 4 * 4
    raw = np.zeros((height, line), np.uint8)
    raw[:, : width * 3] = rgb[::-1, :, ::-1].reshape(height, width * 3)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + raw.size, 0, 0, 54, 40, width, height, 1, 24, 0, raw.size, 2835, 2835, 0, 0) + raw.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _integral_at(image: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The integral along axis 0 at fractional edges: only these rows of the integral image are made, in strips."""
    whole = np.floor(edges).astype(np.int64)
    part = (edges - whole).reshape(-1, *[1] * (image.ndim - 1))
    sums = np.zeros((len(edges), *image.shape[1:]))
    for i in range(1, len(edges)):
        sums[i] = sums[i - 1] + image[whole[i - 1] : whole[i]].sum(axis=0, dtype=np.float64)
    return sums + part * image[np.minimum(whole, image.shape[0] - 1)]


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area of the source, from differences of the integral image; works up and down."""
    down = np.diff(_integral_at(image, np.linspace(0, image.shape[0], height + 1)), axis=0)
    both = np.diff(_integral_at(np.swapaxes(down, 0, 1), np.linspace(0, image.shape[1], width + 1)), axis=0)
    return np.swapaxes(both, 0, 1) / (image.shape[0] / height * (image.shape[1] / width))


def gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: is each cell of an 8 x 9 area-resized gray image darker than its right neighbour?"""
    small = np.round(resize_area(gray(image), 8, 9), 6)  # so that equal areas are equal
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    """The image area-resized to side x side, rounded to uint8, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(resize_area(image, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def media_tiles(df: DataFrame, key: str, media: str, side: int = TILE) -> DataFrame:
    """One row an image: key, height, width, channels, dhash, npy (binary), error (null if it was decoded)."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, height int, width int, channels int, dhash string, npy binary, error string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(media).to_pylist():
                try:
                    image = decode(data or b"")
                    rows.append((image.shape[0], image.shape[1], image.shape[2] if image.ndim == 3 else 1, difference_hash(image), npy_tile(image, side), None))
                except (ValueError, IndexError, OverflowError, struct.error) as e:  # the file is at fault, not the job
                    rows.append((None, None, None, None, None, str(e)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[key, "height", "width", "channels", "dhash", "npy", "error"])

    return arrow_map(df.select(key, media), run, schema)


def payload_of(text: str | None, unit: int = SAMPLE_WIDTH) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros appended up to a positive multiple of ``unit``, and the length before."""
    raw = (text or "").encode()
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0"), len(raw)


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each whole text losslessly as a PGM of 64 samples a row, reads it back and digests it.

    Columns: key, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64
    bytes read back), media_bytes, media_sha256, feature (difference hash), tile_sha256
    (of the NPY tile). A null or empty text is 64 zero bytes.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256"]
    fields = pa.schema([(n, pa.string() if "sha256" in n or n == "feature" else pa.int64()) for n in names])

    def row(value: str) -> tuple:
        payload, n = payload_of(value)
        stored = encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, SAMPLE_WIDTH))
        image = decode(stored)
        back = image.tobytes()
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(image), hashlib.sha256(npy_tile(image)).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*map(row, texts_of(batch, text)))) or [()] * len(names)
            yield batch_of(fields, **{key: batch.column(key)}, **dict(zip(names, cols)))

    return arrow_map(df.select(key, text), run, schema)
