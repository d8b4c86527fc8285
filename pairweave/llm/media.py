"""Media columns: Netpbm and BMP bytes as numpy arrays, NPY tiles and difference hashes.

``decode`` reads PBM, PGM, PPM (plain and raw, 8 and 16 bits) and PAM, and BMP
of 1, 4, 8, 24 or 32 bits without compression or with RLE8 or RLE4 (of at most
128 pixels a byte; an image that claims more is not read).  ``resize``
is an exact area average: the integral image is taken at the (fractional) tile
borders, with integers, over blocks of at most ``_BLOCK`` samples, so memory does
not follow the size.  ``difference_hash`` compares neighbours of a 9 x 8 grey tile.

``media_columns`` gives for each row: width, height, channels, tile (NPY bytes)
and dhash.  Null media, or bytes that are no such image, give nulls there and
the reason in ``error``; an image of no pixels is such an error.  Rows are
independent, so ties and repeated rows need no rule; other columns are not read.
"""

from __future__ import annotations

import io
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import ids_and_bytes, map_batches, texts

PAYLOAD_WIDTH = 64
TILE = 32
_BLOCK = 1 << 19
#: The most pixels that a byte of run lengths stands for: 255 in two bytes.
_EXPANSION = 128
_HEADER = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def _numbers(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    out = []
    for _ in range(n):
        m = _HEADER.match(data, at)
        if not m:
            raise ValueError("short Netpbm header")
        out.append(int(m[1]))
        at = m.end()
    return out, at


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[:2]
    if kind == b"P7":
        end = data.index(b"ENDHDR\n") + 7
        head = dict(x.split(None, 1) for x in data[3:end].decode("ascii", "replace").splitlines() if " " in x and x[0] != "#")
        w, h, depth, top = (int(head[k]) for k in ("WIDTH", "HEIGHT", "DEPTH", "MAXVAL"))
        at, plain = end, False
    else:
        plain, depth = kind in (b"P1", b"P2", b"P3"), 3 if kind in (b"P3", b"P6") else 1
        if kind in (b"P1", b"P4"):
            (w, h), at = _numbers(data, 2, 2)
            top = 1
        else:
            (w, h, top), at = _numbers(data, 2, 3)
        at += not plain
    n = w * h * depth
    if not 0 < top < 65536 or n <= 0:
        raise ValueError("no pixels, or a wrong maximum")
    if kind == b"P1":
        bits = re.sub(rb"#[^\n]*|\s", b"", data[at:])
        x = 1 - (np.frombuffer(bits[:n], np.uint8) - 48)
        return (x.reshape(h, w, 1) * 255).astype(np.uint8)
    if kind == b"P4":
        row = (w + 7) // 8
        x = np.frombuffer(data, np.uint8, row * h, at).reshape(h, row)
        return ((1 - np.unpackbits(x, axis=1)[:, :w]) * 255).astype(np.uint8)[..., None]
    if plain:
        x = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], np.int64)
    else:
        x = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at)
    x = x.reshape(h, w, depth)
    if top == 255:
        return x.astype(np.uint8)
    return ((x.astype(np.int64) * 255 + top // 2) // top).astype(np.uint8)


def _run_lengths(data: bytes, at: int, w: int, h: int, bits: int) -> np.ndarray:
    if w * h > _EXPANSION * len(data):
        raise ValueError("more pixels than the data can hold")
    out = np.zeros((h, w), np.uint8)
    x = y = 0
    while at + 1 < len(data) and y < h:
        n, v = data[at], data[at + 1]
        at += 2
        if n:
            pair = (v, v) if bits == 8 else (v >> 4, v & 15)
            for i in range(min(n, w - x)):
                out[y, x + i] = pair[i % 2]
            x += n
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            break
        elif v == 2:
            x, y, at = x + data[at], y + data[at + 1], at + 2
        else:
            size = v if bits == 8 else (v + 1) // 2
            part = data[at : at + size]
            vals = part if bits == 8 else bytes(z for b in part for z in (b >> 4, b & 15))
            k = min(v, max(0, w - x))
            out[y, x : x + k] = np.frombuffer(vals[:k], np.uint8)
            x, at = x + v, at + size + size % 2
    return out


def _bmp(data: bytes) -> np.ndarray:
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if size == 12:
        w, h, _, bits = struct.unpack_from("<HHHH", data, 18)
        how, used, entry = 0, 0, 3
    else:
        w, h, _, bits, how, _, _, _, used = struct.unpack_from("<iiHHIIiiI", data, 18)
        entry = 4
    down, h = h < 0, abs(h)
    if w <= 0 or h == 0:
        raise ValueError("no pixels")
    if how in (1, 2):
        x = _run_lengths(data, start, w, h, 8 if how == 1 else 4)
    elif how not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, compression {how}")
    else:
        row = (w * bits + 31) // 32 * 4
        x = np.frombuffer(data, np.uint8, row * h, start).reshape(h, row)
        if bits >= 24:
            x = x[:, : w * (bits // 8)].reshape(h, w, bits // 8)[..., 2::-1]
            return x if down else x[::-1]
        if bits == 1:
            x = np.unpackbits(x, axis=1)
        elif bits == 4:
            x = np.stack([x >> 4, x & 15], -1).reshape(h, -1)
        x = x[:, :w]
    n = used or 1 << bits
    palette = np.zeros((256, 3), np.uint8)
    own = np.frombuffer(data, np.uint8, min(n, 256) * entry, 14 + size).reshape(-1, entry)[:, 2::-1]
    palette[: len(own)] = own
    x = palette[x]
    return x if down else x[::-1]


def decode(data: bytes) -> np.ndarray:
    """Samples as uint8 (height, width, channels); ValueError for anything else than an image of these formats."""
    try:
        if data[:2] == b"BM":
            return _bmp(data)
        if data[:1] == b"P" and data[1:2] in b"1234567" and len(data) > 2:
            return _netpbm(data)
    except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error) as e:
        raise ValueError(f"not readable: {e}") from e
    raise ValueError("neither Netpbm nor BMP")


def pgm(samples: np.ndarray) -> bytes:
    """A raw grey Netpbm image of uint8 (height, width)."""
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + samples.tobytes()


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area averages, rounded half up, uint8 (height, width, channels)."""
    h, w, depth = image.shape
    across = np.zeros((height, width, depth), np.int64)
    columns = max(1, min(w, _BLOCK // (depth * max(height, 64))))
    rows = max(1, _BLOCK // (depth * columns))
    # rows are weighted by their overlap with each tile row, in units of 1 / height, and columns so
    top, left = np.arange(height + 1) * h, np.arange(width + 1) * w
    for y in range(0, h, rows):
        for x in range(0, w, columns):
            block = image[y : y + rows, x : x + columns].astype(np.int64)
            n, m = block.shape[:2]
            down = np.zeros((n + 1, m, depth), np.int64)
            np.cumsum(block, 0, out=down[1:])
            a = np.clip(top - y * height, 0, n * height)
            k, f = a // height, a % height
            sums = np.diff(down[k] * height + f[:, None, None] * block[np.minimum(k, n - 1)], axis=0)
            integral = np.zeros((height, m + 1, depth), np.int64)
            np.cumsum(sums, 1, out=integral[:, 1:])
            a = np.clip(left - x * width, 0, m * width)
            k, f = a // width, a % width
            across += np.diff(integral[:, k] * width + f[:, None] * sums[:, np.minimum(k, m - 1)], axis=1)
    area = h * w
    return ((2 * across + area) // (2 * area)).astype(np.uint8)


def grey(image: np.ndarray) -> np.ndarray:
    """One channel: Rec. 601 weights of red, green and blue in thousandths, or the first channel."""
    if image.shape[2] < 3:
        return image[..., :1]
    return ((image[..., :3].astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000).astype(np.uint8)[..., None]


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether each sample of a 9 x 8 grey tile is below its right neighbour."""
    tile = resize(grey(image), 8, 9)[..., 0]
    return np.packbits(tile[:, :-1] < tile[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array))
    return out.getvalue()


def payload(text: bytes, width: int = PAYLOAD_WIDTH) -> np.ndarray:
    """The text's bytes, then 0 up to a positive multiple of ``width``, as rows of samples."""
    size = max(width, -(-len(text) // width) * width)
    return np.frombuffer(text.ljust(size, b"\0"), np.uint8).reshape(-1, width)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text as a losslessly stored grey image: doc_id, n_bytes, media.  Null counts as empty."""

    def each(batch: pa.RecordBatch) -> dict:
        raw = texts(batch.column(1))
        return {"doc_id": batch.column(0), "n_bytes": pa.array(map(len, raw), pa.int64()), "media": pa.array([pgm(payload(x)) for x in raw], pa.binary())}

    return map_batches(ids_and_bytes(df, id_col, text_col), each, "doc_id long, n_bytes long, media binary")


def media_columns(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = (), tile: int = TILE, samples: bool = False) -> DataFrame:
    """Decode, resize and hash a binary column; ``samples`` adds the decoded samples in row order."""
    kept = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]

    def each(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("width", "height", "channels", "tile", "dhash", "error", *["samples"] * samples)}
        for x in batch.column(len(keep)):
            try:
                image = decode(x.as_py() or b"")
                row = (image.shape[1], image.shape[0], image.shape[2], npy(resize(image, tile, tile)), difference_hash(image), None, *[image.tobytes()] * samples)
            except ValueError as e:
                row = (None, None, None, None, None, str(e), *[None] * samples)
            for values, v in zip(out.values(), row):
                values.append(v)
        kinds = {"width": pa.int64(), "height": pa.int64(), "channels": pa.int64(), "tile": pa.binary(), "dhash": pa.string(), "error": pa.string(), "samples": pa.binary()}
        return {c: batch.column(i) for i, c in enumerate(keep)} | {k: pa.array(v, kinds[k]) for k, v in out.items()}

    schema = ", ".join([*kept, "width long, height long, channels long, tile binary, dhash string, error string", *["samples binary"] * samples])
    return map_batches(df.select(*keep, F.col(media_col)), each, schema)


def text_media(df: DataFrame) -> DataFrame:
    """Digest columns of the stored texts, from the stored bytes as they are read back."""
    both = media_columns(store_texts(df), "media", ("doc_id", "n_bytes", "media"), samples=True)
    size = F.length("samples")
    return both.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", size - 63, F.lit(64))).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("dhash").alias("feature"),
        "width",
        "height",
        F.length("tile").cast("long").alias("tile_bytes"),
        F.sha2("tile", 256).alias("tile_sha256"),
    )
