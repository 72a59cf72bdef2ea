"""Media columns: 8-bit PNG through zlib chunks, and low-frequency cosine-transform hashes of binary columns."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, text_or_empty

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)

WIDTH = 64
IDAT_BYTES = 1 << 20
#: Largest image, in samples, that is decoded; more is refused before memory is taken for it.
MOST_SAMPLES = 1 << 31


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def filtered(image: np.ndarray, kinds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the filter of ``kinds`` (of NONE, SUB and UP) whose residuals have the smallest sum, the first of equal
    ones, and the residuals. Rows are judged in bounded stretches."""
    chosen, out = np.full(len(image), kinds[0], np.uint8), np.empty_like(image)
    for a in range(0, len(image), 1 << 14):
        rows, above = image[a : a + (1 << 14)], np.zeros_like(image[a : a + (1 << 14)])
        above[1:] = rows[:-1]
        if a:
            above[0] = image[a - 1]
        least = None
        for kind in kinds:
            left = rows if kind == NONE else rows - above if kind == UP else np.concatenate([rows[:, :1], rows[:, 1:] - rows[:, :-1]], 1)
            cost = np.minimum(left, -left).sum(1, dtype=np.int64)  # the absolute value of a byte taken as signed
            better = np.ones(len(rows), bool) if least is None else cost < least
            least = cost if least is None else np.minimum(cost, least)
            out[a : a + len(rows)][better] = left[better]
            chosen[a : a + len(rows)][better] = kind
    return chosen, out


def encode_png(image: np.ndarray, level: int = 1, kinds: tuple[int, ...] = (NONE, SUB, UP)) -> bytes:
    """A grey 8-bit PNG of ``image``, each row under the filter of ``kinds`` that suits it best."""
    height, width = image.shape
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = filtered(image, kinds)
    data = zlib.compress(rows, level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def decode_png(data: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG.

    ValueError if the signature or a checksum is wrong, IHDR is not the first chunk or not of 13 bytes, IDAT chunks do not
    follow each other, IEND is missing or followed by something, a chunk that may not be skipped is unknown, or the samples
    are fewer or more than the header says (no more than that is ever decompressed).
    """
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, body, kinds = 8, None, [], []
    view = memoryview(data)
    while at < len(data) and kinds[-1:] != [b"IEND"]:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (n,) = struct.unpack_from(">I", data, at)
        kind, content = data[at + 4 : at + 8], view[at + 8 : at + 8 + n]
        if at + 12 + n > len(data):
            raise ValueError("a chunk is cut off")
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(content, zlib.crc32(kind)):
            raise ValueError(f"wrong checksum in {kind!r}")
        if (kind == b"IHDR") != (not kinds) or kind == b"IHDR" and n != 13:
            raise ValueError("IHDR has to be the first chunk, once, with 13 bytes")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            if body and kinds[-1] != b"IDAT":
                raise ValueError("IDAT chunks are parted")
            body.append(bytes(content))
        elif kind != b"IEND" and not kind[0] & 32:
            raise ValueError(f"unknown chunk {kind!r}")
        kinds.append(kind)
        at += 12 + n
    if header is None or kinds[-1] != b"IEND" or at != len(data):
        raise ValueError("IHDR or IEND is missing, or IEND is not the end")
    width, height, *kind = header
    if kind != [8, 0, 0, 0, 0]:
        raise ValueError("only grey 8-bit images without interlace")
    size = height * (width + 1)
    if width == 0 or height == 0 or size > MOST_SAMPLES:
        raise ValueError("an image without or with too many samples")
    try:
        unpack = zlib.decompressobj()
        raw = unpack.decompress(b"".join(body), size + 1)
    except zlib.error as e:
        raise ValueError(f"broken image data: {e}") from e
    if len(raw) != size or not unpack.eof:
        raise ValueError("wrong number of samples")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the row filters in numpy.

    Without AVERAGE and PAETH, SUB is a running sum along the rows and UP one down the rows from the last row that is not UP.
    Otherwise the image is undone by diagonals: the samples of a diagonal depend on the two diagonals before it only.
    """
    if len(kinds) and kinds.max() > PAETH:
        raise ValueError(f"filter {kinds.max()} does not exist")
    if not rows.size:
        return rows.copy()
    if not (kinds >= AVERAGE).any():
        out = rows.copy()
        sub = kinds == SUB
        out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)
        up = kinds == UP
        if up.any():
            start = np.maximum.accumulate(np.where(up, 0, np.arange(len(rows))))
            sums = np.zeros((len(rows) + 1, rows.shape[1]), np.uint8)
            np.cumsum(out, axis=0, dtype=np.uint8, out=sums[1:])
            out[up] = sums[1:][up] - sums[start[up]]
        return out
    height, width = rows.shape
    out = np.zeros((height + 1, width + 1), np.int16)  # a row and a column of zeros before the image
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner, kind = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y]
        p = left + up - corner
        to_left, to_up, to_corner = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        out[y + 1, x + 1] = (rows[y, x] + np.choose(kind, [0 * left, left, up, (left + up) // 2, paeth])) & 255
    return out[1:, 1:].astype(np.uint8)


_k = np.arange(8)[:, None]
_DCT = np.cos(np.pi * _k * (2 * np.arange(32)[None, :] + 1) / 64)
_BITS = 1 << np.arange(63, -1, -1, dtype=np.uint64)


def dct_hash(image: np.ndarray) -> str:
    """64 bits in hex: which of the 8 x 8 lowest cosine coefficients of the image, averaged to 32 x 32, exceed their median."""
    height, width = image.shape
    if height == 0 or width == 0:
        return "0" * 16
    rows = np.arange(32) * height // 32
    cols = np.arange(32) * width // 32
    small = np.add.reduceat(image, rows, axis=0, dtype=np.float64) if height >= 32 else image[rows].astype(np.float64)
    small = np.add.reduceat(small, cols, axis=1) if width >= 32 else small[:, cols]
    if height >= 32:
        small /= np.diff(np.append(rows, height))[:, None]
    if width >= 32:
        small /= np.diff(np.append(cols, width))[None, :]
    low = np.round(_DCT @ small @ _DCT.T, 6).ravel()
    return f"{int(_BITS[low > np.median(low[1:])].sum()):016x}"


def to_image(payload: bytes, width: int = WIDTH) -> np.ndarray:
    """The bytes, zero-padded to a positive multiple of ``width``, as rows of a grey image."""
    padded = payload + bytes(-len(payload) % width if payload else width)
    return np.frombuffer(padded, np.uint8).reshape(-1, width)


def encode_media(df: DataFrame, data_col: str, media_col: str, level: int = 1) -> DataFrame:
    """``df`` with the binary column ``data_col`` stored as PNG in ``media_col``; null data counts as empty. A column that is
    called ``media_col`` already is replaced."""
    names = [n for n in df.columns if n not in (data_col, media_col)]
    schema = T.StructType([*(df.schema[n] for n in names), T.StructField(media_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([encode_png(to_image(x.as_py() or b""), level) for x in batch.column(len(names))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], made], [*names, media_col])

    return df.select(*_quoted(names), F.col(f"`{data_col}`")).transform(map_batches, run, schema)


def _quoted(names: list[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def media_features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """For each row of a binary PNG column: what is read back from the stored bytes, and its cosine-transform hash.

    Adds payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature in place of ``media_col``; columns that
    are called so already are replaced. A null or broken medium gives null in all but the media columns; other rows are not
    affected, and repeated rows each have their own result.
    """
    made = [("payload_bytes", pa.int64(), T.LongType()), ("payload_sha256", pa.string(), T.StringType()), ("tail_crc32", pa.int64(), T.LongType()), ("media_bytes", pa.int64(), T.LongType()), ("media_sha256", pa.string(), T.StringType()), ("feature", pa.string(), T.StringType())]
    new = [n for n, *_ in made]
    names = [n for n in df.columns if n != media_col and n.lower() not in new]
    schema = T.StructType([*(df.schema[n] for n in names), *(T.StructField(n, kind) for n, _, kind in made)])

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 6
        stored = (len(media), hashlib.sha256(media).hexdigest())
        try:
            image = decode_png(media)
        except ValueError:
            return (None, None, None, *stored, None)
        payload = image.tobytes()
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), *stored, dct_hash(image))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*(one(x.as_py()) for x in batch.column(len(names))), strict=True)) or [()] * 6
            arrays = [pa.array(x, kind) for x, (_, kind, _) in zip(got, made, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *arrays], [*names, *new])

    return df.select(*_quoted(names), F.col(f"`{media_col}`")).transform(map_batches, run, schema)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> DataFrame:
    """id, n_bytes (UTF-8 length) and ``media``, the text's bytes as PNG. Null text counts as empty; an empty table gives no rows."""
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.encode(text, "UTF-8").alias("_data"))
    return encode_media(base, "_data", "media", level)
