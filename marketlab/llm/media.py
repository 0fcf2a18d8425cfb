"""Media columns: texts stored losslessly as PNG, read back, and hashed by their low frequencies.

``encode`` writes 8-bit grey, RGB or RGBA samples as PNG: each row gets the filter of None, Sub and Up
whose signed samples sum least, rows go through one zlib stream, and chunks carry their CRC-32.
``decode`` checks the signature, each chunk's checksum and length and the stream's size, and undoes all five filters with
numpy.  ``with_png`` gives a binary column, ``read_png`` what is in one.  ``dct_hash`` averages the samples to 32 x 32, takes the low 8 x 8 corner of the cosine
transform and sets a bit where a term exceeds the median of the 63 without the mean.

Null text counts as empty; an empty text's payload is one block of bytes 255.  Equal texts give equal
bytes; repeated rows are stored each; an empty table gives no rows; the name of a further column may be any but png.  Rows are
worked one by one, so memory follows the longest text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marketlab.llm.common import mapped, slices, stored

SIGNATURE = b"\x89PNG\r\n\x1a\n"
BLOCK = 576
WIDTH = 48  # samples a row; 12 rows make a block
CHANNELS = {0: 1, 2: 3, 6: 4}


class MediaError(ValueError):
    """The bytes are no PNG of the kinds read here, or are damaged."""


def payload(text: bytes | None) -> bytes:
    """The text's bytes and then bytes 255 up to a positive multiple of 576."""
    text = text or b""
    return text + b"\xff" * (-len(text) % BLOCK if text else BLOCK)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(samples: np.ndarray, level: int = 1) -> bytes:
    """PNG of an array (height, width) or (height, width, 3 or 4) of uint8."""
    channels = 1 if samples.ndim == 2 else samples.shape[2]
    height, width = samples.shape[:2]
    rows = np.ascontiguousarray(samples).reshape(height, width * channels)
    sub, up = rows.copy(), rows.copy()
    sub[:, channels:] -= rows[:, :-channels]
    up[1:] -= rows[:-1]
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(1) for x in (rows, sub, up)])
    kind = cost.argmin(0).astype(np.uint8)
    body = np.empty((height, rows.shape[1] + 1), np.uint8)
    body[:, 0] = kind
    body[:, 1:] = np.choose(kind[:, None], [rows, sub, up])
    color = {1: 0, 3: 2, 4: 6}[channels]
    header = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(data: bytes):
    """(kind, data) of every chunk, checked."""
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise MediaError("a chunk is cut off")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise MediaError(f"checksum of chunk {kind!r}")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise MediaError("no end chunk")


def unfilter(body: np.ndarray, kinds: np.ndarray, channels: int) -> np.ndarray:
    """Rows of samples from filtered rows; runs of rows that share None or Up are undone at once, Sub by row sums."""
    height, width = body.shape
    out = np.empty((height, width), np.uint8)
    zero = np.zeros(width, np.uint8)
    plain = kinds == 0
    out[plain] = body[plain]
    if (subs := np.flatnonzero(kinds == 1)).size:
        out[subs] = body[subs].reshape(subs.size, -1, channels).cumsum(1, dtype=np.uint8).reshape(subs.size, width)
    if (kinds > 4).any():
        raise MediaError(f"filter {kinds.max()}")
    # rows that need the row above: Up by column sums, the others along diagonals
    for first, run in _runs(np.flatnonzero(kinds >= 2), np.where(kinds == 2, 2, 3)):
        above, last = out[first - 1] if first else zero, first + len(run)
        if run[0] == 2:
            out[first:last] = body[first:last].cumsum(0, dtype=np.uint8) + above
        else:
            out[first:last] = _diagonals(body[first:last], kinds[first:last], above, channels)
    return out


def _diagonals(body: np.ndarray, kinds: np.ndarray, above: np.ndarray, channels: int) -> np.ndarray:
    """Rows filtered by Average or Paeth: samples on one diagonal need only earlier diagonals, so each is undone at once."""
    height, width = len(body), body.shape[1] // channels
    raw = body.reshape(height, width, channels).astype(np.int16)
    out = np.zeros((height + 1, width + 1, channels), np.int16)  # a row above and a column before
    out[0, 1:] = above.reshape(width, channels)
    for d in range(height + width - 1):
        r = np.arange(max(0, d - width + 1), min(height, d + 1))
        c = d - r
        left, over, corner = out[r + 1, c], out[r, c + 1], out[r, c]
        p = left + over - corner
        by_left, by_over, by_corner = abs(p - left), abs(p - over), abs(p - corner)
        paeth = np.where((by_left <= by_over) & (by_left <= by_corner), left, np.where(by_over <= by_corner, over, corner))
        guess = np.where((kinds[r] == 3)[:, None], (left + over) >> 1, paeth)
        out[r + 1, c + 1] = (raw[r, c] + guess) & 255
    return out[1:, 1:].reshape(height, -1).astype(np.uint8)


def _runs(rows: np.ndarray, kinds: np.ndarray):
    """(first row, its kinds) of adjacent rows with one filter."""
    if rows.size:
        cut = np.flatnonzero((np.diff(rows) != 1) | (np.diff(kinds[rows]) != 0)) + 1
        for part in np.split(rows, cut):
            yield int(part[0]), kinds[part]


def decode(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey, RGB or RGBA PNG."""
    header, stream = None, []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            stream.append(body)
    if not header or header[2] != 8 or header[3] not in CHANNELS or any(header[4:]):
        raise MediaError("only 8-bit grey, RGB and RGBA without interlace are read")
    width, height, channels = header[0], header[1], CHANNELS[header[3]]
    try:
        raw = zlib.decompress(b"".join(stream))
    except zlib.error as e:
        raise MediaError("damaged stream") from e
    if len(raw) != height * (width * channels + 1):
        raise MediaError("the stream's size does not match the header")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width * channels + 1)
    out = unfilter(rows[:, 1:], rows[:, 0], channels)
    return out.reshape(height, width) if channels == 1 else out.reshape(height, width, channels)


_COS = np.cos(np.pi * (2 * np.arange(32)[None, :] + 1) * np.arange(8)[:, None] / 64)


def _shrink(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First index and count of each of 32 even parts of n samples; of fewer than 32, parts repeat."""
    first = np.arange(32) * n // 32
    last = np.maximum(first + 1, (np.arange(32) + 1) * n // 32)
    return first, last - first


def dct_hash(samples: np.ndarray) -> str:
    """64-bit hash, 16 hexadecimal digits, of the low frequencies."""
    grey = samples if samples.ndim == 2 else samples[:, :, :3].mean(2)
    if not grey.size:
        return "0" * 16
    (r, rn), (c, cn) = _shrink(grey.shape[0]), _shrink(grey.shape[1])
    rows = np.add.reduceat(grey, r, axis=0, dtype=np.float64) if grey.shape[0] >= 32 else grey[r].astype(np.float64)
    small = np.add.reduceat(rows, c, axis=1) if grey.shape[1] >= 32 else rows[:, c]
    small = small / (rn[:, None] if grey.shape[0] >= 32 else 1) / (cn[None, :] if grey.shape[1] >= 32 else 1)
    low = (_COS @ small @ _COS.T).round(6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def with_png(docs: DataFrame) -> DataFrame:
    """Columns of docs other than text, n_bytes (of the text) and png, the whole text's payload as a PNG in a binary column."""
    names = [c for c in docs.columns if c != "text"]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            media = [encode(np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH)) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], [*names, "n_bytes", "png"])

    return mapped(docs, run, f"{kinds}n_bytes long, png binary")


def read_png(media: DataFrame, column: str = "png") -> DataFrame:
    """Columns of media other than the binary one, and what its bytes hold: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    names = [c for c in media.columns if c != column]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in media.schema if f.name != column)
    made = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def one(data: bytes) -> tuple:
        samples = decode(data)
        back = samples.tobytes()
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), dct_hash(samples)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, column)):
            cols = zip(*map(one, batch.column(column).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(c, k) for c, k in zip(cols, made.values(), strict=True))], [*names, *made])

    return mapped(media, run, f"{kinds}payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_png(docs: DataFrame) -> DataFrame:
    """Each whole text stored as PNG in a table and read back from it, with digests of both and the feature of the read samples."""
    return read_png(stored(with_png(docs.select("doc_id", "text")), "png"))
