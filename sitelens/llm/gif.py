"""GIF as a lossless media column (operator 6): LZW code streams, palettes, disposal, transparency.

``encode`` stores bytes as the 8-bit samples of timed frames; ``decode`` reads any GIF87a/89a:
it unpacks the variable-width LZW codes, applies the global or local palette, transparency and
disposal, and yields the samples and the composed canvas of each frame with its delay.
``media_rows`` turns decoded frames into a row with colour-histogram columns.

Defined results: a null or empty text is one row of padding; equal texts give equal files; a very
long text only adds frames, none is cut; a broken file raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 576
#: Rows of a full frame; the canvas has as many rows as the tallest frame.
ROWS = 64
DELAY_CS = 4
BITS = 8
MAX_CODES = 4096

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, frames int, duration_cs int, histogram array<long>"
)


@dataclass
class Frame:
    """One image of a file: its place, delay, disposal, samples (palette indices) and composed canvas."""

    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    transparent: int | None
    samples: np.ndarray
    canvas: np.ndarray | None = None


def lzw_codes(samples: bytes, bits: int = BITS) -> list[int]:
    """The LZW codes of ``samples``; a clear code opens the stream and follows each full table."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes = [clear]
    put = codes.append
    # Keys join the code so far and the next sample in one integer.
    table: dict[int, int] = {}
    size = end + 1
    if samples:
        code = samples[0]
        for sample in samples[1:]:
            key = code << 8 | sample
            if key in table:
                code = table[key]
                continue
            put(code)
            if size < MAX_CODES:
                table[key] = size
                size += 1
            else:
                put(clear)
                table = {}
                size = end + 1
            code = sample
        put(code)
    put(end)
    return codes


def lzw_encode(samples: bytes, bits: int = BITS) -> bytes:
    """The code stream of ``samples`` (values under ``2**bits``), packed from the low bit up.

    The width of the k-th code after a clear code follows from k alone: a reader then knows
    ``2**bits + 1 + k`` codes.
    """
    codes = np.array(lzw_codes(samples, bits), np.uint16)
    since = np.arange(len(codes))
    clears = np.flatnonzero(codes == 1 << bits)
    since -= np.repeat(clears, np.diff(np.append(clears, len(codes)))) + 1
    since[0] = 0
    widths = np.clip(np.frexp(since + ((1 << bits) + 1))[1], bits + 1, 12)
    widths[clears[1:]] = 12
    spread = np.unpackbits(codes.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(spread[np.arange(16)[None, :] < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, bits: int = BITS) -> bytes:
    """The samples of a code stream, up to its end code or its last whole code.

    All codes up to the next change of width are cut from the bits at once; a clear code starts
    again with the table of single samples.
    """
    clear, end = 1 << bits, (1 << bits) + 1
    base = [bytes((i,)) for i in range(clear)] + [b"", b""]
    flat = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little")
    table, width, at, out, before = list(base), bits + 1, 0, [], b""
    put = out.append
    while True:
        room = (1 << width) - len(table) + (not before) if len(table) < MAX_CODES else MAX_CODES
        n = min(max(1, room), (len(flat) - at) // width)
        if n <= 0:
            return b"".join(out)
        cut = flat[at : at + n * width].reshape(n, width)
        codes = np.dot(cut.astype(np.float32), (1 << np.arange(width)).astype(np.float32)).astype(np.int64).tolist()
        used, grow, known = n, table.append, len(table)
        for i, code in enumerate(codes):
            if code == clear:
                used = i + 1
                break
            if code == end:
                return b"".join(out)
            if not before:
                if code > clear:
                    raise ValueError("a code stream starts with an unknown code")
                before = table[code]
                put(before)
                continue
            if code < known:
                entry = table[code]
            elif code == known and known < MAX_CODES:
                entry = before + before[:1]
            else:
                raise ValueError(f"unknown code {code}")
            put(entry)
            if known < MAX_CODES:
                grow(before + entry[:1])
                known += 1
            before = entry
        at += used * width
        if codes[used - 1] == clear:
            table, width, before = list(base), bits + 1, b""
        elif known == 1 << width and width < 12:
            width += 1


def _blocks(data: bytes) -> bytes:
    """Data cut into sub-blocks of at most 255 bytes, closed by an empty one."""
    return b"".join(bytes((len(c),)) + c for c in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def grey_palette() -> bytes:
    return bytes(v for i in range(256) for v in (i, i, i))


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF89a whose frames hold ``payload`` row by row; its length must be a positive multiple of ``width``."""
    if not payload or len(payload) % width:
        raise ValueError(f"payload must fill rows of {width} samples")
    total = len(payload) // width
    parts = [b"GIF89a", struct.pack("<HHBBB", width, min(total, rows), 0xF7, 0, 0), grey_palette()]
    parts.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    for top in range(0, total, rows):
        height = min(rows, total - top)
        own = payload[top * width : (top + height) * width]
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay_cs, 0, 0))
        parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0))
        parts.append(bytes((BITS,)) + _blocks(lzw_encode(own)))
    return b"".join(parts) + b"\x3b"


def _sub_blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(raw):
            raise ValueError("the file is cut inside a block")
        n = raw[at]
        at += 1
        if not n:
            return b"".join(parts), at
        parts.append(raw[at : at + n])
        at += n


def _deinterlaced(samples: np.ndarray) -> np.ndarray:
    rows = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, len(samples), step)]
    out = np.empty_like(samples)
    out[rows] = samples
    return out


def decode(raw: bytes, compose: bool = True) -> Iterator[Frame]:
    """The frames of a file in order; with ``compose``, each with the RGBA canvas it leaves on screen."""
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", raw, 6)
    at, palette = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        palette, at = np.frombuffer(raw, np.uint8, n, at).reshape(-1, 3), at + n
    canvas = np.zeros((high, wide), "<u4") if compose else None
    delay = disposal = 0
    transparent = None
    while at < len(raw):
        kind = raw[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = raw[at + 1]
            data, at = _sub_blocks(raw, at + 2)
            if label == 0xF9 and len(data) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", data)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind} at byte {at}")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", raw, at + 1)
        at += 10
        colours = palette
        if packed & 0x80:
            n = 3 << ((packed & 7) + 1)
            colours, at = np.frombuffer(raw, np.uint8, n, at).reshape(-1, 3), at + n
        bits = raw[at]
        stream, at = _sub_blocks(raw, at + 1)
        samples = np.frombuffer(lzw_decode(stream, bits), np.uint8)
        if len(samples) < w * h:
            raise ValueError("a frame has too few samples")
        samples = samples[: w * h].reshape(h, w)
        if packed & 0x40:
            samples = _deinterlaced(samples)
        frame = Frame(left, top, w, h, delay, disposal, transparent, samples)
        if compose:
            if colours is None:
                raise ValueError("a frame has no palette")
            saved = canvas.copy() if disposal == 3 else None
            lut = np.full(256, 0xFF000000, "<u4")
            lut[: len(colours)] |= colours.astype("<u4") @ np.array([1, 1 << 8, 1 << 16], "<u4")
            part = samples[: min(h, high - top), : min(w, wide - left)]
            area = canvas[top : top + part.shape[0], left : left + part.shape[1]]
            if transparent is None:
                area[...] = lut[part]
            else:
                np.copyto(area, lut[part], where=part != transparent)
            frame.canvas = canvas.copy().view(np.uint8).reshape(high, wide, 4)
            if disposal == 2:
                canvas[top : top + h, left : left + w] = 0
            elif disposal == 3:
                canvas = saved
        yield frame
        delay = disposal = 0
        transparent = None


def payload_of(text: str | None, width: int = WIDTH) -> tuple[int, bytes]:
    """Unpadded size and padded bytes of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % width or (0 if raw else width))


def media_row(text: str | None) -> tuple:
    """Encodes a text, reads the stored bytes back and computes their columns."""
    n, payload = payload_of(text)
    stored = encode(payload)
    frames, total, area, back, duration = 0, np.zeros(256, np.int64), 0, [], 0
    for frame in decode(stored):
        back.append(frame.samples.tobytes())
        visible = frame.canvas[: frame.height, : frame.width]
        total += np.bincount(visible[..., 0].ravel(), minlength=256)
        area += frame.width * frame.height
        frames += 1
        duration += frame.delay_cs
    read = b"".join(back)
    histogram = total.reshape(32, 8).sum(axis=1)
    feature = ",".join(f"{x / area:.4f}" for x in total.reshape(8, 32).sum(axis=1)) + f";frames={frames};cs={duration}"
    return (
        n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]), len(stored), hashlib.sha256(stored).hexdigest(),
        feature, frames, duration, histogram.tolist(),
    )


def media_columns(documents: DataFrame) -> DataFrame:
    """One row per document with its media columns, row by row and without a shuffle."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(i, *media_row(t)) for i, t in zip(batch["doc_id"], batch["text"], strict=True)]
            out = pd.DataFrame(made, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, SCHEMA)
