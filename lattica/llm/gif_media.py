"""GIF media columns: a whole decoder, a lossless writer, and frame tables.

``decode_gif`` reads any GIF87a/89a: LZW code streams (with deferred clear codes),
global and local palettes, interlacing, transparency, and the disposal rules 0 to 3.
Codes are cut out of the bit stream for a whole run at a time, since their widths
depend only on how many codes came since the last clear; a string of the table is
always a stretch of what has been put out, so the table is two lists of numbers.

``frames`` makes a row for each timed frame: its start and delay, the composed
canvas as RGBA, and a colour histogram (RGB, 8 levels a channel, as "bin:count").

``store_and_read`` writes texts as GIFs of 8-bit samples with a grey palette, reads
the stored bytes back through the decoder and digests what it read.

Edge cases: a null or empty text is 64 zero bytes.  Null media give no frame rows;
broken media give one row with ``error`` set and null columns after the frames that could
be read; so does a canvas of more than ``most_pixels``.  Texts of any length are stored in
frames of at most ``ROWS`` rows, so memory doesn't grow with one frame.  Repeated rows are
stored one by one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import pieces, text_column
from lattica.session import prepare

WIDTH, ROWS, DELAY_CS = 64, 1024, 10
TABLE = 4096
MOST_PIXELS = 1 << 24  # of a canvas, 64 MB


class GifError(ValueError):
    pass


@dataclass
class Frame:
    start_cs: int
    delay_cs: int
    disposal: int
    left: int
    top: int
    width: int
    height: int
    rgba: np.ndarray  # the canvas as shown, height x width x 4


# -- LZW -------------------------------------------------------------------------------


@lru_cache(maxsize=16)
def _schedule(bits: int) -> np.ndarray:
    held = (1 << bits) + 2 + np.maximum(0, np.arange(2 * TABLE) - 1)
    return np.clip(np.floor(np.log2(np.minimum(held, TABLE))).astype(np.int64) + 1, bits + 1, 12)


def code_widths(first: int, n: int, bits: int) -> np.ndarray:
    """Widths of the codes number first .. first + n - 1 since the last clear."""
    if first + n <= 2 * TABLE:
        return _schedule(bits)[first : first + n]
    return _schedule(bits)[np.minimum(np.arange(first, first + n), 2 * TABLE - 1)]


def _strings(codes: np.ndarray, clear: int, most: int) -> bytes:
    """What the codes since a clear stand for, as far as it takes to make ``most`` samples.

    Code k + clear + 2 is the string of the k-th code followed by the first sample of
    the next one, so each string is a chain of earlier codes that ends in a literal.
    """
    at = np.arange(len(codes))
    literal = codes < clear
    up = codes - (clear + 2)
    if (up >= at).any():
        raise GifError("a code before its string")
    root, size = np.where(literal, at, up), np.where(literal, 0, 1)
    while True:
        size, further = size + size[root], root[root]
        if (further == root).all():
            break
        root = further
    ends = np.cumsum(size + 1)
    if len(ends) and ends[-1] > most:
        used = int(np.searchsorted(ends, most)) + 1
        if used < len(codes):
            return _strings(codes[:used], clear, most)
    first = codes[root].astype(np.uint8)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    out[ends - size - 1] = first
    here = np.flatnonzero(~literal)
    place = ends[here] - 1
    while len(here):
        here = up[here]
        out[place] = first[here + 1]
        more = ~literal[here]
        here, place = here[more], place[more] - 1
    return out.tobytes()


def lzw_decode(data: bytes, bits: int, most: int) -> bytes:
    """Samples of a code stream whose literals have ``bits`` bits; ``most`` samples at most."""
    clear, stop = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(data + bytes(4), dtype=np.uint8).astype(np.int64)
    total, at, since, run = len(data) * 8, 0, 0, 1024
    out: list[bytes] = []
    held: list[np.ndarray] = []  # codes since the last clear
    made = 0
    while at < total:
        widths = code_widths(since, run, bits)
        ends = at + np.cumsum(widths)
        n = int(np.searchsorted(ends, total, side="right"))
        if not n:
            break
        places, widths = (ends - widths)[:n], widths[:n]
        byte = places >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (places & 7)) & ((1 << widths) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        if not len(marks):
            held.append(codes)
            at, since, run = int(ends[n - 1]), since + n, TABLE
            continue
        used = int(marks[0])
        held.append(codes[:used])
        out.append(_strings(np.concatenate(held), clear, most))
        held, made = [], made + len(out[-1])
        if codes[used] == stop or made >= most:
            break
        at, since, run = int(ends[used]), 0, max(256, min(TABLE, 2 * used))
    if held:
        out.append(_strings(np.concatenate(held), clear, most))
    return b"".join(out)[:most]


#: Codes by (prefix code, sample), all times 256; 0 where there is none.  Empty between calls.
_CODES: list[int] = []


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """A code stream of the samples, cleared whenever the table is full."""
    clear, stop = 1 << bits, (1 << bits) + 1
    if not _CODES:
        _CODES.extend([0] * (TABLE << 8))
    table, first, full = _CODES, (stop + 1) << 8, TABLE << 8
    codes, keys, cleared, free = [clear << 8], [], [0], first
    put, note = codes.append, keys.append
    it = iter(samples)
    prefix = next(it, -1) << 8
    if prefix >= 0:
        for sample in it:
            key = prefix + sample
            code = table[key]
            if code:
                prefix = code
                continue
            put(prefix)
            table[key] = free
            note(key)
            free += 256
            prefix = sample << 8
            if free == full:
                cleared.append(len(codes))
                put(clear << 8)
                for key in keys:
                    table[key] = 0
                keys.clear()
                free = first
        put(prefix)
        for key in keys:
            table[key] = 0
    put(stop << 8)
    values = np.array(codes, dtype=np.int64) >> 8
    widths = np.empty(len(values), dtype=np.int64)
    widths[0] = bits + 1
    edges = [*cleared, len(values) - 1]
    for a, b in zip(edges[:-1], edges[1:]):
        widths[a + 1 : b + 1] = code_widths(0, b - a, bits)
    at = np.cumsum(widths) - widths
    values <<= at & 7
    out = np.zeros((int(at[-1] + widths[-1]) + 7 >> 3) + 2)
    byte = at >> 3
    for k in range(3):  # the bits of two codes never overlap, so sums are unions
        out += np.bincount(byte + k, values >> 8 * k & 255, len(out))
    return out[:-2].astype(np.uint8).tobytes()


# -- container -------------------------------------------------------------------------


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise GifError("cut off")
        size = data[at]
        at += 1
        if not size:
            return b"".join(parts), at
        parts.append(data[at : at + size])
        at += size


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    table = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
    return np.vstack([table, np.zeros((256 - n, 3), np.uint8)]), at + 3 * n


def _rows_of_interlace(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, step) for a, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(data: bytes, most_pixels: int = MOST_PIXELS):
    """Yield the frames of a GIF as they are shown; a larger canvas than ``most_pixels`` is an error."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF header")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, common = 13, None
    if flags & 0x80:
        common, at = _palette(data, at, flags)
    if height * width > most_pixels:
        raise GifError("a canvas beyond most_pixels")
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    disposal = delay = clock = 0
    clear_index = None
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1]
            block, at = _blocks(data, at + 2)
            if label == 0xF9 and len(block) >= 4:
                control, delay, index = struct.unpack_from("<BHB", block)
                disposal, clear_index = control >> 2 & 7, index if control & 1 else None
            continue
        if kind != 0x2C:
            raise GifError("an unknown block")
        left, top, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = common
        if own & 0x80:
            palette, at = _palette(data, at, own)
        if palette is None:
            raise GifError("no palette")
        bits = data[at]
        if not 2 <= bits <= 8:
            raise GifError("a wrong code size")
        stream, at = _blocks(data, at + 1)
        samples = np.frombuffer(lzw_decode(stream, bits, w * h), dtype=np.uint8)
        if len(samples) < w * h:
            raise GifError("too few samples")
        samples = samples.reshape(h, w)
        if own & 0x40:
            rows = np.empty_like(samples)
            rows[_rows_of_interlace(h)] = samples
            samples = rows
        need_h, need_w = max(canvas.shape[0], top + h), max(canvas.shape[1], left + w)
        if need_h * need_w > most_pixels:
            raise GifError("a canvas beyond most_pixels")
        if (need_h, need_w) != canvas.shape[:2]:
            grown = np.zeros((need_h, need_w, 4), dtype=np.uint8)
            grown[: canvas.shape[0], : canvas.shape[1]] = canvas
            canvas = grown
        before = canvas.copy() if disposal == 3 else None
        colours = np.concatenate([palette[samples], np.full((h, w, 1), 255, np.uint8)], axis=2)
        place = canvas[top : top + h, left : left + w]
        if clear_index is None:
            place[:] = colours
        else:
            shown = samples != clear_index
            place[shown] = colours[shown]
        yield Frame(clock, delay, disposal, left, top, w, h, canvas.copy())
        clock += delay
        if disposal == 2:
            place[:] = 0
        elif disposal == 3:
            canvas = before
        disposal = delay = 0
        clear_index = None
    raise GifError("no trailer")


def _as_blocks(data: bytes) -> bytes:
    full = len(data) // 255 * 255
    head = np.frombuffer(data, dtype=np.uint8, count=full).reshape(-1, 255)
    out = np.hstack([np.full((len(head), 1), 255, np.uint8), head]).tobytes()
    return out + (bytes([len(data) - full]) + data[full:] if len(data) > full else b"") + b"\0"


GREY = bytes(v for i in range(256) for v in (i, i, i))


def encode_gif(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A grey GIF of samples, a multiple of ``width`` of them, in frames of ``rows`` rows."""
    height = len(samples) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(height, rows), 0xF7, 0, 0), GREY]
    for top in range(0, height, rows):
        part = samples[top * width : (top + rows) * width]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 2 << 2, delay_cs, 0), b"\0"]
        out += [b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _as_blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Counts of the shown pixels by RGB in 8 levels a channel."""
    shown = rgba[rgba[..., 3] > 0].astype(np.int64) >> 5
    return np.bincount(shown[:, 0] << 6 | shown[:, 1] << 3 | shown[:, 2], minlength=512)


def sparse(counts: np.ndarray) -> str:
    return " ".join(f"{i}:{counts[i]}" for i in np.flatnonzero(counts))


# -- DataFrames ------------------------------------------------------------------------

FRAMES = "doc_id long, frame int, start_cs long, delay_cs int, disposal int, width int, height int, rgba binary, histogram string, error string"


def frames(media: DataFrame, id_col: str = "doc_id", data: str = "media", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """A row for each timed frame of each GIF in ``data``, put out frame by frame; a broken file ends in a row with ``error``."""
    names = [x.split()[0] for x in FRAMES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]

    def run(batches):
        for batch in pieces(batches, "media"):
            for doc, blob in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
                if blob is None:
                    continue
                batch_of = lambda *row: pa.record_batch([pa.array([v], t) for v, t in zip(row, types)], names=names)
                try:
                    for i, f in enumerate(decode_gif(bytes(blob), most_pixels)):
                        yield batch_of(doc, i, f.start_cs, f.delay_cs, f.disposal, f.rgba.shape[1], f.rgba.shape[0], f.rgba.tobytes(), sparse(histogram(f.rgba)), None)
                except (GifError, IndexError, struct.error, ValueError, OverflowError) as e:
                    yield batch_of(doc, *[None] * 8, str(e) or type(e).__name__)

    prepare(media.sparkSession)
    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(data).alias("media")).mapInArrow(run, FRAMES)


def payload_of(text: bytes, unit: int = WIDTH) -> bytes:
    return text + bytes(-len(text) % unit if text else unit)


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_cs long"


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of every text as stored in a GIF and read back from it; ``feature`` is its colour histogram."""
    names = [x.split()[0] for x in STORED.split(", ")]
    types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]

    def run(batches):
        for batch in pieces(batches):
            rows = []
            for doc, own in zip(batch.column("doc_id").to_pylist(), text_column(batch).cast(pa.binary()).to_pylist()):
                media = encode_gif(payload_of(own))
                read, counts, n, clock = [], np.zeros(512, np.int64), 0, 0
                for f in decode_gif(media):
                    shown = f.rgba[: f.height, : f.width]
                    read.append(shown[..., 0].tobytes())
                    counts += histogram(shown)
                    n, clock = n + 1, f.start_cs + f.delay_cs
                payload = b"".join(read)
                rows.append((doc, len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), sparse(counts), n, clock))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, STORED)
