"""GIF files in columns: frames with times, composed pixels and colour histograms.

``frames_of`` reads any GIF87a or GIF89a: blocks and sub-blocks, global and local
palettes, interlace, LZW code streams with growing code sizes and deferred clear
codes; ``composed`` applies transparency and the four disposal rules. ``encode``
writes one frame per block of rows under a grey palette, so bytes are pixels and
come back as they were; bytes 255, the padding, are transparent, and each frame is
disposed of before the next, so a composed frame shows its own bytes of text and
nothing else. Both are tables in Python: an LZW string is an entry of a dict when
writing and a prefix string when reading.

A frame's histogram counts its composed pixels in 4 x 4 x 4 boxes of red, green
and blue, unseen ones apart.

``documents_as_gif`` writes a table of GIFs to the shared folder, reads that table
again, and takes all it returns from what it read. Frames are read one at a time,
and a screen or frame has at most ``max_pixels``, so a small file that claims a
huge picture takes no memory.

Defined cases: null bytes decode to no frames with an error in words, broken ones
and those beyond ``max_pixels`` too (frames before the fault are kept); a null text
is the empty one, which is one block of padding; equal bytes give equal rows; an
empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialize, whole

WIDTH = 24
BLOCK = 576
FRAME_ROWS = 24 * 24
PADDING = 255
#: The largest screen or frame that is read, in pixels of 4 bytes each.
MAX_PIXELS = 1 << 24
FRAMES = "index int, delay_cs int, disposal int, transparent int, left int, top int, width int, height int, histogram array<int>"


@dataclass
class Frame:
    delay_cs: int
    disposal: int
    transparent: int | None
    left: int
    top: int
    width: int
    height: int
    pixels: bytes  # as stored: palette indices, row by row
    palette: np.ndarray


@dataclass
class Gif:
    width: int = 0
    height: int = 0
    background: int = 0
    palette: np.ndarray | None = None
    loops: int | None = None
    frames: list[Frame] = field(default_factory=list)
    error: str | None = None


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream of data, whose values have so many bits."""
    clear, end = 1 << bits, (1 << bits) + 1
    size, limit = bits + 1, 1 << (bits + 1)
    out = bytearray()
    acc, held = clear, size
    table: dict[int, int] = {}
    get = table.get
    next_code = end + 1
    if not data:
        acc |= end << held
        held += size
    else:
        values = iter(data)
        cur = next(values)
        for value in values:
            key = cur << 8 | value
            known = get(key)
            if known is not None:
                cur = known
                continue
            acc |= cur << held
            held += size
            if held >= 4096:
                n = held >> 3
                out += (acc & ((1 << (n << 3)) - 1)).to_bytes(n, "little")
                acc >>= n << 3
                held &= 7
            if next_code < 4096:
                table[key] = next_code
                if next_code == limit:
                    size += 1
                    limit <<= 1
                next_code += 1
            else:
                acc |= clear << held
                held += size
                table.clear()
                size, limit, next_code = bits + 1, 1 << (bits + 1), end + 1
            cur = value
        acc |= cur << held
        held += size
        # a reader has one more entry by now
        if next_code == limit and next_code < 4096:
            size += 1
        acc |= end << held
        held += size
    return bytes(out) + acc.to_bytes((held + 7) >> 3, "little")


def codes_of(stream: bytes, at_bit: int, size: int, n: int) -> list[int]:
    """Up to n codes of a size from a bit on."""
    first, shift = at_bit >> 3, at_bit & 7
    n = min(n, (len(stream) * 8 - at_bit) // size)
    if n <= 0:
        return []
    raw = np.frombuffer(stream, np.uint8, min(len(stream) - first, (n * size + shift + 7) // 8), first)
    bits = np.unpackbits(raw, bitorder="little")[shift : shift + n * size].reshape(n, size)
    return (bits @ (1 << np.arange(size, dtype=np.int32))).tolist()


def lzw_decode(stream: bytes, bits: int, most: int | None = None) -> bytes:
    """The values of a code stream, up to its end code or as far as it goes, or until there are `most`. ValueError: a code that can't be."""
    clear, end = 1 << bits, (1 << bits) + 1
    roots = [bytes([i]) for i in range(min(clear, 256))] + [b""] * (max(clear - 256, 0) + 2)
    table = list(roots)
    out: list[bytes] = []
    size, last, at, total = bits + 1, b"", 0, len(stream) * 8
    counted = given = 0
    while at + size <= total:
        if most is not None:
            given += sum(map(len, out[counted:]))
            counted = len(out)
            if given >= most:
                break
        # as many codes as the table can take before codes grow
        room = (1 << size) - len(table) - (0 if last else -1)
        batch = codes_of(stream, at, size, max(room, 1) if size < 12 or room > 0 else 4096)
        used = 0
        grown = False
        for code in batch:
            used += 1
            if code == clear:
                table = list(roots)
                last = b""
                grown = True
                at += used * size
                size = bits + 1
                break
            if code == end:
                return b"".join(out)
            if not last:
                if code >= clear:
                    raise ValueError("a code before its string")
                last = table[code]
                out.append(last)
                continue
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("a code beyond the table")
            out.append(entry)
            if len(table) < 4096:
                table.append(last + entry[:1])
            last = entry
        if not grown:
            at += used * size
            if len(table) == 1 << size and size < 12:
                size += 1
    return b"".join(out)


def sub_blocks(data: bytes) -> bytes:
    full, rest = divmod(len(data), 255)
    out = b"".join(b"\xff" + data[i * 255 : i * 255 + 255] for i in range(full))
    return out + (bytes([rest]) + data[full * 255 :] if rest else b"") + b"\0"


GREY = bytes(v for i in range(256) for v in (i, i, i))


def encode(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = 10) -> bytes:
    """payload, a multiple of width, as a GIF of grey frames of at most frame_rows rows, each cleared before the next, 255 transparent."""
    rows = len(payload) // width
    height = min(rows, frame_rows)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), GREY]
    for top in range(0, rows, frame_rows):
        n = min(frame_rows, rows - top)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 2 << 2 | 1, delay_cs, PADDING) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, n, 0) + b"\x08")
        out.append(sub_blocks(lzw_encode(payload[top * width : (top + n) * width])))
    return b"".join([*out, b";"])


def decode(data: bytes | None, max_pixels: int = MAX_PIXELS) -> Gif:
    out = Gif()
    out.frames = list(frames_of(data, out, max_pixels))
    return out


def frames_of(data: bytes | None, out: Gif, max_pixels: int = MAX_PIXELS) -> Iterator[Frame]:
    """One frame after another. out gets the screen's properties, and the error that ends the frames, if one does."""
    try:
        yield from _read(data or b"", out, max_pixels)
    except (ValueError, IndexError, struct.error) as e:
        out.error = str(e) or type(e).__name__


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 3 << ((flags & 7) + 1)
    if at + n > len(data):
        raise ValueError("a palette is cut off")
    return np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n


def _join(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _read(data: bytes, out: Gif, max_pixels: int) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    out.width, out.height, flags, out.background, _ = struct.unpack_from("<HHBBB", data, 6)
    if out.width * out.height > max_pixels:
        raise ValueError(f"a screen of {out.width} x {out.height}, limit {max_pixels} pixels")
    at = 13
    if flags & 0x80:
        out.palette, at = _palette(data, at, flags)
    delay, disposal, transparent = 0, 0, None
    while True:
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1]
            body, end = _join(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = (body[0] >> 2) & 7, body[1] | body[2] << 8
                transparent = body[3] if body[0] & 1 else None
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                out.loops = body[12] | body[13] << 8
            at = end
        elif kind == 0x2C:
            left, top, width, height, flags = struct.unpack_from("<HHHHB", data, at + 1)
            if width * height > max_pixels:
                raise ValueError(f"a frame of {width} x {height}, limit {max_pixels} pixels")
            at += 10
            palette = out.palette
            if flags & 0x80:
                palette, at = _palette(data, at, flags)
            if palette is None:
                palette = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(-1, 3)
            bits = data[at]
            if not 1 <= bits <= 11:
                raise ValueError("a code size that can't be")
            stream, at = _join(data, at + 1)
            pixels = lzw_decode(stream, bits, width * height)[: width * height]
            pixels += b"\0" * (width * height - len(pixels))
            if flags & 0x40:
                order = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, height, step)]
                rows = np.frombuffer(pixels, np.uint8).reshape(height, width)
                back = np.empty_like(rows)
                back[order] = rows
                pixels = back.tobytes()
            yield Frame(delay, disposal, transparent, left, top, width, height, pixels, palette)
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("a block of no known kind")


def composed(gif: Gif, frames: Iterable[Frame] | None = None) -> Iterator[np.ndarray]:
    """The canvas after each frame, height x width x (red, green, blue, seen). It is the same array each time if frames come one by one."""
    canvas = None
    for frame in gif.frames if frames is None else frames:
        if canvas is None:
            canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
        before = canvas.copy() if frame.disposal == 3 else None
        rows, cols = slice(frame.top, frame.top + frame.height), slice(frame.left, frame.left + frame.width)
        area = canvas[rows, cols]
        index = np.frombuffer(frame.pixels, np.uint8).reshape(frame.height, frame.width)[: area.shape[0], : area.shape[1]]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(frame.palette), :3] = frame.palette[:256]
        colours[:, 3] = 1
        drawn = colours[index]
        if frame.transparent is not None:
            drawn = np.where((index == frame.transparent)[..., None], area, drawn)
        canvas[rows, cols] = drawn
        yield canvas.copy() if frames is None else canvas
        if frame.disposal == 2:
            canvas[rows, cols] = 0
        elif before is not None:
            canvas = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """65 counts: 64 boxes of 4 levels of each colour, then pixels not seen."""
    flat = canvas.reshape(-1, 4)
    box = (flat[:, 0] >> 6).astype(np.int64) * 16 + (flat[:, 1] >> 6) * 4 + (flat[:, 2] >> 6)
    return np.bincount(np.where(flat[:, 3] > 0, box, 64), minlength=65)


FRAME_INTS = ("index", "delay_cs", "disposal", "transparent", "left", "top", "width", "height")
ARROW_FRAMES = pa.list_(pa.struct([*[(n, pa.int32()) for n in FRAME_INTS], ("histogram", pa.list_(pa.int32()))]))
SQL_FRAMES = f"array<struct<{', '.join(p.replace(' ', ':', 1) for p in FRAMES.split(', '))}>>"


def timed(data: bytes | None, gif: Gif, max_pixels: int = MAX_PIXELS) -> Iterator[tuple[Frame, dict]]:
    """Each frame and its row of FRAMES; gif gets the screen's properties and the error."""
    frame: Frame | None = None

    def one() -> Iterator[Frame]:
        nonlocal frame
        for frame in frames_of(data, gif, max_pixels):
            yield frame

    for i, canvas in enumerate(composed(gif, one())):
        row = {"index": i} | {n: getattr(frame, n) for n in FRAME_INTS[1:]}
        yield frame, row | {"histogram": histogram(canvas).tolist()}


def gif_frames(media: DataFrame, media_col: str = "media", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """media's columns with gif_width, gif_height, gif_loops, gif_error and gif_frames, an array of timed frames with their histograms."""

    @F.arrow_udf(f"struct<width:int,height:int,loops:int,error:string,frames:{SQL_FRAMES}>")
    def read(column: pa.Array) -> pa.Array:
        out = []
        for data in column:
            gif = Gif()
            frames = [row for _, row in timed(data.as_py(), gif, max_pixels)]
            out.append({"width": gif.width, "height": gif.height, "loops": gif.loops, "error": gif.error, "frames": frames})
        return pa.array(out, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("loops", pa.int32()), ("error", pa.string()), ("frames", ARROW_FRAMES)]))

    got = read(col(media, media_col))
    return media.withColumn("gif", got).select(*[F.col(f"`{c}`") for c in media.columns], *[F.col(f"gif.{n}").alias(f"gif_{n}") for n in ("width", "height", "loops", "error", "frames")])


def padded(text: bytes, block: int = BLOCK) -> bytes:
    return text + bytes([PADDING]) * (-len(text) % block if text else block)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature(frames: list[dict]) -> str:
    """Frames, their time, and how many 1/1000 of the seen pixels of all frames are in each quarter of the greys."""
    total = np.zeros(65, np.int64)
    for f in frames:
        total += f["histogram"]
    share = total[[0, 21, 42, 63]] * 1000 // max(int(total[:64].sum()), 1)
    return f"{len(frames)} frames, {sum(f['delay_cs'] for f in frames)} cs, grey {'/'.join(map(str, share))}"


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the table (doc_id, n_bytes, media) of the texts as GIFs to the shared folder and returns it, read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in batch.column(1)]
            media = pa.array((encode(padded(t)) for t in texts), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), media], ["doc_id", "n_bytes", "media"])

    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), whole(col(docs, text_col)).alias("text"))
    return materialize(rows.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "gifs", "zstd")


def documents_as_gif(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Each text stored as a GIF and read back: DIGEST's columns and frames (and media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2):
                media = media.as_buffer().to_pybytes()
                gif, frames, sha, n, tail = Gif(), [], hashlib.sha256(), 0, b""
                for frame, row in timed(media, gif):
                    frames.append(row)
                    sha.update(frame.pixels)
                    n += len(frame.pixels)
                    tail = (tail + frame.pixels[-32:])[-32:]
                if gif.error:
                    raise ValueError(gif.error)
                rows.append((n, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature(frames), frames, media))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), ARROW_FRAMES, pa.binary())
            names = [x.split()[0] for x in DIGEST.split(", ")] + ["frames", "media"]
            got = [pa.array([r[i] for r in rows], kinds[i]) for i in range(7 + with_media)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *got], names[: 9 + with_media])

    stored = store_documents(docs, id_col, text_col)
    return stored.mapInArrow(run, f"{DIGEST}, frames {SQL_FRAMES}" + ", media binary" * with_media)
