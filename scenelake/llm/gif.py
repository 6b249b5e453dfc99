"""GIF media columns: code streams, palettes, disposal, transparency, timed frames.

:func:`parse` reads a whole file: header, screen, extensions, image blocks.
:func:`lzw_decode` decodes one code stream; :func:`compose` applies palettes,
transparency and disposal, frame after frame. :func:`decode_gif` puts these
together and gives each shown frame with its time and a colour histogram.

:func:`write_gif` stores bytes losslessly as 8-bit samples: rows of 64 samples,
in frames of at most ``FRAME_ROWS`` rows below each other, under a grey palette.

Defined results:
- null and empty media give no frames, with ``error`` set to "empty";
- a file that breaks off or breaks the format gives the frames read before
  that point, and ``error`` names the fault;
- a file whose screen has more than ``SCREEN`` pixels gives no frames, and one
  whose images have more than ``PIXELS`` together gives those before that point,
  with ``error`` "too large": sizes are 16-bit claims of the file, for which
  nothing is set aside before this is checked;
- a code stream that goes on behind an image's last sample is read no further;
- repeated rows are decoded each for itself, an empty table gives no rows;
- further columns are not read, whatever their names; a kept column that is named
  like an added one stays, and the added one gets the prefix ``gif_``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, map_batches, map_text, slices

WIDTH, FRAME_ROWS, DELAY = 64, 1024, 10
#: A histogram counts the pixels of each of 4 x 4 x 4 colours.
LEVELS = 4
#: Pixels of a screen, and of all images of a file, that are decoded at most.
SCREEN, PIXELS = 1 << 24, 1 << 26
_GREY = bytes(v for i in range(256) for v in (i, i, i))


@dataclass
class Image:
    """One image block with its control block."""

    left: int
    top: int
    width: int
    height: int
    indices: np.ndarray
    palette: np.ndarray
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Gif:
    """A parsed file."""

    width: int = 0
    height: int = 0
    loops: int | None = None
    images: list[Image] = field(default_factory=list)
    error: str | None = None


def lzw_decode(data: bytes, bits: int, expected: int) -> tuple[bytes, bool]:
    """Decode a code stream of ``bits``-wide samples; also whether it was whole.

    Codes are read in stretches of one width: all codes of a stretch are cut out
    of the bit string at once, then the table grows by one entry for each.
    """
    clear, stop = 1 << bits, (1 << bits) + 1
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    stream = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    limit, at = 8 * len(data), 0
    out: list[bytes] = []
    made = 0
    table, width, before = roots[:], bits + 1, b""
    while True:
        room = (1 << width) - len(table) + (not before) if width < 12 else 4096
        n = min(max(1, room), (limit - at) // width)
        if n <= 0:
            return b"".join(out)[:expected], made >= expected
        offsets = at + width * np.arange(n)
        byte = offsets >> 3
        word = stream[byte] | stream[byte + 1] << 8 | stream[byte + 2] << 16
        codes = (word >> (offsets & 7).astype(np.uint32) & ((1 << width) - 1)).tolist()
        for i, code in enumerate(codes):
            if code == clear:
                at += width * (i + 1)
                table, width, before = roots[:], bits + 1, b""
                break
            if code == stop:
                return b"".join(out)[:expected], made >= expected
            if before:
                if code < len(table):
                    entry = table[code]
                elif code == len(table) and len(table) < 4096:
                    entry = before + before[:1]
                else:
                    return b"".join(out)[:expected], False
                if len(table) < 4096:
                    table.append(before + entry[:1])
            else:
                if code >= clear:
                    return b"".join(out)[:expected], False
                entry = table[code]
            out.append(entry)
            made += len(entry)
            before = entry
        else:
            at += width * n
            if made >= expected:
                return b"".join(out)[:expected], True
            if width < 12 and len(table) >= 1 << width:
                width += 1


def _cut(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """The joined sub-blocks from ``at``, the place behind them, and whether they were whole."""
    parts = []
    while at < len(data):
        n = data[at]
        at += 1
        if n == 0:
            return b"".join(parts), at, True
        parts.append(data[at : at + n])
        at += n
    return b"".join(parts), min(at, len(data)), False


def _palette(data: bytes, at: int, size: int) -> np.ndarray:
    colours = np.zeros((256, 3), np.uint8)
    got = np.frombuffer(data[at : at + 3 * size], np.uint8)
    colours[: got.size // 3] = got[: got.size // 3 * 3].reshape(-1, 3)
    return colours


def _rows_in_order(height: int) -> np.ndarray:
    """The rows of an interlaced image in the order of the stream."""
    return np.concatenate([np.arange(first, height, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def parse(data: bytes | None, screen: int | None = SCREEN, pixels: int | None = PIXELS) -> Gif:
    """Read a file as far as it is sound, and within the bounds where there are any."""
    gif = Gif()
    if not data:
        gif.error = "empty"
        return gif
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        gif.error = "no GIF header"
        return gif
    gif.width, gif.height, flags = struct.unpack_from("<HHB", data, 6)
    if screen is not None and gif.width * gif.height > screen:
        gif.error = "too large"
        return gif
    at, common, held = 13, None, 0
    if flags & 128:
        size = 2 << (flags & 7)
        common = _palette(data, at, size)
        at += 3 * size
    control: dict = {}
    while True:
        if at >= len(data):
            gif.error = "no trailer"
            return gif
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return gif
        if kind == 0x21 and at < len(data):
            label = data[at]
            block, at, _ = _cut(data, at + 1)
            if label == 0xF9 and len(block) >= 4:
                control = {"disposal": block[0] >> 2 & 7, "delay": block[1] | block[2] << 8}
                control["transparent"] = block[3] if block[0] & 1 else None
            elif label == 0xFF and block[:11] in (b"NETSCAPE2.0", b"ANIMEXTS1.0") and len(block) >= 14:
                gif.loops = block[12] | block[13] << 8
        elif kind == 0x2C and at + 9 < len(data):
            left, top, width, height, flags = struct.unpack_from("<HHHHB", data, at)
            at += 9
            held += width * height
            if pixels is not None and held > pixels:
                gif.error = "too large"
                return gif
            palette = common
            if flags & 128:
                size = 2 << (flags & 7)
                palette = _palette(data, at, size)
                at += 3 * size
            if palette is None:
                palette = np.frombuffer(_GREY, np.uint8).reshape(-1, 3)
            if at >= len(data) or not 1 <= data[at] <= 8:
                gif.error = "bad code size"
                return gif
            stream, after, whole = _cut(data, at + 1)
            decoded, sound = lzw_decode(stream, data[at], width * height)
            at = after
            samples = np.zeros(width * height, np.uint8)
            samples[: len(decoded)] = np.frombuffer(decoded, np.uint8)
            indices = samples.reshape(height, width)
            if flags & 64:
                straight = np.empty_like(indices)
                straight[_rows_in_order(height)] = indices
                indices = straight
            if not (sound and whole):
                gif.error = "bad code stream"
                return gif
            gif.images.append(Image(left, top, width, height, indices, palette, **control))
            control = {}
        else:
            gif.error = "bad block"
            return gif


def compose(gif: Gif):
    """Yield (time in hundredths, delay, RGBA canvas) for each image, as it is shown."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    time = 0
    for image in gif.images:
        rows = slice(image.top, min(image.top + image.height, gif.height))
        columns = slice(image.left, min(image.left + image.width, gif.width))
        saved = canvas.copy() if image.disposal == 3 else None
        part = canvas[rows, columns]
        indices = image.indices[: part.shape[0], : part.shape[1]]
        drawn = np.empty((*indices.shape, 4), np.uint8)
        drawn[..., :3] = image.palette[indices]
        drawn[..., 3] = 255
        if image.transparent is None:
            part[:] = drawn
        else:
            seen = indices != image.transparent
            part[seen] = drawn[seen]
        yield time, image.delay, canvas
        time += image.delay
        if image.disposal == 2:
            canvas[rows, columns] = 0
        elif image.disposal == 3:
            canvas = saved


def histogram(canvas: np.ndarray) -> list[int]:
    """Opaque pixels of each of the 64 coarse colours."""
    step = 256 // LEVELS
    coarse = (canvas[..., :3] // step).reshape(-1, 3)
    key = coarse[:, 0] * (LEVELS * LEVELS) + coarse[:, 1] * LEVELS + coarse[:, 2]
    return np.bincount(key[canvas[..., 3].reshape(-1) > 0], minlength=LEVELS**3).tolist()


def decode_gif(data: bytes | None) -> tuple[Gif, list[dict]]:
    """The file, and its frames: time, delay, histogram, sha256 of the shown RGBA pixels."""
    gif = parse(data)
    frames = [
        {"time": t, "delay": d, "histogram": histogram(c), "pixels_sha256": hashlib.sha256(c.tobytes()).hexdigest()}
        for t, d, c in compose(gif)
    ]
    return gif, frames


def lzw_encode(samples: bytes) -> bytes:
    """A compressed code stream of 8-bit samples, with a clear code when the table is full."""
    codes: list[int] = [256]
    table: dict[int, int] = {}
    put, find = codes.append, table.get
    free, start = 258, 0
    stretches: list[tuple[int, int]] = []
    current = -1
    for sample in samples:
        if current < 0:
            current = sample
            continue
        key = current << 8 | sample
        code = find(key)
        if code is not None:
            current = code
            continue
        put(current)
        current = sample
        if free < 4095:
            table[key] = free
            free += 1
        else:
            put(256)
            stretches.append((start, len(codes)))
            start = len(codes)
            table.clear()
            free = 258
    if current >= 0:
        put(current)
    put(257)
    stretches.append((start, len(codes)))
    sizes = np.empty(len(codes), np.int64)
    for a, b in stretches:
        # A stretch begins behind a clear code; the decoder's table holds 258 entries and then one
        # more with each code but the first.
        first = a if a else 1
        grown = 258 + np.arange(b - first) - 1
        sizes[first:b] = np.maximum(9, np.ceil(np.log2(np.maximum(grown, 258) + 1)).astype(np.int64))
    sizes[0] = 9
    return _pack(np.array(codes, np.uint64), sizes)


def _pack(codes: np.ndarray, sizes: np.ndarray) -> bytes:
    """Codes of up to 12 bits as a bit string, the low bits first."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.zeros(int(ends[-1] + 7) // 8 + 4, np.uint8)
    shifted = codes << (starts & 7).astype(np.uint64)
    byte = starts >> 3
    for i in range(3):
        np.bitwise_or.at(out, byte + i, (shifted >> np.uint64(8 * i) & np.uint64(255)).astype(np.uint8))
    return out[: int(ends[-1] + 7) // 8].tobytes()


def _blocks(stream: bytes) -> bytes:
    parts = [bytes([len(p)]) + p for i in range(0, len(stream), 255) if (p := stream[i : i + 255])]
    return b"".join(parts) + b"\0"


def write_gif(payload: bytes) -> bytes:
    """Store a payload, a positive multiple of 64 bytes, as a grey animation of 64 columns."""
    rows = len(payload) // WIDTH
    screen = min(rows, FRAME_ROWS)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, screen, 0xF7, 0, 0), _GREY]
    out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    for first in range(0, rows, FRAME_ROWS):
        height = min(FRAME_ROWS, rows - first)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, height, 0) + b"\x08")
        out.append(_blocks(lzw_encode(payload[first * WIDTH : (first + height) * WIDTH])))
    out.append(b"\x3b")
    return b"".join(out)


def read_payload(gif: Gif) -> bytes:
    """The stored samples of all images, in order."""
    return b"".join(image.indices.tobytes() for image in gif.images)


_FRAMES = "array<struct<time:int,delay:int,histogram:array<int>,pixels_sha256:string>>"


def media_columns(media: DataFrame, keep: list[str], data_col: str = "data") -> DataFrame:
    """``keep`` columns, ``width``, ``height``, ``loops``, ``error`` and ``frames`` of GIF files."""
    names = [f"__k{i}" for i in range(len(keep))]
    narrow = media.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(data_col).alias("__data"))
    added = media.sparkSession.createDataFrame([], f"width int, height int, loops int, error string, frames {_FRAMES}").schema
    schema = type(added)(narrow.schema.fields[:-1] + added.fields)
    frame = pa.struct(
        [("time", pa.int32()), ("delay", pa.int32()), ("histogram", pa.list_(pa.int32())), ("pixels_sha256", pa.string())]
    )

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                got = [decode_gif(data) for data in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1],
                        pa.array([g.width for g, _ in got], pa.int32()),
                        pa.array([g.height for g, _ in got], pa.int32()),
                        pa.array([g.loops for g, _ in got], pa.int32()),
                        pa.array([g.error for g, _ in got], pa.string()),
                        pa.array([f for _, f in got], pa.list_(frame)),
                    ],
                    names=schema.names,
                )

    shown = [*keep, *[f"gif_{c}" if c in keep else c for c in added.names]]
    return in_small_batches(map_batches(narrow, run, schema)).toDF(*shown)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The size of a text in bytes, and its bytes filled up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")


def stored(text: str | None) -> tuple:
    """Store a text as a GIF, read the file back, and describe it."""
    n, payload = payload_of(text)
    media = write_gif(payload)
    gif = parse(media, None, None)
    back = read_payload(gif)
    colours = np.zeros(LEVELS**3, np.int64)
    for _, _, canvas in compose(gif):
        colours += histogram(canvas)
    grey = colours[:: LEVELS * LEVELS + LEVELS + 1]  # equal levels of red, green and blue
    feature = f"{len(gif.images)}x{gif.width}x{gif.height}:" + ",".join(map(str, grey.tolist()))
    return (
        n,
        len(back),
        hashlib.sha256(back).hexdigest(),
        zlib.crc32(back[-WIDTH:]),
        len(media),
        hashlib.sha256(media).hexdigest(),
        feature,
    )


def op7_gif(spark, sf_dir: str) -> DataFrame:
    """Contract query: store every whole document as a GIF and read it back."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def start():
        def work(texts: list) -> list[pa.Array]:
            return [pa.array(c, k) for c, k in zip(zip(*map(stored, texts)), kinds)]

        return work

    schema = (
        "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )
    return map_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], "text", schema, start)
