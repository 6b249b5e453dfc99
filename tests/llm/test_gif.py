import random
import struct
import zlib

import numpy as np

from scenelake.llm import gif


def write(frames, width, height, palette, loops=0):
    """A small general GIF writer: frames of (left, top, indices, delay, disposal, transparent, palette, interlaced)."""
    size = max(1, (len(palette) - 1).bit_length())
    pad = lambda p, n: b"".join(map(bytes, p)) + bytes(3 * ((1 << n) - len(p)))
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | size - 1, 0, 0) + pad(palette, size)
    out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0\x21\xfe\x03abc\0"
    for left, top, indices, delay, disposal, transparent, own, interlaced in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0"
        flags = (0x80 | 1 if own else 0) | (0x40 if interlaced else 0)
        out += b"\x2c" + struct.pack("<HHHHB", left, top, indices.shape[1], indices.shape[0], flags) + (pad(own, 2) if own else b"")
        rows = indices[gif._rows_in_order(indices.shape[0])] if interlaced else indices
        out += b"\x02" + gif._blocks(encode(rows.astype(np.uint8).tobytes(), 2))
    return out + b"\x3b"


def encode(samples, bits):
    """Reference LZW encoder, code by code."""
    clear, table, width, value, n, out = 1 << bits, {}, bits + 1, 0, 0, bytearray()

    def put(code):
        nonlocal value, n
        value |= code << n
        n += width
        while n >= 8:
            out.append(value & 255)
            value >>= 8
            n -= 8

    put(clear)
    table = {bytes([i]): i for i in range(clear)}
    word, free = b"", clear + 2
    for s in samples:
        longer = word + bytes([s])
        if longer in table:
            word = longer
            continue
        put(table[word])
        if free < 4096:
            table[longer] = free
            if free == 1 << width and width < 12:
                width += 1
            free += 1
        word = bytes([s])
    put(table[word])
    if free == 1 << width and width < 12:
        width += 1
    put(clear + 1)
    return bytes(out) + bytes([value & 255])


def test_code_streams():
    rng = random.Random(2)
    for bits in (2, 4, 8):
        for n in (1, 2, 3, 50, 5000, 60_000):
            for kinds in (1, 2, 1 << bits):
                samples = bytes(rng.randrange(kinds) for _ in range(n))
                assert gif.lzw_decode(encode(samples, bits), bits, n) == (samples, True)
                if bits == 8:
                    assert gif.lzw_decode(gif.lzw_encode(samples), 8, n) == (samples, True)


def test_broken_streams_are_named():
    whole = gif.write_gif(bytes(range(64)) * 3)
    for cut in range(0, len(whole) - 1, 37):
        assert gif.parse(whole[:cut]).error is not None
    assert gif.parse(None).error == "empty" and gif.parse(b"PNG").error == "no GIF header"
    assert gif.lzw_decode(b"\xff\xff\xff", 2, 4)[1] is False


def test_disposal_transparency_and_time():
    black, red, green, blue = (0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)
    full, dot = np.ones((4, 4), int), np.array([[2, 0], [0, 2]])
    frames = [
        (0, 0, full, 10, 1, None, None, True),
        (1, 1, dot, 20, 2, 0, None, False),
        (0, 0, np.full((1, 1), 3), 30, 3, None, None, False),
        (3, 3, np.full((2, 2), 1), 40, 0, None, [black, blue, red, red], False),
    ]
    parsed, shown = gif.decode_gif(write(frames, 4, 4, [black, red, green, blue], 5))
    assert parsed.error is None and parsed.loops == 5
    assert [(f["time"], f["delay"]) for f in shown] == [(0, 10), (10, 20), (30, 30), (60, 40)]
    name = {red: "r", green: "g", blue: "b"}
    views = ["".join(name.get(tuple(p[:3]), "?") if p[3] else "." for p in c.reshape(-1, 4).tolist()) for _, _, c in gif.compose(parsed)]
    assert views == ["r" * 16, "rrrr" "rgrr" "rrgr" "rrrr", "brrr" "r..r" "r..r" "rrrr", "rrrr" "r..r" "r..r" "rrrb"]
    assert sum(shown[2]["histogram"]) == 12


def test_round_trip_of_texts(spark):
    texts = [None, "", "a" * 64, "é" * 33, "x" * 70_000, "".join(map(chr, range(32, 900))) * 90]
    for text in texts:
        n, payload = gif.payload_of(text)
        got = gif.stored(text)
        assert got[0] == len((text or "").encode()) and got[1] == len(payload) and len(payload) % 64 == 0
        assert got[3] == zlib.crc32(payload[-64:])
        parsed = gif.parse(gif.write_gif(payload))
        assert parsed.error is None and gif.read_payload(parsed) == payload
    media = spark.createDataFrame([(1, gif.write_gif(b"\x80" * 64), "x"), (2, None, "y"), (2, b"junk", None)], "id long, data binary, frames string")
    rows = {(r.id, r.error): r for r in gif.media_columns(media, ["id"]).collect()}
    assert set(rows) == {(1, None), (2, "empty"), (2, "no GIF header")}
    assert sum(rows[1, None].frames[0].histogram) == 64
    assert gif.media_columns(media.limit(0), ["id"]).count() == 0


def claim(width, height, image=None):
    """A file of a few bytes that claims a screen, and an image, of any size."""
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0, 0, 0)
    for w, h in image or []:
        out += b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x02\x02\x4c\x01\x00"
    return out + b"\x3b"


def test_claims_of_size_are_bounded(spark):
    huge = gif.decode_gif(claim(65_535, 65_535, [(65_535, 65_535)]))
    assert huge[0].error == "too large" and huge[1] == []
    image = gif.decode_gif(claim(4, 4, [(1, 1), (65_535, 65_535)]))
    assert image[0].error == "too large" and len(image[1]) == 1
    rows = [("a", bytearray(claim(65_535, 65_535))), ("b", bytearray(gif.write_gif(b"x" * 64))), ("b", bytearray(gif.write_gif(b"x" * 64))), (None, None), ("", bytearray())]
    df = spark.createDataFrame([(n, d, 7) for n, d in rows], "frames string, data binary, error int")
    got = gif.media_columns(df, ["frames", "error"])
    assert got.columns == ["frames", "error", "width", "height", "loops", "gif_error", "gif_frames"]
    assert sorted(map(tuple, got.select("frames", "error", "gif_error").collect()), key=str) == sorted(
        [("a", 7, "too large"), ("b", 7, None), ("b", 7, None), (None, 7, "empty"), ("", 7, "empty")], key=str
    )
    assert len({str(r.gif_frames) for r in got.where("frames = 'b'").collect()}) == 1


def test_codes_behind_the_last_sample_are_not_read():
    stream = gif.lzw_encode(bytes(200_000))
    assert gif.lzw_decode(stream, 8, 10) == (bytes(10), True)


def test_long_texts_are_stored_whole():
    n, *_ = gif.stored("ab" * 3_000_000)
    assert n == 6_000_000
