"""Baseline JPEG files as samples."""

from __future__ import annotations

import re
import struct

import numpy as np

#: Places of the 64 coefficients of a block, diagonal by diagonal, in turn up and down.
ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k % 8 if (k // 8 + k % 8) % 2 == 0 else k // 8))
_k = np.arange(8)
_DCT = np.cos((2 * _k[None] + 1) * _k[:, None] * np.pi / 16) * np.where(_k == 0, np.sqrt(1 / 8), 0.5)[:, None]


class _Bits:
    """Bits of one stretch of entropy-coded data, the high ones first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff") + bytes(8), 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            self.held = (self.held << 32 | int.from_bytes(self.data[self.at : self.at + 4].ljust(4, b"\0"), "big")) & (1 << 64) - 1
            self.at += 4
            self.n += 32

    def symbol(self, table: tuple[np.ndarray, np.ndarray]) -> int:
        self.need(16)
        code = self.held >> self.n - 16 & 0xFFFF
        size = int(table[0][code])
        if not size:
            raise ValueError("bad code in a JPEG file")
        self.n -= size
        return int(table[1][code])

    def number(self, size: int) -> int:
        """A signed number of the given size."""
        if not size:
            return 0
        self.need(size)
        self.n -= size
        value = self.held >> self.n & (1 << size) - 1
        return value if value >> size - 1 else value - (1 << size) + 1


def _table(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Size and symbol for each 16 bits that begin with a code."""
    sizes, values = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code = place = 0
    for size, n in enumerate(counts, 1):
        for symbol in symbols[place : place + n]:
            span = 1 << 16 - size
            sizes[code : code + span], values[code : code + span] = size, symbol
            code += span
        place += n
    return sizes, values


def _coded_until(data: bytes, at: int) -> int:
    """The end of the entropy-coded data from ``at``: the next marker but a restart."""
    found = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
    return found.start() if found else len(data)


def _segments(data: bytes):
    """Yield marker, body and the place behind it, up to the end of the image."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            return
        (size,) = struct.unpack_from(">H", data, at + 2)
        at = at + 2 + size
        yield marker, data[at - size + 2 : at], at
        if marker == 0xDA:
            at = _coded_until(data, at)


def decode_jpeg(data: bytes) -> np.ndarray:
    """Height x width x channels (grey or RGB) of a sequential Huffman-coded file with 8 bits."""
    quant: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], tuple] = {}
    parts: list[dict] = []
    height = width = every = 0
    for marker, body, end in _segments(data):
        if marker == 0xDB:
            at = 0
            while at < len(body):
                wide, name = body[at] >> 4, body[at] & 15
                kind = ">u2" if wide else ">u1"
                quant[name] = np.frombuffer(body, kind, 64, at + 1).astype(np.int64)
                at += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            at = 0
            while at < len(body):
                counts = body[at + 1 : at + 17]
                tables[body[at] >> 4, body[at] & 15] = _table(counts, body[at + 17 : at + 17 + sum(counts)])
                at += 17 + sum(counts)
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or n not in (1, 3) or not (height and width):
                raise ValueError("unsupported JPEG layout")
            for i in range(n):
                name, sampling, table = body[6 + 3 * i : 9 + 3 * i]
                parts.append({"name": name, "h": sampling >> 4, "v": sampling & 15, "quant": table})
            tall, broad = 8 * max(p["v"] for p in parts), 8 * max(p["h"] for p in parts)
            rows, columns = -(-height // tall), -(-width // broad)
            for p in parts:
                p["blocks"] = np.zeros((rows * p["v"], columns * p["h"], 64), np.int64)
                # Blocks that hold samples, where the part is scanned alone.
                p["alone"] = (-(-height * p["v"] // tall), -(-width * p["h"] // broad))
        elif marker == 0xDD:
            (every,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            chosen = []
            for i in range(body[0]):
                name, use = body[1 + 2 * i], body[2 + 2 * i]
                part = next(p for p in parts if p["name"] == name)
                chosen.append((part, tables[0, use >> 4], tables[1, use & 15]))
            _scan(data, end, chosen, every, rows, columns)
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("unsupported JPEG coding")
    if not parts:
        raise ValueError("no image in the JPEG file")
    planes = []
    for p in parts:
        down, across = p["blocks"].shape[:2]
        square = np.zeros((down, across, 64))
        square[..., ZIGZAG] = p["blocks"] * quant[p["quant"]]
        samples = np.einsum("ki,yxkl,lj->yixj", _DCT, square.reshape(down, across, 8, 8), _DCT) + 128
        plane = samples.reshape(8 * down, 8 * across)
        plane = plane.repeat(tall // 8 // p["v"], 0).repeat(broad // 8 // p["h"], 1)
        planes.append(plane[:height, :width])
    if len(planes) == 3:
        y, b, r = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b]
    return np.clip(np.rint(np.stack(planes, 2)), 0, 255).astype(np.uint8)


def _scan(data: bytes, at: int, chosen: list, every: int, rows: int, columns: int) -> None:
    """Read the coefficients of one scan into the blocks of its parts."""
    stretches = re.split(rb"\xff[\xd0-\xd7]", data[at : _coded_until(data, at)])
    alone = len(chosen) == 1
    if alone:
        rows, columns = chosen[0][0]["alone"]
    per = every or rows * columns
    for s, stretch in enumerate(stretches):
        bits, before = _Bits(stretch), [0] * len(chosen)
        for unit in range(s * per, min((s + 1) * per, rows * columns)):
            y, x = divmod(unit, columns)
            for i, (part, dc, ac) in enumerate(chosen):
                h, v = (1, 1) if alone else (part["h"], part["v"])
                for down in range(v):
                    for across in range(h):
                        block = part["blocks"][y * v + down, x * h + across]
                        before[i] += bits.number(bits.symbol(dc))
                        block[0] = before[i]
                        k = 1
                        while k < 64:
                            symbol = bits.symbol(ac)
                            run, size = symbol >> 4, symbol & 15
                            if not size:
                                if run != 15:
                                    break
                                k += 16
                                continue
                            k += run
                            if k > 63:
                                raise ValueError("bad run in a JPEG file")
                            block[k] = bits.number(size)
                            k += 1
