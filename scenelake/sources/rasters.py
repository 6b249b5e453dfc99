"""Raster files as rows of pixels."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jpeg import decode_jpeg

_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


#: First row and column, and steps, of the seven passes of an interlaced file.
_PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def decode_png(data: bytes) -> np.ndarray:
    """Height x width x channels of a PNG of any depth, with or without palette and interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, packed, palette = 8, [], None
    width = height = depth = colour = interlaced = 0
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    channels = 1 if colour == 3 else _CHANNELS.get(colour)
    if channels is None or depth not in (1, 2, 4, 8, 16) or colour == 3 and palette is None:
        raise ValueError("unsupported PNG layout")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    out = np.zeros((height, width, channels), np.uint16 if depth == 16 else np.uint8)
    for top, left, down, across in _PASSES if interlaced else ((0, 0, 1, 1),):
        rows, columns = -(-max(0, height - top) // down), -(-max(0, width - left) // across)
        if rows and columns:
            line = 1 + (columns * channels * depth + 7) // 8
            out[top::down, left::across] = _samples(raw[: rows * line].reshape(rows, line), columns, channels, depth)
            raw = raw[rows * line :]
    return palette[out[..., 0]] if colour == 3 else out


def _samples(lines: np.ndarray, columns: int, channels: int, depth: int) -> np.ndarray:
    """The samples of filtered lines, each behind the number of its filter."""
    rows, size = lines.shape[0], lines.shape[1] - 1
    step = max(1, channels * depth // 8)
    above = np.zeros(size, np.uint8)
    out = np.empty((rows, size), np.uint8)
    for y in range(rows):
        out[y] = above = _unfilter(int(lines[y, 0]), lines[y, 1:], above, step)
    if depth == 16:
        out = out.reshape(-1).view(">u2").astype(np.uint16)
    elif depth < 8:
        bits = np.unpackbits(out, axis=1).reshape(rows, -1, depth)
        out = (bits @ (1 << np.arange(depth)[::-1]))[:, : columns * channels].astype(np.uint8)
    return out.reshape(rows, columns, channels)


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row.copy()
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), 0, dtype=np.uint8).reshape(-1)
    line, up = row.astype(int).tolist(), above.astype(int).tolist()
    for i, value in enumerate(line):
        left, corner = (line[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            p = left + up[i] - corner
            guess = min((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner))[2]
        line[i] = (value + guess) & 255
    return np.array(line, np.uint8)


def decode_image(data: bytes, path: str) -> np.ndarray:
    """Samples of a PNG or JPEG file, told apart by their first bytes."""
    if data[:2] == b"\xff\xd8":
        return decode_jpeg(data)
    if data[:4] == b"\x89PNG":
        return decode_png(data)
    raise ValueError(f"neither PNG nor JPEG: {path}")


def pixels(spark: SparkSession, root: str, glob: str = "*.png") -> DataFrame:
    """``file_path``, ``v``, ``u`` and ``samples`` (one for each channel) of all matching files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)

    def run(frames):
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"]):
                image = decode_image(data, path)
                v, u = np.indices(image.shape[:2])
                yield pd.DataFrame(
                    {"file_path": path, "v": v.ravel(), "u": u.ravel(), "samples": image.reshape(-1, image.shape[2]).tolist()}
                )

    return files.select("path", "content").mapInPandas(run, "file_path string, v int, u int, samples array<int>")


def depth_rows(raw: DataFrame, filled: DataFrame) -> DataFrame:
    """``v``, ``u``, ``depth_raw`` and ``depth_filled`` of the two rasters of one scene."""
    one = raw.select("v", "u", F.get("samples", F.lit(0)).alias("depth_raw"))
    return one.join(filled.select("v", "u", F.get("samples", F.lit(0)).alias("depth_filled")), ["v", "u"])
