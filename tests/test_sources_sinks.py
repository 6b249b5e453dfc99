import json
import struct
import zlib

import numpy as np
import pytest

from scenelake import sinks
from scenelake.operators import spatial
from scenelake.sources import annotations, rasters
from scenelake.sources import jpeg as jpegs
from scenelake.streaming import presence as streams

ROOM = {"name": "Room_1", "polygon": [{"X": [0, 4, 4, 0], "Z": [0, 0, 4, 4], "Ymin": 0, "Ymax": 1.5}]}


def box(name, low, high, x=(1, 2, 2, 1), z=(1, 1, 2, 2)):
    return {"name": name, "polygon": [{"X": list(x), "Z": list(z), "Ymin": low, "Ymax": high}]}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("scenes")
    files = {
        "a/s1/annotation2Dfinal/index.json": json.dumps({"objects": [{"name": "Chair1 "}, {"name": "couch"}, None, {"name": 5}, {"polygon": []}, {"name": " "}]}),
        "a/s2/annotation2Dfinal/index.json": '{"objects": []}',
        "b/s1/annotation2Dfinal/index.json": '{"objects": [{"na',
        "a/s1/scene.txt": " office\n",
        "a/s1/intrinsics.txt": "500 0 100 0 510\n90 0 0 1",
        "a/s1/annotation3Dfinal/index.json": json.dumps({"objects": [box("chair:truncated", 0.2, 1.4), box("desk", 0.0, 1.0), box("low", 1.0, 1.7), box("flat", 1.0, 1.0), {"name": "none", "polygon": []}]}),
        "a/s1/annotation3Dlayout/index.json": json.dumps({"objects": [{"name": "room", "polygon": []}, ROOM]}),
        "b/s3/annotation3Dfinal/index.json": json.dumps({"objects": [box("bed", 0.2, 1.0)]}),
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_two_dimensional(spark, root):
    read = annotations.documents(spark, root, "annotation2Dfinal")
    assert tuple(annotations.counters(read).first()) == (2, 1, 1)
    assert sorted(r["class"] for r in annotations.names_2d(read).collect()) == ["chair", "sofa"]
    labels = {r.scene_path[-4:]: r.scene_type for r in annotations.scene_labels(spark, root, read).collect()}
    assert labels == {"a/s1": "office", "a/s2": "unknown", "b/s1": "unknown"}
    assert annotations.last_path_by_name(read).where("scene = 's1'").first().scene_path.endswith("b/s1")
    k = annotations.intrinsics(spark, root).first()
    assert (k.fx, k.cx, k.fy, k.cy) == (500.0, 100.0, 510.0, 90.0)


def test_three_dimensional(spark, root):
    scenes = annotations.scenes_3d(spark, root)
    features = spatial.object_features(scenes)
    got = {r.category: r for r in features.collect()}
    assert set(got) == {"chair", "desk", "low", "bed"}
    assert [(got[c].bottom_above_floor_m, got[c].on_floor) for c in ("chair", "desk", "low")] == [(0.1, True), (0.5, False), (-0.2, True)]
    assert got["bed"].bottom_above_floor_m is None and got["bed"].dist_to_wall_m is None and got["bed"].norm_cx is None
    assert (got["chair"].dist_to_wall_m, got["chair"].nearest_edge_dist_to_wall_m, got["chair"].norm_cx) == (1.5, 1.0, -0.25)
    summary = spatial.spatial_summary(features)
    assert summary.where("category = 'bed'").first().n_with_floor_data == 0
    assert spatial.bands(summary).where("category = 'chair'").first().floor_band == "floor"


def png(image, depth):
    h, w, c = image.shape
    raw = image.astype(">u2" if depth == 16 else np.uint8).tobytes()
    line = len(raw) // h
    step = c * depth // 8
    out, above = b"", bytes(line)
    for y in range(h):
        row = raw[y * line : (y + 1) * line]
        kind = y % 5
        left = bytes(step) + row[: line - step]
        corner = bytes(step) + above[: line - step]

        def guess(i):
            a, b, d = left[i], above[i], corner[i]
            p = a + b - d
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            return (0, a, b, (a + b) // 2, paeth)[kind]

        out += bytes([kind]) + bytes((row[i] - guess(i)) & 255 for i in range(line))
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", w, h, depth, {1: 0, 3: 2}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("depth, channels", [(8, 1), (8, 3), (16, 1)])
def test_png(spark, tmp_path, depth, channels):
    image = np.random.default_rng(2).integers(0, 1 << depth, (7, 5, channels))
    assert (rasters.decode_png(png(image, depth)) == image).all()
    (tmp_path / "x.png").write_bytes(png(image, depth))
    got = rasters.pixels(spark, str(tmp_path)).orderBy("v", "u").collect()
    assert [r.samples for r in got] == image.reshape(-1, channels).tolist()


def plain_png(samples, depth, colour, palette=b"", interlaced=0):
    """An unfiltered PNG of rows x columns samples of any depth."""
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    passes = rasters._PASSES if interlaced else ((0, 0, 1, 1),)
    out = b""
    for top, left, down, across in passes:
        part = samples[top::down, left::across]
        if part.size:
            for row in part:
                bits = "".join(format(int(x), f"0{depth}b") for x in row.reshape(-1))
                out += b"\0" + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    head = struct.pack(">IIBBBBB", samples.shape[1], samples.shape[0], depth, colour, 0, 0, interlaced)
    extra = chunk(b"PLTE", palette) if palette else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [0, 1])
@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
def test_png_of_any_depth_and_order(depth, interlaced):
    samples = np.random.default_rng(depth).integers(0, 1 << depth, (11, 13, 1))
    assert (rasters.decode_png(plain_png(samples, depth, 0, interlaced=interlaced)) == samples).all()
    if depth <= 8:
        colours = np.random.default_rng(1).integers(0, 256, (1 << depth, 3)).astype(np.uint8)
        got = rasters.decode_png(plain_png(samples, depth, 3, colours.tobytes(), interlaced))
        assert (got == colours[samples[..., 0]]).all()


def jpeg(image, sampling=1, every=0):
    """A baseline JPEG with quantisation 1 and codes of one length, of grey or RGB samples."""
    h, w, n = image.shape
    x = image.astype(float)
    if n == 3:
        r, g, b = np.moveaxis(x, 2, 0)
        y = 0.299 * r + 0.587 * g + 0.114 * b
        x = np.stack([y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402], 2)
    side = 8 * sampling
    rows, columns = -(-h // side), -(-w // side)
    x = np.pad(x, ((0, rows * side - h), (0, columns * side - w), (0, 0)), "edge")
    planes = [x[..., 0]] + [x[..., i].reshape(rows * 8, sampling, columns * 8, sampling).mean((1, 3)) for i in range(1, n)]
    acs = [0x00, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11)]
    bits, last, out = [], [0] * n, []

    def number(value):
        size = abs(value).bit_length()
        return size, format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""

    def block(i, samples):
        c = np.rint(jpegs._DCT @ (samples - 128) @ jpegs._DCT.T).astype(int).reshape(64)[jpegs.ZIGZAG]
        size, text = number(int(c[0]) - last[i])
        last[i] = int(c[0])
        bits.append(format(size, "04b") + text)
        run = 0
        for k in range(1, 64):
            if not c[k]:
                run += 1
                continue
            while run > 15:
                bits.append(format(acs.index(0xF0), "08b"))
                run -= 16
            size, text = number(int(c[k]))
            bits.append(format(acs.index(run << 4 | size), "08b") + text)
            run = 0
        if run:
            bits.append(format(acs.index(0), "08b"))

    def close():
        text = "".join(bits)
        text += "1" * (-len(text) % 8)
        out.append(int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00") if text else b"")
        bits.clear()

    for unit in range(rows * columns):
        if every and unit and unit % every == 0:
            close()
            out.append(bytes([0xFF, 0xD0 + (unit // every - 1) % 8]))
            last[:] = [0] * n
        y, x0 = divmod(unit, columns)
        for i in range(n):
            s = sampling if i == 0 else 1
            for down in range(s):
                for across in range(s):
                    a, b = 8 * (y * s + down), 8 * (x0 * s + across)
                    block(i, planes[i][a : a + 8, b : b + 8])
    close()
    seg = lambda m, d: bytes([0xFF, m]) + struct.pack(">H", len(d) + 2) + d
    frame = struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([i + 1, 0x11 * (sampling if i == 0 else 1), 0]) for i in range(n))
    tables = bytes([0]) + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)) + bytes([0x10]) + bytes([0] * 7 + [len(acs)] + [0] * 8) + bytes(acs)
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC0, frame) + seg(0xC4, tables)
    head += seg(0xDD, struct.pack(">H", every)) if every else b""
    scan = bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\0\x3f\0"
    return head + seg(0xDA, scan) + b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("channels, sampling, every", [(1, 1, 0), (3, 1, 0), (3, 2, 0), (3, 1, 2), (3, 2, 3)])
def test_jpeg(spark, tmp_path, channels, sampling, every):
    v, u = np.indices((37, 29))
    image = np.stack([(3 * u + 2 * v + 60 * i) % 200 if sampling == 1 else (u + v + 20 * i) * 2 for i in range(channels)], 2).astype(np.uint8)
    data = jpeg(image, sampling, every)
    off = np.abs(rasters.decode_image(data, "x.jpg").astype(int) - image)
    assert off.max() <= (3 if sampling == 1 else 8) and off.mean() < 1.6
    if every:
        (tmp_path / "x.jpg").write_bytes(data)
        assert rasters.pixels(spark, str(tmp_path), "*.jpg").count() == image.shape[0] * image.shape[1]


def test_what_is_no_sound_image_is_refused():
    sound = jpeg(np.zeros((8, 8, 1), np.uint8))
    for data in (b"GIF89a", b"\xff\xd8\xff\xd9", sound.replace(b"\xff\xc0", b"\xff\xc2"), b"\x89PNG\r\n\x1a\n"):
        with pytest.raises(ValueError):
            rasters.decode_image(data, "x")


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([("a", "b", 2), ("b", "a", 2)], "class_i string, class_j string, n long")
    wide = sinks.square_matrix(cells, "n", ["b", "a"])
    assert [tuple(r) for r in wide.collect()] == [("b", 0, 2), ("a", 2, 0)]
    sinks.write_csv(wide, str(tmp_path / "m"), single=True)
    back = annotations.matrix_csv(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.collect())) == [("a", "a", 0.0), ("a", "b", 2.0), ("b", "a", 2.0), ("b", "b", 0.0)]
    assert sinks.report("T", [("cells", cells)]).startswith("# T\n\n## cells\n\n| class_i | class_j | n |")
    assert sinks.stamped(cells).columns[0] == "run_timestamp"


def test_stream(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 01:00:00", 1, "a"), ("2024-01-01 02:00:00", 1, "a"), ("2024-01-01 03:00:00", 1, "b")], "ts string, user long, kind string")
    events.selectExpr("cast(ts as timestamp) ts", "user", "kind").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user long, kind string").parquet(str(tmp_path / "in"))
    for name, df, want in (("p", streams.stream_presence(stream, "ts", "user", "kind"), 2), ("w", streams.windowed_frequency(stream, "ts", "kind"), 2)):
        mode = "append" if name == "p" else "complete"
        run = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        run.awaitTermination()
        assert spark.table(name).count() == want
