"""Vector codes against a plain version."""

import math
import random

import numpy as np
import pytest

from scenelake.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def plain(rows, parts=16, entries=64, rounds=2):
    """``(id, code, error, label error)`` and the codebooks, by loops over all entries."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max([len(v) for _, v, _ in kept], default=0) // parts)) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    n = width // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * n : p * n + n] for r in first] for p in range(parts)]

    def near(book, q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), e) for e, c in enumerate(book))

    for _ in range(rounds if kept else 0):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                q = v[p * n : p * n + n]
                members.setdefault(near(books[p], q)[1], []).append(q)
            books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e])] if e in members else c for e, c in enumerate(books[p])]
    coded = []
    for i, v, label in kept:
        found = [near(books[p], v[p * n : p * n + n]) for p in range(parts)]
        coded.append((i, "".join(f"{e:02x}" for _, e in found), min((1 << 63) - 1, sum(d for d, _ in found)), label))
    sums = {}
    for _, _, error, label in coded:
        sums[label] = sums.get(label, 0) + error
    return sorted((str(i), code, error, min((1 << 63) - 1, sums[label])) for i, code, error, label in coded), books


def run(spark, rows):
    df = spark.createDataFrame([(i, v, label, "clash") for i, v, label in rows], SCHEMA)
    coded, books = vectors.compress(df)
    return sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in coded.collect()), books


def cases():
    rng = random.Random(5)
    many = [(i, [rng.gauss(0, 0.3) for _ in range(64)], rng.choice([None, 1, 2])) for i in range(150)]
    many += [(7, [0.5] * 64, 1), (7, [0.5] * 64, 1), (None, [-0.25] * 64, 3)]
    many += [(900, None, 1), (901, [float("nan")] + [0.0] * 63, 1), (902, [float("inf")] * 64, 1), (903, [None] * 64, 2)]
    coarse = [(i, [rng.choice([0.0, 1 / 256, -1 / 256]) for _ in range(32)], 0) for i in range(120)]
    mixed = [(1, [], 0), (2, [1.0], 0), (3, [0.5] * 20, 1), (4, [2.0e30] * 16, 1), (5, [-3.0e9] * 17, None)]
    return {"many": many, "ties": coarse, "lengths and sizes": mixed, "one": [(3, [0.1] * 16, None)], "empty": []}


@pytest.mark.parametrize("case", list(cases()))
def test_codes_against_plain(spark, case):
    rows = cases()[case]
    if case == "lengths and sizes":  # integers are cut to 64 bits
        rows = [(i, [min(x, 2.0**54) for x in v], label) for i, v, label in rows]
    expected, books = plain(rows)
    found, fitted = run(spark, rows)
    assert found == expected
    assert [b.tolist() for b in fitted] == books


def test_cells_open_few_and_miss_none():
    rng = np.random.default_rng(3)
    entries = rng.integers(-200, 200, (64, 4))
    asked = rng.integers(-250, 250, (3000, 4))
    entry, distance, opened = vectors.Cells(entries).nearest(asked)
    full = ((asked[:, None] - entries[None]) ** 2).sum(2)
    assert (entry == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert opened < 0.25 * full.size


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    rows = cases()["many"][:150]
    found, books = run(spark, rows)
    of = {str(i): [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _ in rows}
    for i, code, error, _ in found:
        assert sum((a - b) ** 2 for a, b in zip(of[i], vectors.decode(code, books))) == error


def test_labels_beyond_the_broadcast_are_dealt_out(spark, monkeypatch):
    rows = cases()["many"]
    expected, _ = plain(rows)
    monkeypatch.setattr(vectors, "small", lambda df: df)
    monkeypatch.setattr("scenelake.llm.lines.HOT", 20)
    assert run(spark, rows)[0] == expected
