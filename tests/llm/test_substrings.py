"""Substring dedup against a plain version over all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from scenelake.llm import substrings


def plain(rows, k=50):
    least = -(1 << 63)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        i = least if i is None else i
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < (least if i is None else i):
                gone.update(range(p, p + k))
        rest = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(rest.encode()).hexdigest()))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, h1 string, n int")
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(df).collect())


def passage(rng, n):
    return [rng.choice(["é", "word", "a", "Zebra", "x" * 9]) + str(rng.randrange(50)) for _ in range(n)]


def mixed():
    rng = random.Random(11)
    shared = [passage(rng, n) for n in (50, 49, 51, 120, 300)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += rng.choice(shared) if rng.random() < 0.6 else passage(rng, rng.randrange(0, 90))
            if rng.random() < 0.3:
                part = rng.choice(shared)
                text += part[rng.randrange(30) : len(part) - rng.randrange(10)]
        rows.append((rng.randrange(1000), "".join(w + rng.choice([" ", "\t", "\n\n", " \x0b"]) for w in text)))
    return rows


CASES = {
    "mixed": mixed(),
    "copies": [(i, " ".join(passage(random.Random(i % 3), 40 + 20 * (i % 3)))) for i in range(40)],
    "periodic": [(i, "a " * n) for i, n in enumerate((49, 50, 51, 400, 399))] + [(9, "a b " * 100), (8, "b a " * 90)],
    "odd": [(1, None), (2, ""), (3, " \n\t"), (4, "   x"), (None, "w " * 60), (5, "w " * 60), (5, "w " * 70), (None, "w " * 60)],
    "ids": [(1, "p q " * 40), (1, "q p " * 40), (1, "p q " * 40), (-5, "z " * 60), (2, "p " + "z " * 60 + "q")],
    "long words": [(1, " ".join(["y" * 5000, *("s" * i for i in range(1, 60))])), (2, " ".join(["y" * 5001, *("s" * i for i in range(1, 60))]))],
    "empty": [],
}


@pytest.mark.parametrize("case", list(CASES))
def test_kept_words_against_plain(spark, case):
    assert run(spark, CASES[case]) == plain(CASES[case])


def test_hot_edges_and_texts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr("scenelake.llm.lines.HOT", 15)
    rng = random.Random(2)
    shared = " ".join(passage(rng, 70))
    rows = [(i, f"{' '.join(passage(rng, 9))} {shared} {i}") for i in range(60)] + [(100 + i, shared) for i in range(40)]
    assert run(spark, rows) == plain(rows)


def test_a_very_long_text(spark):
    rng = random.Random(4)
    words = passage(rng, 60_000)
    rows = [(1, " ".join(words)), (2, " ".join(words[20_000:50_000] + ["!"] + words[:100]))]
    found = run(spark, rows)
    assert [r[:3] for r in found] == [("1", 60_000, 0), ("2", 30_101, 30_100)]
    assert found[1][3] == hashlib.sha256(b"!").hexdigest()


def test_runs_are_hashes_of_their_words():
    words = np.random.default_rng(1).integers(0, 5, 500).astype(np.uint64)
    for k in (1, 2, 3, 20, 50):
        found, keys = substrings.runs(words, k, substrings._BASES[0]), {}
        assert found.size == 500 - k + 1
        for p, h in enumerate(found.tolist()):
            assert keys.setdefault(tuple(words[p : p + k].tolist()), h) == h
        assert len(set(keys.values())) == len(keys)


def test_anchors_are_those_of_the_window():
    text = " ".join(passage(random.Random(8), 300))
    of = lambda t: (lambda w: substrings.anchors(w, w.hashes()))(substrings.Words([t]))
    places, found = of(text)
    for p in (0, 7, 250):
        alone = of(" ".join(text.split()[p : p + 50]))[1]
        assert alone.tolist() == [found[places.tolist().index(p)]]
    assert len(set(found.tolist())) < 0.15 * found.size


def test_passages_give_coordinates(spark):
    rng = random.Random(6)
    shared = passage(rng, 90)
    rows = [(1, " ".join(passage(rng, 10) + shared)), (2, " ".join(shared + passage(rng, 30))), (3, " ".join(passage(rng, 5) + shared + passage(rng, 5)))]
    _, texts = substrings.texts_of(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    places = substrings.places_of(texts, substrings.candidates(texts))
    found = substrings.paths(places, substrings.graph(places))
    long = [r for r in substrings.passages(found).collect() if r.length > 80]
    assert [(r["first"], r.a, r.length, r.n_texts) for r in long] == [(1, 10, 90, 3)]
