import random
import re

import numpy as np

from scenelake.llm import jaccard
from scenelake.llm.components import connected_components
from scenelake.llm.shingles import shingle_sets


def plain_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(docs):
    sets = [(i, plain_set(t)) for i, t in docs]
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[top(a)] = top(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(s), least.get(top(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def world(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÄ") for _ in range(3))
    common = [word() for _ in range(30)]
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 12, 40, 90]))]
        for _ in range(rng.choice([1, 2, 5, 9])):
            copy = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    docs += [" ".join(common + [word() for _ in range(rng.choice([2, 10, 60]))]) for _ in range(20)]
    docs += [None, "", "\t \n", "one", "ONE", "one", "a b c d", "A  b\tc d", " ".join(["x"] * 4000)]
    rng.shuffle(docs)
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 4)
    monkeypatch.setattr(jaccard, "QUERIES", 3)
    monkeypatch.setattr(jaccard, "SHELF", 100)
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    for seed in (1, 2):
        docs = world(seed)
        df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, node int")
        got = sorted(map(tuple, jaccard.components(df).collect()), key=str)
        assert got == brute(docs)


def test_one_large_group_near_the_threshold(spark):
    """Copies of one text with so many changes each that most pairs are just not linked, and a word run in all."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    docs = []
    for i in range(900):
        copy = base[:]
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(40)}"
        docs.append((i, " ".join(copy)))
    docs += [(900 + i, " ".join(base[:30] + [f"own{i}x{k}" for k in range(20)])) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.components(df).collect()), key=str) == brute(docs)


def test_the_matrix_finds_links_between_shelves(spark, monkeypatch):
    """Chains of texts, each linked with its neighbours only, and parts of families that are a node and its leader."""
    made = {}
    write = jaccard.materialize

    def seen(df, name, **other):
        out = write(df, name, **other)
        if name in ("jaccard-families", "jaccard-rest", "jaccard-passed", "jaccard-unions", "jaccard-pairs"):
            made[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "materialize", seen)
    monkeypatch.setattr(jaccard, "QUERIES", 1)
    monkeypatch.setattr(jaccard, "SHELF", 500)
    monkeypatch.setattr(jaccard, "GROUP", 2)
    docs = [(1000 * c + i, " ".join(f"c{c}w{k}" for k in range(8 * i, 8 * i + 104))) for c in range(3) for i in range(40)]
    random.Random(7).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.components(df).collect()), key=str)
    assert got == brute(docs) and len({c for *_, c in got}) == 3
    assert made["jaccard-rest"] > made["jaccard-families"], made
    assert made["jaccard-unions"] > 3 and made["jaccard-passed"] > 0


def test_groups_count_like_plain_sets(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 5)
    rng = random.Random(5)
    draw = lambda: np.array(sorted(rng.sample(range(60), rng.randrange(1, 40))), np.uint64)
    group, queries = jaccard.Group(), [draw() for _ in range(50)]
    for i in range(20):
        group.add(i, i, draw())
    union = set().union(*(s.tolist() for s in group.sets))
    chosen, common = group.common(queries)
    assert chosen == [i for i, q in enumerate(queries) if 100 * len(union & set(q.tolist())) >= 80 * q.size]
    assert common.tolist() == [[len(set(queries[i].tolist()) & set(s.tolist())) for s in group.sets] for i in chosen]


def test_sieves_hold_their_keys(spark, monkeypatch):
    keys = [random.Random(6).randrange(-(1 << 63), 1 << 63) for _ in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for most in (1 << 28, 1 << 10):  # the second is full
        monkeypatch.setattr(jaccard, "SIEVE", most)
        sieve = jaccard.Sieve.of(df, "k", len(keys))
        assert sieve.has(np.array(keys)).all()
        others = sieve.has(np.arange(1, 20_000, dtype=np.int64) * 0x9E3779B97F4A7)
        assert others.mean() < 0.2 or most == 1 << 10


def test_boundary_of_the_threshold(spark):
    w = [f"w{i}" for i in range(22)]
    docs = [(1, " ".join(w[:20])), (2, " ".join(w[2:22])), (3, " ".join(w[:13])), (4, " ".join(w[:14]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.components(df).collect()), key=str) == brute(docs)


def test_nulls_repeats_and_empty(spark):
    docs = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (4, "q r s t u v"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.components(df).collect()), key=str) == brute(docs)
    assert jaccard.components(df.limit(0)).count() == 0


def test_shingles_match_plain_sets():
    for _, text in world(3):
        assert shingle_sets([text])[0].size == len(plain_set(text))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 164)] + [(7, i) for i in range(8, 40)] + [(7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 165)}, **{i: 7 for i in range(7, 40)}}
