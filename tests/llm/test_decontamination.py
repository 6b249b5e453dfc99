import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from scenelake.llm import decontamination as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    words = plain_words(text)
    hit, found = set(), set()
    for item, body in items:
        w = plain_words(body)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [w.decode() for w in D.words(text)] == plain_words(text)


def world(seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "Ab", "é", "c3", "zz"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 10, 14])))) for i in range(12)] + [(99, None), (5, "a b c3 zz")]
    docs = [(i, " ".join(word() + rng.choice(["", ".", "\n", "!?"]) for _ in range(rng.randrange(60)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "--- ..."), (7, docs[3][1]), (None, "A. " + (items[0][1] or "a"))]
    docs.append((103, "x " * 30_000 + " ".join(["zz"] * 10)))
    return items, docs


def test_against_brute_force_in_one_block_and_in_many(spark):
    items, docs = world()
    d = spark.createDataFrame([(i, t, "u") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, *brute(t, items)) for i, t in docs), key=str)
    for size in (1 << 20, 40):
        found = D.contamination(d, b, block_bytes=size)
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=str)
        assert got == want


def test_a_block_of_a_megabyte_fits_a_worker():
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(20_000)]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=200))) for i in range(640)]
    assert sum(len(t) for _, t in items) > 1 << 20
    scanner = D.Scanner(items)
    assert scanner.automaton.get_stats()["total_size"] < 300 << 20
    text = D.words("unknown " + items[7][1] + " unseen " + " ".join(items[8][1].split()[50:60]) + " end")
    ranges, ids = scanner.scan(text)
    assert D.merged(ranges) == [(1, 201), (202, 212)] and ids == {"7", "8"}


def test_several_blocks_meet_many_copies(spark, monkeypatch):
    items, docs = world(5)
    monkeypatch.setattr(D, "SMALL", 0)  # texts and hits are shuffled
    d = spark.createDataFrame(docs + [(500 + i, docs[3][1]) for i in range(200)], "doc_id long, text string")
    b = spark.createDataFrame(items + items, "item_id long, text string")
    one, many = (
        sorted(map(str, D.contamination(d, b, block_bytes=n).collect())) for n in (1 << 20, 120)
    )
    assert one == many


def test_spans_cut_the_passages_of_the_original(spark):
    passage = "One, two; THREE four five six seven eight nine ten"
    d = spark.createDataFrame([(1, f"Ünder ... {passage}! Rest.")], "doc_id long, text string")
    b = spark.createDataFrame([(1, passage.lower())], "item_id long, text string")
    row = D.contamination(d, b).first()
    assert [f"Ünder ... {passage}! Rest."[s.start : s.end] for s in row.spans] == [passage]


def test_empty_tables_and_dropping(spark):
    d = spark.createDataFrame([(1, "a b c", "k"), (2, "d", None)], "doc_id long, text string, spans string")
    b = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert D.contamination(d, b.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0
    assert D.contamination(d.limit(0), b).count() == 0
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns and [tuple(r) for r in kept.collect()] == [(2, "d", None)]
