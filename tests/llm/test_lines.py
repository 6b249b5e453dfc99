import random

from scenelake.llm import lines
from scenelake.llm.common import materialize, scratch


def brute(docs, least):
    """docs: (id, text) in any order; the result per (id, text)."""
    order = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0))
    seq = {d: [(i, x.strip(" "), len(x.split())) for i, x in enumerate((d[1] or "").split("\n")) if x.split()] for d in order}
    first, gone = {}, {d: set() for d in order}
    hits = []
    for d in order:
        s = seq[d]
        for p in range(len(s)):
            q, total = p, 0
            while q < len(s) and total < least:
                total += s[q][2]
                q += 1
            if total >= least:
                key = tuple(x for _, x, _ in s[p:q])
                if key in first:
                    hits.append((d, p, *first[key]))
                else:
                    first[key] = (d, p)
    for d, p, e, q in hits:
        a, b = seq[d], seq[e]
        i, j = p, q
        while i > 0 and j > 0 and a[i - 1][1] == b[j - 1][1]:
            i, j = i - 1, j - 1
        while i < len(a) and j < len(b) and a[i][1] == b[j][1]:
            gone[d].add(a[i][0])
            i, j = i + 1, j + 1
    return gone


def world(seed):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 5, 8])))
    passages = [[line() for _ in range(rng.choice([1, 3, 6]))] for _ in range(6)] + [["same"] * 7]
    docs = []
    for i in range(60):
        body = []
        for _ in range(rng.randrange(5)):
            body += rng.choice(passages) if rng.random() < 0.6 else [line() for _ in range(3)] + [""]
        docs.append((i * 7 % 61, "\n".join(body)))
    return docs + [(100, None), (101, ""), (102, "\n\n"), (103, docs[5][1]), (103, docs[5][1]), (None, docs[8][1])]


def test_against_brute_force(spark, monkeypatch):
    for seed, least in ((1, 6), (2, 3), (3, 12)):
        monkeypatch.setattr(lines, "HOT", 3 if seed == 2 else 20_000)  # many keys get salts
        docs = world(seed)
        gone = brute(docs, least)
        df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, line string")
        kept = lines.dedup_lines(df, min_words=least)
        assert kept.columns == ["doc_id", "text", "line", "n_lines", "n_removed"]
        want = []
        for i, t in docs:
            split = (t or "").split("\n")
            rest = None if t is None else "\n".join(x for k, x in enumerate(split) if k not in gone[i, t])
            want.append((i, rest, "k", 0 if t is None else len(split), len(gone[i, t])))
        assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_every_window_selects_a_place_and_few_are_selected(spark):
    rng = random.Random(8)
    text = "\n".join(" ".join(f"w{rng.randrange(9999)}" for _ in range(rng.randint(2, 6))) for _ in range(3000))
    df = spark.createDataFrame([(1, text)], "id long, text string").selectExpr("id", "text", "xxhash64(text) th")
    rows = lines._lines(df)
    marks = sorted(r.pos for r in lines._fingerprints(rows, 40).collect())
    at = [r.at for r in rows.orderBy("pos").collect()]
    # Two neighbouring places are within one window of each other, and about 2 in (lines of a window + 1) are selected.
    assert all(at[b] - at[a] <= 40 + 6 for a, b in zip(marks, marks[1:]))
    assert len(marks) < 3 * len(at) / 11


def test_a_shared_passage_stays_once(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"own {i} line\n{passage}\nend {i}") for i in range(20)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(df).collect()}
    assert got == {i: int(i > 0) for i in range(20)}


def test_one_line_many_times(spark):
    twenty_thousand = "\n".join(["the same words in every line of it"] * 20_000)
    df = spark.createDataFrame([(1, twenty_thousand), (2, twenty_thousand + "\nother")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(df).collect()}
    assert got == {1: (20_000, 19_999, "the same words in every line of it"), 2: (20_001, 20_000, "other")}


def test_a_listing_of_many_documents(spark):
    line = lambda *x: " ".join(f"w{v}" for v in x for _ in range(8))
    parts = [[line(k, j) for j in range(5)] for k in range(400)]
    docs = [(k, "\n".join([*p, f"end {k}"])) for k, p in enumerate(parts)]
    listing = "\n".join(x for k, p in enumerate(parts) for x in [*p, f"end {k}" if k % 2 else "no end"])
    df = spark.createDataFrame([*docs, (9999, listing)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(df).collect() if r.doc_id == 9999 or r.n_removed}
    assert got == {9999: "\n".join(["no end"] * 200)}


def broadcast_joins(df):
    return [x for x in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "BroadcastHashJoin" in x]


def test_only_hot_keys_are_broadcast(spark):
    passage = "\n".join(" ".join(f"w{i}" for i in range(60)) for _ in range(2))
    df = spark.createDataFrame([(i, f"own {i} line\n{passage}\nshort\nend {i}") for i in range(20)], "id long, text string")
    with scratch():  # as tables behind files, which are small
        rows = materialize(lines._lines(df.selectExpr("id", "text", "xxhash64(text) th")), "lines")
        places = materialize(lines._fingerprints(rows, 50), "line-fingerprints")
        seeds = lines._seeds(places)
        pairs = materialize(lines._stretches(seeds), "line-pairs")
        going_on = lines._going_on(rows, pairs)
        tails = materialize(going_on, "line-tails")
        followed = lines._followed(rows, tails, 50)
        assert tails.count() == 19 and followed.count() == 19
        joins = [x for step in (seeds, going_on, followed) for x in broadcast_joins(step)]
        assert joins and all("hot_" in x for x in joins)


def test_many_deletions_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in world(4)], "doc_id long, text string")
    few = lines.dedup_lines(docs, min_words=6)
    want = sorted(map(tuple, few.collect()), key=str)
    monkeypatch.setattr(lines, "SMALL", 40)  # some twenty documents lose lines
    many = lines.dedup_lines(docs, min_words=6)
    assert len(broadcast_joins(few)) == 1 and not broadcast_joins(many)
    assert sorted(map(tuple, many.collect()), key=str) == want and any(x[-1] for x in want)


def test_empty_table(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
