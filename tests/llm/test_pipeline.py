import hashlib

import duckdb
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from scenelake.llm import queries, toxicity
from scenelake.llm.bpe import load_ranks, public_vocabulary

from . import test_decontamination, test_jaccard, test_lines

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), docs.schema)
        ids, kept = {r.doc_id for r in before.select("doc_id").collect()}, {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.7 * len(ids), name
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert {r.doc_id for r in last} == kept and all(len(r.token_ids) == r.n_tokens for r in last)


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_sql_of_the_corpus_queries(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, (query, sql) in queries.QUERIES.items():
        if sql:
            result = con.execute(sql)
            columns = [d[0] for d in result.description]
            got = entry.queries()[name](spark, SF).select(*columns)
            assert sorted(map(tuple, got.collect()), key=str) == sorted(result.fetchall(), key=str), name


def test_rows_of_one_id_are_judged_by_their_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (None, b), (7, c), (7, c + " more"), (None, "alone"), (8, None), (8, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    sevens = [r for r in kept if r[0] == 7]
    assert len(sevens) == 1 and sorted((r for r in kept if r[0] != 7), key=str) == sorted([(3, a), (5, b), (None, "alone"), (8, None), (9, None)], key=str)


def test_nulls_repeats_and_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(70))
    rows = [
        (1, words, "en", "s", 10, 5, "x"), (2, words, None, None, None, None, None), (2, words, None, None, None, None, None),
        (3, "own words here\n" + words, "en", "s", 1, 0, "y"), (4, None, None, None, None, 1, "z"), (5, "", "de", "s", 0, 1, "z"),
        (None, "a text without an id", None, "s", 3, 1, "z"), (6, "one two three four five six seven", "en", "s", 3, 1, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_removed int, node string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), docs.schema)
    got = {(r.doc_id, r.text, r.n_chars) for r in docs.collect()}
    assert got == {
        (1, words, 10), (3, "own words here", 14), (4, None, None), (5, "", 0),
        (None, "a text without an id", 3), (6, "one two three four five six seven", 3),
    }
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 6


def test_the_whole_pipeline_against_plain_stages(spark):
    """All documents of a small table, through plain versions of the five stages."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    docs = [(i, t) for i, t in docs if model.judge(t)[0] < 0.7]
    gone, after = test_lines.brute(docs, 50), []
    for i, t in docs:
        kept = [x for k, x in enumerate((t or "").split("\n")) if k not in gone[i, t]]
        if not gone[i, t] or any(x.split() for x in kept):
            after.append((i, None if t is None else "\n".join(kept)))
    docs = [(i, t) for (i, t), (_, _, least) in zip(sorted(after), sorted(test_jaccard.brute(after))) if i == least]
    docs = [(i, t) for i, t in docs if not test_decontamination.brute(t, items)[1]]
    path, pattern = public_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    want = []
    for i, t in docs:
        ids = library.encode_ordinary(t or "")
        shas = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (t or "").encode())]
        want.append((i, ids, len(ids), *shas))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want) and 0 < len(want) < 200
