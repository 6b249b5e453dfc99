import duckdb
import pytest

import __spark_entry__ as entry
from scenelake import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in queries.QUERIES.items() if sql))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    key = lambda r: tuple(map(repr, r))
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in queries.QUERIES.items() if not sql))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_gap_statistic_runs_as_the_reference(spark, monkeypatch):
    calls = []
    fits = queries.cluster.fits
    monkeypatch.setattr(queries.cluster, "fits", lambda *a, **k: calls.append((a[1:], k)) or fits(*a, **k))
    got = entry.queries()["gap_statistic"](spark, SF)
    assert calls == [(([2, 3, 4, 5, 6, 7, 8, 9, 10],), {"draws": 20})]
    assert {r.k for r in got.collect()} == set(range(2, 11))


def test_threshold_sweep_runs_as_the_reference(spark, monkeypatch):
    calls = []
    fits = queries.cluster.fits
    monkeypatch.setattr(queries.cluster, "fits", lambda *a, **k: calls.append((a[1:], k)) or fits(*a, **k))
    got = entry.queries()["threshold_sweep"](spark, SF).select("threshold").collect()
    assert sorted(r.threshold for r in got) == [0.10, 0.11, 0.12, 0.13, 0.14, 0.15, 0.16, 0.18, 0.20]
    assert calls == [(([2, 3, 4, 5],), {})] * 9
