"""Late arrivals against a plain layout of all rows, by reading the files back."""

import hashlib
import math
import zlib
from datetime import datetime, timedelta
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from scenelake.llm import late

EPOCH = datetime(1970, 1, 1)
CUT = datetime(2024, 3, 20)
DDL = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
NAMES = ["sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority"]


def day(row):
    return -1 if row["sold_at"] is None else (row["sold_at"] - EPOCH).days


def micro(t):
    return "" if t is None else str((t - EPOCH) // timedelta(microseconds=1))


def layout(rows, per_file):
    """Files of the latest rows: (day, number) -> rows."""
    last = {}
    for r in rows:
        if r["sale_id"] not in last or (r["arrived_at"] or datetime.min) > (last[r["sale_id"]]["arrived_at"] or datetime.min):
            last[r["sale_id"]] = r
    days = {}
    for r in last.values():
        days.setdefault(day(r), []).append(r)
    files = {}
    for d, of_day in days.items():
        of_day.sort(key=lambda r: (r["sold_at"] is not None, r["sold_at"] or EPOCH, r["sale_id"] is not None, r["sale_id"] or 0))
        for at in range(0, len(of_day), per_file):
            files[d, at // per_file] = of_day[at : at + per_file]
    return files, last


def plain(sales):
    """The rows of the query, by loops."""
    rows = list(sales)
    for r in sales:
        h = zlib.crc32(str(r["sale_id"]).encode()) if r["sale_id"] is not None else None
        if h is not None and h % 3 == 0 and day(r) % 4 == 0:
            rows.append(r | {
                "total": None if r["total"] is None else r["total"] + 1, "sold_at": r["sold_at"] + timedelta(days=h % 2),
                "arrived_at": r["arrived_at"] and r["arrived_at"] + timedelta(days=1 + h % 97),
            })
    per_file = 1 + len(sales) // 1100
    early = [r for r in rows if r["arrived_at"] is not None and r["arrived_at"] < CUT]
    start, stood = layout(early, per_file)
    final, last = layout(rows, per_file)
    came = [r for r in last.values() if not (r["arrived_at"] is not None and r["arrived_at"] < CUT)]
    touched = {day(r) for r in came} | {day(stood[r["sale_id"]]) for r in came if r["sale_id"] in stood}
    out = []
    for (d, number), of_file in final.items():
        text = lambda v: "" if v is None else str(v)
        crc = sum(zlib.crc32(f"{text(r['sale_id'])}:{micro(r['sold_at'])}:{micro(r['arrived_at'])}".encode()) for r in of_file)
        cents = sum(0 if r["total"] is None else math.floor(100 * r["total"] + 0.5) for r in of_file)
        ids = ",".join(text(r["sale_id"]) for r in of_file)
        out.append((d, number, len(of_file), cents, crc, hashlib.sha256(ids.encode()).hexdigest(), d in touched))
    return sorted(out), {(d, n) for d, n in start if d not in touched}


def local(path):
    return Path(unquote(urlparse(path).path))


def held(rows):
    return sorted((r.day, r.file_no, r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) for r in rows)


def table(tmp_path, spark, rows, ddl=DDL):
    names = [c.split()[0] for c in ddl.split(", ")]
    spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], ddl).write.parquet(f"{tmp_path}/sales.parquet")
    return str(tmp_path)


def sale(i, total, sold, arrived):
    return dict(zip(NAMES, (i, i, "done", total, sold, arrived, 1)))


def test_query_against_plain(spark):
    zone = "America/New_York"
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = late.op12_late_overwrite(spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    expected, untouched = plain(pq.read_table("/root/testdata/sf0.001/sales.parquet").to_pylist())
    assert held(rows) == expected
    assert {(r.day, r.file_no) for r in rows if not r.rewritten} == untouched and untouched
    base = local(rows[0].path).parents[2]
    assert {p for p in base.rglob("*.parquet")} == {local(r.path) for r in rows}
    for r in rows[:40]:
        stored = pq.ParquetFile(local(r.path)).read()
        assert stored.column_names == NAMES == r.columns.split(",")
        assert hashlib.sha256(",".join(map(str, stored["sale_id"].to_pylist())).encode()).hexdigest() == r.ids_sha256


def test_nulls_ties_repeats_and_moves(spark, tmp_path):
    d = lambda m, n, h=0: datetime(2024, m, n, h)
    rows = [
        sale(1, 1.0, d(1, 5), d(1, 5)), sale(1, 2.0, d(1, 9), d(4, 1)),  # moves to another day, its day is empty then
        sale(2, None, None, d(1, 6)), sale(3, 3.0, d(1, 6), None),  # no time; no arrival
        sale(3, 4.0, d(1, 7), d(1, 8)), sale(None, 5.0, d(1, 7), d(1, 8)), sale(None, 6.0, d(1, 7), d(3, 25)),
        sale(4, 7.0, d(1, 20), d(1, 21)), sale(4, 7.0, d(1, 20), d(1, 21)), sale(5, 8.0, d(1, 20, 5), d(1, 21)),
        sale(6, 9.0, None, d(4, 2)), sale(7, -0.005, d(1, 31, 23), d(2, 1)),
    ]
    found = late.op12_late_overwrite(spark, table(tmp_path, spark, rows)).collect()
    expected, _ = plain(rows)
    assert held(found) == expected


def test_more_files_a_day_than_ranges_and_late_days_that_shrink(spark, tmp_path):
    start = datetime(2024, 1, 1)
    early = [sale(i, i / 4, start + timedelta(minutes=7 * (i % 500)), start + timedelta(days=9)) for i in range(900)]
    moved = [sale(i, i / 2, start + timedelta(days=5), CUT + timedelta(days=1, seconds=i)) for i in range(0, 900, 2)]
    schema = spark.createDataFrame([], DDL).schema
    layout_ = late.Layout(str(tmp_path / "base"), schema, 10)
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    late.write_layout(layout_, frame(early))
    days = late.overwrite_late(layout_, frame(moved))
    expected, _ = layout(early + moved, 10)
    found = {}
    for r in layout_.stored(spark).orderBy("path", "pos").collect():
        found.setdefault((r.day, r.file_no), []).append(r.c0)
    assert found == {k: [r["sale_id"] for r in of_file] for k, of_file in expected.items()}
    assert {r.day for r in days.collect()} == {day(r) for r in early} | {day(moved[0])}


def test_a_late_row_that_is_older_than_the_stored_one_stays_out(spark, tmp_path):
    schema = spark.createDataFrame([], DDL).schema
    layout_ = late.Layout(str(tmp_path / "base"), schema, 10)
    d = datetime(2024, 1, 2)
    frame = lambda *rows: spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    late.write_layout(layout_, frame(sale(1, 1.0, d, d + timedelta(days=3)), sale(2, 1.0, d, d)))
    came, gone = late.deletion_vectors(layout_, frame(sale(1, 2.0, d, d), sale(2, 2.0, d, d + timedelta(days=1))))
    assert [r.c0 for r in came.collect()] == [2]
    assert [(r.day, r.file_no, r.pos) for r in gone.collect()] == [(19724, 0, 1)]


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    assert late.op12_late_overwrite(spark, table(tmp_path / "none", spark, [])).collect() == []
    rows = [sale(i, 1.0, datetime(2024, 3, 1 + i), datetime(2024, 3, 1 + 3 * i)) | {"day": "x", "file_no": i, "path": "p", "c0": "y"} for i in range(9)]
    ddl = DDL + ", day string, file_no int, path string, c0 string"
    found = late.op12_late_overwrite(spark, table(tmp_path / "more", spark, rows, ddl)).collect()
    expected, _ = plain(rows)
    assert held(found) == expected
    assert {r.columns for r in found} == {",".join([*NAMES, "day", "file_no", "path", "c0"])}
    assert pq.ParquetFile(local(found[0].path)).read()["day"].to_pylist() == ["x"]


def test_only_late_or_only_early_rows(spark, tmp_path):
    for name, shift in (("early", 0), ("late", 100)):
        rows = [sale(i, 1.5 * i, datetime(2024, 1, 1 + i % 9), datetime(2024, 1, 10) + timedelta(days=shift)) for i in range(1, 60)]
        rows = [r | {"sale_id": 3 * r["sale_id"]} for r in rows]
        found = late.op12_late_overwrite(spark, table(tmp_path / name, spark, rows)).collect()
        assert held(found) == plain(rows)[0]


def test_times_with_a_zone_are_in_utc(spark, tmp_path):
    rows = [sale(i, 1.0, datetime(2024, 3, 1, 23, 30), datetime(2024, 3, 20) - timedelta(hours=i)) for i in range(4)]
    spark.createDataFrame([tuple(r.values()) for r in rows], DDL).withColumns(
        {c: F.col(c).cast("timestamp") for c in ("sold_at", "arrived_at")}
    ).write.parquet(f"{tmp_path}/sales.parquet")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        found = held(late.op12_late_overwrite(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == plain(rows)[0]
