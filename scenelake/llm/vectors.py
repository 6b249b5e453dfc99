"""Vector codes: parts of integer vectors as numbers of codebook entries, found by a vector-approximation file.

Components become integers and vectors equal parts; each part position has a
codebook. A codebook's entries are kept twice: as integers, and bit-quantised,
each coordinate as one of ``2**BITS`` cells that hold about as many entries each
and reach from their least to their greatest value. A part looks the distances
to all cells up in two small tables, which add up to a lower and an upper bound
for each entry. Only entries whose lower bound is not above the least upper bound
are opened, and compared by integer distances.

Codebooks are learned in rounds. A task gives for each entry it has met the
number and the sums of its parts, which Spark adds up, so a round sends
``parts * entries`` rows to the driver, whatever the input.

Defined results:
- rows whose vector is null or has a null or non-finite component go;
- vectors of other lengths are filled up with zeros to the least multiple of the
  number of parts that holds the longest one; empty vectors are all zeros;
- integers beyond 64 bits are cut to the nearest such number; distances are exact
  (whatever their size), errors beyond 64 bits are given as the greatest one;
- the first entries are those of the least ids, null ids last, ties by vector;
- fewer rows than entries give fewer entries; an empty table gives no rows and
  an empty codebook;
- repeated rows each count; a null label is a label; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, scratch, small
from .lines import _dealt as dealt

PARTS, ENTRIES, ROUNDS, BITS = 16, 64, 2, 4
#: Integers below this keep all sums of squares within 64 bits; others are computed as Python integers.
SAFE = 1 << 28
_MOST = (1 << 63) - 1


class Cells:
    """The vector-approximation file of one codebook: ``entries`` (rows of integers) and the cells of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, width = entries.shape
        cells = max(1, min(1 << bits, n))
        self.cell = np.zeros((n, width), np.int64)
        self.low, self.high = np.zeros((width, cells), entries.dtype), np.zeros((width, cells), entries.dtype)
        for d in range(width):
            order = np.argsort(entries[:, d], kind="stable")
            of_rank = np.arange(n) * cells // n
            self.cell[order, d] = of_rank
            first = np.searchsorted(of_rank, np.arange(cells))
            last = np.append(first[1:], n) - 1
            self.low[d], self.high[d] = entries[order[first], d], entries[order[last], d]

    def nearest(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each row (the least number on ties), its squared distance, and how many entries were opened."""
        n, width = self.entries.shape
        q = asked[:, :, None]
        under, over = self.low[None] - q, q - self.high[None]
        zero = np.zeros((), asked.dtype)
        near = np.maximum(np.maximum(under, over), zero) ** 2
        far = np.maximum(np.abs(under), np.abs(over)) ** 2
        lower = np.zeros((len(asked), n), asked.dtype)
        upper = np.zeros((len(asked), n), asked.dtype)
        for d in range(width):
            lower += near[:, d, self.cell[:, d]]
            upper += far[:, d, self.cell[:, d]]
        row, entry = np.nonzero(lower <= upper.min(1)[:, None])
        exact = ((asked[row] - self.entries[entry]) ** 2).sum(1)
        # Pairs come by row, then entry: the first of the least ones is the answer.
        first = np.searchsorted(row, np.arange(len(asked)))
        least = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == least[row])
        best = hit[np.searchsorted(row[hit], np.arange(len(asked)))]
        return entry[best], exact[best], row.size


def integers(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``rows`` whose vector is whole and finite, the vector as floor(scale * x)."""
    x = F.col(vector)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(x.isNotNull() & F.coalesce(whole, F.lit(False))).withColumn(
        vector, F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    )


def width_of(rows: DataFrame, vector: str = "embedding", parts: int = PARTS) -> int:
    """The common length of the vectors: the least multiple of ``parts`` that holds all."""
    longest = rows.agg(F.max(F.size(vector))).first()[0] or 0
    return max(1, -(-longest // parts)) * parts


def _typed(values: np.ndarray) -> np.ndarray:
    """64-bit integers where all distances fit, else Python's."""
    if values.dtype != object and values.size and max(int(values.max()), -int(values.min())) >= SAFE:
        return values.astype(object)
    return values


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(ends)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(flat.size) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _assigned(books: list[np.ndarray], lists: pa.ListArray, width: int, step: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows at a time: their integers by part, the entry and the distance of each part."""
    values = _matrix(lists, width)
    for at in range(0, len(values), step):
        block = _typed(values[at : at + step]).reshape(-1, len(books), width // len(books))
        entries, errors = [], []
        for p, book in enumerate(books):
            same = block.dtype if book.dtype != object else object
            entry, error, _ = Cells(book.astype(same)).nearest(block[:, p].astype(same))
            entries.append(entry)
            errors.append(error)
        yield block, np.stack(entries, 1), np.stack(errors, 1)


def fit(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part position, of integer vectors: (entries, part length) arrays."""
    width = width_of(rows, vector, parts)
    first = rows.orderBy(F.asc_nulls_last(vec_id), vector).select(vector).limit(entries).collect()
    start = np.array([list(r[0]) + [0] * (width - len(r[0])) for r in first], np.int64).reshape(len(first), parts, width // parts)
    books = [_typed(start[:, p]) for p in range(parts)]
    for _ in range(rounds if first else 0):
        books = _moved(rows.select(vector), books, width)
    return books


def _moved(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floored mean of the parts that are nearest to it."""
    parts, n, length = len(books), len(books[0]), width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, n), np.int64), np.zeros((parts, n, length), object)
        for batch in batches:
            for block, entry, _ in _assigned(books, batch.column(0), width):
                for p in range(parts):
                    counts[p] += np.bincount(entry[:, p], minlength=n)
                    here = np.zeros((n, length), block.dtype)
                    np.add.at(here, entry[:, p], block[:, p])
                    sums[p] += here.astype(object)
        p, e = np.nonzero(counts)
        p, e, d = np.repeat(p, length), np.repeat(e, length), np.tile(np.arange(length), p.size)
        total = pa.array([Decimal(int(v)) for v in sums[p, e, d]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(d), pa.array(counts[p, e]), total], names=["p", "e", "d", "n", "s"])

    met = map_batches(rows, run, "p long, e long, d long, n long, s decimal(38,0)").groupBy("p", "e", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    moved = [book.astype(object) for book in books]
    for p, e, d, count, total in met.collect():
        moved[p][e, d] = int(total) // count
    return [_typed(np.array(book.tolist(), np.int64).reshape(n, length)) for book in moved]


def encode(rows: DataFrame, books: list[np.ndarray], keep: list[str], vector: str = "embedding", width: int | None = None) -> DataFrame:
    """Columns ``keep``, ``code`` (two hex digits a part) and ``error`` (sum of the parts' squared distances)."""
    names = [f"__k{i}" for i in range(len(keep))]
    width = width_of(rows, vector, len(books)) if width is None else width
    narrow = rows.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(vector).alias("__v"))
    schema = narrow.drop("__v").schema.add("code", "string").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for _, entry, error in _assigned(books, batch.column(batch.num_columns - 1), width):
                text = entry.astype(np.uint8).tobytes().hex()
                codes += [text[at : at + 2 * len(books)] for at in range(0, len(text), 2 * len(books))]
                errors += [min(_MOST, sum(map(int, e))) for e in error] if error.dtype == object else error.sum(1).tolist()
            columns = batch.columns[:-1] + [pa.array(codes, pa.string()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_batches(narrow, run, schema).toDF(*keep, "code", "error")


def decode(code: str, books: list[np.ndarray]) -> list[int]:
    """The integer vector that a code stands for."""
    numbers = bytes.fromhex(code)
    return [int(x) for p, book in enumerate(books) for x in book[numbers[p]]]


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all integers by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: the error summed over equal labels, which are dealt out if very many rows share them."""
    most = F.lit(_MOST).cast("decimal(38,0)")
    sums = coded.groupBy(F.col(label).alias("__label")).agg(
        F.least(F.sum(F.col("error").cast("decimal(28,0)")), most).cast("long").alias("label_error"), F.count("*").alias("n")
    )
    sums = materialize(sums, "vector-labels")
    sent = small(sums)
    if sent is not sums:
        joined = coded.join(sent, F.col(label).eqNullSafe(F.col("__label")))
    else:
        total = sums.agg(F.sum("n")).first()[0]
        many, few = dealt(coded, sums, {label: "__label"}, sums.select(F.col("__label").alias(label), "n"), total, ["code", "error"])
        joined = many.join(few, F.col(label).eqNullSafe(F.col("__label")) & (F.col("salt") == F.col("f_salt")))
    return joined.select(*coded.columns, "label_error")


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """Each whole vector's id, label, code, error and label error, and the codebooks."""
    kept = integers(rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v")), "v")
    books = fit(kept, "vec_id", "v")
    with scratch():
        coded = materialize(encode(kept, books, ["vec_id", "label"], "v"), "vector-codes")
        return materialize(with_label_error(coded), "vectors", keep=True), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Query: the code of every whole vector of ``embeddings``, its error, and that of its label."""
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round(i: int) -> str:
    """SQL of one round: the nearest entry of each part in ``book{i}``, and ``book{i + 1}``."""
    means = ", ".join(f"(sum(q[{k}]) - ((sum(q[{k}]) % count(*)) + count(*)) % count(*)) // count(*)" for k in range(1, 5))
    return f"""near{i} AS (SELECT rid, p, any_value(q) AS q, min({_SQUARE} * 64 + e) AS best FROM parts JOIN book{i} USING (p) GROUP BY rid, p),
book{i + 1} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} AS b LEFT JOIN (
    SELECT p, best % 64 AS e, [{means}] AS c FROM near{i} GROUP BY p, best % 64) AS m ON m.p = b.p AND m.e = b.e),"""


_SQUARE = "(" + " + ".join(f"(q[{k}] - c[{k}]) * (q[{k}] - c[{k}])" for k in range(1, 5)) + ")"
OP13_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS (SELECT rid, p, list_slice(v, 4 * p + 1, 4 * p + 4) AS q FROM kept, range(16) AS r(p)),
seeds AS (SELECT v, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept QUALIFY e < 64),
book0 AS (SELECT p, e, list_slice(v, 4 * p + 1, 4 * p + 4) AS c FROM seeds, range(16) AS r(p)),
{_round(0)}
{_round(1)}
near2 AS (SELECT rid, p, min({_SQUARE} * 64 + e) AS best FROM parts JOIN book2 USING (p) GROUP BY rid, p),
coded AS (
  SELECT rid, string_agg(format('{{:02x}}', CAST(best % 64 AS INTEGER)), '' ORDER BY p) AS code, sum(best // 64) AS error FROM near2 GROUP BY rid),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT k.vec_id, c.code, CAST(c.error AS BIGINT) AS error,
  CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.codebooks_sha256
FROM kept AS k JOIN coded AS c USING (rid), digest AS d
"""
