"""Substring dedup: repeated passages as compacted paths of a De Bruijn graph of words.

An edge is a run of ``WINDOW`` words of a text, between the nodes of its first and
its last ``WINDOW - 1`` words. Edges that a text with a smaller id has too are
repeated, and the words they cover go.

1. Equal texts are one, under their least id, so copies cost a row each.
2. Not all edges are shuffled. The least hash of the runs of ``ANCHOR`` words in an
   edge is its anchor; equal edges have equal anchors, and neighbours mostly the
   same one. Only edges whose anchor stands under several ids can be repeated.
3. Those are counted: edges under their two hashes, with the least id, and with the
   words before and behind them, which are the same everywhere along a path that
   does not branch.
4. Edges are joined back to their places. Places that follow one another in a
   text, along edges of one first id and over nodes that do not branch, are
   compacted into a path: one row with the coordinates it has in the text.
5. The words of all paths of a greater id than the first go from the texts.
   :func:`passages` joins the paths of all texts by their ends and length, and gives
   the coordinates in the first one.

Edges are told apart by 64 bits and by 32 bits of an independent hash, and a path
is a run of places without a gap: these verify it, texts are not compared again. Edges and
texts that very many rows share are dealt out over salts; no group is collected
but the paths of one text.

Defined results:
- words are runs of characters that are no ASCII white space, taken unchanged; a
  text of fewer than ``WINDOW`` words keeps all of them; null and empty texts have none;
- an id that repeats is no smaller than itself: rows with one id and different
  texts do not take words from one another; equal rows get equal results;
- a null id counts as the least 64-bit integer;
- an empty table gives no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_small_batches, map_batches, materialize, scratch, slices
from .lines import _dealt as dealt
from .shingles import _SPACE, mix

WINDOW, ANCHOR = 50, 20
#: Words longer than this many bytes are hashed one by one.
LONG = 1024
_LEAST = -(1 << 63)

_rng = np.random.default_rng(20240311)
_BYTES = _rng.integers(0, 1 << 64, 256, np.uint64)
_PLACES = _rng.integers(0, 1 << 63, LONG, np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [int(b) * 2 + 1 for b in _rng.integers(0, 1 << 63, 3)]


class Words:
    """The words of some texts, one text behind the other: their places in ``data``, hashes and texts."""

    def __init__(self, texts: list[str | None]):
        raws = [(t or "").encode() for t in texts]
        self.data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
        space = _SPACE[self.data]
        flips = np.flatnonzero(space[1:] != space[:-1]) + 1
        flips = flips if space[0] else np.concatenate([[0], flips])
        self.starts, self.ends = flips[::2], flips[1::2]
        begins = np.cumsum([0] + [len(r) + 1 for r in raws])
        #: The number of the first word of each text, and of all words.
        self.first = np.searchsorted(self.starts, begins)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, about a megabyte of words at a time."""
        sizes = self.ends - self.starts
        out = np.zeros(sizes.size, np.uint64)
        short = np.flatnonzero(sizes <= LONG)
        for i in np.flatnonzero(sizes > LONG).tolist():
            whole = self.data[self.starts[i] : self.ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little")
        ends = np.cumsum(sizes[short])
        at = 0
        while at < short.size:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20))))
            part = short[at:to]
            size = sizes[part]
            cuts = np.cumsum(size) - size
            inside = np.arange(int(size.sum())) - np.repeat(cuts, size)
            values = _BYTES[self.data[np.repeat(self.starts[part], size) + inside]] * _PLACES[inside]
            out[part] = mix(np.add.reduceat(values, cuts) + size.astype(np.uint64))
            at = to
        return out


def runs(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` words, by doubling."""
    n = words.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    whole, met, part, size = None, 0, words, 1
    factor = base
    while True:
        if k & size:
            if whole is None:
                whole = part
            else:
                m = min(whole.size, part.size - met)
                whole = whole[:m] * np.uint64(factor) + part[met : met + m]
            met += size
        if met == k:
            return mix(whole[:n])
        part = part[:-size] * np.uint64(factor) + part[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values, by doubling."""
    n, size = values.size - width + 1, 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size : width - size + n])


def anchors(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (numbers of first words) of all windows within one text, and their anchors."""
    if hashes.size < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found = least(runs(hashes, ANCHOR, _BASES[0]), WINDOW - ANCHOR + 1)
    whole = np.flatnonzero(words.text[: found.size] == words.text[WINDOW - 1 :])
    return whole, found[whole]


def edges(words: Words, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edge of each place, and 32 bits of another hash, 16 of the word before and 16 of the word behind (0 for none)."""
    edge = runs(hashes, WINDOW, _BASES[1])[places]
    check = runs(hashes, WINDOW, _BASES[2])[places] >> np.uint64(32)
    sign = (hashes >> np.uint64(48)) | np.uint64(1)
    edge_of = words.first[words.text[places]]
    before = np.where(places > edge_of, sign[places - 1], 0).astype(np.uint64)
    behind = places + WINDOW
    after = np.where(behind < words.first[words.text[places] + 1], sign[np.minimum(behind, sign.size - 1)], 0).astype(np.uint64)
    return edge, check << np.uint64(32) | before << np.uint64(16) | after


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _mapped(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch, Words], list]) -> DataFrame:
    """Rows made from batches of about a megabyte of ``text``, the last column."""
    names = df.sparkSession.createDataFrame([], schema).columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                yield pa.RecordBatch.from_arrays(work(part, Words(part.column(part.num_columns - 1).to_pylist())), names=names)

    return in_small_batches(map_batches(df, run, schema))


def texts_of(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows as ``doc_id``, ``id``, ``h1``, ``h2``; and the distinct texts: their hashes, least ``id``, rows ``n`` and ``text``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("id"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit("."), text).alias("h2"),
        text.alias("text"),
    )
    texts = rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("text").alias("text"))
    return rows.drop("text"), texts


def candidates(texts: DataFrame) -> DataFrame:
    """``id``, ``h1`` and ``anchors`` of the texts with anchors that stand under several ids."""

    def work(part: pa.RecordBatch, words: Words) -> list:
        places, found = anchors(words, words.hashes())
        text = words.text[places]
        new = np.ones(places.size, bool)
        new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
        return [part.column(0).take(pa.array(text[new])), part.column(1).take(pa.array(text[new])), _signed(found[new])]

    met = materialize(_mapped(texts.select("id", "h1", "text"), "id long, h1 long, anchor long", work), "substring-anchors")
    counts = met.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    shared = materialize(counts.where("low < high").select("anchor", "n"), "substring-shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    few = shared.select(F.col("anchor").alias("f_anchor"))
    many, few = dealt(met, few, {"anchor": "f_anchor"}, shared, total, ["id", "h1"])
    hits = many.join(few, F.expr("anchor = f_anchor and salt = f_salt"))
    hits = materialize(hits.groupBy("id", "h1").agg(F.collect_set("anchor").alias("anchors")), "substring-hits")
    discard(met)
    return hits


def places_of(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """``id``, ``h1``, ``pos``, ``edge`` and ``around`` of all windows that may be repeated."""
    asked = texts.select("id", "h1", "text").join(hits.hint("merge"), ["id", "h1"])

    def work(part: pa.RecordBatch, words: Words) -> list:
        hashes = words.hashes()
        places, found = anchors(words, hashes)
        # An anchor that is shared is shared wherever it stands.
        shared = np.unique(part.column(2).flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
        places = places[np.isin(found, shared)]
        edge, around = edges(words, hashes, places) if places.size else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        text = words.text[places]
        of = pa.array(text)
        pos = pa.array((places - words.first[text]).astype(np.int32))
        return [part.column(0).take(of), part.column(1).take(of), pos, _signed(edge), _signed(around)]

    return _mapped(asked.select("id", "h1", "anchors", "text"), "id long, h1 long, pos int, edge long, around long", work)


def graph(places: DataFrame) -> DataFrame:
    """The repeated edges: ``edge``, ``check``, the least id ``first``, rows ``n``, and whether the words before and behind are always the same."""
    check = F.shiftright("around", 32).cast("int").alias("check")
    met = places.groupBy("edge", check).agg(
        F.min("id").alias("first"), F.count("*").alias("n"), F.bit_or("around").alias("any"), F.bit_and("around").alias("all")
    )
    differ = F.col("any").bitwiseXOR(F.col("all"))
    return met.where("n > 1").select(
        "edge", "check", "first", "n", (differ.bitwiseAND(0xFFFF0000) == 0).alias("same_before"), (differ.bitwiseAND(0xFFFF) == 0).alias("same_after")
    )


def paths(places: DataFrame, found: DataFrame) -> DataFrame:
    """Compacted paths in all texts that have them: ``id``, ``h1``, ``a``, ``b`` (first and last window), ``first``, and the ends' edges.

    A path ends where the places, the first id or a node that branches do not let it go on.
    """
    met = places.withColumn("check", F.shiftright("around", 32).cast("int")).drop("around")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    few = found.select(F.col("edge").alias("f_edge"), F.col("check").alias("f_check"), "first", "same_before", "same_after")
    many, few = dealt(met, few, {"edge": "f_edge", "check": "f_check"}, found.select("edge", "check", "n"), total, ["id", "h1", "pos"])
    joined = many.join(few, F.expr("edge = f_edge and check = f_check and salt = f_salt"))
    along = Window.partitionBy("id", "h1").orderBy("pos")
    goes_on = (
        (F.lag("pos").over(along) == F.col("pos") - 1)
        & (F.lag("first").over(along) == F.col("first"))
        & F.lag("same_after").over(along)
        & F.col("same_before")
    )
    begins = F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1).alias("begins")
    marked = joined.select("id", "h1", "pos", "edge", "first", begins)
    run = F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("run")
    return (
        marked.select("id", "h1", "pos", "edge", "first", run)
        .groupBy("id", "h1", "run", "first")
        .agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.min_by("edge", "pos").alias("head"), F.max_by("edge", "pos").alias("tail"))
        .drop("run")
    )


def passages(found: DataFrame) -> DataFrame:
    """The distinct paths: the ends' edges, ``length`` in words, how many texts have it, and where it stands first (``first``, ``h1``, ``a``).

    A path of a text is joined to the path of the first text with the same ends and length.
    """
    length = (F.col("b") - F.col("a") + WINDOW).alias("length")
    keyed = found.select("*", length)
    counts = keyed.groupBy("first", "head", "tail", "length").agg(F.countDistinct("id", "h1").alias("n_texts"))
    source = keyed.where("id = first").groupBy("first", "head", "tail", "length").agg(F.min(F.struct("h1", "a")).alias("at"))
    return counts.join(source, ["first", "head", "tail", "length"], "left").select(
        "first", "head", "tail", "length", "n_texts", F.col("at.h1").alias("h1"), F.col("at.a").alias("a")
    )


def kept(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``id``, ``h1``, ``h2``, rows ``n`` of each text, with ``n_words``, ``n_removed`` and ``kept_sha256`` under its least id."""
    narrow = spans.select(F.col("id").alias("s_id"), F.col("h1").alias("s_h1"), "a", "b")
    joined = texts.join(narrow.hint("merge"), F.expr("id = s_id and h1 = s_h1"), "left")

    def work(part: pa.RecordBatch, words: Words) -> list:
        n = part.num_rows
        a, b = part.column(4), part.column(5)
        of = np.repeat(np.arange(n), np.diff(a.offsets.to_numpy()) if a.null_count == 0 else np.array([len(x) if x is not None else 0 for x in a.to_pylist()], np.int64))
        change = np.zeros(words.starts.size + 1, np.int64)
        np.add.at(change, words.first[of] + a.flatten().to_numpy(zero_copy_only=False), 1)
        np.add.at(change, words.first[of] + b.flatten().to_numpy(zero_copy_only=False) + WINDOW, -1)
        stays = np.cumsum(change)[:-1] == 0
        starts, ends = words.starts[stays], words.ends[stays]
        marks = np.zeros(words.data.size + 1, np.int8)
        marks[starts] = 1
        np.subtract.at(marks, ends + 1, 1)
        text = words.data.copy()
        text[ends] = 32
        text = text[np.cumsum(marks[:-1], dtype=np.int8) > 0].tobytes()
        size = np.zeros(n, np.int64)
        np.add.at(size, words.text[stays], ends - starts + 1)
        cuts = np.concatenate([[0], np.cumsum(size)]).tolist()
        digests = [hashlib.sha256(text[i : max(i, j - 1)]).hexdigest() for i, j in zip(cuts[:-1], cuts[1:])]
        total = np.diff(words.first)
        left = np.bincount(words.text[stays], minlength=n)
        return [*part.columns[:4], pa.array(total), pa.array(total - left), pa.array(digests)]

    schema = "id long, h1 long, h2 long, n long, n_words long, n_removed long, kept_sha256 string"
    return _mapped(joined.select("id", "h1", "h2", "n", "a", "b", "text"), schema, work)


def spans_of(found: DataFrame) -> DataFrame:
    """``id``, ``h1``, and the first and last windows ``a`` and ``b`` of the paths that a smaller id has, as arrays."""
    later = found.where("id > first").groupBy("id", "h1").agg(F.collect_list(F.struct("a", "b")).alias("s"))
    return later.select("id", "h1", F.col("s.a").alias("a"), F.col("s.b").alias("b"))


def dedup_substrings(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of each row."""
    rows, texts = texts_of(documents, id_col, text_col)
    with scratch():
        texts = materialize(texts, "substring-texts")
        hits = candidates(texts)
        places = materialize(places_of(texts, hits), "substring-places")
        discard(hits)
        found = materialize(graph(places), "substring-edges")
        met = materialize(paths(places, found), "substring-paths")
        discard(places)
        discard(found)
        of_text = materialize(kept(texts, spans_of(met)), "substring-kept")
        few = of_text.select(F.col("h1").alias("f_h1"), F.col("h2").alias("f_h2"), F.col("id").alias("f_id"), "n_words", "n_removed", "kept_sha256")
        total = of_text.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        many, few = dealt(rows, few, {"h1": "f_h1", "h2": "f_h2"}, of_text.select("h1", "h2", "n"), total, ["id"])
        joined = many.join(few, F.expr("h1 = f_h1 and h2 = f_h2 and salt = f_salt"))
        # A copy under a greater id has all its windows in the text under the least one.
        gone = (F.col("id") > F.col("f_id")) & (F.col("n_words") >= WINDOW)
        return materialize(
            joined.select(
                "doc_id",
                "n_words",
                F.when(gone, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
                F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
            ),
            "substrings",
            keep=True,
        )


def op11_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: what each whole document keeps."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM d, unnest(range(1, len(w) - 48)) AS r(i)),
first AS (SELECT win, min(doc_id) AS f FROM wins GROUP BY win HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i FROM wins JOIN first USING (win) WHERE doc_id > f), range(50) AS r(k)),
kept AS (
  SELECT e.doc_id, count(g.i) AS n_removed, string_agg(e.word, ' ' ORDER BY e.i) FILTER (g.i IS NULL) AS rest
  FROM (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(i)) AS e
  LEFT JOIN gone AS g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.rest, '')) AS kept_sha256
FROM d LEFT JOIN kept AS k USING (doc_id)
"""
