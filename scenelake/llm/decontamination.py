"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of every benchmark item (``window`` consecutive words, or the whole
item where it has fewer) become the patterns of one automaton. A document is
normalised once, scanned once, and each match is mapped back to word positions
and to character offsets of the original text.

The automaton reads words, not characters: a word of the patterns is a pair of
letters, one of an upper and one of a lower alphabet, so a window of ten words
is twenty nodes deep, whatever the length of its words; every word that no
pattern holds is one pair of its own.

Words: A-Z are lower-cased, then runs of 0-9, a-z and anything beyond ASCII.

Defined results:
- null or empty text, or text without words: no words, no hits, no items;
- an item whose text is null or has no words has no window;
- repeated rows, of documents or of items, are treated each for itself; an
  ``item_id`` appears once in a document's list; a null ``item_id`` is "null";
- an empty benchmark hits nothing, an empty document table gives no rows;
- further columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, in_small_batches, map_batches, map_text, materialize, slices
from .lines import _dealt as dealt

WINDOW = 10
#: Benchmark text that one automaton takes; a larger benchmark is scanned in blocks.
BLOCK_BYTES = 1 << 20

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_ORIGINAL_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return text.encode().translate(_TABLE).split() if text else []


def item_windows(found: list, window: int = WINDOW) -> set[tuple]:
    """The windows of the words of one benchmark item."""
    return {tuple(found[i : i + window]) for i in range(max(1, len(found) - window + 1))} if found else set()


class Scanner:
    """An automaton over the windows of a block of items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        split = [(item_id, words(text)) for item_id, text in items]
        known = sorted({w for _, found in split for w in found})
        base = math.isqrt(len(known)) + 1
        # Upper letters from 1, lower ones behind them; so no match starts within a pair.
        self.codes = {w: chr(1 + i // base) + chr(1 + base + i % base) for i, w in enumerate(known)}
        owners: dict[str, set[str]] = {}
        for item_id, found in split:
            for pattern in item_windows([self.codes[w] for w in found], window):
                owners.setdefault("".join(pattern), set()).add(item_id)
        self.automaton = ahocorasick.Automaton()
        for pattern, ids in owners.items():
            self.automaton.add_word(pattern, (len(pattern) // 2, tuple(ids)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, found: list[bytes]) -> tuple[set[tuple[int, int]], set[str]]:
        """Word ranges [first, last) covered by windows, and the ids of their items."""
        if self.empty or not found:
            return set(), set()
        code = self.codes.get
        ranges, items = set(), set()
        for end, (n, ids) in self.automaton.iter("".join([code(w, "\0\0") for w in found])):
            last = (end + 1) // 2
            ranges.add((last - n, last))
            items.update(ids)
        return ranges, items


def merged(ranges) -> list[tuple[int, int]]:
    """Sorted disjoint ranges that cover the same positions."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark as tables of about ``block_bytes`` of text, an item at least."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text")
    ).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) for b in range(n)]


_RANGES = pa.list_(pa.list_(pa.int32()))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """Find benchmark windows in documents.

    Returns, for each document row: the ``keep`` columns (the id by default),
    ``n_words``, ``n_hit``, ``items`` (sorted array of strings) and ``spans``
    (character ranges of the original text, end exclusive).

    The driver and each Python worker hold one block of the benchmark at a time
    (about ``block_bytes`` of text, or one longer item). With several blocks the
    texts are read once for each, and only the hits of those that have some are
    written into the shared folder, by the hashes of the text; at the end they
    meet the documents again.
    """
    keep = keep or [id_col]
    names = [f"__k{i}" for i in range(len(keep))]
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    state = documents.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text_col).alias("__t"))
    if len(blocks) == 1:
        schema = "ranges array<array<int>>, items array<string>, n_words long, n_hit long, spans array<struct<start:int,end:int>>"
        out = map_text(state, names, "__t", schema, _finder(blocks[0], window, whole=True))
    else:
        text_key = {"__h1": F.xxhash64("__t"), "__h2": F.xxhash64(F.lit(1), "__t")}
        keyed = state.withColumns(text_key)
        texts = keyed.where("__t is not null").select(*text_key, "__t")
        hits = [_hits(texts, block, window) for block in blocks]
        out = _joined(keyed, reduce(DataFrame.unionByName, hits), names)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_words", "n_hit", "items", "spans")


def _finder(block: DataFrame, window: int, whole: bool):
    """A batch function over texts: ranges and items of one block, and if ``whole`` what follows from them."""
    shared = block.sparkSession.sparkContext.broadcast([tuple(r) for r in block.select("item", "text").collect()])

    def scanner():
        scan = _built(shared, window)

        def work(texts: list) -> list[pa.Array]:
            split = [words(text) for text in texts]
            got = [scan(found) for found in split]
            covers = [merged(ranges) for ranges, _ in got]
            arrays = [pa.array(covers, _RANGES), pa.array([sorted(ids) for _, ids in got], pa.list_(pa.string()))]
            return arrays + _counts(texts, split, covers) if whole else arrays

        return work

    return scanner


def _counts(texts: list, split: list, covers: list) -> list[pa.Array]:
    """``n_words``, ``n_hit`` and ``spans``."""
    return [
        pa.array([len(found) for found in split], pa.int64()),
        pa.array([sum(b - a for a, b in cover) for cover in covers], pa.int64()),
        pa.array([char_spans(text, cover) if cover else [] for text, cover in zip(texts, covers)], _SPANS),
    ]


def _hits(texts: DataFrame, block: DataFrame, window: int) -> DataFrame:
    """What one block finds, a row for each different text with hits."""
    key = ["__h1", "__h2"]
    found = map_text(texts, key, "__t", "ranges array<array<int>>, items array<string>", _finder(block, window, whole=False))
    once = found.where("size(items) > 0").groupBy(*key).agg(F.first("ranges").alias("ranges"), F.first("items").alias("items"))
    return materialize(once, "decontamination")


def _joined(keyed: DataFrame, hits: DataFrame, names: list[str]) -> DataFrame:
    """The documents with the hits of all blocks."""
    of_text = hits.groupBy(F.col("__h1").alias("h1"), F.col("__h2").alias("h2")).agg(
        F.flatten(F.collect_list("ranges")).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    of_text = materialize(of_text, "decontamination")
    on = "__h1 = h1 and __h2 = h2"
    size = of_text.agg(F.coalesce(F.sum(F.size("ranges") + F.size("items") + 4), F.lit(0))).first()[0]
    if size <= SMALL:
        of_text = F.broadcast(of_text)
    else:  # copies of one text may be many
        counts = keyed.groupBy("__h1", "__h2").agg(F.count("*").alias("n"))
        keyed, of_text = dealt(keyed, of_text, {"__h1": "h1", "__h2": "h2"}, counts, keyed.count(), names)
        on += " and salt = f_salt"
    met = keyed.join(of_text, F.expr(on), "left").select(*names, "__t", "ranges", "items")
    none = {c: F.coalesce(c, F.array().cast(met.schema[c].dataType)) for c in ("ranges", "items")}
    met = met.withColumns(none)
    added = "n_words long, n_hit long, spans array<struct<start:int,end:int>>"
    kept = met.drop("__t", "ranges").schema
    schema = type(kept)(list(kept.fields) + list(met.sparkSession.createDataFrame([], added).schema.fields))

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("__t")):
                texts = part.column("__t").to_pylist()
                covers = [merged(map(tuple, x)) for x in part.column("ranges").to_pylist()]
                arrays = _counts(texts, [words(t) for t in texts], covers)
                rest = part.drop_columns(["__t", "ranges"])
                yield pa.RecordBatch.from_arrays(rest.columns + arrays, names=schema.names)

    return in_small_batches(map_batches(met, run, schema))


_last: dict = {}


def _built(shared, window: int):
    """The automaton of a broadcast block, kept while a worker lives."""
    if _last.get("block") is not shared or _last.get("window") != window:
        _last.update(block=shared, window=window, scanner=Scanner(shared.value, window))
    return _last["scanner"].scan


def char_spans(text: str, cover: list[tuple[int, int]]) -> list[dict]:
    """Character ranges of ranges of words."""
    places = [m.span() for m in _ORIGINAL_WORD.finditer(text)]
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in cover]


def decontaminate(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without those that hold a benchmark window; columns unchanged."""
    columns = documents.columns
    names = [f"__c{i}" for i in range(len(columns))]
    plain = documents.toDF(*names)
    text = names[columns.index(text_col)]
    found = contamination(plain, benchmark, names[0], text, keep=names, **options)
    return found.where("n_hit = 0").select(*names).toDF(*columns)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract query: benchmark hits of every whole document."""
    found = contamination(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i)
  WHERE len(w) > 0),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM lowered, (SELECT DISTINCT n FROM windows) AS k, unnest(range(1, len(w) - n + 2)) AS r(i)),
hits AS (
  SELECT g.doc_id, g.i, g.n, x.item FROM grams AS g JOIN windows AS x ON g.n = x.n AND g.win = x.win),
covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n_hit FROM hits, unnest(range(0, n)) AS r(d) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, coalesce(n.items_sha256, sha256('')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AS contaminated
FROM lowered AS l LEFT JOIN covered AS c USING (doc_id) LEFT JOIN named AS n USING (doc_id)
"""
