"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A document is the sequence of its lines that hold a word. The window of a line
is the shortest run of lines from it on with ``MIN_WORDS`` words. Each window
selects the place of its least line hash (the last one on a tie), so equal
windows select the same line of theirs, and any repeated run of that many words
has a selected place: the guarantee of winnowing. Neighbouring windows mostly
select the same place; of the lines of the test documents 59 in a hundred are
selected, and only those whose hash is selected at two places or more are joined.

Selected places are joined by that hash. As one line may stand in different
windows, the windows that select it are told apart by the hash of all their
lines; each of them meets its first occurrence, in the order of id and place.
Such pairs of places are extended both ways as far as the lines of the two
documents are equal; every line of the later run is deleted. So of a passage
that many documents share, the first document keeps it.

The work is linear: an occurrence meets the first one only, never all others,
and no line of a document is compared once for each of its partners:

- from its selected place a pair reaches both ends of its window at once, as the
  hash of the window's lines says that they are equal;
- a run that goes on holds the next window whole, which is a later occurrence
  too. So the windows of later occurrences, as stretches of lines, cover every
  run but for a tail of fewer than ``min_words`` words behind a stretch, and
  backwards no line is left;
- only a pair whose partner goes on with the line behind the stretch has a tail.
  It is followed from the pair's last window on.

Keys that very many rows share are dealt out over salts. Joins are merge joins by
hint: the planner takes the size of a table from its compressed files and does
not count what an explode adds, so it would broadcast far larger tables than it
means to. Only hot keys, 10,000 at most, and few deletions are broadcast.

Defined results:
- lines without a word are no part of runs and stay; null text stays null;
- rows that repeat an id and a text get the same result, as one document;
- rows that repeat an id with different texts are told apart by their text;
- a null id comes first in the order; an empty table gives no rows;
- further columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL, materialize, scratch

MIN_WORDS = 50
#: Rows that a key of a join may bring to a task before it gets salts.
HOT = 20_000


def _lines(docs: DataFrame) -> DataFrame:
    """``id``, ``th``, ``at`` (words before), ``pos``, ``words``, ``h`` and ``next`` (hash of the line behind) of the lines with words."""
    word_count = lambda x: F.regexp_count(x, F.lit(r"[^ \t\x0B\f\r]+"))
    of_text = F.transform(
        F.split("text", "\n"),
        lambda x: F.struct(F.xxhash64(F.trim(x)).alias("h"), word_count(x).alias("words")),
    )
    arrays = docs.where("text is not null").select(
        "id", "th", F.filter(of_text, lambda x: x["words"] > 0).alias("lines")
    )
    single = arrays.groupBy("id", "th").agg(F.first("lines").alias("lines"))
    rows = single.select("id", "th", F.posexplode("lines").alias("pos", "x"))
    along = Window.partitionBy("id", "th").orderBy("pos")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "id",
        "th",
        "pos",
        F.col("x.h").alias("h"),
        F.lead("x.h").over(along).alias("next"),
        F.col("x.words").cast("long").alias("words"),
        F.coalesce(F.sum("x.words").over(before), F.lit(0)).cast("long").alias("at"),
    )


def _fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """The selected places: ``fp`` (the line's hash), ``id``, ``th``, ``pos``, and ``runs``: of the windows that select it the hash, the first and last line, and the line behind."""
    # A line belongs to the window of line p if fewer than min_words words lie between their starts.
    ahead = Window.partitionBy("id", "th").orderBy("at").rangeBetween(0, min_words - 1)
    windows = lines.select(
        "id",
        "th",
        F.col("pos").alias("lo"),
        F.sum("words").over(ahead).alias("total"),
        F.collect_list(F.struct("h", (-F.col("pos")).alias("back"), "next")).over(ahead).alias("window"),
    ).where(F.col("total") >= min_words)
    least, last = F.array_min("window"), F.element_at("window", -1)
    run = F.xxhash64(F.transform("window", lambda x: x["h"])).alias("run")
    chosen = windows.select(
        "id",
        "th",
        (-least["back"]).alias("pos"),
        least["h"].alias("fp"),
        F.struct(run, "lo", (-last["back"]).alias("hi"), last["next"].alias("next")).alias("run"),
    )
    return chosen.groupBy("id", "th", "pos", "fp").agg(F.collect_list("run").alias("runs"))


def _dealt(many: DataFrame, few: DataFrame, keys: dict[str, str], counts: DataFrame, total: int, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with a ``salt``, so that a hot key's rows of ``many`` go to several tasks.

    ``keys``: column of ``many`` -> column of ``few``; ``counts``: the former and
    ``n``, the rows of ``many``, ``total`` at most in all; ``by``: what deals a
    key's rows out. A key is hot from ``HOT`` rows up, or from a 10,000th of all
    if that is more, so at most 10,000 keys are broadcast. ``few`` is copied for
    each salt of a hot key.
    """
    most = max(HOT, total // 10_000)
    names = {c: f"hot_{c}" for c in keys}
    salts = F.ceil(F.col("n") / most).alias("salts")
    hot = F.broadcast(counts.where(F.col("n") > most).select(*[F.col(c).alias(n) for c, n in names.items()], salts))
    of_many = many.join(hot, F.expr(" and ".join(f"{c} <=> {n}" for c, n in names.items())), "left")
    salt = F.coalesce(F.pmod(F.xxhash64(*by), "salts"), F.lit(0).cast("long")).alias("salt")
    of_few = few.join(hot, F.expr(" and ".join(f"{keys[c]} <=> {n}" for c, n in names.items())), "left")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))
    return of_many.select(*many.columns, salt), of_few.select(*few.columns, copies.alias("f_salt"))


def deletions(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """``id``, ``th`` (hash of the text) and ``gone``, for documents that lose lines.

    ``gone``: ranges (``start``, ``end``, both deleted) of positions among the lines that hold a word.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with scratch():
        lines = materialize(_lines(docs.withColumn("th", F.xxhash64("text"))), "lines")
        places = materialize(_fingerprints(lines, min_words), "line-fingerprints")
        pairs = materialize(_stretches(_seeds(places)), "line-pairs")
        tails = materialize(_going_on(lines, pairs), "line-tails")
        ranges = pairs.select("id", "th", "start", "end").distinct().unionByName(_followed(lines, tails, min_words))
        gone = ranges.groupBy("id", "th").agg(F.collect_set(F.struct("start", "end")).alias("gone"))
        return materialize(gone, "line-deletions", keep=True)


def _seeds(places: DataFrame) -> DataFrame:
    """Selected places joined by their fingerprints: the windows ``lo`` to ``hi`` of ``id``, ``th``, the line behind (``next``), the first occurrence ``id1``, ``th1`` and the ``shift`` to it."""
    place = F.struct("id", "th", "pos")
    # A fingerprint at one place only is in no repeated window.
    ends = places.groupBy("fp").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    shared = ends.where(~F.col("first").eqNullSafe(F.col("last"))).select("fp")
    met = places.join(shared.hint("merge"), "fp", "left_semi").select("fp", "id", "th", "pos", F.inline("runs"))
    # One fingerprint may stand in different windows: those that are equal have a first occurrence.
    runs = met.groupBy("fp", "run").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    runs = runs.where(~F.col("first").eqNullSafe(F.col("last")))
    first = runs.select(F.col("fp").alias("f_fp"), F.col("run").alias("f_run"), "first")
    later, first = _dealt(met, first, {"fp": "f_fp", "run": "f_run"}, runs.select("fp", "run", "n"), places.count() * MIN_WORDS, ["id", "th", "pos"])
    found = later.join(first.hint("merge"), F.expr("fp = f_fp and run = f_run and salt = f_salt")).where(~place.eqNullSafe(F.col("first")))
    return found.select(
        "id", "th", "lo", "hi", "next", F.col("first.id").alias("id1"), F.col("first.th").alias("th1"), (F.col("pos") - F.col("first.pos")).alias("shift")
    )


def _stretches(seeds: DataFrame) -> DataFrame:
    """The pairs of each stretch ``start`` to ``end`` of overlapping windows: ``top`` is the pair's last line in it, ``next`` the line behind the stretch."""
    along = Window.partitionBy("id", "th").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("hi").over(along)
    opens = seeds.withColumn("opens", (reached.isNull() | (F.col("lo") > reached + 1)).cast("int"))
    upto = Window.partitionBy("id", "th").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    numbered = opens.withColumn("stretch", F.sum("opens").over(upto))
    pairs = numbered.groupBy("id", "th", "stretch", "id1", "th1", "shift").agg(
        F.min("lo").alias("lo"), F.max(F.struct("hi", "next")).alias("last")
    )
    whole = Window.partitionBy("id", "th", "stretch")
    pairs = pairs.withColumns({"start": F.min("lo").over(whole), "end": F.max("last").over(whole)})
    return pairs.select("id", "th", "start", "end.hi", "end.next", "id1", "th1", "shift", F.col("last.hi").alias("top")).withColumnRenamed("hi", "end")


def _going_on(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose partner has the line behind the stretch at its place."""
    behind = pairs.where("next is not null").withColumn("pos1", F.col("end") + 1 - F.col("shift"))
    met = _beside(behind, lines, "next")
    return met.select("id", "th", "end", "id1", "th1", "shift", "top")


def _beside(rows: DataFrame, lines: DataFrame, hash_col: str) -> DataFrame:
    """The rows whose line ``pos1`` of the partner ``id1``, ``th1`` has the hash ``hash_col``."""
    earlier = lines.select(*[F.col(c).alias(f"e_{c}") for c in ("id", "th", "pos", "h")])
    counts = rows.groupBy("id1", "th1", "pos1").agg(F.count("*").alias("n"))
    keys = {"id1": "e_id", "th1": "e_th", "pos1": "e_pos"}
    rows, earlier = _dealt(rows, earlier, keys, counts, rows.count(), ["id", "th", "shift"])
    on = F.expr(f"id1 <=> e_id and th1 = e_th and pos1 = e_pos and salt = f_salt and {hash_col} = e_h")
    return rows.join(earlier.hint("merge"), on)


def _followed(lines: DataFrame, tails: DataFrame, min_words: int) -> DataFrame:
    """Tails behind stretches, ``start`` to ``end``, of pairs that are equal from their last window on."""
    # A tail has fewer than min_words words, and a word a line at least.
    upto = F.explode(F.sequence(F.col("top") + 1, F.col("end") + min_words - 1)).alias("pos")
    reach = tails.select("*", upto).withColumn("pos1", F.col("pos") - F.col("shift"))
    own = lines.select(F.col("id").alias("o_id"), F.col("th").alias("o_th"), F.col("pos").alias("o_pos"), "h")
    reach = reach.join(own.hint("merge"), F.expr("id <=> o_id and th = o_th and pos = o_pos"))
    equal = _beside(reach, lines, "h")
    pair = ["id", "th", "id1", "th1", "shift", "end", "top"]
    nth = F.row_number().over(Window.partitionBy(*pair).orderBy("pos"))
    unbroken = equal.select(*pair, "pos", nth.alias("nth")).where("pos = top + nth")
    ends = unbroken.groupBy(*pair).agg(F.max("pos").alias("z")).where(F.col("z") > F.col("end"))
    return ends.select("id", "th", (F.col("end") + 1).alias("start"), F.col("z").alias("end"))


def dedup_lines(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    added: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """The documents with ``text`` less its deleted lines, all columns kept, and two counts ``added``: lines, and deleted lines."""
    columns = documents.columns
    names = [f"__c{i}" for i in range(len(columns))]
    plain = documents.toDF(*names)
    key, text = names[columns.index(id_col)], names[columns.index(text_col)]
    gone = deletions(plain, key, text, min_words)
    few = gone.agg(F.coalesce(F.sum(F.size("gone") + 4), F.lit(0))).first()[0] <= SMALL  # about 30 bytes each
    gone = F.broadcast(gone) if few else gone.hint("shuffle_hash")  # which does not sort the texts
    joined = plain.withColumn("__th", F.xxhash64(text)).join(
        gone, F.col(key).eqNullSafe(F.col("id")) & (F.col("__th") == F.col("th")) & F.col(text).isNotNull(), "left"
    )
    # Columns that are used twice stay columns; else each line would cut the text anew.
    joined = joined.withColumn("__split", F.split(text, "\n"))
    worded = F.filter(
        F.transform("__split", lambda x, i: F.when(x.rlike(r"[^ \t\x0B\f\r]"), i)), lambda i: i.isNotNull()
    )
    joined = joined.withColumn("__worded", F.when(F.col("gone").isNotNull(), worded))
    places = F.flatten(F.transform("gone", lambda x: F.sequence(x["start"], x["end"])))
    every = F.sequence(F.lit(0), F.size("__split") - 1)
    left = F.array_except(every, F.transform(places, lambda p: F.get("__worded", p)))
    joined = joined.withColumn("__kept", F.when(F.size("__worded") > 0, left))
    kept = F.array_join(F.transform("__kept", lambda i: F.get("__split", i)), "\n")
    return joined.select(
        *[
            F.when(F.col("gone").isNull(), F.col(text)).otherwise(kept).alias(c) if n == text else F.col(n).alias(c)
            for c, n in zip(columns, names)
        ],
        F.when(F.col(text).isNull(), 0).otherwise(F.size("__split")).cast("long").alias(added[0]),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("__split") - F.size("__kept")).cast("long").alias(added[1]),
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: what each whole document keeps."""
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


OP4_SQL = r"""
WITH split AS (
  SELECT doc_id, i - 1 AS line, l[i] AS content,
    len(regexp_extract_all(l[i], '[^ \t\x0B\f\r]+')) AS words
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i)),
lines AS (
  SELECT doc_id, line, trim(content, ' ') AS content, words,
    row_number() OVER w AS pos,
    coalesce(sum(words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM split WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
windows AS (
  SELECT doc_id, pos, sum(words) OVER w AS total, string_agg(content, chr(10)) OVER w AS win
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
first AS (
  SELECT win, min(struct_pack(d := doc_id, p := pos)) AS f FROM windows WHERE total >= 50 GROUP BY win HAVING count(*) > 1),
seeds AS (
  SELECT DISTINCT doc_id, f.d AS id1, pos - f.p AS shift, pos FROM windows JOIN first USING (win)
  WHERE total >= 50 AND (doc_id <> f.d OR pos <> f.p)),
equal AS (
  SELECT s.doc_id, s.id1, s.shift, a.pos, a.line,
    a.pos - row_number() OVER (PARTITION BY s.doc_id, s.id1, s.shift ORDER BY a.pos) AS run
  FROM (SELECT DISTINCT doc_id, id1, shift FROM seeds) AS s
  JOIN lines AS a ON a.doc_id = s.doc_id
  JOIN lines AS b ON b.doc_id = s.id1 AND b.pos = a.pos - s.shift AND b.content = a.content),
gone AS (
  SELECT DISTINCT e.doc_id, e.line FROM equal AS e JOIN (
    SELECT DISTINCT e.doc_id, e.id1, e.shift, e.run FROM equal AS e JOIN seeds AS s
    ON e.doc_id = s.doc_id AND e.id1 = s.id1 AND e.shift = s.shift AND e.pos = s.pos) AS r
  ON e.doc_id = r.doc_id AND e.id1 = r.id1 AND e.shift = r.shift AND e.run = r.run),
kept AS (
  SELECT s.doc_id, count(g.line) AS n_removed,
    string_agg(s.content, chr(10) ORDER BY s.line) FILTER (g.line IS NULL) AS rest
  FROM split AS s LEFT JOIN gone AS g ON g.doc_id = s.doc_id AND g.line = s.line GROUP BY s.doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.rest, '')) AS kept_sha256
FROM documents AS d LEFT JOIN kept AS k USING (doc_id)
"""
