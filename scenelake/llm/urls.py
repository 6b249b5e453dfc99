"""URL filters by a ratio of character language models.

Rules judge the URLs that they fit; those URLs are the examples. Two models,
of accepted and of rejected URLs, give the next character's probability from
contexts of up to ``ORDER`` characters, each order smoothed by the next shorter
one after Witten and Bell; the longest context that the examples have is used, so
its length varies. The log-likelihood difference by character is compared with a
cut.

The models read a URL without its scheme and without the last two labels of its
host, as rules name those: else the models would learn to tell the rules' hosts
and top-level domains, which say nothing of other URLs. Digits all read as 0, as
numbers in URLs are mostly serial.

The cut is calibrated on examples whose rules the counts do not know: the rules of
each verdict are dealt out over two folds, and a fold's examples are scored by the
other fold's counts. (Where a verdict has one rule only, folds go by a hash of the
URL.) ``Filter.errors`` tells how the examples of each rule fared at the cut.

All counts are used, those of characters seen once too. Up to ``ENTRIES`` of them are sent to the workers; a larger
table stays in the shared folder and is joined to the distinct windows of
``ORDER + 1`` characters of the URLs, with the same results.

Defined results:
- null URL or one without ``://``: empty host and path, no rule; the models judge
  what text there is, and an empty or null URL is allowed;
- without examples of both kinds the models allow all;
- repeated rows are judged each for itself, an empty table gives no rows;
- further columns are not read, whatever their names; an added column that is
  named like a kept one gets ``_new``.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, discard, in_small_batches, map_batches, materialize

ORDER = 5
#: Counts that workers hold at most; a larger table is joined instead.
ENTRIES = 200_000
#: The most common windows, sent to workers where the rest is joined.
COMMON = 20_000
#: Steps of the difference by character, for calibration.
STEP = 0.01

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_digits = re.compile(r"[0-9]").sub
_host = re.compile(r"[^/?#]*").match


def host_and_path(url_col: str) -> tuple[Column, Column]:
    """Host and path of a URL as expressions."""
    rest = F.when(F.instr(F.col(url_col), "://") > 0, F.expr(f"substr(`{url_col}`, instr(`{url_col}`, '://') + 3)"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def told(url: str | None) -> str:
    """The URL without its scheme and the last two labels of its host; all of a text without ``://``."""
    _, scheme, rest = (url or "").partition("://")
    if not scheme:
        return url or ""
    host = _host(rest)[0]
    return ".".join(host.split(".")[:-2]) + rest[len(host) :]


def symbols(url: str | None) -> str:
    """What the models read: start marks, what is told of the URL with digits as 0, an end mark."""
    return "\x02" * ORDER + _digits("0", told(url)) + "\x03"


class Markov:
    """Smoothed variable-order models of two classes over the same contexts."""

    def __init__(self, grams: dict[str, tuple[int, int]]):
        self.grams = grams
        self.contexts: dict[str, list[int]] = {}
        for gram, (rejected, accepted) in grams.items():
            have = self.contexts.setdefault(gram[:-1], [0, 0, 0, 0])
            have[0] += rejected
            have[1] += rejected > 0
            have[2] += accepted
            have[3] += accepted > 0

    def difference(self, url: str | None) -> float:
        """Log-likelihood by character as accepted, less that as rejected."""
        text = symbols(url)
        total = 0.0
        none = (0, 0)
        for i in range(ORDER, len(text)):
            rejected = accepted = 1 / 256
            for n in range(ORDER + 1):
                context = self.contexts.get(text[i - n : i])
                if context is None:
                    break
                gram = self.grams.get(text[i - n : i + 1], none)
                if context[0]:
                    rejected = (gram[0] + context[1] * rejected) / (context[0] + context[1])
                if context[2]:
                    accepted = (gram[1] + context[3] * accepted) / (context[2] + context[3])
            total += math.log(accepted / rejected)
        return total / (len(text) - ORDER)


def _count(examples: DataFrame) -> DataFrame:
    """``gram`` and its counts ``c0`` to ``c3`` by class and half, over all examples."""

    def run(batches):
        seen: Counter = Counter()

        def flush():
            rows = [(g, [n if i == slot else 0 for i in range(4)]) for (g, slot), n in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string())]
                + [pa.array([r[1][i] for r in rows], pa.int64()) for i in range(4)],
                names=["gram", "c0", "c1", "c2", "c3"],
            )

        for batch in batches:
            for url, accepted, half in zip(*(c.to_pylist() for c in batch.columns)):
                text, slot = symbols(url), 2 * half + accepted
                for n in range(ORDER + 1):
                    seen.update((text[i - n : i + 1], slot) for i in range(ORDER, len(text)))
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    counts = map_batches(examples, run, "gram string, c0 long, c1 long, c2 long, c3 long")
    totals = counts.groupBy("gram").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(4)])
    return materialize(totals, "url-grams")


def _windows(urls: DataFrame) -> DataFrame:
    """``id``, ``place`` and ``window`` (a character and the ``ORDER`` before it) of each ``id`` and ``url``."""

    def run(batches):
        for batch in batches:
            for at, url in zip(*(c.to_pylist() for c in batch.columns)):
                text = symbols(url)
                for start in range(0, len(text) - ORDER, 10_000):
                    places = range(start, min(start + 10_000, len(text) - ORDER))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([at] * len(places), pa.int64()),
                            pa.array(places, pa.int32()),
                            pa.array([text[i : i + ORDER + 1] for i in places], pa.string()),
                        ],
                        names=["id", "place", "window"],
                    )

    return map_batches(urls.select("id", "url"), run, "id long, place int, window string")


def _terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``window`` and ``n``, with its log ratios ``t0``, ``t1`` (by the other half's counts) and ``t`` (by all).

    Ends of windows are told apart before each join, so a key meets a row for each character at most.
    """
    sums = [F.sum(f"c{i}").alias(f"s{i}") for i in range(4)]
    kinds = [F.sum((F.col(f"c{i}") > 0).cast("long")).alias(f"k{i}") for i in range(4)]
    kinds += [F.sum((F.col(f"c{i}") + F.col(f"c{i + 2}") > 0).cast("long")).alias(f"k{i + 4}") for i in range(2)]
    contexts = counts.groupBy(F.expr("left(gram, length(gram) - 1)").alias("context")).agg(*sums, *kinds)
    whole = materialize(windows.groupBy("window").agg(F.count("*").alias("n")), "url-windows")
    tails = F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda n: F.right("window", n))
    ends = whole.select(F.explode(tails).alias("end")).distinct().withColumn("before", F.expr("left(end, length(end) - 1)"))
    ends = ends.join(contexts, F.col("before") == F.col("context"), "left")
    ends = materialize(ends.join(counts, F.col("end") == F.col("gram"), "left").na.fill(0), "url-ends")
    # Names of the counts, sums and kinds by model and class.
    parts = {
        "p0": ("c2", "s2", "k2"), "q0": ("c3", "s3", "k3"),
        "p1": ("c0", "s0", "k0"), "q1": ("c1", "s1", "k1"),
        "p": ("c0 + c2", "s0 + s2", "k4"), "q": ("c1 + c3", "s1 + s3", "k5"),
    }
    smoothed = None
    for size in range(1, ORDER + 2):
        rows = ends.where(F.length("end") == size)
        if smoothed is None:
            rows = rows.withColumns({f"{m}_": F.lit(1 / 256) for m in parts})
        else:
            rows = rows.join(smoothed, F.right("end", F.lit(size - 1)) == F.col("tail"))
        chances = [
            F.expr(f"if({s} > 0, ({c} + {k} * {m}_) / ({s} + {k}), {m}_)").alias(f"{m}_") for m, (c, s, k) in parts.items()
        ]
        smoothed = rows.select(F.col("end").alias("tail"), *chances)

    def run(batches):
        for batch in batches:
            values = [c.to_pylist() for c in batch.columns[2:]]
            terms = [[math.log(q / p) for p, q in zip(*values[i : i + 2])] for i in (0, 2, 4)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *[pa.array(t, pa.float64()) for t in terms]], names=["window", "n", "t0", "t1", "t"]
            )

    named = whole.join(smoothed, F.col("window") == F.col("tail")).select("window", "n", *[f"{m}_" for m in parts])
    terms = materialize(map_batches(named, run, "window string, n long, t0 double, t1 double, t double"), "url-terms")
    discard(whole)
    discard(ends)
    return terms


def differences(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """``url`` and its differences ``d0``, ``d1`` and ``d`` by all ``counts``, a row for each distinct URL but null."""
    known = urls.select("url").where("url is not null").distinct().withColumn("id", F.monotonically_increasing_id())
    known = materialize(known, "url-known")
    windows = _windows(known)
    terms = _terms(windows, counts)
    # Windows of very many URLs are sent to the workers, the others joined.
    common = materialize(terms.orderBy(F.desc("n"), "window").limit(COMMON).drop("n"), "url-common")
    met = windows.join(F.broadcast(common), "window")
    others = windows.join(F.broadcast(common.select("window")), "window", "left_anti").join(terms.drop("n"), "window")
    # The sum goes by place, as that of Markov.difference.
    rows = met.unionByName(others).groupBy("id")
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("place", "t0", "t1", "t"))).alias("rows"))
    total = lambda t: F.aggregate("rows", F.lit(0.0), lambda s, r: s + r[t]) / F.size("rows")
    sums = rows.select("id", total("t0").alias("d0"), total("t1").alias("d1"), total("t").alias("d"))
    found = materialize(known.join(sums, "id").drop("id"), "url-differences")
    for table in (known, terms, common):
        discard(table)
    return found


class Filter:
    """The models and their cut; ``found`` holds the differences where the counts are too many for a worker.

    ``errors``: rule -> (wrong, all), of its examples as the other fold's counts judge them.
    """

    def __init__(self, markov: Markov | None, cut: float, found: DataFrame | None = None, errors: dict | None = None):
        self.markov, self.cut, self.found, self.errors = markov, cut, found, errors or {}


def _fold(rule: Column, verdict: Column, rules) -> Column:
    """The fold of an example: its rule's, dealt out by verdict, or that of ``__url`` where a verdict has one rule."""
    of = {v: sorted(h + p for h, p, w in rules if w == v) for v in ("allow", "block")}
    if min(map(len, of.values())) < 2:
        return F.pmod(F.xxhash64("__url"), F.lit(2)).cast("int")
    odd = [name for names in of.values() for name in names[1::2]]
    return rule.isin(odd).cast("int")


def train(judged: DataFrame, url_col: str, verdict_col: str, rule_col: str, rules=RULES) -> Filter:
    """Fit on all rows whose verdict is set."""
    spark = judged.sparkSession
    examples = judged.where(F.col(verdict_col).isNotNull()).withColumn("__url", F.col(url_col)).select(
        F.col(url_col).alias("url"),
        (F.col(verdict_col) == "allow").cast("int").alias("accepted"),
        _fold(F.col(rule_col), F.col(verdict_col), rules).alias("half"),
        F.col(rule_col).alias("rule"),
    )
    examples = materialize(examples, "url-examples")
    grams = _count(examples.select("url", "accepted", "half"))
    size, *slots = grams.agg(F.count("*"), *[F.coalesce(F.sum(f"c{i}"), F.lit(0)) for i in range(4)]).first()
    if not (slots[0] + slots[2] and slots[1] + slots[3]):
        discard(examples)
        discard(grams)
        return Filter(None, 0.0)
    if size > ENTRIES:
        found = differences(judged.select(F.col(url_col).alias("url")), grams)
        by_half = F.when(F.col("half") == 0, F.col("d0")).otherwise(F.col("d1"))
        step = F.rint(by_half / F.lit(STEP)).cast("long").alias("step")
        table = examples.join(found, "url").groupBy(step, "accepted", "rule").agg(F.count("*").alias("n")).collect()
        discard(examples)
        discard(grams)
        cut = _cut(table)
        return Filter(None, cut, found, _errors(table, cut))
    counts = grams.collect()
    discard(grams)
    whole = Markov({r.gram: (r.c0 + r.c2, r.c1 + r.c3) for r in counts})
    halves = [{r.gram: (r.c2, r.c3) for r in counts if r.c2 + r.c3}, {r.gram: (r.c0, r.c1) for r in counts if r.c0 + r.c1}]
    shared = spark.sparkContext.broadcast(halves)

    def run(batches):
        models = [Markov(g) for g in shared.value]
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            found = Counter((round(models[h].difference(u) / STEP), a, r) for u, a, h, r in zip(*columns))
            keys = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int32()),
                    pa.array([k[2] for k in keys], pa.string()),
                    pa.array([found[k] for k in keys], pa.int64()),
                ],
                names=["step", "accepted", "rule", "n"],
            )

    scored = map_batches(examples, run, "step long, accepted int, rule string, n long")
    table = scored.groupBy("step", "accepted", "rule").agg(F.sum("n").alias("n")).collect()
    discard(examples)
    cut = _cut(table)
    return Filter(whole, cut, None, _errors(table, cut))


def _errors(table: list, cut: float) -> dict[str, tuple[int, int]]:
    """Of each rule's examples, how many are on the wrong side of the cut, and how many there are."""
    out: dict[str, list[int]] = {}
    for r in table:
        have = out.setdefault(r.rule, [0, 0])
        have[0] += r.n * ((r.step * STEP >= cut) != bool(r.accepted))
        have[1] += r.n
    return {rule: tuple(have) for rule, have in sorted(out.items())}


def _cut(table: list) -> float:
    """The cut with the least sum of the two error rates, nearest to 0 among equals."""
    totals = [max(1, sum(r.n for r in table if r.accepted == a)) for a in (0, 1)]
    by_step: dict[int, list[int]] = {}
    for r in table:
        by_step.setdefault(r.step, [0, 0])[r.accepted] += r.n
    steps = sorted(by_step)
    best, kept = None, totals[0] if any(r.accepted == 0 for r in table) else 0
    lost = 0
    for step in [*steps, steps[-1] + 1]:  # allowed from this step up
        value = (kept / totals[0] + lost / totals[1], abs(step), step)
        best = min(best, value) if best else value
        have = by_step.get(step, [0, 0])
        kept, lost = kept - have[0], lost + have[1]
    return (best[2] - 0.5) * STEP


def judge(pages: DataFrame, keep: list[str], url_col: str = "url", rules=RULES) -> DataFrame:
    """``keep`` columns, ``host``, ``path``, ``rule``, ``verdict`` and ``difference``, a row for each input row."""
    names = [f"__k{i}" for i in range(len(keep))]
    plain = pages.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(url_col).alias("__url"))
    host, path = host_and_path("__url")
    judged = plain.withColumns({"host": host, "path": path})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "verdict": verdict})
    model = train(judged, "__url", "verdict", "rule", rules)
    added = ["host", "path", "rule", "verdict", "difference"]
    if model.found is not None:
        return _by_table(judged, model).select(*names, *added).toDF(*keep, *beside(keep, added))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    out = judged.select(*names, "host", "path", "rule", "verdict", "__url")
    schema = type(out.schema)(out.schema.fields[:-1]).add("difference", "double")

    def run(batches):
        markov, cut = shared.value.markov, shared.value.cut
        for batch in batches:
            *columns, verdicts, urls = batch.columns
            verdicts, urls = verdicts.to_pylist(), urls.to_pylist()
            found = [markov.difference(u) if markov and u else 0.0 for u in urls]
            verdicts = [
                v or ("allow" if not (markov and u) or d >= cut else "block") for v, u, d in zip(verdicts, urls, found)
            ]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(verdicts, pa.string()), pa.array(found, pa.float64())], names=schema.names
            )

    return in_small_batches(map_batches(out, run, schema)).select(*names, *added).toDF(*keep, *beside(keep, added))


def _by_table(judged: DataFrame, model: Filter) -> DataFrame:
    """``judged`` with its verdicts filled and ``difference``, by the table of differences."""
    found = model.found.where("url <> ''").select("url", F.col("d").alias("difference"))
    done = judged.join(found, F.col("__url") == F.col("url"), "left")
    by_model = F.when(F.col("difference") < model.cut, "block").otherwise("allow")
    verdict = F.coalesce("verdict", by_model)
    return done.withColumns({"verdict": verdict, "difference": F.coalesce("difference", F.lit(0.0))})


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Contract query: judge every page's URL."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id"])
