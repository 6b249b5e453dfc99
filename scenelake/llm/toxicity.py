"""Toxicity by maximum-scoring segments.

Every word has a log-odds score, toxic against clean, from document counts with
Dirichlet priors: a word's prior is that of its longest stem (its first letters),
a stem's prior is that of the next shorter one, and the shortest stem's is the
share of the classes. A word that no training text holds has the score of its
longest known stem. The k-th repeat of a word in a text weighs 1/k, as words come
in bursts. A linear scan (Ruzzo and Tompa) finds all maximal segments of a text,
whose scores are put on the scale of Karlin and Altschul: with lambda and K from
clean texts, the number of segments that reach a score by chance is Poisson with
mean ``K n exp(-lambda S)``. The sum statistic of the best r segments, for the
best r, is a document's evidence; a logistic curve maps it to a probability.
Lambda, K and the curve are fitted on scores that each half of the training rows
gets from the other half's counts.

All words and stems of the training rows are counted. The model holds them as
64-bit hashes, twelve bytes each.

Defined results:
- null or empty text, or text without letters: no segments, lowest evidence;
- equal training texts count once, with the label that most of their rows have
  (0 on a tie), so the model is the same however the tables are partitioned;
- repeated rows are scored each for itself, an empty table gives no rows;
- without usable labels of both classes every score is the prior (0.5 at worst);
- further columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_small_batches, map_batches, map_text, materialize, slices
from .training import held_out, labelled_sample

#: Labelled rows that training takes at most.
SAMPLE = 20_000
#: Lengths of stems.
STEMS = (3, 4, 5, 6, 7, 8)
#: Pseudo-documents of a prior.
PRIOR = 4.0
#: Subtracted from every score, so that a clean text drifts down.
DRIFT = 1.0
#: Words whose scores a worker remembers.
REMEMBERED = 100_000
_GRID = np.linspace(0.1, 3.0, 59)

_word = re.compile(r"[^\W\d_]+").findall
_WORD, _STEM = 0, 1


def stems(word: str) -> list[str]:
    """The proper stems of a word, the longest first."""
    return [word[:n] for n in reversed(STEMS) if n < len(word)]


def key(unit: str, kind: int) -> int:
    """A 64-bit hash that tells words and stems apart."""
    return xxhash.xxh3_64_intdigest(unit.encode("utf-8", "surrogatepass"), kind)


class Scores:
    """Scores of words: sorted hashes of words and stems with a score each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, unknown: float):
        self.keys, self.values, self.unknown = keys, values, unknown
        self.memo: dict[str, float] = {}

    def __getstate__(self):
        return self.keys, self.values, self.unknown

    def __setstate__(self, state):
        self.__init__(*state)

    def held(self, keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes the model holds, and their scores."""
        wanted = np.array(keys, np.uint64)
        if not self.keys.size:
            return np.zeros(wanted.size, bool), np.zeros(wanted.size)
        at = np.minimum(np.searchsorted(self.keys, wanted), self.keys.size - 1)
        return self.keys[at] == wanted, self.values[at]

    def look_up(self, words: list[str]) -> None:
        """Remember the scores of words: their own, or those of their longest known stems."""
        memo = self.memo
        known, values = self.held([key(w, _WORD) for w in words])
        memo.update(zip(words, np.where(known, values, self.unknown).tolist()))
        left = [w for w, k in zip(words, known.tolist()) if not k]
        for n in reversed(STEMS):
            asked = [w for w in left if len(w) > n]
            if asked:
                known, values = self.held([key(w[:n], _STEM) for w in asked])
                found = {w: v for w, k, v in zip(asked, known.tolist(), values.tolist()) if k}
                memo.update(found)
                left = [w for w in left if w not in found]

    def of(self, text: str | None) -> np.ndarray:
        """The scores of a text's words."""
        memo = self.memo
        found = _word(text.lower()) if text else []
        new = list({w for w in found if w not in memo})
        if len(memo) + len(new) > REMEMBERED:
            memo.clear()
            new = list(set(found))
        if new:
            self.look_up(new)
        scores = np.fromiter(map(memo.__getitem__, found), np.float64, len(found))
        seen: dict[str, int] = {}
        for i in np.flatnonzero(scores > 0).tolist():
            k = seen[found[i]] = seen.get(found[i], 0) + 1
            if k > 1:
                scores[i] = (scores[i] + DRIFT) / k - DRIFT
        return scores


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by the scan of Ruzzo and Tompa.

    Runs of words of one sign are taken as one step each. The list of open
    candidates keeps, for each, the index of the nearest earlier one whose left
    sum is smaller, so the scan is linear.
    """
    if not scores.size:
        return []
    up = scores > 0
    edges = np.flatnonzero(np.diff(up, prepend=not up[0]))
    ends = np.append(edges[1:], scores.size)
    totals = np.concatenate([[0.0], np.cumsum(scores)])
    out: list[list] = []  # start, end, left sum, right sum, link
    for a, b in zip(edges[up[edges]].tolist(), ends[up[edges]].tolist()):
        start, left, right = a, float(totals[a]), float(totals[b])
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= right:
                out.append([start, b, left, right, j])
                break
            start, left = out[j][0], out[j][2]
            link = out[j][4]
            del out[j:]
            j = link
    return [(s, e, r - l) for s, e, l, r, _ in out]


def evidence(found: list[float], n: int, rate: float, k: float) -> float:
    """Minus the log of the chance that clean text of n words has such best segments."""
    if not n or not found:
        return -math.log(max(n, 1)) - 5.0
    best = sorted((rate * s - math.log(k * n) for s in found), reverse=True)
    top, total = best[0], 0.0
    for r, x in enumerate(best, 1):
        total += x
        if x <= 0:
            break
        if r > 1:
            log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
            top = max(top, -log_p - (r - 1) * math.log(2))
    return top


def log_odds(units: dict[str, np.ndarray], clean: np.ndarray, toxic: np.ndarray, docs: tuple[int, int]) -> Scores:
    """The model from the documents with each unit.

    ``units``: ``key``, ``parent`` (its longest proper stem's key) and ``level``
    (a stem's letters; words above), sorted by key. Units of no document are left
    out; a unit's parent is in all its documents.
    """
    seen = clean + toxic > 0
    keys, parents, levels = (units[c][seen] for c in ("key", "parent", "level"))
    n0, n1 = np.maximum(docs[0], 1), np.maximum(docs[1], 1)
    share = n1 / (n0 + n1)
    ratios = np.zeros(keys.size)
    for level in np.unique(levels):
        rows = np.flatnonzero(levels == level)
        at = np.minimum(np.searchsorted(keys, parents[rows]), keys.size - 1)
        ratio = np.where((keys[at] == parents[rows]) & (levels[at] < level), ratios[at], 0.0)
        prior = 1 / (1 + (1 - share) / share * np.exp(-ratio))
        p1 = (toxic[seen][rows] + PRIOR * prior) / (n1 + PRIOR)
        p0 = (clean[seen][rows] + PRIOR * (1 - prior)) / (n0 + PRIOR)
        ratios[rows] = np.log(p1 / p0)
    return Scores(keys, (ratios - DRIFT).astype(np.float32), -DRIFT)


class Model:
    """Word scores, the extreme-value parameters and the logistic curve."""

    def __init__(self, scores: Scores, rate: float, k: float, slope: float, offset: float):
        self.scores, self.rate, self.k, self.slope, self.offset = scores, rate, k, slope, offset

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Probability, and the significant segments (first word, end, minus log of E)."""
        scores = self.scores.of(text)
        found = segments(scores)
        n = scores.size
        x = evidence([s for _, _, s in found], n, self.rate, self.k)
        kept = [(a, b, v) for a, b, s in found if (v := self.rate * s - math.log(self.k * n)) > 0]
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * x + self.offset)))), kept


def _count(sample: DataFrame) -> dict[str, np.ndarray]:
    """All units of the sample by ``key``, with ``parent``, ``level`` and document counts ``c0`` to ``c3`` by fold and label."""
    names = ["key", "parent", "level", "c0", "c1", "c2", "c3"]

    def run(batches):
        seen: Counter = Counter()

        def flush():
            rows = []
            for (kind, unit, slot), n in seen.items():
                longest = next(iter(stems(unit)), None)
                parent = key(longest, _STEM) if longest else 0
                rows.append((key(unit, kind), parent, STEMS[-1] + 1 if kind == _WORD else len(unit), *(n * (i == slot) for i in range(4))))
            seen.clear()
            columns = list(zip(*rows)) or [()] * 7
            keys = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns[:2]]
            return pa.RecordBatch.from_arrays(keys + [pa.array(c, pa.int64()) for c in columns[2:]], names=names)

        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                for text, label, fold in zip(*(c.to_pylist() for c in part.columns)):
                    found = set(_word(text.lower()))
                    slot = 2 * fold + label
                    seen.update((_WORD, w, slot) for w in found)
                    seen.update((_STEM, s, slot) for s in {s for w in found for s in stems(w)})
                    if len(seen) > 200_000:
                        yield flush()
        yield flush()

    counts = in_small_batches(map_batches(sample, run, ", ".join(f"{c} long" for c in names)))
    sums = [F.sum(f"c{i}").cast("int").alias(f"c{i}") for i in range(4)]
    totals = counts.groupBy("key").agg(F.min("parent").alias("parent"), F.min("level").cast("byte").alias("level"), *sums)
    table = totals.toArrow()
    order = np.argsort(table.column("key").to_numpy().view(np.uint64))
    found = {}
    for c in names:
        found[c] = table.column(c).to_numpy()[order]
        table = table.drop_columns(c)
    return {c: v.view(np.uint64) if c in ("key", "parent") else v for c, v in found.items()}


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> Model:
    """Fit the model on at most ``bound`` labels outside the held-out fold."""
    sample = labelled_sample(documents, labels, "toxic", 3, 1, bound, id_col, text_col)
    sample = sample.groupBy("text", "fold").agg((F.avg("label") > 0.5).cast("int").alias("label"))
    sample = materialize(sample.select("text", "label", "fold"), "toxicity-sample")
    docs = {(r.fold, r.label): r.n for r in sample.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    n = [docs.get((slot // 2, slot % 2), 0) for slot in range(4)]
    units = _count(sample)
    c = [units[f"c{i}"] for i in range(4)]
    whole = log_odds(units, c[0] + c[2], c[1] + c[3], (n[0] + n[2], n[1] + n[3]))
    # A fold is scored by the other fold's counts.
    crossed = [log_odds(units, c[2], c[3], (n[2], n[3])), log_odds(units, c[0], c[1], (n[0], n[1]))]
    del units, c
    shared = sample.sparkSession.sparkContext.broadcast(crossed)

    def run(batches):
        scores = shared.value
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                rows = []
                for text, label, fold in zip(*(c.to_pylist() for c in part.columns)):
                    values = scores[fold].of(text)
                    moments = np.zeros(_GRID.size)
                    for first in range(0, 0 if label else values.size, 10_000):
                        moments += np.exp(np.outer(_GRID, values[first : first + 10_000])).sum(1)
                    rows.append((label, values.size, [s for _, _, s in segments(values)], moments.tolist()))
                kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["label", "n", "found", "moments"]
                )

    scored = map_batches(sample, run, "label int, n long, found array<double>, moments array<double>")
    scored = materialize(scored, "toxicity-scored")
    shared.destroy()
    del crossed
    discard(sample)
    model = _calibrate(whole, scored, sum(n), n[1] + n[3])
    discard(scored)
    return model


def _exact(column):
    """As a decimal, whose sums do not depend on the order of rows."""
    return column.cast("decimal(38,9)")


def _calibrate(scores: Scores, scored: DataFrame, rows: int, toxic: int) -> Model:
    clean = scored.where("label = 0 and n > 0")
    sums = [F.sum(_exact(F.col("moments")[i])).alias(f"m{i}") for i in range(_GRID.size)]
    got = clean.agg(F.sum("n").alias("words"), *sums).first()
    if not got.words or not toxic:
        return Model(scores, 1.0, 0.1, 0.0, 0.0 if not rows else -4.0 if not toxic else 0.0)
    moments = np.array([float(got[f"m{i}"]) for i in range(_GRID.size)]) / got.words
    above = np.flatnonzero(moments >= 1.0)
    if not above.size:
        rate = float(_GRID[-1])
    elif above[0] == 0:
        rate = float(_GRID[0])
    else:
        i = int(above[0])
        rate = float(np.interp(1.0, moments[i - 1 : i + 1], _GRID[i - 1 : i + 1]))
    top = F.lit(rate) * F.array_max("found") - F.log("n")
    tops = clean.where("size(found) > 0").agg(F.sum(_exact(top)).alias("total"), F.count("*").alias("n")).first()
    k = math.exp(float(tops.total) / tops.n - 0.5772156649) if tops.n else 0.1

    def run(batches):
        for batch in batches:
            x = [evidence(found, n, rate, k) for n, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], names=["label", "x"])

    table = map_batches(scored.select("label", "n", "found"), run, "label int, x double").toArrow()
    y, x = table.column("label").to_numpy().astype(float), table.column("x").to_numpy()
    order = np.lexsort((x, y))
    slope, offset = logistic(x[order], y[order])
    return Model(scores, rate, k, slope, offset)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Newton's method for one input, with the targets of Platt and a small ridge."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    middle, scale = float(np.median(x)), float(x.std()) or 1.0
    z = np.clip((x - middle) / scale, -30, 30)
    design = np.stack([z, np.ones_like(z)], 1)
    w = np.zeros(2)

    def loss(w):
        t = design @ w
        return float((np.logaddexp(0, t) - target * t).sum() + ridge * w[0] ** 2 / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -60, 60)))
        gradient = design.T @ (p - target) + np.array([ridge * w[0], 0])
        hessian = (design.T * (p * (1 - p) + 1e-9)) @ design + np.diag([ridge, 1e-9])
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return float(w[0] / scale), float(w[1] - w[0] * middle / scale)


def score(documents: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``score``, and ``passages``: first word, end and significance of each."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def start():
        judge = shared.value.judge

        def work(texts: list) -> list[pa.Array]:
            got = [judge(text) for text in texts]
            kind = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("significance", pa.float64())])
            return [
                pa.array([p for p, _ in got], pa.float64()),
                pa.array(
                    [[{"first": a, "end": b, "significance": v} for a, b, v in s] for _, s in got], pa.list_(kind)
                ),
            ]

        return work

    schema = "score double, passages array<struct<first:int,end:int,significance:double>>"
    return map_text(documents, keep, text_col, schema, start)


def drop_toxic(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold; columns unchanged."""
    columns = documents.columns
    names = [f"__c{i}" for i in range(len(columns))]
    scored = score(documents.toDF(*names), model, names, names[columns.index(text_col)])
    return scored.where(F.col("score") < threshold).select(*names).toDF(*columns)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: score every whole document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, model, ["doc_id"]).select(
        "doc_id",
        held_out("doc_id", 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )
