"""Quality classifier: a factorisation machine.

Inputs are hashed words (square roots of counts, length one), structure
statistics cut into steps, and steps of metadata columns. Pairs of inputs
interact through low-rank factors, scored in linear time by
``sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2``.

Defined results:
- null and empty texts have no words; their structure steps still give a score;
- a null or missing metadata value is a step of its own;
- repeated rows are scored each for itself, an empty table gives no rows;
- without labels of both classes the score is the share of label 1 (0.5 without any);
- further columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, in_small_batches, map_batches, slices
from .toxicity import logistic
from .training import held_out, labelled_sample

#: Labelled rows that training takes at most.
SAMPLE = 6_000
#: Hash buckets of words; structure and metadata steps lie behind them.
WORDS, STEPS = 1 << 16, 1 << 10
RANK, EPOCHS, BATCH = 8, 10, 32
#: Words whose bucket a worker remembers.
REMEMBERED = 300_000

_CLASS = np.zeros((256, 6))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (
        65 <= _b <= 90,
        _c.isascii() and _c.isdigit(),
        _c in "!?",
        _c in "#$%&*+<=>@\\^_`{|}~",
        _c in ".,;:",
        _b == 10,
    )


def structure(text: str, words: list[str], counts: Counter) -> list[float]:
    """Statistics between 0 and 1 of a text's form."""
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    shares = raw @ _CLASS / max(int(raw.sum()), 1)
    n = max(len(words), 1)
    lines = text.split("\n")
    return [
        *shares.tolist(),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        min(1.0, sum(map(len, words)) / n / 20),
        len(set(lines)) / len(lines),
        min(1.0, math.log1p(len(words)) / 12),
        min(1.0, math.log1p(len(text) / len(lines)) / 12),
        sum(c for w, c in counts.items() if not w.isalnum() and not any(map(str.isalnum, w))) / n,
    ]


def steps(values: list[float | None]) -> list[int]:
    """A bucket for the step in which each value lies; fine near 0, as shares are small."""
    out = []
    for i, value in enumerate(values):
        step = 31 if value is None else int(30 * math.sqrt(max(0.0, min(1.0, value))))
        out.append(WORDS + (i * 32 + step) % STEPS)
    return out


class Features:
    """Texts and metadata as sparse rows."""

    def __init__(self):
        self.bucket: dict[str, int] = {}

    def row(self, text: str | None, meta: tuple) -> tuple[list[int], list[float]]:
        text = text or ""
        words = text.split()
        counts = Counter(words)
        bucket = self.bucket
        if len(bucket) > REMEMBERED:
            bucket.clear()
        for w in counts:
            if w not in bucket:
                bucket[w] = zlib.crc32(w.lower().encode()) % WORDS
        norm = 1 / math.sqrt(max(len(words), 1))
        numbers = [None if m is None else min(1.0, math.log1p(abs(float(m))) / 24) for m in meta]
        form = steps(structure(text, words, counts) + numbers)
        weight = 1 / math.sqrt(len(form))
        index = [bucket[w] for w in counts] + form
        value = [math.sqrt(c) * norm for c in counts.values()] + [weight] * len(form)
        return index, value


class Machine:
    """Weights, factors and the calibration of a factorisation machine."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.weights = np.zeros(WORDS + STEPS, np.float32)
        self.factors = rng.normal(0, 0.05, (WORDS + STEPS, RANK)).astype(np.float32)
        self.slope, self.offset = 1.0, 0.0
        self.constant: float | None = None

    def parts(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray):
        """Raw scores, and the factor sums, of rows that begin at ``starts``."""
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", vx, vx), starts)
        linear = np.add.reduceat(self.weights[index] * value, starts)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums, vx

    def fit(self, rows: list, labels: np.ndarray, seed: int = 11) -> None:
        """AdaGrad on the logistic loss; the last fifth of the rows calibrates."""
        rng = np.random.default_rng(seed)
        n_fit = max(1, len(rows) * 4 // 5)
        share = float(labels.mean())
        if share in (0.0, 1.0):
            self.constant = share
            return
        self.bias = math.log(share / (1 - share))
        g_weights = np.full(self.weights.shape, 1e-3, np.float32)
        g_factors = np.full(self.factors.shape, 1e-3, np.float32)
        rate = 0.15
        for _ in range(EPOCHS):
            order = rng.permutation(n_fit)
            for at in range(0, n_fit, BATCH):
                chosen = order[at : at + BATCH]
                index, value, starts, row = flat([rows[i] for i in chosen])
                raw, sums, vx = self.parts(index, value, starts)
                slack = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]
                d = (slack[row] * value).astype(np.float32)
                touched, place = np.unique(index, return_inverse=True)
                gw = np.bincount(place, d, touched.size).astype(np.float32) / len(chosen)
                inner = (sums[row] - vx) * d[:, None]
                gf = np.stack([np.bincount(place, inner[:, f], touched.size) for f in range(RANK)], 1)
                gf = gf.astype(np.float32) / len(chosen) + 1e-5 * self.factors[touched]
                gw += 1e-5 * self.weights[touched]
                g_weights[touched] += gw * gw
                g_factors[touched] += gf * gf
                self.weights[touched] -= rate * gw / np.sqrt(g_weights[touched])
                self.factors[touched] -= 0.3 * rate * gf / np.sqrt(g_factors[touched])
                self.bias -= 0.05 * float(slack.mean())
        kept = rows[n_fit:] or rows
        kept_labels = labels[n_fit:] if rows[n_fit:] else labels
        if 0 < kept_labels.mean() < 1:
            index, value, starts, _ = flat(kept)
            self.slope, self.offset = logistic(self.parts(index, value, starts)[0], kept_labels)

    def score(self, rows: list) -> np.ndarray:
        """Probabilities of label 1."""
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        index, value, starts, _ = flat(rows)
        raw = self.parts(index, value, starts)[0].astype(float)
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -60, 60)))


def flat(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows as one index, one value and one start array, and each entry's row."""
    sizes = np.array([len(r[0]) for r in rows])
    index = np.concatenate([np.asarray(r[0], np.int64) for r in rows])
    value = np.concatenate([np.asarray(r[1], np.float32) for r in rows])
    return index, value, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(rows)), sizes)


def train(
    documents: DataFrame,
    labels: DataFrame,
    meta_cols: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
    bound: int = SAMPLE,
) -> Machine:
    """Fit on at most ``bound`` labelled rows outside the held-out fold.

    Words become features on the executors; the driver collects the sparse rows
    of the bounded sample and fits there.
    """
    sample = labelled_sample(documents, labels, "quality", 5, 0, bound, id_col, text_col, meta_cols)

    def run(batches):
        features = Features()
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                texts, meta = part.column("text").to_pylist(), part.column("meta").to_pylist()
                rows = [features.row(t, tuple(m)) for t, m in zip(texts, meta)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([np.asarray(r[0], np.int32).tobytes() for r in rows], pa.binary()),
                        pa.array([np.asarray(r[1], np.float32).tobytes() for r in rows], pa.binary()),
                        pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64()),
                        part.column("label"),
                    ],
                    names=["index", "value", "crc", "label"],
                )

    got = in_small_batches(map_batches(sample.select("text", "meta", "label"), run, "index binary, value binary, crc long, label int"))
    got = sorted(got.collect(), key=lambda r: (r.crc, r.label, bytes(r["index"])))
    rows = [(np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32)) for r in got]
    machine = Machine()
    if rows:
        machine.fit(rows, np.array([r.label for r in got], float))
    else:
        machine.constant = 0.5
    return machine


def score(documents: DataFrame, machine: Machine, keep: list[str], text_col: str = "text", meta_cols: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and ``score``, a row for each input row."""
    names = [f"__k{i}" for i in range(len(keep))]
    meta = F.array(*[F.col(c).cast("double") for c in meta_cols]).cast("array<double>")
    narrow = documents.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], meta.alias("__m"), F.col(text_col).alias("__t"))
    schema = type(narrow.schema)(narrow.schema.fields[:-2]).add("score", "double")
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        features, model = Features(), shared.value
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, 4 << 20):
                columns = part.columns
                rows = [features.row(t, tuple(m)) for t, m in zip(columns[-1].to_pylist(), columns[-2].to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*columns[:-2], pa.array(model.score(rows), pa.float64())], names=schema.names
                )

    return in_small_batches(map_batches(narrow, run, schema)).toDF(*keep, *beside(keep, ["score"]))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Contract query: score every whole document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"), ("n_chars",))
    return score(documents, machine, ["doc_id"], "text", ("n_chars",)).select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
