"""Quality classifier on random Fourier features (operator 10).

A document is a vector of ``STATISTICS``. Standardised, it is mapped to ``WIDTH``
random Fourier features, which approximate a Gaussian kernel; a ridge regression on
them is solved from normal equations that every task sums over its rows and Spark
sums over the tasks. Isotonic regression on training rows that the fit left out (a
fold by hash) turns the raw value into a probability.

Documents with several labels take the mean; null labels are ignored. Null and empty
texts have all statistics zero. Without labels every score is 0.5; with one class
only, its label. Equal raw values get equal scores, and so do repeated rows. Long texts are
measured whole. An empty table gives an empty result. Other columns, whatever their names,
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glean.llm.quality_rules import judge
from glean.llm.shared import written
from glean.llm.text import one_array, slices, split_words

STATISTICS = ("log_words", "word_chars", "symbols", "dup_lines", "repeat_words", "lost_words", "lost_lines", "upper", "digits", "marks", "distinct", "line_words", "one_char")
WIDTH = 128
RIDGE = 2.0
BANDWIDTH = 2.5
SEED = 20
BINS = 2000
BLOCK = 16
SLICE = 4 << 20


def statistics(text: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    (n_words, chars, symbols, dup, repeat, lost, lost_lines), _ = judge(text)
    words = split_words(text)
    n, row, codes = len(text), words.row, words.codes
    per = lambda x: np.bincount(row, weights=np.asarray(x, dtype=np.float64)[codes], minlength=n)
    count = lambda pattern: per(pc.count_substring_regex(words.vocab, pattern))
    lines = np.asarray(pc.count_substring(pc.fill_null(text, ""), "\n"), dtype=np.float64) + 1
    size = np.maximum(n_words, 1).astype(np.float64)
    distinct = np.bincount(np.unique(row * np.int64(len(words.vocab) + 1) + codes) // (len(words.vocab) + 1), minlength=n)
    letters = np.maximum(chars, 1)
    return np.stack([np.log1p(n_words), chars / size, symbols / size, dup / lines, repeat / size, lost / size, lost_lines / lines, count(r"\p{Lu}") / letters, count(r"\p{Nd}") / letters, count(r"[.,!?;:]") / size, distinct / size, np.log1p(n_words / lines), per(pc.equal(pc.utf8_length(words.vocab), 1)) / size], 1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  # raw values at which the calibrated score is known
    levels: np.ndarray
    constant: float | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier(np.clip((x - self.mean) / self.scale, -8, 8))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.features(x) @ self.weights, self.edges, self.levels), 0.0, 1.0)


def fourier(x: np.ndarray) -> np.ndarray:
    """Cosines of random projections, and a constant."""
    made = np.random.default_rng(SEED)
    turn = made.standard_normal((x.shape[1], WIDTH)) / (BANDWIDTH * np.sqrt(x.shape[1] / 4))
    return np.hstack([np.sqrt(2 / WIDTH) * np.cos(x @ turn + made.uniform(0, 2 * np.pi, WIDTH)), np.ones((len(x), 1))])


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nearest nondecreasing values, by merging neighbours that are out of order."""
    level: list[list[float]] = []
    for v, w in zip(value, weight):
        level.append([v, w, 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            b, a = level.pop(), level.pop()
            total = a[1] + b[1]
            level.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.concatenate([np.full(int(k), v) for v, _, k in level]) if level else np.zeros(0)


def measure(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x array<double>): the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["key", "x"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id") -> Model:
    """Learn from the rows of ``measured`` that ``labels`` marks."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.avg(label).cast("double").alias("y"))
    rows = written(measured.join(marks, "key").select("x", "y", (F.pmod(F.xxhash64("key"), F.lit(4)) == 0).alias("aside")), "labelled")
    width = len(STATISTICS)
    told = rows.agg(F.count(F.lit(1)), F.min("y"), F.max("y"), *[f(F.col("x")[k]) for k in range(width) for f in (F.avg, F.stddev_pop)]).first()
    if not told[0] or told[1] == told[2]:
        return Model(*[np.zeros(0)] * 5, constant=float(told[1]) if told[0] else 0.5)
    model = Model(np.array(told[3::2]), np.maximum(np.array(told[4::2]), 1e-9), np.zeros(0), np.zeros(0), np.zeros(0))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WIDTH + 1, WIDTH + 2))
        for batch in batches:
            z = model.features(_matrix(batch.column("x")))
            total += z.T @ np.column_stack([z, np.asarray(batch.column("y"))])
        blocks = range(0, WIDTH + 1, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([a // BLOCK for a in blocks], pa.int32()), pa.array([total[a : a + BLOCK].tobytes() for a in blocks], pa.binary())], ["block", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float64) for x in table.column("part").to_pylist()], axis=0)
        return pa.table({"block": table.column("block")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    solve = rows.where("NOT aside").mapInArrow(sums, "block int, part binary").groupBy("block").applyInArrow(add, "block int, part binary").collect()  # (WIDTH + 1) ** 2 numbers
    total = np.concatenate([np.frombuffer(r["part"], np.float64) for r in sorted(solve, key=lambda r: r["block"])]).reshape(WIDTH + 1, WIDTH + 2)
    model.weights = np.linalg.solve(total[:, :-1] + RIDGE * np.diag(np.append(np.ones(WIDTH), 1e-9)), total[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BINS, 3))
        for batch in batches:
            raw = np.clip(model.features(_matrix(batch.column("x"))) @ model.weights, -0.5, 1.5)
            at = np.minimum(((raw + 0.5) / 2 * BINS).astype(np.int64), BINS - 1)
            total += np.stack([np.bincount(at, weights=w, minlength=BINS) for w in (np.ones(len(at)), np.asarray(batch.column("y")), raw)], 1)
        at = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, k]) for k in range(3))], ["bin", "n", "y", "raw"])

    bins = rows.where("aside").mapInArrow(binned, "bin long, n double, y double, raw double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("raw").alias("raw")).orderBy("bin").toArrow()
    n, y, raw = (bins.column(c).to_numpy() for c in ("n", "y", "raw"))
    if not len(n):
        model.edges, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    else:
        model.edges, model.levels = raw / n, isotonic(y / n, n)
    return model


def score(measured: DataFrame, model: Model) -> DataFrame:
    """(key, score) of measured rows."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(shared.value.score(_matrix(one_array(batch.column("x")))))], ["key", "score"])

    return measured.mapInArrow(run, f"key {measured.schema['key'].dataType.simpleString()}, score double")
