"""Toxicity by multiple-instance learning (operator 8).

Labels are known for documents, offences sit in sentences. A sentence's probability
is logistic in the words it holds; a document's is the noisy-or of its sentences,
``1 - prod(1 - p)``. The model is fitted on at most ``SAMPLE`` labelled documents,
those of least id hash. Words are hashed to ``BUCKETS``; the ``KEPT`` buckets whose
document counts differ most between the labels (by a G test) are the features. Weights come from full-gradient steps:
every task sums the gradient of its documents, so the driver only holds a vector
of ``KEPT`` + 1 numbers. Sentences end at line ends and after words that end in
``.``, ``!``, ``?`` or their wide forms.

Null and empty texts count as one sentence without known words. Documents with
several labels take the larger one; labels of unknown documents and null labels are
ignored. Without labels, or with one class only, every score is the share of
toxic labels (0 without any). Equal gains are decided by the smaller bucket. Repeated rows
are scored alike. Long texts are scored whole. An empty table gives an empty result. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glean.llm.shared import written
from glean.llm.text import hash_strings, one_array, slices, split_words

BUCKETS = 1 << 18
KEPT = 1024
#: Labelled documents to fit on, at most.
SAMPLE = 40_000
STEPS = 60
RATE = 0.3
RIDGE = 1e-4
STOP = r"""[.!?。！？]["'”’)]*$"""
SLICE = 4 << 20


@dataclass
class Model:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    constant: float | None = None


def sentences(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word its row, its sentence (numbered on across rows) and its bucket (-1: no letters); per sentence its row."""
    n = len(text)
    lists = one_array(pc.split_pattern(pc.fill_null(text, ""), "\n"))
    words = split_words(lists.values)
    line_row = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets, dtype=np.int64)))
    plain = pc.replace_substring_regex(pc.utf8_lower(words.vocab), r"[^\p{L}\p{M}]+", "")
    bucket = (hash_strings(plain) & np.uint64(BUCKETS - 1)).astype(np.int64)
    bucket[np.asarray(pc.binary_length(plain)) == 0] = -1
    stop = np.asarray(pc.match_substring_regex(words.vocab, STOP))[words.codes]
    line = words.row
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | stop[:-1]
    row = line_row[line]
    return row, np.cumsum(new) - 1, bucket[words.codes], row[new]


def _known(bucket: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Feature of each bucket, -1 where it is not kept."""
    if not len(kept):
        return np.full(len(bucket), -1)
    at = np.minimum(np.searchsorted(kept, bucket), len(kept) - 1)
    return np.where(kept[at] == bucket, at, -1)


def _pairs(text: pa.Array, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sentence, feature) pairs; sentences' rows; first word of each sentence with the word's row."""
    row, sentence, bucket, of = sentences(text)
    feature = _known(bucket, kept)
    on = feature >= 0
    pairs = np.unique(sentence[on] * np.int64(len(kept) + 1) + feature[on])
    return pairs // (len(kept) + 1), pairs % (len(kept) + 1), of, sentence


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    """Learn from the documents of ``docs`` that ``labels`` marks."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k_")).agg((F.max(label) > 0).cast("int").alias("y"))
    marks = written(marks.orderBy(F.xxhash64(F.lit("fit"), "k_"), "k_").limit(SAMPLE), "marks")
    rows = docs.select(F.col(key).alias("k_"), F.col(text).alias("text")).join(F.broadcast(marks), "k_").select("y", "text")  # at most SAMPLE keys

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in slices(batches, "text", SLICE):
            row, _, bucket, _ = sentences(batch.column("text"))
            y = np.asarray(batch.column("y"), dtype=np.int64)
            size += np.bincount(y, minlength=2)
            pairs = np.unique(row[bucket >= 0] * np.int64(BUCKETS) + bucket[bucket >= 0])
            for k in (0, 1):
                total[k] += np.bincount(pairs[y[pairs // BUCKETS] == k] % BUCKETS, minlength=BUCKETS)
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[0][at], size[0])), pa.array(np.append(total[1][at], size[1]))], ["bucket", "n0", "n1"])

    counts = written(rows.mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "counts")
    size = counts.where("bucket = -1").select("n0", "n1").first() or (0, 0)
    if not size[0] or not size[1]:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, float(bool(size[1])))
    term = lambda seen, expected: F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) / expected)).otherwise(0.0)
    share = size[1] / (size[0] + size[1])
    gain = term("n1", (F.col("n0") + F.col("n1")) * share) + term("n0", (F.col("n0") + F.col("n1")) * (1 - share))
    best = counts.where("bucket >= 0").orderBy(gain.desc(), "bucket").limit(KEPT).select("bucket").collect()
    kept = np.sort(np.array([r[0] for r in best], np.int64))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sentence, feature, of, _ = _pairs(batch.column("text"), kept)
            n = batch.num_rows
            filled = np.unique(sentence)
            blank = np.bincount(of, minlength=n) - np.bincount(of[filled], minlength=n)
            blank[np.bincount(of, minlength=n) == 0] = 1
            bounds = np.searchsorted(of[sentence], np.arange(n + 1)).astype(np.int32)
            cells = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (sentence - (sentence[np.minimum(bounds[:-1], max(len(sentence) - 1, 0))][np.repeat(np.arange(n), np.diff(bounds))] if len(sentence) else 0), feature)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(blank), *cells], ["y", "blank", "sentence", "feature"])

    examples = written(rows.mapInArrow(sparse, "y int, blank long, sentence array<int>, feature array<int>"), "examples").coalesce(8)
    weights = np.zeros(len(kept) + 1)
    weights[-1] = -5.0  # most sentences offend nobody
    total, m, v = size[0] + size[1], np.zeros_like(weights), np.zeros_like(weights)
    examples = examples.persist()
    for step in range(1, STEPS + 1):
        parts = examples.mapInArrow(_gradient(weights), "g array<double>").toArrow().column("g")
        g = np.sum([np.array(x.as_py()) for x in parts], axis=0) / total - RIDGE * np.append(weights[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights = weights + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    examples.unpersist()
    return Model(kept, weights[:-1], float(weights[-1]))


def _soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _gradient(weights: np.ndarray):
    """Sum, over a task's documents, of the gradient of the log likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros_like(weights)
        bias = weights[-1]
        for batch in batches:
            n = batch.num_rows
            y, blank = np.asarray(batch.column("y")) > 0, np.asarray(batch.column("blank"), dtype=np.float64)
            size = np.asarray(pc.list_value_length(batch.column("feature")), dtype=np.int64)
            row = np.repeat(np.arange(n), size)
            inner = np.asarray(batch.column("sentence").flatten(), dtype=np.int64)
            feature = np.asarray(batch.column("feature").flatten(), dtype=np.int64)
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (inner[1:] != inner[:-1])
            sentence, of = np.cumsum(new) - 1, row[new]
            z = bias + np.bincount(sentence, weights=weights[feature], minlength=len(of))
            clean = -np.bincount(of, weights=_soft(z), minlength=n) - blank * _soft(bias)  # log of no offence
            pull = np.where(y, np.exp(clean) / np.maximum(-np.expm1(clean), 1e-12), -1.0)
            slope = pull[of] / (1 + np.exp(-z))
            g[:-1] += np.bincount(feature, weights=slope[sentence], minlength=len(g) - 1)
            g[-1] += slope.sum() + (pull * blank).sum() / (1 + np.exp(-bias))
        yield pa.RecordBatch.from_arrays([pa.array([g], pa.list_(pa.float64()))], ["g"])

    return run


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", with_sentences: bool = True, threshold: float = 0.5) -> DataFrame:
    """(key, score[, offending]): ``offending`` lists the sentences at or above the threshold as word ranges with scores."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text", SLICE):
            n = batch.num_rows
            sentence, feature, of, each = _pairs(batch.column("text"), model.buckets)
            z = model.bias + (np.bincount(sentence, weights=model.weights[feature], minlength=len(of)) if len(sentence) else np.zeros(len(of)))
            if model.constant is None:
                clean = -np.bincount(of, weights=_soft(z), minlength=n)
                clean[np.bincount(of, minlength=n) == 0] = -_soft(np.array(model.bias))
                p = -np.expm1(clean)
            else:
                p, z = np.full(n, model.constant), np.full(len(of), -np.inf)
            columns = [batch.column("key"), pa.array(np.clip(p, 0.0, 1.0))]
            if with_sentences:
                low = 1 / (1 + np.exp(-z))
                hit = np.flatnonzero(low >= threshold)
                begin = np.searchsorted(each, np.arange(len(of) + 1))
                first = begin[np.searchsorted(of, np.arange(n))] if len(of) else np.zeros(n, np.int64)
                base = first[of[hit]]
                found = pa.StructArray.from_arrays([pa.array((begin[hit] - base).astype(np.int32)), pa.array((begin[hit + 1] - base).astype(np.int32)), pa.array(low[hit])], fields=list(span))
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of[hit], minlength=n))].astype(np.int32)), found))
            yield pa.RecordBatch.from_arrays(columns, ["key", "score", "offending"][: len(columns)])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, score double" + ", offending array<struct<start:int,end:int,score:double>>" * with_sentences
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
