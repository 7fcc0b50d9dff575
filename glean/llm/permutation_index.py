"""Approximate nearest neighbours by a permutation index (operator 9).

Pivots come from a bounded sample of the vectors (the ``8 * PIVOTS`` rows of least
id hash): ``PIVOTS`` of them, each the one farthest from those chosen before, so
that a crowd of near-equal vectors does not use them up. A
vector is represented by its ``PREFIX`` nearest pivots in order, and posted with
its position in each of those pivots' inverted files. A query walks the inverted
files of its own pivots and adds up, for every posted vector, how far the
positions agree; that ranks by Spearman's footrule with absent pivots placed at
the end. The best ``RERANK`` share of the vectors, at every size, is reranked by the
exact cosine.

Vectors are dealt to shards of about ``SHARD`` rows. A task gets a shard's vectors first,
builds its inverted files once, and streams all queries past them, giving every
query's best rows of that shard; it never holds more than a shard and a batch of
queries. Every vector is indexed, whatever the sample.

Vectors that are null, zero or hold null or non-finite components take no part, nor
do rows without an id. Vectors of different lengths are never neighbours. Repeated
rows are neighbours of each other only under different ids; ties go to the smaller
id. Rows equal in id and vector count once. Different vectors under one id are one
neighbour, and one query, each pair of ids counting by its best score. An empty table
gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glean.llm.text import one_array

PIVOTS = 256
PREFIX = 192
RERANK = 0.1
#: At least so many times the number of neighbours asked for are reranked.
SPARE = 10
#: Above the rounding of a matrix product; rows so near to the k-th are compared by their exact scores.
SLACK = 1e-9
SHARD = 25_000


def usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(table: pa.Table) -> np.ndarray:
    return np.asarray(one_array(table.column("vector")).flatten(), dtype=np.float64).reshape(table.num_rows, -1)


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows, each pair of both once."""
    ids, vectors = table.column("id").to_numpy(), _matrix(table)
    if len(np.unique(ids)) < len(ids):
        _, first = np.unique(np.column_stack([ids, vectors.view(np.int64)]), axis=0, return_index=True)
        ids, vectors = ids[np.sort(first)], vectors[np.sort(first)]
    return ids, vectors


def prefixes(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each unit vector, nearest first."""
    near = -(vectors @ pivots.T)
    length = min(length, len(pivots))
    some = np.argpartition(near, length - 1, axis=1)[:, :length]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)


def spread(vectors: np.ndarray, k: int) -> np.ndarray:
    """``k`` unit vectors far from each other: the first, then always the one least near to any chosen."""
    chosen, near = [0], vectors @ vectors[0]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    return vectors[chosen]


class Shard:
    """Inverted files of one shard's vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, share: float = RERANK):
        self.ids, self.vectors, self.pivots = ids, vectors, pivots
        self.repeated = len(np.unique(ids)) < len(ids)
        self.norms = np.sqrt((vectors * vectors).sum(1))
        order = prefixes(vectors / self.norms[:, None], pivots, PREFIX)
        self.length = order.shape[1]
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows, self.places = by_pivot // self.length, by_pivot % self.length
        self.bounds = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))
        self.budget = max(1, int(np.ceil(share * len(ids))))

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the ``k`` nearest found, ``query_id`` left out."""
        norm = np.sqrt((query * query).sum())
        agree = np.zeros(len(self.ids), np.int32)
        for place, pivot in enumerate(prefixes((query / norm)[None], self.pivots, self.length)[0]):
            part = slice(self.bounds[pivot], self.bounds[pivot + 1])
            agree[self.rows[part]] += self.length - np.abs(self.places[part] - place).astype(np.int32)
        budget = min(len(self.ids), max(SPARE * k, self.budget))
        least = -np.partition(-agree, budget - 1)[budget - 1]
        found = np.flatnonzero((agree >= least) & (self.ids != query_id))
        score = (self.vectors[found] @ query) / (self.norms[found] * norm)
        if not self.repeated and len(found) > k:
            found = found[score >= -np.partition(-score, k - 1)[k - 1] - SLACK]
        # a matrix product rounds by a row's place: what is compared is summed row by row
        score = (self.vectors[found] * query).sum(1) / (self.norms[found] * norm)
        best = np.lexsort((self.ids[found], -score))
        if not self.repeated:
            return self.ids[found[best[:k]]], score[best[:k]]
        _, first = np.unique(self.ids[found[best]], return_index=True)  # an id once, by its best score
        best = best[np.sort(first)[:k]]
        return self.ids[found[best]], score[best]


def nearest(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", share: float = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row where ``is_query`` holds."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    n = rows.count()
    sample = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(8 * PIVOTS).collect()
    by_size: dict[int, list] = {}
    for v in dict.fromkeys(tuple(r["vector"]) for r in sample):
        by_size.setdefault(len(v), []).append(v)
    unit = lambda x: x / np.sqrt((x * x).sum(1))[:, None]
    pivots = df.sparkSession.sparkContext.broadcast({d: spread(unit(np.array(v)), PIVOTS) for d, v in by_size.items()})
    shards = max(1, -(-n // SHARD))
    shard = F.pmod(F.xxhash64(F.lit("deal"), F.col("id")), F.lit(shards)).cast("int")
    shape = ["id", "vector", F.size("vector").alias("length")]
    held = rows.select(*shape, shard.alias("shard"), F.lit(0).alias("asks"))
    asked = rows.where("asks").select(*shape, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks")).distinct()
    by = ["length", "shard"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = held.unionByName(asked).repartition(parts, *by).sortWithinPartitions(*by, "asks")

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, waiting = None, None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in (*by, "asks")], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
                length, at, asks = keys[a].tolist() if b > a else (0, 0, -1)
                if now != (length, at):
                    now, index, waiting = (length, at), None, []
                piece = batch.slice(int(a), int(b - a)).select(["id", "vector"])
                if asks == 0:
                    waiting.append(piece)
                elif asks == 1 and (waiting or index):
                    if index is None:
                        ids, vectors = _distinct(pa.Table.from_batches(waiting))
                        # vectors of a length that the sample misses are compared through pivots of their own shard
                        near = pivots.value.get(length)
                        index, waiting = Shard(ids, vectors, unit(vectors[:PIVOTS]) if near is None else near, share), []
                    table = pa.Table.from_batches([piece])
                    out = [(q, int(i), float(s)) for q, x in zip(table.column("id").to_pylist(), _matrix(table)) for i, s in zip(*index.search(q, x, k))]
                    q, i, s = zip(*out) if out else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(answers, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
