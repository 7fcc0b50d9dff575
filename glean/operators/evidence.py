
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AGGREGATIONS = ("max", "mean", "top2_mean", "top3_mean")


def top_sums(scores: DataFrame, by: list[str], score: str, depths: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """AG2, S9: (by..., sum1, n1, sum2, n2, ...): sum and number of the k largest scores of each group, of fewer if there are fewer.

    The rank limit holds before the shuffle too, so a task sends on at most the deepest
    k rows of a group and nothing keeps a group's scores together. Nulls do not count.
    """
    order = Window.partitionBy(*by).orderBy(F.col(score).desc())
    best = scores.where(F.col(score).isNotNull()).select(*by, score).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= max(depths))
    upto = [(k, F.col("_place") <= k) for k in depths]
    return best.groupBy(*by).agg(*[F.sum(F.when(c, F.col(score))).alias(f"sum{k}") for k, c in upto], *[F.count_if(c).alias(f"n{k}") for k, c in upto])


def _with_tops(plain: DataFrame, tops: DataFrame, by: list[str]) -> DataFrame:
    """Join two tables of one row a group; keys may be null."""
    tops = tops.withColumnsRenamed({c: f"_k_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return plain.join(tops, same, "left").drop(*[f"_k_{c}" for c in by])


def evidence(scores: DataFrame, item: str, concept: str, chunk: str, score: str = "final_score", lda: str = "lda_score", lsa: str = "lsa_score", rank: str = "rank") -> DataFrame:
    """AG1-AG4: figures of each group. The best chunk is the first of equal scores (S10); the ratios' base is the group (S8)."""
    n = F.count(F.lit(1))
    best = F.max_by(F.col(chunk), F.struct(F.col(score), -F.col(chunk)))
    plain = scores.groupBy(item, concept).agg(
        n.alias("num_chunks"),
        F.max(score).alias("max_score"),
        F.avg(score).alias("mean_score"),
        F.count_if(F.col(rank) <= 3).alias("top3_count"),
        (F.count_if(F.col(rank) <= 3) / n).alias("top3_ratio"),
        F.count_if(F.col(rank) == 1).alias("top1_count"),
        (F.count_if(F.col(rank) == 1) / n).alias("top1_ratio"),
        F.max(lsa).alias("max_lsa"),
        F.max(lda).alias("max_lda"),
        best.alias("best_chunk"),
    )
    met = _with_tops(plain, top_sums(scores, [item, concept], score, (2,)), [item, concept])
    return met.withColumn("top2_mean", F.col("sum2") / F.col("n2")).select(item, concept, "num_chunks", "max_score", "mean_score", "top2_mean", "top3_count", "top3_ratio", "top1_count", "top1_ratio", "max_lsa", "max_lda", "best_chunk")


def all_aggregations(scores: DataFrame, by: list[str], score: str) -> DataFrame:
    """AG6: every aggregation as a row (aggregation, value)."""
    plain = scores.groupBy(*by).agg(F.max(score).alias("max"), F.avg(score).alias("mean"))
    wide = _with_tops(plain, top_sums(scores, by, score, (2, 3)), by)
    return wide.select(*by, "max", "mean", (F.col("sum2") / F.col("n2")).alias("top2_mean"), (F.col("sum3") / F.col("n3")).alias("top3_mean")).unpivot(by, list(AGGREGATIONS), "aggregation", "value")


def aggregate(scores: DataFrame, by: list[str], score: str, aggregation: str, digits: int = 4) -> DataFrame:
    """AG6: one aggregation by name."""
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {aggregation!r}; known: {', '.join(AGGREGATIONS)}")
    found = all_aggregations(scores, by, score).where(F.col("aggregation") == aggregation)
    return found.select(*by, F.round("value", digits).alias("value"))
