"""Ranks and quantiles of groups that no task could sort alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glean.sources.scratch import stored


def ranked_within(df: DataFrame, strata: list[str], order: Column, name: str = "place", parts: int | None = None) -> DataFrame:
    """``name``: 1, 2, ... within each stratum in the order of ``order``, which should be unique there.

    Rows are dealt into ranges of (stratum, order) and written with the number of their
    range; the sizes of the ranges, a row for each range and stratum, give every range's
    first rank, and rows are numbered within their range. A stratum spreads over as many
    tasks as it has ranges.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_order", order).repartitionByRange(parts, *strata, "_order")
    dealt = stored(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    size = dealt.groupBy("_range", *strata).agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*strata).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    size = size.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_s_{c}") for c in strata], F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_before"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in strata], F.col("_range") == F.col("_r"))
    inside = F.row_number().over(Window.partitionBy("_range", *strata).orderBy("_order"))
    found = dealt.withColumn("_inside", inside).join(size, same)
    return found.withColumn(name, (F.col("_before") + F.col("_inside")).cast("int")).select(*df.columns, name)


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by..., one column for each of ``shares``): exact quantiles by linear interpolation, of any number of values.

    Equal values are counted first; a running sum over the counts, kept in ranges of
    values like ``ranked_within``, tells which counted values stand at the two places that
    a quantile falls between. No buffer holds a group's values. Null values do not count.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = counted.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_v")
    dealt = stored(dealt.withColumn("_range", F.spark_partition_id()), "values")
    size = dealt.groupBy("_range", *by).agg(F.sum("_n").alias("_size"))
    low = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    size = size.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_b_{c}") for c in by], F.coalesce(F.sum("_size").over(low), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(*by)).alias("_total"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by], F.col("_range") == F.col("_r"))
    upto = F.sum("_n").over(Window.partitionBy("_range", *by).orderBy("_v"))
    placed = dealt.withColumn("_upto", upto).join(size, same).withColumn("_last", F.col("_before") + F.col("_upto"))  # places (last - n, last], from 1
    first = F.col("_last") - F.col("_n")
    picked = []
    for k, q in enumerate(shares.values()):
        at = (F.col("_total") - 1) * F.lit(q)
        holds = lambda place: (first <= place) & (place < F.col("_last"))
        picked += [F.max(F.when(holds(F.floor(at)), F.col("_v"))).alias(f"_lo{k}"), F.max(F.when(holds(F.ceil(at)), F.col("_v"))).alias(f"_hi{k}")]
    met = placed.groupBy(*by).agg(F.max("_total").alias("_total"), *picked)
    out = []
    for k, (name, q) in enumerate(shares.items()):
        at = (F.col("_total") - 1) * F.lit(q)
        out.append((F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (at - F.floor(at))).alias(name))
    return met.select(*by, *out)
