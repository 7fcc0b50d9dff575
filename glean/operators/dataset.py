
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glean.operators.temporal import suppress_close


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK4: the new rows replace old ones of equal key. Null keys match nothing and are kept."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def promote(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK5: state of every new row against the target: ``append``, ``same`` or ``conflict``."""
    rest = [c for c in new.columns if c not in keys]
    told = target.select(*keys, *[F.col(c).alias(f"_t_{c}") for c in rest], F.lit(True).alias("_there"))
    same = F.lit(True)
    for c in rest:
        same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    state = F.when(F.col("_there").isNull(), "append").when(same, "same").otherwise("conflict")
    return new.join(told, keys, "left").withColumn("state", state).select(*new.columns, "state")


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """WN7: the last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """SE7."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """SE8: rows with the number by which the tables differ (positive: more in ``a``); none if equal.

    One aggregation over the union instead of two ``exceptAll``.
    """
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")


def to_long(matrix: DataFrame, ids: list[str], names: list[str], name: str = "concept", value: str = "label") -> DataFrame:
    """EV28: one row for each cell."""
    return matrix.unpivot(ids, names, name, value)


def to_matrix(long: DataFrame, ids: list[str], name: str, names: list[str], value: Column) -> DataFrame:
    """EV29, AG13: one column for each of the listed names; absent cells are 0."""
    return long.groupBy(*ids).pivot(name, names).agg(value).fillna(0, names)


def invalid_labels(long: DataFrame, value: str = "label") -> DataFrame:
    """EV30: cells that are neither 0 nor 1."""
    return long.where(F.col(value).isNull() | ~F.col(value).isin(0, 1))


def annotation_problems(matrix: DataFrame, key: str, names: list[str], annotator: str = "annotator", status: str = "review_status") -> DataFrame:
    """EV30: (key, problem, detail): labels that are not ``0`` or ``1``, blank annotators, reviews that are not completed."""
    cells = to_long(matrix.select(key, *[F.col(c).cast("string").alias(c) for c in names]), [key], names)
    labels = cells.where(~F.coalesce(F.col("label").isin("0", "1"), F.lit(False))).select(key, F.lit("invalid_label").alias("problem"), F.concat_ws("=", "concept", F.coalesce("label", F.lit(""))).alias("detail"))
    plain = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    nobody = matrix.where(plain(annotator) == "").select(key, F.lit("blank_annotator").alias("problem"), F.lit("").alias("detail"))
    open_ = matrix.where(F.lower(plain(status)) != "completed").select(key, F.lit("incomplete_review").alias("problem"), plain(status).alias("detail"))
    return labels.unionByName(nobody).unionByName(open_)


def snippets(segments: DataFrame, key: str, order: str, text: str, hit: Column, gap: float, most: int) -> DataFrame:
    """TX20, WN6, WN8: hits with the text before and after, close ones suppressed, at most ``most`` an item."""
    w = Window.partitionBy(key).orderBy(order)
    context = F.concat_ws(" ", F.lag(text).over(w), F.col(text), F.lead(text).over(w))
    found = segments.withColumn("snippet", context).withColumn("_hit", hit).where("_hit")
    times = found.groupBy(key).agg(suppress_close(F.array_sort(F.collect_set(F.col(order).cast("double"))), gap, most).alias("kept"))
    return found.join(times, key).where(F.array_contains("kept", F.col(order).cast("double"))).select(key, order, "snippet")
