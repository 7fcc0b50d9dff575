"""Mixing sources to target weights by capped water-filling (operator 2).

Every source has a weight and a size (words). A common water level rises until the
targets ``min(weight * level, epochs * size)`` use up the budget: sources at their
cap stay there and their excess goes to the others by weight. The level is found
from prefix sums over the sources in order of the level at which each one fills.

A source with target = r * size takes every document floor(r) times, and the
fraction once more for some: documents are ordered by a seeded hash and taken
while the running size stays within the fraction. The running size is found level
by level: sums over hash buckets, then over finer buckets inside the one bucket
where the fraction runs out, so no task orders a whole source. The last document
is taken if that comes nearer to the target.

Built from DataFrame functions only.

Null texts have size 0 and are taken zero times beyond whole repetitions; null
sources form one source, last in order; ties in the hash are broken by doc_id and
text hash; equal rows get equal decisions; sources of size 0 have target 0; an
empty table gives an empty result. Long texts are measured whole. Columns of the input
that clash are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glean.llm.shared import written
from glean.llm.text import WORD_PATTERN

EPOCHS = 3
SEED = "mix-1"
#: Hash bits told apart by one level of buckets; a level reads sums of at most 2 ** BITS buckets a source.
BITS = 10
LEVELS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def repeating_weights(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Give the sources, by code point with null last, the weights in turn."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("double"))


def water_fill(sizes: DataFrame, budget_share: float = 1.0, epochs: float = EPOCHS) -> DataFrame:
    """Add ``target`` to (source, source_size, weight).

    The budget is ``budget_share`` of all sizes, at most what all caps allow. A row
    for each source: the windows without partitions hold no document.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("fills").asc_nulls_last(), F.col("source").asc_nulls_last())
    from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = (
        sizes.withColumn("cap", cap)
        .withColumn("fills", F.try_divide("cap", "weight"))
        .withColumn("budget", F.least(F.sum("source_size").over(everything) * F.lit(float(budget_share)), F.sum("cap").over(everything)))
        .withColumn("below", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("place", F.row_number().over(order))
        .withColumn("open", F.sum("weight").over(from_here))
        .withColumn("level", F.try_divide(F.col("budget") - F.col("below"), F.col("open")))
    )
    # the first source that the level does not fill sets it; if all are full, every target is its cap
    level = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("place", "level"))).over(everything)
    found = filled.withColumn("found", level)
    target = F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("found.level")))
    return found.select("source", "source_size", "weight", F.round(F.coalesce(target, F.lit(0.0)), 6).alias("target"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, epochs: float = EPOCHS, weigh=repeating_weights) -> DataFrame:
    """All columns of ``df``, then size, source_size, target, times (repetitions) and taken (words).

    ``weigh`` turns (source, source_size) into (source, source_size, weight).
    """
    added = ["size", "source_size", "target", "times", "taken"]
    kept = df.drop(*(c for c in added if c in df.columns))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"))
    names = {"source": F.col(source), "id": F.col(key), "tie": F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), "size": word_count(F.col(text)), "hash": F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")}
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("whole"), *(c.alias(n) for n, c in names.items()))
    some = written(rows.drop("whole").where("size > 0"), "sizes")
    sizes = rows.select("source").distinct().withColumnRenamed("source", "source_")
    sums = some.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = sizes.join(sums, F.col("source_").eqNullSafe(F.col("source")), "left").select(F.col("source_").alias("source"), F.coalesce("source_size", F.lit(0)).alias("source_size"))
    plan = water_fill(weigh(sizes), epochs=epochs)
    whole_times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = written(plan.withColumn("whole_times", whole_times).withColumn("part", F.col("target") - F.col("whole_times") * F.col("source_size")), "plan")

    # narrow each source down to the hash range in which its fraction runs out
    edge = plan.where("part > 0").select("source", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), "part")
    for level in range(LEVELS):
        wide, fine = 60 - BITS * level, 60 - BITS * (level + 1)
        inside = _meet(some, edge).where(F.shiftright("hash", wide) == F.col("prefix"))
        sums = inside.groupBy("source", F.shiftright("hash", fine).alias("bucket"), "before", "part").agg(F.sum("size").alias("n"))
        sums = sums.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
        edge = written(sums.where("upto > part AND upto - n <= part").select("source", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("n")).alias("before"), "part"), "edge")
    # what is left holds one document in 2 ** (BITS * LEVELS)
    prefix = F.shiftright("hash", 60 - BITS * LEVELS)
    place = F.struct("hash", "id", "tie")
    last = _meet(some, edge).where(prefix == F.col("prefix"))
    last = last.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("hash", "id", "tie")))
    last = last.groupBy("source", "prefix").agg(F.max(F.when(2 * F.col("upto") - F.col("size") <= 2 * F.col("part"), place)).alias("stop"))
    last = last.withColumnRenamed("source", "source_")
    plan = written(plan.join(last, plan["source"].eqNullSafe(last["source_"]), "left").drop("source_"), "ends")
    again = (F.col("size") > 0) & (F.col("part") > 0) & ((prefix < F.col("prefix")) | ((prefix == F.col("prefix")) & (place <= F.col("stop"))))
    out = _meet(rows, plan).withColumn("times", F.col("whole_times") + F.coalesce(again, F.lit(False)).cast("long"))
    return out.select(*[f"whole.`{c}`" for c in kept.columns], "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def _meet(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Join documents with a table of a row for each source; Spark broadcasts it while it is small."""
    sources = sources.withColumnRenamed("source", "source_")
    return rows.join(sources, rows["source"].eqNullSafe(sources["source_"])).drop("source_")


#: DuckDB SQL for the query's rows: the same plan with one running sum for a source.
ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}'))::bigint AS size, md5(coalesce(text, '')) AS tie,
    ('0x' || substr(md5('{SEED}|' || doc_id::varchar), 1, 15))::bigint AS hash
  FROM documents
), src AS (
  SELECT source, sum(size)::bigint AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::double AS weight, {EPOCHS}.0::double * sum(size)::double AS cap
  FROM sized GROUP BY source
), filled AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER ()::double AS budget
  FROM src
), found AS (SELECT arg_min((budget - below) / open, place) AS level FROM filled WHERE (budget - below) / open <= cap / weight
), plan AS (
  SELECT source, source_size, round(least(cap, weight * level), 6) AS target FROM filled, found
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::bigint AS whole_times FROM plan
), running AS (
  SELECT s.*, p.source_size, p.target, p.whole_times, p.target - p.whole_times * p.source_size AS part,
    sum(size) OVER (PARTITION BY s.source ORDER BY (size > 0)::int, hash, doc_id, tie) AS upto
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, size * (whole_times + (size > 0 AND part > 0 AND 2 * upto - size <= 2 * part)::int) AS taken FROM running
"""
