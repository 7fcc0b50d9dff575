
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glean.operators.temporal import expected_grid


def ledger(df: DataFrame, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """AU1: rows (check, value, expected, pass) from one aggregation over ``df``."""
    wide = df.agg(*[c.cast("double").alias(f"c{k}") for k, (c, _) in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(f"c{k}"), F.lit(0.0)).alias("value"), F.lit(float(e)).alias("expected")) for k, (n, (_, e)) in enumerate(checks.items())])
    return wide.select(F.inline(rows)).withColumn("pass", F.abs(F.col("value") - F.col("expected")) <= 1e-9)


def join_ledgers(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def failures(found: DataFrame) -> DataFrame:
    """AU2: the checks that failed."""
    return found.where(~F.col("pass"))


def require(found: DataFrame) -> None:
    """AU3: raise with the names of failed checks."""
    bad = [r["check"] for r in failures(found).select("check").collect()]  # a row for each check
    if bad:
        raise ValueError("failed checks: " + ", ".join(bad))


def leakage(folds: DataFrame, item: str, fold: str) -> DataFrame:
    """AU4: for each held-out fold the sizes of train and test and their overlap.

    An item's folds are gathered once; it is trained on for every fold that holds
    it out nowhere, and overlaps where it stands in several.
    """
    of_item = folds.groupBy(item).agg(F.collect_set(fold).alias("in"))
    every = folds.agg(F.array_sort(F.collect_set(fold)).alias("all"))
    spread = of_item.join(F.broadcast(every)).withColumn(fold, F.explode("all"))
    held = F.array_contains("in", F.col(fold))
    trained = F.exists("in", lambda f: f != F.col(fold))
    return spread.groupBy(fold).agg(F.count_if(trained).alias("train"), F.count_if(held).alias("test"), F.count_if(held & trained).alias("overlap"))


def coverage(folds: DataFrame, item: str, fold: str) -> DataFrame:
    """AU5: how many items are held out in how many folds."""
    times = folds.groupBy(item).agg(F.count_distinct(fold).alias("held_out_in"))
    return times.groupBy("held_out_in").agg(F.count(F.lit(1)).alias("items"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """TX25, SNK9: SHA-256 of each row's canonical JSON, names in order."""
    return df.withColumn("sha256", F.sha2(F.to_json(F.struct(*sorted(columns))).cast("binary"), 256))


def max_deviation(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """AU9, JN16."""
    return df.agg(F.round(F.max(F.abs(a - b)), 9).alias("max_abs_diff"), F.count(F.lit(1)).alias("rows"))


def compare_configs(frozen: dict, declared: dict) -> dict[str, tuple]:
    """AU10: names whose values differ, with both values; numbers may differ by 1e-9."""
    same = lambda a, b: abs(a - b) <= 1e-9 if all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b)) else a == b
    return {k: (frozen.get(k), declared.get(k)) for k in sorted(set(frozen) | set(declared)) if k not in frozen or k not in declared or not same(frozen[k], declared[k])}


def frame_problems(videos: DataFrame, frames: DataFrame, step: int, latest: Column) -> DataFrame:
    """AU6: (video_id, timestamp_sec, reason) of everything that keeps a video's frames from being whole.

    A video without any row is ``summary_missing``, one whose rows name no duration
    ``duration_missing``; both have no timestamp. Of a video with a duration every point
    of the grid 0, step, ... is judged by its last row in the order of ``latest``:
    ``row_missing``, ``status_...`` (not ``success``) or ``image_missing_or_invalid``.
    ``frames``: video_id, timestamp_sec, duration_sec, status, image_ok; rows without a
    timestamp count for the duration only. The duration is the first that is told.
    """
    told = frames.groupBy("video_id").agg(F.min_by("duration_sec", F.when(F.col("duration_sec").isNotNull(), latest)).alias("duration"))
    known = videos.select("video_id").distinct().join(told.withColumn("_there", F.lit(True)), "video_id", "left")
    whole = F.when(F.col("_there").isNull(), "summary_missing").when(F.col("duration").isNull(), "duration_missing")
    of_video = known.select("video_id", F.lit(None).cast("int").alias("timestamp_sec"), whole.alias("reason")).where("reason IS NOT NULL")

    last = frames.where("timestamp_sec IS NOT NULL").groupBy("video_id", F.col("timestamp_sec").cast("int").alias("timestamp_sec")).agg(F.max_by(F.struct("status", "image_ok"), latest).alias("row"))
    grid = expected_grid(known.where("duration IS NOT NULL"), "video_id", "duration", step).join(last, ["video_id", "timestamp_sec"], "left")
    status = F.lower(F.trim(F.coalesce("row.status", F.lit("missing"))))
    reason = F.when(F.col("row").isNull(), "row_missing").when(status != "success", F.concat(F.lit("status_"), status)).when(~F.coalesce("row.image_ok", F.lit(False)), "image_missing_or_invalid")
    return of_video.unionByName(grid.select("video_id", "timestamp_sec", reason.alias("reason")).where("reason IS NOT NULL"))


def problem_runs(problems: DataFrame, step: int) -> DataFrame:
    """AU6: gaps and islands: (video_id, reason, first_sec, last_sec, frames) of neighbouring grid points with one reason."""
    some = problems.where("timestamp_sec IS NOT NULL")
    island = (F.col("timestamp_sec") / step).cast("int") - F.row_number().over(Window.partitionBy("video_id", "reason").orderBy("timestamp_sec"))
    runs = some.withColumn("_island", island).groupBy("video_id", "reason", "_island")
    return runs.agg(F.min("timestamp_sec").alias("first_sec"), F.max("timestamp_sec").alias("last_sec"), F.count(F.lit(1)).alias("frames")).drop("_island")
