"""Time-window operators: chunks, point-in-interval joins, grids, greedy folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glean.functions.numeric import jaccard


def overlap_members(segments: DataFrame, chunk_seconds: float | Column, start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """JN7 on a regular grid: a row for each chunk that a segment touches.

    A segment belongs to chunk [a, a + C) if it starts before the chunk's end and
    ends at or after ``a``; so one that ends on a boundary is in both chunks. The
    touched chunks follow by arithmetic: no join, no shuffle.
    """
    size = chunk_seconds if isinstance(chunk_seconds, Column) else F.lit(float(chunk_seconds))
    first, last = (F.floor(F.col(c) / size).cast("int") for c in (start, end))
    return segments.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start))).withColumn("chunk_id", F.explode(F.sequence(first, last)))


def ordered_text(text: str, *order: str) -> Column:
    """AG16: a group's texts in order, joined by spaces; ties in the order are broken by the text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), " ")


def build_chunks(segments: DataFrame, chunk_seconds: float, process, key: str = "video_id", order: str = "start_sec", text: str = "text") -> DataFrame:
    """Chunks with raw and processed text; blank ones go, the numbers of the others stay (S2)."""
    grouped = overlap_members(segments, chunk_seconds).groupBy(key, "chunk_id").agg(ordered_text(text, order).alias("raw_text"), F.count(F.lit(1)).alias("n_segments"))
    return grouped.withColumn("processed_text", process(F.col("raw_text"))).where(F.trim("processed_text") != "")


def chunk_of(seconds: Column, chunk_seconds: float) -> Column:
    """JN8 on a regular grid, MA2: the half-open chunk of a point in time."""
    return F.floor(seconds / F.lit(float(chunk_seconds))).cast("int")


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width: float) -> DataFrame:
    """JN9: points with the interval [start, end) that holds them, on an irregular grid.

    Both sides are bucketed by ``width`` seconds, so the range condition becomes an
    equi-join on (key, bucket) with a residual filter. Overlapping intervals give a
    row each; points outside all intervals give none.
    """
    bucket = lambda c: F.floor(c / F.lit(float(width)))
    spread = intervals.where(F.col(end) > F.col(start)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    return points.withColumn("_bucket", bucket(F.col(at))).join(spread, [key, "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")


def expected_grid(spans: DataFrame, key: str, duration: str, step: int) -> DataFrame:
    """MA3: 0, step, 2 * step ... below the whole seconds of the duration."""
    whole = F.col(duration).cast("int")
    return spans.where(whole > 0).select(key, F.explode(F.sequence(F.lit(0), whole - 1, F.lit(step))).alias("timestamp_sec"))


def missing_points(spans: DataFrame, points: DataFrame, key: str, duration: str, step: int) -> DataFrame:
    """AU6: grid points without a row in ``points``."""
    return expected_grid(spans, key, duration, step).join(points.select(key, "timestamp_sec").distinct(), [key, "timestamp_sec"], "left_anti")


def greedy_dedup(items: Column, threshold: float = 0.85) -> Column:
    """MA5, S13: fold over ordered structs with a field ``tokens``; keep one unless it is near a kept one.

    ``items`` is an array of one group's structs; only kept items are compared.
    """
    return F.reduce(items, F.slice(items, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: jaccard(k["tokens"], x["tokens"]) >= threshold), kept).otherwise(F.concat(kept, F.array(x))))


def suppress_close(times: Column, gap: float, most: int) -> Column:
    """WN8: fold over ascending times; keep at most ``most``, each ``gap`` or more after the last kept."""
    return F.reduce(times, F.slice(times, 1, 0), lambda kept, t: F.when((F.size(kept) >= most) | F.exists(kept, lambda k: F.abs(t - k) < gap), kept).otherwise(F.concat(kept, F.array(t))))
