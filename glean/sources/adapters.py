"""Work that leaves Spark (fetching, capture, recognition) behind callables that the caller brings.

A callable runs once for a key inside a task, failures become statuses instead of
lost tasks, and keys already landed are left out by an anti-join before it runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glean.sources.tables import pending

SEGMENTS = "video_id string, start_sec double, end_sec double, text string, status string"


def fetch_transcripts(videos: DataFrame, fetch: Callable[[str, list[str]], Iterable[tuple[float, float, str]]], languages: tuple[str, ...] = ("en", "vi"), landed: DataFrame | None = None) -> DataFrame:
    """SRC9, SRC10: rows of SEGMENTS for each (video_id, youtube_id); one row without text if the fetch fails or gives nothing.

    ``fetch(youtube_id, languages)`` yields (start, duration, text); times are rounded to two places.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for video, key in zip(pdf["video_id"], pdf["youtube_id"]):
                try:
                    rows = [(video, round(s, 2), round(s + d, 2), t, "success") for s, d, t in fetch(key, list(languages))]
                    out += rows or [(video, None, None, None, "empty")]
                except Exception as e:  # a video that cannot be had must not fail the others
                    out.append((video, None, None, None, f"failed: {e}"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    todo = videos if landed is None else pending(videos, landed, ["video_id"])
    return todo.select("video_id", "youtube_id").mapInPandas(run, SEGMENTS)


def capture_plan(videos: DataFrame, landed: DataFrame, step: int = 10, least_bytes: int = 5000) -> DataFrame:
    """SRC13, SRC14: the (video_id, timestamp_sec) still to capture; files under ``least_bytes`` do not count as landed."""
    whole = F.col("duration_sec").cast("int")
    grid = videos.where(whole > 0).select("video_id", F.explode(F.sequence(F.lit(0), whole - 1, F.lit(step))).alias("timestamp_sec"))
    return pending(grid, landed, ["video_id", "timestamp_sec"], F.col("n_bytes") >= least_bytes)


def repair_section(timestamp: Column, duration: Column, before: int = 20, after: int = 10) -> Column:
    """SRC15: the stretch of a video to fetch for one missing frame, and the frame's place in it."""
    start = F.greatest(timestamp - before, F.lit(0))
    return F.struct(start.alias("start_sec"), F.least(timestamp + after, duration).alias("end_sec"), (timestamp - start).alias("offset_sec"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """SRC16: (image_file, content) of image files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("image_file"), "content")


def recognise(images: DataFrame, engine: Callable[[bytes], str], done: DataFrame | None = None) -> DataFrame:
    """SRC16, SRC17: ocr_text, its characters and words, and ocr_status (success, empty, failed).

    ``done`` holds earlier results; images that failed there are tried again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, content in zip(pdf["image_file"], pdf["content"]):
                try:
                    text, failed = " ".join(engine(bytes(content)).split()), False
                except Exception:  # an unreadable image is a status, not a lost task
                    text, failed = "", True
                out.append((name, text, len(text), len(text.split()), "failed" if failed else "success" if text else "empty"))
            yield pd.DataFrame(out, columns=["image_file", "ocr_text", "ocr_char_count", "ocr_word_count", "ocr_status"])

    todo = images if done is None else pending(images, done, ["image_file"], F.col("ocr_status").isin("success", "empty"))
    return todo.mapInPandas(run, "image_file string, ocr_text string, ocr_char_count int, ocr_word_count int, ocr_status string")
