"""Replacing writes, frames with reasons, annotation checks, the whole screen cleaner, and configurations as runs."""

import dataclasses
import difflib
import os
import re

import pytest
from pyspark.sql import functions as F

from glean.functions import text as X
from glean.operators import audit, dataset, tuning
from glean.plans import text_queries, tuning_queries
from glean.plans.config import LOCKED, PILOT
from glean.sources import tables
from tests.compare import DATA


def test_a_failing_write_leaves_the_old_output(spark, tmp_path):
    path = f"{tmp_path}/out"
    tables.write_csv(spark.createDataFrame([(1, 'say "x", y')], "a int, b string"), path)
    bad = spark.createDataFrame([(1,), (0,)], "a int").select(F.raise_error(F.lit("broken")).cast("int").alias("a"), F.lit("b").alias("b"))
    with pytest.raises(Exception, match="broken"):
        tables.write_csv(bad, path)
    assert [tuple(r) for r in tables.read_csv(spark, path, "a int, b string").collect()] == [(1, 'say "x", y')]
    tables.write_csv(spark.createDataFrame([(2, "z")], "a int, b string"), path, ["b", "a"])
    assert [tuple(r) for r in tables.read_csv(spark, path, "b string, a int").collect()] == [("z", 2)]
    assert sorted(os.listdir(tmp_path)) == ["out"]


def test_a_refused_rename_puts_the_old_output_back(spark, tmp_path):
    path = f"{tmp_path}/out"
    tables.write_csv(spark.createDataFrame([(1,)], "a int"), path)
    with pytest.raises(OSError, match="cannot be moved"):
        tables.replace_after_success(spark, path, lambda to: None)  # nothing is written, so nothing can be moved in
    assert tables.read_csv(spark, path, "a int").count() == 1 and sorted(os.listdir(tmp_path)) == ["out"]


def test_frame_reasons_and_runs(spark):
    frames = [
        ("a", 0, 0, None, "success", True), ("a", 1, 10, 55.9, " Success ", True), ("a", 2, 20, 99.0, "failed", True), ("a", 3, 30, None, "success", False),
        ("a", 4, 30, None, "success", None), ("a", 5, 50, None, None, True), ("b", 6, 0, None, "success", True), ("c", 7, None, 12.0, "success", True), ("d", 8, 0, 0.5, "success", True),
    ]
    df = spark.createDataFrame(frames, "video_id string, n int, timestamp_sec int, duration_sec double, status string, image_ok boolean")
    videos = spark.createDataFrame([(v,) for v in "abcdea"], "video_id string")
    found = audit.frame_problems(videos, df, 10, F.col("n"))
    got = sorted((r["video_id"], -1 if r["timestamp_sec"] is None else r["timestamp_sec"], r["reason"]) for r in found.collect())
    assert got == [
        ("a", 20, "status_failed"), ("a", 30, "image_missing_or_invalid"), ("a", 40, "row_missing"), ("a", 50, "status_missing"),
        ("b", -1, "duration_missing"), ("c", 0, "row_missing"), ("c", 10, "row_missing"), ("e", -1, "summary_missing"),
    ]
    runs = sorted(tuple(r) for r in audit.problem_runs(found, 10).where("reason = 'row_missing'").collect())
    assert runs == [("a", "row_missing", 40, 40, 1), ("c", "row_missing", 0, 10, 2)]


def test_annotation_problems(spark):
    rows = [("v1", "1", "0", "ann", "completed"), ("v2", "x", None, " ", "Completed "), ("v3", "0", "1", None, "draft")]
    df = spark.createDataFrame(rows, "video_id string, loop string, sort string, annotator string, review_status string")
    got = sorted(tuple(r) for r in dataset.annotation_problems(df, "video_id", ["loop", "sort"]).collect())
    assert got == [("v2", "blank_annotator", ""), ("v2", "invalid_label", "loop=x"), ("v2", "invalid_label", "sort="), ("v3", "blank_annotator", ""), ("v3", "incomplete_review", "draft")]


def menu_by_hand(words):
    """The menu words that windows of eight with four menu words, an anchor and no protected term remove, word by word."""
    plain = [re.sub(r"[^a-z0-9_]+", "", w.lower()) for w in words]

    def near(w):
        return w in X.UI_TOKENS or len(w) >= 4 and any(len(u) >= 4 and difflib.SequenceMatcher(None, w, u).ratio() >= 0.82 for u in X.UI_TOKENS)

    flags, gone = [near(w) for w in plain], set()
    for s in range(len(words)):
        some = range(s, min(s + 8, len(words)))
        if sum(flags[i] for i in some) >= 4 and any(plain[i] in X.UI_ANCHORS for i in some) and not any(plain[i] in X.PROTECTED_TERMS for i in some):
            gone |= {i for i in some if flags[i]}
    return [w for i, w in enumerate(words) if i not in gone], len(gone)


def test_the_whole_screen_cleaner(spark):
    texts = [
        "file edit view project tools window help answer is here", "fiie edlt view project tools window help", "file edit view where group tools window help",
        "file edit 1234567 https://a.b/c x ===== y", "", "plain prose about a river and its banks", "edit view help go on file tools window and more words to end the line view help",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id int, screen string")
    got = {r["page_id"]: r for r in text_queries.clean_screen_v2(df, "page_id", "screen").collect()}
    assert len(got) == len(texts)
    removed = 0
    for k, t in enumerate(texts):
        # what the rules before the menus leave, then the menus by hand
        before = X.drop_phrases(X.correct(df.where(F.col("page_id") == k).withColumn("t", F.lower("screen")), "t", "c").withColumn("t", X.strip_links(F.col("t"))), "t", "p").select(X.tokens(F.col("t")).alias("w")).first()["w"]
        left, n = menu_by_hand([w for w in before if w])
        assert got[k]["ui_cluster_tokens_removed"] == n, t
        removed += n
        for w in left:
            if w.isalpha() and len(w) > 2:
                assert w in got[k]["cleaned"].split(), (t, w)
    assert removed >= 10 and got[3]["long_numbers_removed"] == 1 and got[4]["cleaned"] == ""


def test_whole_means_round_as_told(spark):
    df = spark.createDataFrame([(5, 2), (7, 2), (10, 3), (11, 3), (9, 4)], "s long, n long")
    up, even = ([r[0] for r in df.select(tuning.whole_mean(F.col("s"), F.col("n"), m)).collect()] for m in ("half_up", "half_even"))
    assert up == [3, 4, 3, 4, 2] and even == [2, 4, 3, 4, 2]


def test_every_choice_of_a_configuration_counts(spark):
    base = {(r["video_id"], r["concept"]): r for r in tuning_queries.predictions(spark, DATA, PILOT).collect()}
    for change in ({"chunk_seconds": 180}, {"alpha": 0.0}, {"aggregation": "max"}, {"threshold": 0.9}, {"concept_text_mode": "name"}):
        other = {(r["video_id"], r["concept"]): r for r in tuning_queries.predictions(spark, DATA, dataclasses.replace(PILOT, **change)).collect()}
        assert other.keys() == base.keys() and any(other[k] != base[k] for k in base), change
    assert (LOCKED.chunk_seconds, LOCKED.alpha, LOCKED.aggregation, LOCKED.threshold) == (180, 0.0, "max", 0.5)
    with pytest.raises(ValueError, match="concept text"):
        tuning_queries.predictions(spark, DATA, dataclasses.replace(PILOT, concept_text_mode="title"))
