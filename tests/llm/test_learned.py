"""Learned operators by held-out accuracy; the index by recall; the pipeline by its stages' promises."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glean.llm import language_id, permutation_index, quality_classifier, queries, toxicity
from tests.compare import DATA
from tests.llm.fixtures import empty, messy, messy_rows, near_classes_brute, prose, substring_brute, words

SF = DATA.replace("sf0.001", "sf0.01")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_data
def test_languages_held_out(spark):
    got = queries.QUERIES["op5_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


@needs_data
@pytest.mark.parametrize("name,label", [("op8_toxicity", "toxic"), ("op10_quality_classifier", "quality")])
def test_classifiers_held_out(name, label, spark):
    got = queries.QUERIES[name](spark, SF)
    assert got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    held = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    assert held.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] > 0.93


def test_mixed_text_has_spans_of_both_languages(spark):
    rng = random.Random(5)
    train = spark.createDataFrame([(i, prose(rng, 80, lang=l), l) for i in range(30) for l in ("en", "fr", "de")], "doc_id long, text string, lang string")
    model = language_id.train(train)
    mixed = prose(rng, 40, lang="fr") + " " + prose(rng, 30, lang="de")
    r = language_id.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert [s["lang"] for s in r["spans"]] == ["fr", "de"] and abs(r["spans"][0]["end"] - 40) <= 2
    assert r["lang_pred"] == "fr" and r["score"] == pytest.approx(40 / 70, abs=0.05)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(2)
    model = language_id.Model(["a", "b", "c"], np.zeros((1, 3)), np.ones((1, 3), bool))
    table = -rng.random((9, 3)).astype(np.float32) * 8
    words_ = language_id.Words(np.array([0, 0, 6, 9]), np.arange(9), None)
    label = model.paths(words_, table)
    for a, b in ((0, 6), (6, 9)):
        def value(path):
            return sum(table[a + i, s] for i, s in enumerate(path)) - language_id.SWITCH * sum(x != y for x, y in zip(path, path[1:]))
        best = max(value(p) for p in np.ndindex(*[3] * (b - a)))
        assert value(label[a:b]) == pytest.approx(best, abs=1e-4)


def test_languages_of_awkward_rows(spark):
    model = language_id.train(messy(spark))
    got = language_id.identify(messy(spark), model).collect()
    assert len(got) == len(messy_rows())
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in (42, 43, 44))
    marks = spark.createDataFrame([(1, "\u0301 \u0951"), (2, "12 \u0301\u0301"), (3, "\u0301a")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in language_id.identify(marks, model).orderBy("doc_id").collect()] == [True, True, False]
    none = language_id.train(empty(spark))
    assert {r["lang_pred"] for r in language_id.identify(messy(spark), none).collect()} == {"und"}
    assert language_id.identify(empty(spark), model).count() == 0


def test_toxicity_finds_the_sentence(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(240):
        parts = [prose(rng, 8) + "." for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            parts.insert(rng.randint(0, len(parts)), "You utter " + rng.choice(["nitwit", "dolt"]) + " there.")
        docs.append((i, " ".join(parts)))
        labels.append((i, int(i % 4 == 0)))
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (0, 0), (None, 1), (999, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, l)
    got = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    assert all((got[i]["score"] >= 0.5) == (i % 4 == 0) for i in got)
    for i, text in docs[::4]:
        (s,) = got[i]["offending"]
        assert text.split()[s["start"] : s["end"]][:2] == ["You", "utter"]
    odd = toxicity.score(messy(spark), model).collect()
    assert len(odd) == len(messy_rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(empty(spark), model).count() == 0


@pytest.mark.parametrize("rows,expected", [([], 0.0), ([(0, 1), (1, 1)], 1.0), ([(0, 0)], 0.0)])
def test_toxicity_without_both_classes(rows, expected, spark):
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    model = toxicity.fit(messy(spark), labels)
    assert {r["score"] for r in toxicity.score(messy(spark), model, with_sentences=False).collect()} == {expected}


def test_quality_without_both_classes_and_awkward_rows(spark):
    measured = quality_classifier.measure(messy(spark))
    for rows, expected in (([], 0.5), ([(0, 1), (1, 1)], 1.0)):
        model = quality_classifier.fit(measured, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert {r["score"] for r in quality_classifier.score(measured, model).collect()} == {expected}
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.score(measured, quality_classifier.fit(measured, labels)).collect()
    assert len(got) == len(messy_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.measure(empty(spark)).count() == 0


def test_isotonic_is_the_nearest_rising_sequence():
    got = quality_classifier.isotonic(np.array([0.1, 0.5, 0.3, 0.9, 0.7]), np.array([1.0, 1, 3, 1, 1]))
    assert got == pytest.approx([0.1, 0.35, 0.35, 0.8, 0.8])


def test_fourier_features_approximate_a_gaussian_kernel(monkeypatch):
    monkeypatch.setattr(quality_classifier, "WIDTH", 4096)
    x = np.random.default_rng(1).normal(size=(6, 13))
    z = quality_classifier.fourier(x)[:, :-1]
    width = quality_classifier.BANDWIDTH * np.sqrt(13 / 4)
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * width**2))
    assert np.abs(z @ z.T - kernel).max() < 0.06


@needs_data
def test_index_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.array(rows["embedding"].tolist(), dtype=float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = queries.QUERIES["op9_permutation_index"](spark, SF).toPandas()
    hit = 0
    for q, part in got.groupby("query_id"):
        i = int(np.flatnonzero(rows["vec_id"] == q)[0])
        truth = unit @ unit[i]
        for r in part.itertuples():
            assert r.score == pytest.approx(truth[np.flatnonzero(rows["vec_id"] == r.vec_id)[0]], abs=1e-12)
        truth[i] = -9
        assert sorted(part["rank"]) == [1, 2, 3, 4, 5]
        hit += (part["score"] >= np.sort(truth)[-5] - 1e-12).sum()
    assert hit / len(got) >= 0.9


@pytest.mark.parametrize("share,least,most", [(permutation_index.RERANK, 0.9, 1.0), (0.002, 0.0, 0.8)])
def test_recall_of_many_vectors(share, least, most):
    """A tenth reranked finds nine in ten and more; almost nothing reranked does not: the share is what decides."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 64))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    shard = permutation_index.Shard(np.arange(len(x)), x, permutation_index.spread(unit[: 8 * permutation_index.PIVOTS], permutation_index.PIVOTS), share)
    hit = 0
    for q in range(0, 20_000, 500):
        score = unit @ unit[q]
        score[q] = -9
        hit += (shard.search(q, x[q], 5)[1] >= np.sort(score)[-5] - 1e-12).sum()
    assert shard.budget <= 0.1 * len(x) and least <= hit / 200 <= most


def test_shards_give_what_one_gives(spark, monkeypatch):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(rng.normal(size=(400, 8)))], "vec_id long, embedding array<double>").repartition(5)
    monkeypatch.setattr(permutation_index, "SHARD", 60)
    got = permutation_index.nearest(df, F.col("vec_id") % 50 == 0, share=1.0).collect()
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 400, 50):
        score = unit @ unit[q]
        score[q] = -9
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == np.argsort(-score, kind="stable")[:5].tolist()


def test_index_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]), (8, [inf, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (100, [0.0, 0.0]), (150, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = permutation_index.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 2), (0, 2, 3), (0, 3, 1), (0, 4, 50), (50, 1, 1), (50, 2, 0), (50, 3, 2), (50, 4, 3)]
    assert got[2]["score"] == pytest.approx(1 / math.sqrt(2))
    assert permutation_index.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_index_counts_repeated_ids_once(spark):
    rows = [(k, [1.0, 0.1 * k]) for k in range(8)]
    rows += [rows[0]] * 2 + [rows[1]] * 6 + [(2, [-1.0, 0.0])]  # queries, candidates, and an id of two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = permutation_index.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, k, k) for k in range(1, 6)]


def test_index_orders_equal_vectors_by_id():
    rng = np.random.default_rng(4)
    for n in (8, 27, 39, 1000):
        vector, ids = rng.normal(size=32).astype(np.float32).astype(np.float64), rng.permutation(n) + 200
        shard = permutation_index.Shard(ids, np.tile(vector, (n, 1)), vector[None] / np.linalg.norm(vector))
        for query in rng.normal(size=(10, 32)):
            found, score = shard.search(150, query, 5)
            assert found.tolist() == [200, 201, 202, 203, 204] and len(set(score.tolist())) == 1


def test_index_reranks_beyond_the_copies_of_a_row(spark):
    rows = [(k, [1.0, 0.1 * k]) for k in range(8)]
    df = spark.createDataFrame(rows + [rows[1]] * 2000, "vec_id long, embedding array<float>")
    got = permutation_index.nearest(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5]


def test_pipeline_stages(spark, tmp_path):
    """Every stage on awkward rows: its columns, its decisions, and clean documents left alone."""
    docs = messy(spark).select("doc_id", "text", "lang", "source", "n_chars")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        kept[name] = (docs, docs := spark.read.parquet(f"{tmp_path}/{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.where("n_chars <> char_length(text)").count() == 0
    got = {n: ([tuple(r) for r in a.select("doc_id", "text").collect()], [tuple(r) for r in b.select("doc_id", "text").collect()] if "text" in b.columns else b.collect()) for n, (a, b) in kept.items()}
    before, after = got["quality_rules"]
    assert {d for d, t in before if t and 60 <= len(words(t)) <= 300} == {d for d, _ in after if d != 49}
    before, after = got["near_dedup"]
    truth = near_classes_brute(before)
    assert sorted(d for d, _ in after if d is not None) == sorted({c for c in truth.values() if c is not None})
    before, after = got["substring_dedup"]
    truth = substring_brute(before)
    for d, t in after:
        (old,) = [o for e, o in before if e == d]
        total, left = truth[d, old]
        assert t == (old if len(left) == total else b" ".join(left).decode())
    before, after = got["mixing"]
    assert set(after) <= set(before) and max(after.count(x) for x in set(after)) <= 3
    _, coded = got["bpe"]
    assert len(coded) == len(after) and all(r["n_tokens"] == len(r["ids"]) > 0 for r in coded)
    assert {n for n, _ in corpus_pipeline.STAGES} == set(kept)


@needs_data
def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
