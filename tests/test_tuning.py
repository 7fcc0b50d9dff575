"""Folds of whole videos, the search for settings, bootstrap draws, ranks and quantiles of large groups."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glean.operators import audit, evidence, models, ranking, scoring, stats, tuning
from glean.plans import model_queries, tuning_queries


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_within_strata_of_any_size(spark, parts):
    rows = [("big", int(x)) for x in np.random.default_rng(1).permutation(900)] + [("small", 5), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "s string, v int").withColumn("place", F.lit("mine")).repartition(5)
    got = ranking.ranked_within(df.drop("place"), ["s"], F.col("v"), parts=parts).collect()
    assert sorted(((r["s"] or "", r["v"], r["place"]) for r in got)) == sorted([("big", v, v + 1) for v in range(900)] + [("small", 5, 1), ("", 1, 1), ("", 2, 2)])
    assert ranking.ranked_within(df.drop("place").limit(0), ["s"], F.col("v")).count() == 0


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    data = {"a": rng.integers(0, 40, 501) / 4, "b": rng.normal(size=100), "c": np.array([7.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("none", None)], "g string, x double").repartition(4)
    shares = {"lo": 0.025, "mid": 0.5, "hi": 0.975, "end": 1.0}
    got = {r["g"]: r for r in ranking.exact_quantiles(df, ["g"], "x", shares).collect()}
    assert set(got) == set(data)
    for g, v in data.items():
        assert [got[g][n] for n in shares] == pytest.approx(np.quantile(v, list(shares.values())))
    named = {r["g"]: r for r in stats.summary(df, ["g"], "x").collect()}
    assert named["a"]["n"] == 501 and named["b"]["median"] == pytest.approx(np.median(data["b"]), abs=1e-6) and named["none"]["median"] is None


def test_top_sums_of_few_and_null_scores(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.9), ("a", 0.7), ("a", 0.1), ("b", 0.3), ("c", None)], "g string, s double")
    got = {r["g"]: (r["sum1"], r["n1"], r["sum2"], r["n2"], r["sum3"], r["n3"]) for r in evidence.top_sums(df, ["g"], "s").collect()}
    assert got["a"] == pytest.approx((0.9, 1, 1.6, 2, 2.1, 3)) and got["b"] == pytest.approx((0.3, 1, 0.3, 1, 0.3, 1)) and "c" not in got


def test_set_overlap_keeps_pairs_without_common_elements(spark):
    left = spark.createDataFrame([(1, 0, ["x", "y"]), (2, 0, []), (3, 1, ["x"])], "k int, s int, a array<string>")
    right = spark.createDataFrame([(7, 0, ["y", "z"]), (8, 0, ["x", "y"]), (9, 2, ["x"])], "n int, s int, b array<string>")
    got = sorted(tuple(r) for r in scoring.set_overlap(left, ["k"], "a", right, ["n"], "b", "s").collect())
    assert got == [(1, 7, 1, 2, 2), (1, 8, 2, 2, 2), (2, 7, 0, 0, 2), (2, 8, 0, 0, 2)]


def test_overlap_meets_a_catalog_where_the_rows_are(spark, capsys):
    """Nothing is shuffled for a catalog; one beyond the bound gives the same pairs and scores by joins."""
    rng = np.random.default_rng(8)
    sets = lambda n, low: [(k, None if k == 3 else int(k % 3), [f"e{x}" for x in sorted(set(rng.integers(0, 30, rng.integers(low, 12)).tolist()))]) for k in range(n)]
    left = spark.createDataFrame(sets(40, 0), "k long, s int, a array<string>").repartition(3)
    right = spark.createDataFrame(sets(11, 0), "n int, s long, b array<string>")
    for normed in (False, True):
        one, other = (sorted(tuple(r) for r in scoring.overlap_scores(left, ["k"], "a", right, ["n"], "b", "s", normed, most).collect()) for most in (1000, 3))
        assert len(one) > 100 and one == other
    one, other = (sorted(tuple(r) for r in scoring.set_overlap(left, ["k"], "a", right, ["n"], "b", "s", most).collect()) for most in (1000, 3))
    assert one == other
    scoring.overlap_scores(left.coalesce(1), ["k"], "a", right, ["n"], "b", "s", True).explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_counts_of_settings_equal_those_of_scores(spark, capsys, batch):
    """Groups and videos that go on in the next batch are whole, and no weight is a row before the counts."""
    rows, truth, _ = searched(np.random.default_rng(5))
    scores = spark.createDataFrame([(*r, truth[r[0], r[1]]) for r in rows], "video int, concept int, chunk int, lda_norm double, lsa_norm double, y_true int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        alphas, thresholds = [0.0, 0.3, 1.0], [0.2, 0.5, 0.95]
        got = tuning.setting_counts(scores, [], "video", "concept", "y_true", alphas, thresholds)
        scored = tuning.video_scores(scores, [], "video", "concept", alphas).join(scores.select("video", "concept", "y_true").distinct(), ["video", "concept"])
        want = tuning.threshold_counts(scored, ["video", "alpha", "aggregation"], "y_true", thresholds)
        assert got.columns == want.columns and len(rows) > 100
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
        got.explain()
        assert "Generate" not in capsys.readouterr().out
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def searched(rng):
    """Chunk scores of twelve videos, truth and folds."""
    rows = [(v, k, c, float(rng.choice([0, 0.25, 0.3333, 0.7, 1])), float(rng.random())) for v in range(12) for k in range(4) for c in range(3 + v % 3)]
    truth = {(v, k): int(rng.random() < 0.4) for v in range(12) for k in range(4)}
    return rows, truth, {v: v % 3 for v in range(12)}


def by_hand(rows, truth, videos, alpha, aggregation, threshold):
    """Macro F1 of a setting by the definition."""
    rates = []
    for v in videos:
        tp = fp = fn = 0
        for k in range(4):
            xs = sorted((round(round(alpha * a + (1 - alpha) * b, 9) * 10_000) for w, j, _, a, b in rows if (w, j) == (v, k)), reverse=True)
            xs = {"max": xs[:1], "mean": xs, "top2_mean": xs[:2], "top3_mean": xs[:3]}[aggregation]
            hit = (2 * sum(xs) + len(xs)) // (2 * len(xs)) >= round(threshold * 10_000)
            tp, fp, fn = tp + (hit and truth[v, k]), fp + (hit and not truth[v, k]), fn + (not hit and truth[v, k])
        rates.append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    return sum(rates) / len(rates)


def test_search_equals_the_definition(spark):
    rows, truth, folds = searched(np.random.default_rng(4))
    alphas, thresholds = [0.0, 0.4, 1.0], [0.2, 0.5, 0.95]
    scores = spark.createDataFrame(rows, "video int, concept int, chunk int, lda_norm double, lsa_norm double").repartition(3)
    scored = tuning.video_scores(scores, [], "video", "concept", alphas)
    known = spark.createDataFrame([(v, k, t, folds[v]) for (v, k), t in truth.items()], "video int, concept int, y_true int, fold int")
    counts = tuning.threshold_counts(scored.join(known, ["video", "concept"]), ["alpha", "aggregation", "video", "fold"], "y_true", thresholds)
    by = ["alpha", "aggregation", "threshold"]
    sums = tuning.fold_sums(counts, by, "fold").cache()
    nested, whole = tuning.nested_search(sums, by, "fold").collect(), tuning.full_search(sums, by, "fold").collect()
    assert len(nested) == 3 * 36 and len(whole) == 36
    for r in nested:
        inside = [v for v in folds if folds[v] != r["fold"]]
        assert r["videos"] == 8 and r["macro_f1"] == pytest.approx(by_hand(rows, truth, inside, *[r[c] for c in by]), abs=1e-6)
    for r in whole:
        each = [by_hand(rows, truth, [v for v in folds if folds[v] == f], *[r[c] for c in by]) for f in range(3)]
        assert r["macro_f1"] == pytest.approx(np.mean(each), abs=1e-6) and r["fold_std"] == pytest.approx(np.std(each, ddof=1), abs=1e-6)
    # scores of the held-out fold change nothing on its training side
    altered = scores.withColumn("lsa_norm", F.when(F.col("video") % 3 == 1, 0.0).otherwise(F.col("lsa_norm")))
    again = tuning.threshold_counts(tuning.video_scores(altered, [], "video", "concept", alphas).join(known, ["video", "concept"]), ["alpha", "aggregation", "video", "fold"], "y_true", thresholds)
    again = tuning.nested_search(tuning.fold_sums(again, by, "fold"), by, "fold")
    key = lambda found: sorted(tuple(r) for r in found if r["fold"] == 1)
    assert key(again.collect()) == key(nested)


def test_ties_go_to_the_baseline(spark):
    rows = [(0, a, g, t, 0.5, 0.5) for a in (0.3, 0.4, 0.5) for g in evidence.AGGREGATIONS for t in (0.35, 0.4)]
    found = spark.createDataFrame(rows, "fold int, alpha double, aggregation string, threshold double, macro_f1 double, micro_f1 double")
    pick = tuning.select_nested(found, "fold", 0.4, "top2_mean", 0.4).first()
    assert (pick["alpha"], pick["aggregation"], pick["threshold"]) == (0.4, "top2_mean", 0.4)
    first = tuning.best_settings(found.withColumn("fold_std", F.lit(0.1)), []).first()
    assert (first["alpha"], first["aggregation"], first["threshold"]) == (0.3, "max", 0.35)


def test_bootstrap_draws_are_shared_and_stratified(spark):
    values = [("a", i, i, 10 * i) for i in range(7)] + [("b", 0, 100, 1000)]
    df = spark.createDataFrame(values, "s string, place int, x long, y long")
    got = {r["draw"]: r for r in stats.bootstrap_sums(df, "s", "place", ["x", "y"], 50, "seed").collect()}
    assert len(got) == 50
    for d, r in got.items():
        picks = []
        for slot in range(7):
            digest = hashlib.md5(f"seed-a-{d}-{slot // 4}".encode()).hexdigest()
            picks.append(int(digest[8 * (slot % 4) : 8 * (slot % 4) + 8], 16) % 7)
        assert (r["n"], r["x"], r["y"]) == (8, sum(picks) + 100, 10 * sum(picks) + 1000)


def test_bootstrap_draws_are_no_rows(spark, capsys):
    """Places drawn stay inside a task, and tiles of a large stratum give the same sums."""
    df = spark.createDataFrame([(s, i, 3 * i + 1, i / 4) for s, n in (("a", 23), ("b", 4), ("c", 1)) for i in range(n)], "s string, place int, x long, y double").repartition(3)
    one, some = (sorted(tuple(r) for r in stats.bootstrap_sums(df, "s", "place", ["x", "y"], 450, "seed", tile).collect()) for tile in (1 << 20, 5))
    assert [r[:3] for r in one] == [r[:3] for r in some] and [r[3] for r in one] == pytest.approx([r[3] for r in some])
    assert [r[0] for r in one] == list(range(450)) and {r[1] for r in one} == {28}
    stats.bootstrap_sums(df, "s", "place", ["x"], 450, "seed").explain("extended")
    optimized = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1]
    assert "explode(sequence(0, 449" not in optimized and "md5" not in optimized


def test_pairs_of_videos_and_concepts_are_not_broadcast(spark, capsys):
    """Their number is not in Spark's estimates, so no side of them may go through the driver."""
    d = "/root/testdata/sf0.001"
    known = tuning_queries.truth(spark, d)
    for found in (tuning_queries._counts(spark, d, [60], known, [], [0.5], [0.4]), tuning_queries._sized_predictions(spark, d), tuning_queries.predictions(spark, d, tuning_queries.PILOT)):
        found.explain()
        plan, below = capsys.readouterr().out.splitlines(), None  # the column of the broadcast that a line is part of
        assert sum("MapInArrow" in line for line in plan) >= 3
        for line in plan:
            at = len(line) - len(line.lstrip(" :+-"))
            below = None if below is not None and at <= below else below
            assert below is None or "MapInArrow" not in line, line
            below = at if below is None and "BroadcastExchange" in line else below


#: True positives, false positives and false negatives of forty videos, ten of each of four subjects in turn, under two settings.
TUNED = [
    [(4, 0, 2), (4, 1, 1), (2, 2, 0), (4, 1, 0), (4, 1, 2), (2, 0, 4), (8, 2, 1), (9, 1, 0), (2, 0, 8), (1, 0, 3)],
    [(6, 1, 1), (5, 1, 1), (1, 1, 3), (1, 0, 0), (2, 0, 0), (3, 4, 0), (2, 4, 0), (1, 6, 0), (1, 1, 3), (1, 1, 6)],
    [(3, 6, 0), (4, 0, 2), (4, 0, 4), (2, 3, 0), (2, 1, 1), (2, 0, 2), (1, 1, 0), (2, 6, 0), (2, 0, 7), (2, 0, 0)],
    [(2, 5, 0), (2, 5, 0), (1, 1, 0), (1, 3, 0), (1, 4, 0), (1, 3, 0), (2, 2, 0), (2, 1, 0), (1, 1, 1), (1, 2, 0)],
]
FIXED = [
    [(6, 1, 0), (4, 2, 1), (2, 4, 0), (4, 5, 0), (5, 2, 1), (5, 2, 1), (9, 2, 0), (9, 2, 0), (9, 1, 1), (4, 3, 0)],
    [(6, 1, 1), (5, 2, 1), (3, 4, 1), (1, 2, 0), (2, 3, 0), (3, 5, 0), (2, 5, 0), (1, 6, 0), (3, 4, 1), (6, 2, 1)],
    [(3, 6, 0), (4, 2, 2), (8, 1, 0), (2, 5, 0), (3, 5, 0), (2, 2, 2), (1, 4, 0), (2, 6, 0), (8, 0, 1), (2, 3, 0)],
    [(2, 7, 0), (2, 7, 0), (1, 7, 0), (1, 6, 0), (1, 6, 0), (1, 7, 0), (2, 4, 0), (2, 3, 0), (2, 3, 0), (1, 8, 0)],
]
#: The published intervals of the means, in the order in which one generator drew them.
INTERVALS = [
    (0.5689866071, 0.7112500000), (0.6918249008, 0.8616076389), (0.5429002122, 0.6724347374),
    (0.4061479978, 0.5294909361), (0.9019821429, 0.9671240079), (0.5245356446, 0.6232459110),
]
#: The published paired tests of the difference in F1.
WILCOXON, WILCOXON_P, T, T_P, DZ = 252.0, 0.20312664, 0.82896941, 0.41216667, 0.13107157
DIFFERENCE, DIFFERENCE_INTERVAL = 0.0343488477, (-0.0397172053, 0.1086963752)


def rates(counts):
    """Precision, recall and F1 of each stratum's videos."""
    return [[np.array([f(*v) for v in stratum]) for stratum in counts] for f in (lambda t, p, n: t / (t + p), lambda t, p, n: t / (t + n), lambda t, p, n: 2 * t / (2 * t + p + n))]


def test_published_intervals():
    made, got = np.random.default_rng(42), []
    for counts in (TUNED, FIXED):
        for strata in rates(counts):
            got.append(stats.bootstrap_ci_numpy(strata, 10_000, made))
    assert got == [pytest.approx(x, abs=1e-9) for x in INTERVALS]


def test_drawn_intervals_are_near_the_published_ones(spark):
    """Other draws of the same resampling: within a hundredth."""
    wide = [np.concatenate(s) for counts in (TUNED, FIXED) for s in rates(counts)]
    df = spark.createDataFrame([(k // 10, k % 10, *(float(x[k]) for x in wide)) for k in range(40)], "s int, place int, " + ", ".join(f"m{k} double" for k in range(6)))
    sums = stats.bootstrap_sums(df, "s", "place", [f"m{k}" for k in range(6)], 10_000, "boot-42")
    means = sums.select("draw", *[(F.col(f"m{k}") / F.col("n")).alias(f"m{k}") for k in range(6)]).unpivot(["draw"], [f"m{k}" for k in range(6)], "name", "mean")
    got = {r["name"]: (r["ci_low"], r["ci_high"]) for r in stats.interval(means, ["name"], "mean").collect()}
    assert [got[f"m{k}"] for k in range(6)] == [pytest.approx(x, abs=0.01) for x in INTERVALS]


def test_published_paired_tests(spark):
    deltas = np.concatenate(rates(TUNED)[2]) - np.concatenate(rates(FIXED)[2])
    df = spark.createDataFrame([(round(float(x), 12),) for x in deltas], "d double").withColumn("all", F.lit(0))
    w, t = stats.wilcoxon(df, ["all"], "d").first(), stats.paired_t(df, ["all"], "d").first()
    assert w["statistic"] == WILCOXON and t["t_stat"] == pytest.approx(T, abs=1e-5) and t["mean_delta"] == pytest.approx(DIFFERENCE, abs=1e-6)
    assert stats.normal_p(w["z"]) == pytest.approx(WILCOXON_P, abs=2e-4)
    assert stats.student_p(t["t_stat"], 39) == pytest.approx(T_P, abs=1e-4) and t["cohen_dz"] == pytest.approx(DZ, abs=1e-5)


DOCS = 60


def topics_corpus(rng):
    words = [[f"t{k}w{i}" for i in range(30)] for k in range(4)]
    return [(d, d // 3, (d // 3) % 4, [str(x) for x in rng.choice(words[d % 4], 25)] + [str(x) for x in rng.choice(words[(d + 1) % 4], 5)]) for d in range(DOCS)]


def test_latent_space_equals_a_dense_svd(spark):
    rows = topics_corpus(np.random.default_rng(6))
    docs = spark.createDataFrame(rows, "doc_id int, conv_id int, subject int, terms array<string>").repartition(5)
    words = sorted({t for r in rows for t in r[3]})
    space = models.LatentSpace.fit(docs, "terms", words, 8)
    counts = np.array([[Counter(r[3])[w] for w in words] for r in rows], float)
    x = counts * (np.log((1 + DOCS) / (1 + (counts > 0).sum(0))) + 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = np.linalg.svd(x, full_matrices=False)[2][:8].T
    got = np.array([r["latent"] for r in space.transform(docs, "terms").orderBy("doc_id").collect()])
    assert space.components.shape == (len(words), 8)
    assert space.components.T @ space.components == pytest.approx(np.eye(8), abs=1e-9)
    assert (got @ got.T)[:20, :20] == pytest.approx(((x @ v) @ (x @ v).T)[:20, :20], abs=2e-3)  # rotation leaves products alone
    top = np.linalg.svd(space.components.T @ v)[1]
    assert top[:4] == pytest.approx(np.ones(4), abs=1e-6)


def test_folds_hold_out_whole_conversations_and_their_terms(spark):
    rows = topics_corpus(np.random.default_rng(7))
    docs = spark.createDataFrame(rows, "doc_id int, conv_id int, subject int, terms array<string>")
    docs = docs.join(model_queries.video_folds(docs), "conv_id").withColumn("fold", F.col("fold").cast("int"))
    found = audit.leakage(docs, "conv_id", "fold").collect()
    assert len(found) == 5 and all(r["overlap"] == 0 and r["train"] + r["test"] == 20 and r["test"] == 4 for r in found)
    concepts = spark.createDataFrame([(k, k, [f"t{k}w0", f"t{k}w1", f"t{k}w2"]) for k in range(4)], "concept int, subject int, terms array<string>")
    spaces = model_queries.fold_spaces(docs, concepts)
    extra = docs.withColumn("terms", F.when(F.col("fold") == 2, F.concat("terms", F.array(F.lit("heldout"), F.lit("heldout")))).otherwise(F.col("terms")))
    again = model_queries.fold_spaces(extra, concepts)
    known = [w for w in again[2].words if again[2].idf[again[2].words.index(w)] > 0]
    assert "heldout" not in known and "heldout" in [w for w, x in zip(again[1].words, again[1].idf) if x > 0]
    at = [again[2].words.index(w) for w in spaces[2].words]
    assert again[2].idf[at] == pytest.approx(spaces[2].idf, abs=0)
    scores = [models.project(x.where("fold = 2").select("doc_id", "fold", "terms"), "terms", s, "fold", "v") for x, s in ((docs, spaces), (docs, again))]
    a, b = (np.array([r["v"] for r in s.orderBy("doc_id").collect()]) for s in scores)
    assert a @ a.T == pytest.approx(b @ b.T, abs=1e-6)
    # the fit of a fold equals a fit on the other folds alone
    rest = docs.where("fold <> 2").select("terms").unionByName(concepts.select("terms"))
    alone = models.LatentSpace.fit(rest, "terms", [w for w, x in zip(spaces[2].words, spaces[2].idf) if x > 0], 100)
    c = np.array([r["latent"] for r in alone.transform(docs.where("fold = 2"), "terms").orderBy("doc_id").collect()])
    assert c @ c.T == pytest.approx(a @ a.T, abs=2e-3)


def test_every_setting_of_the_survey_is_searched():
    assert len(tuning_queries.ALPHAS) * len(evidence.AGGREGATIONS) * len(tuning_queries.THRESHOLDS) == 484
    assert 484 * model_queries.FOLDS == 2420 and 484 * len(tuning_queries.SIZES) == 1936
