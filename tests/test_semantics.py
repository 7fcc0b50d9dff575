
import pytest
from pyspark.sql import functions as F

from glean.functions import numeric, text as X
from glean.operators import audit, dataset, evaluate, evidence, scoring, stats, temporal, tuning
from glean.plans import text_queries
from glean.plans.config import LOCKED, PILOT


def column(df, name):
    return [r[name] for r in df.collect()]


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_chunks_overlap_and_are_closed_on_the_right(spark):
    seg = spark.createDataFrame([("v", 0.0, 60.0, "a"), ("v", 59.5, 61.0, "b")], "video_id string, start_sec double, end_sec double, text string")
    got = {(r["text"], r["chunk_id"]) for r in temporal.overlap_members(seg, 60).collect()}
    assert got == {("a", 0), ("a", 1), ("b", 0), ("b", 1)}


def test_blank_chunks_go_and_numbers_stay(spark):
    seg = spark.createDataFrame([("v", 5.0, 6.0, "sorting"), ("v", 65.0, 66.0, "the a"), ("v", 125.0, 126.0, "joining")], "video_id string, start_sec double, end_sec double, text string")
    got = temporal.build_chunks(seg, 60, lambda c: X.preprocess(c, ["the", "a"])).orderBy("chunk_id")
    assert column(got, "chunk_id") == [0, 2]


def test_segments_without_times_or_backwards_are_left_out(spark):
    seg = spark.createDataFrame([("v", None, 6.0, "x"), ("v", 9.0, 6.0, "y")], "video_id string, start_sec double, end_sec double, text string")
    assert temporal.overlap_members(seg, 60).count() == 0


def test_point_chunks_are_half_open(spark):
    assert value(spark, temporal.chunk_of(F.lit(59.0), 60)) == 0 and value(spark, temporal.chunk_of(F.lit(60.0), 60)) == 1


def test_points_in_irregular_intervals(spark):
    pts = spark.createDataFrame([("v", 0.0), ("v", 10.0), ("v", 99.0), ("w", 5.0)], "k string, t double")
    iv = spark.createDataFrame([("v", 0.0, 10.0, 1), ("v", 10.0, 55.0, 2), ("v", 5.0, 5.0, 3)], "k string, lo double, hi double, n int")
    got = {(r["t"], r["n"]) for r in temporal.points_in_intervals(pts, iv, "k", "t", "lo", "hi", 20).collect()}
    assert got == {(0.0, 1), (10.0, 2)}


def test_constant_group_is_zero_and_ties_rank_in_catalog_order(spark):
    df = spark.createDataFrame([("c", 1, 0.5), ("c", 2, 0.5)], "g string, idx int, s double")
    got = df.withColumn("n", scoring.minmax(F.col("s"), ["g"])).withColumn("rank", scoring.rank_first(F.col("n"), ["g"], "idx")).orderBy("idx").collect()
    assert [(r["n"], r["rank"]) for r in got] == [(0.0, 1), (0.0, 2)]


def test_round_then_rank_ties_and_rank_then_round_does_not(spark):
    df = spark.createDataFrame([("c", 1, 0.50001), ("c", 2, 0.50004)], "g string, idx int, s double")
    first = scoring.round_then_rank(df, "s", ["g"], "idx").orderBy("idx")
    second = scoring.rank_then_round(df, "s", ["g"], "idx").orderBy("idx")
    assert column(first, "rank") == [1, 2] and column(second, "rank") == [2, 1]


def test_topk_of_one_and_best_chunk_of_equals(spark):
    df = spark.createDataFrame([("v", "k", 3, 0.7, 0.0, 0.0, 1), ("v", "k", 1, 0.7, 0.0, 0.0, 4), ("w", "k", 5, 0.3, 0.0, 0.0, 2)], "v string, k string, chunk int, final_score double, lda_score double, lsa_score double, rank int")
    got = {r["v"]: r for r in evidence.evidence(df, "v", "k", "chunk").collect()}
    assert got["v"]["best_chunk"] == 1 and got["v"]["top1_count"] == 1 and got["v"]["top3_ratio"] == 0.5
    assert got["w"]["top2_mean"] == 0.3


def test_unknown_aggregation_is_an_error(spark):
    df = spark.createDataFrame([("v", 0.5)], "v string, s double")
    with pytest.raises(ValueError, match="median"):
        evidence.aggregate(df, ["v"], "s", "median")
    assert evidence.aggregate(df, ["v"], "s", "max").first()["value"] == 0.5


def test_no_positives_and_no_predictions_give_zero(spark):
    df = spark.createDataFrame([("v", 0, 0)], "item string, y_true int, y_pred int")
    r = evaluate.with_extended_rates(evaluate.with_rates(df.groupBy("item").agg(*evaluate.confusion()))).first()
    assert (r["precision"], r["recall"], r["f1"], r["mcc"], r["accuracy"]) == (0, 0, 0, 0, 1)


def test_macro_is_the_mean_of_item_rates(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 0), ("b", 1, 0)], "item string, y_true int, y_pred int").withColumn("all", F.lit(1))
    r = evaluate.macro_micro(df, "item", ["all"]).first()
    assert r["macro_f1"] == 0.5 and r["micro_f1"] == pytest.approx(2 / 3, abs=1e-6)


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(1, 0.2, 1), (1, 0.9, 1), (2, 0.2, 0)], "g int, score double, y_true int")
    assert {r["g"]: r["roc_auc"] for r in evaluate.roc_auc(df, ["g"]).collect()} == {1: None, 2: None}
    assert {r["g"]: r["average_precision"] for r in evaluate.average_precision(df, ["g"]).collect()} == {1: 1.0, 2: None}


def test_greedy_dedup_compares_with_kept_only(spark):
    base = [f"w{i}" for i in range(20)]
    a, b, c = base, base[1:] + ["x"], base[2:] + ["x", "y"]  # a-b and b-c near, a-c not
    df = spark.createDataFrame([(1, a), (2, b), (3, c)], "n int, tokens array<string>")
    got = df.agg(F.array_sort(F.collect_list(F.struct("n", "tokens"))).alias("i")).select(temporal.greedy_dedup(F.col("i"), 0.85).alias("k")).first()["k"]
    assert [r["n"] for r in got] == [1, 3]


def test_empty_token_sets_are_not_alike(spark):
    empty = F.array().cast("array<string>")
    assert value(spark, numeric.jaccard(empty, empty)) == 0.0


def test_suppression_keeps_three_apart(spark):
    times = F.array(*[F.lit(float(t)) for t in (0, 1, 2, 3.5, 4, 9, 20)])
    assert value(spark, temporal.suppress_close(times, 2.0, 3)) == [0.0, 2.0, 4.0]


def test_subject_aliases_and_video_ids(spark):
    df = spark.createDataFrame([("cpp", "v007"), ("C++", "V12"), (" CXX ", "x1"), ("Sql", None)], "s string, v string")
    got = df.select(X.subject_key(F.col("s")).alias("s"), X.video_id(F.col("v")).alias("v"), X.video_number(F.col("v")).alias("n")).collect()
    assert [r["s"] for r in got] == ["c++", "c++", "c++", "sql"]
    assert [(r["v"], r["n"]) for r in got] == [("v7", 7), ("v12", 12), ("x1", 1), ("", None)]


def test_preprocess_is_idempotent(spark):
    once = X.preprocess(F.lit("See https://a.b/c?d=1 the QUICK brown-fox, www.x.y I um like 2 sorts"), X.stop_words(["the", "see", "i"]))
    first = value(spark, once)
    assert first == "quick brown fox sorts" and value(spark, X.preprocess(F.lit(first), X.stop_words(["the", "see", "i"]))) == first


def test_screen_cleaning(spark):
    assert value(spark, X.clean_screen_v1(F.lit("Object Explorer SELECT * FROM t ===== 1234567 localhost\\sql Ln 12, Col 4 https://x.y/z a@b"))) == "select from t a b"
    df = spark.createDataFrame([("seiect name group 5v id object explorer ln 3, col 4",)], "t string")
    r = X.drop_phrases(X.correct(df, "t", "fixed"), "t", "gone").select(X.squeeze(F.col("t")).alias("t"), "fixed", "gone").first()
    assert (r["t"], r["fixed"], r["gone"]) == ("select name group by id", 2, 2)


def test_menu_clusters_go_unless_protected(spark):
    menu = set(X.UI_TOKENS)

    def left(words):
        w, f = F.array(*[F.lit(x) for x in words]), F.array(*[F.lit(x in menu) for x in words])
        return value(spark, X.without_places(w, X.menu_cluster(w, f)))

    assert left(["file", "edit", "view", "tools", "loop"]) == ["loop"]
    assert left(["file", "edit", "view", "tools", "select"]) == ["file", "edit", "view", "tools", "select"]
    assert left(["run", "search", "save", "close"]) == ["run", "search", "save", "close"]  # no anchor


def test_terms_stand_free(spark):
    has = lambda t, k: value(spark, X.has_term(F.lit(t), F.lit(k)))
    assert has("use group  by here", "group by") and not has("regroup by", "group by") and has("call count(id)", "count(id)")
    assert value(spark, X.has_alias(F.lit("The LEFT  join"), "left join")) and not value(spark, X.has_alias(F.lit("leftjoin"), "left join"))


def test_rounding_modes(spark):
    assert value(spark, numeric.rounded(F.lit(2.5), 0)) == 3 and value(spark, numeric.rounded(F.lit(2.5), 0, "half_even")) == 2
    with pytest.raises(ValueError):
        numeric.rounded(F.lit(1.0), 0, "down")


def test_safe_divide_and_hhmmss(spark):
    assert value(spark, numeric.safe_divide(F.lit(1), F.lit(0))) == 0.0
    assert value(spark, X.hhmmss(F.lit(3725.9))) == "01:02:05"
    assert value(spark, X.video_key(F.lit("https://youtu.be/abc?t=1"))) == "abc"


def test_published_test_statistics():
    assert stats.mcnemar_p(22, 30) == pytest.approx(0.33175, abs=1e-5)
    assert stats.mcnemar_p(21, 68) == pytest.approx(5.987e-7, rel=1e-3)
    assert stats.mcnemar_p(0, 0) == 1.0
    assert stats.student_p(2.0, 10) == pytest.approx(0.07339, abs=1e-4)
    assert stats.normal_p(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_pilot_rates(spark):
    df = spark.createDataFrame([(31, 4, 9, 0)], "tp int, fp int, fn int, tn int")
    r = evaluate.with_rates(df, 4).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.8857, 0.775, 0.8267)


def test_folds_are_balanced_and_cover_once(spark):
    names = ["SQL"] * 10 + ["Python"] * 10 + ["Java"] * 10 + ["C++"] * 10
    got = tuning.shuffled_folds(names, 5)
    for k in range(4):
        assert sorted(got[10 * k : 10 * k + 10]) == sorted([1, 2, 3, 4, 5] * 2)
    df = tuning.stratified_folds(spark.createDataFrame([(i, i % 3) for i in range(30)], "i int, s int"), "s", F.md5(F.col("i").cast("string").cast("binary")), 5)
    assert audit.coverage(df, "i", "fold").collect()[0].asDict() == {"held_out_in": 1, "items": 30}
    assert {(r["train"], r["test"], r["overlap"]) for r in audit.leakage(df, "i", "fold").collect()} == {(24, 6, 0)}


def test_ledger_names_failures(spark):
    found = audit.ledger(spark.range(3), {"three": (F.count(F.lit(1)), 3), "two": (F.count(F.lit(1)), 2)})
    with pytest.raises(ValueError, match="two"):
        audit.require(found)


def test_upsert_promote_and_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted((r["v"] for r in dataset.upsert(old, new, ["k"]).collect())) == ["a", "c", "d", "n"]
    assert {(r["k"], r["state"]) for r in dataset.promote(old, new, ["k"]).collect()} == {(2, "conflict"), (3, "append")}
    assert dataset.table_diff(old, old).count() == 0 and dataset.table_diff(old, new).count() == 5


def test_configurations_are_explicit():
    assert PILOT.concept_text_mode == "name+description" and LOCKED.as_dict()["chunk_seconds"] == 180


def test_screen_text_is_the_whole_page(spark, tmp_path):
    html = "<p>" + "plain words of prose " * 100 + "</p> seiect debugg 7654321 tail"
    spark.createDataFrame([(0, "u", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    run = lambda name: getattr(text_queries, name)(spark, str(tmp_path))
    assert run("ocr_clean_v1").first()["cleaned"].endswith("tail")
    r = run("ocr_clean_v2_audit").first()
    assert r["cleaned"].endswith("tail") and r["ocr_corrections"] == 1 and r["long_numbers_removed"] == 1
    assert "debugg" in column(run("fuzzy_ui_tokens"), "word")
    assert run("menu_cluster").first()["kept"].endswith("tail")


def test_greedy_dedup_of_a_whole_chunk_in_time_order(spark, tmp_path):
    rows = [(0, 0, "u", "same words here"), (0, 1, "u", "other text"), (0, 2, "u", "Same words here."), (0, 3, "u", " "), (0, 4, "u", "да"), (1, 0, "u", "same words here")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = text_queries.greedy_dedup(spark, str(tmp_path)).orderBy("video_id", "chunk_id", "start_sec").collect()
    assert [(r["video_id"], r["chunk_id"], r["turn"]) for r in got] == [(0, 0, 0), (0, 0, 1), (0, 0, 4), (0, 1, 4), (1, 0, 0)]


def test_text_classes(spark):
    df = spark.createDataFrame([(1, ""), (2, "  "), (3, "- x !"), (4, "a b ok"), (5, "-" * 5000 + " at last")], "n int, t string")
    assert column(df.orderBy("n").select(X.text_class(F.col("t")).alias("c")), "c") == ["empty", "empty", "noise", "useful", "useful"]


def test_exact_vector_search_in_blocks(spark, monkeypatch):
    """Ties, copies, zero, null and short vectors, however the rows are dealt."""
    import numpy as np

    drawn = np.random.default_rng(5).normal(size=(300, 4)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(drawn)] + [(300 + i, drawn[7].tolist()) for i in range(40)] + [(400, [0.0] * 4), (401, None), (402, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    x = np.zeros((len(rows), 4))
    for i, (_, v) in enumerate(rows):
        x[i, : len(v or [])] = v or []
    size = np.sqrt((x * x).sum(1))
    for shard, block in ((1 << 16, 1 << 11), (50, 7)):
        monkeypatch.setattr(scoring, "SHARD", shard)
        monkeypatch.setattr(scoring, "BLOCK", block)
        got = scoring.cosine_nearest(df, df.where("id % 20 = 0"), 5).orderBy("query_id", "rank").collect()
        want = []
        for q in (i for i, (n, _) in enumerate(rows) if n % 20 == 0):
            scores = [(-round(float(x[i] @ x[q] / (size[i] * size[q])) if size[i] * size[q] else 0.0, 6), rows[i][0]) for i in range(len(rows)) if i != q]
            want += [(rows[q][0], n, -s + 0.0, r) for r, (s, n) in enumerate(sorted(scores)[:5], 1)]
        assert [tuple(r) for r in got] == want
    assert scoring.cosine_nearest(df.limit(0), df, 5).isEmpty() and scoring.cosine_nearest(df, df.limit(0), 5).isEmpty()


def test_menus_of_many_rows_equal_those_of_each(spark, capsys):
    """Rows of any length in one batch against the expression on one row; no shuffle, no join."""
    import random

    from glean.plans import text_queries

    made = random.Random(3)
    pool = [*X.UI_TOKENS, "filee", "vieew", "select", "table", "xx", "12", "(file)", "windowsx", "a-b"]
    rows = [(k, [made.choice(pool[: made.choice([8, 28, 38])]) for _ in range(made.choice([0, 1, 3, 7, 8, 9, 30]))]) for k in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "k int, words array<string>").coalesce(1)
    near = text_queries._nearness()
    flags = spark.createDataFrame([(k, [near("".join(c for c in w if c.isalnum() or c == "_")) for w in ws]) for k, ws in rows if ws is not None], "k int, flags array<boolean>")
    want = df.join(flags, "k").withColumn("p", X.menu_cluster(F.col("words"), F.col("flags"))).select("k", F.array_join(X.without_places(F.col("words"), F.col("p")), " ").alias("kept"), F.size("p").alias("n"))
    found = text_queries.without_menus(df, "words", "n", "kept")
    got, want = ({r["k"]: (r["kept"], r["n"]) for r in x.collect()} for x in (found, want))
    assert got == want | {99: ("", 0)} and sum(n for _, n in got.values()) > 50
    found.explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Join" not in plan


def test_texts_are_cleaned_once(spark, capsys):
    """Lost terms are exploded above the cleaning; the words of pairs are made once; rules without a match leave a text."""
    from glean.plans import text_queries

    text_queries.term_loss(spark, "/root/testdata/sf0.001").explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count("http") == 1 and plan.index("Generate") < plan.index("http")
    text_queries.ngrams(spark, "/root/testdata/sf0.001").explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count("[^a-z0-9") == 1
    words = lambda *ws: value(spark, X.ngrams(F.array(*[F.lit(w) for w in ws])))
    assert words("ab", "c", "de", "fg") == ["ab", "de", "fg", "ab de", "de fg"] and words("ab") == ["ab"] and words("a") == []


def test_scores_are_dealt_once_in_parts_of_the_file(spark, capsys):
    from glean.plans import model_queries, score_queries
    from glean.sources.tables import parts_by_size, table

    lines = table(spark, "/root/testdata/sf0.01", "lineitem")
    assert parts_by_size(lines, 8) == 4 and parts_by_size(lines.unionAll(lines).unionAll(lines).unionAll(lines).unionAll(lines), 1) == 5
    for name, most in (("audit_ledger", 2), ("score_join_audit", 3)):  # the last one gathers the totals
        getattr(score_queries, name)(spark, "/root/testdata/sf0.001").explain()
        assert capsys.readouterr().out.count("Exchange hashpartitioning") <= most - 1, name
    model_queries.tfidf_weights(spark, "/root/testdata/sf0.001").explain()
    assert "Exchange hashpartitioning(term" not in capsys.readouterr().out
