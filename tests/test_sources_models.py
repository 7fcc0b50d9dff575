import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glean.operators import audit, models, scoring
from glean.plans import model_queries
from glean.sources import adapters, tables
from glean.streaming.windows import chunk_counts, read_stream


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "v1_transcript.csv").write_text("video_id,n,text\nv1,007,\n", encoding="utf-8-sig")
    (tmp_path / "v2_transcript.csv").write_text('video_id,n,text\nv2,x,"a, ""b"""\n', encoding="utf-8-sig")
    got = tables.read_strings(spark, f"{tmp_path}/v*_transcript.csv", ["video_id", "n", "text"]).orderBy("video_id").collect()
    assert [tuple(r) for r in got] == [("v1", "007", ""), ("v2", "x", 'a, "b"')]
    found = tables.lenient_numbers(tables.read_strings(spark, f"{tmp_path}/*.csv", ["video_id", "n", "text"]), n="int").orderBy("video_id")
    assert [r["n"] for r in found.collect()] == [7, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.strict_numbers(tables.read_strings(spark, f"{tmp_path}/*.csv", ["video_id", "n", "text"]), n="int").collect()


def test_files_per_key(spark, tmp_path):
    (tmp_path / "v1_t.csv").write_text("text\na\n")
    expected = spark.createDataFrame([("v1",), ("v9",)], "video_id string")
    found, missing = tables.read_per_key(spark, str(tmp_path), "_t.csv", "text string", "video_id", expected)
    assert [r["video_id"] for r in found.collect()] == ["v1"] and [r[0] for r in missing.collect()] == ["v9"]
    with pytest.raises(FileNotFoundError, match="v9"):
        tables.read_per_key(spark, str(tmp_path), "_t.csv", "text string", "video_id", expected, strict=True)


def test_contracts(spark, tmp_path):
    with pytest.raises(ValueError, match="lacks columns: b"):
        tables.require_columns(spark.range(1).withColumnRenamed("id", "a"), ["a", "b"])
    with pytest.raises(FileNotFoundError):
        tables.require_paths(spark, [str(tmp_path / "none")])


def test_lock_is_written_once(spark, tmp_path):
    first = tables.lock(spark, f"{tmp_path}/lock", {"b": 1, "a": 2})
    assert tables.lock(spark, f"{tmp_path}/lock", {"a": 2, "b": 1}) == first
    with pytest.raises(ValueError, match="another configuration"):
        tables.lock(spark, f"{tmp_path}/lock", {"a": 3})


def test_source_lines_and_context(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\nfit(x)\nfour\nfive\nsix")
    lines = tables.source_lines(spark, str(tmp_path / "*.txt"))
    assert lines.count() == 6 and len(lines.first()["sha256"]) == 64
    assert sorted(r["line_no"] for r in tables.line_hits(lines, {"fit": r"fit\("}, 1).collect()) == [2, 3, 4]


def test_best_source_and_reports(spark, tmp_path):
    for name, body in (("a", "x,y\n1,2\n"), ("b", "x,y,z\n1,2,3\n")):
        (tmp_path / f"{name}.csv").write_text(body)
    assert tables.best_source(spark, [f"{tmp_path}/{n}.csv" for n in "abc"], {}, ["x", "z"]).endswith("b.csv")
    tables.write_csv(spark.createDataFrame([(1, "q")], "n int, s string"), f"{tmp_path}/out", ["s"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").columns == ["s"]


def test_transcripts_land_once_and_failures_are_statuses(spark):
    def fetch(key, languages):
        if key == "bad":
            raise OSError("gone")
        return [(0.004, 1.5, "hello"), (2.0, 1.0, languages[0])] if key == "ok" else []

    videos = spark.createDataFrame([("v1", "ok"), ("v2", "bad"), ("v3", "none"), ("v4", "ok")], "video_id string, youtube_id string")
    landed = spark.createDataFrame([("v4",)], "video_id string")
    got = sorted((tuple(r) for r in adapters.fetch_transcripts(videos, fetch, landed=landed).collect()), key=str)
    assert got == [("v1", 0.0, 1.5, "hello", "success"), ("v1", 2.0, 3.0, "en", "success"), ("v2", None, None, None, "failed: gone"), ("v3", None, None, None, "empty")]


def test_frames_resume_and_are_recognised(spark, tmp_path):
    videos = spark.createDataFrame([("v1", 25.5)], "video_id string, duration_sec double")
    landed = spark.createDataFrame([("v1", 0, 9000), ("v1", 10, 100)], "video_id string, timestamp_sec int, n_bytes int")
    assert [r["timestamp_sec"] for r in adapters.capture_plan(videos, landed).orderBy("timestamp_sec").collect()] == [10, 20]
    box = spark.range(1).select(adapters.repair_section(F.lit(5), F.lit(12)).alias("s")).first()["s"]
    assert (box["start_sec"], box["end_sec"], box["offset_sec"]) == (0, 12, 5)
    for name, body in (("a", b"select  x"), ("b", b" "), ("c", b"\xff")):
        (tmp_path / f"{name}.png").write_bytes(body)
    got = adapters.recognise(adapters.read_images(spark, f"{tmp_path}/*.png"), lambda b: b.decode())
    told = {r["image_file"][-5]: (r["ocr_text"], r["ocr_word_count"], r["ocr_status"]) for r in got.collect()}
    assert told == {"a": ("select x", 2, "success"), "b": ("", 0, "empty"), "c": ("", 0, "failed")}
    again = adapters.recognise(adapters.read_images(spark, f"{tmp_path}/*.png"), lambda b: "read", got)
    assert [r["ocr_status"] for r in again.collect()] == ["success"]


def test_configurations_are_compared():
    assert audit.compare_configs({"a": 0.4, "b": 1, "c": "x"}, {"a": 0.4 + 1e-12, "b": 2, "d": 0}) == {"b": (1, 2), "c": ("x", None), "d": (None, 0)}


def test_boxes_stay_inside(spark):
    w, h = F.lit(100), F.lit(50)
    box = spark.range(1).select(tables.crop_box(w, h, 0.0, 0.995, 1.2, 0.0).alias("b")).first()["b"]
    assert (box["x0"], box["y0"], box["x1"], box["y1"]) == (99, 0, 100, 1)


DOCS = [(0, "select rows where id group by id"), (1, "select rows join table on id"), (2, "loop for while loop break"), (3, "while loop for range break"), (4, "select where group by rows")]


def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id int, text string").withColumn("terms", F.split("text", " "))


def test_tfidf_has_unit_length_and_smooth_idf(spark):
    got = models.tfidf(corpus(spark), "doc_id", "terms")
    for r in got.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect():
        assert r["n"] == pytest.approx(1)
    raw = {t: (2 if t == "id" else 1) * (math.log(6 / (1 + n)) + 1) for t, n in {"select": 3, "rows": 3, "where": 2, "id": 2, "group": 2, "by": 2}.items()}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    assert got.where("doc_id = 0 AND term = 'id'").first()["weight"] == pytest.approx(raw["id"] / norm)


@pytest.mark.parametrize("frequent,terms", [(1 << 18, 1 << 19), (3, 2), (1, 1)])
def test_tfidf_puts_rows_of_a_key_together_and_needs_no_window(spark, monkeypatch, frequent, terms):
    """Whether terms are broadcast or not; documents of one key, without a key, without terms and in pieces."""
    monkeypatch.setattr(models, "FREQUENT", frequent)
    monkeypatch.setattr(models, "TERMS", terms)
    rows = [(1, ["a", "b", "a"]), (2, ["a", "c"]), (1, ["b", "d"]), (None, ["a", "e e"]), (None, ["e e"]), (3, []), (4, None), (5, ["ü", "b", "a"])]
    docs = spark.createDataFrame(rows, "doc_id long, terms array<string>").repartition(3)

    def brute(known):
        tf = {}
        for key, found in rows:
            for t in found or []:
                if t in known:
                    tf[key, t] = tf.get((key, t), 0) + 1
        raw = {(k, t): n * (math.log((1 + 5) / (1 + sum(u == t for _, u in tf))) + 1) for (k, t), n in tf.items()}
        return {(k, t): w / math.sqrt(sum(x * x for (j, _), x in raw.items() if j == k)) for (k, t), w in raw.items()}

    for known, chosen in (({"a", "b", "c", "d", "e e", "ü"}, None), ({"b", "e e"}, spark.createDataFrame([("b",), ("e e",), ("z",)], "term string"))):
        got = models.tfidf(docs, "doc_id", "terms", chosen)
        assert "Window" not in got._jdf.queryExecution().toString()
        found = got.collect()
        assert len(found) == len(brute(known)) and {(r["doc_id"], r["term"]): r["weight"] for r in found} == pytest.approx(brute(known))


def test_topics_are_distributions(spark):
    docs = corpus(spark)
    words = [r["term"] for r in models.vocabulary(docs, "terms", 50).collect()]
    model = models.TopicModel.fit(docs, "terms", words, topics=2, iterations=5)
    for r in model.transform(docs, "terms").collect():
        assert sum(r["topics"]) == pytest.approx(1) and r["topics"][r["dominant_topic"]] == r["dominant_score"]
    assert model.distribution().sum(1) == pytest.approx([1, 1]) and all(len(t) == 12 for t in model.top_words(12))
    affinity = model.affinity([("loops", ["loop", "while"]), ("none", ["zzz"])])
    assert (affinity["none"] == 0).all() and (affinity["loops"] > 0).all()


def plain_topics(docs, words, start, iterations, close=1e-10):
    """Online variational Bayes over whole passes, one document after the other."""
    psi = np.vectorize(lambda x: (math.lgamma(x + 1e-5) - math.lgamma(x - 1e-5)) / 2e-5)
    k, lam, prior = len(start), start.copy(), np.full(len(start), 1 / len(start))
    counts = [np.array([d.count(w) for w in words]) for d in docs]
    counts = [c for c in counts if c.any()]
    for step in range(1, iterations + 1):
        beta, stats, logs = np.exp(psi(lam) - psi(lam.sum(1))[:, None]), np.zeros_like(lam), np.zeros(k)
        for c in counts:
            gamma, change = np.ones(k), 1.0
            while change > close:
                share = np.exp(psi(gamma))
                new = share * (beta @ (c / (share @ beta))) + prior
                gamma, change = new, np.abs(new - gamma).mean()
            share = np.exp(psi(gamma))
            stats += share[:, None] * beta * (c / (share @ beta))
            logs += (psi(gamma) - psi(gamma.sum())) / len(counts)
        rate = (1024 + step) ** -0.51
        lam = (1 - rate) * lam + rate * (stats + 1 / k)
        prime = lambda x: (psi(x + 1e-3) - psi(x - 1e-3)) / 2e-3
        slope, c, q = logs + psi(prior.sum()) - psi(prior), prime(prior.sum()), -prime(prior)
        prior = prior - rate * (slope - (slope / q).sum() / (1 / c + (1 / q).sum())) / q
    return lam, prior


def test_topics_take_every_document_once_a_pass(spark):
    docs, texts = corpus(spark).withColumn("fold", F.col("doc_id") % 2), [t.split(" ") for _, t in DOCS]
    words = [sorted({w for i, t in enumerate(texts) if i % 2 != k for w in t}) for k in range(2)]
    found = models.TopicModel.fit_folds(docs, "terms", "fold", words, topics=2, iterations=6)
    alone = models.TopicModel.fit(docs.where("fold <> 1"), "terms", words[1], topics=2, iterations=6)
    for k, model in [*enumerate(found), (1, alone)]:
        start = models._first_weights(spark, 2, len(words[k]), 42)
        lam, prior = plain_topics([t for i, t in enumerate(texts) if i % 2 != k], words[k], start, 6)
        assert model.words == words[k] and np.abs(model.weights - lam).max() < 0.01 and np.abs(model.prior - prior).max() < 0.001
        rate = [(1024 + s) ** -0.51 for s in range(1, 7)]
        whole = start.sum()
        for r in rate:  # the weights gain every occurrence of every pass
            whole = (1 - r) * whole + r * (sum(len(t) for i, t in enumerate(texts) if i % 2 != k) + len(words[k]))
        assert model.weights.sum() == pytest.approx(whole, rel=1e-6)


def test_topics_of_a_row_are_those_of_its_fold(spark):
    docs = corpus(spark).withColumn("fold", F.col("doc_id") % 2)
    docs = docs.unionByName(spark.createDataFrame([(9, "zzz", ["zzz"], 1), (10, None, None, 0)], docs.schema))
    words = [["select", "rows", "while"], ["loop", "while", "break", "rows"]]
    found = models.TopicModel.fit_folds(docs, "terms", "fold", words, topics=2, iterations=3)
    got = {r["doc_id"]: r["topics"] for r in models.topics_of(docs, "terms", found, "fold").collect()}
    assert len(got) == 7 and got[9] == got[10] == [0, 0]
    for k, model in enumerate(found):
        for r in model.transform(docs.where(F.col("fold") == k), "terms").collect():
            assert got[r["doc_id"]] == pytest.approx(r["topics"]) and r["dominant_score"] == max(r["topics"])


def test_vector_scores_meet_a_catalog_where_they_are(spark):
    made = np.random.default_rng(3).standard_normal((40, 3)).round(3).tolist()
    left = spark.createDataFrame([(i, i % 3 if i % 7 else None, [0.0] * 3 if i == 5 else v, v) for i, v in enumerate(made)], "id long, g int, x array<double>, t array<double>")
    right = spark.createDataFrame([(i, i % 2 if i else None, [0.0] * 3 if i == 3 else v, v[::-1]) for i, v in enumerate(made[:9])], "concept long, g int, y array<double>, s array<double>")
    figures = {"a": ("x", "y", True), "b": ("t", "s", False)}
    both = [scoring.vector_scores(left, ["id"], right, ["concept"], ["g"], figures, most) for most in (1000, 10)]
    assert ["Join" in df._jdf.queryExecution().toString() for df in both] == [False, True]
    near, joined = ({(r["id"], r["concept"]): (r["a"], r["b"]) for r in df.collect()} for df in both)
    assert len(near) == 92 and near.keys() == joined.keys() and all(near[k] == pytest.approx(joined[k]) for k in near)


def test_latent_space_separates_subjects(spark):
    docs = corpus(spark)
    words = [r["term"] for r in models.vocabulary(docs, "terms", 50).collect()]
    space = models.LatentSpace.fit(docs, "terms", words, 3)
    x = {r["doc_id"]: r["latent"] for r in space.transform(docs, "terms").collect()}
    cos = lambda a, b: sum(p * q for p, q in zip(x[a], x[b])) / math.sqrt(sum(p * p for p in x[a]) * sum(q * q for q in x[b]))
    assert cos(2, 3) > 0.9 > cos(0, 2) and cos(0, 4) > cos(0, 3)
    with pytest.raises(ValueError):
        models.LatentSpace.fit(docs.limit(1), "terms", words, 3)


def test_latent_space_takes_five_thousand_terms(spark):
    docs = spark.createDataFrame([(k, [f"w{k * 1250 + i}" for i in range(1250)]) for k in range(4)], "doc_id int, terms array<string>")
    space = models.LatentSpace.fit(docs, "terms", [f"w{i}" for i in range(5000)], 3)
    assert space.components.shape == (5000, 3)


def test_affinity_table_equals_affinity(spark):
    docs = corpus(spark)
    words = [r["term"] for r in models.vocabulary(docs, "terms", 50).collect()]
    model = models.TopicModel.fit(docs, "terms", words, topics=2, iterations=5)
    told = [("loops", ["loop", "while", "loop", "zzz"]), ("none", ["zzz"]), ("empty", [])]
    got = model.affinity_table(spark.createDataFrame(told, "concept string, terms array<string>"), ["concept"], "terms").collect()
    want = model.affinity(told)
    assert len(got) == 3
    for r in got:
        assert r["affinity"] == pytest.approx(list(want[r["concept"]]))


def test_terms_of_concepts_alone_count_and_folds_have_both_scores(spark, tmp_path):
    turns = [(k, t, "u", f"select rows table{t} loop{k % 4}") for k in range(20) for t in range(3)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(k, f"unheard{k} select loop{k}") for k in range(4)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, concepts = model_queries._corpus(spark, str(tmp_path))
    assert {f"unheard{k}" for k in range(4)} <= set(model_queries._latent(docs, concepts).words)
    held_out = docs.where("subject = 3")
    seen = model_queries._topics(docs.where("subject <> 3")).words
    assert held_out.count() == 15 and "loop3" not in seen and "loop2" in seen
    got = model_queries.cv_oof_scores(spark, str(tmp_path))
    assert got.count() == 60 and {r["fold"] for r in got.select("fold").distinct().collect()} == {0, 1, 2, 3, 4} and got.where("lda_score > 0 AND lsa_score > 0").count() > 0


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{k % 5}:{k % 60:02d}", "click" if k % 2 else "view", float(k)) for k in range(40)]
    events = spark.createDataFrame(rows, "at string, event_type string, value double").select(F.to_timestamp("at").alias("ts"), "event_type", "value")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = chunk_counts(read_stream(spark, f"{tmp_path}/in", events))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    ours = {tuple(r) for r in spark.table("counts").collect()}
    assert ours == {tuple(r) for r in chunk_counts(events).collect()}


def test_inference_of_slow_documents_takes_few_updates(spark, monkeypatch):
    """Topics that differ little: updates alone creep; leaps end at the same topics, and go on by updates if they run out."""
    made, calls, plain = np.random.default_rng(5), [0], models._exp_digamma
    beta = np.hstack([made.gamma(100, 0.01, (6, 40)) / 40, np.zeros((6, 1))])
    n = made.integers(1, 30, 50)
    at = np.concatenate([np.sort(made.choice(40, x, replace=False)) for x in n])
    (docs, word, count), = models._side_by_side(n, at, np.ones(len(at), int), 40)
    monkeypatch.setattr(models, "_exp_digamma", lambda x: calls.__setitem__(0, calls[0] + 1) or plain(x))
    found, part = models._inferred(word, count, beta, np.full(6, 1 / 6))
    assert calls[0] < 60 and found.sum(0) == pytest.approx(n[docs] + 1)
    assert np.einsum("kwd,kwd->d", part, beta.take(word, axis=1)) == pytest.approx(n[docs])
    monkeypatch.setattr(models, "CLOSE", 1e-9)
    exact = models._inferred(word, count, beta, np.full(6, 1 / 6))[0]
    monkeypatch.setattr(models, "LEAPS", 0)
    assert models._inferred(word, count, beta, np.full(6, 1 / 6))[0] == pytest.approx(exact, abs=1e-4)


def test_latent_space_is_the_same_whatever_is_dense(spark, monkeypatch):
    docs = corpus(spark)
    words = [r["term"] for r in models.vocabulary(docs, "terms", 50).collect()]
    found = []
    for dense in (0, 4, 768):
        monkeypatch.setattr(models, "DENSE", dense)
        c = models.LatentSpace.fit(docs, "terms", words, 3).components
        found.append(c @ c.T)
    assert np.abs(found[1] - found[0]).max() < 1e-9 and np.abs(found[2] - found[0]).max() < 1e-9
