"""Whole learned operators against plain Python: language scoring and Viterbi, noisy-or and its gradient, ridge and calibration."""

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glean.llm import language_id, quality_classifier, toxicity
from glean.llm.text import mix
from tests.llm.fixtures import messy, messy_rows, prose, words

MASK = (1 << 64) - 1


def letters(word):
    return "".join(c for c in word.lower() if unicodedata.category(c)[0] in "LM")


def features(word):
    """The hashed n-grams of a word between its edges, by the definition; none without letters."""
    points = [0, *map(ord, letters(word)), 0]
    if len(points) == 2:
        return []
    scatter = lambda p: int(mix(np.array([p + 1], np.uint64))[0])
    out = []
    for n in language_id.ORDERS:
        for i in range(len(points) - n + 1):
            part = points[i : i + n]
            if 0 in part[1:-1] or (part[0] == 0 and part[-1] == 0):
                continue
            value = n
            for p in part:
                value = (value * 0x9E3779B97F4A7C15 + scatter(p)) & MASK
            out.append(int(mix(np.array([value], np.uint64))[0]) & (language_id.FEATURES - 1))
    return out


def script(word):
    if not any(unicodedata.category(c)[0] == "L" for c in word):
        return None
    first = ord(letters(word)[0])
    return next((name for a, b, name in language_id.SCRIPT_RANGES if a <= first < b), "Other")


def language_brute(train, texts):
    """[(lang_pred, score, spans)] of texts, learned from (text, lang) pairs."""
    langs = sorted({l for _, l in train})
    grams, used = {l: Counter() for l in langs}, {l: Counter() for l in langs}
    for text, l in train:
        for w in text.split():
            grams[l].update(features(w))
            if script(w):
                used[l][script(w)] += 1
    total = {l: sum(grams[l].values()) + 0.5 * language_id.FEATURES for l in langs}
    allowed = {l: {s for s, n in used[l].items() if n > language_id.RARE_SCRIPT * max(sum(used[l].values()), 1)} for l in langs}
    out = []
    for text in texts:
        ws, table = text.split(), []
        for w in ws:
            f, s = features(w), script(w)
            if s is None:
                table.append([0.0] * len(langs))
                continue
            raw = [language_id.SHARPNESS * sum(math.log((grams[l][x] + 0.5) / total[l]) for x in f) / max(len(f), 1) for l in langs]
            open_ = [s in allowed[l] for l in langs]
            raw = [r if o or not any(open_) else -math.inf for r, o in zip(raw, open_)]
            table.append([max(r - max(raw), language_id.FLOOR) for r in raw])
        value, back = [0.0] * len(langs), []
        for t, row in enumerate(table):
            best = max(range(len(langs)), key=lambda k: value[k])
            step = [best if t and value[best] - language_id.SWITCH > value[k] else k for k in range(len(langs))]
            back.append(step)
            value = [(value[s] - language_id.SWITCH * (s != k) if t else value[k]) + row[k] for k, s in enumerate(step)]
        state, label = max(range(len(langs)), key=lambda k: value[k]) if ws else 0, []
        for step in reversed(back):
            label.append(state)
            state = step[state]
        label.reverse()
        votes = Counter(langs[k] for w, k in zip(ws, label) if script(w))
        pred = max(langs, key=lambda l: votes[l]) if votes else "und"
        spans = []
        for i, k in enumerate(label):
            if spans and spans[-1][2] == langs[k]:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1, langs[k]])
        out.append((pred, max(votes.values()) / sum(votes.values()) if votes else 0.0, spans))
    return out


def test_language_of_whole_texts_equals_plain_python(spark):
    rng = random.Random(12)
    train = [(prose(rng, 60, lang=l), l) for _ in range(12) for l in ("en", "fr", "de")] + [("привет мир это текст на русском языке " * 5, "ru")]
    texts = [prose(rng, 50, lang=l) for l in ("en", "fr", "de")]
    texts += [prose(rng, 30, lang="fr") + " " + prose(rng, 20, lang="de") + " текст мир", "12 34 -- 5", "", "мир world это", "x " * 300, prose(rng, 400, lang="en") + " " + prose(rng, 400, lang="fr"), texts[0], texts[0]]
    model = language_id.train(spark.createDataFrame([(t, l) for t, l in train], "text string, lang string").repartition(4))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    for k, (pred, score, spans) in enumerate(language_brute(train, texts)):
        assert (got[k]["lang_pred"], [list(s) for s in got[k]["spans"]]) == (pred, spans), texts[k][:60]
        assert got[k]["score"] == pytest.approx(score)


def sentences_of(text):
    """Words of each sentence: a line ends one, and so does a closing mark."""
    out = []
    for line in (text or "").split("\n"):
        now = []
        for w in (x.decode() for x in words(line)):
            now.append(w)
            if re.search(toxicity.STOP, w):
                out.append(now)
                now = []
        if now:
            out.append(now)
    return out


def noisy_or(text, weight, bias):
    """1 - product over sentences of 1 - sigmoid(bias + the weights of the sentence's distinct known words)."""
    clean = 1.0
    for s in sentences_of(text) or [[]]:
        z = bias + sum(weight(x) for x in {letters(w) for w in s if letters(w)})
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def toxic_corpus(rng, n=120):
    docs = []
    for i in range(n):
        parts = [prose(rng, rng.randint(3, 9)) + rng.choice([".", "!", "\n"]) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), "you nitwit dolt.")
        docs.append((i, " ".join(parts), int(i % 3 == 0)))
    return docs


def test_toxicity_scores_equal_plain_noisy_or(spark):
    rng = random.Random(3)
    docs = toxic_corpus(rng)
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([(d[0], d[2]) for d in docs], "doc_id long, toxic int"))
    at = {int(b): float(w) for b, w in zip(model.buckets, model.weights)}

    def weight(word):
        bucket = int(toxicity.hash_strings(pa.array([word]))[0] & np.uint64(toxicity.BUCKETS - 1))
        return at.get(bucket, 0.0)

    odd = spark.createDataFrame([(1000 + i, r[1]) for i, r in enumerate(messy_rows())], "doc_id long, text string")
    texts = {d[0]: d[1] for d in docs} | {1000 + i: r[1] for i, r in enumerate(messy_rows())}
    for r in toxicity.score(df.unionByName(odd), model).collect():
        assert r["score"] == pytest.approx(noisy_or(texts[r["doc_id"]], weight, model.bias), abs=1e-9), r["doc_id"]


def test_toxicity_gradient_equals_finite_differences():
    rng = np.random.default_rng(5)
    k, examples = 6, []
    for d in range(20):
        inner = [sorted(set(rng.integers(0, k, rng.integers(1, 4)).tolist())) for _ in range(rng.integers(0, 4))]
        examples.append((int(d % 3 == 0), int(rng.integers(0 if inner else 1, 3)), inner))
    weights = rng.normal(size=k + 1)

    def likelihood(w):
        total = 0.0
        for y, blank, inner in examples:
            clean = sum(-math.log1p(math.exp(w[-1] + sum(w[f] for f in s))) for s in inner) - blank * math.log1p(math.exp(w[-1]))
            total += math.log(-math.expm1(clean)) if y else clean
        return total

    batch = pa.RecordBatch.from_pydict({
        "y": pa.array([e[0] for e in examples], pa.int32()), "blank": pa.array([e[1] for e in examples], pa.int64()),
        "sentence": pa.array([[i for i, s in enumerate(e[2]) for _ in s] for e in examples], pa.list_(pa.int32())), "feature": pa.array([[f for s in e[2] for f in s] for e in examples], pa.list_(pa.int32())),
    })
    got = np.sum([np.array(b.column("g")[0].as_py()) for b in toxicity._gradient(weights)(iter([batch]))], axis=0)
    step = 1e-6 * np.eye(k + 1)
    assert got == pytest.approx(np.array([(likelihood(weights + s) - likelihood(weights - s)) / 2e-6 for s in step]), abs=1e-5)


def test_toxicity_keeps_the_words_that_tell_most(spark):
    """The kept words are those of the largest G statistic, and ties do not change the score's range."""
    rng = random.Random(8)
    docs = toxic_corpus(rng, 90)
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([(d[0], d[2]) for d in docs], "doc_id long, toxic int"))
    bucket = lambda w: int(toxicity.hash_strings(pa.array([w]))[0] & np.uint64(toxicity.BUCKETS - 1))
    by_weight = sorted(zip(model.weights, model.buckets), reverse=True)
    assert {bucket("nitwit"), bucket("dolt"), bucket("you")} == {int(b) for _, b in by_weight[:3]}


def test_quality_fit_equals_a_direct_solve(spark):
    docs = [(i, prose(random.Random(i), 40 + 3 * i) if i % 2 else "\n".join(["buy $ now # | click"] * (3 + i % 7)), i % 2) for i in range(160)]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(d[0], d[2]) for d in docs], "doc_id long, quality int")
    measured = quality_classifier.measure(df)
    model = quality_classifier.fit(measured, labels)
    rows = measured.selectExpr("key", "x", "pmod(xxhash64(key), 4) = 0 AS aside").collect()
    x, aside = np.array([r["x"] for r in rows]), np.array([r["aside"] for r in rows])
    y = np.array([docs[r["key"]][2] for r in rows], float)
    assert model.mean == pytest.approx(x.mean(0)) and model.scale == pytest.approx(np.maximum(x.std(0), 1e-9))
    z = quality_classifier.fourier(np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-9), -8, 8))
    ridge = quality_classifier.RIDGE * np.diag(np.append(np.ones(quality_classifier.WIDTH), 1e-9))
    fitted = z[~aside]
    assert model.weights == pytest.approx(np.linalg.solve(fitted.T @ fitted + ridge, fitted.T @ y[~aside]), abs=1e-8)
    # the calibration rises, and scores are its interpolation at the raw values
    assert (np.diff(model.levels) >= 0).all() and (np.diff(model.edges) > 0).all()
    raw = z @ model.weights
    got = {r["key"]: r["score"] for r in quality_classifier.score(measured, model).collect()}
    assert [got[r["key"]] for r in rows] == pytest.approx(np.clip(np.interp(raw, model.edges, model.levels), 0, 1), abs=1e-9)
    bins = np.minimum(((np.clip(raw[aside], -0.5, 1.5) + 0.5) / 2 * quality_classifier.BINS).astype(int), quality_classifier.BINS - 1)
    each = [(b, (bins == b).sum(), y[aside][bins == b].mean()) for b in np.unique(bins)]
    assert model.levels == pytest.approx(quality_classifier.isotonic(np.array([v for *_, v in each]), np.array([n for _, n, _ in each], float)))


def test_equal_raw_values_get_equal_scores(spark):
    measured = quality_classifier.measure(messy(spark))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality_classifier.fit(measured, labels)
    same = spark.createDataFrame([(i, "one text that repeats") for i in range(20)], "doc_id long, text string")
    assert len({r["score"] for r in quality_classifier.score(quality_classifier.measure(same), model).collect()}) == 1
