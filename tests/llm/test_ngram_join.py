"""N-gram Jaccard join: the search against counting, components against all pairs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glean.llm import linking, ngram_join, overlap_search
from glean.llm.overlap_search import Index
from glean.llm.queries import QUERIES
from tests.compare import DATA, duck
from tests.llm.fixtures import SCHEMA, empty, messy_rows, shingles


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows):
    """[(doc, size, component)] in the order of ``rows``."""
    sets = [shingles(lowered(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in g if d is not None), default=None) for k, g in groups.items()}
    return [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def plain(df):
    return sorted(((r["doc"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def crowd(n=120, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        made = [f"w{i}" for i in range(200)]
        for place in rng.choice(200, 1 + k % 6, replace=False):
            made[place] = f"edit{k}at{place}"
        rows.append((k, " ".join(made)))
    # a passage that unlike texts share, and a chain of which only neighbours link
    passage = " ".join(f"shared{i}" for i in range(60))
    rows += [(500 + k, passage + " " + " ".join(f"own{k}x{i}" for i in range(25 + k))) for k in range(60)]
    base = [f"c{i}" for i in range(400)]
    return rows + [(800 + k, " ".join(base[k * 12 : 250 + k * 12])) for k in range(12)]


@pytest.mark.parametrize("block", [8, 1024])
def test_components_equal_all_pairs(spark, block):
    rows = crowd()
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=block)
    assert plain(got) == sorted(brute(rows), key=repr)


def test_awkward_rows(spark):
    more = [(3000, messy_rows()[3][1].upper()), (3001, "One TWO"), (3002, "one\ntwo"), (3003, "a b c d e"), (3004, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (3004, None)]
    rows = messy_rows() + [(d, t, None, None, None, "a", "b", "c", "d") for d, t in more]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("doc", "c1", "s1", "node", "group", "keys", "label")}).repartition(3)
    assert plain(ngram_join.components(df)) == sorted(brute([(r[0], r[1]) for r in rows]), key=repr)
    assert ngram_join.components(empty(spark)).count() == 0


def test_query_equals_all_pairs(spark):
    got = QUERIES["op13_ngram_join"](spark, DATA)
    rows = [tuple(r) for r in duck("SELECT doc_id, text FROM documents").itertuples(index=False)]
    assert plain(got.withColumnRenamed("doc_id", "doc")) == sorted(brute(rows), key=repr)


def random_sets(rng, n=150):
    """Sets around a few bases, with very common and very rare elements, and some of any size."""
    bases = [rng.choice(5000, rng.integers(1, 120), replace=False) for _ in range(6)]
    out = []
    for _ in range(n):
        base = bases[rng.integers(6)]
        kept = base[rng.random(len(base)) < rng.choice([0.75, 0.9, 1.0])]
        out.append(np.unique(np.r_[kept, rng.choice(9000, rng.integers(0, 1 + len(base) // 6), replace=False)]).astype(np.int64))
    return [x if len(x) else np.array([7]) for x in out]


@pytest.mark.parametrize("heap,probe,skip", [(10**9, 8, 0.01), (0, 8, 0.01), (10**9, 0, 0.01), (10**9, 0, 1.0), (0, 0, 0.0001), (2000, 10**9, 0.01)])
@pytest.mark.parametrize("percent", [50, 80, 100])
def test_search_equals_counting(monkeypatch, heap, probe, skip, percent):
    for name, x in (("HEAP", heap), ("PROBE", probe), ("SKIP", skip)):
        monkeypatch.setattr(overlap_search, name, x)
    rng = np.random.default_rng(percent)
    sets = random_sets(rng)
    index = Index(np.concatenate(sets), np.array([len(x) for x in sets]))
    hits = 0
    for q in random_sets(rng, 40) + sets[:40] + [np.zeros(0, np.int64)]:
        at, same = index.search(q, percent)
        truth = {i: len(np.intersect1d(q, x)) for i, x in enumerate(sets)}
        truth = {i: s for i, s in truth.items() if len(q) and 100 * s >= percent * (len(q) + len(sets[i]) - s)}
        assert dict(zip(at.tolist(), same.tolist())) == truth
        hits += len(truth)
    assert hits >= 40


def test_merge_skips_but_misses_nothing():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lists = [sorted(rng.choice(60, rng.integers(0, 30), replace=False).tolist()) for _ in range(rng.integers(1, 9))]
        least = int(rng.integers(1, 6))
        count = np.bincount(np.array([v for x in lists for v in x], np.int64), minlength=60)
        assert list(overlap_search._skipping(lists, least)) == [(v, c) for v, c in enumerate(count.tolist()) if c >= least]


def test_links_come_back_as_a_forest(spark, monkeypatch):
    """A crowd just below the similarity: each node asks each block once, and only spanning links return."""
    seen, inner = [], linking.rest

    def counting(now, *more):
        seen.append((now.select("node").distinct().count(), inner(now, *more).count()))
        return inner(now, *more)

    monkeypatch.setattr(linking, "rest", counting)
    rows = crowd(60)
    ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), block=16).count()
    assert seen[0][1] <= 4 * seen[0][0]
