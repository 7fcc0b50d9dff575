"""Collocations: against plain Python and SQL, with tiny rounds and a crowded sketch."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glean.llm import collocations, queries
from glean.llm.sketch import Filter, blocks_of, summed
from tests.compare import same
from tests.llm.fixtures import empty, messy_rows, SCHEMA


def brute(rows, least=30, share=80, most=2000):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            lang = r[2] or "und"
            n[lang] += len(ws)
            for m in range(1, 5):
                for i in range(len(ws) - m + 1):
                    f[lang][tuple(ws[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cands.items():
            score, k, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def rows():
    often = "New York City Hall stands, in  New York\tCity; the the the the end! ünder Ünder x\x0by\x0cz\rw"
    texts = [(often + " ") * 7, often.upper(), "und so weiter " * 40, "a b c d e. " * 33 + "b c d " * 10, ". , ;", "a b c \x1cd " * 31]
    more = [(2000 + i, t, (None, "en", "de")[i % 3], "s", None, "a", "b", "c", "d") for i, t in enumerate(texts * 6)]
    return messy_rows() + more + [more[0]] * 3


def plain(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("round_,most", [(3_000_000, 2000), (40, 3)])
def test_equals_brute_force(spark, monkeypatch, round_, most):
    monkeypatch.setattr(collocations, "ROUND", round_)
    df = spark.createDataFrame(rows(), SCHEMA).withColumns({"phrase": F.lit("mine"), "word": F.lit("mine"), "n": F.lit(1), "cell": F.lit(2)}).repartition(3)
    truth = brute(rows(), most=most)
    assert len(truth) > 20 or most < 10
    assert plain(collocations.top(collocations.mine(df), most)) == truth


def test_thresholds_are_parameters(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert plain(collocations.top(collocations.mine(df, least=50, share=95))) == brute(rows(), 50, 95)


def test_empty_and_rare(spark):
    assert collocations.top(collocations.mine(empty(spark))).count() == 0
    few = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    assert collocations.top(collocations.mine(few)).count() == 0


def test_equals_sql(spark):
    same(queries.QUERIES["op12_collocations"], queries.ORACLE_SQL["op12_collocations"], spark)


def test_sketch_bounds_from_above_and_filter_keeps_all(spark):
    def run(batches):
        yield from blocks_of((b.column(0).to_numpy().view(np.uint64) for b in batches), 18)

    values = [i % 977 * 1_000_003 for i in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(4)
    got = {r["cell"]: r["n"] for r in summed(df.mapInArrow(run, "block long, cells binary, times binary"), 21).collect()}
    truth = Counter(v % (1 << 18) for v in values)
    assert got == {c: n for c, n in truth.items() if n >= 21}
    kept = Filter.of(df.distinct(), "v")
    assert kept.has(np.array(sorted(set(values)), np.uint64)).all()
    assert kept.has(np.arange(1, 100_001, dtype=np.uint64) * np.uint64(7_777_777)).mean() < 0.01


def test_more_candidates_take_no_further_pass(spark, monkeypatch):
    """Tables written and jobs run are the same whatever the candidates an automaton holds; a crowded sketch changes no count."""
    made, write, tracker = [], collocations.written, spark.sparkContext.statusTracker()
    monkeypatch.setattr(collocations, "written", lambda df, name: made.append(name) or write(df, name))
    found = []
    for k, round_ in enumerate((3_000_000, 40)):
        monkeypatch.setattr(collocations, "ROUND", round_)
        spark.sparkContext.setJobGroup(f"op12-{k}", "")
        got = plain(collocations.top(collocations.mine(spark.createDataFrame(rows(), SCHEMA).repartition(3))))
        found.append((made[:], len(tracker.getJobIdsForGroup(f"op12-{k}")), got))
        made.clear()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1] and len(found[0][0]) == 3 and found[0][2] == brute(rows())
