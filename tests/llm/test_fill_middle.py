"""Fill-in-middle: against plain Python, over chunks of every size, and automata other than lines."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glean.llm import fill_middle, queries
from glean.llm.automaton import LINES, Automaton, Scan, compose
from tests.compare import same
from tests.llm.fixtures import SCHEMA, empty, messy_rows

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = LINE.findall(text)
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    texts = ["\n", "\n\n\n", "a\nb\nc", "a\nb\nc\n", "x<P>y\nz", "<<P", "ends with <\n<\n<", "é\n日本\n😀😀\nend", "\n".join(f"line {i} ü" for i in range(5000)), "no line feed " * 4000, "\n" * 40_000, "\r\n\r\n"]
    more = [(1000 + i, t, "en", "s", None, "a", "b", "c", "d") for i, t in enumerate(texts)]
    twice = [(1008, texts[8], "en", "s", None, "a", "b", "c", "d"), (1008, "same id\nanother text\n" * 900, "en", "s", None, "a", "b", "c", "d"), (None, texts[8] + "null id", "en", "s", None, "a", "b", "c", "d")]
    return messy_rows() + more + twice


@pytest.mark.parametrize("chunk", [1, 7, 64, 1000, 1 << 15])
def test_equals_brute_force_at_every_chunk_size(spark, chunk):
    data = rows() if chunk >= 1000 else [r for r in rows() if len(r[1] or "") < 700]
    df = spark.createDataFrame(data, SCHEMA).withColumns({"raw": F.col("text"), "n": F.lit(-1), "c1": F.lit("mine"), "doc": F.lit(0), "whole": F.lit(1), "at": F.lit(2)}).repartition(3)
    made = fill_middle.transform(df, chunk=chunk)
    got = made.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(data)
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], r["raw"]), r["doc_id"]
        assert r["back"] == (r["raw"] or "")
        assert (r["c1"], r["doc"], r["whole"], r["at"]) == ("mine", 0, 1, 2)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_rate_and_share(spark):
    df = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(200)], "doc_id long, text string")
    for rate, spm in ((0, 50), (40, 0), (60, 100)):
        got = fill_middle.transform(df, rate=rate, spm=spm).collect()
        for r in got:
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], "a\nb\nc\n", rate, spm)


def test_empty_table(spark):
    assert fill_middle.transform(empty(spark)).count() == 0


def test_equals_sql(spark):
    same(queries.QUERIES["op11_fill_middle"], queries.ORACLE_SQL["op11_fill_middle"], spark)


def quoted():
    """Records that end at a line feed outside double quotes: states before, in, in quotes."""
    step, begins = np.ones((3, 256), np.uint8), np.zeros((3, 256), np.uint8)
    step[2] = 2
    step[:2, ord("\n")] = 0
    step[:2, ord('"')] = 2
    step[2, ord('"')] = 1
    begins[0] = 1
    return Automaton(step, begins)


@pytest.mark.parametrize("automaton", [LINES, quoted()])
def test_summaries_compose_to_the_sequential_scan(automaton):
    rng = np.random.default_rng(5)
    data = rng.choice(np.frombuffer(b'ab"\n', np.uint8), 3000)
    state, begun, at = 0, 0, []
    for i, x in enumerate(data):
        if automaton.begins[state, x]:
            at.append(i)
        state = int(automaton.step[state, x])
    edges = np.r_[0, np.sort(rng.choice(np.arange(1, 3000), 12, replace=False)), 3000]
    starts, lengths = edges[:-1], np.diff(edges)
    scan = Scan.of(automaton, data, starts, lengths)
    states, before, n = compose(*scan.summaries())
    assert n == len(at)
    unit = np.arange(n)
    chunk = np.searchsorted(before, unit, "right") - 1
    assert (starts[chunk] + scan.find(states, chunk, unit - before[chunk]) == at).all()
