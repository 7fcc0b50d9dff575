"""Operators with one right answer, against plain Python, the library or SQL."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glean.llm import bpe, linking, minhash, mixing, quality_rules, queries, substring_dedup, tokenfile
from glean.llm.shared import new_path
from glean.llm.text import split_words
from tests.compare import same
from tests.llm.fixtures import empty, messy, messy_rows, near_classes_brute, substring_brute, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - {"op11_fill_middle", "op12_collocations"}))
def test_equals_sql(name, spark):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name], spark)


def test_words_split_at_ascii_white_space_only():
    texts = [None, "", "  a\tb\x0bc\x0cd\re\nf ", "no break  x", "\x1cq r\x1f"]
    found = split_words(pa.array(texts))
    for i, t in enumerate(texts):
        got = [found.vocab[int(c)].as_py() for c in found.codes[found.starts[i] : found.starts[i + 1]]]
        assert [g.encode() for g in got] == words(t)


@pytest.mark.parametrize("broadcast,hot", [(10**6, 10**6), (0, 3), (10**6, 1)])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, broadcast, hot):
    monkeypatch.setattr(substring_dedup, "BROADCAST", broadcast)
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    truth = substring_brute(messy_rows())
    got = substring_dedup.dedup(messy(spark).withColumn("raw", F.col("text"))).collect()
    assert len(got) == len(messy_rows())
    for r in got:
        total, kept = truth[r["doc_id"], r["raw"]]
        assert (r["n_words"], r["n_removed"]) == (total, total - len(kept)), r["doc_id"]
        assert r["kept_sha256"] == hashlib.sha256(b" ".join(kept)).hexdigest()
        assert r["text"] == (r["raw"] if total == len(kept) else b" ".join(kept).decode())
    assert sum(r["n_removed"] > 0 for r in got) >= 8


@pytest.mark.parametrize("block", [2, 256])
def test_near_duplicates_equal_brute_force(spark, block):
    truth = near_classes_brute(messy_rows())
    got = minhash.near_duplicates(messy(spark), block=block)
    keyed = minhash._keyed(messy(spark).dropDuplicates(), "doc_id", "text")
    joined = got.dropDuplicates().join(keyed.withColumnsRenamed({"doc": "d", "c1": "x", "c2": "y"}), got.doc.eqNullSafe(F.col("d")) & got.c1.eqNullSafe(F.col("x")) & got.c2.eqNullSafe(F.col("y")))
    rows = joined.collect()
    assert got.count() == len(messy_rows()) and len(rows) == len(truth)
    for r in rows:
        assert r["class_id"] == truth[r["doc"], r["text"]], r["doc"]
    stays = {r["class_id"]: r["doc"] for r in rows if r["first"] and words(r["text"])}
    assert all(k == v for k, v in stays.items()) and len(stays) == len({r["class_id"] for r in rows if words(r["text"])})


def test_long_chains_and_large_groups(spark):
    """A chain of texts, each near to the next only, is one class; so is a group of copies around one text."""
    base = [f"w{i}" for i in range(400)]
    chain = [" ".join(base[k * 12 : 250 + k * 12]) for k in range(12)]
    star = [" ".join(f"z{i}" if i != 7 * k % 300 else f"edit{k}" for i in range(300)) for k in range(60)]
    df = spark.createDataFrame([*((k, t) for k, t in enumerate(chain)), *((100 + k, t) for k, t in enumerate(star))], "doc_id long, text string")
    got = {r["doc"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    assert {got[k] for k in range(12)} == {0} and {got[100 + k] for k in range(60)} == {100}


@pytest.mark.parametrize("block", [64])
def test_crowd_around_the_similarity(spark, monkeypatch, block):
    """Copies just above and just below the similarity: classes as by brute force, and blocks that return no pairs."""
    rng = np.random.default_rng(11)
    texts = []
    for k in range(250):
        made = [f"w{i}" for i in range(300)]
        for place in rng.choice(300, 3 + k % 2 * 2, replace=False):
            made[place] = f"edit{k}at{place}"
        texts.append(" ".join(made))
    rows, seen, inner = list(enumerate(texts)), [], linking.rest

    def counting(now, *more):
        seen.append((now.select("node").distinct().count(), inner(now, *more).count()))
        return inner(now, *more)

    monkeypatch.setattr(linking, "rest", counting)
    got = {r["doc"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert got == {d: c for (d, _), c in near_classes_brute(rows).items()}
    assert seen[0][1] <= 4 * seen[0][0]  # a forest from each of four blocks


def test_counted_shingles(spark):
    """With counts as weights, texts that repeat a passage unequally often are apart."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"{passage} {passage} {passage}"), (2, passage + " " + passage), (3, f"{passage} {passage} {passage} end")]
    got = {r["doc"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), weights="count").collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_weighted_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    x, y = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    row = np.repeat([0, 1, 2], 300)
    found = minhash.signatures(row, np.tile(elements, 3), np.r_[x, y, x], 3, k=2048)
    truth = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((found[0] == found[1]).mean() - truth) < 4 * np.sqrt(truth * (1 - truth) / 2048)
    assert (found[0] == found[2]).all()


def test_encoding_equals_the_library(spark, library):
    df = bpe.encode(messy(spark), PATH, back="decoded")
    assert df.columns.count("ids") == 1
    back = {(r["doc_id"], r["text"]): r["d2"] for r in bpe.decode(df, PATH, out="d2").collect()}
    for r in df.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == (r["text"] or "") == back[r["doc_id"], r["text"]]


@pytest.mark.parametrize("text", ["it's  we'll\n\n don't", "\x1c \x85 q  r ", "<|endoftext|><|endoftext|> <|endoftext|>", "é" * 300, "ab" * 500 + " ab", " 　x    y", "áb ﷺ 🏳️‍🌈 1234567890 !!!???"])
def test_encoding_of_odd_texts(text, library):
    coder = bpe.ByteBPE(open(PATH, "rb").read())
    units = bpe.Units(coder.encode, np.array([t[:1] == b" " for t in coder.token_bytes]))
    truth = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode([text])[0], "<i4").tolist() == truth
    ids, counts = units.ids(pa.array([text, None, text]))
    assert ids.tolist() == truth * 2 and counts.tolist() == [len(truth), 0, len(truth)]


def test_workers_remember_short_units_only(library):
    coder = bpe.ByteBPE(open(PATH, "rb").read())
    units = bpe.Units(coder.encode, np.array([t[:1] == b" " for t in coder.token_bytes]), 40)
    texts = ["日本" * 500, "short one", "日本" * 500 + " tail", *(f"t{i} u{i}" for i in range(60))]
    truth = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        ids, counts = units.ids(pa.array(texts))
        assert ids.tolist() == [i for ids in truth for i in ids] and counts.tolist() == [*map(len, truth)]
    assert max(map(len, [*units.heads, *units.known])) <= bpe.SCAN_LIMIT and len(units.known) <= 40


def test_scan_and_heap_merge_alike():
    coder = bpe.ByteBPE(open(PATH, "rb").read())
    for word in (b" understanding", b"aaaaaaaaaaaaaaaaaaaaaaaaa", "éèê".encode() * 5, b"-----=====-----"):
        assert np.frombuffer(coder.merge([word])[0], "<i4").tolist() == coder._merge_long(word)


def test_token_file_round_trip(spark, library, monkeypatch):
    df = messy(spark)
    path = new_path(spark, "test-tokens")
    tokenfile.write_blocks(tokenfile.tokenize(df, PATH, 2), path, block_ids=500)
    got = tokenfile.read_blocks(spark, path, with_ids=True).orderBy("start").collect()
    truth = sorted(([r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]] for r in messy_rows()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in got] == [t[0] for t in truth]
    assert sorted(map(str, (r["ids"] for r in got))) == sorted(map(str, (t[1] for t in truth)))
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]


def test_code_lengths_are_limited_and_complete():
    counts = {i: 2**min(i, 60) for i in range(40)}
    bits = tokenfile.code_lengths(counts, 12)
    assert max(bits.values()) <= 12 and sum(2.0**-b for b in bits.values()) <= 1
    assert all(bits[a] >= bits[b] for a in counts for b in counts if counts[a] < counts[b])
    assert tokenfile.code_lengths({5: 3}) == {5: 1} and tokenfile.code_lengths({}) == {}
    plain = tokenfile.code_lengths({0: 1, 1: 1, 2: 2, 3: 4})
    assert plain == {0: 3, 1: 3, 2: 2, 3: 1}


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10, 1.0), ("b", 100, 1.0), ("c", 90, 2.0), (None, 0, 1.0)], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.water_fill(sizes).collect()}
    assert got == {"a": 30.0, "b": pytest.approx(170 / 3, abs=1e-5), "c": pytest.approx(340 / 3, abs=1e-5), None: 0.0}
    full = {r["source"]: r["target"] for r in mixing.water_fill(sizes, budget_share=9.0).collect()}
    assert full == {"a": 30.0, "b": 300.0, "c": 270.0, None: 0.0}


def test_mixing_hits_targets(spark):
    df = messy(spark, 200)
    got = mixing.mix(df).cache()
    assert got.count() == df.count() and got.columns.count("size") == 1
    largest = {r["source"]: r["m"] for r in got.groupBy("source").agg(F.max("size").alias("m")).collect()}
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"), F.first("source_size").alias("told")).collect():
        assert r["size"] == r["told"] and abs(r["taken"] - r["target"]) <= 3 * largest[r["source"]] / 2
    assert got.where("taken > 3 * size").count() == 0
    again = mixing.mix(messy(spark, 200).repartition(7))
    assert got.select("doc_id", "taken").exceptAll(again.select("doc_id", "taken")).count() == 0


def test_quality_rules_by_line(spark):
    good = "This is a plain sentence of prose that goes on for a while. " * 6
    nav = "Home | About | News | Contact | Login | Shop"
    texts = {1: good + "\n" + nav, 2: "\n".join([nav] * 12), 3: good.upper(), 4: None, 5: "#% $$ && " * 60, 6: "word " * 100}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, kept string")
    got = {r["doc_id"]: r for r in quality_rules.clean(df).collect()}
    assert got[1]["n_lost_words"] == 11 and got[1]["clean_text"] == good
    assert not any(got[k]["kept"] for k in (2, 3, 4, 5, 6)) and got[4]["clean_text"] == "" and got[6]["base_failed"]


def test_phrases_of_furniture_in_prose(spark):
    """A long line that mentions a phrase stays, and so does one that holds it inside words; a short line of furniture goes."""
    rng = np.random.default_rng(2)
    prose = " ".join(f"word{i}" for i in rng.permutation(80)) + "."
    texts = {1: prose + " They chose to click here and to read the privacy policy.", 2: prose + "\nSee the catalog in the hall.", 3: prose + "\nAll rights reserved.", 4: prose + "\nThe design upgrades of 1999."}
    got = {r["doc_id"]: r for r in quality_rules.clean(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all(got[k]["kept"] for k in texts) and {k: got[k]["n_lost_words"] for k in texts} == {1: 0, 2: 0, 3: 3, 4: 0}


@pytest.mark.parametrize(
    "run",
    [
        lambda df: quality_rules.clean(df), lambda df: bpe.encode(df, PATH), lambda df: mixing.mix(df), lambda df: minhash.near_duplicates(df),
        lambda df: substring_dedup.dedup(df), lambda df: tokenfile.token_file(df, new_path(df.sparkSession, "none"), PATH, 2),
    ],
)
def test_empty_tables(run, spark):
    assert run(empty(spark)).count() == 0


@pytest.mark.parametrize("run", [lambda df: quality_rules.clean(df), lambda df: bpe.encode(df, PATH), lambda df: mixing.mix(df), lambda df: minhash.near_duplicates(df), lambda df: tokenfile.token_file(df, new_path(df.sparkSession, "some"), PATH, 2)])
def test_awkward_rows_keep_their_number(run, spark):
    assert len(run(messy(spark)).collect()) == len(messy_rows())
