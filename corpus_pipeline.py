"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, BPE.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns the columns of ``documents``; the last returns token ids. Null
texts and texts without words fail the quality rules, so later stages see none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glean.llm import bpe, minhash, mixing, quality_rules, queries, substring_dedup
from glean.llm.shared import written
from glean.sources.shipping import ship


def _slim(docs: DataFrame, *needed: str) -> DataFrame:
    """What an operator reads, and the whole row in ``row_``: no other column can clash with one that it adds."""
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`").alias(f"f{k}") for k, c in enumerate(docs.columns)]).alias("row_"))


def _as_documents(df: DataFrame, docs: DataFrame, text: F.Column | None = None) -> DataFrame:
    """The columns of ``docs`` from ``row_``, with a new ``text`` where one is given, and n_chars of it."""
    made = {c: F.col(f"row_.f{k}") for k, c in enumerate(docs.columns)}
    if text is not None:
        made["text"] = text
        if "n_chars" in made:
            made["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return df.select(*[x.alias(c) for c, x in made.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rejected documents; the others lose the lines that fail."""
    ship(spark)
    judged = quality_rules.clean(_slim(docs, "doc_id", "text")).where("kept")
    return _as_documents(judged, docs, F.col("clean_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least doc_id stays, once."""
    ship(spark)
    stays = minhash.near_duplicates(docs.select("doc_id", "text")).where("first").select(F.col("doc").alias("k0"), F.col("c1").alias("k1"), F.col("c2").alias("k2")).distinct()
    slim = _slim(docs, F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("c1"), F.xxhash64(F.lit("glean"), "text").alias("c2"))
    kept = slim.join(stays, F.col("doc").eqNullSafe(F.col("k0")) & (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")))
    # rows that repeat a whole document are copies of it
    once = Window.partitionBy("doc", "c1", "c2").orderBy(F.to_json("row_"))
    return _as_documents(kept.withColumn("copy", F.row_number().over(once)).where("copy = 1"), docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 20 words and more that occur earlier; drop documents of which nothing is left."""
    ship(spark)
    return _as_documents(substring_dedup.dedup(_slim(docs, "doc_id", "text")).where("n_words > n_removed"), docs, F.col("text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat every document as often as its source's target asks."""
    ship(spark)
    taken = mixing.mix(_slim(docs, "doc_id", "source", "text")).where("times > 0")
    return _as_documents(taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every taken document, with digests of ids and decoded text."""
    ship(spark)
    coded = bpe.encode(docs.select("doc_id", "source", "text"), queries.VOCABULARY, back="decoded")
    return coded.select("doc_id", "source", *queries.token_digests(), "ids")


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring),
    ("mixing", mix),
    ("bpe", tokenize),
]

#: SQL cannot express BPE; tests/llm holds the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
