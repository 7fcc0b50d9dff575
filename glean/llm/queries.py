"""One query for each numbered operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glean.llm import bpe, collocations, fill_middle, language_id, minhash, mixing, ngram_join, permutation_index, quality_classifier, quality_rules, substring_dedup, tokenfile, toxicity
from glean.llm.shared import new_path, written
from glean.sources.shipping import ship

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "class_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.clean(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.drop("text", "clean_text", "n_lost_lines")


def _remainder(key: str, n: int) -> F.Column:
    """crc32 of the id as text modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(_remainder("doc_id", 4) != 2))
    found = language_id.identify(docs, model)
    return found.select("doc_id", (_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "spans")


def token_digests() -> list[F.Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of (ids, decoded)."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        _sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        _sha(F.col("decoded")).alias("decoded_sha256"),
    ]


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, VOCABULARY, back="decoded").select("doc_id", *token_digests())


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return tokenfile.token_file(docs, new_path(spark, "tokens"), VOCABULARY, END_ID)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = _remainder("doc_id", 5) == 0
    model = toxicity.fit(docs.where(~held_out), _table(spark, sf_dir, "labels").where(~held_out))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(vectors, F.col("vec_id") % 50 == 0)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = written(quality_classifier.measure(_table(spark, sf_dir, "documents")), "measured")
    held_out = _remainder("key", 4) == 2
    model = quality_classifier.fit(measured.where(~held_out), _table(spark, sf_dir, "labels"))
    found = quality_classifier.score(measured, model)
    return found.select(F.col("key").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha(F.col("output")).alias("output_sha256"), _sha(restored).alias("restored_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top(collocations.mine(_table(spark, sf_dir, "documents").select("text", "lang")))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_mixing": op2_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_bpe": op6_bpe,
    "op7_token_file": op7_token_file,
    "op8_toxicity": op8_toxicity,
    "op9_permutation_index": op9_permutation_index,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_fill_middle": op11_fill_middle,
    "op12_collocations": op12_collocations,
    "op13_ngram_join": op13_ngram_join,
}
ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": ngram_join.NEAR_DUPLICATES_SQL,
    "op2_mixing": mixing.ORACLE_SQL,
    "op3_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_quality_rules": quality_rules.ORACLE_SQL,
    "op11_fill_middle": fill_middle.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_ngram_join": ngram_join.ORACLE_SQL,
}
