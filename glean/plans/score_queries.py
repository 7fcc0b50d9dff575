"""Score algebra on a long table of (chunk, concept) scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glean.functions.numeric import close_to
from glean.operators import audit, evidence, scoring
from glean.operators.models import row_normalised
from glean.plans.config import PILOT
from glean.plans.registry import query
from glean.sources.tables import parts_by_size, table

KEYS = ["chunk_id", "concept"]
BY = ["chunk_id"]
#: MB of the file that one task works on: a quarter to two thirds of a million rows.
PART_MB = 4
SCORES_SQL = "sc AS (SELECT l_orderkey AS chunk_id, l_partkey AS concept, min(l_linenumber) AS concept_idx, max(l_extendedprice) AS lda_score, max(l_quantity) AS lsa_score FROM lineitem GROUP BY ALL)"
_MM = "CASE WHEN max({0}) OVER w = min({0}) OVER w THEN 0.0 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"
NORMED_SQL = f"{SCORES_SQL}, nm AS (SELECT *, {_MM.format('lda_score')} AS lda_norm, {_MM.format('lsa_score')} AS lsa_norm FROM sc WINDOW w AS (PARTITION BY chunk_id))"
FUSED_SQL = f"{NORMED_SQL}, fu AS (SELECT *, {PILOT.alpha} * lda_norm + {1 - PILOT.alpha} * lsa_norm AS final_score FROM nm)"
_ORDER = "PARTITION BY chunk_id ORDER BY {0} DESC, concept_idx, concept"


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Dealt out by chunk once: what follows groups by chunk, or by chunk and concept."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("concept"), "l_linenumber", "l_extendedprice", "l_quantity")
    made = rows.repartition(parts_by_size(table(spark, d, "lineitem"), PART_MB), "chunk_id").groupBy(*KEYS)
    return made.agg(F.min("l_linenumber").alias("concept_idx"), F.max("l_extendedprice").alias("lda_score"), F.max("l_quantity").alias("lsa_score"))


def normed(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).withColumns({"lda_norm": scoring.minmax(F.col("lda_score"), BY), "lsa_norm": scoring.minmax(F.col("lsa_score"), BY)})


def fused(spark: SparkSession, d: str) -> DataFrame:
    return normed(spark, d).withColumn("final_score", scoring.fuse(F.col("lda_norm"), F.col("lsa_norm"), PILOT.alpha))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return scoring.round_then_rank(fused(spark, d), "final_score", BY, "concept_idx", "concept")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two tables whose keys overlap in part."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("concept"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"))
    rows = rows.repartition(parts_by_size(table(spark, d, "lineitem"), PART_MB), *KEYS)  # both halves and their join stay in these parts
    left = rows.where("n <= 4").groupBy(*KEYS).agg(F.max("p").alias("lda_score"))
    right = rows.where("n >= 3").groupBy(*KEYS).agg(F.max("q").alias("lsa_score"))
    return left, right


_HALVES_SQL = "a AS (SELECT l_orderkey AS chunk_id, l_partkey AS concept, max(l_extendedprice) AS lda_score FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL), b AS (SELECT l_orderkey AS chunk_id, l_partkey AS concept, max(l_quantity) AS lsa_score FROM lineitem WHERE l_linenumber >= 3 GROUP BY ALL)"


@query(f"WITH {_HALVES_SQL} SELECT chunk_id, concept, lda_score, lsa_score FROM a JOIN b USING (chunk_id, concept)")
def score_join(spark: SparkSession, d: str) -> DataFrame:
    """JN1."""
    return scoring.join_scores(*_halves(spark, d), KEYS)


@query(f"WITH {_HALVES_SQL}, j AS (SELECT a.chunk_id AS l, b.chunk_id AS r FROM a FULL JOIN b USING (chunk_id, concept)) SELECT count(*) AS keys, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS both, count(*) FILTER (r IS NULL) AS left_only, count(*) FILTER (l IS NULL) AS right_only, 0::bigint AS left_duplicates, 0::bigint AS right_duplicates FROM j")
def score_join_audit(spark: SparkSession, d: str) -> DataFrame:
    """JN2, JN12, SE5."""
    return scoring.join_audit(*_halves(spark, d), KEYS)


@query(f"WITH {_HALVES_SQL} SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, coalesce(a.concept, b.concept) AS concept, lda_score, lsa_score, CASE WHEN a.chunk_id IS NULL THEN 'right_only' WHEN b.chunk_id IS NULL THEN 'left_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.chunk_id = b.chunk_id AND a.concept = b.concept")
def outer_alignment(spark: SparkSession, d: str) -> DataFrame:
    """JN3."""
    return scoring.outer_alignment(*_halves(spark, d), KEYS)


@query(f"WITH {_HALVES_SQL}, p AS (SELECT chunk_id, concept FROM a UNION SELECT chunk_id, concept FROM b) SELECT chunk_id, concept, coalesce(lsa_score, 0.0) AS lsa_score FROM p LEFT JOIN b USING (chunk_id, concept)")
def left_join_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    """JN4, SE2: the union of pairs, with 0 where a side has no score."""
    left, right = _halves(spark, d)
    pairs = left.select(*KEYS).unionByName(right.select(*KEYS)).repartition(parts_by_size(table(spark, d, "lineitem"), PART_MB), *KEYS).distinct()
    return pairs.join(right, KEYS, "left").fillna(0.0, ["lsa_score"])


@query(f"WITH {NORMED_SQL} SELECT chunk_id, concept, round(lda_norm, 6) AS lda_norm, round(lsa_norm, 6) AS lsa_norm FROM nm")
def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    """WN1, S4."""
    return normed(spark, d).select(*KEYS, *[F.round(c, 6).alias(c) for c in ("lda_norm", "lsa_norm")])


@query(f"WITH {SCORES_SQL}, s AS (SELECT chunk_id, concept, CASE WHEN concept % 7 = 0 THEN 0.0 ELSE lda_score END AS x FROM sc) SELECT chunk_id, concept, round({_MM.format('x')}, 6) AS lda_norm FROM s WINDOW w AS (PARTITION BY chunk_id)")
def minmax_nan_safe(spark: SparkSession, d: str) -> DataFrame:
    """WN1b: null and NaN scores count as 0."""
    holed = F.when(F.col("concept") % 14 == 0, F.lit(None).cast("double")).when(F.col("concept") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("lda_score"))
    return scores(spark, d).withColumn("x", holed).select(*KEYS, F.round(scoring.minmax(F.col("x"), BY, nan_safe=True), 6).alias("lda_norm"))


@query(f"WITH {FUSED_SQL} SELECT chunk_id, concept, round(final_score, 6) AS final_score FROM fu")
def fuse_weighted(spark: SparkSession, d: str) -> DataFrame:
    """PRJ8."""
    return fused(spark, d).select(*KEYS, F.round("final_score", 6).alias("final_score"))


@query(f"WITH {NORMED_SQL} SELECT chunk_id, concept, round((lda_norm + lsa_norm) / 2, 6) AS final_score FROM nm")
def late_fuse_mean(spark: SparkSession, d: str) -> DataFrame:
    """PRJ9, ML14."""
    return normed(spark, d).select(*KEYS, F.round(scoring.late_mean(F.col("lda_norm"), F.col("lsa_norm")), 6).alias("final_score"))


@query(f"WITH {NORMED_SQL} SELECT chunk_id, concept, 0.0::double AS lda_norm, round(lsa_norm, 6) AS final_score FROM nm")
def lsa_only(spark: SparkSession, d: str) -> DataFrame:
    """ML13: the branch with weight 0 for topics."""
    return normed(spark, d).select(*KEYS, F.lit(0.0).alias("lda_norm"), F.round(scoring.fuse(F.lit(0.0), F.col("lsa_norm"), 0.0), 6).alias("final_score"))


@query(f"WITH {SCORES_SQL} SELECT chunk_id, concept, row_number() OVER ({_ORDER.format('lsa_score')})::int AS rank FROM sc")
def rank_first(spark: SparkSession, d: str) -> DataFrame:
    """WN2, S5: ties in catalog order."""
    return scores(spark, d).select(*KEYS, scoring.rank_first(F.col("lsa_score"), BY, "concept_idx", "concept").alias("rank"))


@query(f"WITH {SCORES_SQL}, r AS (SELECT *, row_number() OVER ({_ORDER.format('lda_score')})::int AS rank FROM sc) SELECT chunk_id, concept, lda_score, rank FROM r WHERE rank <= 3")
def top3(spark: SparkSession, d: str) -> DataFrame:
    """WN3, WN4."""
    found = scores(spark, d).withColumn("rank", scoring.rank_first(F.col("lda_score"), BY, "concept_idx", "concept"))
    return scoring.top_n(found, 3).select(*KEYS, "lda_score", "rank")


@query(f"WITH {FUSED_SQL}, f4 AS (SELECT * REPLACE (round(round(final_score, 9), 4) AS final_score) FROM fu) SELECT chunk_id, concept, final_score, row_number() OVER ({_ORDER.format('final_score')})::int AS rank FROM f4")
def round_then_rank(spark: SparkSession, d: str) -> DataFrame:
    """S6, first branch."""
    return ranked(spark, d).select(*KEYS, "final_score", "rank")


@query(f"WITH {NORMED_SQL} SELECT chunk_id, concept, round(lsa_norm, 6) AS lsa_norm, row_number() OVER ({_ORDER.format('lsa_norm')})::int AS rank FROM nm")
def rank_then_round(spark: SparkSession, d: str) -> DataFrame:
    """S6, second branch."""
    return scoring.rank_then_round(normed(spark, d), "lsa_norm", BY, "concept_idx", "concept").select(*KEYS, "lsa_norm", "rank")


@query("SELECT l_suppkey AS video_id, round((list_sort(list(l_extendedprice), 'DESC'))[1], 6) AS top1, round(list_avg((list_sort(list(l_extendedprice), 'DESC'))[1:2]), 6) AS top2_mean, round(list_avg((list_sort(list(l_extendedprice), 'DESC'))[1:3]), 6) AS top3_mean FROM lineitem GROUP BY 1")
def topk_mean(spark: SparkSession, d: str) -> DataFrame:
    """AG2, S9."""
    found = evidence.top_sums(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("video_id"), "l_extendedprice"), ["video_id"], "l_extendedprice")
    return found.select("video_id", *[F.round(F.col(f"sum{k}") / F.col(f"n{k}"), 6).alias(n) for k, n in ((1, "top1"), (2, "top2_mean"), (3, "top3_mean"))])


@query(f"WITH {SCORES_SQL} SELECT concept, max(lda_score) AS best_score, min_by(chunk_id, (-lda_score, chunk_id)) AS best_chunk FROM sc GROUP BY concept".replace("min_by(chunk_id, (-lda_score, chunk_id))", "arg_min(chunk_id, {'s': -lda_score, 'c': chunk_id})"))
def argmax_row(spark: SparkSession, d: str) -> DataFrame:
    """AG3, S10."""
    return scores(spark, d).groupBy("concept").agg(F.max("lda_score").alias("best_score"), F.max_by("chunk_id", F.struct(F.col("lda_score"), -F.col("chunk_id"))).alias("best_chunk"))


_RANKED_SQL = f"{FUSED_SQL}, rk AS (SELECT * REPLACE (round(round(final_score, 9), 4) AS final_score), row_number() OVER (PARTITION BY chunk_id ORDER BY round(round(final_score, 9), 4) DESC, concept_idx, concept) AS rank FROM fu), it AS (SELECT *, chunk_id % 50 AS item, concept % 40 AS topic FROM rk)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).withColumns({"item": F.col("chunk_id") % 50, "topic": F.col("concept") % 40})


@query(
    f"WITH {_RANKED_SQL} SELECT item, topic, count(*) AS num_chunks, max(final_score) AS max_score, round(avg(final_score), 9) AS mean_score, round(list_avg((list_sort(list(final_score), 'DESC'))[1:2]), 9) AS top2_mean,"
    " count(*) FILTER (rank <= 3) AS top3_count, round(count(*) FILTER (rank <= 3) / count(*), 6) AS top3_ratio, count(*) FILTER (rank = 1) AS top1_count, round(count(*) FILTER (rank = 1) / count(*), 6) AS top1_ratio,"
    " max(lsa_score) AS max_lsa, max(lda_score) AS max_lda, arg_min(chunk_id, {'s': -final_score, 'c': chunk_id}) AS best_chunk FROM it GROUP BY item, topic"
)
def item_concept_evidence(spark: SparkSession, d: str) -> DataFrame:
    """AG1-AG5: twelve figures from one aggregation."""
    found = evidence.evidence(_items(spark, d), "item", "topic", "chunk_id")
    return found.withColumns({c: F.round(c, n) for c, n in (("mean_score", 9), ("top2_mean", 9), ("top3_ratio", 6), ("top1_ratio", 6))})


@query(f"WITH {_RANKED_SQL}, g AS (SELECT item, topic, list_sort(list(final_score), 'DESC') AS xs FROM it GROUP BY ALL) SELECT item, topic, aggregation, round(CASE aggregation WHEN 'max' THEN xs[1] WHEN 'mean' THEN list_avg(xs) WHEN 'top2_mean' THEN list_avg(xs[1:2]) ELSE list_avg(xs[1:3]) END, 9) AS value FROM g, (VALUES ('max'), ('mean'), ('top2_mean'), ('top3_mean')) v(aggregation)")
def switchable_aggregation(spark: SparkSession, d: str) -> DataFrame:
    """AG6: all four aggregations at once."""
    return evidence.all_aggregations(_items(spark, d), ["item", "topic"], "final_score").withColumn("value", F.round("value", 9))


@query(f"WITH {SCORES_SQL} SELECT chunk_id, concept, round(lsa_score / sum(lsa_score) OVER (PARTITION BY chunk_id), 6) AS share FROM sc")
def row_share(spark: SparkSession, d: str) -> DataFrame:
    """MA8."""
    return scores(spark, d).select(*KEYS, F.round(row_normalised(F.col("lsa_score"), BY), 6).alias("share"))


@query(f"WITH {NORMED_SQL}, c AS (SELECT count(*)::double AS n_rows, count(*) FILTER (NOT lda_norm BETWEEN 0 AND 1 OR NOT lsa_norm BETWEEN 0 AND 1)::double AS out_of_range, count(*) FILTER (lda_score IS NULL)::double AS null_scores, (count(*) - count(DISTINCT (chunk_id, concept)))::double AS duplicate_keys FROM nm) SELECT unnest(['rows_present', 'out_of_range', 'null_scores', 'duplicate_keys']) AS \"check\", unnest([(n_rows > 0)::int::double, out_of_range, null_scores, duplicate_keys]) AS value, unnest([1.0, 0.0, 0.0, 0.0])::double AS expected, unnest([n_rows > 0, out_of_range = 0, null_scores = 0, duplicate_keys = 0]) AS pass FROM c")
def audit_ledger(spark: SparkSession, d: str) -> DataFrame:
    """AU1, FLT7, SE7: the rules that must hold after scoring."""
    keyed = normed(spark, d).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("lda_norm").alias("a"), F.max("lsa_norm").alias("b"), F.count_if(F.col("lda_score").isNull()).alias("nulls"))
    return audit.ledger(
        keyed,
        {
            "rows_present": (F.least(F.count(F.lit(1)), F.lit(1)), 1),
            "out_of_range": (F.count_if(~F.col("a").between(0, 1) | ~F.col("b").between(0, 1)), 0),
            "null_scores": (F.sum("nulls"), 0),
            "duplicate_keys": (F.sum(F.col("n") - 1), 0),
        },
    )


@query(f"WITH {NORMED_SQL} SELECT round(max(abs((lda_norm + lsa_norm) / 2 - (lda_norm / 2 + lsa_norm / 2))), 9) AS max_abs_diff, count(*) AS rows FROM nm")
def formula_recheck(spark: SparkSession, d: str) -> DataFrame:
    """AU9, JN16, MA12."""
    a, b = F.col("lda_norm"), F.col("lsa_norm")
    return audit.max_deviation(normed(spark, d), scoring.late_mean(a, b), a / 2 + b / 2)


@query("SELECT p_partkey AS part_id, sha256('{\"p_brand\":\"' || p_brand || '\",\"p_size\":' || p_size || ',\"p_type\":\"' || p_type || '\"}') AS sha256 FROM part")
def config_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """TX25, SNK9: SHA-256 of canonical JSON."""
    return audit.fingerprint(table(spark, d, "part"), ["p_size", "p_brand", "p_type"]).select(F.col("p_partkey").alias("part_id"), "sha256")


@query(f"WITH {SCORES_SQL} SELECT chunk_id, count(*) AS n, count(*) FILTER (abs(lda_score - lsa_score * 1000) <= 500) AS close FROM sc GROUP BY 1")
def close_scores(spark: SparkSession, d: str) -> DataFrame:
    """MA12 with a wide tolerance."""
    return scores(spark, d).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(close_to(F.col("lda_score"), F.col("lsa_score") * 1000, 500)).alias("close"))
