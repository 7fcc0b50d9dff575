"""Predictions against labels: rates, ranking metrics, comparisons, grids, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glean.operators import audit, dataset, evaluate, stats, tuning
from glean.operators.ranking import ranked_within
from glean.plans.registry import query
from glean.sources.tables import table

A_CUT, B_CUT = 0.4, 0.5

#: Two score columns and a label for each labelled document; ``stratum`` plays the subject, ``item`` the video.
PAIRS_SQL = f"""pr AS (SELECT d.doc_id, lang AS stratum, source AS item, quality AS y_true, round(least(n_chars, 4000) / 4000.0, 6)::double AS a, ((d.doc_id * 37) % 101 / 101.0)::double AS b,
  (round(least(n_chars, 4000) / 4000.0, 6) >= {A_CUT})::int AS y_a, ((d.doc_id * 37) % 101 / 101.0 >= {B_CUT})::int AS y_b FROM documents d JOIN labels USING (doc_id))"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("stratum"), F.col("source").alias("item"), F.round(F.least("n_chars", F.lit(4000)) / 4000, 6).alias("a"), (F.col("doc_id") * 37 % 101 / F.lit(101.0)).alias("b"))
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y_true"))
    found = docs.join(labels, "doc_id")
    return found.withColumns({"y_a": (F.col("a") >= A_CUT).cast("int"), "y_b": (F.col("b") >= B_CUT).cast("int")})


_COUNTS = "count(*) FILTER (y_true = 1 AND {0} = 1) AS tp, count(*) FILTER (y_true <> 1 AND {0} = 1) AS fp, count(*) FILTER (y_true = 1 AND {0} <> 1) AS fn, count(*) FILTER (y_true <> 1 AND {0} <> 1) AS tn"
_DIV = "coalesce(({0})::double / nullif(({1})::double, 0), 0.0)"
_P, _R, _F1, _ACC = _DIV.format("tp", "tp + fp"), _DIV.format("tp", "tp + fn"), _DIV.format("2 * tp", "2 * tp + fp + fn"), _DIV.format("tp + tn", "tp + fp + fn + tn")
_RATES = f"round({_P}, 6) AS precision, round({_R}, 6) AS recall, round({_F1}, 6) AS f1, round({_ACC}, 6) AS accuracy"


@query(f"WITH {PAIRS_SQL} SELECT doc_id, a AS score, y_a AS y_pred FROM pr WHERE a >= {A_CUT}")
def threshold_predict(spark: SparkSession, d: str) -> DataFrame:
    """FLT4, PRJ12: inclusive threshold."""
    return pairs(spark, d).where(F.col("a") >= A_CUT).select("doc_id", F.col("a").alias("score"), F.col("y_a").alias("y_pred"))


@query("SELECT d.doc_id, (l.doc_id IS NOT NULL)::int AS y_true FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id)")
def label_join(spark: SparkSession, d: str) -> DataFrame:
    """JN10."""
    return evaluate.label_pairs(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").where("quality = 1"), ["doc_id"])


_OUTCOME_SQL = "CASE WHEN y_true = 1 AND y_a = 1 THEN 'TP' WHEN y_true = 1 THEN 'FN' WHEN y_a = 1 THEN 'FP' ELSE 'TN' END"


@query(f"WITH {PAIRS_SQL}, o AS (SELECT doc_id, {_OUTCOME_SQL} AS outcome FROM pr) SELECT doc_id, outcome, (list_position(['FP', 'FN', 'TP', 'TN'], outcome) - 1)::int AS place FROM o")
def outcome_label(spark: SparkSession, d: str) -> DataFrame:
    """PRJ7, ST3."""
    found = pairs(spark, d).select("doc_id", evaluate.outcome(F.col("y_true"), F.col("y_a")).alias("outcome"))
    return found.withColumn("place", evaluate.outcome_place(F.col("outcome")))


@query(f"WITH {PAIRS_SQL}, o AS (SELECT doc_id, stratum, {_OUTCOME_SQL} AS outcome FROM pr) SELECT * FROM o WHERE outcome IN ('FP', 'FN')")
def error_rows(spark: SparkSession, d: str) -> DataFrame:
    """FLT10."""
    return pairs(spark, d).select("doc_id", "stratum", evaluate.outcome(F.col("y_true"), F.col("y_a")).alias("outcome")).where(F.col("outcome").isin("FP", "FN"))


@query(f"WITH {PAIRS_SQL}, c AS (SELECT stratum, {_COUNTS.format('y_a')} FROM pr GROUP BY GROUPING SETS ((stratum), ())) SELECT *, {_RATES} FROM c")
def prf_report_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """AG14, EV1-EV3."""
    return evaluate.report(pairs(spark, d).withColumn("y_pred", F.col("y_a")), "stratum")


_SPEC = _DIV.format("tn", "tn + fp")


@query(f"WITH {PAIRS_SQL}, c AS (SELECT stratum, {_COUNTS.format('y_b')} FROM pr GROUP BY 1) SELECT *, round({_SPEC}, 6) AS specificity, round({_DIV.format('fp', 'fp + tn')}, 6) AS fpr, round(({_R} + {_SPEC}) / 2, 6) AS balanced_accuracy, round({_DIV.format('tp * tn - fp * fn', 'sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn))')}, 6) AS mcc FROM c")
def confusion_extended(spark: SparkSession, d: str) -> DataFrame:
    """EV4, EV5."""
    return evaluate.with_extended_rates(pairs(spark, d).groupBy("stratum").agg(*evaluate.confusion(predicted="y_b")))


_AP_SQL = "t AS (SELECT {0}, {1} AS score, sum(y_true) AS pos, count(*) AS n FROM pr GROUP BY ALL), s AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM t WINDOW w AS (PARTITION BY {0} ORDER BY score DESC)), ap AS (SELECT {0}, round(sum(pos * tp / seen) / nullif(sum(pos), 0), 6)::double AS average_precision, sum(pos)::bigint AS positives FROM s GROUP BY {0})"


@query(f"WITH {PAIRS_SQL}, {_AP_SQL.format('stratum', 'a')} SELECT * FROM ap")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    """EV6."""
    return evaluate.average_precision(pairs(spark, d), ["stratum"], score="a")


@query(f"WITH {PAIRS_SQL}, t AS (SELECT stratum, a AS score, sum(y_true) AS pos, count(*) AS n FROM pr GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY stratum ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rank FROM t) SELECT stratum, round((sum(pos * rank) - sum(pos) * (sum(pos) + 1) / 2.0) / nullif(sum(pos) * (sum(n) - sum(pos)), 0), 6)::double AS roc_auc FROM r GROUP BY stratum")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    """EV7, WN9."""
    return evaluate.roc_auc(pairs(spark, d), ["stratum"], score="a")


@query(f"WITH {PAIRS_SQL}, {_AP_SQL.format('item', 'a')} SELECT round(avg(average_precision), 6) AS map, count(*) AS items FROM ap WHERE positives > 0")
def map_by_group(spark: SparkSession, d: str) -> DataFrame:
    """EV8."""
    return evaluate.mean_average_precision(pairs(spark, d).withColumn("score", F.col("a")), "item")


_MACRO_SQL = f"ci AS (SELECT {{0}}, item, {_COUNTS.format('{1}')} FROM pr GROUP BY ALL), ri AS (SELECT *, round({_P}, 12) AS p, round({_R}, 12) AS r, round({_F1}, 12) AS f FROM ci), mm AS (SELECT {{0}}, sum(tp)::bigint AS tp, sum(fp)::bigint AS fp, sum(fn)::bigint AS fn, sum(tn)::bigint AS tn, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, count(*) AS items FROM ri GROUP BY {{0}}), mx AS (SELECT *, round({_P}, 6) AS micro_precision, round({_R}, 6) AS micro_recall, round({_F1}, 6) AS micro_f1, round({_ACC}, 6) AS accuracy FROM mm)"


@query(f"WITH {PAIRS_SQL.replace('lang AS stratum', chr(39) + 'all' + chr(39) + ' AS stratum')}, {_MACRO_SQL.format('stratum', 'y_a')} SELECT * FROM mx")
def macro_micro(spark: SparkSession, d: str) -> DataFrame:
    """EV9, S12."""
    return evaluate.macro_micro(pairs(spark, d).withColumns({"y_pred": F.col("y_a"), "stratum": F.lit("all")}), "item", ["stratum"])


@query(f"WITH {PAIRS_SQL}, {_MACRO_SQL.format('stratum', 'y_a')} SELECT * FROM mx")
def per_stratum(spark: SparkSession, d: str) -> DataFrame:
    """EV10."""
    return evaluate.macro_micro(pairs(spark, d).withColumn("y_pred", F.col("y_a")), "item", ["stratum"])


@query(f"WITH {PAIRS_SQL.replace('lang AS stratum', 'd.doc_id % 5 AS stratum')}, {_MACRO_SQL.format('stratum', 'y_b')} SELECT * FROM mx")
def per_fold(spark: SparkSession, d: str) -> DataFrame:
    """EV11."""
    return evaluate.macro_micro(pairs(spark, d).withColumns({"y_pred": F.col("y_b"), "stratum": F.col("doc_id") % 5}), "item", ["stratum"])


@query(
    f"WITH {PAIRS_SQL}, {_MACRO_SQL.format('stratum', 'y_a')}, {_MACRO_SQL.format('stratum', 'y_b').replace('ci AS', 'ci2 AS').replace('FROM ci)', 'FROM ci2)').replace('ri AS', 'ri2 AS').replace('FROM ri ', 'FROM ri2 ').replace('mm AS', 'mm2 AS').replace('FROM mm)', 'FROM mm2)').replace('mx AS', 'my AS')}"
    " SELECT x.stratum, x.macro_f1 AS macro_f1_a, y.macro_f1 AS macro_f1_b, round(y.macro_f1 - x.macro_f1, 6) AS delta, CASE WHEN x.macro_f1 - y.macro_f1 > 1e-12 THEN 'a' WHEN y.macro_f1 - x.macro_f1 > 1e-12 THEN 'b' WHEN x.micro_f1 - y.micro_f1 > 1e-12 THEN 'a' WHEN y.micro_f1 - x.micro_f1 > 1e-12 THEN 'b' ELSE 'tie' END AS winner FROM mx x JOIN my y USING (stratum)"
)
def compare_methods(spark: SparkSession, d: str) -> DataFrame:
    """EV12, EV19, JN14, AG19: both methods from one pass over the pairs, then pivoted."""
    both = pairs(spark, d).select("stratum", "item", "y_true", F.explode(F.array(F.struct(F.lit("a").alias("method"), F.col("y_a").alias("y_pred")), F.struct(F.lit("b").alias("method"), F.col("y_b").alias("y_pred")))).alias("m")).select("stratum", "item", "y_true", "m.*")
    rates = evaluate.macro_micro(both, "item", ["stratum", "method"])
    wide = rates.groupBy("stratum").pivot("method", ["a", "b"]).agg(F.first("macro_f1").alias("macro"), F.first("micro_f1").alias("micro"))
    won = evaluate.winner(F.col("a_macro"), F.col("b_macro"), F.col("a_micro"), F.col("b_micro"), ("a", "b"))
    return wide.select("stratum", F.col("a_macro").alias("macro_f1_a"), F.col("b_macro").alias("macro_f1_b"), F.round(F.col("b_macro") - F.col("a_macro"), 6).alias("delta"), won.alias("winner"))


_FOLDS_SQL = "fo AS (SELECT doc_id, lang AS stratum, ((row_number() OVER (PARTITION BY lang ORDER BY md5('fold-' || doc_id), doc_id) - 1) % 5 + 1)::int AS fold FROM documents)"


def folds(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("stratum"))
    order = F.struct(F.md5(F.concat(F.lit("fold-"), F.col("doc_id").cast("string")).cast("binary")), "doc_id")
    return tuning.stratified_folds(docs, "stratum", order, 5)


@query(f"WITH {_FOLDS_SQL} SELECT * FROM fo")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    """EV20, EV21 in the portable form (md5 order)."""
    return folds(spark, d)


@query(f"WITH {_FOLDS_SQL} SELECT fold, count(*) FILTER (stratum = 'de') AS de, count(*) FILTER (stratum = 'en') AS en, count(*) FILTER (stratum = 'es') AS es, count(*) FILTER (stratum = 'fr') AS fr, count(*) AS total FROM fo GROUP BY fold")
def crosstab_folds(spark: SparkSession, d: str) -> DataFrame:
    """AG13."""
    names = ["de", "en", "es", "fr"]
    wide = dataset.to_matrix(folds(spark, d), ["fold"], "stratum", names, F.count(F.lit(1)))
    return wide.withColumn("total", sum((F.col(n) for n in names), F.lit(0).cast("long")))


@query(f"WITH {_FOLDS_SQL}, c AS (SELECT doc_id, count(DISTINCT fold) AS held_out_in FROM fo GROUP BY 1) SELECT held_out_in, count(*) AS items FROM c GROUP BY 1")
def oof_coverage(spark: SparkSession, d: str) -> DataFrame:
    """AU5."""
    return audit.coverage(folds(spark, d), "doc_id", "fold")


@query(f"WITH {_FOLDS_SQL}, f AS (SELECT DISTINCT fold FROM fo) SELECT f.fold, count(*) FILTER (o.fold <> f.fold) AS train, count(*) FILTER (o.fold = f.fold) AS test, 0::bigint AS overlap FROM f, fo o GROUP BY f.fold")
def leakage_audit(spark: SparkSession, d: str) -> DataFrame:
    """AU4, JN12."""
    return audit.leakage(folds(spark, d), "doc_id", "fold")


@query(f"WITH {PAIRS_SQL}, ci AS (SELECT doc_id % 5 AS fold, item, {_COUNTS.format('y_a')} FROM pr GROUP BY ALL), f AS (SELECT fold, avg(round({_F1}, 12)) AS f FROM ci GROUP BY 1) SELECT round(avg(f), 6) AS mean_macro_f1, round(stddev_samp(f), 6) AS fold_std, count(*) AS folds FROM f")
def fold_stability(spark: SparkSession, d: str) -> DataFrame:
    """EV24."""
    return tuning.fold_stability(pairs(spark, d).withColumns({"y_pred": F.col("y_a"), "fold": F.col("doc_id") % 5}), "fold", "item", [])


_STRATA_SQL = "st AS (SELECT c_mktsegment AS stratum, c_acctbal AS value, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1)::int AS place FROM customer)"


def strata(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "customer").select(F.col("c_mktsegment").alias("stratum"), F.col("c_acctbal").alias("value"), "c_custkey")
    return ranked_within(found, ["stratum"], F.col("c_custkey")).select("stratum", "value", (F.col("place") - 1).alias("place"))


#: Paired differences: one customer's balance and the next one's of the segment.
_DELTA_SQL = f"{_STRATA_SQL}, dl AS (SELECT x.stratum, round(x.value - y.value, 2) AS delta FROM st x JOIN st y ON x.stratum = y.stratum AND y.place = x.place + 1 WHERE x.place % 2 = 0)"


def deltas(spark: SparkSession, d: str) -> DataFrame:
    s = strata(spark, d)
    paired = s.groupBy("stratum", F.floor(F.col("place") / 2).alias("pair")).agg(F.max(F.when(F.col("place") % 2 == 0, F.col("value"))).alias("x"), F.max(F.when(F.col("place") % 2 == 1, F.col("value"))).alias("y"))
    return paired.where("x IS NOT NULL AND y IS NOT NULL").select("stratum", F.round(F.col("x") - F.col("y"), 2).alias("delta"))


@query(f"WITH {_DELTA_SQL}, t AS (SELECT stratum, abs(delta) AS size, count(*) AS n, count(*) FILTER (delta > 0) AS up FROM dl WHERE delta <> 0 GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY stratum ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rank FROM t), s AS (SELECT stratum, sum(n)::bigint AS n, sum(up * rank)::double AS w_plus, sum((n - up) * rank)::double AS w_minus, sum(n * n * n - n) AS ties FROM r GROUP BY 1) SELECT stratum, n, w_plus, w_minus, least(w_plus, w_minus) AS statistic, round((least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n::double * (n + 1) * (2 * n + 1) / 24 - ties / 48.0), 6) AS z FROM s")
def wilcoxon_stat(spark: SparkSession, d: str) -> DataFrame:
    """EV15, WN9."""
    return stats.wilcoxon(deltas(spark, d), ["stratum"], "delta")


_T_SQL = "round(avg(delta) / stddev_samp(delta), 6) AS cohen_dz"


@query(f"WITH {_DELTA_SQL} SELECT stratum, count(delta) AS n, round(avg(delta), 6) AS mean_delta, round(avg(delta) / stddev_samp(delta) * sqrt(count(delta)), 6) AS t_stat, {_T_SQL} FROM dl GROUP BY 1")
def paired_t_stat(spark: SparkSession, d: str) -> DataFrame:
    """EV16, EV17."""
    return stats.paired_t(deltas(spark, d), ["stratum"], "delta")


@query(f"WITH {_DELTA_SQL} SELECT stratum, {_T_SQL} FROM dl GROUP BY 1")
def cohen_dz(spark: SparkSession, d: str) -> DataFrame:
    """EV17."""
    return stats.paired_t(deltas(spark, d), ["stratum"], "delta").select("stratum", "cohen_dz")


@query(f"WITH {_DELTA_SQL} SELECT stratum, count(*) FILTER (delta > 1e-12) AS wins, count(*) FILTER (abs(delta) <= 1e-12) AS ties, count(*) FILTER (delta < -1e-12) AS losses FROM dl GROUP BY 1")
def win_tie_loss(spark: SparkSession, d: str) -> DataFrame:
    """AG18."""
    return deltas(spark, d).groupBy("stratum").agg(*stats.win_tie_loss(F.col("delta")))


@query(f"WITH {PAIRS_SQL} SELECT stratum, count(*) FILTER (y_a = y_true AND y_b <> y_true) AS only_first, count(*) FILTER (y_a <> y_true AND y_b = y_true) AS only_second, count(*) FILTER (y_a = y_true AND y_b = y_true) AS both_right, count(*) FILTER (y_a <> y_true AND y_b <> y_true) AS both_wrong FROM pr GROUP BY 1")
def mcnemar_counts(spark: SparkSession, d: str) -> DataFrame:
    """EV18."""
    return stats.mcnemar_counts(pairs(spark, d), ["stratum"], "y_true", "y_a", "y_b")


@query(f"WITH {_STRATA_SQL} SELECT stratum, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max FROM st GROUP BY 1")
def summary_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AG10, AG15."""
    return stats.summary(strata(spark, d), ["stratum"], "value")
