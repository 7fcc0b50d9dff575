
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glean.functions.numeric import safe_divide

#: ST3: order of outcomes in error reports.
OUTCOME_ORDER = ("FP", "FN", "TP", "TN")


def outcome(truth: Column, predicted: Column) -> Column:
    """PRJ7."""
    return F.when((truth == 1) & (predicted == 1), "TP").when(truth == 1, "FN").when(predicted == 1, "FP").otherwise("TN")


def outcome_place(c: Column) -> Column:
    """ST3: 0-based place in OUTCOME_ORDER."""
    return F.array_position(F.array(*[F.lit(x) for x in OUTCOME_ORDER]), c).cast("int") - 1


def label_pairs(pairs: DataFrame, positives: DataFrame, keys: list[str]) -> DataFrame:
    """JN10: ``y_true`` is 1 for pairs among the positives, else 0."""
    return pairs.join(positives.select(*keys).distinct().withColumn("_p", F.lit(1)), keys, "left").withColumn("y_true", F.coalesce("_p", F.lit(0))).drop("_p")


def confusion(truth: str = "y_true", predicted: str = "y_pred") -> list[Column]:
    """EV1."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    return [F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")]


def with_rates(counts: DataFrame, digits: int = 6) -> DataFrame:
    """EV2, EV3: precision, recall, F1, accuracy; every division by zero is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = {"precision": safe_divide(tp, tp + fp), "recall": safe_divide(tp, tp + fn), "f1": safe_divide(2 * tp, 2 * tp + fp + fn), "accuracy": safe_divide(tp + tn, tp + fp + fn + tn)}
    return counts.withColumns({k: F.round(v, digits) for k, v in rates.items()})


def with_extended_rates(counts: DataFrame, digits: int = 6) -> DataFrame:
    """EV4, EV5: specificity, false-positive rate, balanced accuracy, Matthews correlation (0 if undefined)."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    specificity, recall = safe_divide(tn, tn + fp), safe_divide(tp, tp + fn)
    mcc = safe_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    rates = {"specificity": specificity, "fpr": safe_divide(fp, fp + tn), "balanced_accuracy": (recall + specificity) / 2, "mcc": mcc}
    return counts.withColumns({k: F.round(v, digits) for k, v in rates.items()})


def report(pairs: DataFrame, by: str) -> DataFrame:
    """AG14: rates for each group and, with a null group, over all rows, from one grouping-sets pass."""
    return with_rates(pairs.groupingSets([[F.col(by)], []], F.col(by)).agg(*confusion()))


def macro_micro(pairs: DataFrame, item: str, by: list[str]) -> DataFrame:
    """EV9-EV11, S12: macro = mean of the items' rates, micro = rates of the pooled pairs."""
    per_item = with_rates(pairs.groupBy(*by, item).agg(*confusion()), 12)
    pooled = per_item.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
        *[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        F.count(F.lit(1)).alias("items"),
    )
    return with_rates(pooled).withColumnsRenamed({c: f"micro_{c}" for c in ("precision", "recall", "f1")})


def average_precision(scored: DataFrame, by: list[str], truth: str = "y_true", score: str = "score") -> DataFrame:
    """EV6: sum over distinct scores, falling, of recall gained x precision there; null without positives.

    Scores are summed per distinct value first, so the running window has one row a value.
    """
    tied = scored.groupBy(*by, score).agg(F.sum(truth).alias("pos"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.col(score).desc())
    steps = tied.withColumn("tp", F.sum("pos").over(w)).withColumn("seen", F.sum("n").over(w))
    value = F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos"))
    return steps.groupBy(*by).agg(F.round(value, 6).alias("average_precision"), F.sum("pos").alias("positives"))


def roc_auc(scored: DataFrame, by: list[str], truth: str = "y_true", score: str = "score") -> DataFrame:
    """EV7: rank-sum form with average ranks for ties; null with one class only."""
    tied = scored.groupBy(*by, score).agg(F.sum(truth).alias("pos"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = tied.withColumn("rank", before + (F.col("n") + 1) / 2)
    p, n = F.sum("pos"), F.sum("n") - F.sum("pos")
    auc = F.try_divide(F.sum(F.col("pos") * F.col("rank")) - p * (p + 1) / 2, (p * n).cast("double"))
    return ranked.groupBy(*by).agg(F.round(auc, 6).alias("roc_auc"))


def mean_average_precision(scored: DataFrame, item: str, by: list[str] | None = None) -> DataFrame:
    """EV8: mean over the items with a positive."""
    found = average_precision(scored, [*(by or []), item]).where("positives > 0")
    return found.groupBy(*(by or [])).agg(F.round(F.avg("average_precision"), 6).alias("map"), F.count(F.lit(1)).alias("items"))


def winner(a_macro: Column, b_macro: Column, a_micro: Column, b_micro: Column, names: tuple[str, str], tolerance: float = 1e-12) -> Column:
    """EV19: by macro, then micro, else a tie."""
    ahead = lambda x, y: x - y > tolerance
    return F.when(ahead(a_macro, b_macro), names[0]).when(ahead(b_macro, a_macro), names[1]).when(ahead(a_micro, b_micro), names[0]).when(ahead(b_micro, a_micro), names[1]).otherwise("tie")
