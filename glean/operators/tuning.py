
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glean.operators.evaluate import confusion, with_rates
from glean.operators.evidence import AGGREGATIONS
from glean.operators.ranking import ranked_within


def stratified_folds(df: DataFrame, stratum: str | list[str], order: Column, folds: int) -> DataFrame:
    """EV20, EV21: 1-based ``fold``: rows of a stratum dealt in the order of ``order``. No task sorts a stratum."""
    strata = [stratum] if isinstance(stratum, str) else stratum
    ranked = ranked_within(df, strata, order, "fold")
    return ranked.withColumn("fold", (F.col("fold") - 1) % folds + 1)


def shuffled_folds(strata: list[str], folds: int, seed: int = 42) -> list[int]:
    """EV20 with the generator of the published folds, for small registries: 1-based folds in row order.

    Classes count in order of first appearance; each class gets as many of each
    fold as the sorted classes would give, shuffled.
    """
    names = list(dict.fromkeys(strata))
    codes = np.array([names.index(s) for s in strata])
    ordered = np.sort(codes)
    share = np.array([np.bincount(ordered[k::folds], minlength=len(names)) for k in range(folds)])
    made, out = np.random.RandomState(seed), np.empty(len(codes), int)
    for c in range(len(names)):
        of_class = np.repeat(np.arange(folds), share[:, c])
        made.shuffle(of_class)
        out[codes == c] = of_class
    return (out + 1).tolist()


#: Video scores are whole numbers of this fraction, so that means, halves and thresholds are exact.
UNIT = 10_000
#: The order in which aggregations win ties.
TIE_ORDER = ("top2_mean", "max", "mean", "top3_mean")
#: Rates are summed as whole numbers of this fraction, so that sums and differences of sums are exact.
PICO = 10**12
#: Rates of a setting that are averaged over videos.
RATES = ("precision", "recall", "f1")


def whole_mean(total: Column, n: Column, mode: str = "half_up") -> Column:
    """``total / n`` of whole numbers as a whole number, PRJ10."""
    down = F.floor(total / n).cast("long")
    twice = 2 * (total - down * n)
    up = (twice > n) | ((twice == n) & ((down % 2 == 1) if mode == "half_even" else F.lit(True)))
    return down + up.cast("long")


def video_scores(scores: DataFrame, by: list[str], video: str, concept: str, alphas: list[float], a: str = "lda_norm", b: str = "lsa_norm", mode: str = "half_up") -> DataFrame:
    """EV22: (by..., video, concept, alpha, aggregation, score) in units: every fusion weight and aggregation of a long table of chunk scores.

    Chunk scores are rounded to four places before they are aggregated, and so are video
    scores, by ``mode``. The scores are shuffled once, whatever the number of weights.
    """
    keys = [*by, video, concept]
    dealt = _grouped(scores, [*by, video], keys, [a, b])

    def run(batches):
        for first, found in _settings(batches, keys, a, b, alphas, mode):
            at = np.repeat(np.arange(len(found)), len(alphas) * len(AGGREGATIONS))
            yield pa.RecordBatch.from_arrays([*(first.column(c).take(pa.array(at)) for c in keys), *_setting_columns(len(found), alphas), pa.array(found.ravel())], [*keys, "alpha", "aggregation", "score"])

    return dealt.mapInArrow(run, T.StructType([*dealt.select(*keys).schema, *_SETTING, T.StructField("score", T.LongType())]))


def setting_counts(scores: DataFrame, by: list[str], video: str, concept: str, truth: str, alphas: list[float], thresholds: list[float], a: str = "lda_norm", b: str = "lsa_norm", mode: str = "half_up") -> DataFrame:
    """EV22: (by..., video, alpha, aggregation, threshold, tp, fp, fn, tn): ``video_scores`` against the truth at every threshold.

    ``scores``: chunk scores, each with the truth of its video and concept; ``by`` may name
    what is the same for a whole video. Rows are shuffled once and stream past in the order of
    (by..., video, concept); a task holds the chunks of one concept and histograms of one
    batch's videos, so weights, aggregations and thresholds multiply no rows before the counts.
    """
    keys, cuts = [*by, video], np.array([round(t * UNIT) for t in sorted(thresholds)])
    dealt, steps = _grouped(scores, keys, [*keys, concept], [truth, a, b]), len(cuts) + 1
    settings = len(alphas) * len(AGGREGATIONS)

    def told(videos: pa.RecordBatch, hist: np.ndarray) -> pa.RecordBatch:
        least = hist[..., ::-1].cumsum(-1)[..., ::-1]  # video, truth, setting, scores of this step or more
        (fp, tp), (neg, pos) = (np.moveaxis(x, 1, 0) for x in (least[..., 1:], least[..., :1]))
        n = len(hist)
        at, levels = np.repeat(np.arange(n), settings * len(cuts)), np.tile(np.array(sorted(thresholds), float), n * settings)
        setting = [x.take(pa.array(np.repeat(np.arange(n * settings), len(cuts)))) for x in _setting_columns(n, alphas)]
        counts = [pa.array(x.ravel()) for x in (tp, fp, pos - tp, neg - fp)]
        return pa.RecordBatch.from_arrays([*(videos.column(c).take(pa.array(at)) for c in keys), *setting, pa.array(levels), *counts], [*keys, "alpha", "aggregation", "threshold", "tp", "fp", "fn", "tn"])

    def run(batches):
        kept = None  # the last video, which may go on
        for first, found in _settings(batches, [*keys, concept], a, b, alphas, mode):
            new = _starts(first, keys)
            of, n = np.cumsum(new) - 1, int(new.sum())
            hit = (pc.fill_null(first.column(truth), 0).to_numpy(zero_copy_only=False) == 1).astype(int)
            step = np.searchsorted(cuts, found, side="right")
            cell = ((of * 2 + hit)[:, None] * settings + np.arange(settings)) * steps + step
            hist = np.bincount(cell.ravel(), minlength=n * 2 * settings * steps).reshape(n, 2, settings, steps)
            videos = first.select(keys).take(pa.array(np.flatnonzero(new)))
            if kept and all(kept[0].column(c)[0] == videos.column(c)[0] for c in keys):
                hist[0] += kept[1][0]
            elif kept:
                yield told(*kept)
            if n > 1:
                yield told(videos.slice(0, n - 1), hist[:-1])
            kept = videos.slice(n - 1), hist[-1:]
        if kept:
            yield told(*kept)

    return dealt.mapInArrow(run, T.StructType([*dealt.select(*keys).schema, *_SETTING, T.StructField("threshold", T.DoubleType()), *(T.StructField(c, T.LongType()) for c in ("tp", "fp", "fn", "tn"))]))


_SETTING = [T.StructField("alpha", T.DoubleType()), T.StructField("aggregation", T.StringType())]


def _setting_columns(n: int, alphas: list[float]) -> list[pa.Array]:
    """Weight and aggregation of every setting, n times."""
    every = pa.array(np.tile(np.repeat(np.array(alphas, float), len(AGGREGATIONS)), n))
    return [every, pa.array(AGGREGATIONS).take(pa.array(np.tile(np.arange(len(AGGREGATIONS)), n * len(alphas))))]


def _grouped(scores: DataFrame, deal: list[str], order: list[str], more: list[str]) -> DataFrame:
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scores.select(*order, *more).repartition(parts, *deal).sortWithinPartitions(*order)


def _starts(rows: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row differs from the last one in any of the keys; the first does."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in keys:
        code = pc.fill_null(pc.index_in(rows.column(c), value_set=pc.unique(rows.column(c))), -1).to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return new


def _settings(batches, keys: list[str], a: str, b: str, alphas: list[float], mode: str):
    """(first rows, scores) of the groups of equal keys, which follow each other; scores: groups x settings."""
    rest = None  # the last group, which may go on

    def found(rows: pa.Table, start: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        x, y = (rows.column(c).to_numpy() for c in (a, b))
        n, group = np.diff(np.r_[start, len(rows)]), np.cumsum(np.isin(np.arange(len(rows)), start)) - 1
        out = np.empty((len(start), len(alphas), len(AGGREGATIONS)), np.int64)
        for i, alpha in enumerate(alphas):
            units = _whole(np.floor((alpha * x + (1 - alpha) * y) * 1e9 + 0.5) / 1e9 * UNIT, mode)
            units = units[np.lexsort((-units, group))]
            best = [np.where(n > k, units[np.minimum(start + k, len(units) - 1)], 0) for k in range(3)]
            out[:, i, 0] = best[0]
            for j, (total, of) in enumerate(((np.add.reduceat(units, start), n), (best[0] + best[1], np.minimum(n, 2)), (sum(best), np.minimum(n, 3)))):
                down = total // of
                twice = 2 * (total - down * of)
                out[:, i, j + 1] = down + ((twice > of) | ((twice == of) & ((down % 2 == 1) | (mode != "half_even"))))
        return rows.take(pa.array(start)).combine_chunks().to_batches()[0], out.reshape(len(start), -1)

    for batch in batches:
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        rows = rows.combine_chunks()
        if not len(rows):
            continue
        start = np.flatnonzero(_starts(rows, keys))
        rest = rows.slice(start[-1])
        if len(start) > 1:
            yield found(rows.slice(0, start[-1]), start[:-1])
    if rest is not None and len(rest):
        yield found(rest, np.array([0]))


def _whole(x: np.ndarray, mode: str) -> np.ndarray:
    """PRJ10 of an array."""
    if mode not in ("half_up", "half_even"):
        raise ValueError(f"unknown rounding {mode!r}")
    down = np.floor(x)
    return (np.rint(x) if mode == "half_even" else down + (x - down >= 0.5)).astype(np.int64)


def threshold_counts(scored: DataFrame, by: list[str], truth: str, thresholds: list[float]) -> DataFrame:
    """EV22: (by..., threshold, tp, fp, fn, tn) of every threshold, from one histogram for each group.

    A score falls into the step of the thresholds it reaches; counts at a threshold are
    the sums of the steps from it on. So the number of thresholds multiplies neither the
    rows read nor the rows shuffled.
    """
    cuts = [round(t * UNIT) for t in sorted(thresholds)]
    step = sum((F.when(F.col("score") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    hit = F.col(truth) == 1
    hist = [F.array(*[F.count_if(kind & (F.col("_step") == k)) for k in range(len(cuts) + 1)]).alias(n) for n, kind in (("pos", hit), ("neg", ~hit))]
    found = scored.withColumn("_step", step).groupBy(*by).agg(*hist)
    total = lambda c, low: F.aggregate(F.slice(c, low, len(cuts) + 1), F.lit(0).cast("long"), lambda s, x: s + x)
    found = found.withColumn("_t", F.explode(F.sequence(F.lit(1), F.lit(len(cuts)))))
    level = F.element_at(F.array(*[F.lit(float(t)) for t in sorted(thresholds)]), F.col("_t"))
    tp, fp = total("pos", F.col("_t") + 1), total("neg", F.col("_t") + 1)
    return found.select(*by, level.alias("threshold"), tp.alias("tp"), fp.alias("fp"), (total("pos", F.lit(1)) - tp).alias("fn"), (total("neg", F.lit(1)) - fp).alias("tn"))


def fold_sums(per_video: DataFrame, by: list[str], fold: str) -> DataFrame:
    """Sums of the videos' rates and counts for each setting and fold."""
    rated = with_rates(per_video, 12)
    return rated.groupBy(*by, fold).agg(*[F.sum(F.round(F.col(c) * PICO).cast("long")).alias(f"sum_{c}") for c in RATES], *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], F.count(F.lit(1)).alias("videos"))


def _metrics(sums: DataFrame, by: list[str]) -> DataFrame:
    """Macro (mean over videos) and micro (pooled) rates from sums."""
    micro = PICO // 1_000_000
    macro = {f"macro_{c}": F.expr(f"(2 * sum_{c} + videos * {micro}) div (2 * videos * {micro})") / 1_000_000 for c in RATES}  # half up
    pooled = with_rates(sums.withColumns(macro)).withColumnsRenamed({c: f"micro_{c}" for c in RATES})
    return pooled.select(*by, "videos", *macro, *[f"micro_{c}" for c in RATES], "tp", "fp", "fn", "tn")


def nested_search(sums: DataFrame, by: list[str], fold: str) -> DataFrame:
    """EV21, EV22: for each held-out fold and setting, the metrics over the videos of the other folds.

    The training side of a fold is the total minus the fold, so the folds share every sum.
    ``sums``: ``fold_sums``. The videos' scores should come from inner folds: models that
    have seen neither the video nor, for a held-out fold, anything of it.
    """
    w = Window.partitionBy(*by)
    names = [*(f"sum_{c}" for c in RATES), "tp", "fp", "fn", "tn", "videos"]
    return _metrics(sums.withColumns({c: F.sum(c).over(w) - F.col(c) for c in names}), [fold, *by])


def full_search(sums: DataFrame, by: list[str], fold: str) -> DataFrame:
    """EV23, EV24: the metrics of each setting over all folds, with the sample deviation of the folds' macro F1."""
    names = [*(f"sum_{c}" for c in RATES), "tp", "fp", "fn", "tn", "videos"]
    spread = F.round(F.stddev_samp(F.col("sum_f1") / F.col("videos") / PICO), 6).alias("fold_std")
    total = sums.groupBy(*by).agg(spread, *[F.sum(c).alias(c) for c in names])
    return _metrics(total, by).join(total.select(*by, "fold_std"), by)


def tie_place(aggregation: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in TIE_ORDER]), aggregation)


def select_nested(found: DataFrame, fold: str, alpha: float, aggregation: str, threshold: float) -> DataFrame:
    """EV22, WN11: the setting of each held-out fold: by macro F1, micro F1, then nearness to the given baseline, then a fixed order."""
    order = [
        F.col("macro_f1").desc(), F.col("micro_f1").desc(), (F.col("aggregation") != aggregation).cast("int"),
        F.round(F.abs(F.col("alpha") - alpha), 4), F.round(F.abs(F.col("threshold") - threshold), 4), tie_place(F.col("aggregation")), "alpha", "threshold",
    ]
    return found.withColumn("place", F.row_number().over(Window.partitionBy(fold).orderBy(*order))).where("place = 1").drop("place")


def fold_stability(pairs: DataFrame, fold: str, item: str, by: list[str]) -> DataFrame:
    """EV24: mean and sample deviation of macro F1 over the folds."""
    per_item = with_rates(pairs.groupBy(*by, fold, item).agg(*confusion()), 12)
    per_fold = per_item.groupBy(*by, fold).agg(F.avg("f1").alias("f"))
    return per_fold.groupBy(*by).agg(F.round(F.avg("f"), 6).alias("mean_macro_f1"), F.round(F.stddev_samp("f"), 6).alias("fold_std"), F.count(F.lit(1)).alias("folds"))


def best_settings(found: DataFrame, by: list[str]) -> DataFrame:
    """WN11, ST4, EV23: the first setting by falling macro F1, falling micro F1, rising deviation over the folds, then the order of the search."""
    size = [F.col("chunk_seconds")] if "chunk_seconds" in found.columns else []
    place = F.array_position(F.array(*[F.lit(x) for x in AGGREGATIONS]), F.col("aggregation"))
    order = [F.col("macro_f1").desc(), F.col("micro_f1").desc(), F.col("fold_std"), *size, F.col("alpha"), place, F.col("threshold")]
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("place = 1").drop("place")


def local_sensitivity(found: DataFrame) -> DataFrame:
    """EV26, WN12: the best setting's neighbours: one parameter changed to the next value up or down, or to another aggregation."""
    best = best_settings(found, []).select(*[F.col(c).alias(f"_{c}") for c in ("alpha", "aggregation", "threshold", "macro_f1")])
    steps = {c: [r[0] for r in found.select(c).distinct().orderBy(c).collect()] for c in ("alpha", "threshold")}  # the values searched
    place = lambda c, values: F.array_position(F.array(*[F.lit(v) for v in values]), c)
    near = found.join(F.broadcast(best))
    same = {c: F.col(c) == F.col(f"_{c}") for c in ("alpha", "aggregation", "threshold")}
    moved = {c: F.abs(place(F.col(c), v) - place(F.col(f"_{c}"), v)) == 1 for c, v in steps.items()} | {"aggregation": ~same["aggregation"]}
    out = []
    for name in same:
        others = [same[c] for c in same if c != name]
        met = near.where(moved[name] & others[0] & others[1])
        out.append(met.select(F.lit(name).alias("parameter"), F.col(f"_{name}").cast("string").alias("from_value"), F.col(name).cast("string").alias("to_value"), "macro_f1", F.round(F.col("macro_f1") - F.col("_macro_f1"), 6).alias("delta")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def boundary_flags(found: DataFrame) -> DataFrame:
    """EV27: whether the best setting lies at an end of the searched range."""
    ends = found.agg(*[f(c).alias(f"{n}_{c}") for c in ("alpha", "threshold") for n, f in (("lo", F.min), ("hi", F.max))])
    flags = [((F.col(c) == F.col(f"lo_{c}")) | (F.col(c) == F.col(f"hi_{c}"))).alias(f"{c}_at_end") for c in ("alpha", "threshold")]
    return best_settings(found, []).join(F.broadcast(ends)).select("alpha", "aggregation", "threshold", *flags)


def plateau(found: DataFrame, margins: tuple[float, ...] = (0.005, 0.01, 0.02)) -> DataFrame:
    """AG22: settings within a margin of the best."""
    best = found.agg(F.max("macro_f1").alias("_best"))
    near = lambda m: F.count_if(F.round(F.col("_best") - F.col("macro_f1"), 9) <= m)
    return found.join(F.broadcast(best)).agg(F.count(F.lit(1)).alias("settings"), *[near(m).alias(f"within_{str(m).replace('.', '_')}") for m in margins])
