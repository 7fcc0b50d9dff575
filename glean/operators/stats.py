
from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glean.functions.numeric import safe_divide
from glean.operators.ranking import exact_quantiles


#: 32-bit numbers that one hash gives.
DRAWS_PER_HASH = 4
#: Draws and places of a stratum that meet in one task, and hashes made at once there.
DRAW_PART, TILE, HASHES = 200, 1 << 20, 1 << 15


def bootstrap_sums(values: DataFrame, stratum: str, place: str, metrics: list[str], draws: int, seed: str, tile: int = TILE) -> DataFrame:
    """EV13, EV14: (draw, n, one sum for each metric) of stratified resamples that all metrics share.

    Every stratum is drawn from as often as it has rows; ``place`` numbers the rows of a
    stratum from 0. A hash of (seed, stratum, draw, block of slots) gives four places. Draws
    are dealt out in parts, and the values of a stratum are copied to each part, so a drawn
    place is never a row: a task counts how often a draw meets each of its places and sends
    on the sums. A stratum of more than ``tile`` rows is cut into tiles; each goes through
    all places drawn and keeps its own. ``values`` is read twice.
    """
    sizes = values.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // DRAW_PART)))
    spread = values.join(sizes, stratum).select(F.col(stratum).cast("string").alias("_stratum"), F.col("_n"), F.col(place).cast("long").alias("_place"), *metrics, F.floor(F.col(place) / tile).cast("long").alias("_tile"), parts.alias("_part"))
    kinds = {m: "double" if dict(values.dtypes)[m] in ("double", "float") else "long" for m in metrics}
    schema = ", ".join(["draw int", "n long", *(f"`{m}` {k}" for m, k in kinds.items())])
    keys = ["_stratum", "_tile", "_part"]  # a number of partitions is kept: these rows are few, but each means much work
    spread = spread.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    met = spread.groupBy(*keys).applyInArrow(_resampled(metrics, kinds, draws, seed, tile), schema)
    return met.groupBy("draw").agg(F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in metrics])


def _resampled(metrics: list[str], kinds: dict[str, str], draws: int, seed: str, tile: int):
    """Sums of one part of the draws over one tile of a stratum."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        stratum, at, part = (k.as_py() for k in key)
        n, low = table.column("_n")[0].as_py(), at * tile
        order = np.asarray(table.column("_place")) - low
        of_part = range(part * DRAW_PART, min((part + 1) * DRAW_PART, draws))
        found = []
        for m in metrics:
            whole = np.zeros(min(tile, n - low), np.float64 if kinds[m] == "double" else np.int64)
            whole[order] = np.asarray(pc.fill_null(table.column(m), 0))
            if whole.dtype == np.int64 and len(whole) and int(np.abs(whole).max()) * n >= 1 << 63:
                raise OverflowError(f"sums of {m} may pass 64 bits")
            found.append(whole)
        here = np.bincount(order, minlength=len(found[0]) if found else min(tile, n - low))
        met, sums = np.zeros(len(of_part), np.int64), [np.zeros(len(of_part), x.dtype) for x in found]
        blocks = (n + DRAWS_PER_HASH - 1) // DRAWS_PER_HASH
        for first in range(0, blocks, HASHES):
            slots = [b"%d" % k for k in range(first, min(first + HASHES, blocks))]
            for i, draw in enumerate(of_part):
                start = f"{seed}-{stratum}-{draw}-".encode()
                drawn = np.frombuffer(b"".join([md5(start + s, usedforsecurity=False).digest() for s in slots]), ">u4")
                drawn = drawn[: n - first * DRAWS_PER_HASH].astype(np.int64) % n - low
                times = np.bincount(drawn[(drawn >= 0) & (drawn < len(here))], minlength=len(here))
                met[i] += times @ here
                for total, x in zip(sums, found):
                    total[i] += times @ x
        return pa.table({"draw": pa.array(of_part, pa.int32()), "n": met, **dict(zip(metrics, sums))})

    return run


def interval(means: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """MA13: the mean and the interval's ends, by linear interpolation; a row for each draw, whose number is a parameter."""
    tail = (1 - level) / 2
    ends = [F.round(F.percentile(value, F.lit(q)), 6).alias(n) for q, n in ((tail, "ci_low"), (1 - tail, "ci_high"))]
    return means.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), *ends, F.count(F.lit(1)).alias("draws"))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """AG10, AG15: mean, sample deviation, exact median, extremes. No buffer holds a group's values."""
    named = {"mean": F.avg(value), "std": F.stddev_samp(value), "min": F.min(value), "max": F.max(value)}
    plain = df.groupBy(*by).agg(F.count(value).alias("n"), *[F.round(c, 6).alias(k) for k, c in named.items()])
    middle = exact_quantiles(df, by, value, {"median": 0.5}).withColumnsRenamed({c: f"_k_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return plain.join(middle, same, "left").withColumn("median", F.round("median", 6)).drop(*[f"_k_{c}" for c in by])


def win_tie_loss(delta: Column, tolerance: float = 1e-12) -> list[Column]:
    """AG18."""
    return [F.count_if(delta > tolerance).alias("wins"), F.count_if(F.abs(delta) <= tolerance).alias("ties"), F.count_if(delta < -tolerance).alias("losses")]


def paired_t(df: DataFrame, by: list[str], delta: str) -> DataFrame:
    """EV16, EV17: t statistic and Cohen's dz of paired differences; 0 without spread."""
    mean, sd, n = F.avg(delta), F.stddev_samp(delta), F.count(delta)
    dz = safe_divide(mean, sd)
    return df.groupBy(*by).agg(n.alias("n"), F.round(mean, 6).alias("mean_delta"), F.round(dz * F.sqrt(n), 6).alias("t_stat"), F.round(dz, 6).alias("cohen_dz"))


def wilcoxon(df: DataFrame, by: list[str], delta: str) -> DataFrame:
    """EV15: rank sums of the nonzero differences with average ranks (WN9), and the tie-corrected z without continuity term."""
    some = df.where(F.col(delta) != 0).withColumn("size", F.abs(delta))
    tied = some.groupBy(*by, "size").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(delta) > 0).alias("up"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = tied.withColumn("rank", before + (F.col("n") + 1) / 2)
    found = ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w_plus"), F.sum((F.col("n") - F.col("up")) * F.col("rank")).alias("w_minus"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("_ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48.0)
    statistic = F.least("w_plus", "w_minus")
    return found.withColumn("statistic", statistic).withColumn("z", F.round(safe_divide(statistic - n * (n + 1) / 4, spread), 6)).drop("_ties")


def normal_p(z: float) -> float:
    """Two-sided p of a normal statistic."""
    return math.erfc(abs(z) / math.sqrt(2))


def student_p(t: float, df: int) -> float:
    """Two-sided p of a t statistic, by integrating its density after a change of variable."""
    if df < 1 or not math.isfinite(t):
        return float("nan")
    # with t = sqrt(df) tan(u) the tail is an integral of cos(u) ** (df - 1)
    u0 = math.atan(abs(t) / math.sqrt(df))
    grid = np.linspace(u0, math.pi / 2, 20_001)
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return float(min(1.0, 2 * scale * np.trapezoid(np.cos(grid) ** (df - 1), grid)))


def mcnemar_counts(df: DataFrame, by: list[str], truth: str, first: str, second: str) -> DataFrame:
    """EV18: pairs that only one of two methods gets right."""
    a, b = F.col(first) == F.col(truth), F.col(second) == F.col(truth)
    return df.groupBy(*by).agg(F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"), F.count_if(a & b).alias("both_right"), F.count_if(~a & ~b).alias("both_wrong"))


def mcnemar_p(only_first: int, only_second: int) -> float:
    """Exact two-sided p from the discordant counts."""
    n, k = only_first + only_second, min(only_first, only_second)
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def bootstrap_ci_numpy(strata: list[np.ndarray], draws: int, seed: int | np.random.Generator, method: str = "choice", level: float = 0.95) -> tuple[float, float]:
    """EV13 on a small table with the generator of the published figures: one resample of every stratum in turn for each draw.

    ``method``: ``choice`` draws values, ``integers`` draws places.
    """
    made = np.random.default_rng(seed) if isinstance(seed, int) else seed
    means = np.empty(draws)
    for d in range(draws):
        some = [made.choice(s, size=len(s), replace=True) if method == "choice" else s[made.integers(0, len(s), size=len(s))] for s in strata]
        means[d] = np.concatenate(some).mean()
    tail = (1 - level) / 2
    return tuple(float(x) for x in np.quantile(means, [tail, 1 - tail]))
