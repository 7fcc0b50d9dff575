"""The search for settings: fusion weight, aggregation, threshold and chunk size, over folds of whole videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glean.functions import text as X
from glean.operators import evaluate, scoring, stats, temporal, tuning
from glean.operators.ranking import ranked_within
from glean.plans.chunk_queries import JACCARD_SQL, NAME_WORDS, SEGMENTS_SQL, STOP_WORDS, TOKENS_SQL, concepts, segments
from glean.plans.config import LOCKED, PILOT, PipelineConfig
from glean.plans.model_queries import FOLDS, _VIDEO_FOLDS_SQL, video_folds
from glean.plans.registry import query
from glean.sources.scratch import stored

ALPHAS = [round(k / 10, 1) for k in range(11)]
THRESHOLDS = [round(0.2 + 0.05 * k, 2) for k in range(11)]
SIZES = [30, 60, 90, 120]
INNER = 4
#: Per cent of a concept's tokens that a whole conversation holds where the concept counts as covered.
COVERED = 10

_KEYS = "chunk_seconds, video_id, chunk_id"
_MM = "CASE WHEN max({0}) OVER w = min({0}) OVER w THEN 0.0 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"


def _values(xs: list) -> str:
    return ", ".join(f"({x})" for x in xs)


def _scored_sql(sizes: list[int], text: str = "text") -> str:
    """Chunks of every size with normalised scores (nm), truth of each video and concept (tr), and folds (vf)."""
    return f"""{SEGMENTS_SQL}, {_VIDEO_FOLDS_SQL},
grid AS (SELECT c AS chunk_seconds, video_id, unnest(range(0, (floor(max(end_sec) / c) + 1)::bigint)) AS chunk_id FROM seg, (VALUES {_values(sizes)}) v(c) GROUP BY c, video_id),
chunk AS (SELECT g.chunk_seconds, g.video_id, g.chunk_id, count(*) AS n_segments, string_agg(text, ' ' ORDER BY start_sec, text) AS raw_text FROM grid g JOIN seg s ON s.video_id = g.video_id AND s.start_sec < (g.chunk_id + 1) * g.chunk_seconds AND s.end_sec >= g.chunk_id * g.chunk_seconds GROUP BY ALL),
tok AS (SELECT {_KEYS}, list_distinct({TOKENS_SQL.format("raw_text")}) AS a FROM chunk),
concept AS (SELECT item_id AS concept, item_id % 4 AS subject, list_distinct({TOKENS_SQL.format(text)}) AS b FROM benchmark),
whole AS (SELECT video_id, list_distinct({TOKENS_SQL.format("string_agg(text, ' ')")}) AS a FROM seg GROUP BY video_id),
tr AS (SELECT video_id, concept, (len(b) > 0 AND 100 * len(list_intersect(a, b)) >= {COVERED} * len(b))::int AS y_true FROM whole JOIN concept ON video_id % 4 = subject),
sc AS (SELECT {_KEYS}, concept, {JACCARD_SQL.format("a", "b")} AS lda_score, CASE WHEN len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::double / len(b) END AS lsa_score FROM tok JOIN concept ON video_id % 4 = subject WHERE len(a) > 0),
nm AS (SELECT {_KEYS}, concept, {_MM.format("lda_score")} AS lda_norm, {_MM.format("lsa_score")} AS lsa_norm FROM sc WINDOW w AS (PARTITION BY {_KEYS}))"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Segments with their tokens ``w``. No token crosses a space, so the tokens of joined texts are those of the texts."""
    return segments(spark, d).withColumn("w", F.array_distinct(X.content_tokens(X.clean_text(F.col("text")), STOP_WORDS))).drop("text")


def _union() -> F.Column:
    return F.array_distinct(F.flatten(F.collect_list("w"))).alias("a")


def sized_chunks(spark: SparkSession, d: str, sizes: list[int]) -> DataFrame:
    """(chunk_seconds, video_id, chunk_id, n_segments, a, subject): chunks of every size from one plan, with their tokens."""
    each = _words(spark, d).withColumn("chunk_seconds", F.explode(F.array(*[F.lit(c) for c in sizes])))
    found = temporal.overlap_members(each, F.col("chunk_seconds")).groupBy("chunk_seconds", "video_id", "chunk_id").agg(_union(), F.count(F.lit(1)).alias("n_segments"))
    return found.select("chunk_seconds", "video_id", "chunk_id", "n_segments", "a", (F.col("video_id") % 4).alias("subject"))


def truth(spark: SparkSession, d: str, mode: str = "name+description") -> DataFrame:
    """(video_id, concept, y_true): whether a whole conversation covers a concept of its subject."""
    whole = _words(spark, d).groupBy("video_id").agg(_union()).withColumn("subject", F.col("video_id") % 4)
    met = scoring.set_overlap(whole, ["video_id"], "a", concepts(spark, d, mode), ["concept"], "b", "subject")
    covered = (F.col("n_b") > 0) & (100 * F.col("common") >= COVERED * F.col("n_b"))
    return met.select("video_id", "concept", covered.cast("int").alias("y_true"))


def _met(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Join with rows that tasks made, one for each pair. Spark takes them for as few as the rows they were made of, so it may not choose to broadcast them."""
    return left.join(right.hint("merge"), on)


def _folded_truth(spark: SparkSession, d: str) -> DataFrame:
    """The truth with the fold of each video."""
    return _met(truth(spark, d), _folds(spark, d), "video_id")


def _folds(spark: SparkSession, d: str) -> DataFrame:
    videos = segments(spark, d).select(F.col("video_id").alias("conv_id"), (F.col("video_id") % 4).alias("subject"))
    return video_folds(videos).withColumnRenamed("conv_id", "video_id")


def normed_scores(spark: SparkSession, d: str, sizes: list[int], mode: str = "name+description") -> DataFrame:
    some = sized_chunks(spark, d, sizes).where(F.size("a") > 0)
    return scoring.overlap_scores(some, ["chunk_seconds", "video_id", "chunk_id"], "a", concepts(spark, d, mode), ["concept"], "b", "subject", normed=True)


def _counts(spark: SparkSession, d: str, sizes: list[int], known: DataFrame, of_video: list[str], alphas: list[float], thresholds: list[float]) -> DataFrame:
    """Counts of every setting and video; ``known``: the truth, with the columns ``of_video`` of each video."""
    scored = _met(normed_scores(spark, d, sizes), known, ["video_id", "concept"])
    return tuning.setting_counts(scored, ["chunk_seconds", *of_video], "video_id", "concept", "y_true", alphas, thresholds)


def _sums(spark: SparkSession, d: str, sizes: list[int], more: DataFrame | None = None) -> DataFrame:
    """Sums of rates and counts of every setting and fold; written once, as each search reads them several times."""
    counts = _counts(spark, d, sizes, _folded_truth(spark, d), ["fold"], ALPHAS, THRESHOLDS)
    return stored(tuning.fold_sums(counts, ["chunk_seconds", "alpha", "aggregation", "threshold"], "fold"), "search")


_HALF_UP = "((2 * list_sum({0}) + len({0})) // (2 * len({0})))::bigint"
_RATES = "round(coalesce(({0})::double / nullif({1}, 0), 0.0), {2})"
_F1, _P, _R = ("2 * tp", "2 * tp + fp + fn"), ("tp", "tp + fp"), ("tp", "tp + fn")


def _search_sql(sizes: list[int]) -> str:
    """One row for each setting and video (pv), with its fold."""
    return f"""{_scored_sql(sizes)},
fa AS (SELECT {_KEYS}, concept, alpha, round(round(alpha * lda_norm + (1 - alpha) * lsa_norm, 9) * {tuning.UNIT})::bigint AS s FROM nm, (SELECT x::double AS alpha FROM (VALUES {_values(ALPHAS)}) v(x))),
ga AS (SELECT chunk_seconds, video_id, concept, alpha, list_sort(list(s), 'DESC') AS xs FROM fa GROUP BY ALL),
va AS (SELECT chunk_seconds, video_id, concept, alpha, aggregation, CASE aggregation WHEN 'max' THEN xs[1] WHEN 'mean' THEN {_HALF_UP.format("xs")} WHEN 'top2_mean' THEN {_HALF_UP.format("xs[1:2]")} ELSE {_HALF_UP.format("xs[1:3]")} END AS score FROM ga, (VALUES ('max'), ('mean'), ('top2_mean'), ('top3_mean')) v(aggregation)),
pc AS (SELECT chunk_seconds, alpha, aggregation, threshold, video_id, count(*) FILTER (y_true = 1 AND score >= cut) AS tp, count(*) FILTER (y_true <> 1 AND score >= cut) AS fp, count(*) FILTER (y_true = 1 AND score < cut) AS fn, count(*) FILTER (y_true <> 1 AND score < cut) AS tn FROM va JOIN tr USING (video_id, concept), (SELECT x::double AS threshold, round(x * {tuning.UNIT})::bigint AS cut FROM (VALUES {_values(THRESHOLDS)}) v(x)) GROUP BY ALL),
pv AS (SELECT pc.*, fold, {_RATES.format(*_P, 12)} AS p, {_RATES.format(*_R, 12)} AS r, {_RATES.format(*_F1, 12)} AS f FROM pc JOIN vf ON conv_id = video_id)"""


_MACRO = "(2 * sum(round({0} * 1e12)::bigint) + count(*) * 1000000) // (2 * count(*) * 1000000) / 1e6"
_METRICS = f"count(*) AS videos, {_MACRO.format('p')} AS macro_precision, {_MACRO.format('r')} AS macro_recall, {_MACRO.format('f')} AS macro_f1, sum(tp)::bigint AS tp, sum(fp)::bigint AS fp, sum(fn)::bigint AS fn, sum(tn)::bigint AS tn"
_MICRO = f"{_RATES.format(*_P, 6)} AS micro_precision, {_RATES.format(*_R, 6)} AS micro_recall, {_RATES.format(*_F1, 6)} AS micro_f1"
_SETTING = "alpha, aggregation, threshold"
_NESTED_SQL = f"WITH {_search_sql([PILOT.chunk_seconds])}, no AS (SELECT o.fold, {_SETTING}, {_METRICS} FROM (SELECT DISTINCT fold FROM vf) o JOIN pv ON pv.fold <> o.fold GROUP BY ALL), ns AS (SELECT *, {_MICRO} FROM no)"


def _full_sql(sizes: list[int]) -> str:
    return f"WITH {_search_sql(sizes)}, fo AS (SELECT chunk_seconds, {_SETTING}, round(stddev_samp(f), 6) AS fold_std FROM (SELECT chunk_seconds, {_SETTING}, fold, avg(f) AS f FROM pv GROUP BY ALL) GROUP BY ALL), su AS (SELECT chunk_seconds, {_SETTING}, {_METRICS} FROM pv GROUP BY ALL), gr AS (SELECT su.*, {_MICRO}, fold_std FROM su JOIN fo USING (chunk_seconds, {_SETTING})), gb AS (SELECT * FROM gr ORDER BY macro_f1 DESC, micro_f1 DESC, fold_std, chunk_seconds, alpha, list_position(['max', 'mean', 'top2_mean', 'top3_mean'], aggregation), threshold LIMIT 1)"


@query(f"{_NESTED_SQL} SELECT * FROM ns")
def nested_search(spark: SparkSession, d: str) -> DataFrame:
    """EV21, EV22: 484 settings for each of five held-out folds, over the videos of the other four."""
    return tuning.nested_search(_sums(spark, d, [PILOT.chunk_seconds]).drop("chunk_seconds"), ["alpha", "aggregation", "threshold"], "fold")


@query(f"{_NESTED_SQL} SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY macro_f1 DESC, micro_f1 DESC, aggregation <> '{PILOT.aggregation}', round(abs(alpha - {PILOT.alpha}), 4), round(abs(threshold - {PILOT.threshold}), 4), list_position({list(tuning.TIE_ORDER)}, aggregation), alpha, threshold) AS k FROM ns) WHERE k = 1")
def nested_selection(spark: SparkSession, d: str) -> DataFrame:
    """EV22, WN11: the setting that each held-out fold's training side chooses."""
    return tuning.select_nested(nested_search(spark, d), "fold", PILOT.alpha, PILOT.aggregation, PILOT.threshold)


@query(f"WITH {_VIDEO_FOLDS_SQL}, o AS (SELECT DISTINCT fold AS outer_fold FROM vf) SELECT outer_fold, conv_id AS video_id, ((row_number() OVER (PARTITION BY outer_fold, conv_id % 4 ORDER BY md5('inner-' || outer_fold || '-' || conv_id), conv_id) - 1) % {INNER})::int AS inner_fold FROM o JOIN vf ON fold <> outer_fold")
def inner_folds(spark: SparkSession, d: str) -> DataFrame:
    """EV21: the videos outside each held-out fold dealt into inner folds of their own, evenly within each subject."""
    outer = _folds(spark, d).withColumn("outer_fold", F.explode(F.array(*[F.lit(k) for k in range(FOLDS)]))).where("fold <> outer_fold").drop("fold")
    order = F.struct(F.md5(F.concat_ws("-", F.lit("inner"), F.col("outer_fold").cast("string"), F.col("video_id").cast("string")).cast("binary")), "video_id")
    dealt = tuning.stratified_folds(outer.withColumn("subject", F.col("video_id") % 4), ["outer_fold", "subject"], order, INNER)
    return dealt.select("outer_fold", "video_id", (F.col("fold") - 1).cast("int").alias("inner_fold"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return tuning.full_search(_sums(spark, d, [PILOT.chunk_seconds]), ["chunk_seconds", "alpha", "aggregation", "threshold"], "fold").drop("chunk_seconds")


_GRID_SQL = _full_sql([PILOT.chunk_seconds])


@query(f"{_GRID_SQL} SELECT * EXCLUDE (chunk_seconds) FROM gr")
def grid_search(spark: SparkSession, d: str) -> DataFrame:
    """EV22, EV24: all 484 settings over all videos."""
    return _grid(spark, d)


@query(f"{_full_sql(SIZES)} SELECT * FROM gr")
def full_search(spark: SparkSession, d: str) -> DataFrame:
    """EV23, EV24: 1,936 settings: the grid for four chunk sizes, with the deviation over the folds."""
    return tuning.full_search(_sums(spark, d, SIZES), ["chunk_seconds", "alpha", "aggregation", "threshold"], "fold")


@query(f"{_full_sql(SIZES)} SELECT * FROM gb")
def final_config(spark: SparkSession, d: str) -> DataFrame:
    """EV23, EV24: the one setting chosen of all."""
    return tuning.best_settings(full_search(spark, d), [])


@query(f"{_GRID_SQL} SELECT * EXCLUDE (chunk_seconds) FROM gb")
def best_config(spark: SparkSession, d: str) -> DataFrame:
    """WN11, ST4, EV24."""
    return tuning.best_settings(_grid(spark, d), [])


_NEXT = "abs(list_position({0}, x.{1}) - list_position({0}, b.{1})) = 1"


@query(
    f"{_GRID_SQL} SELECT 'alpha' AS parameter, b.alpha::varchar AS from_value, x.alpha::varchar AS to_value, x.macro_f1, round(x.macro_f1 - b.macro_f1, 6) AS delta FROM gr x, gb b WHERE x.aggregation = b.aggregation AND x.threshold = b.threshold AND {_NEXT.format(ALPHAS, 'alpha')} "
    f"UNION ALL SELECT 'threshold', b.threshold::varchar, x.threshold::varchar, x.macro_f1, round(x.macro_f1 - b.macro_f1, 6) FROM gr x, gb b WHERE x.aggregation = b.aggregation AND x.alpha = b.alpha AND {_NEXT.format(THRESHOLDS, 'threshold')} "
    "UNION ALL SELECT 'aggregation', b.aggregation, x.aggregation, x.macro_f1, round(x.macro_f1 - b.macro_f1, 6) FROM gr x, gb b WHERE x.alpha = b.alpha AND x.threshold = b.threshold AND x.aggregation <> b.aggregation"
)
def local_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """EV26, WN12."""
    return tuning.local_sensitivity(_grid(spark, d))


@query(f"{_GRID_SQL} SELECT alpha, aggregation, threshold, alpha IN ({ALPHAS[0]}, {ALPHAS[-1]}) AS alpha_at_end, threshold IN ({THRESHOLDS[0]}, {THRESHOLDS[-1]}) AS threshold_at_end FROM gb")
def boundary_flags(spark: SparkSession, d: str) -> DataFrame:
    """EV27."""
    return tuning.boundary_flags(_grid(spark, d))


@query(f"{_GRID_SQL}, m AS (SELECT max(macro_f1) AS best FROM gr) SELECT count(*) AS settings, count(*) FILTER (round(best - macro_f1, 9) <= 0.005) AS within_0_005, count(*) FILTER (round(best - macro_f1, 9) <= 0.01) AS within_0_01, count(*) FILTER (round(best - macro_f1, 9) <= 0.02) AS within_0_02 FROM gr, m")
def plateau(spark: SparkSession, d: str) -> DataFrame:
    """AG22."""
    return tuning.plateau(_grid(spark, d))


def _sized_predictions(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_seconds, video_id, fold, subject, tp, fp, fn, tn) at the pilot's setting."""
    known = _folded_truth(spark, d).withColumn("subject", F.col("video_id") % 4)
    return _counts(spark, d, SIZES, known, ["fold", "subject"], [PILOT.alpha], [PILOT.threshold]).where(F.col("aggregation") == PILOT.aggregation)


_PILOT_SQL = f"pp AS (SELECT pv.*, video_id % 4 AS subject FROM pv WHERE alpha = {PILOT.alpha} AND aggregation = '{PILOT.aggregation}' AND threshold = {PILOT.threshold})"
_SIZED_SQL = f"WITH {_search_sql(SIZES)}, {_PILOT_SQL}"


@query(f"{_SIZED_SQL}, ck AS (SELECT chunk_seconds, count(*) AS num_chunks, sum(n_segments)::bigint AS memberships FROM chunk GROUP BY 1), me AS (SELECT chunk_seconds, {_METRICS} FROM pp GROUP BY 1) SELECT chunk_seconds, num_chunks, memberships, me.* EXCLUDE (chunk_seconds), {_MICRO} FROM ck JOIN me USING (chunk_seconds)")
def chunk_size_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """EV25: chunks, and macro and micro rates at the pilot's setting, for each chunk size; the size is a grouping column from chunking on."""
    sizes = sized_chunks(spark, d, SIZES).groupBy("chunk_seconds").agg(F.count(F.lit(1)).alias("num_chunks"), F.sum("n_segments").alias("memberships"))
    sums = tuning.fold_sums(_sized_predictions(spark, d).withColumn("all", F.lit(0)), ["chunk_seconds"], "all")
    return sizes.join(tuning._metrics(sums, ["chunk_seconds"]), "chunk_seconds")


@query(f"{_SIZED_SQL}, lv AS (SELECT chunk_seconds, 'fold' AS kind, fold AS part, p, r, f, tp, fp, fn, tn FROM pp UNION ALL SELECT chunk_seconds, 'subject', subject, p, r, f, tp, fp, fn, tn FROM pp), me AS (SELECT chunk_seconds, kind, part, {_METRICS} FROM lv GROUP BY 1, 2, 3) SELECT *, {_MICRO} FROM me")
def chunk_size_parts(spark: SparkSession, d: str) -> DataFrame:
    """EV25: the same for each fold and each subject."""
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("long").alias("part")) for c in ("fold", "subject")]))
    each = _sized_predictions(spark, d).withColumn("_k", kinds).select("chunk_seconds", "_k.kind", "_k.part", "tp", "fp", "fn", "tn")
    return tuning._metrics(tuning.fold_sums(each, ["chunk_seconds", "kind"], "part"), ["chunk_seconds", "kind", "part"])


#: The two methods that are compared: the pilot's setting and the locked one.
_METHODS = {"pilot": PILOT, "locked": LOCKED}
DRAWS, SEED = 10_000, "boot-42"


def per_video(spark: SparkSession, d: str) -> DataFrame:
    """(video_id, stratum, place, and precision, recall and F1 of both methods in units of tuning.PICO) at the pilot's chunk size."""
    methods = _METHODS.values()
    picked = [(F.col("alpha") == c.alpha) & (F.col("aggregation") == c.aggregation) for c in methods]
    counts = _counts(spark, d, [PILOT.chunk_seconds], truth(spark, d), [], [c.alpha for c in methods], [c.threshold for c in methods]).where(picked[0] | picked[1])
    rates = evaluate.with_rates(counts, 12)
    wide = rates.groupBy("video_id").agg(*[F.max(F.when(p & (F.col("threshold") == c.threshold), F.round(F.col(r) * tuning.PICO).cast("long"))).alias(f"{n}_{r}") for p, (n, c) in zip(picked, _METHODS.items()) for r in tuning.RATES])
    ranked = ranked_within(wide.withColumn("stratum", F.col("video_id") % 4), ["stratum"], F.col("video_id"))
    return ranked.withColumn("place", F.col("place") - 1)


_WIDE = ", ".join(f"max(CASE WHEN alpha = {c.alpha} AND aggregation = '{c.aggregation}' AND threshold = {c.threshold} THEN round({r[0]} * 1e12)::bigint END) AS {n}_{r}" for n, c in _METHODS.items() for r in tuning.RATES)
_PER_VIDEO_SQL = f"{_search_sql([PILOT.chunk_seconds])}, wi AS (SELECT video_id, {_WIDE} FROM pv GROUP BY 1), st AS (SELECT *, video_id % 4 AS stratum, (row_number() OVER (PARTITION BY video_id % 4 ORDER BY video_id) - 1)::int AS place FROM wi)"
_BOOT_SQL = (
    f"{_PER_VIDEO_SQL}, n AS (SELECT stratum, count(*) AS n FROM st GROUP BY 1), bl AS (SELECT stratum, n, draw, unnest(range((n - 1) // 4 + 1)) AS block FROM n, range({DRAWS}) t(draw)), dg AS (SELECT *, md5('{SEED}-' || stratum || '-' || draw || '-' || block) AS h FROM bl), "
    "pk AS (SELECT stratum, draw, (('0x' || substr(h, 1 + 8 * k, 8))::bigint % n)::int AS place FROM dg, (VALUES (0), (1), (2), (3)) v(k) WHERE block * 4 + k < n)"
)
_NAMES = [f"{n}_{r}" for n in _METHODS for r in tuning.RATES]


@query(f"WITH {_PER_VIDEO_SQL} SELECT video_id, stratum, place, {', '.join(f'round({n} / 1e12, 6) AS {n}' for n in _NAMES)} FROM st")
def per_video_metrics(spark: SparkSession, d: str) -> DataFrame:
    """EV9: each video's rates under the pilot's and the locked setting."""
    return per_video(spark, d).select("video_id", "stratum", "place", *[F.round(F.col(n) / tuning.PICO, 6).alias(n) for n in _NAMES])


def _long(wide: DataFrame, more: list[str]) -> DataFrame:
    """One row for each method and rate; values in units of 1."""
    return wide.unpivot(more, _NAMES, "name", "units").select(*more, F.substring_index("name", "_", 1).alias("method"), F.substring_index("name", "_", -1).alias("metric"), "units")


@query(
    f"WITH {_BOOT_SQL}, m AS (SELECT draw, {', '.join(f'sum({n})::double / count(*) / 1e12 AS {n}' for n in _NAMES)} FROM pk JOIN st USING (stratum, place) GROUP BY draw), "
    f"lm AS (UNPIVOT m ON {', '.join(_NAMES)} INTO NAME name VALUE x), lv AS (UNPIVOT (SELECT {', '.join(f'{n} / 1e12 AS {n}' for n in _NAMES)} FROM st) ON {', '.join(_NAMES)} INTO NAME name VALUE x), "
    "ci AS (SELECT name, round(quantile_cont(x, 0.025), 6) AS ci_low, round(quantile_cont(x, 0.975), 6) AS ci_high, count(*) AS draws FROM lm GROUP BY 1), sm AS (SELECT name, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(quantile_cont(x, 0.5), 6) AS median FROM lv GROUP BY 1) "
    "SELECT split_part(name, '_', 1) AS method, split_part(name, '_', 2) AS metric, n, mean, std, median, ci_low, ci_high, draws FROM sm JOIN ci USING (name)"
)
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """EV13, MA13: mean, deviation, median and interval of every rate of both methods, from 10,000 stratified draws of videos."""
    videos = stored(per_video(spark, d), "videos")
    sums = stats.bootstrap_sums(videos, "stratum", "place", _NAMES, DRAWS, SEED)
    means = _long(sums, ["draw", "n"]).withColumn("mean", F.col("units") / F.col("n") / tuning.PICO)
    found = stats.interval(means, ["method", "metric"], "mean").drop("mean")
    plain = stats.summary(_long(videos, ["video_id"]).withColumn("value", F.col("units") / tuning.PICO), ["method", "metric"], "value")
    return plain.drop("min", "max").join(found, ["method", "metric"])


@query(f"WITH {_BOOT_SQL}, m AS (SELECT draw, (sum(locked_f1) - sum(pilot_f1))::double / count(*) / 1e12 AS delta FROM pk JOIN st USING (stratum, place) GROUP BY draw) SELECT round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.025), 6) AS ci_low, round(quantile_cont(delta, 0.975), 6) AS ci_high, count(*) AS draws, count(*) FILTER (delta > 0) AS draws_above_0 FROM m")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """EV14: the interval of the difference in macro F1; both methods are measured on the same draws."""
    sums = stats.bootstrap_sums(stored(per_video(spark, d), "videos"), "stratum", "place", ["pilot_f1", "locked_f1"], DRAWS, SEED)
    deltas = stored(sums.select("draw", ((F.col("locked_f1") - F.col("pilot_f1")) / F.col("n") / tuning.PICO).alias("delta")), "deltas")
    above = deltas.agg(F.count_if(F.col("delta") > 0).alias("draws_above_0"))
    return stats.interval(deltas, [], "delta").join(F.broadcast(above))


def predictions(spark: SparkSession, d: str, config: PipelineConfig) -> DataFrame:
    """(video_id, concept, score, y_true, y_pred): a whole run under one configuration, every field of which counts but the fit's scope."""
    found = tuning.video_scores(normed_scores(spark, d, [config.chunk_seconds], config.concept_text_mode), [], "video_id", "concept", [config.alpha], mode=config.round_mode)
    found = _met(found.where(F.col("aggregation") == config.aggregation), truth(spark, d, config.concept_text_mode), ["video_id", "concept"])
    return found.select("video_id", "concept", (F.col("score") / tuning.UNIT).alias("score"), "y_true", (F.col("score") >= round(config.threshold * tuning.UNIT)).cast("int").alias("y_pred"))


def _run_sql(c: PipelineConfig) -> str:
    text = f"array_to_string(string_split(text, ' ')[1:{NAME_WORDS}], ' ')" if c.concept_text_mode == "name" else "text"
    rounding = "round_even" if c.round_mode == "half_even" else "round"
    best = "xs" if c.aggregation == "mean" else f"xs[1:{ {'max': 1, 'top2_mean': 2, 'top3_mean': 3}[c.aggregation] }]"
    half = "AND (s // n) % 2 = 1" if c.round_mode == "half_even" else ""
    return f"""WITH {_scored_sql([c.chunk_seconds], text)},
fa AS (SELECT video_id, concept, {rounding}(round({c.alpha} * lda_norm + {1 - c.alpha} * lsa_norm, 9) * {tuning.UNIT}, 0)::bigint AS s FROM nm),
ga AS (SELECT video_id, concept, list_sum({best})::bigint AS s, len({best}) AS n FROM (SELECT video_id, concept, list_sort(list(s), 'DESC') AS xs FROM fa GROUP BY ALL)),
va AS (SELECT video_id, concept, s // n + (2 * (s % n) > n OR (2 * (s % n) = n {half}))::int AS score FROM ga)
SELECT video_id, concept, score / {tuning.UNIT} AS score, y_true, (score >= {round(c.threshold * tuning.UNIT)})::int AS y_pred FROM va JOIN tr USING (video_id, concept)"""


@query(_run_sql(PILOT))
def pilot_predictions(spark: SparkSession, d: str) -> DataFrame:
    """PRJ10, PRJ12, S14: the run of the pilot's configuration."""
    return predictions(spark, d, PILOT)


@query(_run_sql(LOCKED))
def locked_predictions(spark: SparkSession, d: str) -> DataFrame:
    """ML13, PRJ10, PRJ12, S14: the run of the locked configuration: long chunks, latent scores alone, best chunk, names, half-even rounding."""
    return predictions(spark, d, LOCKED)
