"""Chunks of time-stamped segments, points in chunks, and scores of chunks against concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glean.functions import text as X
from glean.operators import scoring, temporal
from glean.plans.config import PILOT
from glean.plans.registry import query
from glean.sources.tables import table

STOP_WORDS = X.stop_words(("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "where", "with"))
CHUNK = PILOT.chunk_seconds
#: Gap between a conversation's turns, and how long one lasts: neighbours overlap chunk edges.
STEP, LENGTH = 13, 17
INTERVAL = 1800

SEGMENTS_SQL = f"seg AS (SELECT conv_id AS video_id, turn, {STEP}.0 * turn AS start_sec, {STEP}.0 * turn + {LENGTH} AS end_sec, coalesce(text, '') AS text FROM conversations)"
CLEAN_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), 'http\S+|www\S+', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
TOKENS_SQL = "list_filter(string_split(" + CLEAN_SQL + f", ' '), lambda t: length(t) > 1 AND NOT list_contains({_STOP_SQL}, t))"
JACCARD_SQL = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1}))::double / len(list_distinct(list_concat({0}, {1}))) END"


def segments(spark: SparkSession, d: str) -> DataFrame:
    start = (STEP * F.col("turn")).cast("double")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("video_id"), "turn", start.alias("start_sec"), (start + LENGTH).alias("end_sec"), X.text_or_empty(F.col("text")).alias("text"))


def event_points(spark: SparkSession, d: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start)) / 1e6
    return table(spark, d, "events").select("event_id", "user_id", "event_type", seconds.alias("t"))


_POINTS_SQL = "pt AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 - epoch(TIMESTAMP '2024-01-01 00:00:00') AS t FROM events)"
_GRID_SQL = f"grid AS (SELECT video_id, unnest(range(0, (floor(max(end_sec) / {CHUNK}) + 1)::bigint)) AS chunk_id FROM seg GROUP BY video_id)"
_MEMBER_SQL = f"member AS (SELECT g.video_id, g.chunk_id::int AS chunk_id, s.turn, s.start_sec, s.end_sec, s.text FROM grid g JOIN seg s ON s.video_id = g.video_id AND s.start_sec < (g.chunk_id + 1) * {CHUNK} AND s.end_sec >= g.chunk_id * {CHUNK})"
_CHUNK_SQL = f"WITH {SEGMENTS_SQL}, {_GRID_SQL}, {_MEMBER_SQL}"


@query(f"{_CHUNK_SQL} SELECT video_id, chunk_id, count(*) AS n_segments, min(start_sec)::double AS first_start, max(end_sec)::double AS last_end FROM member GROUP BY ALL")
def overlap_chunks(spark: SparkSession, d: str) -> DataFrame:
    """JN7, S1, S2."""
    found = temporal.overlap_members(segments(spark, d), CHUNK)
    return found.groupBy("video_id", "chunk_id").agg(F.count(F.lit(1)).alias("n_segments"), F.min("start_sec").alias("first_start"), F.max("end_sec").alias("last_end"))


_TEXT_SQL = _CHUNK_SQL + ", chunk AS (SELECT video_id, chunk_id, count(*) AS n_segments, string_agg(text, ' ' ORDER BY start_sec, text) AS raw_text FROM member GROUP BY ALL)"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return temporal.build_chunks(segments(spark, d), CHUNK, lambda c: X.preprocess(c, STOP_WORDS))


@query(f"{_TEXT_SQL}, done AS (SELECT *, array_to_string({TOKENS_SQL.format('raw_text')}, ' ') AS processed_text FROM chunk) SELECT video_id, chunk_id, n_segments, md5(raw_text) AS raw_md5, processed_text FROM done WHERE trim(processed_text) <> ''")
def overlap_chunk_text(spark: SparkSession, d: str) -> DataFrame:
    """AG16, TX3, S2: ordered text of a chunk, cleaned; blank chunks go, numbers stay."""
    return _chunks(spark, d).select("video_id", "chunk_id", "n_segments", F.md5(F.col("raw_text").cast("binary")).alias("raw_md5"), "processed_text")


_SCORED_SQL = (
    _TEXT_SQL
    + f""", tok AS (SELECT video_id, chunk_id, list_distinct({TOKENS_SQL.format('raw_text')}) AS a FROM chunk),
concept AS (SELECT item_id AS concept, item_id % 4 AS subject, list_distinct({TOKENS_SQL.format('text')}) AS b FROM benchmark),
scored AS (SELECT video_id, chunk_id, concept, {JACCARD_SQL.format('a', 'b')} AS lda_score, CASE WHEN len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::double / len(b) END AS lsa_score FROM tok JOIN concept ON video_id % 4 = subject WHERE len(a) > 0),
normed AS (SELECT *, CASE WHEN max(lda_score) OVER w = min(lda_score) OVER w THEN 0.0 ELSE (lda_score - min(lda_score) OVER w) / (max(lda_score) OVER w - min(lda_score) OVER w) END AS lda_norm,
  CASE WHEN max(lsa_score) OVER w = min(lsa_score) OVER w THEN 0.0 ELSE (lsa_score - min(lsa_score) OVER w) / (max(lsa_score) OVER w - min(lsa_score) OVER w) END AS lsa_norm FROM scored WINDOW w AS (PARTITION BY video_id, chunk_id)),
fused AS (SELECT *, round(round({PILOT.alpha} * lda_norm + {1 - PILOT.alpha} * lsa_norm, 9), 4) AS final_score FROM normed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, chunk_id ORDER BY final_score DESC, concept)::int AS rank FROM fused)"""
)


#: Words of a catalog text that stand for a concept's name.
NAME_WORDS = 8


def concepts(spark: SparkSession, d: str, mode: str = "name+description") -> DataFrame:
    """(concept, subject, b): tokens of each concept's text (S14): its name, or name and description."""
    if mode not in ("name", "name+description"):
        raise ValueError(f"unknown concept text {mode!r}")
    text = F.array_join(F.slice(F.split("text", " "), 1, NAME_WORDS), " ") if mode == "name" else F.col("text")
    found = F.array_distinct(X.content_tokens(X.clean_text(text), STOP_WORDS))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("concept"), (F.col("item_id") % 4).alias("subject"), found.alias("b"))


def concept_scores(spark: SparkSession, d: str) -> DataFrame:
    """JN5: chunks meet the concepts of their own subject only, through their common tokens."""
    chunks = _chunks(spark, d).select("video_id", "chunk_id", F.array_distinct(F.split("processed_text", " ")).alias("a"), (F.col("video_id") % 4).alias("subject"))
    return scoring.overlap_scores(chunks, ["video_id", "chunk_id"], "a", concepts(spark, d), ["concept"], "b", "subject")


def ranked_scores(spark: SparkSession, d: str) -> DataFrame:
    by = ["video_id", "chunk_id"]
    normed = concept_scores(spark, d).withColumns({"lda_norm": scoring.minmax(F.col("lda_score"), by), "lsa_norm": scoring.minmax(F.col("lsa_score"), by)})
    return scoring.round_then_rank(normed.withColumn("final_score", scoring.fuse(F.col("lda_norm"), F.col("lsa_norm"), PILOT.alpha)), "final_score", by, "concept")


@query(f"{_SCORED_SQL} SELECT video_id, chunk_id, concept, rank, final_score, round(lda_norm, 6) AS lda_norm, round(lsa_norm, 6) AS lsa_norm FROM ranked WHERE rank <= 3")
def flagship_chunk_top_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The whole path: chunks, token scores, min-max, fusion, rank, top 3."""
    return scoring.top_n(ranked_scores(spark, d), 3).select("video_id", "chunk_id", "concept", "rank", "final_score", F.round("lda_norm", 6).alias("lda_norm"), F.round("lsa_norm", 6).alias("lsa_norm"))


@query(f"WITH {_POINTS_SQL} SELECT user_id, floor(t / 21600)::int AS chunk_id, count(*) AS n_points, floor(min(t))::bigint AS first_t, (floor(t / 21600) + 1)::bigint AS chunk_no FROM pt GROUP BY user_id, floor(t / 21600)")
def point_in_chunk(spark: SparkSession, d: str) -> DataFrame:
    """JN8, MA2, S3: half-open chunks, 0-based, and the 1-based number."""
    found = event_points(spark, d).withColumn("chunk_id", temporal.chunk_of(F.col("t"), 21600))
    return found.groupBy("user_id", "chunk_id").agg(F.count(F.lit(1)).alias("n_points"), F.floor(F.min("t")).alias("first_t")).withColumn("chunk_no", F.col("chunk_id").cast("long") + 1)


_INTERVALS_SQL = f"WITH {_POINTS_SQL}, iv AS (SELECT event_id AS interval_id, user_id, t AS lo, t + {INTERVAL} AS hi FROM pt WHERE event_type = 'purchase'), p AS (SELECT event_id, user_id, t FROM pt WHERE event_type <> 'purchase')"


def _interval_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pts = event_points(spark, d)
    intervals = pts.where("event_type = 'purchase'").select(F.col("event_id").alias("interval_id"), "user_id", F.col("t").alias("lo"), (F.col("t") + INTERVAL).alias("hi"))
    return pts.where("event_type <> 'purchase'").select("event_id", "user_id", "t"), intervals


@query(f"{_INTERVALS_SQL} SELECT event_id, interval_id FROM p JOIN iv ON p.user_id = iv.user_id AND t >= lo AND t < hi")
def point_in_intervals(spark: SparkSession, d: str) -> DataFrame:
    """JN9: an irregular grid of intervals that may overlap."""
    pts, intervals = _interval_sides(spark, d)
    return temporal.points_in_intervals(pts, intervals, "user_id", "t", "lo", "hi", INTERVAL).select("event_id", "interval_id")


@query(f"{_INTERVALS_SQL} SELECT event_id FROM p WHERE NOT EXISTS (SELECT 1 FROM iv WHERE p.user_id = iv.user_id AND t >= lo AND t < hi)")
def unassigned_points(spark: SparkSession, d: str) -> DataFrame:
    """JN9: points outside every interval."""
    pts, intervals = _interval_sides(spark, d)
    inside = temporal.points_in_intervals(pts, intervals, "user_id", "t", "lo", "hi", INTERVAL).select("event_id").distinct()
    return pts.join(inside, "event_id", "left_anti").select("event_id")


@query(f"WITH {_POINTS_SQL}, u AS (SELECT user_id, max(t) AS dur FROM pt GROUP BY 1), g AS (SELECT user_id, unnest(range(0, floor(dur)::bigint, 43200)) AS timestamp_sec FROM u) SELECT user_id, timestamp_sec::int AS timestamp_sec FROM g WHERE NOT EXISTS (SELECT 1 FROM pt WHERE pt.user_id = g.user_id AND floor(pt.t / 43200) * 43200 = g.timestamp_sec)")
def expected_grid_missing(spark: SparkSession, d: str) -> DataFrame:
    """MA3, AU6, JN11: half days without an event."""
    pts = event_points(spark, d)
    spans = pts.groupBy("user_id").agg(F.max("t").alias("duration"))
    seen = pts.select("user_id", (F.floor(F.col("t") / 43200) * 43200).cast("int").alias("timestamp_sec"))
    return temporal.missing_points(spans, seen, "user_id", "duration", 43200)


@query(f"WITH {SEGMENTS_SQL}, h AS (SELECT video_id, turn, floor(start_sec * 97)::int AS s FROM seg) SELECT video_id, turn, lpad((s // 3600)::varchar, 2, '0') || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') AS start_time FROM h")
def hhmmss(spark: SparkSession, d: str) -> DataFrame:
    """TX5."""
    return segments(spark, d).select("video_id", "turn", X.hhmmss(F.col("start_sec") * 97).alias("start_time"))


@query(f"WITH {SEGMENTS_SQL} SELECT video_id, string_agg(text, ' ' ORDER BY start_sec, text) AS document, count(*) AS n_segments FROM seg WHERE trim(text) <> '' GROUP BY video_id")
def build_documents(spark: SparkSession, d: str) -> DataFrame:
    """AG16, FLT5: one document for each item."""
    some = segments(spark, d).where(~X.blank(F.col("text")))
    return some.groupBy("video_id").agg(temporal.ordered_text("text", "start_sec").alias("document"), F.count(F.lit(1)).alias("n_segments"))


@query(f"WITH {SEGMENTS_SQL}, c AS (SELECT video_id, start_sec, concat_ws(' ', lag(text) OVER w, text, lead(text) OVER w) AS s FROM seg WINDOW w AS (PARTITION BY video_id ORDER BY start_sec)) SELECT video_id, start_sec::double AS start_sec, md5(s) AS context_md5 FROM c")
def context_rows(spark: SparkSession, d: str) -> DataFrame:
    """WN6: each segment with its neighbours."""
    from pyspark.sql import Window

    w = Window.partitionBy("video_id").orderBy("start_sec")
    both = F.concat_ws(" ", F.lag("text").over(w), F.col("text"), F.lead("text").over(w))
    return segments(spark, d).select("video_id", "start_sec", both.alias("s")).select("video_id", "start_sec", F.md5(F.col("s").cast("binary")).alias("context_md5"))


@query(f"WITH {SEGMENTS_SQL}, t AS (SELECT video_id, start_sec, '[' || floor(start_sec)::int || ' - ' || floor(end_sec)::int || '] ' || text AS line FROM seg) SELECT video_id, md5('ITEM ' || video_id || chr(10) || string_agg(line, chr(10) ORDER BY start_sec, line)) AS report_md5 FROM t GROUP BY video_id")
def text_report(spark: SparkSession, d: str) -> DataFrame:
    """SNK7."""
    from glean.sources import tables

    whole = lambda c: F.floor(c).cast("int").cast("string")
    line = F.concat(F.lit("["), whole("start_sec"), F.lit(" - "), whole("end_sec"), F.lit("] "), F.col("text"))
    made = tables.text_report(segments(spark, d), "video_id", "start_sec", line, F.concat(F.lit("ITEM "), F.col("video_id").cast("string")))
    return made.select("video_id", F.md5(F.col("report").cast("binary")).alias("report_md5"))
