"""Reading, writing and the work at the edges: round trips of whole tables, capture plans, audits of frames and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glean.functions.numeric import clip01, safe_divide
from glean.operators import audit, dataset
from glean.plans.chunk_queries import _POINTS_SQL, event_points
from glean.plans.registry import query
from glean.sources import adapters, tables
from glean.sources.scratch import scratch_path
from glean.sources.tables import table

STEP = 43200
_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
_ORDERS_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


@query(f"SELECT {_ORDERS} FROM orders")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """SRC1, SRC4-SRC6, SNK1, SNK2, SNK10: written as CSV twice, the second output in place of the first, and read with its schema."""
    path = scratch_path(spark, "orders")
    columns = _ORDERS.split(", ")
    orders = table(spark, d, "orders")
    tables.write_csv(orders.limit(0), path, columns)
    tables.write_csv(orders, path, columns)
    tables.require_paths(spark, [path])
    return tables.require_columns(tables.read_csv(spark, path, _ORDERS_SCHEMA), columns, "orders")


@query("SELECT c_custkey::varchar AS c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS c_name, c_mktsegment FROM customer")
def strings_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """SRC2: every column a string, empty cells empty."""
    path = scratch_path(spark, "customers")
    name = F.when(F.col("c_custkey") % 5 != 0, F.col("c_name"))
    tables.write_csv(table(spark, d, "customer").select("c_custkey", name.alias("c_name"), "c_mktsegment"), path)
    return tables.read_strings(spark, path, ["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT p_partkey, p_brand, p_size FROM part")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """SRC19."""
    path = scratch_path(spark, "parts")
    table(spark, d, "part").select("p_partkey", "p_brand", "p_size").write.json(path)
    return spark.read.schema("p_partkey bigint, p_brand string, p_size bigint").json(path)


_LINES_SQL = "ln AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"


@query(f"WITH {_LINES_SQL}, ht AS (SELECT doc_id, line_no, 'link' AS category FROM ln WHERE regexp_matches(line, 'https?://') UNION ALL SELECT doc_id, line_no, 'rights' FROM ln WHERE regexp_matches(line, '[Ll]icen[cs]e|[Cc]opyright')), ar AS (SELECT DISTINCT doc_id, category, unnest(range(line_no - 2, line_no + 3)) AS line_no FROM ht) SELECT doc_id, category, line_no, md5(line) AS line_md5 FROM ar JOIN ln USING (doc_id, line_no)")
def line_hits(spark: SparkSession, d: str) -> DataFrame:
    """SRC20, SRC21: lines that match a category, with the two lines before and after."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")).select("file", (F.col("at") + 1).alias("line_no"), "line")
    found = tables.line_hits(lines, {"link": "https?://", "rights": "[Ll]icen[cs]e|[Cc]opyright"})
    return found.select(F.col("file").alias("doc_id"), "category", "line_no", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query("SELECT c_custkey::varchar AS video_id, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE c_custkey / 4.0 END AS start_sec, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE c_custkey / 4.0 + 2 END AS end_sec, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE c_name END AS text, CASE WHEN c_custkey % 7 = 0 THEN 'failed: no transcript' WHEN c_custkey % 11 = 0 THEN 'empty' ELSE 'success' END AS status FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def fetched_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """SRC9, SRC10, SRC14: keys that have not landed are fetched by a callable; failures and empty answers are statuses."""

    def fetch(key: str, languages: list[str]):
        number, name = key.split("|")
        if int(number) % 7 == 0:
            raise ValueError("no transcript")
        return [] if int(number) % 11 == 0 else [(int(number) / 4, 2.0, name)]

    videos = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("video_id"), F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name").alias("youtube_id"))
    landed = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").cast("string").alias("video_id"))
    return adapters.fetch_transcripts(videos, fetch, landed=landed)


@query(f"WITH {_POINTS_SQL}, sp AS (SELECT user_id, max(t) AS dur FROM pt GROUP BY 1), gr AS (SELECT user_id, dur, unnest(range(0, floor(dur)::bigint, {STEP})) AS timestamp_sec FROM sp) SELECT user_id AS video_id, timestamp_sec::int AS timestamp_sec, greatest(timestamp_sec - 20, 0)::int AS start_sec, least(timestamp_sec + 10, floor(dur))::int AS end_sec, (timestamp_sec - greatest(timestamp_sec - 20, 0))::int AS offset_sec FROM gr WHERE NOT EXISTS (SELECT 1 FROM pt WHERE pt.user_id = gr.user_id AND floor(pt.t / {STEP}) * {STEP} = timestamp_sec AND event_type <> 'error')")
def repair_plan(spark: SparkSession, d: str) -> DataFrame:
    """SRC13-SRC15: grid points without a whole capture, and the stretch to fetch for each."""
    pts = event_points(spark, d)
    spans = pts.groupBy(F.col("user_id").alias("video_id")).agg(F.max("t").alias("duration_sec"))
    landed = pts.select(F.col("user_id").alias("video_id"), (F.floor(F.col("t") / STEP) * STEP).cast("int").alias("timestamp_sec"), F.when(F.col("event_type") == "error", 10).otherwise(9999).alias("n_bytes"))
    plan = adapters.capture_plan(spans, landed, STEP).join(spans, "video_id")
    stretch = adapters.repair_section(F.col("timestamp_sec"), F.floor("duration_sec").cast("int"))
    return plan.select("video_id", "timestamp_sec", stretch.alias("s")).select("video_id", "timestamp_sec", "s.*")


@query("SELECT page_id::varchar AS image_file, CASE WHEN page_id % 9 = 0 THEN '' ELSE url END AS ocr_text, (CASE WHEN page_id % 9 = 0 THEN 0 ELSE length(url) END)::int AS ocr_char_count, (CASE WHEN page_id % 9 = 0 OR url = '' THEN 0 ELSE 1 END)::int AS ocr_word_count, CASE WHEN page_id % 9 = 0 THEN 'failed' WHEN url = '' THEN 'empty' ELSE 'success' END AS ocr_status FROM pages")
def recognised_images(spark: SparkSession, d: str) -> DataFrame:
    """SRC16, SRC17: bytes read by an engine; those it cannot read get a status."""

    def engine(content: bytes) -> str:
        number, _, text = content.decode().partition("|")
        if int(number) % 9 == 0:
            raise ValueError("unreadable")
        return text

    images = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("image_file"), F.concat_ws("|", F.col("page_id").cast("string"), "url").cast("binary").alias("content"))
    return adapters.recognise(images, engine)


@query("SELECT l_orderkey, round(coalesce(sum(l_discount) / nullif(count(*) FILTER (l_returnflag = 'R'), 0), 0.0), 6)::double AS per_return, round(greatest(0.0, least(1.0, sum(l_quantity) / 100 - 0.5)), 6)::double AS clipped FROM lineitem GROUP BY 1")
def guarded_rates(spark: SparkSession, d: str) -> DataFrame:
    """MA1, PRJ11."""
    rate = safe_divide(F.sum("l_discount"), F.count_if(F.col("l_returnflag") == "R"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(rate, 6).alias("per_return"), F.round(clip01(F.sum("l_quantity") / 100 - 0.5), 6).alias("clipped"))


@query("WITH c AS (SELECT count(*) FILTER (l_quantity > 45)::double AS large, count(*) FILTER (l_quantity < 0)::double AS negative, count(*) FILTER (l_shipdate IS NULL)::double AS unshipped, count(*) FILTER (l_returnflag = 'R')::double AS returned FROM lineitem) SELECT * FROM (SELECT 'large' AS \"check\", large AS value, 0.0::double AS expected, large = 0 AS pass FROM c UNION ALL SELECT 'negative', negative, 0, negative = 0 FROM c UNION ALL SELECT 'unshipped', unshipped, 0, unshipped = 0 FROM c UNION ALL SELECT 'returned', returned, 0, returned = 0 FROM c) WHERE NOT pass")
def failed_checks(spark: SparkSession, d: str) -> DataFrame:
    """AU2: the checks of a ledger that failed."""
    rules = {"large": F.col("l_quantity") > 45, "negative": F.col("l_quantity") < 0, "unshipped": F.col("l_shipdate").isNull(), "returned": F.col("l_returnflag") == "R"}
    return audit.failures(audit.ledger(table(spark, d, "lineitem"), {k: (F.count_if(c), 0) for k, c in rules.items()}))


#: Frames of the audit: half days of a user's events; a user's duration is told by the rows of type ``view``.
_FRAMES_SQL = f"""{_POINTS_SQL}, fr AS (SELECT user_id AS video_id, event_id, (floor(t / {STEP}) * {STEP})::int AS timestamp_sec, CASE WHEN event_type = 'view' AND user_id % 10 <> 3 THEN t + 60000 END AS duration_sec, CASE event_type WHEN 'error' THEN ' Failed ' WHEN 'signup' THEN NULL ELSE 'success' END AS status, image_ok FROM pt JOIN (SELECT event_id, value >= 5 AS image_ok FROM events) USING (event_id)),
du AS (SELECT video_id, arg_min(duration_sec, event_id) FILTER (duration_sec IS NOT NULL) AS duration FROM fr GROUP BY 1),
vi AS (SELECT c_custkey AS video_id, duration, du.video_id IS NOT NULL AS there FROM customer LEFT JOIN du ON c_custkey = du.video_id),
la AS (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY video_id, timestamp_sec ORDER BY event_id DESC) = 1),
gd AS (SELECT video_id, unnest(range(0, duration::int, {STEP})) AS timestamp_sec FROM (SELECT video_id, floor(duration) AS duration FROM vi WHERE duration IS NOT NULL)),
rs AS (SELECT g.video_id, g.timestamp_sec::int AS timestamp_sec, CASE WHEN l.video_id IS NULL THEN 'row_missing' WHEN lower(trim(coalesce(status, 'missing'))) <> 'success' THEN 'status_' || lower(trim(coalesce(status, 'missing'))) WHEN NOT image_ok THEN 'image_missing_or_invalid' END AS reason FROM gd g LEFT JOIN la l ON g.video_id = l.video_id AND g.timestamp_sec = l.timestamp_sec),
pb AS (SELECT * FROM rs WHERE reason IS NOT NULL UNION ALL SELECT video_id, NULL, CASE WHEN NOT there THEN 'summary_missing' ELSE 'duration_missing' END FROM vi WHERE NOT there OR duration IS NULL)"""


def _frame_problems(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", " Failed ").when(F.col("event_type") != "signup", "success")
    told = F.when((F.col("event_type") == "view") & (F.col("user_id") % 10 != 3), F.col("t") + 60000)
    values = table(spark, d, "events").select("event_id", (F.col("value") >= 5).alias("image_ok"))
    frames = event_points(spark, d).join(values, "event_id").select(F.col("user_id").alias("video_id"), "event_id", (F.floor(F.col("t") / STEP) * STEP).cast("int").alias("timestamp_sec"), told.alias("duration_sec"), status.alias("status"), "image_ok")
    return audit.frame_problems(table(spark, d, "customer").select(F.col("c_custkey").alias("video_id")), frames, STEP, F.col("event_id"))


@query(f"WITH {_FRAMES_SQL} SELECT video_id, timestamp_sec, reason FROM pb")
def frame_problems(spark: SparkSession, d: str) -> DataFrame:
    """AU6: missing frames with the reason of each."""
    return _frame_problems(spark, d)


@query(f"WITH {_FRAMES_SQL}, il AS (SELECT *, timestamp_sec // {STEP} - row_number() OVER (PARTITION BY video_id, reason ORDER BY timestamp_sec) AS island FROM pb WHERE timestamp_sec IS NOT NULL) SELECT video_id, reason, min(timestamp_sec)::int AS first_sec, max(timestamp_sec)::int AS last_sec, count(*) AS frames FROM il GROUP BY video_id, reason, island")
def problem_runs(spark: SparkSession, d: str) -> DataFrame:
    """AU6: stretches of neighbouring frames that are missing for one reason."""
    return audit.problem_runs(_frame_problems(spark, d), STEP)


_MATRIX_SQL = "mx AS (SELECT doc_id AS video_id, CASE WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 23 = 0 THEN '2' ELSE quality::varchar END AS quality, CASE WHEN doc_id % 29 <> 0 THEN toxic::varchar END AS toxic, CASE WHEN doc_id % 17 = 0 THEN ' ' WHEN doc_id % 31 <> 0 THEN 'a' || doc_id % 3 END AS annotator, CASE WHEN doc_id % 13 = 0 THEN 'Draft' ELSE ' Completed ' END AS review_status FROM labels)"


@query(f"WITH {_MATRIX_SQL} SELECT video_id, 'invalid_label' AS problem, 'quality=' || quality AS detail FROM mx WHERE quality NOT IN ('0', '1') UNION ALL SELECT video_id, 'invalid_label', 'toxic=' || coalesce(toxic, '') FROM mx WHERE toxic IS NULL OR toxic NOT IN ('0', '1') UNION ALL SELECT video_id, 'blank_annotator', '' FROM mx WHERE trim(coalesce(annotator, '')) = '' UNION ALL SELECT video_id, 'incomplete_review', trim(review_status) FROM mx WHERE lower(trim(review_status)) <> 'completed'")
def annotation_problems(spark: SparkSession, d: str) -> DataFrame:
    """EV30: labels outside 0 and 1, blank annotators, reviews that are not completed."""
    k = F.col("doc_id")
    matrix = table(spark, d, "labels").select(
        k.alias("video_id"),
        F.when(k % 19 == 0, "").when(k % 23 == 0, "2").otherwise(F.col("quality").cast("string")).alias("quality"),
        F.when(k % 29 != 0, F.col("toxic").cast("string")).alias("toxic"),
        F.when(k % 17 == 0, " ").when(k % 31 != 0, F.concat(F.lit("a"), (k % 3).cast("string"))).alias("annotator"),
        F.when(k % 13 == 0, "Draft").otherwise(" Completed ").alias("review_status"),
    )
    return dataset.annotation_problems(matrix, "video_id", ["quality", "toxic"])
