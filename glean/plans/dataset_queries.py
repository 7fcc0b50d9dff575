"""Registries, matrices, set operations, summaries of landed rows, streaming counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glean.functions import text as X
from glean.operators import dataset
from glean.plans.registry import query
from glean.sources import tables
from glean.sources.tables import table
from glean.streaming.windows import chunk_counts

#: An update of the orders registry: every ninth row changed, and some new keys.
_NEW_SQL = "nw AS (SELECT o_orderkey + CASE WHEN o_orderkey % 27 = 0 THEN 10000000 ELSE 0 END AS o_orderkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 9 = 0)"


def _registry(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    moved = F.col("o_orderkey") + F.when(F.col("o_orderkey") % 27 == 0, 10000000).otherwise(0)
    return old, old.where("o_orderkey % 9 = 0").select(moved.alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))


@query(f"WITH {_NEW_SQL} SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM nw) UNION ALL SELECT * FROM nw")
def registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    """SNK4, JN11, SE1."""
    return dataset.upsert(*_registry(spark, d), ["o_orderkey"])


@query("WITH n AS (SELECT o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 10000000 ELSE 0 END AS o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 50 = 0 OR o_orderkey % 49 = 0) SELECT n.o_orderkey, n.o_orderstatus, CASE WHEN o.o_orderkey IS NULL THEN 'append' WHEN o.o_orderstatus = n.o_orderstatus THEN 'same' ELSE 'conflict' END AS state FROM n LEFT JOIN orders o USING (o_orderkey)")
def promote_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """SNK5."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    moved = F.col("o_orderkey") + F.when(F.col("o_orderkey") % 3 == 0, 10000000).otherwise(0)
    new = orders.where("o_orderkey % 50 = 0 OR o_orderkey % 49 = 0").select(moved.alias("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return dataset.promote(orders, new, ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark: SparkSession, d: str) -> DataFrame:
    """SE7."""
    return dataset.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("WITH a AS (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE l_linenumber >= 4), u AS (SELECT *, 1 AS s FROM a UNION ALL SELECT *, -1 FROM b) SELECT l_returnflag, l_linestatus, l_quantity, sum(s)::bigint AS surplus FROM u GROUP BY ALL HAVING sum(s) <> 0")
def table_diff(spark: SparkSession, d: str) -> DataFrame:
    """SE8."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_linenumber")
    return dataset.table_diff(rows.where("l_linenumber <= 4").drop("l_linenumber"), rows.where("l_linenumber >= 4").drop("l_linenumber"))


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def keep_last(spark: SparkSession, d: str) -> DataFrame:
    """WN7."""
    found = dataset.keep_last(table(spark, d, "events"), ["user_id", "event_type"], F.col("ts").desc(), F.col("event_id").desc())
    return found.select("event_id", "user_id", "event_type", "value")


@query("SELECT doc_id, concept, label FROM (SELECT doc_id, 'quality' AS concept, quality AS label FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) WHERE label = 1")
def matrix_to_long(spark: SparkSession, d: str) -> DataFrame:
    """EV28."""
    return dataset.to_long(table(spark, d, "labels"), ["doc_id"], ["quality", "toxic"]).where("label = 1")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events WHERE event_type <> 'signup' GROUP BY user_id")
def long_to_matrix(spark: SparkSession, d: str) -> DataFrame:
    """EV29."""
    some = table(spark, d, "events").where("event_type <> 'signup'")
    return dataset.to_matrix(some, ["user_id"], "event_type", ["click", "error", "purchase", "view"], F.count(F.lit(1)))


@query("SELECT doc_id, concept, label FROM (SELECT doc_id, 'quality' AS concept, CASE WHEN doc_id % 40 = 0 THEN 2 ELSE quality END AS label FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) WHERE label IS NULL OR label NOT IN (0, 1)")
def label_domain(spark: SparkSession, d: str) -> DataFrame:
    """EV30."""
    broken = table(spark, d, "labels").withColumn("quality", F.when(F.col("doc_id") % 40 == 0, 2).otherwise(F.col("quality")))
    return dataset.invalid_labels(dataset.to_long(broken, ["doc_id"], ["quality", "toxic"]))


@query("SELECT doc_id, (l.doc_id IS NOT NULL AND b.doc_id IS NOT NULL)::int AS in_both, (b.doc_id IS NULL)::int AS left_only, (l.doc_id IS NULL)::int AS right_only FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l FULL JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) b USING (doc_id)")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """SE3-SE6: intersection, differences and symmetric difference of two key sets."""
    labels = table(spark, d, "labels")
    a = labels.where("quality = 1").select("doc_id").distinct().withColumn("a", F.lit(1))
    b = labels.where("toxic = 1").select("doc_id").distinct().withColumn("b", F.lit(1))
    both = a.join(b, "doc_id", "full_outer")
    has = lambda c: F.col(c).isNotNull()
    return both.select("doc_id", (has("a") & has("b")).cast("int").alias("in_both"), (~has("b")).cast("int").alias("left_only"), (~has("a")).cast("int").alias("right_only"))


@query("SELECT source, count(*) AS n, count(*) FILTER (length(trim(coalesce(text, ''))) > 0) AS success, count(*) FILTER (length(trim(coalesce(text, ''))) = 0) AS empty, sum(length(coalesce(text, '')))::bigint AS chars, bool_and(lang IS NOT NULL) AS all_with_lang, bool_or(n_chars > 10000) AS any_long FROM documents GROUP BY source")
def landing_summary(spark: SparkSession, d: str) -> DataFrame:
    """AG7-AG9, AG11, AG20."""
    text = X.text_or_empty(F.col("text"))
    return table(spark, d, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~X.blank(F.col("text"))).alias("success"), F.count_if(X.blank(F.col("text"))).alias("empty"),
        F.sum(F.char_length(text)).alias("chars"), F.bool_and(F.col("lang").isNotNull()).alias("all_with_lang"), F.bool_or(F.col("n_chars") > 10000).alias("any_long"),
    )


@query("SELECT source, string_agg(DISTINCT lang, '; ' ORDER BY lang) AS langs FROM documents GROUP BY source")
def sorted_sets(spark: SparkSession, d: str) -> DataFrame:
    """AG17."""
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), "; ").alias("langs"))


@query("WITH c AS (SELECT lang, count(*) AS chunks FROM documents GROUP BY 1), k AS (SELECT CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS lang, count(*) AS concepts FROM benchmark GROUP BY 1) SELECT lang, chunks, concepts, chunks * concepts AS expected_rows FROM c JOIN k USING (lang)")
def expected_rows(spark: SparkSession, d: str) -> DataFrame:
    """AG12, AG21, JN6: sizes of the pair space from two aggregates."""
    lang = F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("de"), F.lit("es")), (F.col("item_id") % 4 + 1).cast("int"))
    chunks = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"))
    concepts = table(spark, d, "benchmark").groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("concepts"))
    return chunks.join(concepts, "lang").withColumn("expected_rows", F.col("chunks") * F.col("concepts"))


@query("SELECT s.doc_id FROM documents s WHERE lower(trim(lang)) = 'fr' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = s.doc_id)")
def pending_rows(spark: SparkSession, d: str) -> DataFrame:
    """FLT1, FLT2, SRC10, SRC17: chosen and not done."""
    chosen = table(spark, d, "documents").where(X.key_text(F.col("lang")) == "fr")
    return tables.pending(chosen, table(spark, d, "labels"), ["doc_id"]).select("doc_id")


@query("SELECT a.p_partkey AS part_id, a.p_brand AS brand, b.p_brand AS other_brand FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_brand <> b.p_brand")
def key_consistency(spark: SparkSession, d: str) -> DataFrame:
    """JN15, JN17, AU8: joined rows that disagree."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("brand"))
    other = part.select((F.col("part_id") - 1).alias("part_id"), F.col("brand").alias("other_brand"))
    return part.join(other, "part_id").where("brand <> other_brand")


@query("SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE o_totalprice::varchar END AS double) AS price FROM orders")
def lenient_numbers(spark: SparkSession, d: str) -> DataFrame:
    """PRJ2, FLT11: text that is no number becomes null."""
    raw = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"))
    return tables.lenient_numbers(raw, price="double")


@query("SELECT c.c_custkey, n_name, r_name, 'tagged' AS method FROM customer c JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """JN13, PRJ5, PRJ6, PRJ13: small lookup tables; Spark broadcasts them by their size."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    joined = table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey").join(n, "n_nationkey").withColumnRenamed("n_regionkey", "r_regionkey").join(r, "r_regionkey")
    return joined.withColumn("method", F.lit("tagged")).select("c_custkey", "n_name", "r_name", "method")


@query("WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'yes' WHEN doc_id % 3 = 1 THEN 'no' ELSE 'api_error' END AS status FROM documents) SELECT doc_id, status, CASE status WHEN 'yes' THEN 'include' WHEN 'no' THEN 'exclude' ELSE 'pending' END AS decision, CASE status WHEN 'yes' THEN '' WHEN 'no' THEN 'no transcript' ELSE 'timeout' END AS reason FROM x")
def screening(spark: SparkSession, d: str) -> DataFrame:
    """SRC11."""
    third = F.col("doc_id") % 3
    docs = table(spark, d, "documents").select("doc_id")
    return tables.availability(docs, third == 0, F.when(third == 2, "timeout")).select("doc_id", "screen.*")


@query("SELECT source, count(*) AS n, arg_min(doc_id, doc_id) AS first_id, list_sort(list(doc_id))[(count(*) + 1) // 2] AS middle_id, max(doc_id) AS last_id FROM documents GROUP BY source")
def first_middle_last(spark: SparkSession, d: str) -> DataFrame:
    """ST6."""
    ids = F.array_sort(F.collect_list("doc_id"))
    middle = F.element_at(ids, F.floor((F.size(ids) + 1) / 2).cast("int"))
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), middle.alias("middle_id"), F.max("doc_id").alias("last_id"))


@query("SELECT c_custkey, c_mktsegment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1)::int AS place, c_mktsegment IN ('BUILDING', 'FURNITURE') AS in_set FROM customer WHERE regexp_matches(c_name, '^Customer#[0-9]*[05]$')")
def id_filters(spark: SparkSession, d: str) -> DataFrame:
    """FLT3, FLT6, WN5: ids of a valid form, membership, and the place in the group."""
    found = table(spark, d, "customer").where(F.col("c_name").rlike(r"^Customer#[0-9]*[05]$"))
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey")) - 1
    return found.select("c_custkey", "c_mktsegment", place.alias("place"), F.col("c_mktsegment").isin("BUILDING", "FURNITURE").alias("in_set"))


@query("SELECT l_orderkey, string_agg(l_linenumber::varchar, ';' ORDER BY l_linenumber) AS joined, count(*) AS n, '{\"k\":' || l_orderkey || ',\"n\":' || count(*) || '}' AS as_json FROM lineitem GROUP BY l_orderkey")
def list_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """MA10, MA11: lists joined to text and split again, and JSON of a row."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ";")
    made = table(spark, d, "lineitem").groupBy("l_orderkey").agg(joined.alias("joined"))
    n = F.size(F.split("joined", ";")).cast("long")
    return made.withColumn("n", n).withColumn("as_json", F.to_json(F.struct(F.col("l_orderkey").alias("k"), "n")))


@query("SELECT r_regionkey, r_name, strftime(current_date, '%Y-%m-%d') AS retrieval_date FROM region")
def retrieval_date(spark: SparkSession, d: str) -> DataFrame:
    """MA9: the day as ISO text."""
    return table(spark, d, "region").select("r_regionkey", "r_name", F.date_format(F.current_date(), "yyyy-MM-dd").alias("retrieval_date"))


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 25")
def sorted_report(spark: SparkSession, d: str) -> DataFrame:
    """ST1, ST7: a top-k report with mixed directions; the limit is the feature."""
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey").limit(25)


@query("SELECT d.doc_id, lang, NULL::int AS toxic FROM documents d WHERE d.doc_id % 10 = 0 UNION ALL SELECT doc_id, NULL, toxic FROM labels WHERE doc_id % 10 = 5")
def union_uneven(spark: SparkSession, d: str) -> DataFrame:
    """SE9: tables with different columns; the modulo makes the two demonstration inputs."""
    a = table(spark, d, "documents").where("doc_id % 10 = 0").select("doc_id", "lang")
    b = table(spark, d, "labels").where("doc_id % 10 = 5").select("doc_id", "toxic")
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the streaming counts (beyond the reference)."""
    return chunk_counts(table(spark, d, "events"))
