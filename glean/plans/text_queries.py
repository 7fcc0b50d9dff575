"""Text cleaning, tokens, terms, screen text and near-copies."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glean.functions import text as X
from glean.functions.numeric import jaccard
from glean.operators import dataset, temporal
from glean.plans.chunk_queries import _CHUNK_SQL, CHUNK, CLEAN_SQL, JACCARD_SQL, SEGMENTS_SQL, STOP_WORDS, TOKENS_SQL, segments
from glean.plans.registry import query
from glean.sources import tables
from glean.sources.scratch import stored
from glean.sources.tables import table

TERMS = ("the", "of the", "thing", "stable", "or")
#: Text-to-context patterns for the demonstration tables.
CONTEXTS = {"code": [r"\{", r"track\(", r"var "], "menu": [r"<nav", r"<li>", r"href="], "prose": [r"<p>", r"<article", r"<h1>"], "notice": [r"(?i)licen[sc]e", r"(?i)copyright"]}


@query(f"SELECT doc_id, {CLEAN_SQL.format('text')} AS cleaned FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """TX1."""
    return table(spark, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, array_to_string({TOKENS_SQL.format('text')}, ' ') AS processed FROM documents")
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    """TX2, TX3."""
    return table(spark, d, "documents").select("doc_id", X.preprocess(F.col("text"), STOP_WORDS).alias("processed"))


_WORDS_SQL = r"CASE WHEN trim(coalesce({0}, '')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' ')) END"


@query(f"WITH c AS (SELECT doc_id, text, {CLEAN_SQL.format('text')} AS k FROM documents), w AS (SELECT doc_id, length(coalesce(text, ''))::int AS n_chars, ({_WORDS_SQL.format('text')})::int AS raw_words, ({_WORDS_SQL.format('k')})::int AS clean_words FROM c) SELECT *, round((1 - clean_words / greatest(raw_words, 1)) * 100, 2) AS reduction_pct FROM w")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """PRJ1, PRJ3, PRJ4."""
    docs = table(spark, d, "documents").select("doc_id", X.text_or_empty(F.col("text")).alias("text"))
    counted = docs.select("doc_id", F.char_length("text").alias("n_chars"), X.word_count(F.col("text")).alias("raw_words"), X.word_count(X.clean_text(F.col("text"))).alias("clean_words"))
    return counted.withColumn("reduction_pct", X.reduction_pct(F.col("raw_words"), F.col("clean_words")))


@query(r"SELECT page_id, regexp_extract(url, '[?&]page=([^&#]+)', 1) AS page_no, coalesce(nullif(regexp_extract(u, '[?&]v=([^&#]+)', 1), ''), regexp_extract(u, 'youtu\.be/([^?&#/]+)', 1)) AS video_key FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN 'https://www.youtube.com/watch?x=1&v=k' || page_id || '&t=4' ELSE 'https://youtu.be/k' || page_id || '?t=1' END AS u FROM pages)")
def url_id(spark: SparkSession, d: str) -> DataFrame:
    """TX4."""
    page = F.col("page_id").cast("string")
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://www.youtube.com/watch?x=1&v=k"), page, F.lit("&t=4"))).otherwise(F.concat(F.lit("https://youtu.be/k"), page, F.lit("?t=1")))
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"[?&]page=([^&#]+)", 1).alias("page_no"), X.video_key(link).alias("video_key"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url || ' see www.a.b and x-y.org now'), 'https?://\S+', ' ', 'g'), 'www\.\S+', ' ', 'g'), '\b[\w.-]+\.(?:com|org|net|io)\b', ' ', 'g'), '\s+', ' ', 'g')) AS stripped FROM pages")
def url_domain_strip(spark: SparkSession, d: str) -> DataFrame:
    """TX9 and the link part of TX10."""
    return table(spark, d, "pages").select("page_id", X.squeeze(X.strip_links(F.lower(F.concat(F.col("url"), F.lit(" see www.a.b and x-y.org now"))))).alias("stripped"))


def screens(spark: SparkSession, d: str) -> DataFrame:
    """The whole page text without tags, with known interface noise mixed in, as a stand-in for screen text."""
    plain = F.regexp_replace("html", r"<[^>]*>", " ")
    noise = F.element_at(F.array(*[F.lit(x) for x in ("File Edit View Project Tools Window Help", "Seiect name Group 5v id havlng cqunt(id)", "Object Explorer localhost\\sql Ln 12, Col 4 UTF-8 CRLF", "1234567 ===== --- x = 5 ; https://a.b/c")]), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", X.squeeze(F.concat_ws(" ", noise, plain)).alias("screen"))


@query()
def ocr_clean_v1(spark: SparkSession, d: str) -> DataFrame:
    """TX10; look-around and back-references have no counterpart in the other engine."""
    return screens(spark, d).select("page_id", X.clean_screen_v1(F.col("screen")).alias("cleaned"))


def _nearness():
    """TX14: a test for a menu word, or a word of four letters or more that is 0.82 alike to a menu word by the matching-blocks ratio."""
    known = [difflib.SequenceMatcher(None, "", w) for w in X.UI_TOKENS if len(w) >= 4]  # each keeps what it needs of its menu word
    longest = max(len(m.b) for m in known)

    def near(word: str) -> bool:
        if word in X.UI_TOKENS:
            return True
        if not word or len(word) < 4 or 2 * longest < 0.82 * (len(word) + longest):
            return False
        for m in known:
            m.set_seq1(word)
            # neither lengths nor letters allow more than the quick ratios
            if m.real_quick_ratio() >= 0.82 and m.quick_ratio() >= 0.82 and m.ratio() >= 0.82:
                return True
        return False

    return near


@F.pandas_udf(T.BooleanType())
def near_menu_word(words: pd.Series) -> pd.Series:
    return words.map(_nearness())


def menu_words(words: DataFrame, column: str) -> DataFrame:
    """Distinct words of an array column that count as menu words: each word is compared once.

    The distinct words are written first; else the comparison would move below the distinct, to every occurrence.
    """
    each = words.select(F.explode(column).alias("w"))
    once = stored(each.select(F.regexp_replace(F.lower("w"), r"[^a-z0-9_]+", "").alias("word")).distinct(), "words")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return once.repartition(parts).where(near_menu_word("word"))


def _screen_words(spark: SparkSession, d: str) -> DataFrame:
    return screens(spark, d).select("page_id", X.tokens(F.lower("screen")).alias("words"))


@query()
def fuzzy_ui_tokens(spark: SparkSession, d: str) -> DataFrame:
    """TX14."""
    return menu_words(_screen_words(spark, d), "words")


#: Words whose nearness a task remembers; menus are searched in windows of so many words, with so many menu words.
REMEMBERED, WINDOW, LEAST = 1 << 18, 8, 4


def without_menus(df: DataFrame, words: str, counter: str, left: str) -> DataFrame:
    """TX15: ``df`` with the words that stay, joined by spaces, instead of ``words`` (lower case), and how many went.

    ``X.menu_cluster`` for many rows at once: a batch's distinct words are judged once, and windows
    are differences of running sums. Rows stay where they are; nothing is shuffled or joined.
    """
    rest = [c for c in df.columns if c not in (words, counter, left)]
    anchors, guarded = set(X.UI_ANCHORS), set(X.PROTECTED_TERMS)

    def run(batches):
        near, judged, foreign = _nearness(), {}, re.compile("[^a-z0-9_]+")

        def judge(word: str) -> tuple[bool, bool, bool]:
            bare = foreign.sub("", word)
            return near(bare), bare in anchors, bare in guarded

        for batch in batches:
            lists = batch.column(words)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            if len(judged) > REMEMBERED:
                judged.clear()
            for w in (distinct := coded.dictionary.to_pylist()):
                if w not in judged:
                    judged[w] = judge(w)
            of = np.array([judged[w] for w in distinct], bool).reshape(-1, 3)[np.asarray(coded.indices)]
            upto = np.vstack([np.zeros((1, 3), int), of.cumsum(0)])
            end, at = np.repeat(size.cumsum(), size), np.arange(len(of))
            count = upto[np.minimum(at + WINDOW, end)] - upto[at]
            menus = np.r_[0, ((count[:, 0] >= LEAST) & (count[:, 1] > 0) & (count[:, 2] == 0)).cumsum()]
            gone = of[:, 0] & (menus[at + 1] > menus[np.maximum(at - WINDOW + 1, end - np.repeat(size, size))])
            removed = np.bincount(np.repeat(np.arange(len(size)), size)[gone], minlength=len(size))
            kept = pa.ListArray.from_arrays(pa.array(np.r_[0, (size - removed).cumsum()], pa.int32()), lists.flatten().filter(pa.array(~gone)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pc.binary_join(kept, " "), pa.array(removed, pa.int32())], [*rest, left, counter])

    return df.select(*rest, words).mapInArrow(run, T.StructType([*df.select(*rest).schema, T.StructField(left, T.StringType()), T.StructField(counter, T.IntegerType())]))


def drop_menus(df: DataFrame, text: str, counter: str) -> DataFrame:
    """TX15 on a text column: the menu words of menu clusters go, and ``counter`` tells how many."""
    return without_menus(df.withColumn("_words", X.tokens(F.col(text))), "_words", counter, text).select(*[c for c in df.columns if c not in (text, counter)], text, counter)


@query()
def menu_cluster(spark: SparkSession, d: str) -> DataFrame:
    """TX15."""
    return without_menus(_screen_words(spark, d), "words", "removed", "kept").select("page_id", "removed", "kept")


def clean_screen_v2(df: DataFrame, key: str, text: str) -> DataFrame:
    """TX11-TX15: ``df`` with ``cleaned`` and a count of each kind of removal; ``key`` is unique and not null."""
    made = X.correct(df.withColumn("t", F.lower(X.text_or_empty(F.col(text)))), "t", "ocr_corrections")
    made = X.drop_phrases(made.withColumn("t", X.strip_links(F.col("t"))), "t", "ui_phrase_removals")
    made = drop_menus(made, "t", "ui_cluster_tokens_removed")
    made = made.withColumn("t", F.regexp_replace("t", X.CODE_CHARSET, " "))
    made = made.withColumn("long_numbers_removed", F.regexp_count("t", F.lit(X.LONG_NUMBER)))
    return made.withColumn("cleaned", X.finish(F.regexp_replace("t", X.LONG_NUMBER, " "))).drop("t")


@query()
def ocr_clean_v2_audit(spark: SparkSession, d: str) -> DataFrame:
    """TX11-TX15, PRJ4: cleaned text with a count of each kind of removal."""
    made = clean_screen_v2(screens(spark, d), "page_id", "screen")
    made = made.withColumn("reduction_pct", X.reduction_pct(X.word_count(F.col("screen")), X.word_count(F.col("cleaned"))))
    return made.select("page_id", "cleaned", "ocr_corrections", "ui_phrase_removals", "ui_cluster_tokens_removed", "long_numbers_removed", "reduction_pct", X.text_class(F.col("cleaned")).alias("text_class"))


_CLASS_SQL = r"CASE WHEN trim({0}) = '' THEN 'empty' WHEN len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: length(regexp_replace(w, '[^a-z0-9]', '', 'g')) >= 2)) > 0 THEN 'useful' ELSE 'noise' END"


@query(f"WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS s FROM documents) SELECT doc_id, {_CLASS_SQL.format('s')} AS text_class FROM t")
def text_class(spark: SparkSession, d: str) -> DataFrame:
    """TX16 on whole texts."""
    plain = F.lower(X.text_or_empty(F.col("text")))
    return table(spark, d, "documents").select("doc_id", X.text_class(plain).alias("text_class"))


@query(f"WITH w AS (SELECT doc_id, {_WORDS_SQL.format('text')} AS raw, len({TOKENS_SQL.format('text')}) AS clean FROM documents) SELECT doc_id, raw::int AS raw_words, clean::int AS clean_words, CASE WHEN raw > 0 AND clean = 0 THEN 'emptied' ELSE 'high_loss' END AS reason FROM w WHERE (raw > 0 AND clean = 0) OR (raw >= 10 AND round((1 - clean / greatest(raw, 1)) * 100, 2) >= 60)")
def cleaning_loss(spark: SparkSession, d: str) -> DataFrame:
    """FLT8, FLT9: texts that cleaning emptied or cut by 60 %."""
    w = table(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("raw_words"), F.size(X.content_tokens(X.clean_text(F.col("text")), STOP_WORDS)).alias("clean_words"))
    emptied = (F.col("raw_words") > 0) & (F.col("clean_words") == 0)
    high = (F.col("raw_words") >= 10) & (X.reduction_pct(F.col("raw_words"), F.col("clean_words")) >= 60)
    return w.where(emptied | high).withColumn("reason", F.when(emptied, "emptied").otherwise("high_loss"))


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TERMS], "term string")


_TERM_ROWS_SQL = "(VALUES " + ", ".join(f"('{t}')" for t in TERMS) + ") v(term)"
_HAS_SQL = r"regexp_matches(lower({0}), '(^|[^a-z0-9_])' || regexp_replace(term, '\s+', '\\s+', 'g') || '($|[^a-z0-9_])')"


@query(f"SELECT term, count(*) FILTER ({_HAS_SQL.format('text')}) AS n_docs, count(*) AS total FROM documents, {_TERM_ROWS_SQL} GROUP BY term")
def term_presence(spark: SparkSession, d: str) -> DataFrame:
    """TX17: the term list (of fixed size) is exploded next to each text."""
    docs = table(spark, d, "documents").select(F.lower("text").alias("t"), F.explode(F.array(*[F.lit(x) for x in TERMS])).alias("term"))
    return docs.groupBy("term").agg(F.count_if(X.has_term(F.col("t"), F.col("term"))).alias("n_docs"), F.count(F.lit(1)).alias("total"))


@query(f"SELECT doc_id, term FROM (SELECT doc_id, text, array_to_string({TOKENS_SQL.format('text')}, ' ') AS k FROM documents), {_TERM_ROWS_SQL} WHERE {_HAS_SQL.format('text')} AND NOT {_HAS_SQL.format('k')}")
def term_loss(spark: SparkSession, d: str) -> DataFrame:
    """TX18: terms that the raw text has and the processed text lacks."""
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("raw"), X.preprocess(F.col("text"), STOP_WORDS).alias("clean"))
    # each text is cleaned once: exploded terms would each clean it again, and so would the filter that is inferred from explode
    lost = [F.when(X.has_term(F.col("raw"), F.lit(t)) & ~X.has_term(F.col("clean"), F.lit(t)), F.lit(t)) for t in TERMS]
    return docs.select("doc_id", F.array_compact(F.array(*lost)).alias("terms")).select("doc_id", F.explode_outer("terms").alias("term")).where("term IS NOT NULL")


_ALIAS_SQL = r"regexp_matches(text, '(?i)(^|\W)la(\W|$)')"


@query(f"WITH {SEGMENTS_SQL} SELECT video_id, turn FROM seg WHERE {_ALIAS_SQL}")
def alias_hits(spark: SparkSession, d: str) -> DataFrame:
    """TX19."""
    return segments(spark, d).where(X.has_alias(F.col("text"), "la")).select("video_id", "turn")


_SNIPPETS_SQL = (
    f"WITH RECURSIVE {SEGMENTS_SQL}, cx AS (SELECT video_id, start_sec::double AS start_sec, text, concat_ws(' ', lag(text) OVER w, text, lead(text) OVER w) AS s FROM seg WINDOW w AS (PARTITION BY video_id ORDER BY start_sec)), "
    r"ht AS (SELECT * FROM cx WHERE regexp_matches(text, '(?i)\bla\b')), "
    "kp(video_id, start_sec, n) AS (SELECT video_id, min(start_sec), 1 FROM ht GROUP BY 1 UNION ALL SELECT kp.video_id, min(ht.start_sec), any_value(n) + 1 FROM kp JOIN ht ON ht.video_id = kp.video_id AND ht.start_sec >= kp.start_sec + 20 WHERE n < 3 GROUP BY kp.video_id) "
    "SELECT video_id, start_sec, md5(s) AS snippet_md5 FROM kp JOIN ht USING (video_id, start_sec)"
)


@query(_SNIPPETS_SQL)
def evidence_snippets(spark: SparkSession, d: str) -> DataFrame:
    """TX20, WN6, WN8: at most three hits an item, 20 seconds apart, with their neighbours."""
    found = dataset.snippets(segments(spark, d), "video_id", "start_sec", "text", X.has_alias(F.col("text"), "la"), 20.0, 3)
    return found.select("video_id", "start_sec", F.md5(F.col("snippet").cast("binary")).alias("snippet_md5"))


_HITS_SQL = {k: " + ".join(f"regexp_matches(html, '{p}')::int" for p in ps) for k, ps in CONTEXTS.items()}
_CONTEXT_SQL = (
    "h AS (SELECT page_id, unnest(["
    + ", ".join(f"{{'context': '{k}', 'hits': {v}}}" for k, v in _HITS_SQL.items())
    + "]) AS x FROM pages), r AS (SELECT page_id, x.context AS context, x.hits AS hits, row_number() OVER w AS k, lead(x.hits) OVER w AS second FROM h WINDOW w AS (PARTITION BY page_id ORDER BY x.hits DESC, x.context)), c AS (SELECT page_id, CASE WHEN hits > 0 THEN context ELSE 'unknown' END AS context, hits::int AS hits, CASE WHEN hits >= 2 AND hits > second THEN 'high' WHEN hits > 0 THEN 'low' ELSE 'none' END AS confidence FROM r WHERE k = 1)"
)


@query(f"WITH {_CONTEXT_SQL} SELECT * FROM c")
def context_detect(spark: SparkSession, d: str) -> DataFrame:
    """TX21."""
    return table(spark, d, "pages").select("page_id", X.contexts(F.col("html"), CONTEXTS).alias("c")).select("page_id", "c.*")


@query(f"WITH {_CONTEXT_SQL} SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'v' || page_id WHEN confidence = 'high' THEN 'c-' || context WHEN page_id % 3 = 0 THEN 's' || page_id % 4 ELSE 'all' END AS box, CASE WHEN page_id % 10 = 0 THEN 'video' WHEN confidence = 'high' THEN 'context' WHEN page_id % 3 = 0 THEN 'subject' ELSE 'global' END AS origin FROM c")
def roi_resolve(spark: SparkSession, d: str) -> DataFrame:
    """TX22: precedence of crop boxes."""
    page = F.col("page_id")
    own = F.when(page % 10 == 0, F.concat(F.lit("v"), page.cast("string")))
    subject = F.when(page % 3 == 0, F.concat(F.lit("s"), (page % 4).cast("string")))
    box = tables.resolve_box(own, F.concat(F.lit("c-"), F.col("context")), F.col("confidence"), subject, "all")
    return context_detect(spark, d).select("page_id", box.alias("b")).select("page_id", "b.*")


@query("WITH s AS (SELECT page_id, 640 + page_id % 7 * 100 AS w, 360 + page_id % 5 * 50 AS h, page_id % 10 / 10.0 AS l, page_id % 8 / 8.0 AS t FROM pages), b AS (SELECT page_id, w, h, greatest(0, least(floor(w * l), w - 1)) AS x0, greatest(0, least(floor(h * t), h - 1)) AS y0 FROM s) SELECT page_id, x0::int AS x0, y0::int AS y0, least(w, greatest(floor(w * 0.9), x0 + 1))::int AS x1, least(h, greatest(floor(h * 0.8), y0 + 1))::int AS y1 FROM b")
def roi_box(spark: SparkSession, d: str) -> DataFrame:
    """SRC18."""
    page = F.col("page_id")
    sized = table(spark, d, "pages").select("page_id", (640 + page % 7 * 100).alias("w"), (360 + page % 5 * 50).alias("h"), (page % 10 / F.lit(10.0)).alias("l"), (page % 8 / F.lit(8.0)).alias("t"))
    w, h = F.col("w"), F.col("h")
    x0, y0 = F.greatest(F.lit(0), F.least(F.floor(w * F.col("l")), w - 1)), F.greatest(F.lit(0), F.least(F.floor(h * F.col("t")), h - 1))
    x1, y1 = F.least(w, F.greatest(F.floor(w * 0.9), x0 + 1)), F.least(h, F.greatest(F.floor(h * 0.8), y0 + 1))
    return sized.select("page_id", *[c.cast("int").alias(n) for n, c in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])


_SET_SQL = r"list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9_]+'))"


@query(f"{_CHUNK_SQL}, t AS (SELECT video_id, chunk_id, turn, {_SET_SQL.format('text')} AS s FROM member) SELECT x.video_id, x.chunk_id, x.turn AS a, y.turn AS b, round({JACCARD_SQL.format('x.s', 'y.s')}, 6) AS similarity FROM t x JOIN t y ON x.video_id = y.video_id AND x.chunk_id = y.chunk_id AND x.turn < y.turn")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """TX23, MA4: all pairs of segments of a chunk; a chunk is a minute, so its pairs are few."""
    found = temporal.overlap_members(segments(spark, d), CHUNK).select("video_id", "chunk_id", "turn", X.token_set(F.col("text")).alias("s"))
    left, right = (found.select("video_id", "chunk_id", F.col("turn").alias(n), F.col("s").alias(t)) for n, t in (("a", "x"), ("b", "y")))
    return left.join(right, ["video_id", "chunk_id"]).where("a < b").select("video_id", "chunk_id", "a", "b", F.round(jaccard(F.col("x"), F.col("y")), 6).alias("similarity"))


_NEAR_SQL = f"len(list_filter(kept, lambda k: {JACCARD_SQL.format('k', 's')} >= 0.85)) > 0"
_GREEDY_SQL = (
    f"{_CHUNK_SQL.replace('WITH', 'WITH RECURSIVE', 1)}, it AS (SELECT video_id, chunk_id, start_sec, turn, {_SET_SQL.format('text')} AS s, row_number() OVER (PARTITION BY video_id, chunk_id ORDER BY start_sec, turn) AS i FROM member WHERE trim(text) <> ''), "
    f"kp(video_id, chunk_id, i, kept, stays) AS (SELECT video_id, chunk_id, i, [s], true FROM it WHERE i = 1 UNION ALL SELECT it.video_id, it.chunk_id, it.i, CASE WHEN {_NEAR_SQL} THEN kept ELSE list_append(kept, s) END, NOT ({_NEAR_SQL}) FROM kp JOIN it ON it.video_id = kp.video_id AND it.chunk_id = kp.chunk_id AND it.i = kp.i + 1) "
    "SELECT video_id, chunk_id, start_sec::double AS start_sec, turn FROM kp JOIN it USING (video_id, chunk_id, i) WHERE stays"
)


@query(_GREEDY_SQL)
def greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    """MA5, S13: of a chunk's segments in the order of their start, keep a text unless it is 0.85 alike to a kept one; blank texts go."""
    members = temporal.overlap_members(segments(spark, d), CHUNK).where(F.trim("text") != "").withColumn("tokens", X.token_set(F.col("text")))
    items = F.array_sort(F.collect_list(F.struct("start_sec", "turn", "tokens")))
    groups = members.groupBy("video_id", "chunk_id").agg(items.alias("items"))
    kept = temporal.greedy_dedup(F.col("items"))
    return groups.select("video_id", "chunk_id", F.inline(F.transform(kept, lambda k: F.struct(k["start_sec"].alias("start_sec"), k["turn"].alias("turn")))))


@query("WITH t AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 2) AS k FROM documents) SELECT doc_id, len(k)::int AS n_words, greatest(len(k) - 1, 0)::int AS n_pairs, CASE WHEN len(k) >= 2 THEN k[1] || ' ' || k[2] END AS first_pair FROM t")
def ngrams(spark: SparkSession, d: str) -> DataFrame:
    """TX26."""
    plain = X.squeeze(F.regexp_replace(F.lower(X.text_or_empty(F.col("text"))), r"[^a-z0-9\s]", " "))
    made = table(spark, d, "documents").select("doc_id", X.ngrams(X.tokens(plain)).alias("g"))
    made = made.withColumn("pairs", F.filter("g", lambda x: x.contains(" ")))
    return made.select("doc_id", (F.size("g") - F.size("pairs")).alias("n_words"), F.size("pairs").alias("n_pairs"), F.get("pairs", F.lit(0)).alias("first_pair"))


@query("SELECT n_nationkey AS id, lower(trim(' ' || n_name || ' ')) AS key_text, CASE WHEN n_nationkey % 4 = 0 THEN 'c++' WHEN n_nationkey % 4 = 1 THEN 'c++' ELSE 'sql' END AS subject, 'v' || n_nationkey AS video_id, n_nationkey::int AS video_no FROM nation")
def key_normalisation(spark: SparkSession, d: str) -> DataFrame:
    """TX6-TX8, TX24, ST2, S16."""
    n = F.col("n_nationkey")
    raw = F.element_at(F.array(F.lit("CPP"), F.lit(" C++ "), F.lit("SQL"), F.lit("sql ")), (n % 4 + 1).cast("int"))
    vid = F.concat(F.lit("V00"), n.cast("string"))
    return table(spark, d, "nation").select(n.alias("id"), X.key_text(F.concat(F.lit(" "), F.col("n_name"), F.lit(" "))).alias("key_text"), X.subject_key(raw).alias("subject"), X.video_id(vid).alias("video_id"), X.video_number(vid).alias("video_no"))
