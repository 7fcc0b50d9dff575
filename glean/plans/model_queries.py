"""Vectors, weights, topics and latent scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glean.functions import text as X
from glean.functions.numeric import argmax_place
from glean.operators import audit, models, scoring, tuning
from glean.plans.chunk_queries import STOP_WORDS
from glean.plans.config import LOCKED, PILOT, PipelineConfig
from glean.plans.registry import query
from glean.sources.scratch import stored
from glean.sources.tables import table

#: Queries of the vector search: ids divisible by this.
EVERY = 20
TOPICS, VOCABULARY = 6, 1000
#: Sizes of the models.
TOPIC_WORDS, PASSES = 3000, 50
LATENT_WORDS, COMPONENTS = 5000, 100
#: Folds of whole conversations.
FOLDS = 5


@query(f"WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % {EVERY} = 0), s AS (SELECT query_id, vec_id, round(coalesce(list_dot_product(e::double[], embedding::double[]) / nullif(sqrt(list_dot_product(e::double[], e::double[])) * sqrt(list_dot_product(embedding::double[], embedding::double[])), 0), 0), 6) AS similarity FROM q, embeddings WHERE vec_id <> query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::int AS rank FROM s) SELECT query_id, vec_id, similarity, rank FROM r WHERE rank <= 5")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """MA6, ML9, WN4: every vector whose id is divisible by EVERY against all vectors, top 5 of each."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return scoring.cosine_nearest(vectors, vectors.where(F.col("id") % EVERY == 0), 5)


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::bigint AS dominant, round(list_max(embedding)::double, 6) AS value FROM embeddings")
def dominant_component(spark: SparkSession, d: str) -> DataFrame:
    """WN10, ML12."""
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", argmax_place(e).alias("dominant"), F.round(F.array_max(e).cast("double"), 6).alias("value"))


_TERMS_SQL = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: length(w) >= 2)"


def _terms() -> F.Column:
    return F.regexp_extract_all(F.lower(X.text_or_empty(F.col("text"))), F.lit("[a-z0-9]{2,}"), F.lit(0))


@query(
    f"WITH t AS (SELECT doc_id, unnest({_TERMS_SQL}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"
)
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    """ML7."""
    docs = table(spark, d, "documents").select("doc_id", _terms().alias("terms"))
    return models.tfidf(docs, "doc_id", "terms").withColumn("weight", F.round("weight", 6))


@query(f"WITH t AS (SELECT doc_id, unnest({_TERMS_SQL}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents), c AS (SELECT term, count(*) AS count, count(DISTINCT doc_id) AS df FROM t GROUP BY 1) SELECT term, count, df FROM c, n WHERE df <= 0.95 * n ORDER BY count DESC, term LIMIT {VOCABULARY}")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """ML1, ST5: the vocabulary's size is a parameter of the model."""
    docs = table(spark, d, "documents").select("doc_id", _terms().alias("terms"))
    return models.vocabulary(docs, "terms", VOCABULARY)


def _corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns and concepts with their terms; the term lists are written once, as every fit reads them many times."""
    terms = X.ngrams(X.content_tokens(X.clean_text(F.col("text")), STOP_WORDS))
    docs = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "conv_id", (F.col("conv_id") % 4).alias("subject"), terms.alias("terms"))
    concepts = table(spark, d, "benchmark").select(F.col("item_id").alias("concept"), (F.col("item_id") % 4).alias("subject"), terms.alias("terms"))
    return stored(docs, "terms"), stored(concepts, "terms")


def _topics(docs: DataFrame) -> models.TopicModel:
    """Topics of these documents, in words of their own."""
    words = [r["term"] for r in models.vocabulary(docs, "terms", TOPIC_WORDS).collect()]  # TOPIC_WORDS rows
    return models.TopicModel.fit(docs, "terms", words, TOPICS, iterations=PASSES)


def _latent(docs: DataFrame, concepts: DataFrame) -> models.LatentSpace:
    """The latent space of these documents and the concepts, in words of both."""
    both = docs.select("terms").unionByName(concepts.select("terms"))
    words = [r["term"] for r in models.vocabulary(both, "terms", LATENT_WORDS, max_df=1.0).collect()]  # LATENT_WORDS rows
    return models.LatentSpace.fit(both, "terms", words, COMPONENTS)


def _topic_score() -> F.Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("lda"))), 6).alias("lda_score")


def _latent_score() -> F.Column:
    return F.round("lsa", 4).alias("lsa_score")


#: Name, vectors of a turn and of a concept, and whether their cosine counts, else their product.
_TOPIC, _SPACE = {"lda": ("topics", "affinity", False)}, {"lsa": ("x", "y", True)}


@query()
def lda_topics(spark: SparkSession, d: str) -> DataFrame:
    """ML2-ML4, ML12: each document's topics; a fit, so checked by its properties."""
    docs, _ = _corpus(spark, d)
    found = _topics(docs).transform(docs, "terms")
    return found.select("doc_id", "topics", "dominant_topic", F.round("dominant_score", 6).alias("dominant_score"))


@query()
def lda_concept_scores(spark: SparkSession, d: str) -> DataFrame:
    """ML5, ML6, MA7: topic shares times topic-concept affinity for concepts of the subject."""
    docs, concepts = _corpus(spark, d)
    model = _topics(docs)
    left = model.transform(docs, "terms").select("doc_id", "subject", "topics")
    scored = scoring.vector_scores(left, ["doc_id"], model.affinity_table(concepts, ["concept", "subject"], "terms"), ["concept"], ["subject"], _TOPIC)
    return scored.select("doc_id", "concept", _topic_score())


def model_scores(spark: SparkSession, d: str, config: PipelineConfig) -> DataFrame:
    """S15: scores of models fitted on ``all`` turns, or for each turn on the ``train`` side of its fold."""
    return {"all": _scores_of_all, "train": _scores_of_folds}[config.fit_scope](spark, d)


def _scores_of_all(spark: SparkSession, d: str) -> DataFrame:
    docs, concepts = _corpus(spark, d)
    space = _latent(docs, concepts)
    left = space.transform(docs, "terms", "x").select("doc_id", "subject", "x")
    scored = scoring.vector_scores(left, ["doc_id"], space.transform(concepts, "terms", "y").select("concept", "subject", "y"), ["concept"], ["subject"], _SPACE)
    return scored.select("doc_id", "concept", _latent_score())


def video_folds(docs: DataFrame) -> DataFrame:
    """(conv_id, fold): whole conversations dealt into FOLDS folds, evenly within each subject; folds from 0."""
    videos = docs.select("conv_id", "subject").distinct()
    order = F.struct(F.md5(F.concat(F.lit("video-"), F.col("conv_id").cast("string")).cast("binary")), "conv_id")
    return tuning.stratified_folds(videos, "subject", order, FOLDS).select("conv_id", (F.col("fold") - 1).cast("int").alias("fold"))


_VIDEO_FOLDS_SQL = f"vf AS (SELECT conv_id, ((row_number() OVER (PARTITION BY conv_id % 4 ORDER BY md5('video-' || conv_id), conv_id) - 1) % {FOLDS})::int AS fold FROM (SELECT DISTINCT conv_id FROM conversations))"


def _in_folds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, concepts = _corpus(spark, d)
    return stored(docs.join(video_folds(docs), "conv_id"), "folds"), concepts


def _fold_sizes(docs: DataFrame) -> list[int]:
    """Documents of each fold, and those of none (concepts)."""
    found = {r["fold"]: r["count"] for r in docs.groupBy("fold").count().collect()}  # a row for each fold
    return [found.get(k, 0) for k in [*range(FOLDS), None]]


def fold_spaces(docs: DataFrame, concepts: DataFrame) -> list[models.LatentSpace]:
    """A latent space for each fold: fitted on the other folds' turns and on the concepts."""
    both = stored(docs.select("fold", "terms").unionByName(concepts.select(F.lit(None).cast("int").alias("fold"), "terms")), "both")
    sizes, found = _fold_sizes(both), stored(models.fold_terms(both, "terms", "fold", FOLDS), "found")
    picked = [models.fold_vocabulary(found, sizes, k, LATENT_WORDS, max_df=1.0).collect() for k in range(FOLDS)]  # LATENT_WORDS rows each
    return models.LatentSpace.fit_folds(both, "terms", "fold", [[r["term"] for r in p] for p in picked], [{r["term"]: r["df"] for r in p} for p in picked], sizes, COMPONENTS)


def fold_topics(docs: DataFrame) -> list[models.TopicModel]:
    """A topic model for each fold, fitted on the other folds' turns in their words; the fits share each pass."""
    sizes, found = _fold_sizes(docs), stored(models.fold_terms(docs, "terms", "fold", FOLDS), "found")
    words = [[r["term"] for r in models.fold_vocabulary(found, sizes, k, TOPIC_WORDS).collect()] for k in range(FOLDS)]  # TOPIC_WORDS rows each
    return models.TopicModel.fit_folds(docs, "terms", "fold", words, TOPICS, iterations=PASSES)


@query()
def lsa_concept_scores(spark: SparkSession, d: str) -> DataFrame:
    """ML7-ML9: cosine in the latent space, fitted on documents and concepts."""
    return model_scores(spark, d, PILOT)


@query()
def cv_oof_scores(spark: SparkSession, d: str) -> DataFrame:
    """ML10, ML11, AU4, S15: every turn scored by topics of the other folds, and by a space of the other folds and the concepts.

    Folds hold out whole conversations, so no turn is scored by a model that has seen its conversation.
    """
    return model_scores(spark, d, LOCKED)


def _scores_of_folds(spark: SparkSession, d: str) -> DataFrame:
    docs, concepts = _in_folds(spark, d)
    spaces, topics = fold_spaces(docs, concepts), fold_topics(docs)
    of_fold = F.explode(F.array(*[F.lit(k) for k in range(FOLDS)]))
    left = models.project(docs, "terms", spaces, "fold", "x")
    right = models.project(concepts.withColumn("fold", of_fold), "terms", spaces, "fold", "y").select("concept", "subject", "fold", "y")
    shares = models.topics_of(left, "terms", topics, "fold").select("doc_id", "conv_id", "subject", "fold", "x", "topics")
    affinity = [model.affinity_table(concepts, ["concept", "subject"], "terms").withColumn("fold", F.lit(k)) for k, model in enumerate(topics)]
    right = right.join(reduce(DataFrame.unionByName, affinity), ["concept", "subject", "fold"])
    scored = scoring.vector_scores(shares, ["doc_id", "conv_id", "fold"], right, ["concept"], ["subject", "fold"], _SPACE | _TOPIC)
    return scored.select("doc_id", "conv_id", "concept", "fold", _latent_score(), _topic_score())


@query(f"WITH {_VIDEO_FOLDS_SQL}, ro AS (SELECT conv_id, fold FROM conversations JOIN vf USING (conv_id)) SELECT f.fold, count(DISTINCT r.conv_id) FILTER (r.fold <> f.fold) AS train, count(DISTINCT r.conv_id) FILTER (r.fold = f.fold) AS test, (SELECT count(*) FROM (SELECT conv_id FROM ro GROUP BY 1 HAVING count(DISTINCT fold) > 1)) AS overlap FROM (SELECT DISTINCT fold FROM vf) f, ro r GROUP BY f.fold")
def oof_leakage(spark: SparkSession, d: str) -> DataFrame:
    """AU4: conversations that train and test each fold of ``cv_oof_scores``, and how many do both, from its rows."""
    docs = table(spark, d, "conversations").select("conv_id", (F.col("conv_id") % 4).alias("subject"))
    return audit.leakage(docs.join(video_folds(docs), "conv_id"), "conv_id", "fold")


@query(f"WITH {_VIDEO_FOLDS_SQL}, dc AS (SELECT conv_id, turn, fold, {_TERMS_SQL} AS ts FROM conversations JOIN vf USING (conv_id)), n AS (SELECT f.fold, count(*) AS n FROM (SELECT DISTINCT fold FROM vf) f, dc WHERE dc.fold <> f.fold GROUP BY 1), c AS (SELECT f.fold, term, count(*) AS count, count(DISTINCT (conv_id, turn)) AS df FROM (SELECT conv_id, turn, fold, unnest(ts) AS term FROM dc) t, (SELECT DISTINCT fold FROM vf) f WHERE t.fold <> f.fold GROUP BY ALL), r AS (SELECT c.*, row_number() OVER (PARTITION BY c.fold ORDER BY count DESC, term) AS k FROM c JOIN n USING (fold) WHERE df <= 0.95 * n) SELECT fold, term, count, df FROM r WHERE k <= {VOCABULARY}")
def fold_vocabularies(spark: SparkSession, d: str) -> DataFrame:
    """ML1, ML10, AU4: each fold's vocabulary without the fold itself, by subtraction from one aggregation."""
    docs = table(spark, d, "conversations").select("conv_id", (F.col("conv_id") % 4).alias("subject"), _terms().alias("terms"))
    docs = stored(docs.join(video_folds(docs), "conv_id"), "terms")
    sizes, found = _fold_sizes(docs), stored(models.fold_terms(docs, "terms", "fold", FOLDS), "found")
    return reduce(DataFrame.unionByName, [models.fold_vocabulary(found, sizes, k, VOCABULARY).select(F.lit(k).alias("fold"), "term", "count", "df") for k in range(FOLDS)])
