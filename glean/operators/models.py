
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glean.functions.numeric import clip01, safe_divide
from glean.sources.scratch import stored

#: Terms of documents counted at once, and terms whose frequencies are broadcast; the others meet theirs by a shuffle.
TERMS, FREQUENT = 1 << 19, 1 << 18


def vocabulary(docs: DataFrame, terms: str, size: int, min_df: int = 1, max_df: float = 0.95) -> DataFrame:
    """ML1: (term, count, df) of the most frequent terms; ties in the order of the terms.

    All occurrences and each document's distinct terms are counted side by side, so
    no row number is needed and partial sums are all that is shuffled.
    """
    n = docs.count()
    once = docs.select(F.explode(F.array_distinct(terms)).alias("term"), F.lit(0).alias("count"), F.lit(1).alias("df"))
    every = docs.select(F.explode(terms).alias("term"), F.lit(1).alias("count"), F.lit(0).alias("df"))
    counts = every.unionByName(once).groupBy("term").agg(F.sum("count").alias("count"), F.sum("df").alias("df"))
    return counts.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n)).orderBy(F.col("count").desc(), "term").limit(size)


def tfidf(docs: DataFrame, key: str, terms: str, chosen: DataFrame | None = None) -> DataFrame:
    """ML7: (key, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), each document of length 1.

    Without ``chosen`` all terms count. Terms are counted where a document is read and written once; rows of
    one key are put together. A document stays one row up to its weights: the ``FREQUENT`` most frequent terms
    are broadcast; beyond them a document's rarer terms, which are few and in few documents, meet their frequencies
    by a shuffle and the document by another, in which its frequent terms are numbers.
    """
    kind = docs.schema[key].dataType.simpleString()
    counted = stored(docs.select(F.col(key).alias("key"), F.col(terms).alias("terms")).mapInArrow(_term_counts, f"key {kind}, term array<string>, tf array<bigint>"), "counted")
    again = stored(counted.groupBy("key").count().where("count > 1").select("key"), "again")
    if not again.isEmpty():
        same = counted["key"].eqNullSafe(again["key"])
        each = counted.join(again, same, "left_semi").select("key", F.explode(F.arrays_zip("term", "tf")).alias("t")).groupBy("key", F.col("t.term").alias("term")).agg(F.sum("t.tf").alias("tf"))
        whole = each.groupBy("key").agg(F.collect_list(F.struct("term", "tf")).alias("t")).select("key", F.col("t.term").alias("term"), F.col("t.tf").alias("tf"))
        counted = stored(counted.join(again, same, "left_anti").unionByName(whole), "counted")
    df = counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = stored(df if chosen is None else df.join(chosen.select("term"), "term", "left_semi"), "df")
    top = df.orderBy(F.col("df").desc(), "term").limit(FREQUENT).toArrow()  # at most FREQUENT rows
    n = docs.agg(F.count_distinct(key)).first()[0]
    shared = docs.sparkSession.sparkContext.broadcast((top["term"].combine_chunks(), np.log((1 + n) / (1 + top["df"].to_numpy())) + 1, n))
    told = counted.mapInArrow(_numbered(shared), f"key {kind}, at array<int>, tf array<bigint>, rare array<string>, rare_tf array<bigint>")
    more = F.lit(None).cast("array<struct<term:string,tf:bigint,df:bigint>>")
    if len(top) < FREQUENT:
        whole = told.select("key", "at", "tf", more.alias("more"))
    else:
        rare = told.select("key", F.explode(F.arrays_zip("rare", "rare_tf")).alias("t")).select("key", F.col("t.rare").alias("term"), F.col("t.rare_tf").alias("tf")).join(df, "term")
        rare = rare.groupBy(F.col("key").alias("of")).agg(F.collect_list(F.struct("term", "tf", "df")).alias("more"))
        whole = told.join(rare, F.col("key").eqNullSafe(F.col("of")), "left").select("key", "at", "tf", "more")
    return whole.mapInArrow(_weighed(shared), f"key {kind}, term string, weight double").withColumnRenamed("key", key)


def _in_parts(batches, column: str):
    """Pieces of the batches with about ``TERMS`` elements of a list column each."""
    for batch in batches:
        n = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(n) - n) // TERMS)) + 1
        for low, high in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            yield batch.slice(int(low), int(high - low))


def _rows(lists: pa.Array) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def _lists(row: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """Lists of n rows; ``row`` rises."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), values)


def _term_counts(batches):
    """(key, term, tf): the distinct terms of each row and how often it has them."""
    for batch in _in_parts(batches, "terms"):
        row, flat = _rows(batch.column("terms")), batch.column("terms").flatten()
        known = np.asarray(flat.is_valid())
        coded = flat.drop_null().dictionary_encode()
        size = max(len(coded.dictionary), 1)
        cell, n = np.unique(row[known] * size + np.asarray(coded.indices, np.int64), return_counts=True)
        lists = [_lists(cell // size, batch.num_rows, x) for x in (coded.dictionary.take(pa.array(cell % size)), pa.array(n))]
        yield pa.RecordBatch.from_arrays([batch.column("key"), *lists], ["key", "term", "tf"])


def _numbered(shared):
    """(key, at, tf, rare, rare_tf): places of the broadcast terms with their counts, and the terms that are not among them."""

    def run(batches):
        words = shared.value[0]
        for batch in _in_parts(batches, "term"):
            row, flat, tf = _rows(batch.column("term")), batch.column("term").flatten(), batch.column("tf").flatten()
            at = pc.index_in(flat, value_set=words)
            known, rare = at.is_valid(), at.is_null()
            here, there = row[np.asarray(known)], row[np.asarray(rare)]
            lists = [_lists(r, batch.num_rows, x) for r, x in ((here, at.drop_null()), (here, tf.filter(known)), (there, flat.filter(rare)), (there, tf.filter(rare)))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *lists], ["key", "at", "tf", "rare", "rare_tf"])

    return run


def _weighed(shared):
    """(key, term, weight) of whole documents."""

    def run(batches):
        words, idf, n = shared.value
        for batch in _in_parts(batches, "at"):
            at = batch.column("at").flatten()
            row, weight = _rows(batch.column("at")), batch.column("tf").flatten().to_numpy() * idf[at.to_numpy()]
            rare, some = _rows(batch.column("more")), batch.column("more").flatten()
            told = some.field("tf").to_numpy() * (np.log((1 + n) / (1 + some.field("df").to_numpy())) + 1)
            row, weight = np.r_[row, rare], np.r_[weight, told]
            length = np.sqrt(np.bincount(row, weight * weight, batch.num_rows))
            term = pa.concat_arrays([words.take(at), some.field("term").cast(words.type)])
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), term, pa.array(weight / length[row])], ["key", "term", "weight"])

    return run


#: The schedule of the online updates, the mean change at which a document's topics stand, words of documents inferred together.
DELAY, DECAY, CLOSE, CELLS = 1024, 0.51, 1e-3, 1 << 16
#: Leaps of a document's topics before updates alone go on.
LEAPS = 30
#: Keeps a quotient finite.
TINY = 1e-100


@dataclass
class TopicModel:
    """ML2-ML6: topics with the affinity of each to each concept."""

    words: list[str]
    weights: np.ndarray  # topics x words
    prior: np.ndarray  # of each topic in a document

    @classmethod
    def fit(cls, docs: DataFrame, terms: str, words: list[str], topics: int = 6, iterations: int = 50, seed: int = 42) -> TopicModel:
        """ML2 on all of ``docs``."""
        return cls.fit_folds(docs.withColumn("_fold", F.lit(None).cast("int")), terms, "_fold", [words], topics, iterations, seed)[0]

    @classmethod
    def fit_folds(cls, docs: DataFrame, terms: str, fold: str, words: list[list[str]], topics: int = 6, iterations: int = 50, seed: int = 42) -> list[TopicModel]:
        """ML2, ML10: online variational Bayes, priors 1 / topics; fit k sees every row whose fold is not k, in ``words[k]``.

        Starts and updates are those of MLlib's LDA, but a pass takes every document once, where MLlib draws as
        many with replacement. All fits share each pass over counts that are written once; a task holds a number for
        each topic, word and fit, and their sums stream through one task for each topic and fit.
        """
        every = sorted(set().union(*words))
        place = {w: i for i, w in enumerate(every)}
        at = [np.array([place[w] for w in known], np.int64) for known in words]
        spark = docs.sparkSession
        counted = stored(_counted(docs.select(F.col(fold).cast("int").alias("fold"), F.col(terms).alias("terms")), every), "counted")
        parts = spark.sparkContext.defaultParallelism
        weights, priors = [_first_weights(spark, topics, len(known), seed) for known in words], [np.full(topics, 1 / topics) for _ in words]
        for step in range(1, iterations + 1):
            betas = []
            for here, lam in zip(at, weights):
                betas.append(np.zeros((topics, len(every) + 1)))  # the last is no word
                betas[-1][:, here] = np.exp(_digamma(lam) - _digamma(lam.sum(1, keepdims=True)))
            shared = spark.sparkContext.broadcast(list(zip(betas, priors)))
            dealt = counted.mapInArrow(_expected(shared), "fit int, block int, part binary").repartition(parts, "fit", "block").sortWithinPartitions("fit", "block")
            totals = [np.zeros((topics, len(every) + 2)) for _ in words]
            for r in dealt.mapInArrow(_summed, "fit int, block int, part binary").collect():  # topics x words numbers for each fit
                totals[r["fit"]][r["block"]] = np.frombuffer(r["part"])
            shared.destroy()
            rate = (DELAY + step) ** -DECAY
            for k, total in enumerate(totals):
                n = total[0, -1]
                if n:
                    weights[k] = (1 - rate) * weights[k] + rate * (total[:, at[k]] * betas[k][:, at[k]] + 1 / topics)
                    priors[k] = _next_prior(priors[k], total[:, -2] / n, n, rate)
        return [cls(known, lam, prior) for known, lam, prior in zip(words, weights, priors)]

    def transform(self, docs: DataFrame, terms: str) -> DataFrame:
        """ML10, ML12: ``topics`` (array), ``dominant_topic`` and its score, for any documents."""
        found = topics_of(docs, terms, [self], None)
        top = F.array_max("topics")
        return found.withColumn("dominant_topic", (F.array_position("topics", top) - 1).cast("int")).withColumn("dominant_score", top)

    def distribution(self) -> np.ndarray:
        """ML4: topics x words, rows summing to 1."""
        total = self.weights.sum(1, keepdims=True)
        return self.weights / np.where(total == 0, 1, total)

    def top_words(self, n: int = 12) -> list[list[str]]:
        """ML3, ST5."""
        return [[self.words[i] for i in np.argsort(-row, kind="stable")[:n]] for row in self.weights]

    def affinity(self, concepts: list[tuple[str, list[str]]]) -> dict[str, np.ndarray]:
        """ML5: cosine of each topic with each concept's term counts; both sides are of fixed size."""
        place = {w: k for k, w in enumerate(self.words)}
        topics = self.distribution()
        out = {}
        for name, terms in concepts:
            v = np.bincount([place[t] for t in terms if t in place], minlength=len(self.words)).astype(float)
            norm = np.linalg.norm(topics, axis=1) * np.linalg.norm(v)
            out[name] = np.divide(topics @ v, norm, out=np.zeros(len(topics)), where=norm > 0)
        return out

    def affinity_table(self, concepts: DataFrame, keys: list[str], terms: str) -> DataFrame:
        """ML5 as a join: ``keys`` and ``affinity`` (array, one for each topic) of every row of ``concepts``."""
        topics = self.distribution()
        norms = np.linalg.norm(topics, axis=1)
        told = concepts.sparkSession.createDataFrame([(w, [float(x) for x in topics[:, i]]) for i, w in enumerate(self.words)], "term string, share array<double>")
        counts = concepts.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
        dots = [F.sum(F.col("share")[k] * F.col("n")).alias(f"_{k}") for k in range(len(topics))]
        met = counts.join(told, "term").groupBy(*keys).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("_norm"), *dots)
        shares = [F.coalesce(safe_divide(F.col(f"_{k}"), F.col("_norm") * float(norms[k])), F.lit(0.0)) for k in range(len(topics))]
        return concepts.select(*keys).join(met, keys, "left").select(*keys, F.array(*shares).alias("affinity"))


def _digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of log gamma: six steps up, then the series."""
    y, low = x + 6, _steps(x)
    return np.log(y) - _series(y) - low


def _exp_digamma(x: np.ndarray) -> np.ndarray:
    y, low = x + 6, _steps(x)
    return y * np.exp(-_series(y) - low)


def _steps(x: np.ndarray) -> np.ndarray:
    """1 / x + ... + 1 / (x + 5), with two terms to a quotient."""
    u = x * (x + 5)
    return (2 * x + 5) * (1 / u + 1 / (u + 4) + 1 / (u + 6))


def _series(y: np.ndarray) -> np.ndarray:
    i = 1 / (y * y)
    return 0.5 / y + i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def _trigamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    i = 1 / (y * y)
    return sum(1 / (x + k) ** 2 for k in range(6)) + (1 + 0.5 / y + i * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))) / y


def _first_weights(spark, topics: int, n: int, seed: int) -> np.ndarray:
    """MLlib's random start, which depends on the sizes and the seed alone."""
    one = spark.range(0, 1, 1, 1).select(array_to_vector(F.array_repeat(F.lit(1.0), max(n, 1))).alias("features"))
    return LDA(k=topics, maxIter=0, seed=seed, optimizer="online").fit(one).topicsMatrix().toArray().T[:, :n].copy()


def _next_prior(prior: np.ndarray, logs: np.ndarray, n: float, rate: float) -> np.ndarray:
    """A Newton step of the documents' prior towards the mean expected logs of their topics; none that would leave the positive."""
    slope = n * (_digamma(prior.sum()) - _digamma(prior) + logs)
    c, q = n * _trigamma(prior.sum()), -n * _trigamma(prior)
    b = (slope / q).sum() / (1 / c + (1 / q).sum())
    made = prior - rate * (slope - b) / q
    return made if (made > 0).all() else prior


def _counted(docs: DataFrame, words: list[str]) -> DataFrame:
    """(fold, term, count): places of the known words of each document and how often it has them."""
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(words, pa.string()))

    def run(batches):
        for batch in batches:
            row, at, count = sparse_rows(batch.column("terms"), shared.value)
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (at, count)]
            yield pa.RecordBatch.from_arrays([batch.column("fold"), *lists], ["fold", "term", "count"])

    return docs.mapInArrow(run, "fold int, term array<int>, count array<int>")


def _side_by_side(n: np.ndarray, at: np.ndarray, count: np.ndarray, none: int):
    """(documents, words, counts): documents of like size in columns of equal length; ``none`` and 0 fill them up. Empty ones are left out."""
    start = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    while len(order):
        most = n[order[0]]
        docs, order = np.split(order, [max(1, CELLS // most)])
        line = np.arange(most)[:, None]
        full = line < n[docs]
        place = np.where(full, start[docs] + line, 0)
        yield docs, np.where(full, at[place], none), np.where(full, count[place], 0).astype(float)


def _inferred(word: np.ndarray, count: np.ndarray, beta: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The variational topics (topics x documents) of documents in columns, and each word's part in them (topics x words x documents) without the factor beta.

    Two updates tell how fast a document's topics still move and how that slows down; from there a leap goes along this
    course (SQUAREM), and updates go on. A document stands where an update changes its topics by at most CLOSE on average,
    as without leaps; the others go on without it, after LEAPS leaps by updates alone.
    """
    known = beta.take(word, axis=1)
    k, _, n = known.shape
    out, live = np.empty((k, n)), np.arange(n)
    b, c, now, open_ = known, count, np.ones((k, n)), np.ones(n, bool)
    leaps = 0

    def updated(x: np.ndarray) -> np.ndarray:
        share = _exp_digamma(x)  # the factor that makes shares sum to 1 cancels
        new = share * np.einsum("kwd,wd->kd", b, c / (np.einsum("kwd,kd->wd", b, share) + TINY)) + prior[:, None]
        stands = open_ & (np.abs(new - x).sum(0) <= CLOSE * k)
        out[:, live[stands]] = new[:, stands]
        open_[stands] = False
        return new

    while open_.any():
        if 4 * open_.sum() < 3 * len(live):
            live, b, c, now = live[open_], b[:, :, open_], c[:, open_], now[:, open_]
            open_ = np.ones(len(live), bool)
        one = updated(now)
        two = updated(one)
        move, turn = one - now, two - 2 * one + now
        far = np.maximum(1, np.sqrt((move * move).sum(0) / ((turn * turn).sum(0) + TINY))) if leaps < LEAPS else 1
        now = np.maximum(now + 2 * far * move + far * far * turn, prior[:, None])  # with far = 1 the second update
        leaps += 1
    share = _exp_digamma(out)
    return out, share[:, None, :] * (count / (np.einsum("kwd,kd->wd", known, share) + TINY))


def _expected(shared):
    """Each fit's expected counts of the task's words in each topic, without the factor beta; then the topics' expected logs, and the number of documents."""

    def run(batches):
        fits = shared.value
        totals = [np.zeros((len(beta), beta.shape[1] + 1)) for beta, _ in fits]
        for batch in batches:
            fold = pc.fill_null(batch.column("fold"), -1).to_numpy(zero_copy_only=False)
            n = pc.list_value_length(batch.column("term")).to_numpy(zero_copy_only=False)
            at, count = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("term", "count"))
            for docs, word, times in _side_by_side(n, at, count, fits[0][0].shape[1] - 1):
                for k, ((beta, prior), total) in enumerate(zip(fits, totals)):
                    here = times * beta.any(0)[word] * (fold[docs] != k)
                    some = here.any(0)
                    if not some.any():
                        continue
                    w, here = word[:, some], here[:, some]
                    found, part = _inferred(w, here, beta, prior)
                    for j, x in enumerate(part):
                        total[j, :-2] += np.bincount(w.ravel(), weights=x.ravel(), minlength=beta.shape[1])[:-1]
                    total[:, -2] += (_digamma(found) - _digamma(found.sum(0))).sum(1)
                    total[:, -1] += some.sum()
        rows = [(k, j, line.tobytes()) for k, total in enumerate(totals) for j, line in enumerate(total)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["fit", "block", "part"])

    return run


def topics_of(docs: DataFrame, terms: str, models: list[TopicModel], fold: str | None, out: str = "topics") -> DataFrame:
    """ML10: every row's topic shares by the model of its fold (by the only one without ``fold``); 0 for a row without known words."""
    told = []
    for m in models:
        beta = np.exp(_digamma(m.weights) - _digamma(m.weights.sum(1, keepdims=True)))
        told.append((pa.array(m.words, pa.string()), np.hstack([beta, np.zeros((len(beta), 1))]), m.prior))
    shared = docs.sparkSession.sparkContext.broadcast(told)

    def run(batches):
        for batch in batches:
            of = batch.column(fold).to_numpy(zero_copy_only=False) if fold else np.zeros(batch.num_rows, int)
            found = np.zeros((batch.num_rows, len(shared.value[0][2])))
            for k, (words, beta, prior) in enumerate(shared.value):
                mine = np.flatnonzero(of == k)
                if not len(mine):
                    continue
                row, at, count = sparse_rows(batch.column(terms).take(pa.array(mine)), words)
                for some, word, times in _side_by_side(np.bincount(row, minlength=len(mine)), at, count, len(words)):
                    topics = _inferred(word, times, beta, prior)[0]
                    found[mine[some]] = (topics / topics.sum(0)).T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def topic_scores(topics: Column, affinity: np.ndarray, clip: bool = True) -> Column:
    """ML6, MA7: topic shares times affinities."""
    total = F.aggregate(F.zip_with(topics, F.lit([float(x) for x in affinity]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return clip01(total) if clip else total


#: Terms of one block of a sum, entries of sparse rows worked on at once, spare directions of a block, its passes.
BLOCK, ENTRIES, SPARE, PASSES = 256, 20_000, 10, 5
#: The most frequent terms, whose part of a product is dense, and rows of such a part.
DENSE, ROWS = 768, 2048


def fold_terms(docs: DataFrame, terms: str, fold: str, folds: int) -> DataFrame:
    """(term, counts, dfs): each fold's occurrences of a term and documents with it, as arrays.

    What a fit without fold k may see is the total minus element k, so every fit's
    statistics come from one aggregation. Rows whose fold is null are in every fit; they
    are the last element.
    """
    at = F.coalesce(F.col(fold), F.lit(folds)).alias("_fold")
    once = docs.select(at, F.explode(F.array_distinct(terms)).alias("term"), F.lit(0).alias("count"), F.lit(1).alias("df"))
    every = docs.select(at, F.explode(terms).alias("term"), F.lit(1).alias("count"), F.lit(0).alias("df"))
    per_fold = lambda c: F.array(*[F.sum(F.when(F.col("_fold") == k, F.col(c)).otherwise(0)) for k in range(folds + 1)])
    return every.unionByName(once).groupBy("term").agg(per_fold("count").alias("counts"), per_fold("df").alias("dfs"))


def fold_vocabulary(found: DataFrame, sizes: list[int], k: int, size: int, max_df: float = 0.95) -> DataFrame:
    """(term, count, df): ML1 without fold k, from ``fold_terms`` and the folds' numbers of documents."""
    n = sum(sizes) - sizes[k]
    left = lambda c: (F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x) - F.col(c)[k])
    seen = found.select("term", left("counts").alias("count"), left("dfs").alias("df")).where((F.col("df") >= 1) & (F.col("df") <= max_df * n))
    return seen.orderBy(F.col("count").desc(), "term").limit(size)


def sparse_rows(lists: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the known terms of each list, sorted by row and term."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    found = pc.index_in(lists.flatten(), value_set=words)
    known = np.asarray(found.is_valid())
    key = row[known] * max(len(words), 1) + np.asarray(found.drop_null(), np.int64)
    key, count = np.unique(key, return_counts=True)
    return key // max(len(words), 1), key % max(len(words), 1), count


def _unit(row: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights with every row's length 1; rows of length 0 stay 0."""
    length = np.sqrt(np.bincount(row, weights=weight * weight, minlength=int(row[-1]) + 1 if len(row) else 0))
    return np.divide(weight, length[row], out=np.zeros_like(weight), where=length[row] > 0)


def _times(row: np.ndarray, at: np.ndarray, weight: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """The n sparse rows times a dense basis."""
    out = np.zeros((n, basis.shape[1]))
    for low in range(0, len(row), ENTRIES):
        r, a, w = row[low : low + ENTRIES], at[low : low + ENTRIES], weight[low : low + ENTRIES]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        out[r[first]] += np.add.reduceat(w[:, None] * basis[a], first)
    return out


@dataclass
class LatentSpace:
    """ML8, ML9, ML11: a truncated SVD fitted on some documents, applied to any."""

    words: list[str]
    idf: np.ndarray  # 0 for words that the fit does not know
    components: np.ndarray  # words x k

    @classmethod
    def fit(cls, docs: DataFrame, terms: str, words: list[str], most: int = 100, seed: int = 42) -> LatentSpace:
        """ML8 on all of ``docs``."""
        n, shared = docs.count(), pa.array(words, pa.string())

        def counted(batches):
            for batch in batches:
                at = sparse_rows(batch.column(0), shared)[1]
                yield pa.RecordBatch.from_pydict({"term": at})

        df = np.zeros(len(words))
        for r in docs.select(terms).mapInArrow(counted, "term long").groupBy("term").count().collect():  # the vocabulary
            df[r["term"]] = r["count"]
        whole = docs.select(F.lit(None).cast("int").alias("fold"), F.col(terms).alias("terms"))
        return cls._fit(whole, words, [np.log((1 + n) / (1 + df)) + 1], [n], most, seed)[0]

    @classmethod
    def fit_folds(cls, docs: DataFrame, terms: str, fold: str, words: list[list[str]], dfs: list[dict[str, int]], sizes: list[int], most: int = 100, seed: int = 42) -> list[LatentSpace]:
        """ML11: one space for each fold, fitted on the other folds and on the rows whose fold is null; all fits share each pass.

        ``words[k]`` and ``dfs[k]``: the words without fold k and their document
        frequencies there; ``sizes``: documents of each fold, then those without one.
        """
        every = sorted(set().union(*words))
        place, idf, rows = {w: i for i, w in enumerate(every)}, [], []
        for k, (known, df) in enumerate(zip(words, dfs)):
            rows.append(sum(sizes) - sizes[k])
            idf.append(np.zeros(len(every)))
            idf[k][[place[w] for w in known]] = [np.log((1 + rows[k]) / (1 + df[w])) + 1 for w in known]
        return cls._fit(docs.select(F.col(fold).cast("int").alias("fold"), F.col(terms).alias("terms")), every, idf, rows, most, seed)

    @classmethod
    def _fit(cls, docs: DataFrame, words: list[str], idf: list[np.ndarray], rows: list[int], most: int, seed: int) -> list[LatentSpace]:
        """Block Lanczos from a random start: right singular vectors of each fit's rows.

        A pass multiplies the rows' cross products with a block of k + ``SPARE`` directions;
        a task holds that many numbers for each term and fit, and there is no square of the
        vocabulary. What a pass adds to the directions so far is the next block; the vectors
        are the best within all of them, and exact once nothing is added. Sums of blocks of
        terms stream through one task each.
        """
        made = np.random.default_rng(seed)
        ranks = [min(n - 1, int((w > 0).sum()) - 1, most) for n, w in zip(rows, idf)]
        if min(ranks) < 2:
            raise ValueError("too few documents or terms for a latent space")
        blocks = []
        for k, w in zip(ranks, idf):
            start = made.standard_normal((len(words), min(k + SPARE, int((w > 0).sum())))) * (w > 0)[:, None]
            blocks.append(np.linalg.qr(start)[0])
        spark = docs.sparkSession
        parts = spark.sparkContext.defaultParallelism
        vocabulary = pa.array(words, pa.string())
        docs = docs.coalesce(parts)  # one matrix for each core, not for each partition of the input
        bases, images = [np.zeros((len(words), 0)) for _ in idf], [np.zeros((len(words), 0)) for _ in idf]
        for _ in range(PASSES):
            shared = spark.sparkContext.broadcast((vocabulary, idf, blocks))
            dealt = docs.mapInArrow(_products(shared), "fit int, block int, part binary").repartition(parts, "fit", "block").sortWithinPartitions("fit", "block")
            products = [np.zeros_like(q) for q in blocks]
            for r in dealt.mapInArrow(_summed, "fit int, block int, part binary").collect():  # terms x (k + SPARE) numbers for each fit
                part = np.frombuffer(r["part"]).reshape(-1, blocks[r["fit"]].shape[1])
                products[r["fit"]][r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
            shared.destroy()
            for k, z in enumerate(products):
                bases[k], images[k] = np.hstack([bases[k], blocks[k]]), np.hstack([images[k], z])
                blocks[k] = _beyond(bases[k], z)
            if not any(q.shape[1] for q in blocks):
                break
        out = []
        for q, z, k, w in zip(bases, images, ranks, idf):
            small = q.T @ z  # the cross product within the basis
            _, turn = np.linalg.eigh((small + small.T) / 2)
            out.append(cls(words, w, q @ turn[:, ::-1][:, :k]))
        return out

    def transform(self, docs: DataFrame, terms: str, out: str = "latent") -> DataFrame:
        """ML11: project any documents."""
        return project(docs, terms, [self], None, out)


def _beyond(basis: np.ndarray, image: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``image`` holds outside ``basis``; nothing if that is noise."""
    rest = image
    for _ in range(2):
        rest = rest - basis @ (basis.T @ rest)
    left, size, _ = np.linalg.svd(rest, full_matrices=False)
    left = left[:, size > 1e-9 * max(1.0, np.linalg.norm(image, axis=0).max(initial=0.0))]
    return left - basis @ (basis.T @ left)


def _products(shared):
    """Each fit's cross product of the task's rows with its basis, in blocks of terms; the most frequent terms go as dense matrices."""

    def run(batches):
        words, idf, basis = shared.value
        totals = [np.zeros_like(q) for q in basis]
        places = [_frequent(w) for w in idf]
        for batch in (b.slice(low, ROWS) for b in batches for low in range(0, b.num_rows, ROWS)):
            row, at, count = sparse_rows(batch.column("terms"), words)
            fold = pc.fill_null(batch.column("fold"), -1).to_numpy(zero_copy_only=False)
            for k, (w, q, total, place) in enumerate(zip(idf, basis, totals, places)):
                if not q.shape[1]:
                    continue
                on = (fold[row] != k) & (w[at] > 0)
                r, a = row[on], at[on]
                v = _unit(r, count[on] * w[a])
                often = place[a] >= 0
                top = np.flatnonzero(place >= 0)
                some = np.zeros((batch.num_rows, len(top)))
                some[r[often], place[a[often]]] = v[often]
                r, a, v = r[~often], a[~often], v[~often]
                told = _times(r, a, v, q, batch.num_rows) + some @ q[top]
                total[top] += some.T @ told
                order = np.argsort(a, kind="stable")
                r, a, v = r[order], a[order], v[order]
                for low in range(0, len(a), ENTRIES):
                    x = a[low : low + ENTRIES]
                    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                    total[x[first]] += np.add.reduceat(v[low : low + ENTRIES, None] * told[r[low : low + ENTRIES]], first)
        for k, total in enumerate(totals):
            for b in range(0, len(total), BLOCK):
                part = total[b : b + BLOCK]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"fit": pa.array([k], pa.int32()), "block": pa.array([b // BLOCK], pa.int32()), "part": pa.array([part.tobytes()], pa.binary())})

    return run


def _frequent(idf: np.ndarray) -> np.ndarray:
    """Places, in the order of the terms, of the DENSE terms of least weight (the most frequent); -1 for the others."""
    known = np.flatnonzero(idf > 0)
    top = np.sort(known[np.argsort(idf[known], kind="stable")[:DENSE]])
    place = np.full(len(idf), -1)
    place[top] = np.arange(len(top))
    return place


def _summed(batches):
    """Sums of equal (fit, block), which follow each other."""
    now, total = None, None
    told = lambda: pa.RecordBatch.from_pydict({"fit": pa.array([now[0]], pa.int32()), "block": pa.array([now[1]], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})
    for batch in batches:
        for fit, block, part in zip(batch.column("fit").to_pylist(), batch.column("block").to_pylist(), batch.column("part")):
            if now != (fit, block):
                if now:
                    yield told()
                now, total = (fit, block), np.frombuffer(part.as_buffer()).copy()
            else:
                total += np.frombuffer(part.as_buffer())
    if now:
        yield told()


def project(docs: DataFrame, terms: str, spaces: list[LatentSpace], fold: str | None, out: str = "latent") -> DataFrame:
    """ML11: every row in the space of its fold (in the only one without ``fold``)."""
    shared = docs.sparkSession.sparkContext.broadcast((pa.array(spaces[0].words, pa.string()), [(s.idf, s.components) for s in spaces]))

    def run(batches):
        words, fits = shared.value
        for batch in batches:
            row, at, count = sparse_rows(batch.column(terms), words)
            of = batch.column(fold).to_numpy(zero_copy_only=False) if fold else np.zeros(batch.num_rows, int)
            found = [None] * batch.num_rows
            for k, (idf, components) in enumerate(fits):
                on = (of[row] == k) & (idf[at] > 0)
                r, a = row[on], at[on]
                x = _times(r, a, _unit(r, count[on] * idf[a]), components, batch.num_rows)
                for i in np.flatnonzero(of == k):
                    found[i] = x[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def row_normalised(value: Column, by: list[str]) -> Column:
    """MA8: share of the group's sum; 0 in a group without weight."""
    return safe_divide(value, F.sum(value).over(Window.partitionBy(*by)))
