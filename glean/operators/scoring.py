
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glean.functions.numeric import cosine, dot, safe_divide
from glean.sources.scratch import stored

#: Vectors and queries that meet in one task of an exact search.
SHARD, BLOCK = 1 << 16, 1 << 11


def join_scores(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """JN1: inner equi-join of two score tables."""
    return left.join(right, keys)


def meet(left: DataFrame, right: DataFrame, keys: list[str], spread: str | list[str], parts: int | None = None) -> DataFrame:
    """JN5: every row of ``left`` with every row of ``right`` of equal ``keys``, of which there are few.

    ``left`` is dealt out by ``spread`` and ``right`` (a catalog) copied to each part, so
    the join has as many keys as there are tasks, whatever the number of keys.
    """
    parts = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.withColumn("_part", F.pmod(F.xxhash64(*([spread] if isinstance(spread, str) else spread)), F.lit(parts)).cast("int"))
    return dealt.join(right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), [*keys, "_part"]).drop("_part")


#: Parts over which the occurrences of one token are dealt, elements of a catalog that a task holds, and pairs made at once.
TOKEN_PARTS, CATALOG, PAIRS = 16, 1_000_000, 500_000


def set_overlap(left: DataFrame, keys: list[str], a: str, right: DataFrame, names: list[str], b: str, subject: str, most: int = CATALOG) -> DataFrame:
    """JN5, MA4: (keys..., names..., common, n_a, n_b) of every pair of equal ``subject``, zeros included.

    ``left`` is large, ``right`` a catalog; keys and names are unique and not null, sets
    hold no element twice. Rows of ``left`` stay where they are and meet an inverted index of
    the catalog; nothing is shuffled. A catalog of more than ``most`` elements in all meets
    them by joins on (subject, element), occurrences of one element dealt over
    ``TOKEN_PARTS``; only pairs that share one are counted, the others follow from the sizes.
    """
    made = [f for n in keys for f in left.schema if f.name == n] + [f for n in names for f in right.schema if f.name == n]
    if shared := _catalog(right, names, b, subject, most):
        sizes = [T.StructField("common", T.LongType()), T.StructField("n_a", T.IntegerType()), T.StructField("n_b", T.IntegerType())]
        return left.select(*keys, subject, a).mapInArrow(_overlaps(shared, keys, a, subject, lambda common, n_a, n_b: {"common": common, "n_a": (n_a + 0 * common).astype(np.int32), "n_b": (n_b + 0 * common).astype(np.int32)}), T.StructType([*made, *sizes]))
    post = left.select(*keys, subject, F.explode(a).alias("_element"))
    met = meet(post, right.select(*names, subject, F.explode(b).alias("_element")), [subject, "_element"], keys, TOKEN_PARTS)
    counted = met.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("common"))
    pairs = meet(left.select(*keys, subject, F.size(a).alias("n_a")), right.select(*names, subject, F.size(b).alias("n_b")), [subject], keys)
    return pairs.join(counted, [*keys, *names], "left").select(*keys, *names, F.coalesce("common", F.lit(0)).alias("common"), "n_a", "n_b")


def overlap_scores(left: DataFrame, keys: list[str], a: str, right: DataFrame, names: list[str], b: str, subject: str, normed: bool = False, most: int = CATALOG) -> DataFrame:
    """(keys..., names..., lda_score, lsa_score): Jaccard similarity and share of the catalog's set, of the pairs of ``set_overlap``.

    With ``normed`` they are lda_norm and lsa_norm instead, min-max over each row of ``left``:
    its pairs are made together, so no window has to gather them.
    """
    out = [f"{c}_{'norm' if normed else 'score'}" for c in ("lda", "lsa")]
    if shared := _catalog(right, names, b, subject, most):
        made = [f for n in keys for f in left.schema if f.name == n] + [f for n in names for f in right.schema if f.name == n]

        def scored(common: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> dict[str, np.ndarray]:
            union = n_a + n_b - common
            alike = np.divide(common, union, out=np.zeros(common.shape), where=(n_a > 0) & (n_b > 0))
            share = np.divide(common, n_b + 0 * common, out=np.zeros(common.shape), where=n_b > 0)
            if normed:
                alike, share = _minmax_rows(alike), _minmax_rows(share)
            return dict(zip(out, (alike, share)))

        return left.select(*keys, subject, a).mapInArrow(_overlaps(shared, keys, a, subject, scored), T.StructType([*made, *(T.StructField(c, T.DoubleType()) for c in out)]))
    met = set_overlap(left, keys, a, right, names, b, subject, most)
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    alike = F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), 0.0).otherwise(F.col("common") / union)
    found = [alike, safe_divide(F.col("common"), F.col("n_b"))]
    met = met.select(*keys, *names, *[c.alias(n) for n, c in zip(out, found)])
    return met.select(*keys, *names, *[minmax(F.col(c), keys).alias(c) for c in out]) if normed else met


def _minmax_rows(x: np.ndarray) -> np.ndarray:
    low, high = x.min(1, keepdims=True), x.max(1, keepdims=True)
    return np.divide(x - low, high - low, out=np.zeros(x.shape), where=high > low)


def _catalog(right: DataFrame, names: list[str], b: str, subject: str, most: int):
    """A catalog as an inverted index for each subject, broadcast; nothing if it has more than ``most`` elements or rows."""
    told = right.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size(b)), F.lit(0)).alias("elements")).first()
    if max(told["rows"], told["elements"]) > most:
        return None
    rows = right.where(F.col(subject).isNotNull()).select(*names, subject, b).toArrow()  # at most ``most`` elements
    lists = rows.column(b).combine_chunks()
    words = pc.unique(lists.flatten())
    element = np.asarray(pc.index_in(lists.flatten(), value_set=words)) if len(words) else np.zeros(0, int)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    row, subjects = np.repeat(np.arange(len(sizes)), sizes), pc.unique(rows.column(subject))
    of, posts = np.asarray(pc.index_in(rows.column(subject), value_set=subjects)), []
    for k in range(len(subjects)):
        mine = np.flatnonzero(of == k)
        place = np.full(len(sizes), -1)
        place[mine] = np.arange(len(mine))
        on = np.flatnonzero(place[row] >= 0)
        on = on[np.argsort(element[on], kind="stable")]
        posts.append((mine, sizes[mine].astype(np.int64), np.searchsorted(element[on], np.arange(len(words) + 1)), place[row[on]]))
    return right.sparkSession.sparkContext.broadcast((rows.select(names).combine_chunks(), words, subjects, posts))


def _overlaps(shared, keys: list[str], a: str, subject: str, figures):
    """Every row with every catalog row of its subject; ``figures(common, n_a, n_b)`` gives the columns, from rows x catalog rows."""

    def run(batches):
        named, words, subjects, posts = shared.value
        for batch in batches:
            lists = batch.column(a)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            known = pc.index_in(lists.flatten(), value_set=words)
            on = np.asarray(known.is_valid())
            row, element = np.repeat(np.arange(len(size)), size)[on], np.asarray(known.drop_null(), np.int64)
            of = pc.fill_null(pc.index_in(batch.column(subject).cast(subjects.type), value_set=subjects), -1).to_numpy(zero_copy_only=False)
            for k, (mine, n_b, start, place) in enumerate(posts):
                every = np.flatnonzero(of == k)
                step = max(1, PAIRS // len(mine))
                for low in range(0, len(every), step):
                    some = every[low : low + step]
                    at = np.full(len(size), -1)
                    at[some] = np.arange(len(some))
                    here = np.flatnonzero(at[row] >= 0)
                    r, e = at[row[here]], element[here]
                    times = start[e + 1] - start[e]
                    to = place[np.repeat(start[e] - np.cumsum(times) + times, times) + np.arange(times.sum())]
                    common = np.bincount(np.repeat(r, times) * len(mine) + to, minlength=len(some) * len(mine)).reshape(len(some), len(mine))
                    left, right = pa.array(np.repeat(some, len(mine))), pa.array(np.tile(mine, len(some)))
                    columns = [batch.column(c).take(left) for c in keys] + [named.column(c).combine_chunks().take(right) for c in named.column_names]
                    told = figures(common, size[some][:, None], n_b[None, :])
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x.ravel()) for x in told.values())], [*keys, *named.column_names, *told])

    return run


def vector_scores(left: DataFrame, keys: list[str], right: DataFrame, names: list[str], on: list[str], figures: dict[str, tuple[str, str, bool]], most: int = CATALOG) -> DataFrame:
    """MA6, MA7: (keys..., names..., one column for each of ``figures``) of every pair of equal ``on``.

    ``figures``: name -> (vector of ``left``, vector of ``right``, whether the cosine, else the
    product). ``right`` is a catalog: rows of ``left`` stay where they are and meet it as
    matrices; one of more than ``most`` numbers meets them by a join.
    """
    right = stored(right, "catalog")
    told = right.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(sum(F.size(b) for _, b, _ in figures.values())), F.lit(0)).alias("numbers")).first()
    if max(told["rows"], told["numbers"]) > most:
        met = meet(left, right, on, keys)
        return met.select(*keys, *names, *[(cosine if alike else dot)(F.col(a), F.col(b)).alias(n) for n, (a, b, alike) in figures.items()])
    rows = right.dropna(subset=on).toArrow().combine_chunks()  # at most ``most`` numbers
    groups = {}
    for i, key in enumerate(zip(*(rows.column(c).to_pylist() for c in on))):
        groups.setdefault(key, []).append(i)
    vectors = {n: _dense(rows.column(b)) for n, (_, b, _) in figures.items()}
    named = [rows.column(c).combine_chunks() for c in names]
    shared = right.sparkSession.sparkContext.broadcast((named, {k: np.array(v) for k, v in groups.items()}, vectors))

    def run(batches):
        named, groups, vectors = shared.value
        for batch in batches:
            mine = {n: _dense(batch.column(a)) for n, (a, _, _) in figures.items()}
            for key, of in groups.items():
                same = np.ones(batch.num_rows, bool)
                for c, value in zip(on, key):
                    same &= pc.fill_null(pc.equal(batch.column(c), value), False).to_numpy(zero_copy_only=False)
                every, step = np.flatnonzero(same), max(1, PAIRS // len(of))
                for low in range(0, len(every), step):
                    some = every[low : low + step]
                    at, to = pa.array(np.repeat(some, len(of))), pa.array(np.tile(of, len(some)))
                    found = [_products(mine[n][some], vectors[n][of], alike) for n, (_, _, alike) in figures.items()]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), *(c.take(to) for c in named), *(pa.array(x.ravel()) for x in found)], [*keys, *names, *figures])

    fields = [left.schema[c] for c in keys] + [right.schema[c] for c in names] + [T.StructField(n, T.DoubleType()) for n in figures]
    needed = [*keys, *on, *(a for a, _, _ in figures.values())]
    return left.select(*dict.fromkeys(needed)).mapInArrow(run, T.StructType(fields))


def _dense(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists as rows, filled up with zeros; nulls are zero."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), n.max(initial=0)))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False)
    return out


def _products(x: np.ndarray, y: np.ndarray, alike: bool) -> np.ndarray:
    width = min(x.shape[1], y.shape[1])
    out = x[:, :width] @ y[:, :width].T
    if alike:
        size = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))
        out = np.divide(out, size, out=np.zeros(out.shape), where=size > 0)
    return out


def join_audit(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """JN2, JN12, SE5: one row of counts: keys, duplicates, one-sided keys.

    Each side is first counted per key, so the join itself is one to one.
    """
    side = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    both = side(left, "n_left").join(side(right, "n_right"), keys, "full_outer")
    return both.agg(
        F.count(F.lit(1)).alias("keys"),
        F.count_if(F.col("n_left").isNotNull() & F.col("n_right").isNotNull()).alias("both"),
        F.count_if(F.col("n_right").isNull()).alias("left_only"),
        F.count_if(F.col("n_left").isNull()).alias("right_only"),
        F.count_if(F.col("n_left") > 1).alias("left_duplicates"),
        F.count_if(F.col("n_right") > 1).alias("right_duplicates"),
    )


def outer_alignment(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """JN3: full outer join with an indicator column ``side``."""
    joined = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), keys, "full_outer")
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    return joined.withColumn("side", side).drop("_l", "_r")


def minmax(score: Column, by: list[str], nan_safe: bool = False) -> Column:
    """WN1, S4: min-max over the group; a constant group is 0. WN1b: with ``nan_safe`` null and NaN count as 0 first."""
    if nan_safe:
        score = F.when(score.isNull() | F.isnan(score), 0.0).otherwise(score)
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 0.0).otherwise((score - low) / (high - low))


def fuse(lda: Column, lsa: Column, alpha: float) -> Column:
    """PRJ8."""
    return alpha * lda + (1 - alpha) * lsa


def late_mean(a: Column, b: Column) -> Column:
    """PRJ9, ML14."""
    return (a + b) / 2


def rank_first(score: Column, by: list[str], *ties: str) -> Column:
    """WN2, S5: 1, 2, ... by falling score; ties in the order of ``ties`` (the catalog order)."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(score.desc_nulls_last(), *ties))


def round_then_rank(df: DataFrame, score: str, by: list[str], *ties: str, digits: int = 4) -> DataFrame:
    """S6, first branch. Noise of the last places goes first, so that halves round alike everywhere."""
    rounded = df.withColumn(score, F.round(F.round(score, 9), digits))
    return rounded.withColumn("rank", rank_first(F.col(score), by, *ties))


def rank_then_round(df: DataFrame, score: str, by: list[str], *ties: str, digits: int = 6) -> DataFrame:
    """S6, second branch."""
    return df.withColumn("rank", rank_first(F.col(score), by, *ties)).withColumn(score, F.round(score, digits))


def top_n(df: DataFrame, n: int) -> DataFrame:
    """WN3, WN4: rows of rank at most n."""
    return df.where(F.col("rank") <= n)


def _matrix(table: pa.Table) -> np.ndarray:
    """Rows scaled to length 1; null and zero vectors are zero."""
    lists = [v.values.to_numpy(zero_copy_only=False) if v.is_valid else () for v in table.column("v")]
    out = np.zeros((len(lists), max(map(len, lists), default=0)))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def cosine_nearest(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """MA6, ML9, WN4: (query_id, vec_id, similarity, rank): the k vectors most alike to each query, exactly.

    Both sides are (id, v), ids being unique. Vectors are dealt into shards and queries
    into blocks; each shard meets each block in a task of its own, which returns k rows
    a query, so neither side is ever whole in one place. The similarity is rounded
    before it is ranked; ties go to the smaller id, and no vector answers its own query.
    A null or zero vector has similarity 0; either side may be empty.
    """
    shards, blocks = max(1, math.ceil(vectors.count() / SHARD)), max(1, math.ceil(queries.count() / BLOCK))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("id", "v", dealt(shards).alias("shard"), every(blocks).alias("block"))
    right = queries.select("id", "v", dealt(blocks).alias("block"), every(shards).alias("shard"))

    def search(mine: pa.Table, asked: pa.Table) -> pa.Table:
        order = pc.sort_indices(mine.column("id"))
        mine = mine.take(order)
        x, y = _matrix(mine), _matrix(asked)
        ids, of = mine.column("id").to_numpy(), asked.column("id").to_numpy()
        width = max(x.shape[1], y.shape[1])
        x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for q in range(len(y)):
            score = np.round(x @ y[q], digits) + 0.0
            score[ids == of[q]] = -np.inf
            best = np.argsort(-score, kind="stable")[:k]
            best = best[np.isfinite(score[best])]
            for part, values in zip(out, (np.full(len(best), of[q]), ids[best], score[best])):
                part.append(values)
        return pa.table(dict(zip(("query_id", "vec_id", "similarity"), map(np.concatenate, out))))

    near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, "query_id long, vec_id long, similarity double")
    return top_n(near.withColumn("rank", rank_first(F.col("similarity"), ["query_id"], "vec_id")), k)
