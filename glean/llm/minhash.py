"""Near-duplicate groups by DartMinHash signatures (operator 1).

Texts are sets of ``SHINGLE``-word shingles (or multisets, with ``weights="count"``);
two texts are linked if their weighted Jaccard similarity is at least
``SIMILARITY``, and the classes are the connected components of the links.

1. Equal texts become one node. Every node gets a sparse DartMinHash signature,
   whose coordinates are joined into bands; a band's hash is a bucket.
2. The nodes of a bucket are a group for ``linking.connect``: leader rounds verify each
   node against a few others on whole shingle sets; where a bucket still holds several
   components, its nodes outside the largest one ask the blocks of the others, each block
   once for all buckets, and a T-occurrence search on whole sets answers. Only spanning
   links come back. No bucket is capped and no pair left out.

With 32 bands of 5 rows, a pair at similarity 0.8 shares no bucket with
probability 3e-6, and less above.

Null texts and texts without words are linked to nothing: each is its own class.
Texts of one to four words have one shingle, all their words. Rows with equal text
are in one class, rows repeated as a whole included. The class id is the least
doc_id of the class, null if no row of it has one; rows without an id stay only where
no other can. Long texts are taken whole. An empty table gives none. Other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glean.llm import linking
from glean.llm.shared import written
from glean.llm.sketch import Filter
from glean.llm.text import Words, as_lists, mix, slices, split_words, window_hashes, windows_inside

SHINGLE = 5
COORDINATES = 160
ROWS = 5
#: Similarity from which texts are linked, in per cent.
PERCENT = 80
SLICE = 4 << 20


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles of each text, sorted by row and hash.

    Texts of one to four words have one shingle, all their words; texts without words none.
    """
    hashes = words.hashes()
    at = windows_inside(words, SHINGLE)
    row, value = words.row[at], window_hashes(hashes, SHINGLE)[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            on = words.counts[short] > k
            whole[on] = mix(whole[on] + np.uint64(k + 1) + hashes[words.starts[short[on]] + k])
        row, value = np.r_[row, short], np.r_[value, whole]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])]) if len(row) else np.zeros(0, np.int64)
    return row[new], value[new], np.diff(np.r_[new, len(row)])


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """DartMinHash: an (n, k) array of dart hashes; rows without elements are all zero.

    Over the weight axis of an element lie bands [0, 1), [1, 2), [2, 4), ...; darts
    hit a band as a Poisson process in rank, with the band's width as its rate, at
    even places across the band. All of it follows from the element's hash. A text
    throws, for each element, the darts below its own rank limit and keeps those
    whose place lies within the element's weight. Every dart belongs to one
    coordinate, and a coordinate keeps its earliest dart. Two texts agree in a
    coordinate with a probability equal to their weighted Jaccard similarity. The
    limit gives k ln k + 2k darts on average, whatever the number of elements; texts
    with a coordinate left empty throw again with the limit doubled.
    """
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(row, weights=weight, minlength=n)
    limit = np.zeros(n)
    limit[total > 0] = (k * np.log(k) + 2 * k) / total[total > 0]
    open_rows = total > 0
    while open_rows.any():
        on = open_rows[row]
        best = np.full(n * k, np.inf)
        darts = []
        for r, rank, name in _darts(row[on], element[on], weight[on], limit):
            cell = r * k + (name % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, cell, rank)
            darts.append((cell, rank, name))
        done = open_rows & np.isfinite(best).reshape(n, k).all(1)
        for cell, rank, name in darts:
            first = (rank == best[cell]) & done[cell // k]
            out.reshape(-1)[cell[first]] = name[first]
        open_rows &= ~done
        limit[open_rows] *= 2
    return out


def _darts(row, element, weight, limit):
    """(row, rank, hash) of the darts below each row's limit, arrival by arrival."""
    low, width, band = 0.0, 1.0, 0
    while len(row):
        seed = mix(element + np.uint64(0xA24BAED4963EE407 * (band + 1) % (1 << 64)))
        r, s, w, rank, arrival = row, seed, weight, np.zeros(len(row)), 0
        while len(r):
            arrival += 1
            s = mix(s + np.uint64(0x9FB21C651E98DF25))
            rank = rank - np.log(_unit(s)) / width
            live = rank < limit[r]
            r, s, w, rank = r[live], s[live], w[live], rank[live]
            name = mix(s ^ np.uint64(0xD1B54A32D192ED03))
            hit = low + width * _unit(mix(name)) < w
            yield r[hit], rank[hit], name[hit]
        low += width
        width = width if band == 0 else 2 * width
        band += 1
        more = weight > low
        row, element, weight = row[more], element[more], weight[more]


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket for each band of ``rows`` coordinates."""
    n, k = signature.shape
    out = np.zeros((n, k // rows), np.uint64) + np.arange(1, k // rows + 1, dtype=np.uint64)
    for j in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + signature[:, j::rows][:, : k // rows])
    return out


def _weights(count: np.ndarray, weights: str) -> np.ndarray:
    return np.ones(len(count)) if weights == "set" else count.astype(np.float64)


def sign(df: DataFrame, key: str = "doc_id", text: str = "text", weights: str = "set") -> DataFrame:
    """(doc, c1, c2, size, buckets): the text's 128-bit hash, its total weight and the signature's bands.

    Texts without words have no buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            words = split_words(batch.column("text"))
            row, value, count = shingle_sets(words)
            weight = _weights(count, weights)
            n = batch.num_rows
            some = words.counts > 0
            each = bands(signatures(row, value, weight, n))[some]
            buckets = as_lists(each.ravel().view(np.int64), np.where(some, COORDINATES // ROWS, 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("c1"), batch.column("c2"), pa.array(np.bincount(row, weights=weight, minlength=n)), buckets], ["doc", "c1", "c2", "size", "buckets"])

    return _keyed(df, key, text).mapInArrow(run, "doc long, c1 long, c2 long, size double, buckets array<long>")


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("c1"), F.xxhash64(F.lit("glean"), F.col(text)).alias("c2"), F.col(text).alias("text"))


def _shingles(df: DataFrame, wanted: DataFrame, key: str, text: str, weights: str) -> DataFrame:
    """(node, shingles) of the wanted nodes, from one document each.

    With ``weights="count"`` the second and later places of a shingle are elements of
    their own, so that common elements add up to the least of the two counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            row, value, count = shingle_sets(split_words(batch.column("text")))
            if weights == "count":
                nth = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
                row, value = np.repeat(row, count), np.repeat(value, count)
                value = np.where(nth > 0, mix(value + nth * np.uint64(0x9E3779B97F4A7C15)), value)
            each = np.bincount(row, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("node"), as_lists(value.view(np.int64), each, pa.int64())], ["node", "shingles"])

    docs = Filter.of(wanted, "c1").keep(_keyed(df, key, text), "c1")  # only texts that are probably wanted are shuffled
    wanted = wanted.select("node", "rep", F.col("c1").alias("k1"), F.col("c2").alias("k2"))
    # the texts are dealt out at every size: a plan that changes with the size would hide how it grows
    found = docs.join(wanted.hint("merge"), (docs.c1 == wanted.k1) & (docs.c2 == wanted.k2) & docs.doc.eqNullSafe(wanted.rep)).select("node", "text")
    return found.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", weights: str = "set", block: int = linking.BLOCK) -> DataFrame:
    """(doc, c1, c2, class_id, first): one row per row of ``df``; ``first`` marks the document that stays.

    ``c1`` and ``c2`` hash the text, so (doc, c1, c2) leads back to the rows of
    ``df``; ``first`` holds for all rows that repeat the document that stays.
    """
    signed = written(sign(df, key, text, weights), "signed")
    nodes = signed.where("size > 0").groupBy("c1", "c2").agg(F.min("doc").alias("rep"), F.first("size").cast("long").alias("size"), F.first("buckets").alias("buckets"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # the ids are fixed once written
    buckets = nodes.select(F.explode("buckets").alias("group"), "node")
    shared = buckets.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node"), "node")).alias("lead")).where("n > 1")
    members = written(buckets.join(shared.select("group", F.col("lead.node").alias("lead")), "group"), "members")
    known = written(nodes.drop("buckets").join(members.select("node").distinct(), "node", "left_semi"), "known")
    store = written(_shingles(df, known, key, text, weights), "shingles")
    labels = linking.connect(members, known.select("node", "size"), store, PERCENT, block)

    # classes are named and their staying text chosen among nodes, of which exact copies are one
    placed = nodes.select("node", "rep", "c1", "c2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = F.struct(F.col("rep").isNull(), F.col("rep").alias("doc"), "c1", "c2")
    named = written(placed.groupBy("label").agg(F.min("rep").alias("class_id"), F.min(first).alias("stay")), "named")
    of_text = written(placed.select("label", "c1", "c2").join(named, "label").select("c1", "c2", "class_id", F.col("stay.doc").alias("stay"), ((F.col("c1") == F.col("stay.c1")) & (F.col("c2") == F.col("stay.c2"))).alias("stays")), "classes")
    out = signed.select("doc", "c1", "c2", "size").join(of_text, ["c1", "c2"], "left")
    here = F.col("stays") & F.col("doc").eqNullSafe(F.col("stay"))
    return out.select("doc", "c1", "c2", F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc")).alias("class_id"), F.when(F.col("size") > 0, here).otherwise(True).alias("first"))
