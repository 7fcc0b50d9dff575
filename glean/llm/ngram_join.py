"""N-gram Jaccard join by T-occurrence search (operator 13).

Texts are lower-cased (A-Z) and taken as sets of ``SHINGLE``-word shingles. Two texts
link if 100 * overlap >= ``PERCENT`` * union; a component is what links connect. The
join is exact (shingles are 64-bit hashes).

1. Order. A sketch tells roughly how often a shingle occurs: once, or in a few steps.
   Sets are ordered from rare to common shingles. Two linked sets of n and m shingles
   share one among the first n - ceil(0.8 n) + 1 of the one and the first
   m - ceil(0.8 m) + 1 of the other: their prefixes. Any order would do for right results;
   rare shingles first leave nothing to share in the prefix of a text that is a fifth its
   own, and keep passages that many texts share out of the prefixes.
2. Groups. Equal sets become one node; the nodes that share a prefix shingle are a group,
   so linked nodes meet. Shingles that occur once need no group.
3. Links. ``linking.connect``: leaders first, then T-occurrence searches (DivideSkip) in
   blocks of nodes: short inverted lists are merged by a heap, long ones probed by binary
   search, and sets that reach the required overlap are linked. Links come back as spanning
   forests; no pairs of copies are formed.

The filters made of the sketch have bounded sizes; false positives cost time only.

Texts of one to four words have one shingle, all their words. Null texts and texts
without words have none and are linked to nothing. Equal sets link, also of texts that
differ in case or white space; rows repeated as a whole are linked likewise. The
component id is the least doc_id of the component, null if no row of it has one. Long
texts are taken whole. An empty table gives none. Other columns of the input, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glean.llm import linking
from glean.llm.minhash import SHINGLE, shingle_sets
from glean.llm.shared import written
from glean.llm.sketch import Filter, blocks_of, summed
from glean.llm.text import WORD_PATTERN, as_lists, mix, slices, split_words

PERCENT = 80
SLICE = 4 << 20
#: Occurrences from which a shingle is shared, and a step more common each.
STEPS = (2, 32, 1024, 32768)
#: Bytes of text for each shingle, roughly; sets the number of the sketch's cells.
BYTES = 6


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle), sorted, of a batch's texts."""
    row, value, _ = shingle_sets(split_words(pc.ascii_lower(batch.column("text"))))
    return row, value


def _cells(x: np.ndarray, bits: int) -> np.ndarray:
    return mix(x) & np.uint64((1 << bits) - 1)


class Order:
    """Rare shingles before common ones, by filters of the cells that reach each of STEPS."""

    def __init__(self, bits: int, steps: list[Filter]):
        self.bits, self.steps = bits, steps

    def prefixes(self, row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, shingle) of each set's prefix, without shingles that occur once."""
        step = np.zeros(len(value), np.uint8)
        for k, f in enumerate(self.steps):
            on = np.flatnonzero(step == k)
            step[on] += f.has(_cells(value[on], self.bits))
        order = np.lexsort((value, step, row))
        row, value = row[order], value[order]
        size = np.bincount(row, minlength=n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        first = (place < (size + (-PERCENT * size // 100) + 1)[row]) & (step[order] > 0)
        return row[first], value[first]


def _sketched(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from blocks_of((_cells(_sets(b)[1], bits) for b in slices(batches, "text", SLICE)), bits)

    return run


def _signed(order):
    """(doc, c1, c2, s1, s2, size, keys): two hashes of the text and of its set, and the prefix shingles that others may share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            n = batch.num_rows
            row, value = _sets(batch)
            size = np.bincount(row, minlength=n)
            some = np.flatnonzero(size)
            sums = []
            for odd in (np.uint64(0x8D265FCDA7B5A3E1), np.uint64(0x3C79AC492BA7B653)):
                s = np.zeros(n, np.uint64)
                s[some] = np.add.reduceat(mix(value ^ odd), (np.cumsum(size) - size)[some]) if len(some) else s[some]
                sums.append(pa.array(s.view(np.int64)))
            at, key = order.value.prefixes(row, value, n)
            keys = as_lists(key.view(np.int64), np.bincount(at, minlength=n), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "c1", "c2")), *sums, pa.array(size), keys], ["doc", "c1", "c2", "s1", "s2", "size", "keys"])

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles)."""
    for batch in slices(batches, "text", SLICE):
        row, value = _sets(batch)
        yield pa.RecordBatch.from_arrays([batch.column("node"), as_lists(value.view(np.int64), np.bincount(row, minlength=batch.num_rows), pa.int64())], ["node", "shingles"])


def shingles_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of ``nodes`` (node, doc, c1, c2), from one document each; only texts that a filter lets pass are shuffled."""
    found = Filter.of(nodes, "c1").keep(docs, "c1")
    nodes = nodes.select("node", *[F.col(c).alias(f"{c}_") for c in ("doc", "c1", "c2")])
    found = found.join(nodes.hint("merge"), found.doc.eqNullSafe(nodes.doc_) & (found.c1 == nodes.c1_) & (found.c2 == nodes.c2_)).select("node", "text")
    return found.mapInArrow(_whole, "node long, shingles array<long>").dropDuplicates(["node"])


def components(df: DataFrame, key: str = "doc_id", text: str = "text", block: int = linking.BLOCK) -> DataFrame:
    """(doc, n_shingles, component_id): one row per row of ``df``."""
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("c1"), F.xxhash64(F.lit("glean"), F.col(text)).alias("c2"), F.col(text).alias("text"))
    texts = docs.select("text").where("text IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(16, (size // BYTES).bit_length() + 2)
    cells = written(summed(texts.mapInArrow(_sketched(bits), "block long, cells binary, times binary"), STEPS[0]), "cells")
    order = spark.sparkContext.broadcast(Order(bits, [Filter.of(cells.where(F.col("n") >= n), "cell") for n in STEPS]))
    signed = written(docs.mapInArrow(_signed(order), "doc long, c1 long, c2 long, s1 long, s2 long, size long, keys array<long>"), "signed")

    sets = signed.where("size > 0").groupBy("s1", "s2").agg(F.min("doc").alias("least"), F.min(F.struct("doc", "c1", "c2")).alias("rep"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = written(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")  # the ids are fixed once written
    groups = nodes.select(F.explode("keys").alias("group"), "node")
    several = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node"), "node")).alias("lead")).where("n > 1")
    members = written(groups.join(several.select("group", F.col("lead.node").alias("lead")), "group"), "members")
    known = written(nodes.select("node", "size", "rep").join(members.select("node").distinct(), "node", "left_semi"), "known")
    store = written(shingles_of(docs, known.select("node", "rep.*")), "shingles")
    labels = linking.connect(members, known.select("node", "size"), store, PERCENT, block)

    placed = nodes.select("node", "s1", "s2", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = written(placed.groupBy("label").agg(F.min("least").alias("component_id")), "named")
    of_set = written(placed.join(named, "label").select("s1", "s2", "component_id"), "classes")
    found = signed.select("doc", "s1", "s2", "size").join(of_set, ["s1", "s2"], "left")
    return found.select("doc", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))



def components_sql(text: str, component: str, *more: str) -> str:
    """DuckDB SQL: all pairs that share a shingle, and the closure of the links."""
    columns = ", ".join([*more, f"min(stop) AS {component}"])
    return rf"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all({text}, '{WORD_PATTERN}') AS ws FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(ws[s:s + {SHINGLE - 1}], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS s FROM word WHERE len(ws) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM shingle a JOIN shingle b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * same >= {PERCENT} * (p.n + q.n - same)
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(doc_id, stop) AS (
  SELECT doc_id, doc_id FROM word UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.stop = e.a
)
SELECT doc_id, {columns} FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id
"""


_UPPER = "".join(map(chr, range(65, 91)))
ORACLE_SQL = components_sql(f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')", "component_id", "coalesce(any_value(n), 0)::bigint AS n_shingles")
#: The same classes without lower-casing: what operator 1 finds by its signatures.
NEAR_DUPLICATES_SQL = components_sql("coalesce(text, '')", "class_id")
