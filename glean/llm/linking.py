"""Components of sets linked by Jaccard similarity, given groups in which every linked pair meets.

1. Leader rounds. The nodes of a group are compared with a leader, never with each
   other: first with the node of least hash, then with the node that proved nearest to a
   leader before. This links the crowds.
2. The rest. In a group that still holds several components, every node outside its
   largest one asks all blocks of nodes that the group has in other components. A node
   asks a block once, however many groups say so, and a T-occurrence search over the
   block's inverted lists answers, returning a spanning forest of the components it
   links, never pairs. No group is capped and no pair left out.

Tables: ``members`` (group, node, lead), one row for each node of a group with several;
``known`` (node, size); ``store`` (node, shingles), whole sets as distinct hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glean.llm.overlap_search import Index
from glean.llm.shared import written
from glean.llm.text import one_array

#: A block holds about so many nodes at most, and about so many elements.
BLOCK = 1024
BLOCK_ELEMENTS = 1 << 19
#: Queries that meet a block in one task, and their elements, about.
QUERIES = 1024
QUERY_ELEMENTS = 1 << 20


def similar(a: str, b: str, percent: int) -> F.Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def verify(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """(a, b, same, both): overlap and union of distinct pairs of nodes, on their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                columns = {c: one_array(part.column(c)) for c in part.schema.names}
                same, both = [], []
                for i in range(part.num_rows):
                    x, y = (columns[c][i].values.to_numpy() for c in ("shingles_a", "shingles_b"))
                    same.append(len(np.intersect1d(x, y, assume_unique=True)))
                    both.append(len(x) + len(y) - same[-1])
                yield pa.RecordBatch.from_arrays([columns["a"], columns["b"], pa.array(same, pa.int64()), pa.array(both, pa.int64())], ["a", "b", "same", "both"])

    side = lambda s: store.select([F.col(c).alias(s if c == "node" else f"{c}_{s}") for c in store.columns])
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(run, "a long, b long, same long, both long")


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Contract linked labels until no link joins two of them: the components' least nodes.

    ``labels``: (node, label), a label being a node of its component; ``links``:
    (a, b). Each pass hooks every label to its least neighbour, so the number of
    passes is logarithmic; links and labels stay distributed tables.
    """
    end = lambda c, out: labels.select(F.col("node").alias(c), F.col("label").alias(out))
    tied = lambda df: df.where("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    links = written(tied(links.join(end("a", "x"), "a").join(end("b", "y"), "b")), "links")
    while not links.isEmpty():
        hook = written(links.groupBy("x").agg(F.min("y").alias("to")), "hook")
        to = lambda df, c: df.join(hook.select(F.col("x").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        labels = written(to(labels, "label").select("node", "label"), "labels")
        links = written(tied(to(to(links, "x"), "y")), "links")
    return labels


def undecided(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with labels, of the groups that hold several components."""
    now = members.join(labels, "node")
    open_ = now.groupBy("group").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l != h")
    return now.join(written(open_.select("group"), "open"), "group")


def _union(pairs: Iterator[tuple[int, int]]) -> np.ndarray:
    """Those of the pairs that connect what was apart, in turn."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def _search(percent: int):
    """(a, b): labels that the queries link with those of a block's nodes."""

    def run(mine: pa.Table, asked: pa.Table) -> pa.Table:
        lists = one_array(mine.column("shingles"))
        index = Index(lists.flatten().to_numpy(), np.asarray(lists.value_lengths(), np.int64))
        label = mine.column("label").to_numpy()
        wanted, sets = asked.column("asker").to_numpy(), one_array(asked.column("query"))

        def pairs() -> Iterator[tuple[int, int]]:
            for q in range(len(wanted)):
                found = np.unique(label[index.search(sets[q].values.to_numpy(), percent)[0]])
                yield from ((int(wanted[q]), int(x)) for x in found if x != wanted[q])

        links = _union(pairs())
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    return run


def rest(now: DataFrame, store: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): labels linked by two nodes of one open group; ``now``: (group, node, label, size)."""
    nodes = now.select("node", "label", "size").distinct()
    kind = F.floor(F.log(F.col("size")) / math.log(100 / percent)).cast("long")  # similar sizes are of neighbouring kinds
    plan = nodes.groupBy(kind.alias("kind")).agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / BLOCK_ELEMENTS)).alias("blocks"))
    plan = F.broadcast(written(plan, "plan"))  # a row for each power of 100 / percent up to the largest size, 100 at most
    placed = now.withColumn("kind", kind).join(plan, "kind").withColumn("block", F.col("kind") * (1 << 40) + F.pmod(F.xxhash64("node"), "blocks"))
    placed = written(placed.select("group", "node", "label", "size", "block"), "placed")

    by_label = placed.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    main = by_label.groupBy("group").agg(F.max(F.struct("n", "label")).alias("top")).select("group", F.col("top.label").alias("main"))
    met = placed.groupBy("group", "block").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.min("size").alias("least"), F.max("size").alias("most"))
    asks = placed.join(written(main, "main"), "group").where("label != main").select("group", "node", "label", "size").join(written(met.withColumnRenamed("block", "asked"), "met"), "group")
    asks = asks.where((F.col("first") != F.col("label")) | (F.col("last") != F.col("label")))
    asks = asks.where((100 * F.col("most") >= percent * F.col("size")) & (100 * F.col("size") >= percent * F.col("least")))
    asks = written(asks.select(F.col("asked").alias("block"), "node", "label", "size").distinct(), "asks")

    share = asks.groupBy("block").agg(F.greatest(F.ceil(F.count(F.lit(1)) / QUERIES), F.ceil(F.sum("size") / QUERY_ELEMENTS)).cast("int").alias("parts"))
    share = written(share, "parts")
    queries = asks.join(share, "block").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).join(store, "node").select("block", "part", F.col("label").alias("asker"), F.col("shingles").alias("query"))
    held = placed.select("block", "node", "label").distinct().join(share, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = held.join(store, "node").select("block", "part", "label", "shingles")
    held = held.select(*[F.col(c).alias(c) for c in held.columns])
    return held.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInArrow(_search(percent), "a long, b long").distinct()


def connect(members: DataFrame, known: DataFrame, store: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(node, label): the components of ``known``, named by their least nodes."""
    labels = known.select("node", F.col("node").alias("label"))
    size = lambda c: known.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"))
    fits = lambda p: p.join(size("a"), "a").join(size("b"), "b").where(similar("size_a", "size_b", percent)).select("a", "b")
    ordered = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = lambda t: t.where(100 * F.col("same") >= percent * F.col("both")).select("a", "b")

    tested = written(verify(fits(ordered(members.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")))), store), "tested")
    labels = merge_labels(labels, links(tested))

    now = undecided(members, labels)
    near = tested.select(F.explode(F.array("a", "b")).alias("node"), (F.col("same") / F.col("both")).alias("near")).groupBy("node").agg(F.max("near").alias("near"))
    rank = F.struct(-F.coalesce("near", F.lit(0.0)), F.xxhash64("node"), "node", "label")
    second = now.where("node != lead").join(near, "node", "left").groupBy("group").agg(F.min(rank).alias("best"))
    second = written(second.select("group", F.col("best.node").alias("to"), F.col("best.label").alias("at")), "second")
    pairs = ordered(now.join(second, "group").where("label != at").select(F.col("to").alias("a"), F.col("node").alias("b")))
    again = written(verify(fits(pairs.join(tested, ["a", "b"], "left_anti")), store), "tested")
    labels = merge_labels(labels, links(again))

    now = written(undecided(members, labels).join(known.select("node", "size"), "node").select("group", "node", "label", "size"), "undecided")
    return merge_labels(labels, rest(now, store, percent, block))
