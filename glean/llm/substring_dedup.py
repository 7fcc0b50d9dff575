"""Substring dedup by compacting a sparse de Bruijn graph of token k-mers (operator 3).

A window of ``WINDOW`` words is a repeat if its word sequence starts earlier too
(smaller doc_id, or same document and earlier start); all words under a repeat are
removed. The graph keeps this cheap:

1. Anchors. Of the k-mers in a window the one with the smallest hash (leftmost on
   ties) is its anchor. Equal windows have equal anchors at equal offsets, so only
   about one k-mer in seven is an edge of the graph. An edge row has the k-mer's
   hash, its source coordinates and a hash of the words up to the next anchor.
2. Compaction. Grouping the edges by k-mer tells how often each occurs and whether
   all occurrences go on alike. Joined back to the documents, two neighbouring
   anchors lie on a nonbranching path if the first always goes on to the second and
   both occur equally often: all their occurrences are in step, and such neighbours
   compact into one path. The join is a lookup in a broadcast table while the
   repeated k-mers number at most ``BROADCAST``, and a shuffle join beyond.
3. Verification by source coordinates. All windows inside a path occur exactly where
   the path does, so one of them stands for it; windows that reach over a path's end
   stand for themselves. They meet by anchor, with hashes of all their words, in the
   order of their source coordinates: all but the first are repeats.

Rows that share doc_id and text are one document and get the same result; rows
that share only doc_id are ordered by a hash of their text. Null ids come first.
Null texts have no words. Texts under ``WINDOW`` words are never touched; long ones are
taken whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glean.llm.shared import written
from glean.llm.text import WORD_PATTERN, Words, as_lists, mix, slices, split_words, window_hashes, windows_inside

WINDOW = 20
K = 8
SLICE = 4 << 20
#: Repeated k-mers that are broadcast at most (17 bytes each).
BROADCAST = 6_000_000
#: Occurrences of a k-mer whose windows meet in one place; commoner k-mers are split by their windows' hashes.
HOT = 20_000
_END = np.uint64(0x51ED270B153A4D2F)
_SECOND = "glean-words-key2"


def _anchors(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows, each one's anchor (as an index), the anchors' positions, and all k-mer hashes."""
    starts = windows_inside(words, WINDOW)
    grams = window_hashes(hashes, K)
    span = WINDOW - K + 1
    place, low, width = np.arange(len(grams)), grams, 1
    while width < span:
        step = min(width, span - width)
        n = len(low) - step
        left = low[:n] <= low[step:]
        place, low = np.where(left, place[:n], place[step:]), np.where(left, low[:n], low[step:])
        width += step
    found, which = np.unique(place[starts] if len(starts) else np.zeros(0, np.int64), return_inverse=True)
    return starts, which, found, grams


def _links(words: Words, hashes: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Hash of the words from each anchor up to the end of the next one, or to the end of the text."""
    row = words.row[found]
    ends = words.starts[1:][row]
    last = np.ones(len(found), bool)
    last[:-1] = row[1:] != row[:-1]
    stop = np.where(last, ends, np.append(found[1:], 0) + K)
    scattered = mix(hashes)
    odd = np.uint64(0x9E3779B97F4A7C15)
    out = np.where(last, _END, np.uint64(0)) + (stop - found).astype(np.uint64)
    for k in range(int((stop - found).max()) if len(found) else 0):  # a stretch has at most WINDOW + K words, but for the last of a text
        on = np.flatnonzero(found + k < stop)
        out[on] = out[on] * odd + scattered[found[on] + k]
    return mix(out)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, link) of every anchor."""
    for batch in slices(batches, "text", SLICE):
        words = split_words(batch.column("text"))
        hashes = words.hashes()
        _, _, found, grams = _anchors(words, hashes)
        yield pa.RecordBatch.from_arrays([pa.array(grams[found].view(np.int64)), pa.array(_links(words, hashes, found).view(np.int64))], ["gram", "link"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, doc, tie, pos) of every anchor."""
    for batch in slices(batches, "text", SLICE):
        words = split_words(batch.column("text"))
        _, _, found, grams = _anchors(words, words.hashes())
        row = words.row[found]
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(grams[found].view(np.int64)), batch.column("doc").take(at), batch.column("tie").take(at), pa.array((found - words.starts[row]).astype(np.int32))], ["gram", "doc", "tie", "pos"])


def _probes(known):
    """Compact each document's anchors into paths and send out the windows that need a verdict.

    ``known``: a broadcast of sorted repeated k-mers, how often each occurs and
    whether always alike; or None, where the rows bring their anchors' facts along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            words = split_words(batch.column("text"))
            hashes = words.hashes()
            starts, which, found, grams = _anchors(words, hashes)
            row, times, alike = words.row[found], np.ones(len(found), np.int64), np.zeros(len(found), bool)
            if known is not None:
                table, often, same = known.value
                at = np.minimum(np.searchsorted(table, grams[found].view(np.int64)), max(len(table) - 1, 0))
                hit = table[at] == grams[found].view(np.int64) if len(table) else alike
                times[hit], alike[hit] = often[at[hit]], same[at[hit]]
            else:
                lists = batch.column("anchors")
                told, size = lists.flatten(), np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
                at = np.searchsorted(found, np.repeat(words.starts[:-1], size) + np.asarray(told.field("pos"), dtype=np.int64))
                times[at], alike[at] = np.asarray(told.field("times")), np.asarray(told.field("alike").cast(pa.int8())) > 0
            joined = np.zeros(len(found), bool)  # with the anchor before
            joined[1:] = (row[1:] == row[:-1]) & alike[:-1] & (times[1:] == times[:-1]) & (times[1:] > 1)
            path, head = np.cumsum(~joined) - 1, np.flatnonzero(~joined)
            tail = np.append(head[1:], len(found)) - 1 if len(head) else head
            begin, stop = found[head], found[tail] + K
            # windows to send: those of repeated anchors, but of a path's own only the first
            sent = np.flatnonzero(times[which] > 1) if len(starts) else np.zeros(0, np.int64)
            s, mine = starts[sent], path[which[sent]]
            inside = (s >= begin[mine]) & (s + WINDOW <= stop[mine])
            keep = ~inside | (s == begin[mine])
            sent, s, mine, inside = sent[keep], s[keep], mine[keep], inside[keep]
            anchor, of = which[sent], words.row[s]
            base = words.starts[of]
            a, b = s - base, np.where(inside, stop[mine], s + WINDOW) - base
            key = mix(window_hashes(hashes, WINDOW)[s] ^ window_hashes(words.hashes(_SECOND), WINDOW)[s]).view(np.int64)
            salt = np.where(times[anchor] > HOT, key.view(np.uint64) % np.maximum(times[anchor] // HOT, 1).astype(np.uint64), 0).astype(np.int32)
            order = np.lexsort((salt, anchor))
            anchor, salt, a, b, key, of = anchor[order], salt[order], a[order], b[order], key[order], of[order]
            new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])]) if len(anchor) else np.zeros(0, np.int64)
            counts = np.diff(np.r_[new, len(anchor)])
            rows = pa.array(of[new])
            place = (found[anchor[new]] - words.starts[of[new]]).astype(np.int32)
            lists = [as_lists(a.astype(np.int32), counts, pa.int32()), as_lists(b.astype(np.int32), counts, pa.int32()), as_lists(key, counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(grams[found[anchor[new]]].view(np.int64)), pa.array(salt[new]), batch.column("doc").take(rows), batch.column("tie").take(rows), pa.array(place), *lists], _PROBE_NAMES)

    return run


_PROBES = "gram long, salt int, doc long, tie int, pos int, a array<int>, b array<int>, key array<long>"
_PROBE_NAMES = [c.split()[0] for c in _PROBES.split(", ")]


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From probes in the order of (gram, salt, doc, tie, pos): the word ranges under windows that came before.

    Only the windows met under the present k-mer are remembered, each once.
    """
    seen: dict[int, tuple] = {}
    last = None
    for batch in batches:
        size = np.asarray(batch.column("key").value_lengths(), dtype=np.int64)
        row = np.repeat(np.arange(batch.num_rows), size)
        gram, salt = (batch.column(c).to_numpy()[row] for c in ("gram", "salt"))
        key, a, b = (np.asarray(batch.column(c).flatten()) for c in ("key", "a", "b"))
        docs = pc.fill_null(batch.column("doc"), 0).to_numpy()
        none = np.asarray(batch.column("doc").is_null())
        place = np.stack([none.astype(np.int64), docs, batch.column("tie").to_numpy().astype(np.int64), batch.column("pos").to_numpy().astype(np.int64)], 1)
        order = np.lexsort((np.arange(len(key)), key, salt, gram))
        g, t, k = gram[order], salt[order], key[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (t[1:] != t[:-1]) | (k[1:] != k[:-1])] if len(g) else np.zeros(0, bool)
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        late = np.zeros(len(key), bool)
        late[order] = (place[row[order]] != place[row[first]]).any(1)
        if last is not None:
            for i in np.flatnonzero((gram == last[0]) & (salt == last[1])):
                before = seen.get(int(key[i]))
                if before is not None:
                    late[i] = before != tuple(place[row[i]])
        if len(gram):
            end = (int(gram[-1]), int(salt[-1]))
            if end != last:
                seen, last = {}, end
            for i in np.flatnonzero((gram == end[0]) & (salt == end[1])):
                seen.setdefault(int(key[i]), tuple(place[row[i]]))
        hit = np.flatnonzero(late)
        # ranges of one row that touch become one
        new = np.r_[True, (row[hit][1:] != row[hit][:-1]) | (a[hit][1:] > b[hit][:-1])] if len(hit) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        rows = pa.array(row[hit][start])
        if len(start):
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(rows), batch.column("tie").take(rows), pa.array(a[hit][start]), pa.array(np.maximum.reduceat(b[hit], start))], ["doc", "tie", "a", "b"])


def _keyed(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc"), F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 30)).cast("int").alias("tie"), F.col(text).alias("text"), *more)


def _by_document(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Left join on the document key, null ids included."""
    lists = lists.withColumnsRenamed({"doc": "doc_", "tie": "tie_"})
    return docs.join(lists, docs.doc.eqNullSafe(lists.doc_) & (docs.tie == lists.tie_), "left").drop("doc_", "tie_")


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, tie, spans array<struct<a, b>>): the word ranges to remove of each document that has any."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = _keyed(df, key, text)
    edges = docs.select("text").mapInArrow(_edges, "gram long, link long")
    facts = edges.groupBy("gram").agg(F.count(F.lit(1)).alias("times"), (F.min("link") == F.max("link")).alias("alike"))
    facts = written(facts.where("times > 1"), "facts")
    if facts.count() <= BROADCAST:
        table = facts.orderBy("gram").toArrow()
        known = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("gram", "times", "alike")))
        probes = docs.mapInArrow(_probes(known), _PROBES)
    else:
        anchors = docs.mapInArrow(_places, "gram long, doc long, tie int, pos int").join(facts, "gram")
        anchors = anchors.groupBy("doc", "tie").agg(F.collect_set(F.struct("pos", "times", "alike")).alias("anchors"))
        probes = _by_document(docs, anchors).where("anchors IS NOT NULL").mapInArrow(_probes(None), _PROBES)
    ordered = probes.repartition(parts, "gram", "salt").sortWithinPartitions("gram", "salt", "doc", "tie", "pos")
    spans = ordered.mapInArrow(_verdicts, "doc long, tie int, a int, b int")
    return spans.groupBy("doc", "tie").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """All columns of ``df``, then n_words, n_removed and kept_sha256.

    With ``with_text``, ``text`` becomes the kept words joined by single spaces
    where any word is removed, and stays as it is elsewhere; without, it is left
    out. Other columns of ``df`` with one of the three names are replaced.
    """
    added = {"n_words": "long", "n_removed": "long", "kept_sha256": "string"}
    rest = [f.name for f in df.schema.fields if f.name not in added and f.name != text]
    docs = _keyed(df, key, text, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("whole"))
    schema = f"whole {docs.schema['whole'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in added.items()) + ", text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            total, removed, digests, texts = [], [], [], []
            for raw, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans")):
                words = (raw or b"").split()
                kept = words
                if spans.is_valid:
                    keep = np.ones(len(words), bool)
                    for a, b in zip(np.asarray(spans.values.field("a")), np.asarray(spans.values.field("b"))):
                        keep[a:b] = False
                    kept = list(compress(words, keep.tolist()))
                joined = b" ".join(kept)
                total.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined if spans.is_valid else raw)
            columns = [batch.column("whole"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.binary()).cast(pa.string())] * with_text, ["whole", *added] + ["text"] * with_text)

    found = _by_document(docs, repeats(df, key, text)).select("text", "spans", "whole").mapInArrow(run, schema)
    names = [f"whole.`{c}`" for c in rest]
    return found.select(*names, *added, *([F.col("text").alias(text)] if with_text else []))


#: DuckDB SQL for the query's rows.
ORACLE_SQL = f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}') AS ws FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(ws[s + 1 : s + {WINDOW}], ' ') AS seq FROM (SELECT doc_id, ws, unnest(range(len(ws) - {WINDOW - 1})) AS s FROM split WHERE len(ws) >= {WINDOW})
), late AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY seq ORDER BY doc_id, s) AS k FROM win) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, s + o AS i FROM late, range({WINDOW}) t(o)
), word AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM split
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS joined FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(ws)::bigint AS n_words, (len(ws) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(joined, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""
