"""Phrase collocations by sketch bounds and automata (operator 12).

A text is lower-cased (A-Z) and split at ``.,;:!?`` and line ends into pieces, a piece
at spaces and tabs into words. A phrase is 2 to ``LONGEST`` consecutive words of one
piece; everything is counted per language.

1. Words are counted exactly. A word that occurs under ``LEAST`` times breaks a piece.
2. A sketch counts all phrases; its cells give upper bounds. The cells that reach
   ``LEAST`` go into a filter of bounded size.
3. Of each text only the runs remain in which every pair of neighbours passes the
   filter; no candidate lies elsewhere. From each of their words on, the longest phrase
   whose beginnings of two words and more all pass is its window; the windows of a task
   are told once each, with how often they occur, and dealt out by language and first pair.
4. All beginnings of a window are candidates, and every occurrence of a candidate begins
   one window. The candidates of one deal are compiled into automata of bounded size,
   every phrase guarded by the mark of a window in front and by the delimiter behind,
   which scan the windows of the deal. So no text is scanned again for more candidates,
   and sums are exact.
5. Thresholds. A candidate with ``a`` occurrences, cut after its first k words into
   parts with ``l`` and ``r``, scores floor(SCALE * a / (l + r)); its lowest cut counts,
   the shorter first part on ties. It goes if a longer candidate that holds it has at
   least ``SHARE`` per cent of its occurrences.

False positives of sketch and filter cost time only: what the automata count under
``LEAST`` is dropped. Within a slice of text phrases are kept apart by 64-bit hashes,
by their words from there on.

Null texts are empty, null languages are ``und``. Repeated rows count each time. Ties
in the ranking go to the larger ``a``, then to the smaller phrase in byte order, so ranks
are unique. Long texts are handled whole. An empty table gives no phrase. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glean.llm.shared import written
from glean.llm.sketch import Filter, blocks_of, summed
from glean.llm.text import Words, hash_strings, mix, one_array, slices, split_words, window_hashes

LONGEST = 4
LEAST = 30
SHARE = 80
SCALE = 2_000_000
TOP = 2000
#: Characters of the windows that one automaton is compiled from.
ROUND = 3_000_000
#: Parts into which a language's windows are dealt by their first pair.
BUCKETS = 1 << 10
#: Rows that a task gathers before it adds up equal ones, and cells of the sketch that it holds.
HELD, CELLS = 1 << 18, 1 << 21
SLICE = 2 << 20
STOP = "."
_PIECES = r"[.,;:!?\n\x0b\x0c\r]+"


def _normal(text: pa.Array) -> pa.Array:
    """Lower case, with a word of its own, ``STOP``, where a piece ends."""
    return pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(text, "")), _PIECES, f" {STOP} ")


class Tokens:
    """Words of several texts, with the hash of each one's language and the places that no phrase crosses."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        self.words: Words = split_words(text)
        self.hashes, self.row = self.words.hashes(), self.words.row
        self.lang = mix(hash_strings(one_array(lang)))
        stop = np.asarray(pc.equal(self.words.vocab, STOP))
        self.breaks = stop[self.words.codes] if len(stop) else np.zeros(0, bool)

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word's place, hash) of every phrase of k words."""
        at, n = np.r_[0, np.cumsum(self.breaks)], max(0, len(self.row) - k + 1)
        good = np.flatnonzero((self.row[k - 1 : k - 1 + n] == self.row[:n]) & (at[k : k + n] == at[:n]))
        return good, mix(window_hashes(self.hashes, k)[good] ^ self.lang[self.row[good]])

    def drop(self, frequent: Filter) -> None:
        """Words that are not frequent break pieces."""
        self.breaks |= ~frequent.has(mix(self.hashes ^ self.lang[self.row]))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches with equal rows made one, ``n`` added up; rows that are not held together stay apart."""
    held: list[pa.Table] = []
    size = 0

    def together() -> pa.Table:
        table = pa.concat_tables(held)
        keys = [c for c in table.column_names if c != "n"]
        return table.group_by(keys, use_threads=False).aggregate([("n", "sum")]).select([*keys, "n_sum"]).rename_columns([*keys, "n"])

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size >= HELD:
            held = [together()]
            size = held[0].num_rows
            if size >= HELD // 2:
                yield held[0]
                held, size = [], 0
    if size:
        yield together()
    pa.default_memory_pool().release_unused()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), about once a task."""

    def sliced() -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            t = Tokens(_normal(batch.column("text")), batch.column("lang"))
            names = one_array(pc.dictionary_encode(batch.column("lang")))
            size = len(t.words.vocab)
            of = np.asarray(names.indices, dtype=np.int64)[t.row] * size + t.words.codes
            found, n = np.unique(of[~t.breaks], return_counts=True)
            word = t.words.vocab.take(pa.array(found % max(size, 1)))
            lang = names.dictionary.take(pa.array(found // max(size, 1)))
            yield pa.RecordBatch.from_arrays([lang, word, pa.array(n)], ["lang", "word", "n"])

    for table in _added(sliced()):
        yield from table.to_batches()


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``key`` of each word and language, as ``Tokens.drop`` asks for it."""
    for batch in batches:
        key = mix(hash_strings(batch.column("word")) ^ mix(hash_strings(batch.column("lang"))))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])


def _sketched(frequent, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashes():
            for batch in slices(batches, "text", SLICE):
                t = Tokens(_normal(batch.column("text")), batch.column("lang"))
                t.drop(frequent.value)
                for k in range(2, LONGEST + 1):
                    yield t.phrases(k)[1]

        yield from blocks_of(hashes(), bits, CELLS)

    return run


def _windows(frequent, hot, bits: int):
    """(lang, bucket, windows, times): the windows of each text's runs, about once a task, packed by language and first pair."""
    cells = np.uint64((1 << bits) - 1)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            t = Tokens(_normal(batch.column("text")), batch.column("lang"))
            t.drop(frequent.value)
            names = one_array(pc.dictionary_encode(batch.column("lang")))
            of = np.asarray(names.indices, dtype=np.int64)
            long = np.ones(len(t.row), np.int8)  # words of the window that begins here
            value, pair = np.zeros(len(t.row), np.uint64), np.zeros(len(t.row), np.uint64)
            for k in range(2, LONGEST + 1):
                at, found = t.phrases(k)
                some = np.flatnonzero(long[at] == k - 1)
                some = some[hot.value.has(found[some] & cells)]
                long[at[some]], value[at[some]] = k, found[some]
                if k == 2:
                    pair = value.copy()
            begun = np.flatnonzero(long > 1)
            _, first, n = np.unique(value[begun], return_index=True, return_counts=True)
            start = begun[first]
            windows, order = [], []
            for k in range(2, LONGEST + 1):
                mine = np.flatnonzero(long[start] == k)
                words = [t.words.vocab.take(pa.array(t.words.codes[start[mine] + j])) for j in range(k)]
                windows.append(pc.binary_join_element_wise(*words, " ").cast(pa.string()))
                order.append(mine)
            order = np.concatenate(order)
            lang = names.dictionary.take(pa.array(of[t.row[start[order]]]))
            bucket = (pair[start[order]] % np.uint64(BUCKETS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([lang, pa.array(bucket), pa.concat_arrays(windows), pa.array(n[order])], ["lang", "bucket", "window", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _added(sliced(batches)):
            names = one_array(pc.dictionary_encode(one_array(table["lang"])))
            key = np.asarray(names.indices, dtype=np.int64) * BUCKETS + table["bucket"].to_numpy()
            order = np.argsort(key, kind="stable")
            found, n = np.unique(key, return_counts=True)
            ends = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, one_array(table[c]).take(pa.array(order))) for c in ("window", "n")]
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(found // BUCKETS)), pa.array((found % BUCKETS).astype(np.int32)), *lists], ["lang", "bucket", "windows", "times"])

    return run


def _matches(windows: list[str], times: np.ndarray) -> Iterator[tuple[str, int]]:
    """Each beginning of the windows and how often it occurs: one automaton of all beginnings scans the windows."""
    import ahocorasick

    words = [w.split(" ") for w in windows]
    phrases = list({" ".join(ws[:k]) for ws in words for k in range(2, len(ws) + 1)})
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, phrase in enumerate(phrases):
        automaton.add_word(f"{STOP} {phrase} ", i)
    automaton.make_automaton()
    hits = np.fromiter(chain.from_iterable(automaton.iter(f"{STOP} {f' {STOP} '.join(windows)} ")), np.int64).reshape(-1, 2)
    ends = np.cumsum([len(w) + len(STOP) + 2 for w in windows])
    total = np.zeros(len(phrases), np.int64)
    np.add.at(total, hits[:, 1], times[np.searchsorted(ends, hits[:, 0], "right")])
    return zip(phrases, total.tolist())


def _scan(least: int):
    """(lang, phrase, a): the candidates of equal (lang, bucket), which follow each other, that occur at least ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((batch, i) for batch in batches for i in range(batch.num_rows))
        for (lang, _), some in groupby(rows, lambda r: (r[0].column("lang")[r[1]].as_py(), r[0].column("bucket")[r[1]].as_py())):
            times: Counter = Counter()
            for batch, i in some:
                for window, n in zip(batch.column("windows")[i].values.to_pylist(), batch.column("times")[i].values.to_pylist()):
                    times[window] += n
            windows, total = sorted(times), Counter()
            size = np.cumsum([len(w) for w in windows])
            for _, part in groupby(range(len(windows)), lambda j: int(size[j]) // ROUND):
                mine = [windows[j] for j in part]
                for phrase, n in _matches(mine, np.array([times[w] for w in mine], np.int64)):
                    total[phrase] += n
            often = sorted(p for p, n in total.items() if n >= least)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(often), pa.string()), pa.array(often, pa.string()), pa.array([total[p] for p in often], pa.int64())], ["lang", "phrase", "a"])

    return run


def counted(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n) of all words, and (lang, phrase, a) of all phrases that occur at least ``least`` times."""
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text IS NOT NULL")
    words = docs.mapInArrow(_word_counts, "lang string, word string, n long")
    words = written(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    frequent = spark.sparkContext.broadcast(Filter.of(words.where(F.col("n") >= least).mapInArrow(_keyed, "key long"), "key"))
    total = words.agg(F.sum("n")).first()[0] or 0
    bits = max(16, int(total).bit_length())
    parts = docs.mapInArrow(_sketched(frequent, bits), "block long, cells binary, times binary")
    hot = spark.sparkContext.broadcast(Filter.of(written(summed(parts, least), "hot"), "cell"))
    packed = docs.mapInArrow(_windows(frequent, hot, bits), "lang string, bucket int, windows array<string>, times array<long>")
    packed = packed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "bucket").sortWithinPartitions("lang", "bucket")
    return words, written(packed.mapInArrow(_scan(least), "lang string, phrase string, a long"), "phrases")


def mine(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = SHARE) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate that stays."""
    words, phrases = counted(df, text, lang, least)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    split = phrases.withColumn("ws", F.split("phrase", " "))
    part = lambda low, n: F.array_join(F.slice("ws", low, n), " ")
    m = F.size("ws")

    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).unionByName(words.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), F.col("n").alias("f")))
    side = lambda part, f: parts.select("lang", F.col("part").alias(part), F.col("f").alias(f))
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), m - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, m - F.col("k")).alias("rest"))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    score = F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = split.where(m > 2).withColumn("size", F.explode(F.sequence(F.lit(2), m - 1))).withColumn("low", F.explode(F.sequence(F.lit(1), m - F.col("size") + 1)))
    longer = inner.select("lang", part(F.col("low"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    found = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * exact("longest") < share * exact("a")))
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return found.join(n, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))


def top(found: DataFrame, most: int = TOP) -> DataFrame:
    """The first ``most`` of each language, with their ``rank``."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_UPPER = "".join(map(chr, range(65, 91)))
#: DuckDB SQL for the query's rows.
ORACLE_SQL = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\n\x0b\x0c\r]')) AS p FROM documents
), word AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM piece
), total AS (
  SELECT lang, sum(len(ws)) AS n FROM word GROUP BY lang
), gram AS (
  SELECT lang, m, array_to_string(ws[s:s + m - 1], ' ') AS phrase FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS s FROM word, range(1, {LONGEST + 1}) t(m) WHERE len(ws) >= m)
), f AS (
  SELECT lang, m, phrase, count(*) AS a FROM gram GROUP BY ALL HAVING count(*) >= {LEAST}
), cut AS (
  SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)
), score AS (
  SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, ({SCALE}::hugeint * cut.a) // (x.a + y.a) AS score FROM cut JOIN f x ON cut.lang = x.lang AND cut.first = x.phrase JOIN f y ON cut.lang = y.lang AND cut.rest = y.phrase
), least_cut AS (
  SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(ws[s:s + z - 1], ' ') AS phrase, max(a) AS longest FROM (SELECT lang, a, string_split(phrase, ' ') AS ws, z, unnest(range(1, m - z + 2)) AS s FROM f, range(2, {LONGEST}) t(z) WHERE z < m) GROUP BY ALL
), kept AS (
  SELECT c.* FROM least_cut c LEFT JOIN inside i USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < {SHARE} * a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept
)
SELECT lang, rank, phrase, a, l, r, n::bigint AS n, score::bigint AS score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
