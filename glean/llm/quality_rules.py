"""Line-first cleaning (operator 4).

Every line is judged by itself: ``symbols`` (more than one mark of ``#*$%&|<>``
for two words), ``navigation`` (at least two separators, and one for every four
words), ``shouting`` (five words or more, over 60 % of letters in upper case),
``punctuation`` (ten words or more, none with a closing mark at its end) and
``boilerplate`` (a fixed phrase of whole words for every ``PHRASE_WORDS`` words, so
that prose may mention one). Lines that fail are removed; a document that
loses more than ``max_loss`` of its words is rejected, and so is one that fails
the base rules (under 50 words, or over half of them in repeated 3-word windows).

Edge cases: null and empty texts have no words and fail the base rules; lines
without a word are neither judged nor counted; a text without line breaks is one
line, and long texts are judged whole; repeated rows are judged alike; equal windows are
found by 64-bit hashes within one text; shares exactly at a limit pass. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glean.llm.text import WORD_PATTERN, mix, one_array, slices, split_words, window_hashes, windows_inside

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MAX_LOSS_PCT = 50
SYMBOLS = r"[#*$%&|<>]"
SEPARATOR = r"^[|»›>·•]$"
CLOSED = r"""[.!?:;,…"'”’»)\]。！？]$"""
#: Phrases of page furniture, matched in any case.
BOILERPLATE = r"(?i)\b(cookie policy|accept (all )?cookies|enable javascript|privacy policy|terms of (use|service)|all rights reserved|click here|sign up|log in|subscribe (now|to)|lorem ipsum|skip to content|share this)\b"
#: A line is furniture if it holds a phrase for every so many words.
PHRASE_WORDS = 15
LINE_RULES = ("symbols", "navigation", "shouting", "punctuation", "boilerplate")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lost_words long, n_lost_lines long"


def _per(index: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, weights=weight, minlength=n).astype(np.int64)


def judge(text: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    """The columns of STATS, and the texts without the lines that fail."""
    n = len(text)
    lists = one_array(pc.split_pattern(pc.fill_null(text, ""), "\n"))
    starts = np.asarray(lists.offsets, dtype=np.int64)
    lines, row = lists.values, np.repeat(np.arange(n), np.diff(starts))
    words = split_words(lines)
    vocab, codes, at = words.vocab, words.codes, words.row
    of_word = lambda x: np.asarray(x, dtype=np.int64)[codes]
    chars, marks = of_word(pc.utf8_length(vocab)), of_word(pc.count_substring_regex(vocab, SYMBOLS))
    m = len(lines)
    size, symbols = words.counts, _per(at, marks, m)
    upper = _per(at, of_word(pc.count_substring_regex(vocab, r"\p{Lu}")), m)
    letters = _per(at, of_word(pc.count_substring_regex(vocab, r"\p{L}")), m)
    separators = _per(at, of_word(pc.match_substring_regex(vocab, SEPARATOR)), m)
    closed = _per(at, of_word(pc.match_substring_regex(vocab, CLOSED)), m) > 0
    some = size > 0
    failed = (2 * symbols > size) | ((separators >= 2) & (4 * separators >= size)) | ((size >= 5) & (10 * upper > 6 * letters)) | ((size >= 10) & ~closed)
    phrases = np.asarray(pc.count_substring_regex(lines, BOILERPLATE), dtype=np.int64)
    failed = (failed | ((phrases > 0) & (size <= PHRASE_WORDS * phrases))) & some

    coded = one_array(pc.dictionary_encode(lines))
    pairs = row[some] * np.int64(len(coded.dictionary)) + np.asarray(coded.indices, dtype=np.int64)[some]
    _, first = np.unique(pairs, return_index=True)
    repeated = np.ones(len(pairs), bool)
    repeated[first] = False

    words.starts = words.starts[starts]  # from here on the words of whole texts
    total, of_row = words.counts, words.row
    inside = windows_inside(words, 3)
    keys = mix(window_hashes(words.hashes(), 3)[inside] + np.uint64(0x9E3779B97F4A7C15) * of_row[inside].astype(np.uint64)) if len(inside) else np.zeros(0, np.uint64)
    _, back, often = np.unique(keys, return_inverse=True, return_counts=True)
    hit = inside[often[back] > 1]
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[hit + k] = True

    stats = [total, _per(of_row, chars, n), _per(row, symbols, n), np.bincount(row[some][repeated], minlength=n), _per(of_row, covered, n), _per(row, size * failed, n), np.bincount(row[failed], minlength=n)]
    kept = ~failed
    left = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)][starts].astype(np.int32)), lines.filter(pa.array(kept)))
    return stats, pc.binary_join(left, "\n")


def clean(df: DataFrame, text: str = "text", max_loss_pct: int = MAX_LOSS_PCT) -> DataFrame:
    """All columns of ``df``, then STATS, ``clean_text``, ``base_failed`` and ``kept``.

    ``clean_text`` is the text without failed lines (null text: empty). Columns of
    ``df`` with one of these names are replaced.
    """
    names = [c.split()[0] for c in STATS.split(", ")]
    kept = df.drop(*names, "clean_text", "base_failed", "kept")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), STATS, "clean_text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            stats, left = judge(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(s, pa.int64()) for s in stats), left], [*batch.schema.names, *names, "clean_text"])

    judged = kept.mapInArrow(run, schema)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return judged.withColumn("base_failed", base).withColumn("kept", ~base & (100 * F.col("n_lost_words") <= max_loss_pct * F.col("n_words")))


#: DuckDB SQL for the query's rows, written from the rules rather than from the code above.
ORACLE_SQL = f"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), counted AS (
  SELECT *, regexp_extract_all(line, '{WORD_PATTERN}') AS words FROM line
), judged AS (
  SELECT doc_id, pos, line, words, len(words) AS n,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
    length(regexp_replace(line, '[^\\p{{Lu}}]', '', 'g')) AS upper, len(regexp_extract_all(line, '{BOILERPLATE}')) AS phrases,
    length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) AS letters,
    len(list_filter(words, lambda w: regexp_matches(w, '{SEPARATOR}'))) AS separators,
    len(list_filter(words, lambda w: regexp_matches(w, '{CLOSED.replace("'", "''")}'))) AS closed
  FROM counted WHERE len(words) > 0
), ruled AS (
  SELECT *, 2 * symbols > n OR (separators >= 2 AND 4 * separators >= n) OR (n >= 5 AND 10 * upper > 6 * letters)
    OR (n >= 10 AND closed = 0) OR (phrases > 0 AND n <= {PHRASE_WORDS} * phrases) AS failed,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again
  FROM judged
), by_line AS (
  SELECT doc_id, sum(n) AS n_words, sum(symbols) AS n_symbols, sum(again::int) AS n_dup_lines, sum(CASE WHEN failed THEN n ELSE 0 END) AS lost
  FROM ruled GROUP BY doc_id
), word AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{WORD_PATTERN}')) AS w, unnest(range(len(regexp_extract_all(text, '{WORD_PATTERN}')))) AS i FROM documents
), windowed AS (
  SELECT doc_id, i, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), often AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1 AND w2 IS NOT NULL AS hit FROM windowed
), by_word AS (
  SELECT doc_id, sum(covered::int) AS n_repeat_words FROM (
    SELECT doc_id, hit OR coalesce(lag(hit) OVER o, false) OR coalesce(lag(hit, 2) OVER o, false) AS covered FROM often WINDOW o AS (PARTITION BY doc_id ORDER BY i)
  ) GROUP BY doc_id
), chars AS (SELECT doc_id, sum(length(w)) AS word_chars FROM word GROUP BY doc_id
), whole AS (
  SELECT d.doc_id, coalesce(n_words, 0)::bigint AS n_words, coalesce(word_chars, 0)::bigint AS word_chars, coalesce(n_symbols, 0)::bigint AS n_symbols,
    coalesce(n_dup_lines, 0)::bigint AS n_dup_lines, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words, coalesce(lost, 0)::bigint AS n_lost_words
  FROM documents d LEFT JOIN by_line USING (doc_id) LEFT JOIN by_word USING (doc_id) LEFT JOIN chars USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words) AND 100 * n_lost_words <= {MAX_LOSS_PCT} * n_words AS kept
FROM whole
"""
