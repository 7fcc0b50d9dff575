"""Language identification of mixed text (operator 5).

Training counts hashed character n-grams (with word edges) and scripts for each
language, over all training documents; every task adds up its own table, so what
reaches the driver is bounded by languages x ``FEATURES``. A word's score for a
language is the mean log probability of its n-grams times ``SHARPNESS``, relative to
the best language and cut at ``FLOOR``. Unicode script ranges narrow the candidates:
a language that hardly ever uses a word's script gets the floor there. Viterbi over
the words, with ``SWITCH`` as the price of changing language, labels the spans; a
document's language is the one with most lettered words on the path, and its score
that share.

Null texts and texts without a letter (marks are none) are ``und`` with score 0. Words without
letters follow their neighbours. Ties go to the language first by code point.
Texts are labelled whole, whatever their length. Repeated rows are labelled alike, and
count each time where they train. Without training documents every
text is ``und``. An empty table gives an empty result. Other columns, whatever their names,
are not read. More than ``MOST_LANGUAGES`` training languages are an error: there is no
way beyond, as a model holds a column for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glean.llm.shared import written
from glean.llm.text import Words, mix, slices, split_words

FEATURES = 1 << 16
ORDERS = (1, 2, 3, 4)
SHARPNESS = 3.0
FLOOR = -4.0
SWITCH = 6.0
RARE_SCRIPT = 0.002
MOST_LANGUAGES = 1000
UNKNOWN = "und"
#: First code point, end and name of the ranges of widely used scripts.
SCRIPT_RANGES = (
    (0x0041, 0x0250, "Latin"), (0x0370, 0x0400, "Greek"), (0x0400, 0x0530, "Cyrillic"), (0x0530, 0x0590, "Armenian"), (0x0590, 0x0600, "Hebrew"),
    (0x0600, 0x0780, "Arabic"), (0x0900, 0x0980, "Devanagari"), (0x0980, 0x0A00, "Bengali"), (0x0B80, 0x0C00, "Tamil"), (0x0E00, 0x0E80, "Thai"),
    (0x10A0, 0x1100, "Georgian"), (0x1100, 0x1200, "Hangul"), (0x1E00, 0x1F00, "Latin"), (0x1F00, 0x2000, "Greek"), (0x3040, 0x3100, "Kana"),
    (0x3400, 0xA000, "Han"), (0xAC00, 0xD7B0, "Hangul"),
)
SCRIPTS = sorted({name for *_, name in SCRIPT_RANGES}) + ["Other"]


def _points(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words' letters in lower case, each word between edge marks (0), and where each word starts."""
    letters = pc.replace_substring_regex(pc.utf8_lower(vocab), r"[^\p{L}\p{M}]+", "")
    size = np.asarray(pc.utf8_length(letters), dtype=np.int64)
    flat = np.frombuffer("".join(letters.to_pylist()).encode("utf-32-le", "replace"), np.uint32)
    starts = np.cumsum(size + 1) - size - 1
    out = np.zeros(int(size.sum()) + len(size) + 1, np.int64)
    marks = np.ones(len(out), bool)
    marks[starts] = marks[-1] = False
    out[marks] = flat
    return out, starts


def grams(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of every n-gram of the words; none for words without letters."""
    points, starts = _points(vocab)
    word = np.zeros(len(points), np.int64)
    word[starts] = 1
    word = np.cumsum(word) - 1
    edge = points == 0
    scattered = mix(points.astype(np.uint64) + np.uint64(1))
    words, features = [], []
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        value = np.full(m, n, np.uint64)
        inner = np.zeros(m, bool)
        for k in range(n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + scattered[k : k + m]
            if 0 < k < n - 1:
                inner |= edge[k : k + m]
        fine = ~inner & ~(edge[:m] & edge[n - 1 : n - 1 + m])
        at = np.flatnonzero(fine)
        words.append(np.where(edge[at], word[at], word[np.minimum(at, len(word) - 1)]))
        features.append((mix(value[at]) & np.uint64(FEATURES - 1)).astype(np.int64))
    return (np.concatenate(words), np.concatenate(features)) if words else (np.zeros(0, np.int64),) * 2


def scripts(vocab: pa.Array) -> np.ndarray:
    """The script of each word's first letter or mark; -1 for words without letters."""
    points, starts = _points(vocab)
    first = points[starts + 1] if len(starts) else np.zeros(0, np.int64)
    out = np.full(len(first), len(SCRIPTS) - 1)
    for a, b, name in SCRIPT_RANGES:
        out[(first >= a) & (first < b)] = SCRIPTS.index(name)
    out[~np.asarray(pc.match_substring_regex(vocab, r"\p{L}"), dtype=bool)] = -1
    return out


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # FEATURES x languages
    allowed: np.ndarray  # scripts x languages

    def word_scores(self, vocab: pa.Array) -> np.ndarray:
        word, feature = grams(vocab)
        n, width = len(vocab), len(self.languages)
        total = np.stack([np.bincount(word, weights=self.log_p[feature, k], minlength=n) for k in range(width)], 1)
        size = np.bincount(word, minlength=n)
        score = SHARPNESS * total / np.maximum(size, 1)[:, None]
        script = scripts(vocab)
        lettered = script >= 0
        open_ = self.allowed[script]
        open_[~open_.any(1)] = True
        score[~open_] = -np.inf
        score -= score.max(1, keepdims=True)
        score = np.maximum(score, FLOOR)
        score[~lettered] = 0
        return score.astype(np.float32)

    def paths(self, words: Words, scores: np.ndarray) -> np.ndarray:
        """The Viterbi label of every word; all texts take each step together."""
        codes, width = words.codes, len(self.languages)
        order = np.argsort(-words.counts, kind="stable")
        sizes, begin = words.counts[order], words.starts[:-1][order]
        longest = int(sizes[0]) if len(sizes) else 0
        live = np.searchsorted(-sizes, -np.arange(longest), side="left")
        moved = np.zeros((len(codes), width), bool)
        source = np.zeros(len(codes), np.int16)
        value = np.zeros((len(sizes), width), np.float32)
        for t in range(longest):
            n = live[t]
            v, at = value[:n], begin[:n] + t
            if t:
                best = v.argmax(1)
                switch = v[np.arange(n), best] - SWITCH
                take = switch[:, None] > v
                moved[at], source[at] = take, best
                np.maximum(v, switch[:, None], out=v)
            v += scores[codes[at]]
            v -= v.max(1, keepdims=True)
        label = np.zeros(len(codes), np.int16)
        state = value.argmax(1)
        for t in range(longest - 1, -1, -1):
            n = live[t]
            at, s = begin[:n] + t, state[:n]
            label[at] = s
            state[:n] = np.where(moved[at, s], source[at], s)
        return label


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count n-grams and scripts over all rows with a text and a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            words = split_words(batch.column("text"))
            langs = pc.dictionary_encode(batch.column("lang"))
            names, of = langs.dictionary.to_pylist(), np.asarray(langs.indices, dtype=np.int64)[words.row]
            word, feature = grams(words.vocab)
            script = scripts(words.vocab)
            for k, name in enumerate(names):
                times = np.bincount(words.codes[of == k], minlength=len(words.vocab))
                table = tables.setdefault(name, np.zeros(FEATURES + len(SCRIPTS)))
                table[:FEATURES] += np.bincount(feature, weights=times[word], minlength=FEATURES)
                table[FEATURES:] += np.bincount(script[script >= 0], weights=times[script >= 0], minlength=len(SCRIPTS))
        for name, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(table[at])], ["lang", "feature", "n"])

    rows = df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(run, "lang string, feature long, n double").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    counts = written(counts, "counts")  # read twice, counted once
    if (found := counts.agg(F.count_distinct("lang")).first()[0]) > MOST_LANGUAGES:
        raise ValueError(f"{found} languages; at most {MOST_LANGUAGES} are kept on the driver")
    got = counts.toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    index = np.array([languages.index(x) for x in got.column("lang").to_pylist()], np.int64)
    table = np.zeros((FEATURES + len(SCRIPTS), len(languages)))
    table[got.column("feature").to_numpy(), index] = got.column("n").to_numpy()
    seen, used = table[:FEATURES] + 0.5, table[FEATURES:]
    return Model(languages, np.log(seen / seen.sum(0)), used > RARE_SCRIPT * np.maximum(used.sum(0), 1))


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", with_spans: bool = True) -> DataFrame:
    """(key, lang_pred, score[, spans]): a span is a run of words (start, end) with its language."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
    limit = max(1 << 20, (64 << 20) // max(1, len(model.languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        width, names = len(model.languages), np.array([*model.languages, UNKNOWN], object)
        for batch in slices(batches, "text", limit):
            words, n = split_words(batch.column("text")), batch.num_rows
            if width:
                label = model.paths(words, model.word_scores(words.vocab)).astype(np.int64)
                lettered = (scripts(words.vocab) >= 0)[words.codes]
                votes = np.bincount((words.row * width + label)[lettered], minlength=n * width).reshape(n, width)
                total, best = votes.sum(1), votes.argmax(1)
                pred, score = np.where(total > 0, best, width), votes.max(1) / np.maximum(total, 1)
            else:
                label, pred, score = np.zeros(len(words.codes), np.int64), np.zeros(n, np.int64), np.zeros(n)
            columns = [batch.column("key"), pa.array(names[pred], pa.string()), pa.array(score.astype(np.float64))]
            if with_spans:
                row = words.row
                cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (label[1:] != label[:-1])]) if len(row) else np.zeros(0, np.int64)
                base, end = words.starts[:-1][row[cut]], np.r_[cut[1:], len(row)]
                runs = pa.StructArray.from_arrays([pa.array((cut - base).astype(np.int32)), pa.array((end[: len(cut)] - base).astype(np.int32)), pa.array(names[label[cut]], pa.string())], fields=list(span))
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row[cut], minlength=n))].astype(np.int32)), runs))
            yield pa.RecordBatch.from_arrays(columns, ["key", "lang_pred", "score", "spans"][: len(columns)])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * with_spans
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
