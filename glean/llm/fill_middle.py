"""Fill-in-the-middle transformation by a parallel automaton scan (operator 11).

A text is a sequence of units (lines with their line feed). Two cuts between units,
drawn from a hash of the document's id, part it into prefix, middle and suffix, and
the parts are put into another order behind sentinels:

- ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
- ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
- ``plain``: the text as it is, if it is empty, holds a sentinel or is not drawn.

Finding the cuts needs the number of units first and then the place of two of them.
Texts of up to ``CHUNK`` bytes are one chunk, scanned where they are read. Longer ones
are cut into chunks that are dealt out over all tasks; every chunk sends back its
transition function and its counts for each entry state (a few numbers), those are
composed in the order of the text, and the composition names, for each cut, the chunk
that holds it, the state in which that chunk is entered and the unit to look for. The
task that puts the text together scans these two chunks alone.

A null text is empty. A null id is hashed as the empty string. An empty text has no
unit. Texts without a line feed are one unit, whatever their length. Equal cuts give
an empty middle. Rows that repeat id and text get the same result; rows that share
only the id get the same hashes, but cuts by their own numbers of units. An empty table
gives an empty result. Columns of the input pass through, but for those named like the
added ones, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glean.llm.automaton import LINES, Automaton, Scan, compose
from glean.llm.text import one_array, slices

#: Bytes of a chunk.
CHUNK = 1 << 15
#: The sentinels.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE = 2 << 20
ADDED = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def _draws(key: Column, seed: str) -> list[Column]:
    """The four numbers of a document: the first four groups of eight hexadecimal digits of its hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a text column, and each text's start and length; null is empty."""
    texts = one_array(column.fill_null(b"" if pa.types.is_binary(column.type) else ""))
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, offset=4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, ends[:-1], np.diff(ends)


def _chars(data: np.ndarray) -> int:
    """Code points of whole UTF-8."""
    return int(len(data) - np.count_nonzero((data & 0xC0) == 0x80))


def _arrange(batch: pa.RecordBatch, n: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
    """The added columns, from the number of units and both cuts (byte offsets) of each text."""
    data, starts, lengths = _bytes(batch.column("text"))
    form, prefix, middle, output = [], [], [], []
    for plain, order, s, size, (a, b) in zip(batch.column("plain").to_pylist(), batch.column("order").to_pylist(), starts, lengths, cuts):
        text = data[s : s + size]
        if plain:
            form.append("plain")
            prefix.append(None)
            middle.append(None)
            output.append(text.tobytes())
            continue
        p, m, x = text[:a].tobytes(), text[a:b].tobytes(), text[b:].tobytes()
        form.append(order)
        prefix.append(_chars(text[:a]))
        middle.append(_chars(text[a:b]))
        marks = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
        output.append(b"".join((marks[0], p, marks[1], x) if order == "psm" else (marks[1], x, marks[0], p)) + marks[2] + m)
    return [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]


def _cut_numbers(n: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """How many units lie before each of both cuts."""
    return np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)], 1), axis=1)


def _whole(automaton: Automaton):
    """Texts that are one chunk each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            data, starts, lengths = _bytes(batch.column("text"))
            scan = Scan.of(automaton, data, starts, lengths)
            entry = np.zeros(batch.num_rows, np.int64)
            n = scan.enter(entry)[3]
            units = _cut_numbers(n, *(batch.column(c).to_numpy() for c in ("h1", "h2")))
            cuts = np.stack([lengths, lengths], 1)
            for k in (0, 1):
                inside = np.flatnonzero(units[:, k] < n)
                cuts[inside, k] = scan.find(entry, inside, units[inside, k])
            yield pa.RecordBatch.from_arrays([batch.column("whole"), *_arrange(batch, n, cuts)], ["whole", *ADDED])

    return run


def _split(chunk: int):
    """(doc, c1, c2, at, piece): the chunks of long texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            data, starts, lengths = _bytes(batch.column("text"))
            for i, (s, size) in enumerate(zip(starts, lengths)):
                here = [batch.column(c).slice(i, 1) for c in ("doc", "c1", "c2")]
                for low in range(0, int(size), 64 * chunk):  # never all of a text at once
                    edges = np.arange(low, min(low + 64 * chunk, int(size)), chunk)
                    pieces = [data[s + e : s + min(e + chunk, size)].tobytes() for e in edges]
                    same = pa.array(np.zeros(len(edges), np.int64))
                    yield pa.RecordBatch.from_arrays([*(c.take(same) for c in here), pa.array((edges // chunk).astype(np.int32)), pa.array(pieces, pa.binary())], ["doc", "c1", "c2", "at", "piece"])

    return run


def _summarise(automaton: Automaton):
    """(doc, c1, c2, at, to, units) of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "piece", SLICE):
            data, starts, lengths = _bytes(batch.column("piece"))
            to, units = Scan.of(automaton, data, starts, lengths).summaries()
            lists = [pa.array(list(x.astype(np.int64)), pa.list_(pa.int64())) for x in (to, units)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "c1", "c2", "at")), *lists], ["doc", "c1", "c2", "at", "to", "units"])

    return run


_CUTS = "doc long, c1 long, c2 long, n long, chunk array<int>, state array<int>, unit array<long>"


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compose the chunks of each text; name for both cuts the chunk, its entry state and the unit in it (-1 at the text's end)."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            parts = row["parts"]  # a text of 2 GB has 65,536
            states, before, n = compose(np.array([p["to"] for p in parts]), np.array([p["units"] for p in parts]))
            units = _cut_numbers(np.array([n]), np.array([row["h1"]]), np.array([row["h2"]]))[0]
            chunk = np.searchsorted(before, units, "right") - 1
            ended = units >= n
            out.append({**{c: row[c] for c in ("doc", "c1", "c2")}, "n": n, "chunk": chunk.tolist(), "state": states[chunk].tolist(), "unit": np.where(ended, -1, units - before[chunk]).tolist()})
        kind = pa.schema([("doc", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int64()), ("chunk", pa.list_(pa.int32())), ("state", pa.list_(pa.int32())), ("unit", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_pylist(out, kind)


def _assemble(automaton: Automaton, size: int):
    """Long texts with their resolved cuts: scan the chunks that hold one, and put the parts together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            data, starts, lengths = _bytes(batch.column("text"))
            chunk, state, unit = (np.stack(batch.column(c).to_numpy(zero_copy_only=False)).astype(np.int64) for c in ("chunk", "state", "unit"))
            cuts = np.stack([lengths, lengths], 1)
            for k in (0, 1):
                inside = np.flatnonzero(unit[:, k] >= 0)
                low = chunk[inside, k] * size
                scan = Scan.of(automaton, data, starts[inside] + low, np.minimum(size, lengths[inside] - low))
                cuts[inside, k] = low + scan.find(state[inside, k], np.arange(len(inside)), unit[inside, k])
            yield pa.RecordBatch.from_arrays([batch.column("whole"), *_arrange(batch, batch.column("n").to_numpy(), cuts)], ["whole", *ADDED])

    return run


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "7", rate: int = 100, spm: int = 50, automaton: Automaton = LINES, chunk: int = CHUNK) -> DataFrame:
    """The columns of ``df`` without ``text``, and ADDED.

    ``rate`` and ``spm``: per cent of the documents that are transformed, and of those
    that get the form ``spm``. ``prefix_chars`` and ``middle_chars`` count code points.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in df.columns if c != text and c not in ADDED]
    h1, h2, h3, h4 = _draws(F.col(key), seed)
    body = F.coalesce(F.col(text), F.lit(""))
    marked = body.contains(PREFIX) | body.contains(SUFFIX) | body.contains(MIDDLE)
    docs = df.select(
        F.col(key).cast("long").alias("doc"), body.alias("text"), h1.alias("h1"), h2.alias("h2"), ((body == "") | marked | (h3 % 100 >= rate)).alias("plain"),
        F.when(h4 % 100 < spm, "spm").otherwise("psm").alias("order"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("whole"),
    )
    kind = ", ".join([f"whole {docs.schema['whole'].dataType.simpleString()}", *(f"{k} {v}" for k, v in ADDED.items())])
    short = docs.where(F.octet_length("text") <= chunk).drop("doc").mapInArrow(_whole(automaton), kind)

    long = docs.where(F.octet_length("text") > chunk).withColumns({"c1": F.xxhash64("text"), "c2": F.xxhash64(F.lit("glean"), "text")})
    names = ["doc", "c1", "c2"]
    pieces = long.select(*names, "text").mapInArrow(_split(chunk), "doc long, c1 long, c2 long, at int, piece binary").repartition(parts, *names, "at")
    told = pieces.mapInArrow(_summarise(automaton), "doc long, c1 long, c2 long, at int, to array<long>, units array<long>").dropDuplicates([*names, "at"])
    told = told.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("at", "to", "units"))).alias("parts"))
    drawn = _draws(F.col("doc"), seed)
    cuts = told.withColumns({"h1": drawn[0], "h2": drawn[1]}).mapInArrow(_resolve, _CUTS).withColumnsRenamed({c: f"{c}_" for c in names})
    met = long.join(cuts, long.doc.eqNullSafe(cuts.doc_) & (long.c1 == cuts.c1_) & (long.c2 == cuts.c2_))
    long = met.select("text", "plain", "order", "whole", "n", "chunk", "state", "unit").mapInArrow(_assemble(automaton, chunk), kind)
    return short.unionByName(long).select(*[f"whole.`{c}`" for c in rest], *ADDED)


def restore(output: Column, form: Column) -> Column:
    """The text from its output and form. No sentinel can lie across the seam of two parts, so the first of each is the one put there."""
    p, s, m = (F.locate(x, output) for x in (PREFIX, SUFFIX, MIDDLE))
    size = len(PREFIX)
    piece = lambda a, b: F.substring(output, a + size, b - a - size)
    tail = F.substring(output, m + size, F.char_length(output))
    return F.when(form == "psm", F.concat(piece(p, s), tail, piece(s, m))).when(form == "spm", F.concat(piece(p, m), tail, piece(s, p))).otherwise(output)


#: DuckDB SQL for the query's rows.
ORACLE_SQL = r"""
WITH unit AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS us, sha256('7:' || coalesce(doc_id::varchar, '')) AS h FROM documents
), num AS (
  SELECT *, len(us) AS n, ('0x' || h[1:8])::bigint AS h1, ('0x' || h[9:16])::bigint AS h2, ('0x' || h[25:32])::bigint AS h4 FROM unit
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM num
), part AS (
  SELECT doc_id, text, n, form, array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:], '') AS s FROM cut
)
SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM part
"""
