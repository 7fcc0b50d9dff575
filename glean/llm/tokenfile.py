"""Token-id output: canonical length-limited Huffman blocks (operator 7).

Global id counts give every id of the vocabulary a code length of at most
``MAX_BITS``; lengths alone fix the canonical code. Documents go out in ascending
doc_id order (nulls first; repeated ids by their stream), in blocks that decode on
their own: a block holds the documents' ids and lengths, the bit stream and a bit
offset for every ``EVERY`` symbols. Decoding reads the next ``MAX_BITS`` bits of
all those checkpoints at once and looks symbol and length up in one table.

The files are Parquet tables in a folder that Spark writes: ``codebook`` (id,
bits) and ``blocks`` (part, block, first_index, doc_ids, counts, checkpoints,
payload).

Edge cases: null and empty texts become streams that hold the end id alone; an
empty table gives an empty codebook and no blocks; ids that never occur get no
code; a vocabulary of one used id gets one bit. Code lengths that pass the limit are
repaired until the code is whole again; that is not always the shortest code of limited
length. Long texts are encoded whole; repeated rows are streams of their own. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glean.llm.bpe import Units, byte_letters
from glean.llm.shared import written
from glean.llm.text import as_lists, ragged, slices

MAX_BITS = 16
#: Symbols between two bit-offset checkpoints.
EVERY = 128
#: Ids in a block, about; one longer document has a block of its own.
BLOCK_IDS = 1 << 19
BLOCK_SCHEMA = "part int, block int, first_index long, doc_ids array<long>, counts array<long>, checkpoints array<long>, payload binary"
BLOCK_NAMES = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]


@lru_cache(maxsize=2)
def _library(spec: bytes) -> Units:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(spec.decode())
    made.no_truncation()
    made.no_padding()

    def encode(texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for a in range(0, len(texts), 1000):  # the library's results are large
            out += [np.array(x.ids, "<i4").tobytes() for x in made.encode_batch_fast(texts[a : a + 1000], add_special_tokens=False)]
        return out

    space = byte_letters()[ord(" ")]
    opens = np.zeros(made.get_vocab_size(), bool)
    opens[[i for token, i in made.get_vocab().items() if token.startswith(space)]] = True
    return Units(encode, opens, 1_000_000)


def tokenize(df: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, counts): the ids of every text by the tokenizers library, closed by ``end_id``.

    ``ids`` are little-endian 32-bit integers, or 16-bit ones if the whole
    vocabulary fits. Each task adds one row without ids, whose ``counts`` tell how
    often it wrote each id; all other rows have null there.
    """
    with open(vocabulary, "rb") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _library(spec.value)
        total = np.zeros(max(len(units.opens), end_id + 1), np.int64)
        for batch in slices(batches, "text"):
            ids, counts = units.ids(batch.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            total += np.bincount(ids, minlength=len(total))
            kind = _kind(len(total))
            data = _cut(ids.astype(kind).tobytes(), np.cumsum(counts + 1) * kind.itemsize)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), data, pa.nulls(batch.num_rows, pa.list_(pa.int64()))], ["doc_id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total], pa.list_(pa.int64()))], ["doc_id", "ids", "counts"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary, counts array<long>")


def _kind(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def _cut(data: bytes, stops: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(np.r_[0, stops].astype(np.int32)), pa.py_buffer(data)])


def code_lengths(counts: dict[int, int], limit: int = MAX_BITS) -> dict[int, int]:
    """Huffman code lengths of at most ``limit`` bits.

    Plain Huffman lengths first; lengths above the limit are cut to it and the
    Kraft sum is repaired by lengthening the rarest shorter codes, after which
    spare room shortens the most frequent codes that it fits.
    """
    if len(counts) > 1 << limit:
        raise ValueError("more ids than codes")
    order = sorted(counts, key=lambda i: (counts[i], i))
    if len(order) < 2:
        return dict.fromkeys(order, 1)
    heap = [(counts[i], k) for k, i in enumerate(order)]
    parent = [0] * (2 * len(order) - 1)
    heapq.heapify(heap)
    for node in range(len(order), len(parent)):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = node
        heapq.heappush(heap, (a + b, node))
    depth = [0] * len(parent)
    for node in range(len(parent) - 2, -1, -1):
        depth[node] = depth[parent[node]] + 1
    bits = [min(d, limit) for d in depth[: len(order)]]
    room = (1 << limit) - sum(1 << limit - b for b in bits)
    while room < 0:
        for k, b in enumerate(bits):
            if b < limit and room < 0:
                bits[k] += 1
                room += 1 << limit - b - 1
    for k in range(len(bits) - 1, -1, -1):
        while bits[k] > 1 and 1 << limit - bits[k] <= room:
            room -= 1 << limit - bits[k]
            bits[k] -= 1
    return dict(zip(order, bits))


class Codebook:
    """Canonical codes of (id, bits): shorter first, then smaller id."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        ids, bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        span = 1 << MAX_BITS - bits
        top = np.cumsum(span) - span
        size = int(ids.max()) + 1 if len(ids) else 0
        self.code, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[ids], self.bits[ids] = (top >> MAX_BITS - bits).astype(np.uint64), bits
        self.symbol_at, self.bits_at = np.zeros(1 << MAX_BITS, np.int32), np.ones(1 << MAX_BITS, np.uint8)
        self.symbol_at[: span.sum()] = np.repeat(ids, span)
        self.bits_at[: span.sum()] = np.repeat(bits, span)

    def pack(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bits of several streams, each from a whole byte on.

        Returns the bytes, where each stream ends in them, and the bit offset
        within its stream of every ``EVERY``-th id.
        """
        ends = np.cumsum(counts)
        starts = ends - counts
        total = np.r_[0, np.cumsum(self.bits[ids])]
        size = -(-(total[ends] - total[starts]) // 8)
        stops = np.cumsum(size)
        within = total[:-1] - np.repeat(total[starts], counts)
        at = within + np.repeat(8 * (stops - size), counts)
        word, room = at >> 5, 64 - (at & 31) - self.bits[ids]
        out = np.zeros(int(size.sum() >> 2) + 3, np.uint64)
        if len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            joined = np.bitwise_or.reduceat(self.code[ids] << room.astype(np.uint64), first)
            out[word[first]] |= joined >> np.uint64(32)
            out[word[first] + 1] |= joined & np.uint64(0xFFFFFFFF)
        return out.astype(">u4").tobytes()[: int(size.sum())], stops, within[_marks(starts, counts)]

    def unpack(self, payload: bytes, checkpoints: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids from a payload; all checkpoints advance together, a symbol at a time."""
        words = np.frombuffer(payload + bytes(12 - len(payload) % 4), ">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        lanes = -(-counts // EVERY)
        length = np.full(int(lanes.sum()), EVERY, np.int64)
        last = np.cumsum(lanes)[lanes > 0] - 1
        length[last] = (counts[lanes > 0] - 1) % EVERY + 1
        order = np.argsort(-length, kind="stable")
        live = np.searchsorted(-length[order], -np.arange(EVERY), side="left")
        at = np.asarray(checkpoints, np.int64)[order]
        out = np.zeros((EVERY, len(at)), np.int32)
        mask = np.uint64((1 << MAX_BITS) - 1)
        for k in range(EVERY):
            at = at[: live[k]]
            if not len(at):
                break
            look = ((pairs[at >> 5] >> (64 - MAX_BITS - (at & 31)).astype(np.uint64)) & mask).astype(np.int64)
            out[k, order[: len(at)]] = self.symbol_at[look]
            at = at + self.bits_at[look]
        return out.T[np.arange(EVERY) < length[:, None]]


def _marks(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of every ``EVERY``-th id of each stream."""
    lanes = -(-counts // EVERY)
    return np.repeat(starts, lanes) + EVERY * ragged(np.zeros_like(lanes), lanes)


def write_blocks(streams: DataFrame, path: str, block_ids: int = BLOCK_IDS) -> None:
    """Write what ``tokenize`` gives as a token file at ``path``.

    Ids are coded before the one shuffle, so it moves compressed bits; ranges of
    doc_id then join the documents' bits into blocks. Each document starts on a
    whole byte and has checkpoints of its own.
    """
    spark = streams.sparkSession
    summed = streams.where("counts IS NOT NULL").select(F.posexplode("counts").alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n"), F.count(F.lit(1))).collect()  # the vocabulary
    found = {r["id"]: r["n"] for r in summed if r["n"]}
    kind = _kind(len(summed))
    lengths = sorted(code_lengths(found).items())
    spark.createDataFrame([(int(i), int(b)) for i, b in lengths], "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast(np.array(lengths, np.int64).reshape(-1, 2))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Codebook(*book.value.T)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                raw = part.column("ids").to_pylist()
                counts = np.array([len(x) // kind.itemsize for x in raw], np.int64)
                data, stops, points = made.pack(np.frombuffer(b"".join(raw), kind).astype(np.int64), counts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), as_lists(points, -(-counts // EVERY), pa.int32()), _cut(data, stops)], ["doc_id", "n", "points", "data"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, done = TaskContext.get().partitionId(), 0, 0
        docs: list[tuple] = []

        def joined() -> pa.RecordBatch:
            nonlocal number, done, docs
            size = np.array([len(d[3]) for d in docs], np.int64)
            lanes = np.array([len(d[2]) for d in docs], np.int64)
            points = np.concatenate([np.asarray(d[2], np.int64) for d in docs]) + np.repeat(8 * (np.cumsum(size) - size), lanes)
            counts = [d[1] for d in docs]
            row = [part, number, done, [d[0] for d in docs], counts, points, b"".join(d[3] for d in docs)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            number, done, docs = number + 1, done + sum(counts), []
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], BLOCK_NAMES)

        held = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if docs and held + row[1] > block_ids:
                    yield joined()
                    held = 0
                docs.append(row)
                held += row[1]
        if docs:
            yield joined()

    streams = streams.where("counts IS NULL").select("doc_id", "ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [k / parts for k in range(1, parts)]
    edges = streams.agg(F.percentile_approx("doc_id", steps, 100 * parts)).first()[0] if steps else None  # at most the partitions
    part = F.size(F.filter(F.lit(sorted(set(edges or [])) or [0]), lambda e: e < F.coalesce("doc_id", F.lit(-(1 << 63)))))
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("data").asc(), F.col("n").asc()]
    coded = streams.mapInArrow(code, "doc_id long, n long, points array<int>, data binary")
    coded.repartitionById(parts, part).sortWithinPartitions(*by).mapInArrow(block, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")


def read_blocks(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of a token file.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is the CRC of
    the decoded ids as little-endian unsigned 32-bit integers.
    """
    rows = spark.read.parquet(f"{path}/codebook").collect()  # at most the vocabulary
    book = spark.sparkContext.broadcast(np.array([(r["id"], r["bits"]) for r in rows], np.int64).reshape(-1, 2))
    schema = "part int, doc_id long, first long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Codebook(*book.value.T)
        for batch in batches:
            for row in (batch.slice(i, 1).to_pydict() for i in range(batch.num_rows)):
                counts = np.array(row["counts"][0], np.int64)
                ids = made.unpack(row["payload"][0], np.array(row["checkpoints"][0], np.int64), counts)
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                out = [pa.array([row["part"][0]] * len(counts), pa.int32()), pa.array(row["doc_ids"][0], pa.int64()), pa.array(row["first_index"][0] + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [as_lists(ids, counts, pa.int32())] * with_ids, [c.split()[0] for c in schema.split(", ")])

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)).alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))  # a row for each range partition
    found = blocks.mapInArrow(run, schema).join(F.broadcast(before), "part")
    return found.select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * with_ids))


def token_file(df: DataFrame, path: str, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize ``df``, write the token file at ``path`` and read it back."""
    write_blocks(written(tokenize(df, vocabulary, end_id, key, text), "ids"), path)
    return read_blocks(df.sparkSession, path)
