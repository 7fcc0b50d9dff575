"""BPE encoding and decoding with a contiguous rank array (operator 6).

A pre-token is held as two parallel arrays: its parts' boundaries and, for every
part but the last, the rank of the merge with its right neighbour. The smallest
rank is found by a scan, its right boundary is deleted, and only the two
neighbouring ranks are refreshed. Words of equal length are rows of one array and
take each step together. The scan beats a heap on short words; words longer than
``SCAN_LIMIT`` bytes go to a heap over the same ranks, which gives the same merges
(lowest rank first, leftmost on ties) without quadratic time.

Edge cases: null text encodes to no ids and decodes to the empty text; the
special tokens' strings inside a text become their single ids; any Unicode text
round-trips; ids outside the vocabulary are an error. Long texts are encoded whole.
Repeated rows are encoded alike. An empty table gives an empty result. Columns of the
input pass through, but for those named like the added ones, which are replaced.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glean.llm.text import as_lists, one_array, ragged, slices

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCAN_LIMIT = 64
#: A unit with white space at an edge, or none at all (RE2).
EDGE = r"^[\s\v\x1c-\x1f\x{85}\p{Z}]|[\s\v\x1c-\x1f\x{85}\p{Z}]$|^$"
#: Units and pre-tokens remembered per Python worker; frequent ones come early, so a full table just stops growing.
REMEMBERED = 300_000
#: Text bytes encoded at once.
SLICE = 4 << 20
NEVER = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + b - sum(p < b for p in plain)))
    return [letters[b] for b in range(256)]


class ByteBPE:
    """Encoder and decoder of one ``tokenizer.json`` (byte-level BPE)."""

    def __init__(self, spec: bytes):
        told = json.loads(spec)
        model = told["model"]
        if model["type"] != "BPE" or (told.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE vocabulary is needed")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.token_bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for letters, i in vocab.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in letters)
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        self.byte_id = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        self.width = len(self.token_bytes)
        keys = np.array([vocab[x] * self.width + vocab[y] for x, y in pairs], np.int64)
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[self.rank_of], np.iinfo(np.int64).max)
        self.rank_of = np.append(self.rank_of, NEVER).astype(np.int32)
        self.first_ranks = self.ranks(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)).reshape(256, 256)
        self.pretoken = regex.compile(PRETOKEN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merges of neighbours; ``NEVER`` where there is none."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank_of[at], NEVER)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids (as little-endian int32 bytes) of each pre-token."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            if len(word) > SCAN_LIMIT:
                out[k] = np.array(self._merge_long(word), "<i4").tobytes()
            else:
                by_length.setdefault(len(word), []).append(k)
        for length, which in by_length.items():
            raw = np.frombuffer(b"".join(words[k] for k in which), np.uint8).reshape(len(which), length)
            for k, ids in self._merge_rows(raw):
                for row, i in zip(ids.astype("<i4"), k.tolist()):
                    out[which[i]] = row.tobytes()
        return out

    def _merge_rows(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merge equally long words, a merge of each at a time; finished rows come out with their places."""
        place, ids = np.arange(len(raw)), self.byte_id[raw]
        ranks = self.first_ranks[raw[:, :-1], raw[:, 1:]]
        while ranks.shape[1]:
            spot = ranks.argmin(1)
            low = ranks[np.arange(len(spot)), spot]
            over = low == NEVER
            if over.any():
                yield place[over], ids[over]
                place, ids, ranks, spot, low = (x[~over] for x in (place, ids, ranks, spot, low))
            if not len(place):
                return
            row, column = np.arange(len(place)), np.arange(ids.shape[1] - 1)
            ids[row, spot] = self.made[low]
            ids = np.take_along_axis(ids, column + (column > spot[:, None]), 1)
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= spot[:, None]), 1)
            for off, some in ((-1, spot > 0), (0, spot < len(column))):
                r, c = row[some], spot[some] + off
                ranks[r, c] = self.ranks(ids[r, c], ids[r, c + 1])
        yield place, ids

    def _merge_long(self, word: bytes) -> list[int]:
        ids: list[int | None] = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        start = self.ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(rank, i, ids[i], ids[i + 1]) for i, rank in enumerate(start) if rank != NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = int(self.made[rank]), None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (rank := int(self.ranks(np.int64(ids[a]), np.int64(ids[b])))) != NEVER:
                    heapq.heappush(heap, (rank, a, ids[a], ids[b]))
        return [i for i in ids if i is not None]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian int32 bytes."""
        found: list[list[str]] = []
        own = {x: np.array([i], "<i4").tobytes() for x, i in self.special.items()}
        for text in texts:
            parts = self.cut.split(text) if self.cut else [text]
            found.append([t for k, part in enumerate(parts) for t in ([part] if k % 2 else self.pretoken.findall(part))])
        # a pre-token never equals a special string: the pattern cuts those up
        missing = [t for t in dict.fromkeys(t for tokens in found for t in tokens) if t not in self.known and t not in own]
        fresh = dict(zip(missing, self.merge([t.encode() for t in missing]))) | own
        for t in missing[: max(0, REMEMBERED - len(self.known))]:
            if len(t) <= SCAN_LIMIT:
                self.known[t] = fresh[t]
        known = self.known
        return [b"".join([known[t] if t in known else fresh[t] for t in tokens]) for tokens in found]

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """Texts of a column of id lists; bytes that are no UTF-8 become U+FFFD."""
        table = pa.array(self.token_bytes, pa.large_binary())
        ids = lists.flatten()
        joined = one_array(table.take(ids))
        ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]
        at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset :][ends]
        whole = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at.astype(np.int64)), joined.buffers()[2]])
        try:
            return whole.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())


class Units:
    """Encodes whole texts unit by unit.

    A unit is what stands between two single spaces. Where neither edge of a unit
    is white space, a pre-token never spans two units, so a unit (with the space
    before it) has the same ids in every text and is encoded once per worker.
    Texts with any other unit are encoded whole.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], opens: np.ndarray, remembered: int = REMEMBERED):
        """``encode`` gives the ids of whole texts; ``opens`` tells of each id whether its token begins with a space."""
        self.encode, self.opens, self.remembered, self.known, self.heads = encode, opens, remembered, {}, {}

    def ids(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and how many each text has."""
        text = pc.fill_null(text, "")
        lists = one_array(pc.split_pattern(text, " "))
        starts = np.asarray(lists.offsets, dtype=np.int64)
        coded = one_array(pc.dictionary_encode(lists.values))
        codes, names = np.asarray(coded.indices, dtype=np.int64), coded.dictionary
        fine = ~np.asarray(pc.match_substring_regex(coded.dictionary, EDGE))
        n = len(text)
        row = np.repeat(np.arange(n), np.diff(starts))
        odd = np.bincount(row[~fine[codes]], minlength=n) > 0
        later = np.ones(len(codes), bool)
        later[starts[:-1]] = False
        later &= ~odd[row]
        used = np.zeros(len(names), bool)
        used[codes[later]] = True
        found = self._resolve(pc.binary_join_element_wise(" ", names.filter(pa.array(used)), "").to_pylist())
        spot = np.cumsum(used) - 1
        opening = lists.values.take(pa.array(starts[:-1][~odd])).to_pylist()
        heads = self._resolve_heads(opening)
        whole = self.encode(text.filter(pa.array(odd)).to_pylist())
        table = [*found, *heads, *whole]
        slot = np.where(later, spot[codes], -1)
        slot[starts[:-1][~odd]] = len(found) + np.arange(len(heads))
        slot[starts[:-1][odd]] = len(found) + len(heads) + np.arange(len(whole))
        slot, row = slot[slot >= 0], row[slot >= 0]
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat = np.frombuffer(b"".join(table), "<i4")
        each = size[slot]
        counts = np.bincount(row, weights=each, minlength=n).astype(np.int64)
        return flat[ragged((np.cumsum(size) - size)[slot], each)], counts

    def _resolve_heads(self, units: list[str]) -> list[bytes]:
        """Ids of units that open texts, with no space before them; long ones, such as texts without spaces, are not remembered."""
        known = self.heads
        if len(known) > self.remembered // 10:
            known.clear()
        missing = [u for u in dict.fromkeys(units) if u not in known]
        fresh = dict(zip(missing, self.encode(missing)))
        known.update((u, ids) for u, ids in fresh.items() if len(u) <= SCAN_LIMIT)
        return [known[u] if u in known else fresh[u] for u in units]

    def _resolve(self, units: list[str]) -> list[bytes]:
        """Ids of units that begin with a space; those not yet known are encoded as one text."""
        known = self.known
        found = [*map(known.get, units)]
        missing = [u for u, ids in zip(units, found) if ids is None]
        fresh: list[bytes] = []
        for a in range(0, len(missing), 30_000):
            some = missing[a : a + 30_000]
            (joined,) = self.encode(["".join(some)])
            at = np.append(np.flatnonzero(self.opens[np.frombuffer(joined, "<i4")]) * 4, len(joined)).tolist()
            if len(at) != len(some) + 1:
                raise ValueError("a unit does not begin with a token that opens with a space")
            fresh += [joined[i:j] for i, j in zip(at, at[1:])]
        for u, ids in zip(missing[: max(0, self.remembered - len(known))], fresh):
            if len(u) <= SCAN_LIMIT:
                known[u] = ids
        rest = iter(fresh)
        return [next(rest) if ids is None else ids for ids in found]


@lru_cache(maxsize=2)
def _coder(spec: bytes) -> tuple[ByteBPE, Units]:
    bpe = ByteBPE(spec)
    return bpe, Units(bpe.encode, np.array([t[:1] == b" " for t in bpe.token_bytes]))


def read_spec(df: DataFrame, path: str):
    """Broadcast a vocabulary file (of fixed size) from the driver to the tasks."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocabulary: str, text: str = "text", out: str = "ids", back: str | None = None) -> DataFrame:
    """Add ``out array<int>``, the BPE ids of ``text``; other columns pass through.

    With ``back``, also add the text decoded from those ids, in the same pass.
    """
    spec = read_spec(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            bpe, units = _coder(spec.value)
            ids = as_lists(*units.ids(batch.column(text)), pa.int32())
            yield _with(batch, {out: ids} | ({back: bpe.decode(ids)} if back else {}))

    return df.mapInArrow(run, _schema(df, {out: T.ArrayType(T.IntegerType())} | ({back: T.StringType()} if back else {})))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out string``, the text of the ids in ``ids`` (a null list gives the empty text)."""
    spec = read_spec(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                yield _with(part, {out: _coder(spec.value)[0].decode(one_array(part.column(ids)))})

    return df.mapInArrow(run, _schema(df, {out: T.StringType()}))


def _schema(df: DataFrame, added: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in added] + [T.StructField(k, v) for k, v in added.items()])


def _with(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [x for x in batch.schema.names if x not in added]
    return pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *added.values()], [*names, *added])
