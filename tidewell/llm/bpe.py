"""Byte-level BPE over padded matrices.

The pieces of a text (the matches of a pattern) are encoded each by itself. Distinct pieces that the worker hasn't met
are put into integer matrices by length, padded on the right. A round looks up the rank of every adjacent pair in a
hash table, merges in each row the leftmost pair of least rank, closes the gap, and takes finished rows out. Pieces over
``LONG`` bytes, for which a row would take a round for each byte, go through a heap instead, with the same result.

Defined cases: a null text is empty and has no tokens; null ids and repeated rows are returned as they come; a very long text is
encoded whole, in its row; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NO_RANK = np.int32(2**31 - 1)
#: Most bytes of a piece that goes into a matrix.
LONG = 256
#: Most cells of a matrix.
CELLS = 1 << 18
#: Most pieces that a worker remembers, and most bytes of them and their ids; a piece over KEEP bytes is forgotten after its texts.
MEMORY, MEMORY_BYTES, KEEP = 160_000, 32 << 20, 1 << 10

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(2**64 - 1)


class PairTable:
    """(left id, right id) -> rank of the merged token, in an open-addressing table of numpy arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY, np.uint64)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == _EMPTY)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.ranks[at[won]] = keys[won], ranks[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, ranks, at = keys[rest], ranks[rest], at[rest]
            at = np.where(self.keys[at] == _EMPTY, at, (at + 1) & (len(self.keys) - 1))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NO_RANK where there is none; padding (-1) on the right has none."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.ranks[at], NO_RANK)
        open_ = np.flatnonzero((seen != keys) & (seen != _EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (seen != _EMPTY)]
        return out


class Codec:
    """A vocabulary of byte strings with ranks, which are their ids too."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    pairs[a, b] = rank
        self.pairs, self.table = pairs, PairTable(pairs)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.memory: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def from_ranks(cls, data: bytes, pattern: str) -> Codec:
        """From the lines of a rank file: base64 of the bytes, space, rank."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}, pattern)

    def matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece; pieces of about the same length, each of two bytes or more."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(lengths.max())
        m = np.full((len(pieces), width), -1, np.int32)
        cells = np.arange(width) < lengths[:, None]
        m[cells] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        p = self.table(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(pieces), width - 1)
        rows, out = np.arange(len(pieces)), [None] * len(pieces)
        while True:
            j = p.argmin(axis=1)
            best = p[np.arange(len(p)), j]
            done = best == NO_RANK
            if done.any():
                for r, n, ids in zip(rows[done].tolist(), lengths[rows[done]].tolist(), m[done], strict=True):
                    out[r] = ids[:n]
                going = ~done
                m, p, rows, j, best = m[going], p[going], rows[going], j[going], best[going]
            if not len(rows):
                return out
            at = np.arange(len(rows))
            m[at, j] = best
            cols = np.arange(m.shape[1] - 1)
            m = np.take_along_axis(m, cols + (cols > j[:, None]), 1)
            lengths[rows] -= 1
            if m.shape[1] == 1:
                p = np.full((len(rows), 1), NO_RANK, np.int32)
                continue
            cols = cols[:-1]
            p = np.take_along_axis(p, cols + (cols > j[:, None]), 1)
            left = np.flatnonzero(j > 0)
            p[left, j[left] - 1] = self.table(m[left, j[left] - 1], best[left])
            right = np.flatnonzero(j < m.shape[1] - 1)
            p[right, j[right]] = self.table(best[right], m[right, j[right] + 1])

    def heap(self, piece: bytes) -> list[int]:
        """The ids of one long piece: a heap of (rank, place) over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo = [(r, i) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(todo)
        while todo:
            rank, i = heapq.heappop(todo)
            k = after[i]
            if ids[i] < 0 or k >= n or self.pairs.get((ids[i], ids[k])) != rank:
                continue
            ids[i], ids[k], after[i] = rank, -1, after[k]
            if after[k] < n:
                before[after[k]] = i
                if (r := self.pairs.get((rank, ids[after[k]]))) is not None:
                    heapq.heappush(todo, (r, i))
            if before[i] >= 0 and (r := self.pairs.get((ids[before[i]], rank))) is not None:
                heapq.heappush(todo, (r, before[i]))
        return [x for x in ids if x >= 0]

    def learn(self, pieces: list[str]) -> None:
        """Puts the ids of pieces, as little-endian unsigned 32-bit integers, into the memory."""
        todo: list[tuple[bytes, str]] = []
        for s in pieces:
            b = s.encode()
            if (i := self.ranks.get(b)) is not None:
                self.memory[s] = i.to_bytes(4, "little")
            elif len(b) > LONG:
                self.memory[s] = np.array(self.heap(b), "<u4").tobytes()
            else:
                todo.append((b, s))
        todo.sort(key=lambda x: len(x[0]))
        i = 0
        while i < len(todo):
            width = -(-len(todo[i][0]) // 4) * 4
            k = min(i + max(1, CELLS // width), len(todo))
            while len(todo[k - 1][0]) > width:
                lo, hi = i, k - 1  # the first that is longer
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if len(todo[mid][0]) <= width else (lo, mid)
                k = lo
            for (_, s), ids in zip(todo[i:k], self.matrix([b for b, _ in todo[i:k]]), strict=True):
                self.memory[s] = ids.astype("<u4").tobytes()
            i = k

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers."""
        out = []
        for at in range(0, len(texts), 64):
            split = [self.pattern.findall(t) for t in texts[at : at + 64]]
            new = list(set().union(*split) - self.memory.keys())
            if new:
                self.learn(new)
            out += [b"".join(map(self.memory.__getitem__, pieces)) for pieces in split]
            for s in new:
                size = len(s) + len(self.memory[s])
                if size > KEEP:
                    del self.memory[s]
                else:
                    self.held += size
            if len(self.memory) > MEMORY or self.held > MEMORY_BYTES:
                self.memory.clear()
                self.held = 0
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """The worker's codec for a rank file's contents."""
    key = hashlib.sha256(data).hexdigest(), pattern
    if key not in _codecs:
        _codecs[key] = Codec.from_ranks(data, pattern)
    return _codecs[key]


def encoded(df: DataFrame, ranks: bytes, pattern: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, ids): the ids of every whole text as binary. ranks is the content of a rank file, sent to the executors once."""
    common.ready(df.sparkSession)
    rows = df.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("_t"))
    sent = df.sparkSession.sparkContext.broadcast(ranks)
    schema = rows.select(id_column).schema.add("ids", "binary")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.encode_all(b.column(1).to_pylist()), pa.binary())], names=schema.names)

    return common.spread(rows).mapInArrow(common.tidy(task), schema)


def decoded(df: DataFrame, ranks: bytes, pattern: str, ids_column: str = "ids") -> DataFrame:
    """df with the column decoded: the bytes that the ids stand for."""
    common.ready(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(ranks)
    at = df.columns.index(ids_column)
    schema = df.select("*").schema.add("decoded", "binary")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.decode(x) for x in b.column(at).to_pylist()], pa.binary())], names=schema.names)

    return df.mapInArrow(common.tidy(task), schema)


def round_trip(df: DataFrame, ranks: bytes, pattern: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, ids, decoded): encoded() and decoded() in one pass through one worker a task."""
    common.ready(df.sparkSession)
    rows = df.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("_t"))
    sent = df.sparkSession.sparkContext.broadcast(ranks)
    schema = rows.select(id_column).schema.add("ids", "binary").add("decoded", "binary")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, pattern)
        for b in batches:
            ids = c.encode_all(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([c.decode(x) for x in ids], pa.binary())], names=schema.names)

    return common.spread(rows).mapInArrow(common.tidy(task), schema)


def digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    both = round_trip(docs, ranks, pattern)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def vocabulary(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with the 50k byte-level vocabulary and decoded again."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
