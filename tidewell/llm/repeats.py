"""Removal of repeated passages by Rabin-Karp hashes of all windows of a fixed number of words.

1. Every batch of documents hashes all its windows with a rolling polynomial modulo 2**64 (differences of prefix sums).
   Of a hash that comes more than once in the batch only the first place goes on; the later ones are repeats already.
   So a hot window costs one entry a batch.
2. Hashes are dealt to buckets by their highest bits and packed by batch and bucket: sorted, as differences, with the
   place in the batch. A bucket counts each hash over all batches; where it has several places, all but the first in
   the order of documents are repeats.
3. The starts of repeated windows return to their documents, where they merge into maximal intervals, which are cut out.

Two unequal windows share a 64-bit hash with a chance of 2**-64 a pair, which is about n**2 / 2**65 among n windows.

Defined cases: a null text has no words; documents with fewer words than a window lose none; a null doc_id comes before
all others; rows that share a doc_id are documents of their own, told apart by 63 bits of their texts and in the order of these, and
equal rows are one document, returned as often as it comes; a very long text is hashed whole, as a batch of its own; an empty
table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 20
#: Words of a batch, and bytes of text that a bucket stands for.
BATCH_WORDS, BUCKET_BYTES = 800_000, 16 << 20
NO_ID = -(2**63)

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """The hash of each run of window words, from the words' hashes: sum of word j times base**j, then mixed."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(_BASE, n), dtype=np.uint64)))
    h = (sums[window:] - sums[:-window]) * powers(pow(_BASE, -1, 1 << 64), n - window + 1)
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def planes(x: np.ndarray) -> bytes:
    """Unsigned integers as their number of bytes, then one plane for each byte that any of them needs."""
    need = (int(x.max(initial=0)).bit_length() + 7) // 8
    return struct.pack("<B", need) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :need].T).tobytes()


def unplanes(data: memoryview, n: int) -> tuple[np.ndarray, int]:
    """What planes() packed, and how many bytes it took."""
    need = data[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :need] = np.frombuffer(data, np.uint8, need * n, 1).reshape(need, n).T
    return out.view("<u8").ravel(), 1 + need * n


def packed(hashes: np.ndarray, places: np.ndarray, doc_ids: np.ndarray, checks: np.ndarray, starts: np.ndarray) -> bytes:
    """Sorted hashes with places in the batch, and the batch's documents that they lie in: id, checksum, first place."""
    used = np.unique(np.searchsorted(starts, places, "right") - 1)
    ids, firsts = doc_ids[used], starts[used]
    docs = zlib.compress(np.diff(ids, prepend=0).astype("<i8").tobytes() + np.diff(firsts, prepend=0).astype("<u4").tobytes() + checks[used].astype("<i8").tobytes(), 1)
    return struct.pack("<III", len(hashes), len(used), len(docs)) + docs + planes(np.diff(hashes, prepend=np.uint64(0))) + planes(places.astype(np.uint64))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, k, size = struct.unpack_from("<III", blob)
    raw = zlib.decompress(blob[12 : 12 + size])
    ids = np.cumsum(np.frombuffer(raw, "<i8", k))
    starts = np.cumsum(np.frombuffer(raw, "<u4", k, 8 * k), dtype=np.int64)
    checks = np.frombuffer(raw, "<i8", k, 12 * k)
    view = memoryview(blob)[12 + size :]
    deltas, used = unplanes(view, n)
    places, _ = unplanes(view[used:], n)
    return np.cumsum(deltas, dtype=np.uint64), places.astype(np.int64), ids, checks, starts


#: kind 0: hashes of a batch; kind 1: starts of repeated windows of the documents that belong to the bucket.
DEALT = "bucket int, kind int, data binary"


class _Batch:
    def __init__(self, window: int, buckets: int) -> None:
        self.window, self.buckets = window, buckets
        self.docs: dict[tuple[int, int], np.ndarray] = {}
        self.words = 0

    def add(self, doc_id: int, text: bytes, check: int = 0) -> None:
        key = (doc_id, check)
        words = text.split()
        if len(words) >= self.window and key not in self.docs:
            self.docs[key] = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
            self.words += len(words)

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        """The batch's rows of DEALT: its hashes by bucket, and the repeats within it by the buckets of their documents."""
        order = sorted(self.docs)
        ids, checks = np.array([k[0] for k in order], np.int64), np.array([k[1] for k in order], np.int64)
        sizes = np.array([len(self.docs[k]) for k in order], np.int64)
        starts = np.cumsum(sizes) - sizes
        h = window_hashes(np.concatenate([self.docs[k] for k in order]), self.window)
        good = np.ones(len(h), bool)  # windows that lie in one document
        for back in range(1, self.window):
            edge = starts[1:] - back
            good[edge[edge < len(h)]] = False
        places = np.flatnonzero(good)
        h = h[places]
        by = np.argsort(h, kind="stable")
        h, places = h[by], places[by]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        again = np.sort(places[~first])
        h, places = h[first], places[first]
        bucket = (h >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1, dtype=np.uint64))
        for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if j > i:
                yield b, 0, packed(h[i:j], places[i:j], ids, checks, starts)
        doc = np.searchsorted(starts, again, "right") - 1
        yield from dealt(ids[doc], checks[doc], again - starts[doc], self.buckets)
        self.docs, self.words = {}, 0


def dealt(ids: np.ndarray, checks: np.ndarray, pos: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Starts of repeated windows as rows of DEALT, one for each bucket that has any of their documents. A row holds its
    documents' ids, checksums and numbers of starts, and the starts."""
    to = (((ids ^ checks).astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    order = np.lexsort((pos, checks, ids, to))
    to, ids, checks, pos = to[order], ids[order], checks[order], pos[order]
    for b, i, j in _runs(to):
        first = np.flatnonzero(np.concatenate(([True], (ids[i + 1 : j] != ids[i : j - 1]) | (checks[i + 1 : j] != checks[i : j - 1]))))
        n = np.diff(np.append(first, j - i))
        yield b, 1, struct.pack("<I", len(first)) + zlib.compress(ids[i:j][first].astype("<i8").tobytes() + checks[i:j][first].astype("<i8").tobytes() + n.astype("<u4").tobytes() + pos[i:j].astype("<u4").tobytes(), 1)


def by_document(blobs: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(doc_id, checksum, all its starts) from the rows that dealt() made for a bucket."""
    parts: list[list[np.ndarray]] = [[], [], []]
    for b in blobs:
        (k,) = struct.unpack_from("<I", b)
        raw = zlib.decompress(b[4:])
        n = np.frombuffer(raw, "<u4", k, 16 * k)
        for to, x in zip(parts, (np.repeat(np.frombuffer(raw, "<i8", k), n), np.repeat(np.frombuffer(raw, "<i8", k, 8 * k), n), np.frombuffer(raw, "<u4", -1, 20 * k)), strict=True):
            to.append(x)
    ids, checks, pos = (np.concatenate(x) for x in parts)
    order = np.lexsort((checks, ids))
    ids, checks, pos = ids[order], checks[order], pos[order]
    doc = np.cumsum(np.concatenate(([0], (ids[1:] != ids[:-1]) | (checks[1:] != checks[:-1]))).astype(np.int64))
    for _, i, j in _runs(doc):
        yield int(ids[i]), int(checks[i]), pos[i:j].astype("<u4").tobytes()


def _runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of the runs of equal values."""
    if len(x):
        cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
        yield from ((int(x[i]), i, j) for i, j in zip(cuts, cuts[1:], strict=False))


def repeats_of(blobs: list[bytes], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows of DEALT for the windows of a bucket whose hash has an earlier place."""
    parts = [unpacked(b) for b in blobs]
    h = np.concatenate([p[0] for p in parts])
    by = np.argsort(h, kind="stable")
    same = h[by][1:] == h[by][:-1]
    many = np.zeros(len(h), bool)
    many[1:] |= same
    many[:-1] |= same
    by = by[many]
    if not len(by):
        return
    ends = np.cumsum([len(p[0]) for p in parts])
    src = np.searchsorted(ends, by, "right")
    ids, checks, pos = (np.zeros(len(by), np.int64) for _ in range(3))
    for s in np.unique(src).tolist():
        mine = src == s
        _, places, d_ids, d_checks, d_starts = parts[s]
        p = places[by[mine] - (ends[s] - len(places))]
        d = np.searchsorted(d_starts, p, "right") - 1
        ids[mine], checks[mine], pos[mine] = d_ids[d], d_checks[d], p - d_starts[d]
    hs = h[by]
    order = np.lexsort((pos, checks, ids, hs))
    hs, ids, checks, pos = hs[order], ids[order], checks[order], pos[order]
    lead = np.maximum.accumulate(np.where(np.concatenate(([True], hs[1:] != hs[:-1])), np.arange(len(hs)), 0))
    later = (ids != ids[lead]) | (checks != checks[lead]) | (pos != pos[lead])
    yield from dealt(ids[later], checks[later], pos[later], buckets)


def repeated_windows(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """(_id, _chk, starts): for each document with repeats the starts of all repeated windows, packed.

    rows: (_id, _chk, text as binary), as documents() makes them. Two shuffles, of hashes to their buckets and of starts to the buckets of their documents,
    both in packed rows, at most one for each task, batch and bucket.
    """

    def table(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for r in rows:
            out.append(r)
            size += len(r[2])
            if size > 4 << 20 or len(out) >= 5000:
                yield _rows(out, DEALT)
                out, size = [], 0
        if out:
            yield _rows(out, DEALT)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = _Batch(window, buckets)
        for b in batches:
            for i, c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                batch.add(i, t.as_py(), c)
                if batch.words >= BATCH_WORDS:
                    yield from table(batch.rows())
        if batch.docs:
            yield from table(batch.rows())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.groups(batches, ["bucket"]):
            kinds, data = t["kind"].to_pylist(), t["data"].to_pylist()
            bucket = t["bucket"][0].as_py()
            del t
            yield from table((bucket, 1, x) for k, x in zip(kinds, data, strict=True) if k == 1)
            if blobs := [x for k, x in zip(kinds, data, strict=True) if k == 0]:
                del data
                yield from table(repeats_of(blobs, buckets))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.groups(batches, ["bucket"]):
            out = list(by_document(t["data"].to_pylist()))
            for k in range(0, len(out), 5000):
                yield _rows(out[k : k + 5000], FOUND)

    # a bucket's number is its task's, so that every task has one bucket
    by_bucket = lambda df: df.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    return by_bucket(by_bucket(rows.mapInArrow(hashed, DEALT)).mapInArrow(counted, DEALT)).mapInArrow(together, FOUND)


FOUND = "_id long, _chk long, starts binary"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, _TYPES[t]) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def intervals(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [a, b) of words that windows at the starts cover; windows that touch are one interval."""
    s = np.unique(starts)
    if not len(s):
        return []
    cut = np.flatnonzero(np.diff(s) > window)
    return list(zip(s[np.concatenate(([0], cut + 1))].tolist(), (s[np.concatenate((cut, [len(s) - 1]))] + window).tolist(), strict=True))


def documents(rows: DataFrame) -> DataFrame:
    """(doc_id, _id, _chk, _t) from (doc_id, _t): _id and _chk tell documents apart. _chk is zero for an id that comes once, so that it
    takes no room in the shuffle; else 63 bits of the text, a 16-bit checksum before 47 bits of a hash."""
    again = common.kept(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")), "again")
    n = again.limit(common.BROADCAST_ROWS + 1).count()
    if n:
        again = F.broadcast(again) if n <= common.BROADCAST_ROWS else again
        rows = rows.join(again, F.col("doc_id") == F.col("_again"), "left")
    else:
        rows = rows.withColumn("_again", F.lit(None).cast("long"))
    check = F.shiftleft(F.crc32("_t") % 65536, 47).bitwiseOR(F.shiftrightunsigned(F.xxhash64("_t"), 17))
    many = F.col("doc_id").isNull() | F.col("_again").isNotNull()
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.when(many, check).otherwise(F.lit(0).cast("long")).alias("_chk"), "_t")


def with_starts(mine: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, _t, starts) of every document; starts is null for one without repeats.

    If the documents with repeats are counted to few, theirs are the only texts that are shuffled, and the others stay where
    they are read; else all are joined by a shuffle.
    """
    ids = found.select(F.col("_id").alias("_i"), F.col("_chk").alias("_c"))
    if not common.small(ids):
        return mine.join(found, ["_id", "_chk"], "left").select("doc_id", "_t", "starts")
    ids, on = F.broadcast(ids), (F.col("_id") == F.col("_i")) & (F.col("_chk") == F.col("_c"))
    moved = mine.join(ids, on, "left_semi").join(found, ["_id", "_chk"]).select("doc_id", "_t", "starts")
    return mine.join(ids, on, "left_anti").select("doc_id", "_t", F.lit(None).cast("binary").alias("starts")).unionByName(moved)


def without_repeats(df: DataFrame, *, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; with keep_text also text, the kept words joined by spaces."""
    spark = common.ready(df.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(-(-size // BUCKET_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    mine = documents(df.select(F.col(id_column).cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("_t")))
    found = common.kept(repeated_windows(common.spread(mine.select("_id", "_chk", "_t")), window, buckets), "starts")
    both = with_starts(mine, found)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if keep_text else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, parts in zip(b.column(1), b.column(2), strict=True):
                words = t.as_py().split()
                n, gone = len(words), 0
                if parts.is_valid:
                    for a, z in reversed(intervals(np.frombuffer(parts.as_py(), "<u4").astype(np.int64), window)):
                        gone += z - a
                        del words[a:z]
                line = b" ".join(words)
                out.append((n, gone, hashlib.sha256(line).hexdigest(), line))
            n, gone, sha, lines = zip(*out, strict=True) if out else ((), (), (), ())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                cols, names = [*cols, pa.array([x.decode() for x in lines], pa.string())], [*names, "text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return both.mapInArrow(cut, schema)


def op10_rabin_karp_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 20 words or more that come earlier."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents)),
n AS (
  SELECT doc_id, i, x, string_agg(x, ' ') OVER o AS s, count(*) OVER o AS c
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (
  SELECT doc_id, i, x, c = 20 AND row_number() OVER (PARTITION BY c = 20, s ORDER BY doc_id NULLS FIRST, i) > 1 AS again FROM n),
h AS (
  SELECT doc_id, i, x, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
a AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM h GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM (SELECT doc_id FROM documents) LEFT JOIN a USING (doc_id)
"""
