"""MinHash near-duplicates: circulant signatures, bands, links confirmed on whole shingle sets, groups.

A signature of K coordinates needs two permutations only (C-MinHash, Li and Li 2022): the first, sigma, scatters the elements; coordinate k is the
least value of the second, pi, over the elements shifted circularly by k. Elements are hashes of 32 bits, on which both
permutations are bijections of multiplications and shifts, so no table of them is held or sent.

Signatures are cut into ``BANDS`` bands of ``BAND_ROWS`` coordinates. Documents that agree in a band are candidates; two of similarity 0.8 agree in none with a
chance of 7e-6. Unrelated documents that agree in a band grow as the square of their number, so before any set is moved, the members of a bucket are held against
each other by 128 bits of their signatures, one of each of 128 coordinates: of a pair of similarity s about (1 + s) / 2 of the bits agree, and a
member that differs from all others of the bucket in over ``RADIUS`` bits, which one of 0.8 does with a chance of 3e-6, leaves it.
Links are confirmed, and groups made, by ``jaccard``, from the sets of 64-bit hashes of all shingles of the members that are left, which are made from the
texts a second time, as the sets of all documents take twice the texts' room. Texts of equal
sets are one node, so copies cost a row each and no pairs.

Defined cases: a null text has no words; a row without words has an empty set and is linked with nothing, copies of it included; with
fewer words than a shingle has, the whole sequence is the one shingle; rows of equal sets are one group, repeated rows and repeated ids
too; a row without an id links others and gets its group's smallest id, null if no row of the group has one, and is not kept; ties of
ids are kept alike; very long texts are taken whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, jaccard, simhash

WORDS, NUM, DEN = 2, 4, 5
BANDS, BAND_ROWS = 30, 5
#: Bits of 128 that near members of a bucket may differ in, and the rows beyond which a bucket isn't tested.
RADIUS, TESTED_ROWS = 30, 4096
#: What sigma and pi start with.
SIGMA, PI = np.uint32(0x9E3779B9), np.uint32(0x7F4A7C15)


def permute(x: np.ndarray, start: np.uint32) -> np.ndarray:
    """A permutation of the whole numbers of 32 bits, in place."""
    x ^= start
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(hashes: np.ndarray, k: int = BANDS * BAND_ROWS) -> np.ndarray:
    """The k coordinates of a set of 64-bit hashes that isn't empty."""
    x = permute((hashes >> np.uint64(32)).astype(np.uint32), SIGMA)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    shifts = np.arange(k, dtype=np.uint32)[:, None]
    for at in range(0, len(x), 1024):
        np.minimum(out, permute(x[None, at : at + 1024] + shifts, PI).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 63-bit key for each band; different bands have different ones."""
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for c in sig.reshape(BANDS, BAND_ROWS).T.astype(np.uint64):
        key = (key ^ c) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return (key >> np.uint64(1)).astype(np.int64)


def texts_of(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, h, _t): h tells equal texts, up to chance."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    return common.spread(df.select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(text).alias("h"), F.encode(text, "UTF-8").alias("_t")))


def prints(texts: DataFrame, words: int) -> DataFrame:
    """(row, id, h, digest, n, keys, w0, w1) of each row, written; all from digest on but n are null without words. w0 and w1 are bits of the signature."""
    kinds = [pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64()]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(2):
                h = np.unique(simhash.shingle_hashes(t.as_py(), words)[1])
                if not len(h):
                    out.append((None, 0, None, None, None))
                    continue
                sig = signature(h)
                w0, w1 = np.packbits((sig[:128] & 1).astype(bool)).view(np.int64).tolist()
                out.append((xxhash.xxh3_128_digest(h.tobytes()), len(h), band_keys(sig), w0, w1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]], names=["id", "h", "digest", "n", "keys", "w0", "w1"])

    made = texts.mapInArrow(common.tidy(take), f"id {texts.schema['id'].dataType.simpleString()}, h long, digest binary, n int, keys array<long>, w0 long, w1 long")
    return common.kept(made.select(F.monotonically_increasing_id().alias("row"), "*"), "prints")


def sets_of(texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(row, s), written: the sorted distinct hashes of the shingles of nodes (row, digest, h; written). They are made from the texts again, which are found
    by h and told by digest, so that the sets of rows that are near nothing are never written; a task gives one of the copies that it meets."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            out = []
            for t in b.column(0):
                s = np.unique(simhash.shingle_hashes(t.as_py(), words)[1]).tobytes()
                digest = xxhash.xxh3_128_digest(s)
                if digest not in seen:
                    seen.add(digest)
                    out.append((digest, s))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["digest", "s"])

    asked = nodes.select("h").distinct()
    side = F.broadcast(asked) if common.small(asked, jaccard.ASKED_ROWS, jaccard.ASKED_BYTES) else asked.hint("merge")
    made = texts.select("h", "_t").join(side, "h", "left_semi").select("_t").mapInArrow(common.tidy(take), "digest binary, s binary")
    found = made.join(nodes.select("row", "digest").hint("merge"), "digest")
    return common.kept(found.groupBy("row").agg(F.first("s").alias("s")), "sets")


def near_members(every: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, row, n): the buckets of the nodes' bands without the members that are near no other of theirs, written. Buckets over TESTED_ROWS
    rows stay whole, so that no task gets the rows of a hot one."""
    own = common.kept(every.select("row", "n", "keys", "w0", "w1").join(nodes.select("row").hint("merge"), "row"), "own")
    own = own.select(F.explode("keys").alias("key"), "row", "n", "w0", "w1")
    several = common.kept(own.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "several")
    rows = common.kept(own.join(several.hint("merge"), "key"), "members")
    tested = rows.where(F.col("c") <= TESTED_ROWS).select("key", "row", "w0", "w1").repartition("key").sortWithinPartitions("key")
    near = tested.mapInArrow(common.tidy(lambda b: simhash.with_neighbours(b, RADIUS)), "key long, row long")
    near = common.kept(near.select(F.xxhash64(F.spark_partition_id(), "key").alias("key"), "row"), "near")
    sized = near.join(every.select("row", "n").hint("merge"), "row").select("key", "row", "n")
    return common.kept(sized.unionByName(rows.where(F.col("c") > TESTED_ROWS).select("key", "row", "n")), "near")


def near_duplicates(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(id, n_shingles, component_id) for each row: component_id is the smallest id that its links reach."""
    common.ready(df.sparkSession)
    texts = texts_of(df, id_column, text_column)
    every = prints(texts, words)
    nodes = every.where("n > 0").groupBy("digest").agg(F.min(F.struct("row", "h")).alias("x"), F.min("id").alias("least"))
    nodes = common.kept(nodes.select("digest", "x.row", "x.h", "least"), "nodes")
    near = near_members(every, nodes)
    asked = common.kept(nodes.select("row", "digest", "h").join(near.select("row").distinct().hint("merge"), "row"), "asked")
    roots = jaccard.grouped(near, sets_of(texts, asked, words), num, den, simhash.components)
    if roots is None:
        rooted = nodes.withColumn("root", F.col("row"))
    else:
        rooted = nodes.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    rooted = common.kept(rooted.select("digest", "least", "root"), "rooted")
    names = common.kept(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    labels = common.kept(rooted.join(names, "root").select("digest", "component_id"), "labels")
    some = common.join_small_or_salted(every.where("n > 0").select("row", "id", "n", "digest"), labels, "digest")
    none = every.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return some.select("id", "n", "component_id").unionByName(none).select("id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def op12_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents grouped by two-word shingles."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component_id").cast("long").alias("component_id"), kept.alias("kept"))


OP12_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT r, doc_id, list_sort(CASE WHEN len(w) < 2 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END) AS s FROM d),
n AS MATERIALIZED (SELECT min(r) AS r, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
e AS MATERIALIZED (SELECT r, n, unnest(s) AS x FROM n),
f AS MATERIALIZED (SELECT x, count(*) AS df FROM e GROUP BY x),
o AS MATERIALIZED (SELECT r, n, x, row_number() OVER (PARTITION BY r ORDER BY df, x) AS i FROM e JOIN f USING (x) WHERE df > 0),
p AS MATERIALIZED (
  SELECT DISTINCT a.r AS a, b.r AS b FROM (SELECT * FROM o WHERE i <= n - (4 * n + 4) // 5 + 1) AS a JOIN (SELECT * FROM o WHERE i <= n - (4 * n + 4) // 5 + 1) AS b
  ON a.x = b.x AND a.r < b.r AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4),
l AS MATERIALIZED (
  SELECT a, b FROM (SELECT a, b, len(list_intersect(u.s, v.s)) AS k, u.n + v.n AS m FROM p JOIN n AS u ON u.r = a JOIN n AS v ON v.r = b)
  WHERE 100 * k >= 80 * (m - k)),
g(a, b) AS (SELECT r, r FROM n UNION SELECT g.a, y FROM g JOIN (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l) ON g.b = x),
c AS MATERIALIZED (SELECT n.s, min(m.doc_id) AS component_id FROM g JOIN n ON n.r = g.a JOIN n AS o ON o.r = g.b JOIN s AS m ON m.s = o.s GROUP BY n.s)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN doc_id ELSE component_id END AS component_id,
       coalesce(doc_id = CASE WHEN len(s.s) = 0 THEN doc_id ELSE component_id END, false) AS kept
FROM s LEFT JOIN c ON c.s = s.s
"""
