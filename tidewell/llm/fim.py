"""Fill-in-middle: every text is cut at two units into prefix, middle and suffix, which change places.

A unit is a run of ASCII letters or any other single code point, so a unit begins at every code point save a letter behind
a letter: a test of two adjacent characters. Texts are cut into chunks that overlap by that one character, and each chunk counts
the units and the code points that begin in it, whatever the others hold. Prefix sums of the counts give a text's number of
units, and lead each of the two cuts' ranks to the chunk that owns it; only those chunks are scanned again for the place.

Texts up to ``LONG`` bytes are chunks of one Arrow batch, whose counts and sums are vectors. Longer texts become a row for each chunk,
which are dealt over all tasks: counts, sums by a window over a text's chunks (one for each megabyte), and a join that leads ranks to chunks.

Which units are cut, and the form, follow from a hash of seed and id alone, so a run that is repeated gives the same rows.

Defined cases: a null text counts as empty, and an empty text is plain; a text that holds one of the marks is plain, so that every output
can be undone; a null id hashes like an empty one; rows of one id are cut by the same hashes; repeated rows come as often as they are;
a text without a letter has a unit for each code point, one of letters alone has one; an empty table gives no rows; other columns,
whatever their names, are ignored unless they are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The marks before the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are changed, and of a hundred changed ones so many have the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
#: Bytes of a chunk inside a batch, and of a chunk that is a row; texts of more bytes than LONG are cut into rows.
CHUNK, ROW_CHUNK, LONG = 1 << 14, 1 << 20, 8 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def begins(data: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Where units and where code points begin in UTF-8 bytes, behind the byte ``before`` (0 at the start of a text)."""
    point = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    unit = point.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    if len(data) and letter[0] and _LETTER[before]:
        unit[0] = False
    return unit, point


def find(data: np.ndarray, before: int, rank: int) -> int:
    """The code points of a chunk before its unit of this rank."""
    unit, point = begins(data, before)
    return int(np.count_nonzero(point[: np.flatnonzero(unit)[rank]]))


def cut_batch(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, code points before the first cut, before the second) of the texts between offsets in data."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    chunks = -(-size // chunk)
    text = np.repeat(np.arange(n), chunks)
    first = np.concatenate(([0], np.cumsum(chunks)))
    start = offsets[:-1][text] + (np.arange(first[-1]) - first[:-1][text]) * chunk
    end = np.minimum(start + chunk, offsets[1:][text])
    before = np.where(start > offsets[:-1][text], data[np.maximum(start - 1, 0)], 0) if len(start) else start
    counts = np.zeros((len(start) + 1, 2), np.int64)
    for i, (a, z, b) in enumerate(zip(start.tolist(), end.tolist(), before.tolist(), strict=True), 1):
        counts[i] = [np.count_nonzero(x) for x in begins(data[a:z], b)]
    sums = np.cumsum(counts, axis=0)
    units, points = (sums[first[1:], k] - sums[first[:-1], k] for k in (0, 1))
    ranks = np.stack((h1 % (units + 1), h2 % (units + 1)))
    out = np.empty((2, n), np.int64)
    for k, rank in enumerate((ranks.min(axis=0), ranks.max(axis=0))):
        out[k] = points
        own = np.searchsorted(sums[:, 0], sums[first[:-1], 0] + rank, side="right") - 1
        for t in np.flatnonzero(rank < units).tolist():
            c = int(own[t])
            out[k, t] = sums[c, 1] - sums[first[t], 1] + find(data[start[c] : end[c]], int(before[c]), int(sums[first[t], 0] + rank[t] - sums[c, 0]))
    return units, out[0], out[1]


def cut_short(rows: DataFrame) -> DataFrame:
    """rows with n, p and m; the last three columns of rows are the text as _t and the hashes."""
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in ("n", "p", "m")]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(b.num_columns - 3).cast(pa.large_binary())
            offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
            data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
            found = cut_batch(data, offsets, *[b.column(b.num_columns - k).to_numpy() for k in (2, 1)])
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, found)], names=schema.names)

    return common.spread(rows).mapInArrow(common.tidy(task), schema)


def cut_long(texts: DataFrame, chunk: int = ROW_CHUNK) -> DataFrame:
    """(_key, n, p, m) of (_key, _t, _h1, _h2), written; a row for each chunk of a text goes to a task of its own."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = t.cast(pa.large_binary()).as_buffer()
                for i, at in enumerate(range(0, len(raw), chunk)):
                    before = raw[at - 1] if at else 0
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([i], pa.int32()), pa.array([before], pa.int32()), pa.array([raw[at : at + chunk].to_pybytes()], pa.binary())], names=["_key", "i", "before", "t"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [[int(np.count_nonzero(x)) for x in begins(np.frombuffer(t.as_buffer(), np.uint8), before)] for before, t in zip(b.column(2).to_pylist(), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([x[k] for x in both], pa.int64()) for k in (0, 1)]], names=["_key", "i", "units", "points"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [find(np.frombuffer(t.as_buffer(), np.uint8), before, rank) for before, t, rank in zip(b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(5), pa.array(np.array(at, np.int64) + b.column(6).to_numpy())], names=["_key", "cut", "at"])

    chunks = common.kept(texts.select("_key", "_t").mapInArrow(split, "_key long, i int, before int, t binary").repartition("_key", "i"), "chunks")
    counts = common.kept(chunks.mapInArrow(common.tidy(counted), "_key long, i int, units long, points long"), "counts")
    total = counts.groupBy("_key").agg(F.sum("units").alias("n"), F.sum("points").alias("points"))
    ranks = texts.select("_key", "_h1", "_h2").join(total, "_key").select("_key", "n", "points", *[F.expr(f"{f}(_h1 % (n + 1), _h2 % (n + 1))").alias(k) for f, k in (("least", "r0"), ("greatest", "r1"))])
    ranks = common.kept(ranks, "ranks")
    so_far = Window.partitionBy("_key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select("_key", "i", "units", *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"{c}_before") for c in ("units", "points")])
    each = ranks.select("_key", F.posexplode(F.array("r0", "r1")).alias("cut", "rank"))
    own = sums.join(each, "_key").where("rank >= units_before and rank < units_before + units").select("_key", "i", (F.col("rank") - F.col("units_before")).alias("rank"), "cut", "points_before")
    found = chunks.join(own, ["_key", "i"]).select("_key", "i", "before", "t", "rank", "cut", "points_before").mapInArrow(common.tidy(placed), "_key long, cut int, at long")
    at = found.groupBy("_key").agg(*[F.max(F.when(F.col("cut") == k, F.col("at"))).alias(f"at{k}") for k in (0, 1)])
    return common.kept(ranks.join(at, "_key", "left").select("_key", "n", *[F.coalesce(f"at{k}", "points").alias(c) for k, c in enumerate("pm")]), "cuts")


def hashes(seed: str, id_: Column) -> list[Column]:
    """Four whole numbers of 32 bits from seed and id."""
    text = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(text, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", seed: str = "1", changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST, carry: dict[str, Column] | None = None, long: int = LONG) -> DataFrame:
    """carry's columns (the id as _id besides) and for each row: text, n units, form, prefix_chars and middle_chars, null for plain, and output.

    The forms: plain, the text; psm, prefix, suffix, middle; spm, suffix, prefix, middle; each part behind its mark.
    """
    common.ready(df.sparkSession)
    h = hashes(seed, F.col(f"`{id_column}`"))
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains(text, F.lit(m))
    form = F.when((text == "") | marked | (h[2] % 100 >= changed), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = df.select(F.col(f"`{id_column}`").alias("_id"), *[c.alias(k) for k, c in (carry or {}).items()], form.alias("form"), text.alias("_t"), h[0].alias("_h1"), h[1].alias("_h2"))
    cuts = cut_short(rows.where(F.octet_length("_t") <= long))
    some = common.kept(rows.where(F.octet_length("_t") > long).select(F.monotonically_increasing_id().alias("_key"), "*"), "long")
    if some.head(1):
        cuts = cuts.unionByName(some.join(cut_long(some.select("_key", "_t", "_h1", "_h2")), "_key").drop("_key"))
    part = lambda a, n: F.substring(F.col("_t"), a, n)
    pre, mid, suf = part(F.lit(1), F.col("p")), part(F.col("p") + 1, F.col("m") - F.col("p")), part(F.col("m") + 1, F.length("_t"))
    out = F.when(F.col("form") == "plain", F.col("_t")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), pre, F.lit(SUFFIX), suf, F.lit(MIDDLE), mid))
    out = out.otherwise(F.concat(F.lit(SUFFIX), suf, F.lit(PREFIX), pre, F.lit(MIDDLE), mid))
    plain = F.col("form") == "plain"
    return cuts.select("_id", *(carry or {}), F.col("_t").alias("text"), "n", "form", F.when(~plain, F.col("p")).alias("prefix_chars"), F.when(~plain, F.col("m") - F.col("p")).alias("middle_chars"), out.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: no text in parts holds a mark, so the first of each mark is the one that was set."""
    first = F.when(form == "psm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    i, j = F.position(second, output), F.position(F.lit(MIDDLE), output)
    a = F.substring(output, F.length(first) + 1, i - 1 - F.length(first))
    b = F.substring(output, i + F.length(second), j - i - F.length(second))
    mid = F.substring(output, j + len(MIDDLE), F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(a, mid, b)).otherwise(F.concat(b, mid, a))


def op11_fim_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents transformed, with digests of the outputs and of what is restored from them."""
    out = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(F.col("_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256(concat('1:', doc_id)) AS h FROM documents),
k AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN [0, 1, 2, 3]] AS h FROM d),
f AS (
  SELECT doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:], '') AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
