"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised at approximate quantiles, the cells are numbered along a Hilbert curve, rows are sorted by
that number, and the sorted rows are cut into runs. Every run covers a compact region of all dimensions, so that the
minimum and maximum of each dimension per shard let a reader skip most shards for a predicate on any of them.

Defined cases: a null dimension value falls into cell 0; a null text counts no bytes; equal curve numbers are ordered by
a hash of the id and of the kept columns, then the id, nulls first; repeated rows are rows of their own; texts, however long, count
by their bytes alone; an empty table gives no rows; extra columns, whatever their names, are ignored unless they are kept.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Dimension:
    """A metadata column; ``kind`` is number or string. Both are quantised at their own quantiles: those of numbers come from an
    approximate aggregate of all rows, those of strings are counted exactly."""

    column: str
    kind: str = "number"

    def value(self) -> Column:
        return F.col(self.column).cast("string" if self.kind == "string" else "double")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of each row of cells (rows x dimensions, each below 2**bits).

    The bit-parallel form of Skilling (2004): undo the excess work of the axes, Gray-encode, interleave.
    """
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ t) >> b) & 1)
    return out


def quantised(df: DataFrame, dims: list[Dimension], bits: int) -> list[list]:
    """The distinct quantile borders of each dimension: at most 2**bits - 1 values each."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = [i for i, d in enumerate(dims) if d.kind != "string"]
    row = df.agg(F.lit(0), *[F.percentile_approx(dims[i].value(), shares, 10_000).alias(f"d{i}") for i in numbers]).first()
    return [sorted({float(v) for v in (row[f"d{i}"] or ())}) if i in numbers else string_borders(df, d, bits) for i, d in enumerate(dims)]


def string_borders(df: DataFrame, dim: Dimension, bits: int) -> list[bytes]:
    """The exact quantiles of all of a dimension's strings: distinct values are counted and sorted over ranges, and the driver sees
    each range's number of rows and the values that stand at the quantiles' places."""
    counts = df.select(dim.value().alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    counts = sorted_and_kept(counts, [F.col("v")])
    before, total = {}, 0
    for p, n in sorted(tuple(r) for r in counts.groupBy(F.spark_partition_id()).agg(F.sum("n")).collect()):
        before[p], total = total, total + n
    places = np.unique([total * k >> bits for k in range(1, 1 << bits)])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = before.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            ends = at + np.cumsum(b.column(1).to_numpy())
            starts = np.concatenate(([at], ends[:-1])) if len(ends) else ends
            hit = np.searchsorted(places, ends) > np.searchsorted(places, starts)
            yield b.select(["v"]).filter(pa.array(hit))
            at = int(ends[-1]) if len(ends) else at

    return sorted(r["v"].encode() for r in counts.mapInArrow(pick, "v string").collect())


def curve_rows(df: DataFrame, dims: list[Dimension], bits: int, keep: dict[str, Column]) -> DataFrame:
    """The columns in keep, and curve: the place along the curve."""
    borders = quantised(df, dims, bits)
    n = len(dims)
    values = df.select(*[c.alias(k) for k, c in keep.items()], *[d.value().alias(f"_d{i}") for i, d in enumerate(dims)])
    schema = values.select(*keep).schema.add("curve", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.zeros((b.num_rows, n), np.int64)
            for i in range(n):
                c = b.column(b.num_columns - n + i)
                if dims[i].kind == "string":
                    coded = c.dictionary_encode()
                    cell = np.array([bisect.bisect_left(borders[i], v.encode()) for v in coded.dictionary.to_pylist()] + [0], np.int64)
                    cells[:, i] = cell[coded.indices.fill_null(len(cell) - 1).to_numpy(zero_copy_only=False)]
                elif len(borders[i]):
                    v = c.to_numpy(zero_copy_only=False)
                    cells[:, i] = np.where(np.isnan(v), 0, np.searchsorted(np.array(borders[i]), v, "left"))
            yield pa.RecordBatch.from_arrays([*b.columns[:-n], pa.array(hilbert_index(cells, bits))], names=[*b.schema.names[:-n], "curve"])

    return values.mapInArrow(place, schema)


def assign(df: DataFrame, dims: list[Dimension], shards: int, law: str = "rows", *, bits: int = 5, id_column: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of df: id, curve, rank along the curve, shard, slot (gapless from 0 in its shard), and keep's columns.

    ``law`` rows cuts runs whose counts are at most one apart; bytes cuts where the running sum of the column ``size``
    in keep passes each shard's share, so that sizes differ by about one row.

    Rows are range-partitioned by curve number and a hash of the id, so one hot cell spreads over many tasks; the
    ranks come from each partition's own counts, of which the driver sees one row a partition.
    """
    spark = common.ready(df.sparkSession)
    keep = {id_column: F.col(id_column)} | (keep or {})
    # the kept columns tell rows of one id, or of none, apart, so that many of them in one cell spread over ranges
    placed = curve_rows(df, dims, bits, keep).withColumn("_tie", F.xxhash64(*[f"`{c}`" for c in keep]))
    order = [F.col("curve"), F.col("_tie"), F.col(id_column).asc_nulls_first()]
    sorted_rows = sorted_and_kept(placed, order)
    part, size = F.spark_partition_id(), (F.col("size") if "size" in keep else F.lit(1)).cast("long")
    counts = {r["p"]: (r["n"], r["b"]) for r in sorted_rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).collect()}
    before, n, b = {}, 0, 0
    for p in sorted(counts):
        before[p] = (n, b)
        n, b = n + counts[p][0], b + (counts[p][1] or 0)
    schema = sorted_rows.drop("_tie").schema.add("rank", "long").add("shard", "integer").add("slot", "long")
    if law not in ("rows", "bytes"):
        raise ValueError(f"law {law!r} is not one of rows, bytes")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rank, done = before.get(TaskContext.get().partitionId(), (0, 0))
        for batch in batches:
            ranks = np.arange(rank, rank + batch.num_rows, dtype=np.int64)
            if law == "rows":
                shard = ranks * shards // max(n, 1)
                slot = ranks - -(-shard * n // shards)
            else:
                sizes = batch.column(batch.schema.get_field_index("size")).to_numpy(zero_copy_only=False)
                ends = done + np.cumsum(sizes)
                shard = np.minimum((ends - sizes // 2 - 1) * shards // max(b, 1), shards - 1)
                slot, done = ranks, int(ends[-1]) if len(ends) else done
            rank += batch.num_rows
            cols = [c for c, f in zip(batch.columns, batch.schema.names, strict=True) if f != "_tie"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ranks), pa.array(shard.astype(np.int32)), pa.array(slot)], names=schema.names)

    out = sorted_rows.mapInArrow(cut, schema)
    if law == "bytes":
        first = {r["shard"]: r["m"] for r in out.groupBy("shard").agg(F.min("rank").alias("m")).collect()}
        starts = F.create_map(*[F.lit(x) for pair in first.items() for x in pair]) if first else None
        out = out.withColumn("slot", F.col("rank") - starts[F.col("shard")]) if first else out
    return out


def sorted_and_kept(df: DataFrame, order: list[Column]) -> DataFrame:
    """df range-partitioned and sorted by order, kept so that partitions and their rows stay as they are."""
    spark = df.sparkSession
    common.shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(common.shared_dir(spark))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order).checkpoint(eager=True)


def write_shards(df: DataFrame, dims: list[Dimension], shards: int, path: str, law: str = "rows", *, bits: int = 5, id_column: str = "doc_id") -> DataFrame:
    """Writes df's rows, all of their columns, as Parquet folders shard=N under path; returns the manifest: per shard its rows and
    each dimension's least and greatest value. The columns go along with the rows as they are placed, so ids may repeat or
    be missing; a column of df that is called shard, slot, rank or curve is written as it is and ours get a _ in front."""
    own = {c: f"_{i}" for i, c in enumerate(df.columns)}
    moved = df.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()], *[d.value().alias(f"_q{i}") for i, d in enumerate(dims)])
    keep = {k: F.col(k) for k in own.values()}
    if law == "bytes":
        raise ValueError("cut by rows here; assign() tells shards by bytes")
    placed = assign(moved, [Dimension(f"_q{i}", d.kind) for i, d in enumerate(dims)], shards, law, bits=bits, id_column=own[id_column], keep=keep)
    ours = "shard"
    while ours in [c.lower() for c in df.columns]:
        ours = f"_{ours}"
    rows = placed.select(*[F.col(k).alias(c) for c, k in own.items()], F.col("shard").alias(ours), F.col("slot").alias("__slot"))
    rows.repartition(F.col(ours), F.pmod(F.col("__slot"), F.lit(4))).sortWithinPartitions(ours, "__slot").drop("__slot").write.partitionBy(ours).parquet(path)
    back = df.sparkSession.read.parquet(path)
    bounds = [f(d.column).alias(f"{k}_{d.column}") for d in dims for k, f in (("min", F.min), ("max", F.max))]
    return back.groupBy(F.col(ours).alias("shard")).agg(F.count(F.lit(1)).alias("rows"), *bounds)


def prune(manifest: DataFrame, box: dict[str, tuple]) -> DataFrame:
    """The shards of a manifest that can hold rows inside box: {column: (least, greatest)}."""
    keep = F.lit(True)
    for c, (low, high) in box.items():
        keep &= (F.col(f"max_{c}") >= F.lit(low)) & (F.col(f"min_{c}") <= F.lit(high))
    return manifest.where(keep)


DOCUMENT_DIMENSIONS = [Dimension("lang", "string"), Dimension("source", "string"), Dimension("n_chars")]


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards cut from the curve over language, source and length, by the law of rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = {"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(F.encode(text, "UTF-8")).cast("long")}
    out = assign(docs, DOCUMENT_DIMENSIONS, 24, "rows", keep=keep)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
