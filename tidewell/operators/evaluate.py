"""How good approximate answers are. Frames hold key columns, exact (or e), approx (or a) and err."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keyed

if TYPE_CHECKING:
    from ..plans.query import Query
    from .engine import SampledTable


def hits(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, hits, coverage): over all repeats, how many estimates are within their error of the exact value."""
    hit = F.sum(F.when(F.abs(F.col("approx") - F.col("exact")) <= F.col("err"), 1).otherwise(0))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), hit.alias("hits"), (hit / F.count(F.lit(1))).alias("coverage"))


def repeated(df: DataFrame, value: str, queries: dict[str, str], draws: int, ratio: float, seed: str, keys: list[str], z: float = 1.96) -> DataFrame:
    """(draw, q, approx, err): the sums of a value where each query's flag column holds, from so many samples at a ratio, in one scan.

    A row's membership in all samples is one array of bits, four to an MD5 of seed and key, whose 32-bit words are compared with the
    ratio; the row goes on once for each sample that holds it, and sums by sample merge before they are shuffled.
    """
    text = lambda i: F.md5(F.concat_ws("|", F.lit(f"{seed}/{i}"), *[F.col(k).cast("string") for k in keys]))
    words = F.array(*[text(i) for i in range(-(-draws // 4))])
    word = lambda i: F.conv(F.substring(F.element_at("_h", F.shiftright(i, 2) + 1), F.pmod(i, F.lit(4)) * 8 + 1, F.lit(8)), 16, 10).cast("long")
    bound = F.lit(keyed.below(ratio))
    rows = df.select(F.col(value).cast("double").alias("_v"), *[F.col(c).alias(f"_q{k}") for k, c in queries.items()], words.alias("_h"))
    rows = rows.withColumn("draw", F.explode(F.filter(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: word(i) < bound)))
    y = {k: F.when(F.col(f"_q{k}"), F.col("_v")).otherwise(0.0) for k in queries}
    by = rows.groupBy("draw").agg(F.count(F.lit(1)).cast("double").alias("_n"), *[x for k, c in y.items() for x in (F.sum(c).alias(f"s{k}"), F.sum(c * c).alias(f"ss{k}"))])
    n, big = F.col("_n"), F.col("_n") / ratio
    err = lambda k: z * F.sqrt(F.greatest(big * big * (1 - ratio) / n * F.try_divide(F.col(f"ss{k}") - F.col(f"s{k}") * F.col(f"s{k}") / n, n - 1), F.lit(0.0)))
    return by.select("draw", F.inline(F.array(*[F.struct(F.lit(k).alias("q"), (F.col(f"s{k}") / ratio).alias("approx"), err(k).alias("err")) for k in queries])))


def scaled(df: DataFrame, exact_rows: str, approx_rows: str) -> DataFrame:
    """Sums and counts of a sample from when the table had fewer rows, scaled to its rows now."""
    ratio = F.try_divide(F.col(exact_rows).cast("double"), F.col(approx_rows).cast("double"))
    return df.withColumn("approx", F.col("approx") * ratio).withColumn("err", F.col("err") * ratio)


def relative_error(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.try_divide(F.abs(F.col("approx") - F.col("exact")), F.abs(F.col("exact")))).alias("relative_error"))


def relative_bound(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.try_divide(F.col("err"), F.abs(F.col("exact")))).alias("relative_bound"))


def running(df: DataFrame, time: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Sums of a value over time so far. Without keys the times of one table are one window: pass totals of batches, not rows."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(value).over(w))


def over_time(table: SampledTable, batches: list[DataFrame], queries: dict[str, Query], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(step, q, action, rows, seconds, exact, approx, err) for each batch, counted from 1, and ungrouped query: what was done with the
    table's first sample and how long all took, and the query's answers afterwards, exact and from a sample."""
    spark, out = table.spark, []
    for i, batch in enumerate(batches, 1):
        report = table.receive(batch, i)
        x = table.samples()[0]
        seconds = sum(v for k, v in report.items() if ".cost." in k or k.startswith("cost."))
        for name, query in queries.items():
            exact = query.exact({**(tables or {}), table.table: table.base()}).first()[0]
            approx, err = table.approximate(query, tables).first()
            out.append((i, name, report.get(f"sampling.action.{x.id}", "none"), x.rows, seconds, exact, approx, err))
    return spark.createDataFrame(out, "step int, q string, action string, rows bigint, seconds double, exact double, approx double, err double")
