"""Running moments of every numeric column, from which the needed sample size follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sizing

#: d counts all rows, filled those with a value, to which s2, avg and sum belong.
STATS = "column_name string, d long, filled long, s2 double, avg double, sum double, e double"


def numeric(df: DataFrame, only: list[str] | None = None) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and (not only or f.name in only)]


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, d, filled, s2, avg, sum) of each column, in one scan."""
    aggs = [x for i, c in enumerate(columns) for x in (F.count(c).alias(f"n{i}"), F.var_pop(c).alias(f"v{i}"), F.avg(c).alias(f"a{i}"), F.sum(F.col(c).cast("double")).alias(f"s{i}"))]
    row = df.agg(F.count(F.lit(1)).alias("d"), *aggs)
    col = lambda x: F.col(x).cast("double")
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("d"), F.col(f"n{i}").alias("filled"), col(f"v{i}").alias("s2"), col(f"a{i}").alias("avg"), F.col(f"s{i}").alias("sum")) for i, c in enumerate(columns)])
    return row.select(F.inline(each))


def profile(df: DataFrame, columns: list[str], relative: float = 0.1, absolute: float | None = None) -> DataFrame:
    """moments with e, the error allowed, fixed here."""
    return moments(df, columns).withColumn("e", sizing.error_bound(F.col("avg"), relative, absolute))


def refreshed(old: DataFrame, batch: DataFrame, columns: list[str] | None = None, *, relative: float = 0.1, refresh_error: bool = False) -> DataFrame:
    """The profile of the table with the batch, from the old profile and a scan of the batch alone. Without columns the old profile is
    run to tell them, which a lazy one answers by scanning its table once more.

    Moments are merged by the numbers of rows that have a value. e stays as it was unless it is asked to follow the mean. A
    batch without values in a column changes nothing but d.
    """
    columns = columns or [r["column_name"] for r in old.select("column_name").collect()]
    new = moments(batch, columns).select("column_name", *[F.col(c).alias(f"b_{c}") for c in ("d", "filled", "s2", "avg", "sum")])
    out = old.join(F.broadcast(new), "column_name").select("column_name", (F.col("d") + F.col("b_d")).alias("d"), *[c.alias(k) for k, c in _merged("", "b_").items()], "e")
    return out.withColumn("e", sizing.error_bound(F.col("avg"), relative)) if refresh_error else out


def _merged(a: str, b: str) -> dict[str, Column]:
    """filled, s2, avg and sum of two parts whose columns have these prefixes."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    n, m = F.col(f"{a}filled"), F.col(f"{b}filled")
    total = zero(f"{a}sum") + zero(f"{b}sum")
    var = F.when(m == 0, F.col(f"{a}s2")).when(n == 0, F.col(f"{b}s2")).otherwise(sizing.merged_variance(n, zero(f"{a}s2"), zero(f"{a}avg"), m, zero(f"{b}s2"), zero(f"{b}avg")))
    avg = F.when(m == 0, F.col(f"{a}avg")).when(n == 0, F.col(f"{b}avg")).otherwise(total / (n + m))
    return {"filled": n + m, "s2": var, "avg": avg, "sum": F.when(n + m > 0, total)}


def merged_rows(old: list[dict], new: list[dict]) -> list[dict]:
    """refreshed() of a few rows on the driver: old profile and the moments of a batch, by column."""
    by, out = {r["column_name"]: r for r in new}, []
    for a in old:
        b = by[a["column_name"]]
        n, m = a["filled"], b["filled"]
        r = a | {"d": a["d"] + b["d"], "filled": n + m}
        if n == 0 and m:
            r |= {k: b[k] for k in ("s2", "avg", "sum")}
        elif m:
            r |= {"sum": a["sum"] + b["sum"], "avg": (a["sum"] + b["sum"]) / (n + m)}
            mean = (n * a["avg"] + m * b["avg"]) / (n + m)
            r["s2"] = (n * (a["s2"] + (mean - a["avg"]) ** 2) + m * (b["s2"] + (mean - b["avg"]) ** 2)) / (n + m)
        out.append(r)
    return out


def required(stats: DataFrame, z: float = 1.96) -> DataFrame:
    """stats with n0, n and x, the whole rows needed by each column."""
    n = sizing.needed(F.col("s2"), F.col("d"), F.col("e"), z)
    n0 = F.try_divide(F.lit(z * z) * F.col("s2"), F.col("e") * F.col("e"))
    return stats.withColumn("n0", n0).withColumn("n", n).withColumn("x", sizing.whole_below(F.col("n")).cast("long"))


def need_of(stats: list[dict], z: float = 1.96) -> int:
    """need() of rows on the driver."""
    most = 0
    for r in stats:
        if r["s2"]:
            n0 = z * z * r["s2"] / (r["e"] * r["e"]) if r["e"] else None
            most = max(most, r["d"] if n0 is None else int(n0 * r["d"] / (n0 + r["d"])))
    return most


def need(stats: DataFrame, z: float = 1.96) -> int:
    """The rows that the most demanding column needs."""
    return int(required(stats, z).agg(F.max(F.floor("n"))).first()[0] or 0)


def status(stats: DataFrame, sample_size: int, z: float = 1.96, scale: float = 1.0) -> DataFrame:
    """Per column: rows needed, whether the sample falls short, the ratio of the table that it should hold, and M, ten times
    the largest shortfall."""
    r = required(stats, z).select("column_name", F.floor("n").cast("long").alias("need"), "d")
    out = r.withColumn("most", F.max("need").over(Window.partitionBy(F.lit(1))))  # a row for each column only
    short = F.greatest(F.col("most") - sample_size, F.lit(0))
    return out.select("column_name", "need", (F.col("need") > sample_size).alias("deficient"), (F.lit(scale) * F.col("most") / F.col("d")).alias("ratio"), (short * 10).cast("long").alias("m"))


def trace(batches: list[DataFrame], columns: list[str], relative: float = 0.1) -> DataFrame:
    """The profile after each batch, with step; no sampling. Each batch is scanned once; a row for each column goes to the driver."""
    spark, stats, out = batches[0].sparkSession, None, []
    for i, b in enumerate(batches):
        if stats is None:
            stats = [r.asDict() for r in profile(b, columns, relative).collect()]
        else:
            stats = merged_rows(stats, [r.asDict() for r in moments(b, columns).collect()])
        out += [(*[r[c] for c in ("column_name", "d", "filled", "s2", "avg", "sum", "e")], i) for r in stats]
    return spark.createDataFrame(out, STATS + ", step int")
