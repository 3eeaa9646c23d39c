"""Queries answered from samples: an estimate and a bound of its error.

Rows of a sample that share a chance, and a stratum if there is one, were drawn without replacement from a known number of
rows N, of which n were drawn. Sums are weighted by N / n, and their variance is N**2 (1 - n / N) s**2 / n added up over
strata, with s**2 over all n rows: rows that the filter or the group leaves out count as zero and don't make n smaller.
Averages and ratios are of two such sums; their variance is that of the residuals, over the square of the lower sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keyed
from ..operators.sampling import PART, PROB, THRESHOLD
from .query import Query


def estimate(query: Query, sample: DataFrame, tables: dict[str, DataFrame] | None = None, *, stratum: str | None = None, z: float = 1.96) -> DataFrame:
    """The group columns, <agg> and <agg>_err. An error that can't be told, of one drawn row in a stratum, is null."""
    strata = [PROB] + ([stratum] if stratum else [])
    hold = [F.col(c).alias(f"_h{i}") for i, c in enumerate(strata)]
    all_rows = sample.groupBy(*hold).agg(F.count(F.lit(1)).alias("_n"))
    rows = query.joined({**(tables or {}), query.table: sample.select("*", *hold)})
    if query.where:
        rows = rows.where(query.where)
    value = F.expr(query.value)
    if query.agg == "count":
        top, low = F.when(value.isNotNull(), 1.0), F.lit(None).cast("double")
    elif query.agg == "sum":
        top, low = value.cast("double"), F.lit(None).cast("double")
    elif query.agg == "avg":
        top, low = value.cast("double"), F.when(value.isNotNull(), 1.0)
    else:
        top, low = value.cast("double"), F.expr(query.over).cast("double")
    h = [f"_h{i}" for i in range(len(strata))]
    rows = rows.select(*[F.col(g) for g in query.group_by], *h, top.alias("_y"), low.alias("_x"))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    by = rows.groupBy(*query.group_by, *h).agg(s("_y").alias("_sy"), s("_x").alias("_sx"), s(F.col("_y") * F.col("_y")).alias("_yy"), s(F.col("_x") * F.col("_x")).alias("_xx"), s(F.col("_y") * F.col("_x")).alias("_xy"))
    on = [F.col(a).eqNullSafe(F.col(f"_a{a}")) for a in h]
    by = by.join(all_rows.select("_n", *[F.col(a).alias(f"_a{a}") for a in h]), on)
    n, f = F.col("_n").cast("double"), F.col("_h0")
    big = n / f  # rows of the table that the stratum stands for
    cov = lambda ab, a, b: big * big * (1 - f) / n * F.try_divide(ab - a * b / n, n - 1)
    col = F.col
    out = by.groupBy(*query.group_by).agg(
        F.sum(col("_sy") / f).alias("_Y"), F.sum(col("_sx") / f).alias("_X"),
        _sum_known(cov(col("_yy"), col("_sy"), col("_sy")), f).alias("_vy"),
        _sum_known(cov(col("_xx"), col("_sx"), col("_sx")), f).alias("_vx"),
        _sum_known(cov(col("_xy"), col("_sy"), col("_sx")), f).alias("_vxy"),
    )
    if query.agg in ("sum", "count"):
        est, var = col("_Y"), col("_vy")
    else:
        r = F.try_divide(col("_Y"), col("_X"))
        est = r * query.scale
        var = F.try_divide(col("_vy") - 2 * r * col("_vxy") + r * r * col("_vx"), col("_X") * col("_X")) * query.scale**2
    return out.select(*query.group_by, est.alias(query.name), F.when(var.isNotNull(), z * F.sqrt(F.greatest(var, F.lit(0.0)))).alias(f"{query.name}_err"))


def _sum_known(v: Column, f: Column) -> Column:
    """The sum over strata; strata that are drawn whole add nothing; null if any other stratum's variance isn't known."""
    v = F.when(f >= 1, F.lit(0.0)).otherwise(v)
    return F.when(F.count(F.when(v.isNull(), 1)) == 0, F.sum(v))


def estimate_by_parts(query: Query, sample: DataFrame, tables: dict[str, DataFrame] | None = None, *, z: float = 1.96) -> DataFrame:
    """Like estimate, with the error from the spread of the estimates of the sample's parts (subsampling): the standard deviation of
    the PARTS estimates over the square root of their number. A part without a row of a group tells of a sum or count of zero, and nothing of an
    average or ratio, which counts over the parts that have one."""
    rows = query.joined({**(tables or {}), query.table: sample})
    if query.where:
        rows = rows.where(query.where)
    w, value = 1 / F.col(PROB), F.expr(query.value)
    y = F.when(value.isNotNull(), 1.0) if query.agg == "count" else value.cast("double")
    x = F.expr(query.over).cast("double") if query.agg == "ratio" else F.when(value.isNotNull(), 1.0)
    by = rows.groupBy(*query.group_by, PART).agg(F.sum(y * w).alias("_y"), F.sum(x * w).alias("_x"))
    parts = float(keyed.PARTS)
    if query.agg in ("sum", "count"):
        # a part stands for a share of the rows: its estimate of the whole is PARTS times its sum
        total, squares = F.coalesce(F.sum("_y"), F.lit(0.0)), F.coalesce(F.sum(F.col("_y") * F.col("_y")), F.lit(0.0))
        spread = F.sqrt(F.greatest(squares - total * total / parts, F.lit(0.0)) / (parts - 1)) * parts
        return by.groupBy(*query.group_by).agg(F.sum("_y").alias(query.name), (z * spread / parts**0.5).alias(f"{query.name}_err"))
    each = F.try_divide("_y", "_x") * query.scale
    est = F.try_divide(F.sum("_y"), F.sum("_x")) * query.scale
    return by.groupBy(*query.group_by).agg(est.alias(query.name), (z * F.stddev_samp(each) / F.sqrt(F.count(each))).alias(f"{query.name}_err"))


@dataclass(frozen=True)
class Registered:
    """A sample that may answer queries on a table."""

    table: str
    kind: str
    column: str | None
    rows: int
    data: DataFrame
    moments: DataFrame | None = None


def sample_moments(sample: DataFrame, columns: list[str], stratum: str | None = None) -> DataFrame:
    """What errors are predicted from, a row for each part of each stratum and column: (h, column_name, n, rows, mean, s2); h is the
    stratum as text, n the drawn rows, rows those that they stand for."""
    h = F.col(stratum).cast("string") if stratum else F.lit(None).cast("string")
    by = sample.groupBy(h.alias("h"), F.col(PROB).alias("_p")).agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(columns) for x in (F.avg(c).cast("double").alias(f"m{i}"), F.var_samp(c).alias(f"v{i}"))])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("s2")) for i, c in enumerate(columns)])
    return by.select("h", "n", (F.col("n") / F.col("_p")).alias("rows"), F.inline(each)).select("h", "column_name", "n", "rows", "mean", "s2")


def predicted_error(query: Query, s: Registered, share: float, *, z: float = 1.96) -> DataFrame:
    """One row, error: the share of the answer that the sample's error is expected to be, the mean over groups, null if it can't be told.

    share is the part of the rows that a filter or a group leaves, as far as the stratum doesn't tell it: a filter on the stratum's column alone
    picks strata whole, and a group by it makes each stratum a group. Within a stratum the rows that are left are taken for
    like the others, so the variance of y where it is left and 0 elsewhere follows from mean and variance.
    """
    m = s.moments.where(F.col("column_name") == query.value)
    own = s.column is not None and set(query.where_columns) <= {s.column}
    if own and query.where:
        kind = dict(s.data.dtypes)[s.column]
        m = m.withColumn(s.column, F.col("h").cast(kind)).where(query.where)
    grouped = bool(query.group_by) and query.group_by == (s.column,)
    f = F.lit(1.0 if (own or not query.where) and (grouped or not query.group_by) else share)
    n, rows, mean, s2 = (F.col(c) for c in ("n", "rows", "mean", "s2"))
    weight = rows * rows * (1 - n / rows) / n
    spread = lambda y, v: F.when(n >= rows, 0.0).otherwise(weight * (f * (v + y * y) - f * f * y * y))
    keys = ["h"] if grouped else []
    if query.agg == "count":
        each = m.groupBy(*keys).agg((z * F.sqrt(F.sum(spread(F.lit(1.0), F.lit(0.0)))) / F.sum(rows * f)).alias("e"))
    elif query.agg == "sum":
        each = m.groupBy(*keys).agg((z * F.sqrt(F.sum(spread(mean, s2))) / F.abs(F.sum(rows * f * mean))).alias("e"))
    else:
        whole = m.groupBy(*keys).agg(F.try_divide(F.sum(rows * mean), F.sum(rows)).alias("_r"))
        both = m.join(whole.withColumnRenamed("h", "_g"), F.col("h").eqNullSafe(F.col("_g"))) if keys else m.crossJoin(F.broadcast(whole))  # one row
        gap = mean - F.col("_r")
        each = both.groupBy(*keys, "_r").agg((z * F.sqrt(F.sum(spread(gap, s2))) / (F.sum(rows * f) * F.abs(F.col("_r")))).alias("e"))
    return each.agg(F.avg("e").alias("error"))


def share_left(query: Query, samples: list[Registered]) -> float:
    """The part of the rows that the filter, and a group on average, leaves, as the smallest uniform sample shows it."""
    if not query.where and not query.group_by:
        return 1.0
    pilot = min((s for s in samples if s.kind == "uniform"), key=lambda s: s.rows, default=None) or min(samples, key=lambda s: s.rows)
    rows = pilot.data.select("*", F.coalesce(F.expr(query.where), F.lit(False)).alias("_in") if query.where else F.lit(True).alias("_in"))
    by = rows.groupBy(*query.group_by).agg(F.sum(F.when(F.col("_in"), 1 / F.col(PROB))).alias("w"), F.sum(1 / F.col(PROB)).alias("all"))
    left, groups, every = by.agg(F.sum("w"), F.count("w"), F.sum("all")).first()
    return max((left or 0.0) / max(groups or 1, 1) / max(every or 1.0, 1.0), 1e-9)


def by_error(query: Query, samples: list[Registered], *, z: float = 1.96) -> Registered | None:
    """The smallest sample whose predicted error is within the query's bound, or the one with the least; None if nothing can be predicted."""
    mine = [s for s in samples if s.table == query.table and s.moments is not None and s.kind != "universe"]
    if query.joins or query.agg == "ratio" or not mine:
        return None
    share = share_left(query, mine)
    errors = [(e, s) for s in mine if (e := predicted_error(query, s, share, z=z).first()["error"]) is not None]
    good = [s for e, s in errors if e <= (query.error_bound or 0)]
    return min(good, key=lambda s: s.rows) if good else min(errors, key=lambda x: x[0])[1] if errors else None


def choose(query: Query, samples: list[Registered]) -> Registered | None:
    """A stratified sample whose column the query filters or groups by; else the largest uniform one; else none."""
    mine = [s for s in samples if s.table == query.table]
    fit = [s for s in mine if s.kind == "stratified" and s.column in query.columns()] or [s for s in mine if s.kind == "uniform"]
    return max(fit, key=lambda s: s.rows, default=None)


def answer(query: Query, samples: list[Registered], tables: dict[str, DataFrame], *, z: float = 1.96) -> DataFrame:
    """The query from the sample that fits, or exactly, with an error of 0, where none does."""
    s = (by_error(query, samples, z=z) if query.error_bound is not None else None) or choose(query, samples)
    if s is None:
        return query.exact(tables).withColumn(f"{query.name}_err", F.lit(0.0))
    return estimate(query, s.data, tables, stratum=s.column, z=z)


def universe(query: Query, samples: dict[str, DataFrame], key: str, tables: dict[str, DataFrame] | None = None, *, z: float = 1.96) -> DataFrame:
    """The group columns, <agg> and <agg>_err of a query that joins facts on a key by whose hash all of them are sampled.

    A row of one table is in its sample exactly if its key's number is under the sample's bound, so the rows of two samples that meet are
    all that have a key under the smaller bound p: the join of the samples is a sample of the join by keys. Sums of a key's rows
    weigh 1 / p, and as keys are drawn one by one, their variance is (1 - p) / p**2 times the sum of the keys' squares; averages and
    ratios by the residuals. ``key`` is the first fact's column; other tables of the query are whole.
    """
    p = F.lit(1.0)
    for df in samples.values():
        p = F.least(p, F.lit(df.agg(F.min(PROB)).first()[0] or 1.0))
    rows = query.joined({**(tables or {}), **{name: df.drop(PROB, PART, THRESHOLD) for name, df in samples.items()}})
    rows = rows.where(query.where) if query.where else rows
    value = F.expr(query.value)
    y = F.when(value.isNotNull(), 1.0) if query.agg == "count" else value.cast("double")
    x = F.expr(query.over).cast("double") if query.agg == "ratio" else F.when(value.isNotNull(), 1.0)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    by = rows.groupBy(*query.group_by, F.col(key).alias("_key")).agg(zero(y).alias("_y"), zero(x).alias("_x"))
    yy, xx, xy = (F.sum(F.col(a) * F.col(b)) for a, b in (("_y", "_y"), ("_x", "_x"), ("_x", "_y")))
    if query.agg in ("sum", "count"):
        return by.groupBy(*query.group_by).agg((F.sum("_y") / p).alias(query.name), (z * F.sqrt((1 - p) * yy) / p).alias(f"{query.name}_err"))
    r = F.try_divide(F.sum("_y"), F.sum("_x"))
    err = z * query.scale * F.sqrt((1 - p) * F.greatest(yy - 2 * r * xy + r * r * xx, F.lit(0.0))) / F.sum("_x")
    return by.groupBy(*query.group_by).agg((r * query.scale).alias(query.name), err.alias(f"{query.name}_err"))


def audit(query: Query, sample: DataFrame, tables: dict[str, DataFrame], *, stratum: str | None = None) -> DataFrame:
    """Exact and approximate answer side by side, with the rows of the sample and their least and greatest chance."""
    keys = list(query.group_by)
    exact = query.exact(tables).withColumnRenamed(query.name, "exact")
    approx = estimate(query, sample, tables, stratum=stratum).withColumnRenamed(query.name, "approx").withColumnRenamed(f"{query.name}_err", "err")
    rows = query.joined({**tables, query.table: sample})
    rows = (rows.where(query.where) if query.where else rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_rows"), F.min(PROB).alias("least_vprob"), F.max(PROB).alias("most_vprob"))
    if not keys:
        keys = ["_one"]
        exact, approx, rows = (x.withColumn("_one", F.lit(1)) for x in (exact, approx, rows))
    return exact.join(approx, keys, "left").join(rows, keys, "left").drop("_one")
