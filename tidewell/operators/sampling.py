"""Draws from a table, from a sample and a batch, uniform and by strata.

All draws are by keyed numbers: the rows with the least numbers are drawn. Such a sample of a sample and a batch is the
sample of both, whatever the order of batches, and drawing again gives the same rows.

*Threshold samples.* A sample may consist of parts that were drawn at different chances, as an extension leaves them. Every row carries its
part's threshold (``verdict_vthr``): of the rows that the part stands for, the sample holds those with numbers under it. When a sample
is thinned, by a batch that comes in or by an extension, all parts get the common threshold t that the draw ends at:

- parts whose thresholds are t or more, and the batch, whose rows had none yet, are one part from then on: they are the rows under t of
  all rows that they stand for;
- a part with a lower threshold loses no row and stays what it is.

A part of n rows that stands for N rows is a draw without replacement of n from N, so its chance (``verdict_vprob``) is n / N, and estimates add up
over parts as over strata. The same holds within each stratum of a stratified sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keyed, sizing

PROB, PART, THRESHOLD = "verdict_vprob", "verdict_vpart", "verdict_vthr"
#: Least rows kept of a stratum that has them.
LEAST = 10


def bernoulli(df: DataFrame, p: float | Column, seed: int | str, keys: list[str]) -> DataFrame:
    """Each row with chance p, which may differ from row to row."""
    bound = F.lit(keyed.below(p)) if isinstance(p, (int, float)) else p * keyed.RANGE
    return df.where(keyed.unit(seed, keys) < bound)


def _edge(counts: dict[int, int], k: int) -> tuple[int | None, int]:
    """The first bucket with which more than k rows are reached, if there is one, and the rows before it."""
    done = 0
    for b in sorted(counts):
        if done + counts[b] > k:
            return b, done
        done += counts[b]
    return None, done


def bottom_k(df: DataFrame, k: int, seed: int | str, keys: list[str], rows: int | None = None) -> DataFrame:
    """The k rows with the least keyed numbers, ties by key; more only if rows share the last one's key, which then all are drawn."""
    return draw(df, k, seed, keys, rows)[0]


def draw(df: DataFrame, k: int, seed: int | str, keys: list[str], rows: int | None = None) -> tuple[DataFrame, int, int | None]:
    """bottom_k's rows, the threshold under which the drawn rows' numbers are, and how many rows were drawn, None if that is all that
    df has: a filter of df, without a sort or a shuffle of its rows.

    One row a bucket of numbers goes to the driver and tells up to which number all rows are drawn. If ``rows`` is told, of
    which df's are those with the least numbers, the k-th number is known to within ten standard deviations, and fine
    buckets of that window mostly settle it at once. Else, or where the window misses, the numbers' upper 16 bits are
    counted, and then the lower ones of a single bucket. Only of rows that share the last number the first by key are looked up.
    """
    k = max(0, int(k))
    if not k:
        return df.limit(0), 0, 0
    u = df.withColumn("_u", keyed.unit(seed, keys))

    def counted(rows: DataFrame, bucket: Column) -> dict[int, int]:
        return {r["b"]: r["n"] for r in rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}

    base, step, done = 0, 1 << 16, 0
    found: int | None = None
    if rows and rows > k:
        spread = 10 * k**0.5 + 50
        low, high = (max(0, min(keyed.RANGE, int((k + d) / rows * keyed.RANGE))) for d in (-spread, spread))
        width = max(1, -(-(high - low) // (1 << 16)))
        where = F.when(F.col("_u") < low, -1).when(F.col("_u") < high, F.floor((F.col("_u") - low) / width))
        counts = counted(u, where.cast("long"))
        beyond, before = counts.pop(None, 0), counts.pop(-1, 0)
        if before <= k:
            found, more = _edge(counts, k - before)
            if found is None and not beyond and before + more <= k:
                return df, keyed.RANGE, None
            base, step, done = low, width, before + more
            if found is None and done == k:
                return u.where(F.col("_u") < high).drop("_u"), high, k
    if found is None:
        base, step = 0, 1 << 16
        found, done = _edge(counted(u, F.shiftright("_u", 16)), k)
        if found is None:
            return df, keyed.RANGE, None
    edge = base + found * step
    if done < k and step > 1:
        ends = counted(u.where((F.col("_u") >= edge) & (F.col("_u") < edge + step)), F.col("_u"))
        edge, more = _edge(ends, k - done)
        done += more
    drawn = F.col("_u") < edge
    if done < k:
        tied = u.where(F.col("_u") == edge)
        most = tied.orderBy(*keys).limit(k - done).agg(F.max(F.struct(*keys)).alias("m")).first()["m"]
        last = F.struct(*[F.lit(most[c]).cast(df.schema[c].dataType).alias(c) for c in keys])
        drawn |= (F.col("_u") == edge) & (F.struct(*keys) <= last)
        done += tied.where(F.struct(*keys) <= last).count()
        edge += 1
    return u.where(drawn).drop("_u"), edge, done


def weighted(df: DataFrame, p: float | Column, seed: int | str, keys: list[str], threshold: int | Column | None = None) -> DataFrame:
    """df with its chance of being drawn, its part for subsampling, and its threshold, that of the chance if none is told."""
    if threshold is None:
        threshold = keyed.below(p) if isinstance(p, (int, float)) else F.least(F.lit(keyed.RANGE), F.ceil(p * keyed.RANGE))
    p, threshold = (F.lit(x) if isinstance(x, (int, float)) else x for x in (p, threshold))
    own = [F.col(f"`{c}`") for c in df.columns if c not in (PROB, PART, THRESHOLD)]
    return df.select(*own, p.cast("double").alias(PROB), keyed.part(seed, keys).alias(PART), threshold.cast("long").alias(THRESHOLD))


def plain(sample: DataFrame) -> DataFrame:
    return sample.drop(PROB, PART, THRESHOLD)


def uniform(base: DataFrame, rows: int, k: int, seed: int | str, keys: list[str]) -> DataFrame:
    """A new sample of k of the base's rows."""
    drawn, threshold, n = draw(base, k, seed, keys, rows)
    return weighted(drawn, 1.0 if n is None else min(1.0, n / max(rows, 1)), seed, keys, threshold)


def with_new(sample: DataFrame, batch: DataFrame | None) -> DataFrame:
    """The rows of the sample with their chances and thresholds and those of the batch, which have none yet. A sample from before
    thresholds were kept is one part."""
    old = sample.drop(PART) if THRESHOLD in sample.columns else sample.drop(PART).withColumn(THRESHOLD, F.lit(keyed.RANGE))
    none = {PROB: F.lit(None).cast("double"), THRESHOLD: F.lit(None).cast("long")}
    return old if batch is None else old.unionByName(batch.withColumns(none), allowMissingColumns=True)


def thinned(sample: DataFrame, batch: DataFrame | None, k: int, rows: int, seed: int | str, keys: list[str]) -> DataFrame:
    """k rows of the sample, and the batch if there is one, with the chances of their parts; rows is what they all stand for. The
    threshold is that of the least thinned part at most. A row for each part goes to the driver."""
    drawn, threshold, _ = draw(with_new(sample, batch), k, seed, keys, rows)
    parts = drawn.groupBy(THRESHOLD, PROB).agg(F.count(F.lit(1)).alias("n")).collect()
    known = [r[THRESHOLD] for r in parts if r[THRESHOLD] is not None]
    t = min(threshold, max(known, default=keyed.RANGE))
    apart = [r for r in parts if r[THRESHOLD] is not None and r[THRESHOLD] < t]
    drawn = drawn.where(keyed.unit(seed, keys) < t) if t < threshold else drawn
    n = sum(r["n"] for r in parts) - sum(r["n"] for r in apart) if t == threshold else drawn.where(F.coalesce(F.col(THRESHOLD) >= t, F.lit(True))).count()
    p = min(1.0, n / max(rows - sum(round(r["n"] / r[PROB]) for r in apart), 1))
    stays = F.coalesce(F.col(THRESHOLD) < t, F.lit(False))
    return weighted(drawn, F.when(stays, F.col(PROB)).otherwise(p), seed, keys, F.when(stays, F.col(THRESHOLD)).otherwise(keyed.RANGE if p == 1.0 else t))


def uniform_ratio(base: DataFrame, ratio: float, seed: int | str, keys: list[str]) -> DataFrame:
    """A new sample with each row drawn at the ratio, which is rounded to 4 places and at least 0.0001."""
    ratio = max(0.0001, round(ratio, 4))
    return weighted(bernoulli(base, ratio, seed, keys), ratio, seed, keys)


def uniform_update(sample: DataFrame, batch: DataFrame, size: int, base_rows: int, batch_rows: int, seed: int | str, keys: list[str]) -> DataFrame:
    """The sample of base and batch of the same size, from sample and batch alone. base_rows excludes the batch."""
    return thinned(sample, batch, size, base_rows + batch_rows, seed, keys)


def find_x(need: int, size: int, m: int, seed: int | str) -> int:
    """How many rows of the old sample an extension keeps: whole, even in max(need - m, LEAST) to size, fixed by the seed. Without any
    row of it, nothing would stand for the table before the batch."""
    import hashlib

    low, high = max(need - m, min(LEAST, size)), size
    return low if high <= low else low + int(hashlib.md5(f"{seed}/x".encode()).hexdigest()[:8], 16) % (high - low + 1)


def uniform_adaptive(sample: DataFrame, batch: DataFrame, need: int, x: int, base_rows: int, batch_rows: int, seed: int | str, keys: list[str]) -> DataFrame:
    """x rows of the old sample and need - x of the batch, each part with its own chance."""
    return thinned(sample, None, x, base_rows, seed, keys).unionByName(uniform(batch, batch_rows, need - x, seed, keys), allowMissingColumns=True)


def uniform_incremental(sample: DataFrame, batch: DataFrame, ratio: float, seed: int | str, keys: list[str]) -> DataFrame:
    """The old sample and the batch's rows at the ratio."""
    return sample.unionByName(uniform_ratio(batch, ratio, seed, keys), allowMissingColumns=True)


def universe(base: DataFrame, column: str, ratio: float, seed: int | str, keys: list[str]) -> DataFrame:
    """A sample of a column's values with all rows of each: tables that are sampled so by columns that join keep the pairs that join. Rows
    of a batch are in it by the same rule, so the sample of (table + batch) is the one of the table and the one of the batch."""
    ratio = max(0.0001, round(ratio, 4))
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return weighted(base.withColumn("_key", value).where(keyed.unit(f"{seed}/universe", ["_key"]) < keyed.below(ratio)).drop("_key"), ratio, seed, keys)


# by strata


def group_sizes(df: DataFrame, column: str) -> DataFrame:
    """(column, group_size); null is a stratum."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("group_size"))


def merged_sizes(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Sizes of two tables together."""
    return a.unionByName(b).groupBy(column).agg(F.sum("group_size").alias("group_size"))


def cap_for(sizes: DataFrame, target: Column | float) -> DataFrame:
    """One row, cap: the largest whole number for which the sum of least(group_size, cap) is at most the target.

    Exact: strata of one size are one row, of which there are at most about the square root of twice the rows; running
    sums over them give the total at each size, and between two sizes it grows by the number of larger strata.
    """
    target = F.lit(target) if isinstance(target, (int, float)) else target
    by = sizes.groupBy("group_size").agg(F.count(F.lit(1)).alias("n"))
    up = Window.orderBy("group_size").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("group_size").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = by.select("group_size", F.sum("n").over(up).alias("le"), F.sum(F.col("n") * F.col("group_size")).over(up).alias("rows"), F.sum("n").over(every).alias("groups"))
    total = total.withColumn("at", F.col("rows") + F.col("group_size") * (F.col("groups") - F.col("le")))
    room = F.when(F.col("groups") > F.col("le"), F.floor((target - F.col("at")) / (F.col("groups") - F.col("le")))).otherwise(F.lit(0))
    last = F.max_by(F.col("group_size") + room, F.when(F.col("at") <= target, F.col("group_size")))
    caps = total.agg(last.alias("c"), F.max("groups").alias("groups"))
    return caps.select(F.coalesce("c", F.floor(target / F.col("groups")), F.lit(0)).cast("long").alias("cap"))


def cap_value(sizes: DataFrame, target: float, least: int = LEAST) -> int:
    return max(cap_for(sizes, float(target)).first()["cap"] or 0, least)


def bottom_cap(df: DataFrame, column: str, sizes: DataFrame, cap: int, seed: int | str, keys: list[str]) -> DataFrame:
    """Of each stratum its cap rows with the least keyed numbers, all if it has no more; with _u, the number, _kept, how many, and _size.

    Rows that are surely not among them are filtered before strata are ordered: in a stratum of s rows of which c are drawn,
    the c-th least number is below (c + 10 sqrt(c) + 50) / s of the range, save with a chance under 1e-15. So what is
    ordered is about the sample, and a stratum that holds most rows isn't sorted whole. The sizes are those of the table of which
    df holds the rows with the least numbers; of a table that grew they are the sizes now.
    """
    bound = cap + 10 * cap**0.5 + 50
    rows = _with_size(df.withColumn("_u", keyed.unit(seed, keys)), column, sizes)
    near = rows.where((F.col("_size") <= bound) | (F.col("_u") < F.lit(bound) / F.col("_size") * keyed.RANGE))
    stratum = Window.partitionBy(column)
    ranked = near.withColumn("_r", F.row_number().over(stratum.orderBy("_u", *keys))).withColumn("_kept", F.least(F.count(F.lit(1)).over(stratum), F.lit(cap)))
    return ranked.where(F.col("_r") <= cap).drop("_r")


def _with_size(df: DataFrame, column: str, sizes: DataFrame) -> DataFrame:
    own = sizes.select(F.col(column).alias("_g"), F.col("group_size").alias("_size"))
    return df.join(own, F.col(column).eqNullSafe(F.col("_g"))).drop("_g")


def parted(drawn: DataFrame, column: str, rows: Column, seed: int | str, keys: list[str]) -> DataFrame:
    """What bottom_cap drew, with the chances of the parts of its stratum; rows is what a stratum's drawn rows stand for. Rows that
    come with a chance and a threshold are of the parts that those name; the windows lie as bottom_cap's do, so nothing is shuffled."""
    stratum = Window.partitionBy(column)
    out = drawn.withColumn("_t", F.max("_u").over(stratum) + 1)
    stays = F.coalesce(F.col(THRESHOLD) < F.col("_t"), F.lit(False))
    out = out.withColumns({"_n": F.sum(F.when(stays, 0).otherwise(1)).over(stratum), "_rest": rows - F.round(F.coalesce(F.sum(F.when(stays, 1 / F.col(PROB))).over(stratum), F.lit(0.0)))})
    whole = F.col("_n") >= F.col("_rest")
    p = F.when(stays, F.col(PROB)).when(whole, 1.0).otherwise(F.col("_n") / F.col("_rest"))
    t = F.when(stays, F.col(THRESHOLD)).when(whole, keyed.RANGE).otherwise(F.col("_t"))
    return weighted(out, p, seed, keys, t)


def stratified(base: DataFrame, column: str, sizes: DataFrame, cap: int, seed: int | str, keys: list[str]) -> DataFrame:
    """A new sample with at most cap rows of each stratum; sizes are the base's."""
    drawn = bottom_cap(base, column, sizes, cap, seed, keys)
    t = F.when(F.col("_kept") < F.col("_size"), F.max("_u").over(Window.partitionBy(column)) + 1).otherwise(keyed.RANGE)
    return weighted(drawn, F.col("_kept") / F.col("_size"), seed, keys, t).drop("_u", "_kept", "_size")


def stratified_bernoulli(base: DataFrame, column: str, sizes: DataFrame, cap: int, seed: int | str, keys: list[str]) -> DataFrame:
    """A new sample with each row drawn by chance: cap / size, or the guard of its stratum if that is more."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(cap) / F.col("_size"), sizing.guard(F.col("_size"))))
    rows = _with_size(base, column, sizes).withColumn("_p", p)
    return weighted(bernoulli(rows, F.col("_p"), seed, keys), F.col("_p"), seed, keys).drop("_p", "_size")


def stratified_update(sample: DataFrame, batch: DataFrame, column: str, sizes: DataFrame, cap: int, seed: int | str, keys: list[str]) -> DataFrame:
    """The sample by a cap of base and batch, from sample and batch alone. sizes are those of base and batch together."""
    drawn = bottom_cap(with_new(sample, batch), column, sizes, cap, seed, keys)
    return parted(drawn, column, F.col("_size"), seed, keys).drop("_u", "_kept", "_size", "_t", "_n", "_rest")


def stratified_adaptive(sample: DataFrame, batch: DataFrame, column: str, sizes: DataFrame, x: int, need: int, seed: int | str, keys: list[str]) -> DataFrame:
    """A cap for x rows of the old sample and one for need - x rows of the batch, and for what either keeps of a stratum its own
    chance, of the stratum's rows before the batch and in it. sizes are those of base and batch together."""
    a, b = group_sizes(sample, column), group_sizes(batch, column)
    old = bottom_cap(with_new(sample, None), column, a, cap_value(a, x), seed, keys).drop("_size")
    before = sizes.unionByName(b.select(column, (-F.col("group_size")).alias("group_size"))).groupBy(column).agg(F.sum("group_size").alias("group_size"))
    old = parted(_with_size(old, column, before), column, F.col("_size"), seed, keys).drop("_u", "_kept", "_size", "_t", "_n", "_rest")
    return old.unionByName(stratified(batch, column, b, cap_value(b, need - x), seed, keys), allowMissingColumns=True)


def stratified_incremental(sample: DataFrame, batch: DataFrame, column: str, target: float, seed: int | str, keys: list[str]) -> DataFrame:
    """The old sample and a stratified sample of the batch alone, of about target rows."""
    b = group_sizes(batch, column)
    return sample.unionByName(stratified(batch, column, b, cap_value(b, target), seed, keys), allowMissingColumns=True)


def simple_sample(df: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Spark's own Bernoulli sample."""
    return df.sample(False, ratio, seed)
