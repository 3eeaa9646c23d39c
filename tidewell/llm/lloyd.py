"""Centroid clustering by plain Lloyd rounds in whole numbers, so that every run and every engine gives the same clusters.

Vectors of the right length without null or non-finite components become whole numbers, written once. In a round the centroids, a
fixed small table, go to every task; ``mapInPandas`` takes the squared differences to each centroid in NumPy, and the smallest
column of the least distance is the vector's cluster. A task gives at most one row of sums for each cluster, sums merge through
``groupBy``, and k rows come back to the driver, which divides them exactly. So a round moves k rows a task whatever the
vectors are, and a vector that a third of all rows hold costs no more than others.

Defined cases: vectors that are null, of another length, or hold a null, NaN or infinity are left out, and so are vectors with a
component beyond ±``MOST``, whose squared distances a long can't hold; fewer vectors than centroids start as many; ties go to
the smaller number; a cluster without vectors keeps its centroid; null ids hash like empty ones, repeated ids start in the order of
their vectors, and repeated rows count as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIM, SCALE = 64, 256
K, ROUNDS, SEED = 40, 5, "2"
#: Most that a component may be: (2 * 256 * MOST) ** 2 * 64 is under 2 ** 63.
MOST = 1 << 19


def whole_vectors(df: DataFrame, id_column: str, vector_column: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, v): the vectors that are taken, each component x as floor(scale * x)."""
    v = F.col(f"`{vector_column}`")
    x = F.transform(v, lambda c: c.cast("double"))
    fit = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= MOST)
    ok = F.coalesce(F.size(v) == dim, F.lit(False)) & F.coalesce(F.forall(x, fit), F.lit(False))
    return df.where(ok).select(F.col(f"`{id_column}`").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared differences (vectors x centroids)."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = x - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, dim), np.int64)


def round_sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Rows and componentwise sums of each cluster that has vectors."""
    dim = centroids.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        n, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for f in frames:
            x = _matrix(f["v"], dim)
            own = distances(x, c).argmin(axis=1)
            n += np.bincount(own, minlength=len(c))
            np.add.at(total, own, x)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "s": [t.tolist() for t in total[some]]})

    by = rows.select("v").mapInPandas(task, "cluster int, n long, s array<long>")
    sums = by.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i].cast("decimal(19,0)")).alias(f"s{i}") for i in range(dim)]).collect()
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(dim)]) for r in sums}


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector. Ids cross to pandas as text, where whole numbers with nulls between would turn into floats."""
    dim, sent = centroids.shape[1], rows.sparkSession.sparkContext.broadcast(centroids)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            d = distances(_matrix(f["v"], dim), sent.value)
            own = d.argmin(axis=1)
            yield pd.DataFrame({"id": f["id"], "cluster": own.astype(np.int32), "distance": d[np.arange(len(d)), own]})

    out = rows.withColumn("id", F.col("id").cast("string")).mapInPandas(task, "id string, cluster int, distance long")
    return out.withColumn("id", F.col("id").cast(rows.schema["id"].dataType))


def started(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose ids have the least hashes, in their order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def clustered(df: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: str = SEED, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector that is taken, written, and the last centroids."""
    common.ready(df.sparkSession)
    rows = common.kept(common.spread(whole_vectors(df, id_column, vector_column, dim, scale)), "vectors")
    centroids = started(rows, k, seed)
    if not len(centroids):
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        for c, (n, s) in round_sums(rows, centroids).items():
            centroids[c] = [x // n for x in s]
    return common.kept(assigned(rows, centroids), "clusters"), centroids


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 40 clusters, with the distances of a cluster and of all summed up."""
    out, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda d: int(d) if d < 1 << 63 else None
    names = [(c, fits(d), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sums.items()]
    each = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(each), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = K, rounds: int = ROUNDS) -> str:
    near = "SELECT vec_id, v, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (SELECT r, vec_id, v, c, list_sum([(x[1] - x[2]) ** 2 FOR x IN list_zip(v, w)])::HUGEINT AS d FROM e, c{i}) GROUP BY r, vec_id, v"
    out = [
        f"e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE)::HUGEINT FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) = {DIM} AND len([1 FOR x IN embedding IF x IS NOT NULL AND isfinite(x) AND abs(x) <= {MOST}]) = {DIM})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256(concat('2:', vec_id)), v) - 1)::INT AS c, v AS w FROM e QUALIFY c < {k})",
    ]
    for i in range(rounds):
        out.append(f"a{i} AS MATERIALIZED ({near.format(k=k, i=i)})")
        part = f"SELECT c, i, ((s - ((s % n) + n) % n) // n) AS w FROM (SELECT c, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, range(1, {DIM + 1}) AS g(i) GROUP BY c, i)"
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.w, c{i}.w) AS w FROM c{i} LEFT JOIN (SELECT c, list(w ORDER BY i) AS w FROM ({part}) GROUP BY c) AS m USING (c))")
    out.append(f"f AS MATERIALIZED ({near.format(k=k, i=rounds)})")
    return f"WITH {', '.join(out)} SELECT vec_id, f.c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256 FROM f JOIN c{rounds} USING (c)"


OP13_SQL = _sql()
