"""What the training-data operators share: shared storage, lineage cuts, bounded batches, salted joins."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a table that may be sent to every executor; beyond either another plan is used.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Bytes that cross to a Python worker at once; the same for all operators, so that frames of several may be built before one runs.
BATCH_BYTES = 4 << 20
#: Rows of a key up to which it is never hot.
HOT_ROWS = 256
#: Bits of a row's key that its place in its file takes; the file's number has the others.
PLACE_BITS = 36
#: What separates words everywhere in this subpackage.
WORD_SPACE = r"[\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package and bounds the bytes that cross to Python at once.

    On a cluster ship the package with ``--py-files``; in local mode the workers find it by the path set here.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env, now = spark.sparkContext.environment, os.environ.get("PYTHONPATH", "")
    if root not in (env.get("PYTHONPATH") or now).split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH") or now) if x)
    if root not in sys.path:
        sys.path.append(root)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def tidy(task):
    """A task whose worker gives memory that it doesn't need back to the system when it ends, since workers wait for the next task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def partitions(df: DataFrame) -> int:
    """Of a table's scan, dealt anew or not."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: dealt anew where it has fewer partitions than there are cores, as a table of one small file has. What comes out
    of a shuffle is dealt already, and isn't run to count its partitions."""
    cores, run = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if "AdaptiveSparkPlan" in run.executedPlan().toString():
        return df
    return df.repartition(cores) if partitions(df) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        at = "file://" + tempfile.gettempdir() + "/tidewell-shared"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name in the shared folder; removed when the driver ends."""
    at = f"{shared_dir(spark)}/tidewell/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(drop_scratch)
    _made.append((spark, at))
    return at


def drop_scratch() -> None:
    """Removes what scratch() named; results that still read it must have been written before."""
    while _made:
        spark, at = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may have ended before; its folder is temporary anyway
            return


def kept(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    at = scratch(spark, tag)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def file_system(uri: str):
    """pyarrow's file system for a URI or a local path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def write_file(uri: str, data: bytes) -> None:
    """Writes a whole file under a name of its own and then moves it to its place, so that readers see all or nothing."""
    fs, path = file_system(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, path)


def read_file(uri: str) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_stream(path, compression=None) as got:
        return got.read()


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in a partition that is sorted by keys, across batch borders."""
    import numpy as np

    waiting: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table[k].combine_chunks() for k in keys]
        change = np.zeros(table.num_rows, bool)
        for c in columns:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a].as_py() for c in columns)
            if key != last and waiting:
                yield pa.concat_tables(waiting)
                waiting = []
            last = key
            waiting.append(table.slice(a, b - a))
    if waiting:
        yield pa.concat_tables(waiting)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df, counted, has at most so many rows and bytes (as text). df is written already or cheap to make."""
    n, b = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return n <= rows and (b or 0) <= size


def join_small_or_salted(left: DataFrame, right: DataFrame, key: str, salt_by: str | None = None, *, salts: int | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join on key, nulls equal to nulls. right has one row for each key; left is read twice.

    right is broadcast only if it is counted to few rows and bytes. Else both sides are shuffled, whatever the planner takes their
    sizes for (it doesn't see that explode makes rows more), and right's rows of left's hot keys are repeated for each salt, so that the rows of
    a hot key spread over ``salts`` tasks (an eighth of the shuffle's partitions, 16 at least). A key is hot if it has over a
    quarter of a task's share of the rows, so there are at most 4 * salts. The salt is a hash of ``salt_by`` or, without it, of the row's place in left, which is a
    written table then; either stays the same when a lost task runs again, and the place differs for repeated rows too.
    """
    other = right.withColumnRenamed(key, "_key")
    if small(right, rows):
        return left.join(F.broadcast(other), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    salts = salts or max(16, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    if salts == 1:
        return left.join(other.hint("merge"), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    limit = max(HOT_ROWS, left.count() // (4 * salts))
    hot = kept(left.groupBy(F.col(key).alias("_hot")).count().where(F.col("count") > limit).select("_hot", F.lit(salts).alias("_salts")), "hot")
    marked = lambda df, c: df.join(F.broadcast(hot), F.col(c).eqNullSafe(F.col("_hot")), "left")
    other = marked(other, "_key").withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_hot", "_salts")
    salted = marked(left.withColumn("_place", F.monotonically_increasing_id()) if not salt_by else left, key)
    salt = F.pmod(F.xxhash64(salt_by or "_place"), F.col("_salts")).cast("int")
    salted = salted.withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_hot", "_salts", "_place")
    return salted.join(other.hint("merge"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_salt2")), "left").drop("_key", "_salt", "_salt2")


def without_ids(df: DataFrame, ids: DataFrame, id_column: str = "doc_id", *, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of df whose id isn't in ids (one column, written already); rows without an id stay.

    The ids are broadcast only if they are counted to at most ``rows``; else both sides are shuffled by id.
    """
    name = free_name(df, "_gone")
    gone = ids.toDF(name).where(F.col(name).isNotNull())
    side = F.broadcast(gone) if small(gone, rows) else gone.hint("merge")
    return df.join(side, F.col(f"`{id_column}`") == F.col(name), "left_anti")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until df has no such column."""
    while name in [c.lower() for c in df.columns]:
        name += "_"
    return name


def stored(df: DataFrame) -> bool:
    """Whether df is a Parquet table as it lies, which reads the same each time; what is made of one may not, so it is written where it is read twice."""
    plan = df._jdf.queryExecution().analyzed().toString().strip()
    return plan.startswith("Relation ") and plan.endswith("] parquet") and "\n" not in plan


def keyed(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df with a column more that is unique for each row and the same each time that it is read, and that column's name.

    Rows of a stored table are told by their file's number among the table's and their place in it, so no copy is made; other tables are written,
    and so is one that reads a file twice.
    """
    name = free_name(df, "_row")
    path, file, place = (free_name(df, c) for c in ("_path", "_file", "_place"))
    files = None
    if stored(df):
        at = df.metadataColumn("_metadata")
        rows = df.select("*", at["file_path"].alias(path), at["row_index"].alias(place))
        files = rows.groupBy(path).agg(F.count(F.lit(1)) == F.max(place) + 1).collect()  # as many as the driver has listed
    if files is None or not all(once for _, once in files):
        return kept(df.withColumn(name, F.monotonically_increasing_id()), tag), name
    numbers = df.sparkSession.createDataFrame([(f, i) for i, (f, _) in enumerate(sorted(files))], f"{file} string, {name} long")
    rows = rows.join(F.broadcast(numbers), F.col(path) == F.col(file))
    return rows.withColumn(name, F.shiftleft(name, PLACE_BITS).bitwiseOR(F.col(place))).drop(path, file, place), name
