"""A query for each operator, and the same in SQL. Both run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keyed, sizing
from ..operators import engine, evaluate, profile, sampling, store
from ..sources import files, tables
from ..streaming import ingest
from . import aqp, policy
from . import query as q
from . import text as texts

Run = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Run] = {}
_SQL: dict[str, str] = {}

#: The row key of lineitem; the last is a whole number for hashing.
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_qty"]
KEYS_SQL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(l_quantity AS BIGINT)"]
SEED = 42
U = keyed.unit_sql(SEED, KEYS_SQL)
PART_U = keyed.unit_sql(f"{SEED}/part", KEYS_SQL)
#: The batch in maintenance queries: a fifth of the keys, by another seed.
BATCH = keyed.unit_sql("batch", KEYS_SQL) + f" < {keyed.below(0.2)}"


def _query(sql: str | None = None):
    def put(f: Run) -> Run:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("l_qty", F.col("l_quantity").cast("bigint"))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base and batch."""
    df, u = files.spread(df.select(*KEYS, "l_extendedprice", "l_returnflag")), keyed.unit("batch", KEYS)
    return df.where(u >= keyed.below(0.2)), df.where(u < keyed.below(0.2))


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder in the folder that the cluster shares; removed when the driver ends."""
    import atexit
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = "file://" + tempfile.gettempdir()
    at = f"{base.rstrip('/')}/tidewell/{tag}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            store.Store(spark, at).drop(".")
        except Exception:  # the session may have ended before
            return

    atexit.register(remove)
    return at


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, tag: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What an operation starts from, such as a sample that it updates: written once a session, as an engine has it."""
    key = spark.sparkContext.applicationId, sf_dir, tag
    if key not in _STORED:
        at = scratch(spark, tag)
        make().write.parquet(at)
        _STORED[key] = at
    return spark.read.parquet(_STORED[key])


def stored_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """split(), each part as a stored table."""
    base, batch = split(lineitem(spark, sf_dir))
    return stored(spark, sf_dir, "base", lambda: base), stored(spark, sf_dir, "batch", lambda: batch)


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    """What tells two sets of rows apart: number, sum of keys, and money."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("key_sum"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


SUMS = "count(*) AS n, sum(l_orderkey)::BIGINT AS key_sum, round(sum(l_extendedprice), 2) AS price"

# sources and sinks


@_query(f"SELECT l_returnflag, {SUMS} FROM lineitem GROUP BY l_returnflag")
def s1_load_batches(spark, sf_dir):
    """A base and a batch appended as two loads, read as one table; the batch again changes nothing."""
    base, batch = split(lineitem(spark, sf_dir))
    at = scratch(spark, "load")
    for i, b in enumerate((base, batch, batch)):
        files.append(b, at, min(i, 1))
    return _sums(spark.read.parquet(at), "l_returnflag")


@_query(f"SELECT l_returnflag, {SUMS} FROM lineitem GROUP BY l_returnflag")
def s5_delimited_text(spark, sf_dir):
    """Written as delimited text and read with a declared schema."""
    at = scratch(spark, "text")
    files.write_delimited(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag"), at, "|")
    return _sums(files.read_delimited(spark, at, "l_orderkey bigint, l_extendedprice double, l_returnflag string", "|"), "l_returnflag")


@_query("SELECT o_orderpriority AS priority, count(*) AS n, sum(o_custkey)::BIGINT AS custs FROM orders GROUP BY 1")
def s16_result_text(spark, sf_dir):
    """A result table as text with a header, written and read."""
    at = scratch(spark, "result")
    files.write_results(table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("custs")), at)
    return files.read_results(spark, at, "priority string, n bigint, custs bigint")


@_query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def s18_json_rows(spark, sf_dir):
    return files.json_rows(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@_query("SELECT n_nationkey || '|' || n_name AS value FROM nation")
def s19_last_separator(spark, sf_dir):
    lines = table(spark, sf_dir, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit("|"), F.col("n_name"), F.lit("|")).alias("value"))
    return files.without_last_separator(lines)


@_query("SELECT 'nation' AS table_name, count(*) AS rows FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders")
def s20_dimension_counts(spark, sf_dir):
    return files.row_counts({n: table(spark, sf_dir, n) for n in ("nation", "region", "supplier", "customer", "part", "orders")})


_TBL = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey"}


@_query("SELECT 'partsupp' AS table_name, count(*) AS rows, sum(l_partkey)::BIGINT AS key_sum FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)" + "".join(f" UNION ALL SELECT '{t}', count(*), sum({k})::BIGINT FROM {t}" for t, k in _TBL.items()))
def s20_delimited_dimensions(spark, sf_dir):
    """The dimension tables as text with a separator at each line's end, cleaned, read by their schemas, and counted."""
    at = scratch(spark, "tbl")
    for name in (*_TBL, "partsupp"):
        if name == "partsupp":
            df = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct()
        else:
            df = table(spark, sf_dir, name)
        columns = [c.split()[0] for c in files.TPCH[name].split(", ")]
        line = F.concat(*[x for c in columns for x in (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit(""), F.lit("|"))])
        df.select(line.alias("value")).write.text(f"{at}/raw/{name}")
        files.clean_delimited(spark, f"{at}/raw/{name}", f"{at}/{name}.tbl")
    read = files.read_tpch(spark, at, names=(*_TBL, "partsupp"))
    out = [read[t].agg(F.count(F.lit(1)).alias("rows"), F.sum(k).alias("key_sum")).select(F.lit(t).alias("table_name"), "rows", "key_sum") for t, k in (*_TBL.items(), ("partsupp", "ps_partkey"))]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


_LINES = "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint, l_qty bigint, l_extendedprice double, l_returnflag string"


def _counts_by_flag(t: engine.SampledTable) -> DataFrame:
    return _sums(t.base(), "l_returnflag").withColumn("batches", F.lit(t.state()["batch"] + 1).cast("bigint"))


@_query(f"SELECT l_returnflag, {SUMS}, 3::BIGINT AS batches FROM lineitem GROUP BY l_returnflag")
def s10_files_by_name(spark, sf_dir):
    """Five text files of a folder, two to a batch in the order of their names, by three calls of which each goes on where the last ended."""
    at, df = scratch(spark, "named"), files.spread(lineitem(spark, sf_dir).select(*[c.split()[0] for c in _LINES.split(", ")]))
    parts = F.pmod(F.xxhash64("l_orderkey"), F.lit(5))
    fs, _ = store.Store(spark, at)._path(at)
    for i in range(5):
        files.write_delimited(df.where(parts == i).coalesce(1), f"{at}/made/{i}")
        name = next(x.name for x in ingest.named_files(spark, f"{at}/made/{i}"))
        fs.mkdirs(store.Store(spark, at)._path(f"{at}/in")[1])
        fs.rename(store.Store(spark, at)._path(f"{at}/made/{i}/{name}")[1], store.Store(spark, at)._path(f"{at}/in/hour-{9 - i}.csv")[1])
    t = engine.SampledTable(spark, f"{at}/table", "lineitem", engine.Settings(KEYS, columns=["l_extendedprice"]))
    for _ in range(3):
        ingest.by_name(t, f"{at}/in", _LINES, files=2, most=1)
    ingest.by_name(t, f"{at}/in", _LINES, files=2)
    return _counts_by_flag(t)


@_query(f"SELECT l_returnflag, {SUMS}, 4::BIGINT AS batches FROM lineitem GROUP BY l_returnflag")
def s7_file_stream(spark, sf_dir):
    """A base table, then a stream of three files, one to a batch, run twice: the second run finds nothing new."""
    at, df = scratch(spark, "stream"), files.spread(lineitem(spark, sf_dir).select(*[c.split()[0] for c in _LINES.split(", ")]))
    parts = F.pmod(F.xxhash64("l_orderkey"), F.lit(4))
    t = engine.SampledTable(spark, f"{at}/table", "lineitem", engine.Settings(KEYS, columns=["l_extendedprice"]))
    t.receive(df.where(parts == 0), 0)
    for i in (1, 2, 3):
        df.where(parts == i).coalesce(1).write.mode("append").csv(f"{at}/in")
    for _ in range(2):
        ingest.into(ingest.file_batches(spark, f"{at}/in", _LINES), t, f"{at}/checkpoint").awaitTermination()
    return _counts_by_flag(t)


@_query("SELECT n_regionkey, count(*) AS n, sum(n_nationkey)::BIGINT AS key_sum FROM nation GROUP BY n_regionkey")
def s9_socket_lines(spark, sf_dir):
    """Lines sent to a socket, into a table at a fixed rate. The sender is a thread of this test; the lines are a dimension's."""
    import socket
    import threading

    lines = [f"{r[0]},{r[1]}" for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()]
    server, at = socket.create_server(("127.0.0.1", 0)), scratch(spark, "socket")

    def serve() -> None:
        c, _ = server.accept()
        c.sendall(("\n".join(lines) + "\n").encode())
        c.recv(1)

    threading.Thread(target=serve, daemon=True).start()
    t = engine.SampledTable(spark, f"{at}/table", "nation", engine.Settings(["n_nationkey"], columns=["n_nationkey"]))
    stream = ingest.socket_lines(spark, "127.0.0.1", server.getsockname()[1], "n_nationkey bigint, n_regionkey bigint")
    q_ = ingest.into(stream, t, f"{at}/checkpoint", every="1 second")
    try:
        for _ in range(60):
            q_.processAllAvailable()
            if t.state()["rows"] >= len(lines):
                break
    finally:
        q_.stop()
        server.close()
    return t.base().groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.sum("n_nationkey").alias("key_sum"))


@_query("SELECT * FROM (VALUES ('after create', 2, (SELECT count(*) FROM nation)), ('like', 2, 0), ('inserted', 2, (SELECT 2 * count(*) FROM nation)), ('truncated', 2, 0), ('renamed', 2, 0), ('dropped', 1, (SELECT count(*) FROM nation))) AS t(step, tables, rows)")
def c5_table_statements(spark, sf_dir):
    """A database of its own: create as select, like, insert, truncate, rename, drop; tables and rows after each step."""
    steps = []
    with tables.database(spark, scratch(spark, "db")) as db:
        tables.create(db, "nations", table(spark, sf_dir, "nation"))
        tables.create_like(db, "copy", "nations")
        seen = lambda step, name: steps.append((step, len(tables.names(db)), tables.count(db, name)))
        seen("after create", "nations")
        seen("like", "copy")
        tables.insert(db, "copy", db.table("nations"))
        tables.insert(db, "copy", db.table("nations"))
        seen("inserted", "copy")
        tables.truncate(db, "copy")
        seen("truncated", "copy")
        tables.rename(db, "copy", "other")
        seen("renamed", "other")
        tables.drop(db, "other")
        tables.drop(db, "other")
        seen("dropped", "nations")
    return spark.createDataFrame(steps, "step string, tables int, rows bigint")


@_query("SELECT true AS database_there, count(*) > 0 AS table_there, count(*) FILTER (table_name = 'other') > 0 AS other_there, false AS database_left, string_agg(column_name || ' ' || CASE data_type WHEN 'VARCHAR' THEN 'string' ELSE 'bigint' END, ',' ORDER BY ordinal_position) AS columns FROM information_schema.columns WHERE table_name IN ('nation', 'other')")
def c2_catalog_lookups(spark, sf_dir):
    """SHOW DATABASES, existence of tables, and a table's columns."""
    with tables.database(spark, scratch(spark, "db")) as db:
        tables.create(db, "nations", table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint"), "n_name", F.col("n_regionkey").cast("bigint")))
        row = db.name in tables.databases(spark), tables.exists(db, "nations"), tables.exists(db, "other"), tables.described(db, "nations")
        name = db.name
    return spark.createDataFrame([(*row[:3], name in tables.databases(spark), row[3])], "database_there boolean, table_there boolean, other_there boolean, database_left boolean, columns string")


@_query("SELECT copy, count(*) AS n, sum(s_suppkey)::BIGINT AS key_sum FROM supplier, range(1, 4) AS r(copy) GROUP BY copy")
def s21_replicated(spark, sf_dir):
    return files.replicated(table(spark, sf_dir, "supplier"), 3).groupBy(F.col("copy").cast("bigint").alias("copy")).agg(F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("key_sum"))


# filters and projections


@_query("SELECT count(*) AS n, 'x' AS tag FROM lineitem WHERE l_quantity > 4 AND l_quantity <= 15 AND (l_returnflag = 'A' OR l_discount < 0.02 OR l_tax >= 0.08)")
def f4_comparisons(spark, sf_dir):
    """Comparisons joined by and and or, with a constant column."""
    c = F.col
    df = table(spark, sf_dir, "lineitem").where((c("l_quantity") > 4) & (c("l_quantity") <= 15) & ((c("l_returnflag") == "A") | (c("l_discount") < 0.02) | (c("l_tax") >= 0.08)))
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("tag", F.lit("x"))


@_query("SELECT p_type, count(*) AS n, sum(CASE WHEN p_size BETWEEN 1 AND 10 THEN 1 ELSE 0 END)::BIGINT AS small FROM part WHERE p_brand IN ('Brand#12', 'Brand#23', 'Brand#14') AND (p_type LIKE 'PROMO%' OR p_size IS NOT NULL) GROUP BY p_type")
def f6_between_in_like_case(spark, sf_dir):
    df = table(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#12", "Brand#23", "Brand#14") & (F.col("p_type").like("PROMO%") | ~F.col("p_size").isNull()))
    return df.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("p_size").between(1, 10), 1).otherwise(0)).alias("small"))


@_query("SELECT year(l_shipdate)::INT AS y, count(*) AS n FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' GROUP BY 1")
def f11_date_range(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").where("l_shipdate BETWEEN TIMESTAMP_NTZ '1996-01-01' AND TIMESTAMP_NTZ '1998-12-31'")
    return df.groupBy(F.year("l_shipdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT l_returnflag, {SUMS} FROM lineitem WHERE {U} < {keyed.below(0.1)} GROUP BY l_returnflag")
def f12_bernoulli(spark, sf_dir):
    return _sums(sampling.bernoulli(lineitem(spark, sf_dir), 0.1, SEED, KEYS), "l_returnflag")


@_query(f"SELECT l_returnflag, {SUMS} FROM lineitem JOIN (SELECT l_returnflag AS g, 1000.0::DOUBLE / count(*) AS p FROM lineitem GROUP BY 1) ON l_returnflag = g WHERE {U} < p * {keyed.RANGE} GROUP BY l_returnflag")
def f13_bernoulli_by_group(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    rows = sampling._with_size(df, "l_returnflag", sampling.group_sizes(df, "l_returnflag"))
    return _sums(sampling.bernoulli(rows.withColumn("p", F.lit(1000.0) / F.col("_size")), F.col("p"), SEED, KEYS), "l_returnflag")


@_query("SELECT n, round(0.1 * n - 5 * sqrt(0.09 * n), 4) AS least, round(0.1 * n + 5 * sqrt(0.09 * n), 4) AS most, true AS within FROM (SELECT count(*) AS n FROM lineitem)")
def f14_spark_sample(spark, sf_dir):
    """Spark's own sample, whose rows no other engine can draw: their number is within five standard deviations of the ratio's."""
    df = table(spark, sf_dir, "lineitem")
    every, drawn = df.agg(F.count(F.lit(1)).alias("n")), sampling.simple_sample(df, 0.1, SEED).agg(F.count(F.lit(1)).alias("k"))
    spread = 5 * F.sqrt(0.09 * F.col("n"))
    out = every.join(drawn).select("n", F.round(0.1 * F.col("n") - spread, 4).alias("least"), F.round(0.1 * F.col("n") + spread, 4).alias("most"), "k")
    return out.select("n", "least", "most", F.col("k").between(F.col("least"), F.col("most")).alias("within"))


# joins


@_query("SELECT l_returnflag, s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
def j1_inner(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_returnflag", "s_nationkey").agg(F.count(F.lit(1)).alias("n"))


_NULLED = "(SELECT CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_returnflag END AS g, l_orderkey FROM lineitem)"


@_query(f"SELECT a.g, count(*) AS n, sum(l_orderkey)::BIGINT AS key_sum, any_value(group_size) AS group_size FROM {_NULLED} a JOIN (SELECT g, count(*) AS group_size FROM {_NULLED} GROUP BY g) b ON a.g IS NOT DISTINCT FROM b.g GROUP BY a.g")
def j3_null_safe(spark, sf_dir):
    """Rows with the size of their stratum, where null is a stratum."""
    df = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_suppkey") % 7 != 0, F.col("l_returnflag")).alias("g"), "l_orderkey")
    rows = sampling._with_size(df, "g", sampling.group_sizes(df, "g"))
    return rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("key_sum"), F.max("_size").alias("group_size"))


@_query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS a_n, coalesce(b.n, 0) AS b_n FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1) b ON a.k = b.k")
def j4_full_outer(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"))
    a, b = (x.groupBy("k").agg(F.count(F.lit(1)).alias(n)) for x, n in ((df.where("k % 3 <> 0"), "a_n"), (df.where("k % 2 = 0"), "b_n")))
    return a.join(b, "k", "full_outer").select("k", F.coalesce("a_n", F.lit(0)).alias("a_n"), F.coalesce("b_n", F.lit(0)).alias("b_n"))


@_query(f"SELECT l_suppkey, count(*) FILTER (NOT ({BATCH})) AS a_group_size, count(*) FILTER ({BATCH}) AS b_group_size, count(*) FILTER (NOT ({BATCH}) AND {U} < {keyed.below(0.1)}) AS s_group_size FROM lineitem GROUP BY l_suppkey")
def j5_three_way_sizes(spark, sf_dir):
    """Sizes of base, batch and sample by stratum, by one union and one aggregate instead of two outer joins."""
    base, batch = split(lineitem(spark, sf_dir))
    parts = [df.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit(t)) for t, df in (("a", base), ("b", batch), ("s", sampling.bernoulli(base, 0.1, SEED, KEYS)))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("l_suppkey").agg(*[F.coalesce(F.sum(F.when(F.col("t") == t, F.col("n"))), F.lit(0)).alias(f"{t}_group_size") for t in "abs"])


def _tables(spark, sf_dir):
    return {"lineitem": table(spark, sf_dir, "lineitem"), "part": table(spark, sf_dir, "part")}


@_query(f"SELECT round(ratio, 6) AS ratio FROM ({q.Q14.sql()})")
def j6_q14_exact(spark, sf_dir):
    return q.Q14.exact(_tables(spark, sf_dir)).select(F.round("ratio", 6).alias("ratio"))


@_query(f"SELECT round(sum, 2) AS sum FROM ({q.Q19.sql()})")
def j7_q19_exact(spark, sf_dir):
    return q.Q19.exact(_tables(spark, sf_dir)).select(F.round("sum", 2).alias("sum"))


@_query(f"SELECT round(sum, 2) AS sum FROM ({q.Q6.sql()})")
def a8_q6_exact(spark, sf_dir):
    return q.Q6.exact(_tables(spark, sf_dir)).select(F.round("sum", 2).alias("sum"))


# aggregates


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS avg_price, round(var_pop(l_discount), 8) AS var_discount, round(stddev_pop(l_quantity), 6) AS std_qty FROM lineitem GROUP BY 1, 2")
def a1_aggregates(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.round(F.var_pop("l_discount"), 8).alias("var_discount"), F.round(F.stddev_pop("l_quantity"), 6).alias("std_qty"))


_MONEY = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _moments_sql(where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS d, coalesce(var_pop({c}), 0) AS s2, coalesce(avg({c}), 0) AS avg, coalesce(sum({c}), 0) AS sum FROM lineitem WHERE {where}" for c in _MONEY)


#: Values are compared to eight digits or so. The last term takes means of cents, which end in a 5 now and then, off the edge
#: where the order of a sum would tell which way they are rounded.
_DIGITS = {"s2": "CASE WHEN s2 > 1000 THEN round(s2, 0) ELSE round(s2, 5) END", "avg": "round(avg + 1e-9, 6)", "sum": "round(sum, 2)", "e": "round(e + 1e-9, 6)"}
_ROUNDED = "column_name, d, " + ", ".join(f"{x} AS {c}" for c, x in _DIGITS.items())


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("column_name", "d", *[F.expr(x.replace("1e-9", "1e-9D")).alias(c) for c, x in _DIGITS.items()])


@_query("SELECT * FROM (SELECT 'l_tax' AS column_name, count(*) AS d, count(x) AS filled, round(var_pop(x), 8) AS s2, round(avg(x) + 1e-9, 6) AS avg, round(sum(x), 2) AS sum FROM (SELECT CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END AS x FROM lineitem))")
def n3_profile_with_nulls(spark, sf_dir):
    """The profile of a column with nulls after a batch; the same as of the whole table."""
    df, u = lineitem(spark, sf_dir).withColumn("l_tax", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax"))), keyed.unit("batch", KEYS)
    out = profile.refreshed(profile.profile(df.where(u >= keyed.below(0.2)), ["l_tax"]), df.where(u < keyed.below(0.2)))
    return out.select("column_name", "d", "filled", F.round("s2", 8).alias("s2"), F.round(F.col("avg") + F.lit(1e-9), 6).alias("avg"), F.round("sum", 2).alias("sum"))


@_query(f"SELECT {_ROUNDED} FROM (SELECT *, least(abs(avg) * 0.1, 100000) AS e FROM ({_moments_sql()}))")
def n2_profile(spark, sf_dir):
    """All columns' moments in one scan, and the errors allowed."""
    return _rounded(profile.profile(table(spark, sf_dir, "lineitem"), _MONEY))


@_query(f"SELECT {_ROUNDED} FROM (SELECT a.*, e FROM ({_moments_sql()}) a JOIN (SELECT column_name, least(abs(avg) * 0.1, 100000) AS e FROM ({_moments_sql('NOT (' + BATCH + ')')})) USING (column_name))")
def n3_profile_refresh(spark, sf_dir):
    """The profile after a batch, from the profile before it and the batch; the same as of the whole table."""
    df, u = lineitem(spark, sf_dir), keyed.unit("batch", KEYS)
    base, batch = df.where(u >= keyed.below(0.2)), df.where(u < keyed.below(0.2))
    return _rounded(profile.refreshed(profile.profile(base, _MONEY), batch, _MONEY))


_NEED = f"SELECT column_name, d, 3.8416 * s2 / (e * e) AS n0, s2 FROM (SELECT *, least(abs(avg) * 0.02, 100000) AS e FROM ({_moments_sql()}))"


@_query(f"SELECT column_name, round(n0, 6) AS n0, round(n0 * d / (n0 + d), 6) AS n, floor(n0 * d / (n0 + d))::BIGINT AS x FROM ({_NEED})")
def n1_required_size(spark, sf_dir):
    out = profile.required(profile.profile(table(spark, sf_dir, "lineitem"), _MONEY, 0.02))
    return out.select("column_name", F.round("n0", 6).alias("n0"), F.round("n", 6).alias("n"), "x")


@_query(f"SELECT column_name, need, need > 1000 AS deficient, round(most / d, 10) AS ratio, greatest(most - 1000, 0)::BIGINT * 10 AS m FROM (SELECT *, max(need) OVER () AS most FROM (SELECT column_name, d::DOUBLE AS d, floor(n0 * d / (n0 + d))::BIGINT AS need FROM ({_NEED})))")
def n4_status(spark, sf_dir):
    out = profile.status(profile.profile(table(spark, sf_dir, "lineitem"), _MONEY, 0.02), 1000)
    return out.withColumn("ratio", F.round("ratio", 10))


_PRICE = f"(SELECT count(*)::DOUBLE AS d, count(*) FILTER ({BATCH})::DOUBLE AS b, 3.8416 * var_pop(l_extendedprice) / power(abs(avg(l_extendedprice)) * 0.02, 2) AS n0 FROM lineitem)"
_STATES = f"(SELECT size::DOUBLE AS size, d, b, need, 10 * greatest(need - size, 0) AS m FROM (SELECT d, b, floor(n0 * d / (n0 + d)) AS need FROM {_PRICE}), (VALUES (100), (1000), (2000), (3000), (20000)) AS t(size))"
_ACTION = "CASE WHEN need <= size THEN 'update' WHEN m <= b THEN 'adaptive' ELSE 'resample' END"


def _decisions(spark, sf_dir) -> list[tuple[int, policy.Decision]]:
    """What the policy decides for samples of several sizes, from the table's profile and the size of its last batch."""
    df = lineitem(spark, sf_dir)
    need = profile.need(profile.profile(df, ["l_extendedprice"], 0.02))
    r = df.agg(F.count(F.lit(1)).alias("d"), F.count(F.when(keyed.unit("batch", KEYS) < keyed.below(0.2), 1)).alias("b")).first()
    return [(size, policy.decide(need, size, r["d"], r["b"], 0.02, policy.State(), policy.Flags(adaptive=True))) for size in (100, 1000, 2000, 3000, 20000)]


@_query(f"SELECT size::INT AS size, need::BIGINT AS need, {_ACTION} AS action, m::BIGINT AS m, round(CASE WHEN {_ACTION} = 'resample' THEN greatest(0.02, 1.01 * need / d) ELSE 0.02 END, 10) AS ratio FROM {_STATES}")
def n5_decision(spark, sf_dir):
    """The policy for samples of several sizes after a batch."""
    return spark.createDataFrame([(s, d.need, d.action.value, d.m, round(d.ratio, 10)) for s, d in _decisions(spark, sf_dir)], "size int, need bigint, action string, m bigint, ratio double")


@_query(f"SELECT size::INT AS size, round(CASE WHEN {_ACTION} = 'adaptive' AND m > 1 AND b > m AND d > b THEN 1 + ln((d - b) / (b - m)) / ln(m) ELSE 1 END, 8) AS attenuation FROM {_STATES}")
def n6_attenuation(spark, sf_dir):
    """How much harder the next extension is, after these decisions."""
    return spark.createDataFrame([(s, round(d.state.attenuation, 8)) for s, d in _decisions(spark, sf_dir)], "size int, attenuation double")


# samples

_K = ", ".join(KEYS_SQL)
_BOTTOM = lambda k, where="true": f"SELECT * FROM lineitem WHERE {where} ORDER BY {U}, {_K} LIMIT {k}"


@_query(f"SELECT l_returnflag, {SUMS}, round(sum(n0 / 2000.0), 6) AS weight FROM (SELECT *, (SELECT count(*) FROM lineitem) AS n0 FROM ({_BOTTOM(2000)})) GROUP BY l_returnflag")
def n15_uniform_resample(spark, sf_dir):
    """A new uniform sample of 2,000 rows."""
    df = files.spread(lineitem(spark, sf_dir).select(*KEYS, "l_extendedprice", "l_returnflag"))
    return _weighed(sampling.uniform(df, df.count(), 2000, SEED, KEYS), "l_returnflag")


def _weighed(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("key_sum"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.sum(1 / F.col(sampling.PROB)), 6).alias("weight"))


@_query(f"SELECT l_returnflag, {SUMS}, round(sum(n0 / 2000.0), 6) AS weight FROM (SELECT *, (SELECT count(*) FROM lineitem) AS n0 FROM ({_BOTTOM(2000)})) GROUP BY l_returnflag")
def n7_reservoir_uniform(spark, sf_dir):
    """A stored sample of the base updated by a batch; the same as a new sample of all rows."""
    base, batch = stored_split(spark, sf_dir)
    a, b = base.count(), batch.count()
    old = stored(spark, sf_dir, "uniform", lambda: sampling.uniform(base, a, 2000, SEED, KEYS))
    return _weighed(sampling.uniform_update(old, batch, 2000, a, b, SEED, KEYS), "l_returnflag")


_CAP = """SELECT coalesce(arg_max(s + CASE WHEN g > le THEN floor((t - low) / (g - le)) ELSE 0 END, s) FILTER (low <= t), floor(any_value(t) / any_value(g)))::BIGINT AS cap
FROM (SELECT s, le, g, t, r + s * (g - le) AS low FROM (SELECT s, sum(n) OVER (ORDER BY s) AS le, sum(n * s) OVER (ORDER BY s) AS r, sum(n) OVER () AS g, {target} AS t FROM (SELECT s, count(*) AS n FROM ({sizes}) GROUP BY s)))"""
_SIZES = "SELECT l_suppkey AS k, count(*) AS s FROM lineitem GROUP BY 1"


@_query(" UNION ALL ".join(f"SELECT {t} AS target, cap FROM ({_CAP.format(target=t, sizes=_SIZES)})" for t in (50, 500, 2000, 6000)))
def n12_cap_search(spark, sf_dir):
    sizes = sampling.group_sizes(lineitem(spark, sf_dir), "l_suppkey")
    out = [sampling.cap_for(sizes, t).select(F.lit(t).alias("target"), "cap") for t in (50, 500, 2000, 6000)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _strat_sql(cap: str, where: str = "true") -> str:
    return f"SELECT *, least(s, c)::DOUBLE / s AS p FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {U}, {_K}) AS r, count(*) OVER (PARTITION BY l_suppkey) AS s, ({cap}) AS c FROM lineitem WHERE {where}) WHERE r <= c"


_CAP2000 = f"SELECT greatest(cap, 10) FROM ({_CAP.format(target=2000, sizes=_SIZES)})"
_WEIGHED = SUMS + ", round(sum(1 / p), 6) AS weight"


@_query(f"SELECT l_suppkey, {_WEIGHED} FROM ({_strat_sql(_CAP2000)}) GROUP BY l_suppkey")
def n16_stratified_resample(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    sizes = sampling.group_sizes(df, "l_suppkey")
    return _weighed(sampling.stratified(df, "l_suppkey", sizes, sampling.cap_value(sizes, 2000), SEED, KEYS), "l_suppkey")


@_query(f"SELECT l_suppkey, {_WEIGHED} FROM ({_strat_sql('20')}) GROUP BY l_suppkey")
def n8_reservoir_stratified(spark, sf_dir):
    """A stored stratified sample of the base updated by a batch by the same cap; the same as a new one of all rows."""
    batch, old, sizes = _stratified_state(spark, sf_dir)
    return _weighed(sampling.stratified_update(old, batch, "l_suppkey", sizes, 20, SEED, KEYS), "l_suppkey")


def _stratified_state(spark, sf_dir):
    """The stored batch, the stored sample of the base, and the sizes of strata with the batch."""
    base, batch = stored_split(spark, sf_dir)
    a = stored(spark, sf_dir, "sizes", lambda: sampling.group_sizes(base, "l_suppkey"))
    old = stored(spark, sf_dir, "stratified", lambda: sampling.stratified(base, "l_suppkey", a, 20, SEED, KEYS))
    return batch, old, sampling.merged_sizes(a, sampling.group_sizes(batch, "l_suppkey"), "l_suppkey")


@_query(f"SELECT l_returnflag, {SUMS}, round(sum(w), 6) AS weight FROM (SELECT *, (SELECT count(*) FROM lineitem WHERE NOT ({BATCH})) / 1200.0 AS w FROM ({_BOTTOM(1200, 'NOT (' + BATCH + ')')}) UNION ALL SELECT *, (SELECT count(*) FROM lineitem WHERE {BATCH}) / 800.0 AS w FROM ({_BOTTOM(800, BATCH)})) GROUP BY l_returnflag")
def n9_adaptive_uniform(spark, sf_dir):
    """1,200 rows of a stored sample of the base and 800 of a batch, each part with its own weight."""
    base, batch = stored_split(spark, sf_dir)
    a, b = base.count(), batch.count()
    old = stored(spark, sf_dir, "uniform1500", lambda: sampling.uniform(base, a, 1500, SEED, KEYS))
    return _weighed(sampling.uniform_adaptive(old, batch, 2000, 1200, a, b, SEED, KEYS), "l_returnflag")


_OLD20 = f"SELECT * EXCLUDE (r, s, c, p) FROM ({_strat_sql('20', 'NOT (' + BATCH + ')')})"


def _capped_sql(rows: str, target: int) -> str:
    """Of each stratum of rows the first by the cap that gives about target rows, ten at least."""
    cap = f"SELECT greatest(cap, 10) FROM ({_CAP.format(target=target, sizes=f'SELECT l_suppkey AS k, count(*) AS s FROM ({rows}) GROUP BY 1')})"
    return f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {U}, {_K}) AS r FROM ({rows})) WHERE r <= ({cap})"


@_query(f"""WITH rows_ AS (SELECT *, 0 AS o FROM ({_capped_sql(_OLD20, 1200)}) UNION ALL SELECT *, 1 AS o FROM ({_capped_sql('SELECT * FROM lineitem WHERE ' + BATCH, 800)})),
kept AS (SELECT l_suppkey AS k, o, count(*) AS kept FROM rows_ GROUP BY 1, 2), sizes AS (SELECT l_suppkey AS k, ({BATCH})::INT AS o, count(*) AS s FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, {_WEIGHED} FROM (SELECT rows_.*, kept::DOUBLE / sizes.s AS p FROM rows_ JOIN kept ON l_suppkey = kept.k AND rows_.o = kept.o JOIN sizes ON l_suppkey = sizes.k AND rows_.o = sizes.o) GROUP BY l_suppkey""")
def n10_adaptive_stratified(spark, sf_dir):
    """A stored stratified sample of the base extended by a batch; what each of them keeps of a stratum has its own weight."""
    batch, old, sizes = _stratified_state(spark, sf_dir)
    return _weighed(sampling.stratified_adaptive(old, batch, "l_suppkey", sizes, 1200, 2000, SEED, KEYS), "l_suppkey")


_LOW = "greatest(need - m, least(10, size))"


@_query(f"SELECT size::INT AS size, (CASE WHEN size <= {_LOW} THEN {_LOW} ELSE {_LOW} + ('0x' || substr(md5(size::INT || '/x'), 1, 8))::BIGINT % (size - {_LOW} + 1)::BIGINT END)::BIGINT AS x FROM {_STATES}")
def n11_find_x(spark, sf_dir):
    """The rows that an extension of samples of several sizes keeps, for what the table's profile needs: even in the range, fixed by the seed."""
    return spark.createDataFrame([(s, sampling.find_x(d.need, s, d.m, s)) for s, d in _decisions(spark, sf_dir)], "size int, x bigint")


@_query(f"SELECT l_returnflag, {SUMS}, round(sum(CAST(10 AS DOUBLE)), 6) AS weight FROM lineitem WHERE {U} < {keyed.below(0.1)} GROUP BY l_returnflag")
def n13_incremental_uniform(spark, sf_dir):
    """A sample at a ratio and the batch's rows at the same ratio."""
    base, batch = split(lineitem(spark, sf_dir))
    return _weighed(sampling.uniform_incremental(sampling.uniform_ratio(base, 0.1, SEED, KEYS), batch, 0.1, SEED, KEYS), "l_returnflag")


@_query(f"SELECT l_suppkey, {_WEIGHED} FROM (SELECT * FROM ({_strat_sql('20', 'NOT (' + BATCH + ')')}) UNION ALL SELECT * FROM ({_strat_sql('10', BATCH)})) GROUP BY l_suppkey")
def n14_incremental_stratified(spark, sf_dir):
    """A stored stratified sample and one of the batch alone, by the least cap."""
    batch, old, _ = _stratified_state(spark, sf_dir)
    return _weighed(sampling.stratified_incremental(old, batch, "l_suppkey", 0, SEED, KEYS), "l_suppkey")


@_query(f"SELECT l_suppkey, {SUMS}, round(sum(1 / p), 6) AS weight FROM (SELECT *, least(1.0, greatest(20::DOUBLE / s, {sizing.guard_sql('s')})) AS p FROM lineitem JOIN (SELECT l_suppkey AS k, count(*) AS s FROM lineitem GROUP BY 1) ON l_suppkey = k) WHERE {U} < p * {keyed.RANGE} GROUP BY l_suppkey")
def n17_guarded_bernoulli(spark, sf_dir):
    """Rows by chance, cap / size or the guard that keeps about ten of each stratum."""
    df = lineitem(spark, sf_dir)
    return _weighed(sampling.stratified_bernoulli(df, "l_suppkey", sampling.group_sizes(df, "l_suppkey"), 20, SEED, KEYS), "l_suppkey")


@_query("SELECT l_suppkey, count(*) AS group_size FROM lineitem GROUP BY l_suppkey")
def n18_group_sizes(spark, sf_dir):
    """Sizes of strata kept over batches."""
    base, batch = split(lineitem(spark, sf_dir))
    return sampling.merged_sizes(sampling.group_sizes(base, "l_suppkey"), sampling.group_sizes(batch, "l_suppkey"), "l_suppkey")


@_query(f"SELECT floor({PART_U} * 100 / {keyed.RANGE})::DOUBLE AS part, count(*) AS n FROM lineitem WHERE {U} < {keyed.below(0.1)} GROUP BY 1")
def n19_parts(spark, sf_dir):
    """Subsample ids of a sample's rows."""
    return sampling.uniform_ratio(lineitem(spark, sf_dir), 0.1, SEED, KEYS).groupBy(F.col(sampling.PART).alias("part")).agg(F.count(F.lit(1)).alias("n"))


_LC = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


@_query(f"SELECT min(m)::INT AS m FROM (SELECT m, sum(exp({_LC.format(n='d', k='x')} + {_LC.format(n='m', k='(110.0 - x)')} - {_LC.format(n='(d + m)', k='110.0')})) AS chance FROM (SELECT count(*)::DOUBLE AS d FROM lineitem), (SELECT unnest(range(10, (SELECT count(*) // 3 FROM lineitem)))::DOUBLE AS m), (SELECT unnest(range(101))::DOUBLE AS x) WHERE 110 - x <= m GROUP BY m) WHERE chance >= 0.75")
def n22_break_even(spark, sf_dir):
    """The least number of new rows for which an extension of the table's sample very likely needs no old row that isn't there."""
    return spark.createDataFrame([(policy.break_even(table(spark, sf_dir, "lineitem").count(), 100, 110),)], "m int")


# the catalog


def _sampled(spark, sf_dir, name: str, keys: list[str]) -> engine.SampledTable:
    df = table(spark, sf_dir, name)
    t = engine.SampledTable(spark, scratch(spark, "catalog"), name, engine.Settings(keys, columns=["l_extendedprice", "o_totalprice"]))
    t.receive(df, 0)
    return t


_FIFTH = f"count(*) FILTER ({keyed.unit_sql('half', ['l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey'])} < {keyed.below(0.5)})"


@_query("SELECT 'default' AS originalschemaname, 'lineitem' AS originaltablename, 'default_samples' AS sampleschemaaname, x.* , count(*) AS originaltablesize FROM lineitem, (VALUES ('vs_lineitem_uniform_all_0', 'uniform', 0.1::DOUBLE, NULL::VARCHAR), ('vs_lineitem_uniform_all_2', 'uniform', 0.2, NULL)) AS x(sampletablename, sampletype, samplingratio, columnnames) GROUP BY ALL")
def c8_list_samples(spark, sf_dir):
    """The samples that are left after statements on a stored table, as the catalog lists them."""
    t = _sampled(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    for x in ("CREATE 10% UNIFORM SAMPLE OF lineitem", "CREATE 5% STRATIFIED SAMPLE OF lineitem ON l_returnflag", "CREATE 20% UNIFORM SAMPLE OF lineitem", "DROP 5% STRATIFIED SAMPLES OF lineitem"):
        t.sql(x)
    return t.listed().drop("samplesize")


@_query(f"SELECT 'vs_lineitem_uniform_all_0' AS tablename, round(0.1 * {_FIFTH})::BIGINT AS samplesize, count(*) AS originaltablesize FROM lineitem UNION ALL SELECT 'vs_orders_uniform_all_0', round(0.2 * count(*))::BIGINT, count(*) FROM orders UNION ALL SELECT 'vs_orders_uniform_all_1', round(0.1 * count(*))::BIGINT, count(*) FROM orders")
def c11_shared_catalog(spark, sf_dir):
    """A catalog that two tables share: samples added, one dropped, one whose table grew by a batch; sizes replaced by key."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    df, u, at = table(spark, sf_dir, "lineitem"), keyed.unit("half", keys), scratch(spark, "shared")
    t = engine.SampledTable(spark, scratch(spark, "catalog"), "lineitem", engine.Settings(keys, relative=10.0, columns=["l_extendedprice"]))
    t.receive(df.where(u < keyed.below(0.5)), 0)
    t.create("uniform", 0.1)
    t.create("stratified", 0.05, "l_returnflag")
    o = _sampled(spark, sf_dir, "orders", ["o_orderkey"])
    o.create("uniform", 0.2)
    o.create("uniform", 0.1)
    for x in (t, o):
        x.publish(at)
    t.sql("DROP STRATIFIED SAMPLES OF lineitem")
    t.receive(df.where(u >= keyed.below(0.5)), 1)
    return t.publish(at)[1].drop("schemaname")


@_query("SELECT 'vs_lineitem_uniform_all_0' AS tablename, 'uniform' AS sampletype, count(*) AS originaltablesize FROM lineitem UNION ALL SELECT 'vs_lineitem_stratified_l_returnflag_1', 'stratified', count(*) FROM lineitem")
def c13_refresh_base_sizes(spark, sf_dir):
    """Base sizes and ratios follow the table; names don't, and DROP by the declared ratio still finds its sample."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    df, u = table(spark, sf_dir, "lineitem"), keyed.unit("half", keys)
    t = engine.SampledTable(spark, scratch(spark, "catalog"), "lineitem", engine.Settings(keys, relative=10.0, columns=["l_extendedprice"]))
    t.receive(df.where(u < keyed.below(0.5)), 0)
    for x in ("CREATE 10% UNIFORM SAMPLE OF lineitem", "CREATE 10% STRATIFIED SAMPLE OF lineitem ON l_returnflag", "CREATE 5% UNIFORM SAMPLE OF lineitem"):
        t.sql(x)
    t.receive(df.where(u >= keyed.below(0.5)), 1)
    if t.sql("DROP 5% UNIFORM SAMPLES OF lineitem") != 1:
        raise AssertionError("the sample declared at 5 % was not found after a batch")
    return t.listed().select(F.col("sampletablename").alias("tablename"), "sampletype", "originaltablesize")


@_query(f"SELECT 'uniform' AS kind, count(*) AS n FROM lineitem WHERE {U} < {keyed.below(0.05)} UNION ALL SELECT 'stratified', count(*) FROM lineitem JOIN (SELECT l_returnflag AS k, count(*) AS s FROM lineitem GROUP BY 1) ON l_returnflag = k, (SELECT greatest(cap, 10) AS cap FROM ({_CAP.format(target='round(0.1 * (SELECT count(*) FROM lineitem))', sizes='SELECT l_returnflag AS k, count(*) AS s FROM lineitem GROUP BY 1')})) WHERE {U} < least(1.0, greatest(cap::DOUBLE / s, {sizing.guard_sql('s')})) * {keyed.RANGE}")
def c14_sample_statements(spark, sf_dir):
    """CREATE and DROP statements on samples of a stored table; what is left and how many rows it has."""
    t = engine.SampledTable(spark, scratch(spark, "ddl"), "lineitem", engine.Settings(KEYS, columns=["l_extendedprice"], resample="bernoulli"))
    t.receive(lineitem(spark, sf_dir), 0)
    t.sql("CREATE 5% UNIFORM SAMPLE OF lineitem")
    t.sql("CREATE 20% UNIFORM SAMPLE OF lineitem")
    t.sql("CREATE 10% STRATIFIED SAMPLE OF lineitem ON l_returnflag")
    t.sql("DROP 20% UNIFORM SAMPLES OF lineitem")
    return spark.createDataFrame([(s.kind, s.rows) for s in t.samples()], "kind string, n bigint")


# approximate answers

_S = f"(SELECT *, 0.1::DOUBLE AS p FROM lineitem WHERE {U} < {keyed.below(0.1)})"


def _sample(spark, sf_dir):
    return sampling.uniform_ratio(lineitem(spark, sf_dir), 0.1, SEED, KEYS)


def aqp_sql(query: q.Query, sample: str = _S, z: float = 1.96) -> str:
    """The estimate of sum, count or avg from a uniform sample, in SQL."""
    y = "1.0" if query.agg == "count" else f"({query.value})"
    keys = ", ".join(query.group_by)
    k = f"{keys}, " if keys else ""
    inner = f"SELECT {k}sum({y}) AS sy, sum({y} * {y}) AS yy, count(*)::DOUBLE AS c, any_value(p) AS p, (SELECT count(*)::DOUBLE FROM {sample}) AS n FROM {sample} WHERE {query.where or 'true'}" + (f" GROUP BY {keys}" if keys else "")
    v = "(n / p) * (n / p) * (1 - p) / n / (n - 1)"
    if query.agg == "avg":
        return f"SELECT {k}round(sy / c, 4) AS avg, round({z} * sqrt({v} * (yy - sy * sy / c)) / (c / p), 4) AS avg_err FROM ({inner})"
    return f"SELECT {k}round(sy / p, 2) AS {query.agg}, round({z} * sqrt({v} * (yy - sy * sy / n) * n / n), 2) AS {query.agg}_err FROM ({inner})"


def _round_answer(df: DataFrame, query: q.Query) -> DataFrame:
    d = 4 if query.agg in ("avg", "ratio") else 2
    return df.select(*query.group_by, F.round(query.name, d).alias(query.name), F.round(f"{query.name}_err", d).alias(f"{query.name}_err"))


_AQP = {
    "q1_aqp_sum": q.Query("lineitem", "sum", "l_extendedprice", "l_quantity > 4", where_columns=("l_quantity",)),
    "q2_aqp_count": q.Query("lineitem", "count", "l_extendedprice", "l_quantity < 10", where_columns=("l_quantity",)),
    "q3_aqp_avg": q.Query("lineitem", "avg", "l_extendedprice", "l_quantity >= 15", where_columns=("l_quantity",)),
    "q4_aqp_grouped": q.Query("lineitem", "avg", "l_extendedprice", group_by=("l_returnflag",)),
    "q4_aqp_grouped_sum": q.Query("lineitem", "sum", "l_quantity", "l_discount > 0.03", ("l_returnflag", "l_linestatus"), ("l_discount",)),
    "q5_aqp_q6": q.Q6,
}
for _name, _q in _AQP.items():
    _QUERIES[_name] = lambda spark, sf_dir, x=_q: _round_answer(aqp.estimate(x, _sample(spark, sf_dir)), x)
    _SQL[_name] = aqp_sql(_q)


#: From a joined uniform sample: n rows in all and at chance p, sums over those that pass. Its variance as in aqp_sql.
_JOINED = f"(SELECT y, x, p, (SELECT count(*)::DOUBLE FROM {_S}) AS n FROM (SELECT {{y}} AS y, {{x}} AS x, p FROM {_S} JOIN part ON l_partkey = p_partkey WHERE {{where}}))"
_COV = "(n / p) * (n / p) * (1 - p) / n / (n - 1) * ({ab} - {a} * {b} / n)"


@_query(f"SELECT round(sy / p, 2) AS sum, round(1.96 * sqrt({_COV.format(ab='yy', a='sy', b='sy')}), 2) AS sum_err FROM (SELECT sum(y) AS sy, sum(y * y) AS yy, any_value(p) AS p, any_value(n) AS n FROM {_JOINED.format(y=q.REVENUE, x='1.0', where=q.Q19.where)})")
def q5_aqp_q19(spark, sf_dir):
    """Only the fact is sampled; the dimension is whole."""
    return _round_answer(aqp.estimate(q.Q19, _sample(spark, sf_dir), _tables(spark, sf_dir)), q.Q19)


_R = "(sy / sx)"


@_query(f"SELECT round(100 * sy / sx, 6) AS ratio, round(1.96 * 100 * sqrt({_COV.format(ab='yy', a='sy', b='sy')} - 2 * {_R} * {_COV.format(ab='xy', a='sx', b='sy')} + {_R} * {_R} * {_COV.format(ab='xx', a='sx', b='sx')}) / (sx / p), 6) AS ratio_err FROM (SELECT sum(y) AS sy, sum(x) AS sx, sum(y * y) AS yy, sum(x * x) AS xx, sum(x * y) AS xy, any_value(p) AS p, any_value(n) AS n FROM {_JOINED.format(y=q.Q14.value, x=q.REVENUE, where=q.Q14.where)})")
def q5_aqp_q14(spark, sf_dir):
    """A ratio of two sums, whose error follows from the residuals."""
    return aqp.estimate(q.Q14, _sample(spark, sf_dir), _tables(spark, sf_dir)).select(F.round("ratio", 6).alias("ratio"), F.round("ratio_err", 6).alias("ratio_err"))


def _strata_sql(sample: str, value: str, where: str = "true", keys: str = "l_returnflag") -> str:
    """Sum and error of a value by keys from a sample with strata of l_suppkey and chance p."""
    inner = f"SELECT {keys}, p, sum({value}) AS sy, sum({value} * {value}) AS yy, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY l_suppkey, p)::DOUBLE AS n FROM ({sample})) WHERE {where} GROUP BY {keys}, l_suppkey, p"
    return f"SELECT {keys}, round(sum(sy / p), 2) AS sum, round(1.96 * sqrt(sum(CASE WHEN p >= 1 THEN 0 ELSE {_COV.format(ab='yy', a='sy', b='sy')} END)), 2) AS sum_err FROM ({inner}) GROUP BY {keys}"


@_query(_strata_sql(_strat_sql(_CAP2000), "l_extendedprice"))
def q6_aqp_stratified(spark, sf_dir):
    """From a stratified sample; its strata are not the query's groups."""
    df = lineitem(spark, sf_dir)
    sizes = sampling.group_sizes(df, "l_suppkey")
    s = sampling.stratified(df, "l_suppkey", sizes, sampling.cap_value(sizes, 2000), SEED, KEYS)
    x = q.Query("lineitem", "sum", "l_extendedprice", group_by=("l_returnflag",))
    return _round_answer(aqp.estimate(x, s, stratum="l_suppkey"), x)


_HALF = "SELECT l_suppkey AS k, count(*) AS s FROM lineitem GROUP BY 1"
_TENTH = "(SELECT greatest(1, round(0.1 * count(*))) FROM lineitem)"


@_query(f"SELECT 'uniform' AS from_sample, l_returnflag::VARCHAR AS g, round(sum(l_extendedprice / p), 0) AS sum FROM (SELECT *, {_TENTH}::DOUBLE / (SELECT count(*) FROM lineitem) AS p FROM (SELECT *, row_number() OVER (ORDER BY {U}, {_K}) AS r FROM lineitem) WHERE r <= {_TENTH}) GROUP BY l_returnflag "
        f"UNION ALL SELECT 'stratified', l_suppkey::VARCHAR, round(sum(l_extendedprice / p), 0) FROM ({_strat_sql('SELECT greatest(cap, 10) FROM (' + _CAP.format(target=_TENTH, sizes=_HALF) + ')')}) WHERE l_suppkey < 20 GROUP BY l_suppkey "
        f"UNION ALL SELECT 'none', o_orderpriority, round(sum(o_totalprice), 0) FROM orders GROUP BY o_orderpriority")
def q6_stored_samples(spark, sf_dir):
    """Queries on a stored table that the engine answers from the sample it chooses: by the stratified one's column, by another, and
    on a table without samples, exactly."""
    t = engine.SampledTable(spark, scratch(spark, "stored"), "lineitem", engine.Settings(KEYS, columns=["l_extendedprice"], seed=SEED))
    t.receive(lineitem(spark, sf_dir).select(*KEYS, "l_extendedprice", "l_returnflag"), 0)
    t.sql("CREATE 10% UNIFORM SAMPLE OF lineitem")
    t.sql("CREATE 10% STRATIFIED SAMPLE OF lineitem ON l_suppkey")
    by = lambda name, table_, value, g, where=None: (name, g, q.Query(table_, "sum", value, where, (g,), (g,)))
    out = None
    for name, g, x in (by("uniform", "lineitem", "l_extendedprice", "l_returnflag"), by("stratified", "lineitem", "l_extendedprice", "l_suppkey", "l_suppkey < 20"), by("none", "orders", "o_totalprice", "o_orderpriority")):
        chosen = aqp.choose(x, t.registered())
        if (chosen.kind if chosen else "none") != name:
            raise AssertionError(f"{chosen} was chosen for {name}")
        one = t.approximate(x, {"orders": table(spark, sf_dir, "orders")}).select(F.lit(name).alias("from_sample"), F.col(g).cast("string").alias("g"), F.round("sum", 0).alias("sum"))
        out = one if out is None else out.unionByName(one)
    return out


@_query(f"SELECT l_returnflag, round(sum(y), 2) AS sum, round(1.96 * 10 * stddev_samp(y), 2) AS sum_err FROM (SELECT l_returnflag, part, coalesce(y, 0) AS y FROM (SELECT DISTINCT l_returnflag FROM {_S}) CROSS JOIN (SELECT unnest(range(100)) AS part) LEFT JOIN (SELECT l_returnflag, floor({PART_U} * 100 / {keyed.RANGE})::BIGINT AS part, sum(l_extendedprice / p) AS y FROM {_S} GROUP BY 1, 2) USING (l_returnflag, part)) GROUP BY l_returnflag")
def q1_aqp_subsampled(spark, sf_dir):
    """Errors from the spread of a hundred parts of the sample."""
    x = q.Query("lineitem", "sum", "l_extendedprice", group_by=("l_returnflag",))
    return _round_answer(aqp.estimate_by_parts(x, _sample(spark, sf_dir)), x)


def _pool_sql(query: q.Query, i: int) -> str:
    key = f"{query.group_by[0]}::BIGINT" if query.group_by else "-1::BIGINT"
    return f"SELECT {i} AS q, {key} AS g, round({query.agg}({query.value}), 4)::DOUBLE AS v FROM lineitem" + (f" WHERE {query.where}" if query.where else "") + (f" GROUP BY {query.group_by[0]}" if query.group_by else "")


@_query(" UNION ALL ".join(_pool_sql(x, i) for i, x in enumerate(q.pool() + q.equality_pool())))
def q7_exact_pool(spark, sf_dir):
    """The pool's 60 queries and the 16 on equal counts. Queries that group alike are one scan: a conditional aggregate
    for each, then one row for each query and group."""
    df, queries, out = table(spark, sf_dir, "lineitem"), q.pool() + q.equality_pool(), []
    for keys in sorted({x.group_by for x in queries}):
        mine = [(i, x) for i, x in enumerate(queries) if x.group_by == keys]
        value = lambda x: F.when(F.expr(x.where), F.expr(x.value)) if x.where else F.expr(x.value)
        row = df.groupBy(*keys).agg(*[F.round({"avg": F.avg, "sum": F.sum, "count": F.count}[x.agg](value(x)), 4).cast("double").alias(f"v{i}") for i, x in mine])
        g = F.col(keys[0]).cast("bigint") if keys else F.lit(-1).cast("bigint")
        out.append(row.select(F.inline(F.array(*[F.struct(F.lit(i).alias("q"), g.alias("g"), F.col(f"v{i}").alias("v")) for i, _ in mine]))))
    return out[0].unionByName(out[1]).where("g = -1 OR v IS NOT NULL")


@_query(f"SELECT e.l_returnflag, round(exact, 2) AS exact, round(approx, 2) AS approx, n AS sample_rows, p AS least_vprob, p AS most_vprob FROM (SELECT l_returnflag, sum(l_extendedprice) AS exact FROM lineitem GROUP BY 1) e JOIN (SELECT l_returnflag, sum(l_extendedprice / p) AS approx, count(*) AS n, any_value(p) AS p FROM {_S} GROUP BY 1) USING (l_returnflag)")
def q8_audit(spark, sf_dir):
    x = q.Query("lineitem", "sum", "l_extendedprice", group_by=("l_returnflag",))
    out = aqp.audit(x, _sample(spark, sf_dir), {"lineitem": lineitem(spark, sf_dir)})
    return out.select("l_returnflag", F.round("exact", 2).alias("exact"), F.round("approx", 2).alias("approx"), "sample_rows", "least_vprob", "most_vprob")


_BOTTOMED = lambda target: f"(SELECT * EXCLUDE (r), {target}::DOUBLE / (SELECT count(*) FROM lineitem) AS p FROM (SELECT *, row_number() OVER (ORDER BY {U}, {_K}) AS r FROM lineitem) WHERE r <= {target})"
#: Large numbers to whole ones: the order in which doubles are summed shows in their last digits.
_COARSE = "CASE WHEN abs({0}) > 100000 THEN round({0}, 0) ELSE round({0}, 2) END"
#: A query of the pool for each aggregate, value, and set of columns that it filters and groups by.
_SHAPES = list({(x.agg, x.value, x.where_columns, x.group_by): x for x in reversed(q.pool())}.values())


def _texts_sql() -> str:
    each = " UNION ALL ".join(f"SELECT {i} AS q, {x.group_by[0] if x.group_by else -1}::BIGINT AS g, {_COARSE.format(x.agg)} AS v, {_COARSE.format(x.agg + '_err')} AS err FROM ({aqp_sql(x, 's')})" for i, x in enumerate(_SHAPES))
    return f"WITH s AS MATERIALIZED {_BOTTOMED(_TENTH)} {each}"


@_query(_texts_sql())
def q9_sql_texts(spark, sf_dir):
    """SQL texts of every shape in the pool, sent to a stored table as they are and answered from its sample, with errors."""
    t = engine.SampledTable(spark, scratch(spark, "texts"), "lineitem", engine.Settings(KEYS, columns=["l_extendedprice"], seed=SEED))
    t.receive(lineitem(spark, sf_dir).select(*KEYS, "l_extendedprice", "l_quantity"), 0)
    t.sql("CREATE 10% UNIFORM SAMPLE OF lineitem")
    out = None
    for i, x in enumerate(_SHAPES):
        g = F.col(x.group_by[0]).cast("bigint") if x.group_by else F.lit(-1).cast("bigint")
        one = _round_answer(t.sql(x.sql()), x).select(F.lit(i).alias("q"), g.alias("g"), F.expr(_COARSE.format(x.agg)).alias("v"), F.expr(_COARSE.format(f"{x.agg}_err")).alias("err"))
        out = one if out is None else out.unionByName(one)
    return out


_UP = lambda ratio: f"(SELECT greatest(1, round({ratio} * count(*))) FROM lineitem)"
_HALF_WHERE = "l_suppkey % 2 = 0"


def _choice_sql() -> str:
    uniform = lambda r: f"SELECT 'uniform' AS kind, count(*) AS rows, 1.96 * sqrt(sum(1 / p) * sum(1 / p) * (1 - count(*) / sum(1 / p)) / count(*) * share * var_samp(l_extendedprice)) / (sum(1 / p) * share * abs(avg(l_extendedprice))) AS e FROM {_BOTTOMED(_UP(r))}, (SELECT count(*) FILTER ({_HALF_WHERE}) / count(*)::DOUBLE AS share FROM {_BOTTOMED(_UP(0.01))}) GROUP BY share"
    strata = f"SELECT l_suppkey, count(*)::DOUBLE AS n, sum(1 / p) AS s, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM ({_strat_sql('SELECT greatest(cap, 10) FROM (' + _CAP.format(target=_UP(0.02), sizes=_SIZES) + ')')}) GROUP BY l_suppkey"
    stratified = f"SELECT 'stratified', sum(n)::BIGINT, 1.96 * sqrt(sum(CASE WHEN n >= s THEN 0 ELSE s * s * (1 - n / s) / n * v END) FILTER ({_HALF_WHERE})) / abs(sum(s * m) FILTER ({_HALF_WHERE})) FROM ({strata})"
    return f"SELECT kind, rows::BIGINT AS rows, round(e, 6) AS predicted, row_number() OVER (ORDER BY e > 0.02, CASE WHEN e > 0.02 THEN e ELSE rows END) = 1 AS chosen FROM ({uniform(0.2)} UNION ALL {uniform(0.01)} UNION ALL {stratified})"


@_query(_choice_sql())
def q6_choice_by_error(spark, sf_dir):
    """The errors that a query is expected to have from each of three samples, and which one the engine takes for a bound of 2 %. By its
    columns alone it would take the stratified one, which is worse for it."""
    t = engine.SampledTable(spark, scratch(spark, "choice"), "lineitem", engine.Settings(KEYS, columns=["l_extendedprice"], seed=SEED))
    t.receive(lineitem(spark, sf_dir).select(*KEYS, "l_extendedprice"), 0)
    for x in ("20% UNIFORM SAMPLE OF lineitem", "2% STRATIFIED SAMPLE OF lineitem ON l_suppkey", "1% UNIFORM SAMPLE OF lineitem"):
        t.sql(f"CREATE {x}")
    x = q.Query("lineitem", "avg", "l_extendedprice", _HALF_WHERE, where_columns=("l_suppkey",), error_bound=0.02)
    samples = t.registered(moments=True)
    taken, share = aqp.by_error(x, samples), aqp.share_left(x, samples)
    if aqp.choose(x, samples).kind != "stratified":
        raise AssertionError("the rule of columns takes another sample")
    out = None
    for s in samples:
        one = aqp.predicted_error(x, s, share).select(F.lit(s.kind).alias("kind"), F.lit(s.rows).cast("bigint").alias("rows"), F.round("error", 6).alias("predicted"), F.lit(s is taken).alias("chosen"))
        out = one if out is None else out.unionByName(one)
    return out


_KEY_U = lambda c: keyed.unit_sql(f"{SEED}/universe", [c])


@_query(f"SELECT o_orderpriority, round(sum(y) / 0.1, 0) AS sum, round(1.96 * sqrt(0.9 * sum(y * y)) / 0.1, 0) AS sum_err FROM (SELECT o_orderpriority, l_orderkey, sum({q.REVENUE}) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 1000 AND {_KEY_U('l_orderkey')} < {keyed.below(0.1)} GROUP BY 1, 2) GROUP BY o_orderpriority")
def q5_universe_join(spark, sf_dir):
    """A sum over the join of two facts, from samples of both by the hash of the key that joins them, one of them of twice the ratio."""
    items = engine.SampledTable(spark, scratch(spark, "items"), "lineitem", engine.Settings(KEYS, columns=["l_extendedprice"], seed=SEED))
    df, u = lineitem(spark, sf_dir).select(*KEYS, "l_extendedprice", "l_discount"), keyed.unit("batch", KEYS)
    items.receive(df.where(u >= keyed.below(0.2)), 0)
    items.sql("CREATE 20% UNIVERSE SAMPLE OF lineitem ON l_orderkey")
    items.receive(df.where(u < keyed.below(0.2)), 1)
    orders = engine.SampledTable(spark, scratch(spark, "orders"), "orders", engine.Settings(["o_orderkey"], columns=["o_totalprice"], seed=SEED))
    orders.receive(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), 0)
    orders.sql("CREATE 10% UNIVERSE SAMPLE OF orders ON o_orderkey")
    x = q.Query("lineitem", "sum", q.REVENUE, "o_totalprice > 1000", ("o_orderpriority",), ("o_totalprice",), (q.Join("orders", "l_orderkey", "o_orderkey"),))
    return items.joined(x, [orders]).select("o_orderpriority", F.round("sum", 0).alias("sum"), F.round("sum_err", 0).alias("sum_err"))


@_query(f"SELECT 'uniform' AS kind, {_TENTH}::BIGINT AS n UNION ALL SELECT 'stratified', sum(least(s, greatest(cap, 10)))::BIGINT FROM (SELECT l_returnflag AS k, count(*) AS s FROM lineitem GROUP BY 1), ({_CAP.format(target=_TENTH, sizes='SELECT l_returnflag AS k, count(*) AS s FROM lineitem GROUP BY 1')}) UNION ALL SELECT 'universe', count(*) FROM lineitem WHERE {_KEY_U('l_orderkey')} < {keyed.below(0.1)}")
def c16_create_kinds(spark, sf_dir):
    """CREATE without a kind makes a uniform and a stratified sample; a universe sample is named."""
    t = engine.SampledTable(spark, scratch(spark, "kinds"), "lineitem", engine.Settings(KEYS, columns=["l_extendedprice"], seed=SEED))
    t.receive(lineitem(spark, sf_dir).select(*KEYS, "l_extendedprice", "l_returnflag"), 0)
    t.sql("CREATE 10% SAMPLE OF lineitem", default_column="l_returnflag")
    t.sql("CREATE 10% UNIVERSE SAMPLE OF lineitem ON l_orderkey")
    return spark.createDataFrame([(x.kind, x.rows) for x in t.samples()], "kind string, n bigint")


# evaluation


def _repeats(spark, sf_dir, seeds=range(10)):
    """Answers of ten samples, by the size's average, with the exact one; the table is scanned once."""
    df, price, aggs = lineitem(spark, sf_dir), F.col("l_extendedprice"), [F.avg("l_extendedprice").alias("exact")]
    for s in seeds:
        drawn = F.when(keyed.unit(s, KEYS) < keyed.below(0.1), price)
        aggs += [F.avg(drawn).alias(f"a{s}"), (1.96 * F.stddev_samp(drawn) / F.sqrt(F.count(drawn))).alias(f"e{s}")]
    each = F.array(*[F.struct(F.col(f"a{s}").alias("approx"), F.col(f"e{s}").alias("err"), F.lit(s).alias("seed")) for s in seeds])
    return df.agg(*aggs).select("exact", F.inline(each)).withColumn("q", F.lit("avg"))


_REP = " UNION ALL ".join(f"SELECT (SELECT avg(l_extendedprice) FROM lineitem) AS exact, avg(l_extendedprice) AS approx, 1.96 * stddev_samp(l_extendedprice) / sqrt(count(*)) AS err FROM lineitem WHERE {keyed.unit_sql(s, KEYS_SQL)} < {keyed.below(0.1)}" for s in range(10))


@_query(f"SELECT 'avg' AS q, count(*) AS n, sum(CASE WHEN abs(approx - exact) <= err THEN 1 ELSE 0 END)::BIGINT AS hits, avg(CASE WHEN abs(approx - exact) <= err THEN 1.0 ELSE 0.0 END) AS coverage FROM ({_REP})")
def e1_coverage(spark, sf_dir):
    return evaluate.hits(_repeats(spark, sf_dir), ["q"])


#: Samples, their ratio, the year that they are drawn from the rows of and before, and what is asked.
_DRAWS, _DRAWN, _UNTIL = 100, 0.1, 1997
_ASKED = {"all": "true", "small": "l_quantity < 10", "large": "l_quantity >= 40", "cheap": "l_discount > 0.05"}


def _decay_sql() -> str:
    text = lambda i: f"md5(concat_ws('|', 'decay/{i}', {', '.join(KEYS_SQL)}))"
    bits = ", ".join(f"('0x' || substr(h[{i // 4 + 1}], {8 * (i % 4) + 1}, 8))::BIGINT < {keyed.below(_DRAWN)}" for i in range(_DRAWS))
    rows = f"SELECT year(l_shipdate) AS y, l_extendedprice AS v, [{', '.join(_ASKED.values())}] AS hit, [{', '.join(text(i) for i in range(-(-_DRAWS // 4)))}] AS h FROM lineitem"
    drawn = f"SELECT v, hit, unnest(list_filter(range({_DRAWS}), lambda i: b[i + 1])) AS draw FROM (SELECT v, hit, [{bits}] AS b FROM r WHERE y <= {_UNTIL})"
    each = f"SELECT draw, q, count(*)::DOUBLE AS n, sum(CASE WHEN hit[q] THEN v ELSE 0 END) AS sy, sum(CASE WHEN hit[q] THEN v * v ELSE 0 END) AS yy FROM d, range(1, {len(_ASKED) + 1}) AS t(q) GROUP BY ALL"
    exact = f"SELECT y, q, sum(sum(CASE WHEN hit[q] THEN v ELSE 0 END)) OVER o AS exact, sum(count(*)) OVER o AS rows FROM r, range(1, {len(_ASKED) + 1}) AS t(q) GROUP BY y, q WINDOW o AS (PARTITION BY q ORDER BY y)"
    est = f"SELECT draw, q, sy / {_DRAWN} AS approx, 1.96 * sqrt((n / {_DRAWN}) * (n / {_DRAWN}) * (1 - {_DRAWN}) / n * (yy - sy * sy / n) / (n - 1)) AS err FROM e"
    names = ", ".join(f"'{k}'" for k in _ASKED)
    return f"""WITH r AS MATERIALIZED ({rows}), d AS MATERIALIZED ({drawn}), e AS ({each}), s AS ({est}), x AS MATERIALIZED ({exact}),
base AS (SELECT q, rows FROM x WHERE y = {_UNTIL})
SELECT y::INT AS year, [{names}][x.q] AS q, count(*) AS n, count(*) FILTER (abs(approx * x.rows / base.rows - exact) <= err * x.rows / base.rows) AS scaled_hits, count(*) FILTER (abs(approx - exact) <= err) AS hits
FROM x JOIN base USING (q) JOIN s USING (q) WHERE y >= {_UNTIL} GROUP BY ALL"""


@_query(_decay_sql())
def e1_static_decay(spark, sf_dir):
    """A hundred samples of a tenth of the rows up to a year, left as they are while the table grows: how many of them hold the sums of later
    years within their errors, scaled to the table's rows and not. All samples and sums are one scan."""
    df = lineitem(spark, sf_dir).select(*KEYS, "l_extendedprice", F.year("l_shipdate").alias("year"), *[F.expr(x).alias(f"in_{k}") for k, x in _ASKED.items()])
    draws = evaluate.repeated(df.where(F.col("year") <= _UNTIL), "l_extendedprice", {k: f"in_{k}" for k in _ASKED}, _DRAWS, _DRAWN, "decay", KEYS)
    by = df.groupBy("year").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.when(F.col(f"in_{k}"), F.col("l_extendedprice"))).alias(k) for k in _ASKED])
    so_far = evaluate.running(by, "year", "rows").withColumnRenamed("running", "so_far")  # a row for each year
    for k in _ASKED:
        so_far = evaluate.running(so_far, "year", k).withColumnRenamed("running", f"x_{k}")
    exact = so_far.select("year", F.col("so_far").alias("now"), F.inline(F.array(*[F.struct(F.lit(k).alias("q"), F.col(f"x_{k}").alias("exact")) for k in _ASKED]))).where(F.col("year") >= _UNTIL)
    then = exact.where(F.col("year") == _UNTIL).select(F.col("q").alias("_q"), F.col("now").alias("then"))
    both = exact.join(F.broadcast(then), F.col("q") == F.col("_q")).drop("_q").join(draws, "q")
    keys = ["year", "q"]
    plain = evaluate.hits(both, keys).select(*keys, "n", "hits")
    return plain.join(evaluate.hits(evaluate.scaled(both, "now", "then"), keys).select(*keys, F.col("hits").alias("scaled_hits")), keys)


@_query(f"SELECT 'avg' AS q, round(avg(abs(approx * 1.25 - exact) / abs(exact)), 8) AS relative_error FROM ({_REP})")
def e2_scaled_error(spark, sf_dir):
    """Answers of a sample of a table with four fifths of the rows, scaled."""
    r = evaluate.scaled(_repeats(spark, sf_dir).withColumn("now", F.lit(5)).withColumn("then", F.lit(4)), "now", "then")
    return evaluate.relative_error(r, ["q"]).withColumn("relative_error", F.round("relative_error", 8))


@_query(f"SELECT 'avg' AS q, round(avg(abs(approx - exact) / abs(exact)), 8) AS relative_error FROM ({_REP})")
def e3_relative_error(spark, sf_dir):
    return evaluate.relative_error(_repeats(spark, sf_dir), ["q"]).withColumn("relative_error", F.round("relative_error", 8))


@_query(f"SELECT 'avg' AS q, round(avg(err / abs(exact)), 8) AS relative_bound FROM ({_REP})")
def e4_relative_bound(spark, sf_dir):
    return evaluate.relative_bound(_repeats(spark, sf_dir), ["q"]).withColumn("relative_bound", F.round("relative_bound", 8))


@_query("SELECT column_name, filters, groups, n AS distinct_values FROM (VALUES ('l_extendedprice', 18, 0), ('l_quantity', 21, 0), ('l_suppkey', 21, 9)) AS t(column_name, filters, groups) JOIN (SELECT unnest(['l_extendedprice', 'l_quantity', 'l_suppkey']) AS column_name, unnest([count(DISTINCT l_extendedprice), count(DISTINCT l_quantity), count(DISTINCT l_suppkey)]) AS n FROM lineitem) USING (column_name)")
def e5_query_pool(spark, sf_dir):
    """The columns that the pool's 60 texts filter and group by, as their analysed plans tell, and how many values the table has of each."""
    df = table(spark, sf_dir, "lineitem")
    df.createOrReplaceTempView("lineitem")
    asked = [texts.read(spark, x.sql(), "lineitem").queries[0][1] for x in q.pool()]
    columns = sorted({c for x in asked for c in x.columns()})
    n = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    row = lambda c: F.struct(F.lit(c).alias("column_name"), F.lit(sum(c in x.where_columns for x in asked)).alias("filters"), F.lit(sum(c in x.group_by for x in asked)).alias("groups"), F.col(c).alias("distinct_values"))
    return n.select(F.inline(F.array(*map(row, columns))))


@_query("SELECT y, round(total, 2) AS total, round(sum(total) OVER (ORDER BY y), 2) AS running FROM (SELECT year(o_orderdate)::INT AS y, sum(o_totalprice) AS total FROM orders GROUP BY 1)")
def a11_running_totals(spark, sf_dir):
    by = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("total"))
    return evaluate.running(by, "y", "total").select("y", F.round("total", 2).alias("total"), F.round("running", 2).alias("running"))


_TRACE = [f"{keyed.unit_sql('trace', KEYS_SQL)} < {keyed.below((i + 1) / 3)}" for i in range(3)]


_FIRST = f"(SELECT greatest(1, round(0.1 * count(*))) FROM lineitem WHERE {_TRACE[0]})"


def _over_time(spark, sf_dir, columns=("l_extendedprice",)) -> list[DataFrame]:
    df, u = lineitem(spark, sf_dir).select(*KEYS, "l_extendedprice", "l_returnflag"), keyed.unit("trace", KEYS)
    edges = [0, *[keyed.below((i + 1) / 3) for i in range(3)]]
    return [df.where((u >= a) & (u < b)) for a, b in zip(edges, edges[1:], strict=False)]


@_query(" UNION ALL ".join(
    f"SELECT {i} AS step, 'update' AS action, k::BIGINT AS rows, round(exact, 4) AS exact, round(approx, 4) AS approx, abs(approx - exact) <= err AS hit FROM "
    f"(SELECT avg(l_extendedprice) AS exact FROM lineitem WHERE {w}), (SELECT avg(l_extendedprice) AS approx, count(*) AS k, "
    f"1.96 * sqrt((1 - count(*)::DOUBLE / (SELECT count(*) FROM lineitem WHERE {w})) / count(*) * var_samp(l_extendedprice)) AS err "
    f"FROM (SELECT *, row_number() OVER (ORDER BY {U}, {_K}) AS r FROM lineitem WHERE {w}) WHERE r <= {_FIRST})" for i, w in enumerate(_TRACE) if i))
def e6_accuracy_over_time(spark, sf_dir):
    """A sample kept up through batches: after each the exact and the approximate average, and whether the error bound holds."""
    first, *rest = _over_time(spark, sf_dir)
    t = engine.restored(spark, scratch(spark, "time"), "lineitem", engine.Settings(KEYS, relative=10.0, columns=["l_extendedprice"]), first, [("uniform", 0.1, None)])
    x = q.Query("lineitem", "avg", "l_extendedprice")
    rows = evaluate.over_time(t, rest, {"avg": x})
    return rows.select("step", "action", "rows", F.round("exact", 4).alias("exact"), F.round("approx", 4).alias("approx"), (F.abs(F.col("approx") - F.col("exact")) <= F.col("err")).alias("hit"))


_GROWING = [f"l_suppkey % 5 < {3 + i}" for i in range(3)]


@_query(" UNION ALL ".join(f"SELECT {i} AS step, count(*) AS strata, sum(least(s, greatest(cap, 10)))::BIGINT AS rows FROM (SELECT l_suppkey AS k, count(*) AS s FROM lineitem WHERE {w} GROUP BY 1), ({_CAP.format(target='(SELECT round(0.1 * count(*)) FROM lineitem WHERE ' + _GROWING[0] + ')', sizes=f'SELECT l_suppkey AS k, count(*) AS s FROM lineitem WHERE {w} GROUP BY 1')})" for i, w in enumerate(_GROWING) if i))
def e6_growing_strata(spark, sf_dir):
    """A stratified sample through batches of new strata alone: it keeps to its target, and its strata follow the table."""
    df = lineitem(spark, sf_dir).select(*KEYS, "l_extendedprice")
    g = F.col("l_suppkey") % 5
    t = engine.restored(spark, scratch(spark, "strata"), "lineitem", engine.Settings(KEYS, relative=10.0, columns=["l_extendedprice"]), df.where(g < 3), [("stratified", 0.1, "l_suppkey")])
    out = []
    for i in (1, 2):
        t.receive(df.where(g == 2 + i), i)
        (x,) = t.samples()
        out.append((i, t.store.read(x.at).select("l_suppkey").distinct().count(), x.rows))
    return spark.createDataFrame(out, "step int, strata bigint, rows bigint")


@_query(" UNION ALL ".join(f"SELECT {i} AS step, count(*) AS d, round(var_pop(l_extendedprice), 2) AS s2, round(avg(l_extendedprice), 4) AS avg FROM lineitem WHERE {w}" for i, w in enumerate(_TRACE)))
def e9_variance_trace(spark, sf_dir):
    """The variance after each of three batches."""
    df, u = lineitem(spark, sf_dir), keyed.unit("trace", KEYS)
    edges = [0, *[keyed.below((i + 1) / 3) for i in range(3)]]
    parts = [df.where((u >= a) & (u < b)) for a, b in zip(edges, edges[1:], strict=False)]
    return profile.trace(parts, ["l_extendedprice"]).select("step", "d", F.round("s2", 2).alias("s2"), F.round("avg", 4).alias("avg"))


@_query(f"SELECT l_returnflag, {SUMS} FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag UNION ALL SELECT l_returnflag, {SUMS} FROM lineitem WHERE l_discount <= 0.05 GROUP BY l_returnflag")
def u1_bag_union(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return _sums(df.where("l_discount > 0.05"), "l_returnflag").unionByName(_sums(df.where("l_discount <= 0.05"), "l_returnflag"))


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def l1_ordered_limit(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


_THIRD = [f"{keyed.unit_sql('rounds', KEYS_SQL)} < {keyed.below((i + 1) / 3)}" for i in range(3)]


def _m1_sql(kind: str) -> str:
    """Sizes and actions of a sample over three rounds by the policy's definition: d rows, need, and the target that updates keep."""
    rows = " ".join(f", t{i} AS (SELECT count(*)::DOUBLE AS d, var_pop(l_extendedprice) AS s2, avg(l_extendedprice) AS a FROM lineitem WHERE {_THIRD[i]})" for i in range(3))
    need = " ".join(f", n{i} AS (SELECT t{i}.d, floor(n0 * t{i}.d / (n0 + t{i}.d)) AS need FROM (SELECT 3.8416 * t{i}.s2 / (least(abs(t0.a) * 0.05, 100000) * least(abs(t0.a) * 0.05, 100000)) AS n0 FROM t{i}, t0), t{i})" for i in (1, 2))

    def size(i: int, target: str) -> str:
        if kind == "uniform":
            return f"least({target}, (SELECT d FROM t{i}))"
        sizes = f"SELECT l_suppkey AS k, count(*) AS s FROM lineitem WHERE {_THIRD[i]} GROUP BY 1"
        return f"(SELECT sum(least(s, greatest(cap, 10))) FROM ({sizes}), ({_CAP.format(target=target, sizes=sizes)}))"

    steps, before = "", "r0"
    for i in (1, 2):
        steps += f", g{i} AS (SELECT n{i}.d, n{i}.need, n{i}.need > old.size AS short, CASE WHEN n{i}.need > old.size THEN greatest(1, round(greatest(old.size / old.d, 1.01 * n{i}.need / n{i}.d) * n{i}.d)) ELSE old.target END AS target FROM {before} AS old, n{i})"
        steps += f", r{i} AS (SELECT d, need, short, target, {size(i, f'(SELECT target FROM g{i})')} AS size FROM g{i})"
        before = f"r{i}"
    first = f", r0 AS (SELECT d, target, {size(0, '(SELECT greatest(1, round(0.1 * d)) FROM t0)')} AS size FROM (SELECT d, greatest(1, round(0.1 * d)) AS target FROM t0))"
    out = " UNION ALL ".join(f"SELECT {i} AS batch, '{kind}' AS kind, CASE WHEN short THEN 'resample' ELSE 'update' END AS action, need::BIGINT AS need, size::BIGINT AS rows FROM r{i}" for i in (1, 2))
    return f"WITH z AS (SELECT 1){rows}{need}{first}{steps} {out}"


@_query(f"SELECT * FROM ({_m1_sql('uniform')}) UNION ALL SELECT * FROM ({_m1_sql('stratified')})")
def m1_maintained_table(spark, sf_dir):
    """A stored table with a uniform and a stratified sample through two batches: actions, sizes and needs as reported."""
    df, u = lineitem(spark, sf_dir).select(*KEYS, "l_extendedprice", "l_returnflag"), keyed.unit("rounds", KEYS)
    edges = [0, *[keyed.below((i + 1) / 3) for i in range(3)]]
    parts = [df.where((u >= a) & (u < b)) for a, b in zip(edges, edges[1:], strict=False)]
    t = engine.restored(spark, scratch(spark, "table"), "lineitem", engine.Settings(KEYS, relative=0.05, columns=["l_extendedprice"]), parts[0], [("uniform", 0.1, None), ("stratified", 0.1, "l_suppkey")])
    out = []
    for i, p in enumerate(parts[1:], 1):
        r = t.receive(p, i)
        out += [(i, x.kind, r[f"sampling.action.{x.id}"], r[f"sample.need.{x.id}"], r[f"sampling.count.{x.id}"]) for x in t.samples()]
    return spark.createDataFrame(out, "batch int, kind string, action string, need bigint, rows bigint")


_ORIGIN = f"CASE WHEN {keyed.unit_sql('batch', KEYS_SQL)} < {keyed.below(0.01)} THEN 2 WHEN {BATCH} THEN 1 ELSE 0 END"


@_query(f"""WITH l AS MATERIALIZED (SELECT *, {_ORIGIN} AS origin, row_number() OVER (PARTITION BY {_ORIGIN} ORDER BY {U}, {_K}) AS r FROM lineitem),
n AS (SELECT floor(n0 * d / (n0 + d))::BIGINT AS need FROM (SELECT count(*) FILTER (origin < 2)::DOUBLE AS d, 3.8416 * var_pop(l_extendedprice) FILTER (origin < 2) / power(least(abs(avg(l_extendedprice) FILTER (origin = 0)) * 0.08, 100000), 2) AS n0 FROM l)),
x AS (SELECT need, low + ('0x' || substr(md5('{SEED}/1/x'), 1, 8))::BIGINT % (150 - low + 1) AS x FROM (SELECT need, greatest(need - 10 * (need - 150), 10) AS low FROM n)),
f AS MATERIALIZED (SELECT l.* FROM l, x WHERE (origin = 0 AND r <= x) OR (origin = 1 AND r <= need - x) OR origin = 2 ORDER BY {U}, {_K} LIMIT (SELECT need FROM x)),
p AS (SELECT part, count(*)::DOUBLE AS n, any_value(s)::DOUBLE AS s FROM (SELECT (origin > 0)::INT AS part FROM f) JOIN (SELECT (origin > 0)::INT AS part, count(*) AS s FROM l GROUP BY 1) USING (part) GROUP BY part)
SELECT origin, round(y * s / n, 3) AS count, round(1.96 * sqrt(s * s * (1 - n / s) / n * (y - y * y / n) / (n - 1)), 3) AS count_err, round(v * s / n, 0) AS price
FROM (SELECT origin, count(*)::DOUBLE AS y, sum(l_extendedprice) AS v FROM f GROUP BY origin) JOIN p ON part = (origin > 0)::INT""")
def m2_adaptive_table(spark, sf_dir):
    """A stored table whose sample a large batch extends and a small one updates: how many rows came with each, and their prices, with
    each part's own chance."""
    u = keyed.unit("batch", KEYS)
    df = lineitem(spark, sf_dir).select(*KEYS, "l_extendedprice", F.when(u < keyed.below(0.01), 2).when(u < keyed.below(0.2), 1).otherwise(0).alias("origin"))
    t = engine.SampledTable(spark, scratch(spark, "adaptive"), "lineitem", engine.Settings(KEYS, relative=0.08, columns=["l_extendedprice"], seed=SEED, flags=policy.Flags(adaptive=True)))
    t.receive(df.where("origin = 0"), 0)
    x = t.create("uniform", 150 / t.state()["rows"])
    actions = [t.receive(df.where("origin = 1"), 1)[f"sampling.action.{x.id}"]]
    t.set.flags = policy.Flags(force_update=True)
    actions.append(t.receive(df.where("origin = 2"), 2)[f"sampling.action.{x.id}"])
    if actions != ["adaptive", "update"]:
        raise AssertionError(f"an extension and an update were to be expected: {actions}")
    count, price = (t.approximate(q.Query("lineitem", agg, value, group_by=("origin",))) for agg, value in (("count", "l_orderkey"), ("sum", "l_extendedprice")))
    return count.join(price, "origin").select("origin", F.round("count", 3).alias("count"), F.round("count_err", 3).alias("count_err"), F.round("sum", 0).alias("price"))


def queries() -> dict[str, Run]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

