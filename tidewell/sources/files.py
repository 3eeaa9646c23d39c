"""Delimited text, Parquet, JSON rows and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The schema of hourly page counts.
PAGE_COUNTS = "date_time int, project_name string, page_name string, page_count int, page_size int"

#: The seven dimension tables and the fact table of the public benchmark as delimited text.
TPCH = {
    "region": "r_regionkey int, r_name string, r_comment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
    "supplier": "s_suppkey int, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal double, s_comment string",
    "customer": "c_custkey int, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal double, c_mktsegment string, c_comment string",
    "part": "p_partkey int, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice double, p_comment string",
    "partsupp": "ps_partkey int, ps_suppkey int, ps_availqty int, ps_supplycost double, ps_comment string",
    "orders": "o_orderkey int, o_custkey int, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "lineitem": "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string",
}


def read_delimited(spark: SparkSession, paths: str | list[str], schema: str, sep: str = ",") -> DataFrame:
    """One or several text files, or folders of them, with a declared schema and no header."""
    return spark.read.csv(paths, schema=schema, sep=sep, header=False)


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=False)


def without_last_separator(lines: DataFrame, sep: str = "|", column: str = "value") -> DataFrame:
    """Text lines without the separator at their end."""
    return lines.withColumn(column, F.regexp_replace(column, rf"\Q{sep}\E$", ""))


def clean_delimited(spark: SparkSession, path: str, out: str, sep: str = "|") -> None:
    """Rewrites text files without the separator at the end of lines."""
    without_last_separator(spark.read.text(path), sep).write.mode("overwrite").text(out)


def read_tpch(spark: SparkSession, folder: str, sep: str = "|", names: tuple[str, ...] = tuple(TPCH)) -> dict[str, DataFrame]:
    """The tables, or those named, that lie in a folder as <name>.tbl."""
    return {name: read_delimited(spark, f"{folder}/{name}.tbl", TPCH[name], sep) for name in names}


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of several tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def replicated(df: DataFrame, times: int, copy: str = "copy") -> DataFrame:
    """Every row as often as told, with the number of the copy; without a shuffle."""
    return df.withColumn(copy, F.explode(F.sequence(F.lit(1), F.lit(times))))


def json_rows(df: DataFrame, column: str = "json") -> DataFrame:
    """Every row as a JSON object, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(column))


def write_results(df: DataFrame, path: str, sep: str = "|") -> None:
    """A result table as text with a header."""
    df.write.mode("overwrite").csv(path, sep=sep, header=True, nullValue="\\N")


def read_results(spark: SparkSession, path: str, schema: str, sep: str = "|") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=True, nullValue="\\N")


def append(df: DataFrame, path: str, batch_id: int) -> None:
    """A batch into a table of batches; the same batch again replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it comes from fewer partitions than there are cores and is read several times."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
