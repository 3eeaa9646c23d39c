"""The sample catalog: two tables, of names and of sizes, as rows of the store's state."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The catalog's column names (the second has the spelling that readers of the catalog expect).
NAME_COLUMNS = "originalschemaname string, originaltablename string, sampleschemaaname string, sampletablename string, sampletype string, samplingratio double, columnnames string"
SIZE_COLUMNS = "schemaname string, tablename string, samplesize bigint, originaltablesize bigint"


@dataclass
class Sample:
    """A registered sample; ``id`` identifies it, whatever its ratio becomes."""

    id: str
    schema: str
    table: str
    kind: str
    ratio: float
    column: str | None
    rows: int
    base_rows: int
    at: str = ""
    attenuation: float = 1.0
    #: Ratio by which it was created, which names it in statements, and the rows that updates keep it at; both last while
    #: ratio and rows follow the table.
    declared: float = 0.0
    target: int = 0

    def dict(self) -> dict:
        return asdict(self)


def name_table(spark: SparkSession, samples: list[Sample]) -> DataFrame:
    return spark.createDataFrame([(s.schema, s.table, f"{s.schema}_samples", s.id, s.kind, float(s.ratio), s.column) for s in samples], NAME_COLUMNS)


def size_table(spark: SparkSession, samples: list[Sample]) -> DataFrame:
    return spark.createDataFrame([(f"{s.schema}_samples", s.id, s.rows, s.base_rows) for s in samples], SIZE_COLUMNS)


def listed(names: DataFrame, sizes: DataFrame, table: str | None = None) -> DataFrame:
    """Names with sizes, by table, kind, ratio and columns; of one table if it is given."""
    on = (F.col("sampleschemaaname") == F.col("schemaname")) & (F.col("sampletablename") == F.col("tablename"))
    out = names.join(sizes, on).drop("schemaname", "tablename")
    out = out.where(F.col("originaltablename") == table) if table else out
    return out.orderBy("originaltablename", "sampletype", "samplingratio", "columnnames")


def upserted(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """rows with those of new, which replace rows with the same keys; nulls are equal."""
    other = new.select(*[F.col(k).alias(f"_{k}") for k in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(other, on, "left_anti").unionByName(new)


def removed(rows: DataFrame, **equal) -> DataFrame:
    """rows without those whose columns equal the values."""
    match = F.lit(True)
    for k, v in equal.items():
        match &= F.col(k).eqNullSafe(F.lit(v))
    return rows.where(~match)


def resized(sizes: DataFrame, table: str, rows: int) -> DataFrame:
    """The base size of all samples of a table, which their names hold, set to its rows now."""
    return sizes.withColumn("originaltablesize", F.when(F.col("tablename").contains(f"vs_{table}_"), F.lit(rows).cast("long")).otherwise(F.col("originaltablesize")))
