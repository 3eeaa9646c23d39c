"""Tables of a database by name: what Spark's catalog says and does, under short names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Database:
    spark: SparkSession
    name: str

    def full(self, table: str) -> str:
        return f"`{self.name}`.`{table}`"

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.full(name))


@contextmanager
def database(spark: SparkSession, folder: str) -> Iterator[Database]:
    """A new database whose tables lie in folder; it is dropped with them at the end. No other database is touched."""
    name = f"tidewell_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE `{name}` LOCATION '{folder}'")
    try:
        yield Database(spark, name)
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")


def databases(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases()]


def names(db: Database) -> list[str]:
    return sorted(t.name for t in db.spark.catalog.listTables(db.name) if not t.isTemporary)


def exists(db: Database, table: str) -> bool:
    return db.spark.catalog.tableExists(db.full(table))


def described(db: Database, table: str) -> str:
    """Columns with types, in order."""
    return ",".join(f"{f.name} {f.dataType.simpleString()}" for f in db.table(table).schema)


def create(db: Database, table: str, rows: DataFrame) -> None:
    rows.write.saveAsTable(db.full(table), format="parquet")


def create_like(db: Database, table: str, other: str) -> None:
    """An empty table with the columns of another."""
    db.spark.sql(f"CREATE TABLE {db.full(table)} LIKE {db.full(other)}")


def insert(db: Database, table: str, rows: DataFrame) -> None:
    """Appends rows, columns by name."""
    rows.select(*db.table(table).columns).write.insertInto(db.full(table))


def truncate(db: Database, table: str) -> None:
    db.spark.sql(f"TRUNCATE TABLE {db.full(table)}")


def rename(db: Database, table: str, new: str) -> None:
    db.spark.sql(f"ALTER TABLE {db.full(table)} RENAME TO {db.full(new)}")


def drop(db: Database, table: str) -> None:
    db.spark.sql(f"DROP TABLE IF EXISTS {db.full(table)}")


def count(db: Database, table: str) -> int:
    return db.table(table).count()
