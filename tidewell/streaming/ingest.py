"""Batches as they come: the files of a folder by name, new files as a stream, or lines on a socket, into a sampled table."""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.engine import SampledTable
from ..sources.files import read_delimited


def file_batches(spark: SparkSession, path: str, schema: str, *, files: int = 1, fmt: str = "csv", sep: str = ",") -> DataFrame:
    """A stream of the files of a folder, in the order of their times, so many to a batch."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return r.option("sep", sep).csv(path) if fmt == "csv" else r.format(fmt).load(path)


def socket_lines(spark: SparkSession, host: str, port: int, schema: str, sep: str = ",") -> DataFrame:
    """A stream of delimited lines from a socket; it can't be replayed, so it is for tests and trials."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return lines.select(F.from_csv("value", schema, {"sep": sep}).alias("r")).select("r.*")


def into(stream: DataFrame, table: SampledTable, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Feeds a stream to a table: each micro-batch is a batch. Its id, which counts within this checkpoint, makes a second
    delivery no work; batches that the table has from elsewhere don't matter to it.

    Without ``every`` it takes what there is and ends; with it, it goes on at that interval.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        table.receive(batch, batch_id, checkpoint)

    w = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


@dataclass(frozen=True)
class Found:
    """A file of a folder; its length and time stay what they are when it is renamed."""

    name: str
    length: int
    modified: int


def named_files(spark: SparkSession, folder: str) -> list[Found]:
    """A folder's files in the order of their names; hidden ones are left out."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [Found(x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(path) if x.isFile()]
    return sorted((x for x in found if x.name[0] not in "._"), key=lambda x: x.name)


class Manifest:
    """Which files of a folder a table has taken in: a set, kept beside the table's state as one file for each batch, of which MOST at
    most are open; then they are written as one. Only files that the state names count, so a batch that dies leaves its files untaken."""

    MOST = 32

    def __init__(self, table: SampledTable, folder: str) -> None:
        self.table, self.folder, state = table, folder, table.state()
        self.entry = state.get("taken", {}).get(f"{folder}#", {"parts": [], "batches": 0})
        last = state["seen"].get(folder)
        self.before = last if isinstance(last, str) else ""  # of a table from when the last name was all that was kept
        self.taken = [Found(*x) for at in self.entry["parts"] for x in table.store.read_json(at)]

    def untaken(self) -> list[Found]:
        """The files that weren't taken, by name, late ones too. A file is known by its name, or, renamed, as one that was
        taken under a name that is gone, of the same length and time."""
        there = named_files(self.table.spark, self.folder)
        names = {x.name for x in there}
        known = {x.name for x in self.taken}
        moved = Counter((x.length, x.modified) for x in self.taken if x.name not in names)
        out = []
        for x in there:
            if x.name in known or x.name <= self.before:
                continue
            if moved[x.length, x.modified] > 0:
                moved[x.length, x.modified] -= 1
                continue
            out.append(x)
        return out

    def with_batch(self, files: list[Found]) -> dict:
        """The entry that says that these files are taken too; it counts once the state holds it."""
        number, store = self.entry["batches"], self.table.store
        at = f"taken/{zlib.crc32(self.folder.encode()):08x}-{len(self.folder)}/{number}-{uuid.uuid4().hex}.json"
        for old in self.entry.get("gone", []):  # what an earlier batch, which the state holds by now, has written as one
            store.drop(old)
        parts, gone = [*self.entry["parts"], at], []
        self.taken += files
        if len(parts) > self.MOST:
            parts, gone, files = [at], self.entry["parts"], self.taken
        store.write_json([[x.name, x.length, x.modified] for x in files], at)
        self.entry = {"parts": parts, "batches": number + 1, "gone": gone}
        return self.entry


def by_name(table: SampledTable, folder: str, schema: str, *, files: int = 1, sep: str = ",", most: int | None = None) -> list[dict]:
    """Takes in the delimited files of a folder that the table hasn't yet, by name, so many to a batch; at most so many batches. Files that
    come late, whatever their names, are taken by the next call, renamed ones never again. A batch and the note that its files are taken
    become the table's state at once, so this goes on where the last call, or the one that died, ended."""
    manifest = Manifest(table, folder)
    todo, out = manifest.untaken(), []
    for g in [todo[i : i + files] for i in range(0, len(todo), files)][:most]:
        batch = read_delimited(table.spark, [f"{folder}/{x.name}" for x in g], schema, sep)
        number = manifest.entry["batches"]
        out.append(table.receive(batch, number, f"{folder}#", manifest.with_batch(g)))
    return out
