"""Where a table, its samples and their state live: versioned Parquet folders and small numbered files that name the current ones.

Every batch writes new folders; then a pointer file of the next number is made under another name and renamed. The highest
number counts, no pointer is ever replaced, and older ones go only afterwards, so a run that dies anywhere leaves the last
state whole, at most with folders that nothing points to, and the batch can be run again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _pointers(self) -> list[tuple[int, str]]:
        """Numbers and names of the pointer files, in order."""
        fs, path = self._path(f"{self.root}/_current")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted((int(n[:-5]), n) for n in names if n.endswith(".json"))

    def state(self) -> dict:
        """What the last pointer file says; empty before the first batch."""
        found = self._pointers()
        if not found:
            return {}
        return self.read_json(f"_current/{found[-1][1]}")

    def switch(self, state: dict) -> None:
        """Makes the state the current one. The two pointers before it stay, for those who are reading them."""
        found = self._pointers()
        fs, part = self._path(self.write_json(state, f"_current/{uuid.uuid4().hex}.part"))
        _, path = self._path(f"{self.root}/_current/{found[-1][0] + 1 if found else 0:012d}.json")
        if not fs.rename(part, path):
            raise OSError(f"can't rename {part} to {path}: another run has written it")
        for _, name in found[:-2]:
            self.drop(f"_current/{name}")

    def write_json(self, value, at: str) -> str:
        """Writes a small value to a file; its whole path."""
        fs, path = self._path(f"{self.root}/{at}")
        stream = fs.create(path, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        return f"{self.root}/{at}"

    def read_json(self, at: str):
        fs, path = self._path(f"{self.root}/{at}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, df: DataFrame, name: str, version: str) -> str:
        """A new version of a table; its folder relative to the root. The same version again replaces itself."""
        at = f"{name}/v{version}"
        df.write.mode("overwrite").parquet(f"{self.root}/{at}")
        return at

    def write_counted(self, df: DataFrame, name: str, version: str) -> tuple[str, int]:
        """The same, and the rows as they were counted while they were written."""
        seen = Observation()
        at = self.write(df.observe(seen, F.count(F.lit(1)).alias("n")), name, version)
        return at, seen.get["n"]

    def write_at(self, df: DataFrame, at: str) -> None:
        """Writes what follows from a version beside it."""
        df.write.mode("overwrite").parquet(f"{self.root}/{at}")

    def written(self, at: str) -> bool:
        """Whether a folder was written to its end."""
        fs, path = self._path(f"{self.root}/{at}/_SUCCESS")
        return fs.exists(path)

    def read(self, at: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{at}")

    def drop(self, at: str) -> None:
        fs, path = self._path(f"{self.root}/{at}")
        fs.delete(path, True)
