"""A growing table with its samples: batches come in, samples are kept up, queries are answered."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keyed
from ..plans import aqp, policy
from ..plans import text as texts
from ..plans.query import Query
from . import catalog, ddl, profile, sampling
from .catalog import Sample
from .store import Store


@dataclass
class Settings:
    """relative or absolute error bound, confidence factor, columns to profile (all numeric ones if none), what an update and
    a new draw do (reservoir or incremental; bottom or bernoulli), over-provision of new draws, seed and row key. fast takes
    Spark's own hash for the draws instead of MD5, which other engines can check. So many folders of batches are written as one."""

    keys: list[str]
    relative: float = 0.1
    absolute: float | None = None
    z: float = 1.96
    columns: list[str] | None = None
    update: str = "reservoir"
    resample: str = "bottom"
    overflow: float = 1.01
    seed: int | str = 42
    fast: bool = False
    fold: int = 16
    flags: policy.Flags = field(default_factory=policy.Flags)

    def __post_init__(self) -> None:
        if self.fast:
            self.seed = keyed.Fast(self.seed)


class SampledTable:
    """State is in the store alone, so a new object on the same root goes on where the last one ended."""

    def __init__(self, spark: SparkSession, root: str, table: str, settings: Settings, schema: str = "default") -> None:
        self.spark, self.table, self.set, self.schema = spark, table, settings, schema
        self.store = Store(spark, root)

    # state

    def state(self) -> dict:
        """batch: the last batch's number; seen: the last id of each source; stats: the profile's rows."""
        return self.store.state() or {"batch": -1, "seen": {}, "rows": 0, "batches": [], "stats": [], "samples": [], "groups": {}, "next": 0}

    def base(self, state: dict | None = None) -> DataFrame:
        """The whole table: its batches' folders."""
        s = state or self.state()
        read = self.spark.read.schema(T.StructType.fromJson(s["schema"])) if s.get("schema") else self.spark.read
        return read.parquet(*[f"{self.store.root}/{at}" for at in s["batches"]])

    def samples(self, state: dict | None = None) -> list[Sample]:
        return [Sample(**x) for x in (state or self.state())["samples"]]

    def stats(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(r[c] for c in ("column_name", "d", "filled", "s2", "avg", "sum", "e")) for r in self.state()["stats"]], profile.STATS)

    # batches

    def receive(self, batch: DataFrame, batch_id: int | str, source: str = "", taken: dict | None = None) -> dict:
        """Takes in a batch and keeps up every sample; returns a report with dotted keys.

        Ids of a source grow, and are all numbers or all text; a batch that came before from the same source is no work. Sources (a
        stream's checkpoint, a folder) count for themselves. An update reads the batch and the sample, never the table; only a new draw
        reads the table. A batch may have further columns, which are null in the rows before it, or lack some, which are null in its own;
        numbers are taken as the table's column has them, and a column of any other type is an error. ``taken`` becomes the source's entry in the state's manifest together with the batch.
        """
        s = self.state()
        last = s["seen"].get(source)
        if last is not None and isinstance(last, str) != isinstance(batch_id, str):
            raise ValueError(f"ids of {source!r} are like {last!r}, not like {batch_id!r}")
        if last is not None and batch_id <= last:
            return {"batch.skipped": True}
        schema, batch = self._fitted(s, batch)
        report: dict[str, float | int | str] = {}
        number, began = s["batch"] + 1, time.time()
        at, n = self.store.write_counted(batch, "base", f"{number}")
        batch = self.store.read(at)
        report |= {"batch.rows": n, "table.rows": s["rows"] + n, "cost.ingest": time.time() - began}
        began = time.time()
        if s["stats"]:
            new = profile.moments(batch, [r["column_name"] for r in s["stats"]]).collect()
            stats = profile.merged_rows(s["stats"], [r.asDict() for r in new])
        else:
            stats = [r.asDict() for r in profile.profile(batch, profile.numeric(batch, self.set.columns), self.set.relative, self.set.absolute).collect()]
        for r in stats:
            report |= {f"table.variance.{r['column_name']}": r["s2"], f"error-bound.{r['column_name']}": r["e"]}
        report["cost.profile"] = time.time() - began
        before, groups = s["rows"], dict(s["groups"])
        gone, replaced = s.get("replaced", []), [x for x in (*groups.values(), *(x["at"] for x in s["samples"])) if x]
        s = s | {"batch": number, "seen": s["seen"] | {source: batch_id}, "rows": before + n, "batches": [*s["batches"], at], "stats": stats, "schema": schema}
        if taken is not None:
            s["taken"] = s.get("taken", {}) | {source: taken}
        if n:
            for column, where in groups.items():
                merged = sampling.merged_sizes(self.store.read(where), sampling.group_sizes(batch, column), column)
                groups[column] = self.store.write(merged, f"groups/{column}", f"{number}")
        s["groups"] = groups
        s["batches"], folded = self._folded(s["batches"], number)
        replaced += folded
        if s["samples"] and n and not self.set.flags.skip:
            need = profile.need_of(stats, self.set.z)
            s["samples"] = [self._kept_up(x, s, batch, before, n, need, report).dict() for x in self.samples(s)]
        now = {*s["groups"].values(), *s["batches"], *(x["at"] for x in s["samples"])}
        self.store.switch(s | {"replaced": [x for x in replaced if x not in now]})
        for x in gone:  # what the batch before this one replaced; readers of the last state still find theirs
            self.store.drop(x)
            self.store.drop(f"{x}_moments")
        return report

    def _folded(self, batches: list[str], number: int) -> tuple[list[str], list[str]]:
        """The table's folders with ``fold`` of one tier written as one of the next, and the folders that this replaces, which go a batch
        later. A row is written once for each tier, so n batches are about fold x log n folders, and readers of the last state keep theirs."""
        tier = lambda at: int(at.rpartition("t")[2]) if "t" in at.rpartition("/")[2] else 0
        gone: list[str] = []
        for t in range(len(batches)):
            same = [at for at in batches if tier(at) == t]
            if len(same) < max(2, self.set.fold):
                break
            merged = self.store.write(self.spark.read.option("mergeSchema", True).parquet(*[f"{self.store.root}/{at}" for at in same]), "base", f"{number}t{t + 1}")
            batches, gone = [merged, *[at for at in batches if at not in same]], gone + same
        return batches, gone

    def _fitted(self, s: dict, batch: DataFrame) -> tuple[dict, DataFrame]:
        """The table's columns with the batch's further ones, as JSON, and the batch with its numbers as the table's columns have them."""
        old = s.get("schema") or (self.base(s).schema.jsonValue() if s["batches"] else {"type": "struct", "fields": []})
        fields, casts = {f.name: f for f in T.StructType.fromJson(old)}, {}
        for f in batch.schema:
            kind = fields.setdefault(f.name, T.StructField(f.name, f.dataType)).dataType
            if kind != f.dataType:
                if not (isinstance(kind, T.NumericType) and isinstance(f.dataType, T.NumericType)):
                    raise ValueError(f"column {f.name} is {kind.simpleString()} in the table and {f.dataType.simpleString()} in the batch")
                casts[f.name] = F.col(f.name).cast(kind)
        return T.StructType(list(fields.values())).jsonValue(), batch.withColumns(casts) if casts else batch

    def _kept_up(self, x: Sample, s: dict, batch: DataFrame, before: int, n: int, need: int, report: dict) -> Sample:
        p, began, target = self.set, time.time(), x.target
        data = self.store.read(x.at)
        if x.kind == "universe":
            new = data.unionByName(sampling.universe(batch, x.column, x.declared, p.seed, p.keys), allowMissingColumns=True)
            at, rows = self.store.write_counted(new, f"samples/{x.id}", f"{s['batch']}")
            report |= {f"sampling.action.{x.id}": policy.Action.UPDATE.value, f"sampling.count.{x.id}": rows, f"sampling.cost.{x.id}": time.time() - began}
            return Sample(**x.dict() | {"rows": rows, "base_rows": before + n, "ratio": rows / max(before + n, 1), "at": at})
        d = policy.decide(need, x.rows, before + n, n, x.ratio, policy.State(x.attenuation), p.flags, p.overflow)
        cap_sizes = self.store.read(s["groups"][x.column]) if x.column else None
        if d.action is policy.Action.RESAMPLE:
            target = self._target(s, d.ratio)
            new = self._drawn(self.base(s), s, x.kind, x.column, d.ratio)
        elif d.action is policy.Action.ADAPTIVE:
            k = sampling.find_x(need, x.rows, d.m, f"{p.seed}/{s['batch']}")
            report[f"adaptive.X.{x.id}"] = k
            target = need
            if x.column:
                new = sampling.stratified_adaptive(data, batch, x.column, cap_sizes, k, need, p.seed, p.keys)
            else:
                new = sampling.uniform_adaptive(data, batch, need, k, before, n, p.seed, p.keys)
        elif p.update == "incremental":
            new = sampling.stratified_incremental(data, batch, x.column, x.ratio * n, p.seed, p.keys) if x.column else sampling.uniform_incremental(data, batch, x.ratio, p.seed, p.keys)
        elif x.column:
            new = sampling.stratified_update(data, batch, x.column, cap_sizes, sampling.cap_value(cap_sizes, target), p.seed, p.keys)
        else:
            new = sampling.uniform_update(data, batch, target, before, n, p.seed, p.keys)
        at, rows = self.store.write_counted(new, f"samples/{x.id}", f"{s['batch']}")
        if d.action is policy.Action.UPDATE and p.update == "incremental":
            target = rows
        report |= {f"sampling.action.{x.id}": d.action.value, f"sampling.count.{x.id}": rows, f"sampling.cost.{x.id}": time.time() - began, f"sample.need.{x.id}": need}
        return Sample(**x.dict() | {"rows": rows, "base_rows": before + n, "ratio": rows / max(before + n, 1), "at": at, "attenuation": d.state.attenuation, "target": target})

    def _target(self, s: dict, ratio: float) -> int:
        return max(1, round(ratio * s["rows"]))

    def _drawn(self, base: DataFrame, s: dict, kind: str, column: str | None, ratio: float) -> DataFrame:
        p, k = self.set, self._target(s, ratio)
        if kind == "uniform":
            return sampling.uniform_ratio(base, ratio, p.seed, p.keys) if p.resample == "bernoulli" else sampling.uniform(base, s["rows"], k, p.seed, p.keys)
        if kind == "universe":
            return sampling.universe(base, column, ratio, p.seed, p.keys)
        sizes = self.store.read(s["groups"][column])
        draw = sampling.stratified_bernoulli if p.resample == "bernoulli" else sampling.stratified
        return draw(base, column, sizes, sampling.cap_value(sizes, k), p.seed, p.keys)

    # samples

    def create(self, kind: str, ratio: float, column: str | None = None) -> Sample:
        """A new sample of the table as it is."""
        s = self.state()
        if kind == "stratified" and column not in s["groups"]:
            s["groups"] = s["groups"] | {column: self.store.write(sampling.group_sizes(self.base(s), column), f"groups/{column}", f"{s['batch']}")}
        id_ = f"vs_{self.table}_{kind}_{column or 'all'}_{s['next']}"
        at, rows = self.store.write_counted(self._drawn(self.base(s), s, kind, column, ratio), f"samples/{id_}", f"{s['batch']}")
        x = Sample(id_, self.schema, self.table, kind, ratio, column, rows, s["rows"], at, declared=ratio, target=self._target(s, ratio))
        self.store.switch(s | {"samples": [*s["samples"], x.dict()], "next": s["next"] + 1})
        return x

    def drop(self, kind: str | None = None, ratio: float | None = None) -> int:
        """Drops samples by kind and by the ratio that they were created with, all if neither is told; how many. The sizes of a
        column's strata go with its last sample."""
        s = self.state()
        gone = [x for x in self.samples(s) if (kind in (None, x.kind)) and (ratio is None or abs(x.declared - ratio) < 1e-5)]
        left = [x for x in self.samples(s) if x not in gone]
        groups = {c: at for c, at in s["groups"].items() if any(x.column == c for x in left)}
        self.store.switch(s | {"samples": [x.dict() for x in left], "groups": groups})
        for at in [f"samples/{x.id}" for x in gone] + [f"groups/{c}" for c in s["groups"] if c not in groups]:
            self.store.drop(at)
        return len(gone)

    def listed(self) -> DataFrame:
        """The table's samples as the catalog lists them: names with sizes, in order."""
        mine = self.samples()
        return catalog.listed(catalog.name_table(self.spark, mine), catalog.size_table(self.spark, mine), self.table)

    def publish(self, root: str) -> tuple[DataFrame, DataFrame]:
        """Brings the catalog that several tables share, two tables under root, up to this table's samples: rows of samples that
        are gone are removed, others replaced or added, and base sizes set to the rows now. Returns names and sizes."""
        shared, mine, s = Store(self.spark, root), self.samples(), self.state()
        names, sizes, at = catalog.name_table(self.spark, mine), catalog.size_table(self.spark, mine), shared.state()
        if at:
            old_names, old_sizes = shared.read(at["names"]), shared.read(at["sizes"])
            owned = (F.col("originalschemaname") == self.schema) & (F.col("originaltablename") == self.table)
            gone = [r["sampletablename"] for r in old_names.where(owned).collect() if r["sampletablename"] not in {x.id for x in mine}]
            for x in gone:
                old_names = catalog.removed(old_names, sampletablename=x)
                old_sizes = catalog.removed(old_sizes, schemaname=f"{self.schema}_samples", tablename=x)
            names = catalog.upserted(old_names, names, ["sampleschemaaname", "sampletablename"])
            sizes = catalog.upserted(old_sizes, sizes, ["schemaname", "tablename"])
        sizes = catalog.resized(sizes, self.table, s["rows"])
        version = at.get("version", -1) + 1
        new = {"names": shared.write(names, "names", f"{version}"), "sizes": shared.write(sizes, "sizes", f"{version}"), "version": version}
        shared.switch(new)
        return shared.read(new["names"]), shared.read(new["sizes"])

    def sql(self, text: str, default_column: str | None = None, *, exact: bool = False) -> DataFrame | list[Sample] | int:
        """A statement on samples, or any SQL over the table by its name and the session's views. Aggregates that a sample can
        answer come with their errors, in columns <name>_err; what it can't, or all if it is asked, Spark answers exactly."""
        st = ddl.parse(text)
        if isinstance(st, ddl.Drop):
            return self.drop(st.kind, st.ratio)
        if isinstance(st, ddl.Create):
            kinds = [(st.kind, st.column)] if st.kind else [("uniform", None), *([("stratified", st.column or default_column)] if st.column or default_column else [])]
            return [self.create(k, st.ratio, c) for k, c in kinds]
        self.base().createOrReplaceTempView(self.table)
        if exact or not self.samples():
            return self.spark.sql(text)
        try:
            asked = texts.read(self.spark, text, self.table)
        except texts.Unsupported:
            return self.spark.sql(text)
        others = {j.table: self.spark.table(j.table) for _, x in asked.queries for j in x.joins}
        return texts.answered(asked, lambda x: self.approximate(x, others))

    def registered(self, *, moments: bool = False) -> list[aqp.Registered]:
        """The samples; with the moments that errors are predicted from, which are stored beside a sample when they are asked for first."""
        return [aqp.Registered(x.table, x.kind, x.column, x.rows, data, self._moments(x, data) if moments else None) for x in self.samples() for data in [self.store.read(x.at)]]

    def _moments(self, x: Sample, data: DataFrame) -> DataFrame:
        at = f"{x.at}_moments"
        if not self.store.written(at):
            columns = [r["column_name"] for r in self.state()["stats"]]
            self.store.write_at(aqp.sample_moments(data, columns, x.column if x.kind == "stratified" else None), at)
        return self.store.read(at)

    def approximate(self, query: Query, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        """From the sample that fits, or exactly where none does. Other facts of a query are told by tables."""
        mine = self.registered(moments=query.error_bound is not None)
        return aqp.answer(query, mine, {**(tables or {}), self.table: self.base()}, z=self.set.z)

    def joined(self, query: Query, others: list[SampledTable], tables: dict[str, DataFrame] | None = None) -> DataFrame:
        """A query that joins this table with other sampled ones, from their universe samples on the columns that join."""
        on = {j.table: j for j in query.joins}
        (key,) = {on[o.table].left for o in others}
        picked = {self.table: self._universe(key), **{o.table: o._universe(on[o.table].right) for o in others}}
        return aqp.universe(query, picked, key, tables, z=self.set.z)

    def _universe(self, column: str) -> DataFrame:
        found = [x for x in self.samples() if x.kind == "universe" and x.column == column]
        if not found:
            raise LookupError(f"{self.table} has no universe sample on {column}")
        return self.store.read(max(found, key=lambda x: x.rows).at)

    def report_frame(self, report: dict) -> DataFrame:
        """A report in long form."""
        return self.spark.createDataFrame([(k, str(v)) for k, v in sorted(report.items())] or [], "key string, value string")


def restored(spark: SparkSession, root: str, table: str, settings: Settings, base: DataFrame, samples: list[tuple[str, float, str | None]]) -> SampledTable:
    """A known state under a new root: the base as batch 0 and its samples. Nothing outside the root is touched."""
    t = SampledTable(spark, root, table, settings)
    if t.state()["batch"] >= 0:
        raise ValueError(f"{root} is in use")
    t.receive(base, 0)
    for kind, ratio, column in samples:
        t.create(kind, ratio, column)
    return t


def prefixed(report: dict, prefix: str) -> dict:
    """The entries of a report whose keys begin with a prefix."""
    return {k: v for k, v in report.items() if k.startswith(prefix)}


def audit(t: SampledTable, query: Query, sample: Sample) -> DataFrame:
    return aqp.audit(query, t.store.read(sample.at), {t.table: t.base()}, stratum=sample.column)


__all__ = ["SampledTable", "Settings", "audit", "prefixed", "restored"]
