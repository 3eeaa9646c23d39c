"""A stored table: batches, replays, streams and sources."""

import socket
import threading

import pytest
from pyspark.sql import functions as F

from tidewell.functions import keyed
from tidewell.operators import engine, sampling
from tidewell.plans import aqp
from tidewell.plans import text as texts
from tidewell.plans.policy import Flags
from tidewell.plans.query import Join, Query, equality_pool, pool
from tidewell.sources import files
from tidewell.streaming import ingest

SCHEMA = "id long, g long, y double"


def frame(spark, n, start=0):
    return spark.range(start, start + n).select("id", (F.col("id") % 7).alias("g"), (F.col("id") % 101).cast("double").alias("y"))


def settings(**more):
    return engine.Settings(**{"keys": ["id"], "columns": ["y"], "relative": 0.2} | more)


def make(spark, at, **more):
    return engine.restored(spark, str(at), "t", settings(**more), frame(spark, 1000), [("uniform", 0.1, None), ("stratified", 0.1, "g")])


def test_updates_equal_new_draws(spark, tmp_path):
    t = make(spark, tmp_path / "a")
    for i in (1, 2):
        r = t.receive(frame(spark, 200, 800 + 200 * i), i)
        assert set(engine.prefixed(r, "sampling.action").values()) == {"update"}
    u = next(x for x in t.samples() if x.kind == "uniform")
    new = sampling.uniform(frame(spark, 1400), 1400, u.rows, 42, ["id"])
    columns = [c for c in new.columns if c != sampling.THRESHOLD]  # any number between the last row drawn and the next
    assert sorted(t.store.read(u.at).select(columns).collect()) == sorted(new.select(columns).collect())
    assert t.base().count() == 1400
    assert sorted(x.name for x in (tmp_path / "a" / "groups" / "g").iterdir()) == ["v1", "v2"]


def test_a_batch_again_is_no_work(spark, tmp_path):
    t = make(spark, tmp_path / "a")
    t.receive(frame(spark, 200, 1000), 1)
    before = t.state()
    assert t.receive(frame(spark, 200, 1000), 1) == {"batch.skipped": True}
    assert t.state() == before
    again = engine.SampledTable(spark, str(tmp_path / "a"), "t", settings())
    assert again.state() == before


def test_an_empty_batch_changes_no_sample(spark, tmp_path):
    t = make(spark, tmp_path / "a")
    before = [x.rows for x in t.samples()]
    t.receive(frame(spark, 0), 1)
    assert [x.rows for x in t.samples()] == before and t.state()["rows"] == 1000


def test_actions(spark, tmp_path):
    t = make(spark, tmp_path / "a", relative=0.05, flags=Flags(adaptive=True))
    r = t.receive(frame(spark, 9000, 1000), 1)
    assert "adaptive" in engine.prefixed(r, "sampling.action").values()
    t = make(spark, tmp_path / "b", flags=Flags(force_resample=True), resample="bernoulli")
    assert set(engine.prefixed(t.receive(frame(spark, 100, 1000), 1), "sampling.action").values()) == {"resample"}
    t = make(spark, tmp_path / "c", update="incremental")
    assert set(engine.prefixed(t.receive(frame(spark, 100, 1000), 1), "sampling.action").values()) == {"update"}
    t = make(spark, tmp_path / "d", flags=Flags(skip=True))
    assert not engine.prefixed(t.receive(frame(spark, 100, 1000), 1), "sampling.action")


def test_recorded_sizes_are_stored_sizes(spark, tmp_path):
    t = make(spark, tmp_path / "a", relative=0.05)
    t.receive(frame(spark, 3000, 1000), 1)
    for x in t.samples():
        assert t.store.read(x.at).count() == x.rows


def test_answers_and_statements(spark, tmp_path):
    t = make(spark, tmp_path / "a")
    q = Query("t", "sum", "y", group_by=("g",))
    got = t.approximate(q).join(q.exact({"t": t.base()}).withColumnRenamed("sum", "exact"), "g")
    assert got.where("abs(sum - exact) <= 2 * sum_err").count() == 7
    assert engine.audit(t, q, t.samples()[1]).count() == 7
    assert t.listed().count() == 2 and t.stats().count() == 1
    assert len(t.sql("CREATE 20% SAMPLE OF t", default_column="g")) == 2
    assert t.sql("DROP 20% UNIFORM SAMPLES OF t") == 1
    assert t.sql("SELECT count(*) FROM t").first()[0] == 1000
    assert t.sql("DROP SAMPLES OF t") == 3 and t.samples() == []


def test_restore_needs_a_new_root(spark, tmp_path):
    make(spark, tmp_path / "a")
    with pytest.raises(ValueError):
        make(spark, tmp_path / "a")


def test_stream_equals_batches(spark, tmp_path):
    for i in range(3):
        files.write_delimited(frame(spark, 200, 1000 + 200 * i).coalesce(1), str(tmp_path / f"part{i}"))
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i in range(3):
        next((tmp_path / f"part{i}").glob("part-*.csv")).rename(inbox / f"{i}.csv")
    t = make(spark, tmp_path / "a")
    for _ in range(2):  # the second finds nothing new
        ingest.into(ingest.file_batches(spark, str(inbox), SCHEMA), t, str(tmp_path / "ck")).awaitTermination()
    assert t.state()["batch"] == 3 and t.state()["rows"] == 1600
    u = next(x for x in t.samples() if x.kind == "uniform")
    assert t.store.read(u.at).select("id").exceptAll(sampling.uniform(frame(spark, 1600), 1600, u.rows, 42, ["id"]).select("id")).count() == 0


def test_samples_keep_their_size(spark, tmp_path):
    """Ten batches that each bring a new stratum: the targets stay, and so do the sizes, within what one cap more or less makes."""
    t = make(spark, tmp_path / "a", relative=10.0)
    first = {x.id: x.rows for x in t.samples()}
    for i in range(1, 11):
        t.receive(spark.range(1000 + 100 * i, 1100 + 100 * i).select("id", F.lit(6 + i).cast("long").alias("g"), F.lit(1.0).alias("y")), i)
    now = {x.id: x for x in t.samples()}
    assert {x.target for x in now.values()} == {100}
    for x in now.values():
        assert x.rows == first[x.id] if x.kind == "uniform" else x.rows > 100 - 17 or x.rows == 170  # ten rows of each stratum at least
    assert t.sql("DROP 10% UNIFORM SAMPLES OF t") == 1 and t.sql("DROP 10% STRATIFIED SAMPLES OF t") == 1
    assert t.state()["groups"] == {} and not (tmp_path / "a" / "groups" / "g").exists()


def test_a_crash_keeps_the_last_state(spark, tmp_path, monkeypatch):
    """A run that dies between writing the new pointer and renaming it, or before, leaves the old state; the batch can come again."""
    t = make(spark, tmp_path / "a")
    before, store = t.state(), t.store
    path = type(store)._path

    class Dying:
        def __init__(self, fs):
            self.fs = fs

        def rename(self, *a):
            raise OSError("died")

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(type(store), "_path", lambda self, at: (Dying(path(self, at)[0]), path(self, at)[1]) if at.endswith(".part") else path(self, at))
    with pytest.raises(OSError):
        t.receive(frame(spark, 200, 1000), 1)
    monkeypatch.undo()
    again = engine.SampledTable(spark, str(tmp_path / "a"), "t", settings())
    assert again.state() == before and again.base().count() == 1000
    again.receive(frame(spark, 200, 1000), 1)
    assert again.base().count() == 1200 and again.state()["rows"] == 1200


def test_sources_count_for_themselves(spark, tmp_path):
    t = make(spark, tmp_path / "a")
    t.receive(frame(spark, 2, 1000), 0, "stream")
    assert t.state()["rows"] == 1002
    assert t.receive(frame(spark, 2, 1000), 0, "stream") == {"batch.skipped": True}
    assert t.receive(frame(spark, 2, 1000), 0) == {"batch.skipped": True}


def test_files_by_name(spark, tmp_path):
    """In the order of names, not of times; a second call goes on."""
    (tmp_path / "in").mkdir()
    for name, i in (("b", 1100), ("a", 1000), ("c", 1200)):
        (tmp_path / "in" / f"{name}.csv").write_text("".join(f"{k},1,1.0\n" for k in range(i, i + 10)))
    t = make(spark, tmp_path / "a")
    folder = str(tmp_path / "in")
    assert [r["batch.rows"] for r in ingest.by_name(t, folder, SCHEMA, files=2, most=1)] == [20]
    assert t.base().where("id >= 1200").count() == 0
    assert [r["batch.rows"] for r in ingest.by_name(t, folder, SCHEMA, files=2)] == [10]
    assert ingest.by_name(t, folder, SCHEMA) == [] and t.state()["rows"] == 1030


def test_late_and_renamed_files(spark, tmp_path, monkeypatch):
    """A late file of a smaller name is read, a renamed one isn't again, one that a dead batch had is; the manifest stays few files."""
    (tmp_path / "in").mkdir()
    put = lambda name, i: (tmp_path / "in" / f"{name}.csv").write_text(f"{i},1,1.0\n" * 3)
    t, folder = engine.SampledTable(spark, str(tmp_path / "a"), "t", settings()), str(tmp_path / "in")
    monkeypatch.setattr(ingest.Manifest, "MOST", 3)
    put("m", 1)
    ingest.by_name(t, folder, SCHEMA)
    put("c", 20)
    assert len(ingest.by_name(t, folder, SCHEMA)) == 1 and t.state()["rows"] == 6
    (tmp_path / "in" / "c.csv").rename(tmp_path / "in" / "z.csv")
    assert ingest.by_name(t, folder, SCHEMA) == []
    put("d", 300)
    with monkeypatch.context() as m:
        m.setattr(engine.Store, "switch", lambda *_: (_ for _ in ()).throw(OSError("dead")))
        with pytest.raises(OSError):
            ingest.by_name(t, folder, SCHEMA)
    for i in range(6):
        put(f"a{i}", 1000 + i * 1000)
    assert len(ingest.by_name(t, folder, SCHEMA)) == 7 and t.state()["rows"] == 27 and ingest.by_name(t, folder, SCHEMA) == []
    assert len(t.state()["taken"][f"{folder}#"]["parts"]) <= 3


def test_columns_and_ids_that_differ(spark, tmp_path):
    """A further column is null before, a missing one after; another type and ids of another kind are errors."""
    t = make(spark, tmp_path / "a")
    t.receive(frame(spark, 10, 1000).withColumn("more", F.lit("x")), 1)
    t.receive(frame(spark, 10, 2000), 2)
    assert {tuple(r) for r in t.base().groupBy("more").count().collect()} == {(None, 1010), ("x", 10)} and t.base().columns == ["id", "g", "y", "more"]
    assert all("more" in t.store.read(x.at).columns for x in t.samples())
    with pytest.raises(ValueError, match="column y"):
        t.receive(frame(spark, 10, 3000).withColumn("y", F.lit("text")), 3)
    with pytest.raises(ValueError, match="ids of"):
        t.receive(frame(spark, 10, 3000), "three")
    assert t.state()["rows"] == 1020


def test_batches_are_folded(spark, tmp_path):
    """Twenty batches are few folders that hold each row once; who has read the last state still reads it; a state of before folds on."""
    t = engine.SampledTable(spark, str(tmp_path / "a"), "t", settings(fold=3))
    for i in range(20):
        before = t.base().withColumn("n", F.lit(1)) if i else None
        t.receive(frame(spark, 5, 5 * i), i)
        assert before is None or before.count() == 5 * i
    s = t.state()
    assert len(s["batches"]) <= 6 and t.base().select("id").distinct().count() == t.base().count() == 100
    there = {f"base/{x.name}" for x in (tmp_path / "a" / "base").iterdir()}
    assert there == {*s["batches"], *s["replaced"]} and len(there) <= 9


def test_fast_draws(spark, tmp_path):
    t = make(spark, tmp_path / "a", fast=True)
    t.receive(frame(spark, 200, 1000), 1)
    u = next(x for x in t.samples() if x.kind == "uniform")
    new = sampling.uniform(frame(spark, 1200), 1200, u.rows, keyed.Fast(42), ["id"])
    columns = [c for c in new.columns if c != sampling.THRESHOLD]  # any number between the last row drawn and the next
    assert sorted(t.store.read(u.at).select(columns).collect()) == sorted(new.select(columns).collect())


def test_socket_lines(spark, tmp_path):
    s = socket.create_server(("127.0.0.1", 0))

    def serve():
        c, _ = s.accept()
        c.sendall(b"1,2,3.5\n2,3,4.5\n")
        c.recv(1)

    threading.Thread(target=serve, daemon=True).start()
    rows = ingest.socket_lines(spark, "127.0.0.1", s.getsockname()[1], SCHEMA)
    q = rows.writeStream.format("memory").queryName("lines").start()
    try:
        for _ in range(50):
            q.processAllAvailable()
            if spark.table("lines").count() == 2:
                break
        assert sorted(tuple(r) for r in spark.table("lines").collect()) == [(1, 2, 3.5), (2, 3, 4.5)]
    finally:
        q.stop()


def test_sources(spark, tmp_path):
    (tmp_path / "x.tbl").write_text("1|AFRICA|c|\n2|ASIA|d||\n")
    files.clean_delimited(spark, str(tmp_path / "x.tbl"), str(tmp_path / "y"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "y")).collect()) == ["1|AFRICA|c", "2|ASIA|d|"]
    (tmp_path / "region.tbl").write_text("0|AFRICA|c\n")
    r = files.read_delimited(spark, str(tmp_path / "region.tbl"), files.TPCH["region"], "|")
    assert r.first() == (0, "AFRICA", "c")
    assert files.json_rows(spark.createDataFrame([(1, None)], "a int, b string")).first()[0] == '{"a":1,"b":null}'
    p = spark.createDataFrame([("01", None, 2.5)], "time string, q1 string, q2 double")
    files.write_results(p, str(tmp_path / "r"))
    assert files.read_results(spark, str(tmp_path / "r"), "time string, q1 string, q2 double").collect() == p.collect()


def test_sql_texts_are_answered_from_samples(spark, tmp_path):
    """Aggregates come with errors, in the text's columns and order; what a sample can't tell is exact."""
    t = make(spark, tmp_path / "a")
    spark.range(7).selectExpr("id AS k", "id % 2 AS odd").createOrReplaceTempView("dim")
    r = t.sql("SELECT g AS h, avg(y) AS a, count(*) FROM t WHERE y > 10 GROUP BY g ORDER BY h DESC LIMIT 3")
    assert r.columns == ["h", "a", "a_err", "count(1)", "count(1)_err"] and [x["h"] for x in r.collect()] == [6, 5, 4]
    exact = {x[0]: x[1:] for x in t.sql("SELECT g, avg(y), count(*) FROM t WHERE y > 10 GROUP BY g", exact=True).collect()}
    assert all(abs(x["a"] - exact[x["h"]][0]) <= 2 * x["a_err"] for x in r.collect())
    r = t.sql("SELECT odd, 100 * sum(CASE WHEN y > 50 THEN y ELSE 0 END) / sum(y) AS share FROM t JOIN dim ON g = k GROUP BY odd").collect()
    assert len(r) == 2 and all(0 < x["share"] < 100 and x["share_err"] > 0 for x in r)
    for text in ("SELECT count(DISTINCT g) AS n FROM t", "SELECT g, sum(y) AS s FROM t GROUP BY g HAVING s > 0", "SELECT max(y) FROM t", "SELECT * FROM t", "SELECT sum(y) FROM t LEFT JOIN dim ON g = k", "SELECT g + 1, sum(y) FROM t GROUP BY g + 1", "SELECT sum(y) + 1 FROM t"):
        assert sorted(t.sql(text).collect()) == sorted(t.sql(text, exact=True).collect())


def test_pool_is_read_off_plans(spark):
    frame(spark, 5).selectExpr("id AS l_suppkey", "y AS l_quantity", "y AS l_extendedprice").createOrReplaceTempView("lineitem")
    for x in pool() + equality_pool():
        asked = texts.read(spark, x.sql(), "lineitem")
        ((name, got),) = asked.queries
        assert (name, got.agg, got.value, got.group_by, got.where_columns, got.joins) == (x.name, x.agg, x.value, x.group_by, x.where_columns, ())
        assert (got.where is None) == (x.where is None)


def test_choice_by_error(spark, tmp_path):
    """The smallest sample that meets the bound; the most precise one if none does; the rule of columns where nothing can be predicted."""
    t = engine.SampledTable(spark, str(tmp_path / "a"), "t", settings())
    t.receive(frame(spark, 4000), 0)
    for x in ("40% UNIFORM SAMPLE OF t", "3% STRATIFIED SAMPLE OF t ON g", "10% UNIFORM SAMPLE OF t"):
        t.sql(f"CREATE {x}")
    taken = lambda **more: aqp.by_error(Query("t", "avg", "y", **more), t.registered(moments=True))
    assert taken(error_bound=0.2).rows < 400 and taken(error_bound=0.08).rows == 400
    assert taken(error_bound=0.0001).rows == taken(error_bound=0.04).rows == 1600
    assert taken(group_by=("g",), error_bound=0.5).kind == "stratified"
    assert aqp.by_error(Query("t", "avg", "y * 2", error_bound=0.1), t.registered(moments=True)) is None
    x = t.approximate(Query("t", "avg", "y", error_bound=0.04)).first()
    assert x[1] / x[0] < 0.045
    t.receive(frame(spark, 100, 4000), 1)
    assert t.approximate(Query("t", "count", "y", "y > 50", where_columns=("y",), error_bound=0.1)).first()[1] > 0


def test_universe_samples_join(spark, tmp_path):
    """Two facts sampled by the key that joins them: the sum over the join within its error, kept up by batches, null keys apart."""
    a = engine.SampledTable(spark, str(tmp_path / "a"), "a", settings())
    b = engine.SampledTable(spark, str(tmp_path / "b"), "b", engine.Settings(["k"], columns=["z"]))
    left = spark.range(6000).selectExpr("id", "IF(id % 50 = 0, NULL, id % 1500) AS key", "CAST(id % 13 AS double) AS y", "id % 3 AS g")
    right = spark.range(1400).selectExpr("id AS k", "CAST(id % 7 AS double) AS z")
    a.receive(left.where("id < 4000"), 0)
    a.sql("CREATE 30% UNIVERSE SAMPLE OF a ON key")
    a.receive(left.where("id >= 4000"), 1)
    b.receive(right, 0)
    b.sql("CREATE 20% UNIVERSE SAMPLE OF b ON k")
    x = Query("a", "sum", "y * z", "z > 1", ("g",), joins=(Join("b", "key", "k"),))
    got = {r["g"]: (r["sum"], r["sum_err"]) for r in a.joined(x, [b]).collect()}
    want = {r["g"]: r["sum"] for r in x.exact({"a": left, "b": right}).collect()}
    assert set(got) == set(want) and all(abs(got[g][0] - want[g]) <= 1.5 * got[g][1] < want[g] for g in want)
    new = sampling.universe(left, "key", 0.3, 42, ["id"])
    assert sorted(a.store.read(a.samples()[0].at).select("id").collect()) == sorted(new.select("id").collect())
    with pytest.raises(LookupError):
        b.joined(Query("b", "count", "z", joins=(Join("a", "z", "y"),)), [a])
