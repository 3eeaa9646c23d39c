"""The pipeline's stages read a stored table again and write no copy of its texts; rows of one are told by their places."""

import os
import random
from collections import Counter

import pytest

import corpus_pipeline
from tidewell.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _metadata string"


def corpus():
    rng = random.Random(11)
    texts = [" ".join(f"{rng.getrandbits(48):x}" for _ in range(120)) for _ in range(600)]
    texts += [texts[0], texts[0].upper(), texts[1] + " more", None, None, ""]
    texts += [texts[2] + " token = abcdefgh1", f"{texts[3]} {texts[599]}"]
    return [(None if i % 97 == 5 else i // 2, t, "en", f"s{i % 7}" if i % 50 else None, len(t or ""), "own") for i, t in enumerate(texts)]


def bytes_of(folder):
    return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(folder) for x in names)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_write_no_copy(spark, tmp_path, name):
    stage, rows = dict(corpus_pipeline.STAGES)[name], corpus()
    plain = spark.createDataFrame(rows, SCHEMA)
    plain.repartition(3).write.parquet(at := f"{tmp_path}/a b%20\u00e9/documents.parquet")
    spark.createDataFrame([(0, rows[599][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    begun = len(common._made)
    out = stage(spark, spark.read.parquet(at), str(tmp_path))
    got = Counter(map(tuple, out.collect()))
    written = sum(bytes_of(folder.removeprefix("file://")) for _, folder in common._made[begun:])
    assert written < bytes_of(at) / 3
    want = Counter(map(tuple, stage(spark, plain, str(tmp_path)).collect()))
    alike = lambda rows: Counter((r[0], (r[1] or "").lower().strip(), *r[2:]) for r in rows.elements())  # noqa: E731  of equal words and ids either stays
    assert alike(got) == alike(want)


def test_quality_with_many_hosts(spark, tmp_path, monkeypatch):
    """A stored table is measured twice; its hosts may be too many to broadcast, and no filter makes the measures again inside itself."""
    rows = [(d, f"{t} {t}" if t else t, *x) for d, t, *x in corpus()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(at := f"{tmp_path}/documents.parquet")
    plain, docs = spark.createDataFrame(rows, SCHEMA), spark.read.parquet(at)
    few = Counter(map(tuple, corpus_pipeline.quality(spark, docs, "").collect()))
    monkeypatch.setattr(common, "small", lambda *a, **b: False)
    out = corpus_pipeline.quality(spark, docs, "")
    assert "monotonically_increasing_id" in out._jdf.queryExecution().optimizedPlan().toString()
    assert few == Counter(map(tuple, out.collect())) == Counter(map(tuple, corpus_pipeline.quality(spark, plain, "").collect()))


def test_keys_of_a_stored_table(spark, tmp_path):
    """They are the same each time, whatever the splits; a file that is read twice has two rows for each place, and is copied."""
    spark.range(4000).selectExpr("id AS doc_id", "id % 3 AS p", "'x' AS _ROW").repartition(4).write.option("parquet.block.size", 1024).partitionBy("p").parquet(at := f"{tmp_path}/x y.parquet")
    begun, seen = len(common._made), []
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows, key = common.keyed(spark.read.parquet(at), "t")
        seen.append({r["doc_id"]: r[key] for r in rows.collect()})
        assert rows.columns == ["doc_id", "_ROW", "p", key]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 4000 and len(common._made) == begun
    flat = f"{at}/p=0"
    twice = spark.read.parquet(flat, next(f"{flat}/{x}" for x in os.listdir(flat) if x.endswith(".parquet")))
    assert twice.count() > spark.read.parquet(flat).count()
    for odd in (twice, spark.read.parquet(at).limit(50), spark.read.parquet(at).sample(0.5)):
        rows, key = common.keyed(odd, "t")
        assert rows.select(key).distinct().count() == rows.count() and len(common._made) > begun
        begun = len(common._made)
    rows, key = common.keyed(spark.read.parquet(at).limit(0), "t")
    assert rows.count() == 0
