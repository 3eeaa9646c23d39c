"""What a join may send to every executor."""

import numpy as np
import pyarrow as pa

from tidewell.llm import common, hilbert, jaccard, wavelet
from tidewell.llm.bpe import vocabulary


def test_salted_side_is_never_broadcast(spark):
    """Its file is small, but exploding by salts makes it larger than the planner takes it for."""
    right = common.kept(spark.range(3000).selectExpr("id AS k", "id AS v"), "right")
    left = common.kept(spark.range(6000).selectExpr("if(id < 3000, 7, id - 3000) AS k", "id AS i"), "left")
    joined = common.join_small_or_salted(left, right, "k", rows=0)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    physical = joined._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in physical and "strategy=merge" in plan
    assert {(r["i"], r["v"]) for r in joined.collect()} == {(i, 7 if i < 3000 else i - 3000) for i in range(6000)}


def test_string_borders_come_from_all_rows(spark):
    """Over more rows than the sample had that borders once came from."""
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 'same', concat('é', lpad(cast(id * 7919 % 30000 as string), 6, '0'))) AS v").unionByName(spark.createDataFrame([(None,)], "v string"))
    values = sorted(r["v"].encode() for r in df.where("v is not null").collect())
    assert hilbert.quantised(df, [hilbert.Dimension("v", "string")], 5) == [sorted({values[len(values) * k >> 5] for k in range(1, 32)})]
    assert hilbert.quantised(df.limit(0), [hilbert.Dimension("v", "string")], 5) == [[]]


def test_op4_encodes_a_word_once(monkeypatch):
    """Words of an earlier batch aren't given to the library again, also after all were forgotten."""
    e = wavelet.WordEncoder(vocabulary("word_bpe_49k.json").decode())
    texts = pa.array(["zolo nervin, Alta 12x", "alta zolo. nervin élan", "", "quorb zolo"])
    given, plain = [], e.plain
    monkeypatch.setattr(e, "plain", lambda some: given.extend(some) or plain(some))
    for limit in (1 << 19, 2, 0):
        monkeypatch.setattr(wavelet, "HELD_WORDS", limit)
        for _ in range(2):
            given.clear()
            ids, lengths = e.encode(texts)
            want = [x.ids for x in e.library.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            assert ids.tolist() == sum(want, []) and lengths.tolist() == list(map(len, want))
        assert ("zolo" in " ".join(given).split()) == (limit < 3)


def test_short_forms_never_miss_a_link():
    """op12 sends short forms of sets to the buckets; sizes on both sides of the change from 16 to 32 bits."""
    rng, links = np.random.default_rng(3), 0
    for n in (5, 300, 1000, 1024, 1025, 1270, 1290, 3000):
        for gone in (0.05, 0.19, 0.2, 0.21, 0.4):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = np.sort(a[: len(a) - int(gone * n)])
            pair = [a, b]
            zero, sizes = np.zeros(2, np.int8), np.array([len(x) for x in pair])
            found = jaccard.maybe_linked(np.arange(2), zero, sizes, list(pa.array([jaccard.short(x) for x in pair], pa.binary())), 4, 5)
            exact = jaccard.linked(np.arange(2), zero, pair, 4, 5)
            assert found or not exact
            assert gone < 0.4 or not found
            links += bool(exact)
    assert links > 10
