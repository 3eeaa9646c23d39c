"""Fill-in-middle and Lloyd rounds against their definitions."""

import hashlib
import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_ops import edge  # noqa: F401

from tidewell.llm import fim, lloyd, registry

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
SCHEMA = "doc_id long, text string, _t string, n string, form string, output string, _h1 string"


def transformed(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output), as plainly as can be."""
    t, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    u = UNIT.findall(t)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    x, y, z = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, t
    if h4 % 100 < 20:
        return len(u), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return len(u), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def odd_texts():
    rng = random.Random(5)
    letters = ["a", "Z", "word", " ", "\n", "é", "漢", "🙂", "<", "S>", "P", ">", "0", "\x00", "ﬁ", "́"]
    made = ["".join(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(300)]
    return [None, "", "x", "é", " ", "a" * 50_000, "é🙂" * 30_000, "ab " * 20_000, "has <P> in it", "<M>", "ends with <", "<<S", *made]


@pytest.mark.parametrize("long", [fim.LONG, 0, 20_000])
def test_forms(spark, monkeypatch, long):
    """All texts in batches, all as rows of chunks, and some as either; chunks far smaller than texts."""
    monkeypatch.setattr(fim, "ROW_CHUNK", 1000)
    monkeypatch.setattr(fim.cut_long, "__defaults__", (1000,))
    rows = [(None if i % 9 == 4 else i // 2, t, *["clash"] * 5) for i, t in enumerate(odd_texts())] * 2
    got = fim.transformed(spark.createDataFrame(rows, SCHEMA), long=long).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [(d, t or "", *transformed(d, t), t or "") for d, t, *_ in rows]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((d, t, *o, b) for d, t, *o, b in want), key=repr)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 14])
def test_chunks_give_the_same_cuts(chunk):
    texts = [(t or "").encode() for t in odd_texts() if len(t or "") < 1000]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(0, 1 << 32, len(texts)) for _ in range(2))
    n, p, m = fim.cut_batch(data, offsets, h1, h2, chunk)
    for i, t in enumerate(texts):
        u = UNIT.findall(t.decode())
        a, b = sorted((int(h1[i]) % (len(u) + 1), int(h2[i]) % (len(u) + 1)))
        assert (n[i], p[i], m[i]) == (len(u), len("".join(u[:a])), len("".join(u[:b])))


def test_op11_whole_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {d: (*(x := transformed(d, t))[:4], sha(x[4]), sha(t or "")) for d, t in docs}
    assert {r[0]: tuple(r[1:]) for r in registry.queries()["op11_fim_chunks"](spark, sf).collect()} == want


def lloyd_by_hand(rows, k=40, rounds=5):
    import math

    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (key(r[0]), r[1]))[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    near = lambda v: min((far(v, w), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        new = []
        for j, w in enumerate(c):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            new.append([sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else w)
        c = new
    last = [(i, *near(v)[::-1]) for i, v in kept]
    by = {j: sum(d for _, o, d in last if o == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return [(i, j, d, by[j], sum(by.values()), sha[j]) for i, j, d in last]


@pytest.mark.parametrize("name", ["sf", "edge"])
def test_op13_by_hand(spark, request, name):
    import pyarrow.parquet as pq

    folder = request.getfixturevalue(name)
    t = pq.read_table(f"{folder}/embeddings.parquet")
    want = lloyd_by_hand(list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True)))
    got = registry.queries()["op13_lloyd"](spark, folder).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(got) > 60


def test_few_vectors_and_great_ones(spark):
    big = 1.0 * lloyd.MOST
    rows = [(2**60 + 1, [big] * 64), (None, [-big] * 64), (3, [big * 2] * 64), (2**60 + 1, [big] * 64)]
    out, c = lloyd.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, out.collect()), key=repr)
    assert len(c) == 3 and [r[0] for r in got] == [2**60 + 1, 2**60 + 1, None] and {r[2] for r in got} == {0}
    assert (lloyd.distances(np.array([[256 * lloyd.MOST] * 64]), np.array([[-256 * lloyd.MOST] * 64])) == (2 * 256 * lloyd.MOST) ** 2 * 64).all()
