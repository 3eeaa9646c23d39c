"""The pipeline's near-dedup stage against brute-force Jaccard."""

import random

import corpus_pipeline
from tidewell.llm import simhash

SCHEMA = "doc_id long, text string"


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def survivors(docs):
    """Ids that stay: of each group of Jaccard 0.8 or more the smallest."""
    ids, sets, up = [d for d, _ in docs], [shingle_set(t) for _, t in docs], list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted(least.values())


def edited(words, rng, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"e{rng.random()}"
    return words


def corpus(copies):
    rng = random.Random(7)
    texts = []
    for b in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(80, 160))]
        texts += [base, *(edited(base, rng, n) for n in (1, 1, 2, 2, 3, 4, 5, 8))]
    base = [f"h{rng.randrange(5000)}" for _ in range(100)]
    texts += [edited(base, rng, rng.randrange(0, 4)) for _ in range(copies)]
    texts += [["a", "b"], ["A", "b"], [], []]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_near_dedup_is_jaccard(spark):
    docs = corpus(100)
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, SCHEMA), "")
    assert sorted(r["doc_id"] for r in got.collect()) == survivors(docs)
    assert len(survivors(docs)) < len(docs)


def test_tables_reach_the_recall():
    for n in (10, 10**4, 10**6, 10**9):
        tables = simhash.tables_for(n)
        width = len(tables[0])
        assert 1 - (1 - (1 - simhash.BIT_DIFFERENCE) ** width) ** len(tables) >= simhash.RECALL
        assert n / 2**width <= max(4, n**0.3)


def test_wide_prints_differ_as_sets_do():
    import numpy as np

    rng = np.random.default_rng(1)
    far = []
    for _ in range(200):
        s = rng.integers(0, 1 << 63, 220).astype(np.uint64)
        a, b = (int.from_bytes(simhash.wide_print(np.unique(x)), "little") for x in (s[:200], s[20:]))  # similarity 180 / 220
        far.append((a ^ b).bit_count())
    assert np.mean(np.array(far) <= simhash.WIDE_RADIUS) >= 0.98 and abs(np.mean(far) / (64 * simhash.WIDE) - 0.145) < 0.02


def test_verdicts_are_by_row(spark, tmp_path):
    """Null and repeated ids: one row of a group stays, each leaking row goes, and no other row of the same id."""
    rng = random.Random(3)
    a, b, c, d, e, f = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(6))
    rows = [(1, a), (1, a), (None, a), (None, b), (None, b), (2, c), (3, c), (3, d), (None, e), (5, e), (5, f), (None, f)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, a), (None, b), (2, c), (3, d), (5, e), (5, f)], key=repr)
    spark.createDataFrame([(0, a)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{b} {a}"), (None, b), (1, f"{a} {c}"), (1, c), (1, c), (2, None), (None, None)]
    got = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None, b), (1, c), (1, c), (2, None), (None, None)], key=repr)


def test_near_groups_hang_together():
    """Groups of heads are the components of the graph of near heads; far ones are in none; large shards are one."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (9, 2)).astype(np.uint64)
    heads = np.array([[x ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for x in map(int, base[rng.integers(0, 9)])] for _ in range(60)] + [[0, 0], [2**64 - 1, 2**64 - 1]], np.uint64)
    for radius in (3, 6, 8):
        far = np.bitwise_count(heads[:, None] ^ heads[None]).sum(axis=2)
        up = list(range(62))
        for _ in range(62):
            up = [min(up[j] for j in range(62) if far[i, j] <= radius) for i in range(62)]
        got = simhash.near_groups(heads, radius)
        assert [g >= 0 for g in got] == [(far[i] <= radius).sum() > 1 for i in range(62)]
        pairs = [(i, j) for i in range(62) for j in range(62) if got[i] >= 0 and got[j] >= 0]
        assert all((got[i] == got[j]) == (up[i] == up[j]) for i, j in pairs)
        assert ((simhash.near_any(heads, radius)) == (got >= 0)).all()
