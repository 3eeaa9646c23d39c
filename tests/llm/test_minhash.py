"""Circulant MinHash and the exact links inside buckets, against brute force."""

import random

import numpy as np
import pytest

from tidewell.llm import common, jaccard, minhash, registry, simhash

SCHEMA = "doc_id long, text string, row string, key string, s string"


def shingles(text, k=2):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(sets, similar):
    """The least place of each place's component."""
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(sets))]


def near(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 80 * (len(a) + len(b) - both)


def by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    own = components(sets, near)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[own[i]] = min(d, least.get(own[i], d))
    name = [least.get(own[i]) if sets[i] else rows[i][0] for i in range(len(rows))]
    return [(d, len(s), c, d is not None and d == c) for (d, _), s, c in zip(rows, sets, name, strict=True)]


def edited(words, rng, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"e{rng.random()}"
    return words


def corpus(seed=2):
    rng = random.Random(seed)
    texts = []
    for n in (20, 40, 80, 150, 300):
        base = [f"w{rng.randrange(900)}" for _ in range(n)]
        texts += [base] * 3 + [edited(base, rng, k) for k in range(1, max(2, n // 8))]
    template = [f"t{i}" for i in range(120)]
    texts += [edited(template, rng, rng.randrange(4, 16)) for _ in range(120)]
    texts += [[], [], ["a"], ["A"], ["a", "b"], ["b", "a"], ["a", "b", "a", "b"], ["İ", "É"], ["İ", "é"]]
    rng.shuffle(texts)
    rows = [(None if i % 17 == 3 else i // 2 if i % 5 == 0 else i, "  \t".join(t)) for i, t in enumerate(texts)]
    return [*rows, (7, None), (None, None), (8, " \n")]


def test_groups_equal_brute_force(spark):
    rows = corpus()
    got = minhash.near_duplicates(spark.createDataFrame([(d, t, "clash", "clash", "clash") for d, t in rows], SCHEMA)).collect()
    want = [(d, n, c) for d, n, c, _ in by_hand(rows)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_op12_by_hand(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, registry.queries()["op12_circulant_minhash"](spark, sf).collect())) == sorted(by_hand(docs))


def test_signatures_agree_as_sets_do():
    rng = np.random.default_rng(1)
    for similarity in (0.3, 0.8, 0.95):
        n = 400
        both = round(2 * n * similarity / (1 + similarity))
        agree = []
        for _ in range(40):
            x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            agree.append(np.mean(minhash.signature(np.unique(x[:n])) == minhash.signature(np.unique(x[n - both :]))))
        assert abs(np.mean(agree) - similarity) < 0.02
        bands = 1 - (1 - similarity**minhash.BAND_ROWS) ** minhash.BANDS
        assert similarity < 0.8 or bands > 0.99999


def test_signature_bits_tell_who_is_near():
    """Pairs of 0.8 differ in no more than RADIUS bits of 128 save with a chance of one in 100,000; unrelated ones nearly always do."""
    from math import comb

    beyond = sum(comb(128, k) * 0.1**k * 0.9 ** (128 - k) for k in range(minhash.RADIUS + 1, 129))
    assert beyond < 1e-5
    rng = np.random.default_rng(2)
    far = {0.8: [], 0.3: []}
    for similarity, seen in far.items():
        n, both = 400, round(800 * similarity / (1 + similarity))
        for _ in range(60):
            x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = (minhash.signature(np.unique(y))[:128] & 1 for y in (x[:n], x[n - both :]))
            seen.append(int((a != b).sum()))
    assert max(far[0.8]) <= minhash.RADIUS and np.mean(np.array(far[0.3]) > minhash.RADIUS) > 0.9


def test_permutations_are_bijections_and_shifts_circular():
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    assert len(np.unique(minhash.permute(x.copy(), minhash.PI))) == len(np.unique(x))
    h = np.array([(2**32 - 1) << 32, 5 << 32], np.uint64)
    sigma = minhash.permute((h >> np.uint64(32)).astype(np.uint32), minhash.SIGMA)
    want = [min(int(minhash.permute(np.array([(int(s) + k) % 2**32], np.uint32), minhash.PI)[0]) for s in sigma) for k in range(9)]
    assert minhash.signature(h, 9).tolist() == want
    long = np.arange(5000, dtype=np.uint64) << np.uint64(32)
    assert (minhash.signature(long) == np.minimum(minhash.signature(long[:2600]), minhash.signature(long[2600:]))).all()


def sets_of(seed, n, size=60):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 62, size, dtype=np.uint64)
    out = []
    for _ in range(n):
        k = int(rng.integers(0, size // 2))
        out.append(np.unique(np.concatenate((base[k:], rng.integers(0, 1 << 62, int(rng.integers(0, 12)), dtype=np.uint64), rng.choice(base, 3)))))
    return out


@pytest.mark.parametrize(("block", "width"), [(512, 4096), (3, 7)])
def test_links_in_a_task(monkeypatch, block, width):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "WIDTH", width)
    similar = lambda a, b: 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
    for seed in range(12):
        sets = sets_of(seed, 25)
        comps = np.arange(25)
        up = list(range(25))
        for i, r in jaccard.linked(comps, np.zeros(25, np.int8), sets, 4, 5):
            up[i] = r
        assert up == components(sets, similar)
        # across two sides only
        side = np.arange(25, dtype=np.int8) % 2
        got = {i for x in jaccard.linked(comps, side, sets, 4, 5) for i in x}
        want = {i for a in range(25) for b in range(25) if side[a] != side[b] and similar(sets[a], sets[b]) for i in (a, b)}
        assert got == want


def test_rounds_and_parts_lose_no_link(spark, tmp_path):
    """One bucket of all rows, whatever is left to the tasks and however it is split."""
    sets = sets_of(3, 60)
    rows = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "row long, s binary")
    rows = common.kept(rows, "test")
    members = rows.selectExpr("explode(array(0L, 1L)) AS key", "row", "cast(octet_length(s) / 8 AS int) AS n")
    want = components(sets, lambda a, b: 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)))
    for rounds, part_rows, part_elements in ((0, 1024, 1 << 19), (0, 7, 1 << 19), (1, 1024, 300), (3, 1024, 1 << 19)):
        found = jaccard.grouped(members, rows, 4, 5, simhash.components, rounds=rounds, star_rows=5, part_rows=part_rows, part_elements=part_elements)
        roots = {r["node"]: r["root"] for r in found.collect()}
        assert [roots.get(i, i) for i in range(60)] == want


def test_a_template_costs_few_pairs(spark, monkeypatch):
    """300 texts of one template, hardly any two similar: a pair for a member and large bucket at most, and rows only for links from tasks."""
    rng = random.Random(4)
    template = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join(edited(template, rng, 15))) for i in range(300)]
    made = []
    kept = common.kept
    monkeypatch.setattr(common, "kept", lambda df, tag: (out := kept(df, tag), made.append((tag, out.count())) if tag in ("pairs", "links") else None)[0])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(r[:3] for r in by_hand(rows))
    assert sum(n for _, n in made) < 300 * minhash.BANDS / 2 < 300 * 299 / 2 / 9
