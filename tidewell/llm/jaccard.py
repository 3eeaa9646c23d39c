"""Groups of rows whose sets are similar: exact links among the members of candidate buckets, without the pairs of a bucket.

Buckets come from a sketch (bands of MinHash, bits of SimHash): (key, row). What is asked for is which rows hang together by links of a
least Jaccard similarity, so most pairs of a bucket never have to be looked at:

1. *Stars*, in buckets over ``STAR_ROWS`` rows. In each round their members are held against one of them, the representative, which is the
   same in all buckets of the same rows; a link is confirmed on the two whole sets. A large group of near copies falls together at
   one pair a member.
2. *What is left*, buckets whose members are still of several components, is decided inside tasks to which short forms of the sets
   go, which never miss a link; the links that they tell are confirmed on the whole sets, and a bucket of which one is refuted is decided by whole sets: first a share of the buckets, which joins most rows that meet in many of them, then all that are left. Buckets of the same members are one. In a task a prefix filter takes out the rows that can't be similar to any other: in
   one order of elements, the rarest of the bucket first, two similar sets share one of their first n - ceil(n * least) + 1. The
   others' intersections are counted by products of 0/1 blocks, and links are joined at once, so a task gives a row less than it has, never pairs.
   Buckets over ``PART_ROWS`` rows or ``PART_ELEMENTS`` elements are split, and each two parts meet in a task.

Joins on rows that many pairs share have written tables on both sides, so that Spark can split a skewed key (AQE).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: One in so many of the buckets is decided before the others.
SHARE = 4
#: Rounds of stars, and the rows beyond which a bucket takes part; most rows and elements of one part of a bucket.
ROUNDS, STAR_ROWS, PART_ROWS, PART_ELEMENTS = 2, 64, 1024, 1 << 19
#: Most rows and bytes, as text, of row numbers that are sent to every executor.
ASKED_ROWS, ASKED_BYTES = 1_000_000, 64 << 20
#: Elements of a set up to which its short form has 16 bits of each, and 32 beyond.
SHORT_ROWS = 1024
#: Rows and columns of a block of the products.
BLOCK, WIDTH = 512, 4096

def enough(shared: np.ndarray | int, sizes: np.ndarray | int, num: int, den: int) -> np.ndarray | bool:
    """Whether sets whose sizes add up so have the similarity num / den with so many elements in common."""
    return shared * (num + den) >= num * sizes


class Forest:
    """Union-find; the smallest place is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def linked(comps: np.ndarray, side: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets of different components, as places (i, root); with both sides present
    only links across them count. Sets are sorted and distinct."""
    if len(sets) == 2:
        both = np.sort(np.concatenate(sets), kind="stable")
        ok = comps[0] != comps[1] and enough(int(np.count_nonzero(both[1:] == both[:-1])), len(both), num, den)
        return [(1, 0)] if ok else []
    size = np.array([len(s) for s in sets], np.int64)
    doc = np.repeat(np.arange(len(sets)), size)
    _, element, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # the prefix filter
    order = np.lexsort((element, seen[element], doc))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    first = place < np.repeat(size - -(-num * size // den) + 1, size)
    prefix, owner = element[order][first], doc[order][first]
    shared = np.bincount(prefix, minlength=len(seen))[prefix] > 1
    live = np.unique(owner[shared])
    if len(live) < 2:
        return []
    live = live[np.argsort(size[live], kind="stable")]
    local = np.full(len(sets), -1)
    local[live] = np.arange(len(live))
    # elements of two rows or more, in the rows that are left
    keep = local[doc] >= 0
    doc, element = local[doc[keep]], element[keep]
    often = np.bincount(element, minlength=len(seen)) > 1
    number = np.cumsum(often) - 1
    keep = often[element]
    doc, column = doc[keep], number[element[keep]]
    order = np.lexsort((column, doc // BLOCK, column // WIDTH))
    doc, column = doc[order], column[order]
    n, blocks, wides = size[live], -(-len(live) // BLOCK), -(-(int(number[-1]) + 1) // WIDTH)
    cell = (column // WIDTH) * blocks + doc // BLOCK
    edges = np.searchsorted(cell, np.arange(wides * blocks + 1))
    comp, part, both = comps[live], side[live], side.any()
    forest = Forest(len(sets))

    def dense(wide: int, b: int) -> np.ndarray:
        a, z = edges[wide * blocks + b], edges[wide * blocks + b + 1]
        out = np.zeros((min(BLOCK, len(live) - b * BLOCK), WIDTH), np.float32)
        out[doc[a:z] - b * BLOCK, column[a:z] - wide * WIDTH] = 1
        return out

    for p in range(blocks):
        for q in range(p, blocks):
            i, j = slice(p * BLOCK, (p + 1) * BLOCK), slice(q * BLOCK, (q + 1) * BLOCK)
            if n[i][-1] * den < n[j][0] * num or (p == q and len(set(comp[i].tolist())) == 1):  # sizes grow with places
                continue
            count = np.zeros((len(n[i]), len(n[j])), np.float32)
            for wide in range(wides):
                x = dense(wide, p)
                if x.any():
                    count += x @ (x if p == q else dense(wide, q)).T
            hit = enough(count.astype(np.int64), n[i][:, None] + n[j][None, :], num, den) & (comp[i][:, None] != comp[j][None, :])
            if both:
                hit &= part[i][:, None] != part[j][None, :]
            for a, b in np.argwhere(hit).tolist():
                forest.join(int(live[p * BLOCK + a]), int(live[q * BLOCK + b]))
    return [(i, r) for i in range(len(sets)) if (r := forest.root(i)) != i]


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v), u > v: the written pairs (a, b) whose whole sets have the similarity, written."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((s, t)), kind="stable")
                ok.append(enough(int(np.count_nonzero(both[1:] == both[:-1])), len(s) + len(t), num, den))
            u, v = (b.column(k).to_numpy()[np.array(ok, bool)] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    few = asked(sets, pairs.select(F.col("a").alias("row")).union(pairs.select("b")))
    one = few.select(F.col("row").alias("b"), F.col("s").alias("t"))
    both = pairs.join(one, "b").join(few.select(F.col("row").alias("a"), "s"), "a").select("a", "b", "s", "t")
    return common.kept(both.mapInArrow(common.tidy(decide), "u long, v long"), "links")


def asked(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """The sets of these rows: filtered where they lie if the rows are counted to few enough, so that the others aren't shuffled."""
    few = common.kept(rows.distinct(), "asked")
    return sets.join(F.broadcast(few), "row", "left_semi") if common.small(few, ASKED_ROWS, ASKED_BYTES) else sets


def with_components(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("comp", F.col("row"))
    return members.join(roots.withColumnRenamed("node", "row"), "row", "left").select("key", "row", "n", F.coalesce("root", "row").alias("comp"))


def buckets(known: DataFrame, mask: Column) -> DataFrame:
    """(key, rows, elements, a, d, e) of the buckets that have members of two components or more, written: a is the representative
    by this mask, d and e tell which members there are."""
    digest = lambda k: F.bit_xor(F.xxhash64("row", F.lit(k)))
    by = known.groupBy("key").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("n").cast("long")).alias("elements"), F.min(F.col("row").bitwiseXOR(mask)).alias("a"),
        F.min("comp").alias("x"), F.max("comp").alias("y"), digest(0).alias("d"), digest(1).alias("e"),
    )
    return common.kept(by.where("x <> y").select("key", "rows", "elements", F.col("a").bitwiseXOR(mask).alias("a"), "d", "e"), "buckets")


def starred(known: DataFrame, large: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): the confirmed links of the large buckets' members with their representatives, written."""
    heads = large.select("a").distinct().join(known.select(F.col("row").alias("a"), F.col("n").alias("a_n"), F.col("comp").alias("a_comp")).distinct(), "a")
    met = known.join(common.kept(large.select("key", "a").join(heads, "a"), "heads"), "key").where("comp <> a_comp")
    near = met.where(F.least("n", "a_n") * den >= F.greatest("n", "a_n") * num).select("a", F.col("row").alias("b")).distinct()
    return confirmed(common.kept(near, "pairs"), sets, num, den)


def short(s: np.ndarray) -> bytes:
    """The last bits of a set's hashes, 16 of up to SHORT_ROWS and 32 of more, sorted."""
    return np.sort(s.astype(np.uint16 if len(s) <= SHORT_ROWS else np.uint32)).tobytes()


def numbered(values: np.ndarray) -> np.ndarray:
    """Sorted values as a set: each with how often it came before. Two sets of hashes have at most as many elements in common as their
    short forms' numbered values, so what those can't link isn't linked."""
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    before = np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))
    return values.astype(np.uint64) << np.uint64(24) | before.astype(np.uint64)


def maybe_linked(comps: np.ndarray, side: np.ndarray, sizes: np.ndarray, shorts: list, num: int, den: int) -> list[tuple[int, int]]:
    """linked() of the short forms: of sets of up to SHORT_ROWS with those that are in reach of them by 16 bits, of larger ones by 32."""
    out = []
    for bits, mine in ((16, sizes * num <= SHORT_ROWS * den), (32, sizes > SHORT_ROWS)):
        at = np.flatnonzero(mine)
        if len(at) < 2 or (bits == 16 and sizes[at].min() > SHORT_ROWS):
            continue
        own = []
        for k in at.tolist():
            v = np.frombuffer(shorts[k].as_buffer(), np.uint16 if sizes[k] <= SHORT_ROWS else np.uint32)
            own.append(numbered(v if bits == 32 or sizes[k] <= SHORT_ROWS else np.sort(v.astype(np.uint16))))
        out += [(int(at[i]), int(at[j])) for i, j in linked(comps[at], side[at], own, num, den)]
    return out


def dealt_sets(dealt: DataFrame, sets: DataFrame, num: int, den: int, brief: bool) -> DataFrame:
    """(key, u, v), written: links between the rows (key, i, j, side, row, comp; written) of equal keys, by their sets or, brief, by short forms."""
    few = asked(sets, dealt.select("row"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in every], pa.int32()), pa.array([short(s) for s in every], pa.binary())], names=["row", "size", "s"])

    few = few.select("row", "s").mapInArrow(common.tidy(cut), "row long, size int, s binary") if brief else few.select("row", F.lit(0).alias("size"), "s")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.groups(batches, ["key", "i", "j"]):
            row, comp, own = (t[c].to_numpy() for c in ("row", "comp", "side"))
            if brief:
                found = maybe_linked(comp, own, t["size"].to_numpy(), list(t["s"]), num, den)
            else:
                found = linked(comp, own, [np.frombuffer(x.as_buffer(), np.uint64) for x in t["s"]], num, den)
            if found:
                u, v = (row[[x[k] for x in found]] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(t["key"].to_numpy()[:1], len(u))), pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["key", "u", "v"])

    rows = dealt.join(few.hint("merge"), "row")
    return common.kept(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(common.tidy(decide), "key long, u long, v long"), "links")


def in_tasks(known: DataFrame, by: DataFrame, sets: DataFrame, num: int, den: int, part_rows: int, part_elements: int) -> DataFrame:
    """(u, v): links that span what the buckets hold of different components, written. Short forms of the sets, which never miss a link, come
    together first; what links they tell is confirmed on the whole sets, and buckets of which one is refuted are decided by those."""
    parts = F.greatest(F.ceil(F.col("rows") / part_rows), F.ceil(F.col("elements") / part_elements)).cast("int")
    mixed = common.kept(by.groupBy("rows", "elements", "d", "e").agg(F.min("key").alias("key")).select("key", parts.alias("parts")), "mixed")
    rows = known.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    tasks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    side = ((F.col("own") == F.col("t.j")) & (F.col("t.i") != F.col("t.j"))).cast("byte")
    dealt = rows.select("key", "row", "comp", "own", F.explode(tasks).alias("t")).select("key", F.col("t.i").alias("i"), F.col("t.j").alias("j"), side.alias("side"), "row", "comp")
    dealt = common.kept(dealt, "dealt")
    maybe = dealt_sets(dealt, sets, num, den, True)
    links = confirmed(common.kept(maybe.select(F.col("u").alias("a"), F.col("v").alias("b")).distinct(), "pairs"), sets, num, den)
    refuted = common.kept(maybe.join(links.hint("merge"), ["u", "v"], "left_anti").select("key").distinct(), "refuted")
    if not refuted.head(1):
        return links
    again = common.kept(dealt.join(refuted, "key"), "dealt")
    return links.unionByName(dealt_sets(again, sets, num, den, False).select("u", "v"))


def grouped(members: DataFrame, sets: DataFrame, num: int, den: int, components, *, rounds: int = ROUNDS, star_rows: int = STAR_ROWS, part_rows: int = PART_ROWS, part_elements: int = PART_ELEMENTS) -> DataFrame | None:
    """(node, root) for the rows with links, written; None if there is none.

    members: (key, row, n), cheap to make twice, n the size of the row's set; sets: (row, s), written, s the sorted distinct
    hashes of 64 bits. ``components`` makes (node, root) of written links (u, v).
    """
    edges: DataFrame | None = None
    roots: DataFrame | None = None
    several = common.kept(members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "several")
    members = common.kept(members.join(several, "key"), "members")
    known = by = met = None
    for turn, step in enumerate(["stars", "share", *["stars"] * (rounds - 1), "all"] if rounds else ["all"]):
        if by is None:
            known = with_components(members, roots)
            by = buckets(known, F.lit((turn * 0x2545F4914F6CDD1D) & (2**63 - 1)))  # another order of rows, so another representative, in each turn
        large, mine = F.col("rows") > star_rows, by
        if step == "stars" and by is met:  # the same representatives again
            continue
        if step == "stars":
            mine, met = by.where(large), by
        elif step == "share":
            mine = by.where(~large & (F.pmod(F.xxhash64("key"), F.lit(SHARE)) == 0))
        if not mine.head(1):
            continue
        new = starred(known, mine, sets, num, den) if step == "stars" else in_tasks(known, mine, sets, num, den, part_rows, part_elements)
        if new.head(1):
            edges = new if edges is None else edges.unionByName(new)
            roots, by = common.kept(components(edges.distinct()), "roots"), None
    return roots
