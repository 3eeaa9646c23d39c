"""SimHash near-duplicates: fingerprints, linked within a Hamming radius through BK-trees, joined into groups.

*By fingerprints alone* (``near_duplicates``):

1. A 64-bit fingerprint per document, in Arrow batches.
2. Distinct fingerprints only, so copies cost one row, and rows without an id count like any other.
3. Shards: two fingerprints at radius r or less agree on at least b - r of b bit blocks, so each fingerprint goes to one
   shard for each choice of b - r blocks and no link is lost; b grows with the number of fingerprints. The fingerprints of
   shards over ``tree_rows`` are sharded once more, all together, by longer keys; only what is dense even then is split into
   parts, of which each pair is a task: a tree of one part, which the other part's fingerprints search.
4. In a task a BK-tree keeps children by their integer distance to the parent; a search follows the edges within the
   radius only. Links are joined at once in a union-find, so a task gives at most one link per fingerprint, never pairs.
5. Groups: alternating large-star and small-star rounds (Kiveris et al. 2014) until nothing changes. What a round
   makes is written to the shared folder.

*Verified* (``similar_groups``), for a similarity whose fingerprints differ in too many bits for blocks: fingerprints of 512
bits; each of a number of tables deals their heads of 128 bits to shards by bits of its own choice, so that a pair of the least
similarity, even in the upper tail of its difference, meets in some table with the chance ``RECALL``. A shard's root keys its children by their
distance, and a search follows the edges within the radius. Documents that have no other near them in their shard leave it; those that
hang together are a bucket, whose links ``jaccard`` decides by the two whole shingle sets.

Defined cases: a null text has no words; no words give fingerprint zero, linked like any other; null doc_ids never
name a group, and their rows belong to the group that their fingerprint is in (null if no row of it has an id); repeated
rows stay; a very long text is hashed whole; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, jaccard

SEED = 42
RADIUS = 4
SHINGLE_WORDS = 4
#: Most fingerprints in one BK-tree.
TREE_ROWS = 2048
#: Edges beyond which a hub's rows may be more than a task should hold.
HUB_EDGES = 2_000_000

#: What verified groups take: words of a shingle, and the least similarity as a fraction.
SIMILAR_WORDS, NUM, DEN = 5, 4, 5
#: 64-bit words of a wide fingerprint, and the radii of it and of its first two words, its head: pairs of Jaccard 0.8 differ in 0.15 of
#: the bits, on average, and the radii are two and a half and three standard deviations more.
WIDE, WIDE_RADIUS, HEAD_RADIUS = 8, 98, 32
#: The chance with which a pair that differs in BIT_DIFFERENCE of the bits, the most that is taken for near, meets in some table.
RECALL, BIT_DIFFERENCE = 0.99, WIDE_RADIUS / (64 * WIDE)
#: Rows of a shard beyond which all of them count as near each other, so that no task holds more; distances that are taken at once.
SHARD_ROWS, AT_ONCE = 100_000, 1 << 18
#: Heads of a shard up to which those that hang together are told apart.
GROUPED_ROWS = 4096


def shingle_hashes(text: bytes, words: int) -> tuple[bytes, np.ndarray]:
    """The words in lower case joined by spaces, and the hashes of all shingles, repeats included."""
    w = text.lower().split()
    line = b" ".join(w)
    if not w:
        return line, np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return line, np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(w) - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    return line, np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def majority(h: np.ndarray) -> bytes:
    """The bits that more than half of the rows of h (hashes x 64-bit words) have, little-endian."""
    wide = h.shape[1] * 8
    count = np.zeros(8 * wide, np.int64)
    for i in range(0, len(h), 16384):
        part = np.ascontiguousarray(h[i : i + 16384]).view(np.uint8).reshape(-1, wide)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * count > len(h), bitorder="little").tobytes()


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Bit i is set if more than half of the shingle hashes have it."""
    _, h = shingle_hashes(text, words)
    return int.from_bytes(majority(h.reshape(-1, 1)), "little")


def fingerprints(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id_column, fp): the fingerprint as a signed long."""
    common.ready(df.sparkSession)
    rows = df.select(F.col(id_column), F.encode(F.coalesce(F.col(text_column), F.lit("")), "UTF-8").alias("_t"))
    schema = rows.select(id_column).schema.add("fp", "long")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=schema.names)

    return common.spread(rows).mapInArrow(common.tidy(take), schema)


class BKTree:
    """Integers under Hamming distance; children[i] maps a distance to the child at that distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The value's place, which is its old one if the tree has it."""
        new = len(self.values)
        if new:
            at = 0
            while d := (value ^ self.values[at]).bit_count():
                child = self.children[at].setdefault(d, new)
                if child == new:
                    break
                at = child
            else:
                return at
        self.values.append(value)
        self.children.append({})
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """The places of all values at the radius or nearer."""
        found, open_, values, children = [], [0] if self.values else [], self.values, self.children
        while open_:
            at = open_.pop()
            d = (value ^ values[at]).bit_count()
            if d <= radius:
                found.append(at)
            edges = children[at]
            if len(edges) <= 2 * radius + 1:
                open_ += [c for e, c in edges.items() if d - radius <= e <= d + radius]
            else:
                open_ += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
        return found


def tree_links(values: np.ndarray, nodes: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest (node, root) of the links between values; with both sides present only links across them count.

    side: 0 goes into the tree, 1 searches it; all of side 0 means that each value searches the values before it.
    """
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)

    order = np.argsort(nodes, kind="stable")
    vals, ids, side = values[order].view(np.uint64).tolist(), nodes[order].tolist(), side[order].tolist()
    tree, places = BKTree(), []
    both = any(side)
    for i, v in enumerate(vals):
        if side[i] == 0:
            if not both:
                for p in tree.within(v, radius):
                    join(i, places[p])
            if tree.add(v) == len(places):
                places.append(i)
    if both:
        for i, v in enumerate(vals):
            if side[i]:
                for p in tree.within(v, radius):
                    join(i, places[p])
    return [(ids[i], ids[root(i)]) for i in range(len(ids)) if root(i) != i]


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """Blocks of bits that cover all 64: (shift, width)."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def blocks_for(n: int, radius: int, rows: int) -> int:
    """Into how many blocks n fingerprints are cut: with b blocks, two within the radius agree on b - radius of them, so
    every choice of that many is a key, of about 64 (b - radius) / b bits. The fewest that give shards of rows / 8 if bits
    were even; as fingerprints grow more, keys get longer, shards stay small, and work grows about as the number."""
    b = radius + 1
    while b < 2 * radius + 2 and n >> (64 * (b - radius) // b) > rows // 8:
        b += 1
    return b


def block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """The shards of a fingerprint: for each choice of blocks - radius blocks their bits and the choice's number."""
    bounds, keys = block_bounds(blocks), []
    for k, choice in enumerate(combinations(bounds, blocks - radius)):
        value = F.lit(0).cast("long")
        for shift, width in choice:
            value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(value * 256 + k)
    return F.array(*keys)


def searched(dealt: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """(u, v) from rows (fp, node, *keys, side) of which those of equal keys are a tree and its searchers."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for t in common.groups(batches, keys):
            if t.num_rows > 1:
                found += tree_links(t["fp"].to_numpy(), t["node"].to_numpy(), t["side"].to_numpy(), radius)
            if len(found) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["u", "v"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["u", "v"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(common.tidy(search), "u long, v long")


def links(reps: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS, blocks: int | None = None) -> DataFrame:
    """(u, v), u > v: links between the nodes of reps (fp, node; written) that span every group of fingerprints within the radius.

    Fingerprints of shards over ``tree_rows`` rows are dealt again by keys of most blocks, which hold half of all bits and more. A
    shard that is over the limit even then goes to parts ``fp_hash mod parts``; the task (i, j) gets parts i and j.
    """
    most = 2 * radius + 2
    blocks = blocks or blocks_for(reps.count(), radius, tree_rows)
    rows = reps.select("fp", "node", F.explode(block_keys(F.col("fp"), radius, blocks)).alias("key"))
    sizes = common.kept(rows.groupBy("key").count().where(F.col("count") > tree_rows).select("key", F.ceil(F.col("count") / tree_rows).cast("int").alias("parts")), "shards")
    if not sizes.head(1):
        return searched(rows.withColumn("side", F.lit(0).cast("byte")), ["key"], radius).distinct()
    rows = common.join_small_or_salted(rows, sizes, "key", "fp")
    cold = searched(rows.where("parts is null").select("fp", "node", "key", F.lit(0).cast("byte").alias("side")), ["key"], radius)
    rows = rows.where("parts is not null")
    if blocks < most:
        hot = common.kept(rows.select("fp", "node").distinct(), "hot")
        return cold.unionByName(links(hot, radius, tree_rows, most)).distinct()
    tasks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    split = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).select("fp", "node", "key", "own", F.explode(tasks).alias("t"))
    side = ((F.col("own") == F.col("t.j")) & (F.col("t.i") != F.col("t.j"))).cast("byte")
    return cold.unionByName(searched(split.select("fp", "node", "key", F.col("t.i").alias("i"), F.col("t.j").alias("j"), side.alias("side")), ["key", "i", "j"], radius)).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's connected component, for nodes with edges.

    edges: (u, v) with u > v. Both kinds of round leave the components as they are and the result is a star for each. Of more than
    HUB_EDGES edges least neighbours are pre-aggregated and written, so that both sides of a join are dealt by it alone and Spark can
    split a hub's rows; of fewer, a hub's rows are a small table.
    """
    sums = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = common.kept(edges.where("u != v"), "edges")
    now = sums(edges)
    for _ in range(max_rounds):
        cut = common.kept if now[0] > HUB_EDGES else lambda df, tag: df
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        down = cut(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        edges, before = common.kept(small, "edges"), now
        now = sums(edges)
        if now == before:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(id_column, fp, component_id) for each row: component_id is the smallest id in its group of near-duplicates.

    The nodes are the fingerprints themselves, so that those of rows without an id link others too.
    """
    fps = common.kept(fingerprints(df, id_column=id_column, text_column=text_column, words=words), "fps")
    reps = common.kept(fps.groupBy("fp").agg(F.min(id_column).cast("long").alias("least")).withColumn("node", F.col("fp")), "reps")
    roots = components(links(reps, radius, tree_rows))
    rooted = reps.join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    rooted = common.kept(rooted, "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = common.kept(rooted.join(names, "root").select("fp", "component_id"), "labels")
    return common.join_small_or_salted(fps, labels, "fp").select(id_column, "fp", "component_id")


# groups verified by Jaccard similarity


def wide_print(hashes: np.ndarray) -> bytes:
    """A fingerprint of WIDE words from the distinct hashes of a text's shingles."""
    out = np.empty((len(hashes), WIDE), np.uint64)
    for k in range(WIDE):
        x = hashes * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        out[:, k] = x ^ (x >> np.uint64(29))
    return majority(out)


def wide_prints(texts: DataFrame, words: int) -> DataFrame:
    """(row, digest, fp): a 128-bit digest of the words and the wide fingerprint, from (row, _t as binary)."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, fps = [], []
            for t in b.column(1):
                line, h = shingle_hashes(t.as_py(), words)
                digests.append(xxhash.xxh3_128_digest(line))
                fps.append(wide_print(np.unique(h)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(fps, pa.binary())], names=["row", "digest", "fp"])

    return common.spread(texts).mapInArrow(common.tidy(take), "row long, digest binary, fp binary")


def tables_for(n: int) -> list[np.ndarray]:
    """For n fingerprints the bits that each table's key takes, and so many tables that RECALL holds. The longer the key, the smaller
    are the shards and the more tables it takes: shards grow as n to the power 0.3, tables about as its fifth root."""
    width = min(60, max(2, math.ceil(math.log2(max(n, 1) / max(4, n**0.3)))))
    meet = (1 - BIT_DIFFERENCE) ** width
    count = max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - meet)))
    rng = np.random.default_rng(SEED)
    return [np.sort(rng.choice(64 * WIDE, width, replace=False)) for _ in range(count)]


def table_keys(nodes: DataFrame) -> DataFrame:
    """(key, row, w0, w1) for each table and each of nodes (row, fp): w0 and w1 are the fingerprint's first words."""
    tables = tables_for(nodes.count())

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                raw = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, 8 * WIDE)
                bits = np.unpackbits(raw, axis=1, bitorder="little")
                words = [pa.array(np.ascontiguousarray(raw[:, i : i + 8]).view(np.int64).ravel()) for i in (0, 8)]
                for k, choice in enumerate(tables):
                    key = bits[:, choice].astype(np.int64) @ (np.int64(1) << np.arange(len(choice), dtype=np.int64))
                    key = key * np.int64(len(tables)) + k if len(choice) < 50 else key ^ np.int64(k * 0x9E3779B97F4A7C15 % 2**63)
                    yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0), *words], names=["key", "row", "w0", "w1"])

    return nodes.mapInArrow(common.tidy(take), "key long, row long, w0 long, w1 long")


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """(rows, heads, starts) of the runs of equal keys in a sorted partition that have two rows or more; many whole runs at once, starts
    with the end behind them. A run that grows over SHARD_ROWS comes in pieces without heads."""
    tail: pa.Table | None = None
    over = None  # the key of a run in pieces

    def cut(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = table["key"].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        keep = np.flatnonzero(np.repeat(sizes > 1, sizes))
        heads = np.stack([table[c].to_numpy()[keep].view(np.uint64) for c in ("w0", "w1")], axis=1)
        return table["row"].to_numpy()[keep], heads, np.concatenate(([0], np.cumsum(sizes[sizes > 1])))

    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        if over is not None:
            n = int(np.searchsorted(table["key"].to_numpy(), over, side="right"))
            if n:
                yield table["row"].to_numpy()[:n], None, np.array([0, n])
                table = table.slice(n)
            if not table.num_rows:
                continue
            over = None
        table = pa.concat_tables([tail, table]) if tail is not None else table
        key = table["key"].to_numpy()
        at = int(np.searchsorted(key, key[-1]))
        if at:
            yield cut(table.slice(0, at))
        tail = table.slice(at)
        if tail.num_rows > SHARD_ROWS:
            over = key[-1]
            yield tail["row"].to_numpy(), None, np.array([0, tail.num_rows])
            tail = None
    if tail is not None:
        yield cut(tail)


def near_any(heads: np.ndarray, radius: int) -> np.ndarray:
    """Which heads of a shard have another within the radius, by a BK-tree of one level, held as vectors: the first head is the
    root, the others are its children, in order of their distances, and a search looks at those whose distance is within the
    radius of its own. Heads that a search finds need none themselves, so a dense shard takes few searches."""
    far = np.bitwise_count(heads ^ heads[0]).sum(axis=1, dtype=np.int64)
    order = np.argsort(far, kind="stable")
    far, heads = far[order], heads[order]
    hit = far <= radius
    hit &= hit.sum() > 1
    low, high = np.searchsorted(far, far - radius), np.searchsorted(far, far + radius, side="right")
    at, step = 0, 1
    while True:
        lone = np.flatnonzero(~hit[at:])[:step] + at
        if not len(lone):
            break
        a, z = int(low[lone[0]]), int(high[lone[-1]])
        close = np.bitwise_count(heads[lone][:, None, :] ^ heads[None, a:z, :]).sum(axis=2, dtype=np.int32) <= radius
        several = close.sum(axis=1) > 1
        hit[lone[several]] = True
        hit[a:z] |= close[several].any(axis=0)
        at, step = int(lone[-1]) + 1, max(1, min(2 * step, AT_ONCE // len(heads)))
    out = np.empty(len(hit), bool)
    out[order] = hit
    return out


def near_groups(heads: np.ndarray, radius: int) -> np.ndarray:
    """A number for each head of a shard: heads that hang together by steps within the radius have the same, those that are near no
    other have -1. As in near_any, the first head is the root of a BK-tree of one level, and a head is compared with those whose distance
    to the root is within the radius of its own. Shards over GROUPED_ROWS heads aren't told apart further."""
    n = len(heads)
    if n > GROUPED_ROWS:
        return np.where(near_any(heads, radius), 0, -1)
    far = np.bitwise_count(heads ^ heads[0]).sum(axis=1, dtype=np.int64)
    order = np.argsort(far, kind="stable")
    far, heads = far[order], heads[order]
    low, high = np.searchsorted(far, far - radius), np.searchsorted(far, far + radius, side="right")
    close = np.zeros((n, n), bool)
    step = max(1, AT_ONCE // n)
    for at in range(0, n, step):
        end = min(at + step, n)
        a, z = int(low[at]), int(high[end - 1])
        close[at:end, a:z] = np.bitwise_count(heads[at:end, None, :] ^ heads[None, a:z, :]).sum(axis=2, dtype=np.int32) <= radius
    out = np.full(n, -1)
    some = np.flatnonzero(close.sum(axis=1) > 1)
    if not len(some):
        return out
    close, label = close[np.ix_(some, some)], np.full(len(some), -1)
    for k in range(len(some)):
        if label[k] >= 0:
            continue
        new = reached = close[k]
        while new.any():
            new = close[new].any(axis=0) & ~reached
            reached = reached | new
        label[reached] = k
    out[order[some]] = label
    return out


def with_neighbours(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """(key, row): of each shard the documents that have another within the radius, by the groups in which they hang together; all of a
    shard that comes in pieces. Keys are new ones, that tell the groups of a partition apart."""
    key, in_pieces = 0, False
    for rows, heads, starts in shards(batches):
        if heads is None:
            key += not in_pieces
            in_pieces = True
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), key)), pa.array(rows)], names=["key", "row"])
            continue
        in_pieces = False
        if len(starts) < 2:
            continue
        own = np.concatenate([np.where((g := near_groups(heads[i:j], radius)) < 0, -1, g + i) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)])
        hit = own >= 0
        yield pa.RecordBatch.from_arrays([pa.array(own[hit] + key + 1), pa.array(rows[hit])], names=["key", "row"])
        key += len(rows) + 1


def shingle_sets(texts: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(row, n, s) of those texts (row, _t) whose rows are asked for (distinct, written): the sorted distinct hashes of their shingles, written."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)[1]) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["row", "n", "s"])

    few = texts.join(F.broadcast(rows), "row", "left_semi") if common.small(rows) else texts.join(rows, "row", "left_semi")
    return common.kept(few.mapInArrow(common.tidy(take), "row long, n int, s binary"), "sets")


def with_roots(every: DataFrame, labels: DataFrame) -> DataFrame:
    return common.join_small_or_salted(every.select("row", "digest"), labels, "digest").select("row", "digest", "root")


def similar_groups(df: DataFrame, *, key: str, text_column: str = "text", words: int = SIMILAR_WORDS) -> DataFrame:
    """(row, digest, root) for each row of df, whose key is unique and written: digest tells texts of equal words, root the group."""
    common.ready(df.sparkSession)
    texts = df.select(F.col(key).alias("row"), F.encode(F.coalesce(F.col(text_column), F.lit("")), "UTF-8").alias("_t"))
    every = common.kept(wide_prints(texts, words), "prints")
    nodes = common.kept(every.groupBy("digest").agg(F.min(F.struct("row", "fp")).alias("x")).select("digest", "x.row", "x.fp"), "nodes")
    dealt = table_keys(nodes.select("row", "fp")).repartition("key").sortWithinPartitions("key")
    near = dealt.mapInArrow(common.tidy(lambda b: with_neighbours(b, HEAD_RADIUS)), "key long, row long").select(F.xxhash64(F.spark_partition_id(), "key").alias("key"), "row")
    shared = common.kept(near, "near")
    sets = shingle_sets(texts, common.kept(shared.select("row").distinct(), "asked"), words)
    roots = jaccard.grouped(shared.join(sets.select("row", "n"), "row"), sets.select("row", "s"), NUM, DEN, components)
    if roots is None:
        return with_roots(every, nodes.select("digest", F.col("row").alias("root")))
    labels = nodes.join(roots, nodes["row"] == roots["node"], "left").select("digest", F.coalesce("root", "row").alias("root"))
    return with_roots(every, common.kept(labels, "labels"))


def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
