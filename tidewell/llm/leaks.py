"""Benchmark passages in documents, by the q-gram lemma.

A passage of m characters that stands in a text with at most k edits shares at least m + 1 - q - kq of its q-grams with
it, and all of them lie on k + 1 neighbouring diagonals (place in the text less place in the passage). So the shared q-grams
of each text are counted by passage and by bands of 2(k + 1) diagonals that overlap by half, any k + 1 neighbours lie in
one band, and only bands that reach the bound are aligned. The alignment is kept to the band's diagonals, with k to either
side; it gives the least number of edits with which the passage stands there.

Texts are compared in lower case with every run of white space as one space. Shared q-grams are counted in steps of PAIRS
(place, posting) pairs at most, and only the sums by band are kept from step to step, so a q-gram that is frequent on both
sides costs time but no memory. A text over SEGMENT characters is held in segments that overlap by more than the longest
passage with its edits. Passages go to the executors in groups of GROUP_BYTES, each in one scan of the documents; in a task they are
indexed block by block, one at a time.

Defined cases: a null or empty text holds nothing; null and empty passages are found nowhere; passages of fewer characters
than q are found by equality alone; null ids are returned as such; a row that repeats gives its pairs again; a very long text is
searched whole; an empty table on either side gives no pairs; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

Q = 8
#: Edits that a passage may have, as a share of its characters.
BUDGET = 0.1
#: Bytes of passages that are indexed at once, whose index takes about 40 times as much in each worker, and that are sent at once.
BLOCK_BYTES, GROUP_BYTES = 1 << 20, 32 << 20
#: Characters of texts that are counted at once, of a segment of a long text, and of texts that wait where there are several blocks.
TEXT_CHARS, SEGMENT, WAITING = 1 << 20, 1 << 20, 8 << 20
#: Pairs of a place in a text and a posting that are made at once.
PAIRS = 1 << 20
#: Alignments that are made together.
ALIGNED = 64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """The hash of every q-gram: sum of code j times base**(q - 1 - j), by doubling, then mixed."""
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, width = None, 0, c.astype(np.uint64), 1
    power = _BASE
    rest = q
    while rest:
        if rest & 1:
            out = part[done : done + n].copy() if out is None else out[:n] * power + part[done : done + n]
            done += width
        rest >>= 1
        if rest:
            part = part[:-width] * power + part[width:]
            power = np.uint64(int(power) ** 2 % (1 << 64))
            width *= 2
    out *= _MIX
    return out ^ (out >> np.uint64(31))


def budget(m: int, q: int, share: float) -> int:
    """Edits allowed: the share, but not so many that the lemma would ask for no shared q-gram."""
    return max(0, min(int(share * m), (m - q) // q))


class Passages:
    """An index of passages: sorted q-gram hashes with the passages and places that hold them."""

    def __init__(self, items: list[tuple[int, str]], q: int, share: float) -> None:
        self.q = q
        items = [(i, t) for i, t in items if t]
        self.short = [(i, t) for i, t in items if len(t) < q]
        items = [(i, t) for i, t in items if len(t) >= q]
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.k = np.array([budget(len(t), q, share) for t in self.texts], np.int64)
        self.least = np.array([len(t) + 1 - q - k * q for t, k in zip(self.texts, self.k.tolist(), strict=True)], np.int64)
        grams = [gram_hashes(codes(t), q) for t in self.texts]
        h = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams]).astype(np.int64)
        place = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)]).astype(np.int64)
        by = np.argsort(h, kind="stable")
        self.item, self.place = item[by], place[by]
        self.hash, self.first = np.unique(h[by], return_index=True)
        self.many = np.diff(np.append(self.first, len(by)))
        self.bits = max(12, min(26, (16 * max(1, len(h))).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.hash >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        #: makes half bands positive, and the overlap of a long text's segments
        self.shift = max(map(len, self.texts), default=0) + 2
        self.overlap = 2 * self.shift + q
        self.automaton = None
        if self.short:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            by_text: dict[str, list[int]] = {}
            for i, t in self.short:
                by_text.setdefault(t, []).append(i)
            for t, ids in by_text.items():
                self.automaton.add_word(t, (t, ids))
            self.automaton.make_automaton()

    def bands(self, text_codes: np.ndarray, limits: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, passage, band) where the bound is met. limits: the first place of each text in the joined codes, and the
        end; texts are apart by one code that no passage holds."""
        h = gram_hashes(text_codes, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        g = np.searchsorted(self.hash, h[at])
        good = g < len(self.hash)
        good[good] = self.hash[g[good]] == h[at][good]
        at, g = at[good], g[good]
        if not len(at):
            return []
        text_of = np.searchsorted(limits, at, "right") - 1
        span = int(np.diff(limits).max()) + int(max(map(len, self.texts))) + 4
        place, ends = at - limits[text_of], np.cumsum(self.many[g])
        found, keys, counts, i = [], np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            keys, counts = merged(keys, counts, *self._counted(place[i:j], text_of[i:j], g[i:j], span))
            i = j
            # what is surely whole: all texts before the one that the next place lies in
            whole = len(keys) if i == len(at) else int(np.searchsorted(keys, int(text_of[i]) * len(self.ids) * span))
            if whole:
                found += self._met(keys[:whole], counts[:whole], span)
                keys, counts = keys[whole:], counts[whole:]
        return found

    def _counted(self, at: np.ndarray, text: np.ndarray, g: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of text, passage and half band, and how many of the places' q-grams fall into each."""
        n = self.many[g]
        src = np.repeat(np.arange(len(at)), n)
        post = np.repeat(self.first[g] - (np.cumsum(n) - n), n) + np.arange(len(src))
        item = self.item[post]
        band = np.floor_divide(at[src] - self.place[post], self.k[item] + 1)
        return np.unique((text[src] * len(self.ids) + item) * span + band + self.shift, return_counts=True)

    def _met(self, keys: np.ndarray, counts: np.ndarray, span: int) -> list[tuple[int, int, int]]:
        """The (text, passage, band) of two neighbouring half bands that reach the bound."""
        pair, band = np.divmod(keys, span)
        cut = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        # most pairs of text and passage share too few q-grams in all
        total = np.repeat(np.add.reduceat(counts, cut), np.diff(np.append(cut, len(pair))))
        enough = total >= self.least[pair % len(self.ids)]
        pair, band, counts = pair[enough], band[enough] - self.shift, counts[enough]
        if not len(pair):
            return []
        p, b, n = np.concatenate((pair, pair)), np.concatenate((band, band - 1)), np.concatenate((counts, counts))
        by = np.lexsort((b, p))
        p, b, n = p[by], b[by], n[by]
        cut = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (b[1:] != b[:-1]))))
        met = np.add.reduceat(n, cut) >= self.least[p[cut] % len(self.ids)]
        return [(x // len(self.ids), x % len(self.ids), y) for x, y in zip(p[cut][met].tolist(), b[cut][met].tolist(), strict=True)]

    def aligned(self, texts: list[str], places: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
        """(text, passage, (edits, start, end)): the best place of each passage on the diagonals of each band, if in the budget."""
        rest: dict[tuple[int, int], list[int]] = {}
        whole = set()
        for t, item, band in places:
            if (t, item) in whole:
                continue
            p, k = self.texts[item], int(self.k[item])
            a, z = max(0, band * (k + 1) - k), (band + 2) * (k + 1) + len(p) + k
            if (i := texts[t].find(p, a, z)) >= 0:  # no edits: nothing better can be found
                whole.add((t, item))
                yield t, item, (0, i, i + len(p))
            else:
                rest.setdefault((t, item), []).append(band)
        todo = [(t, item, band) for (t, item), bands in rest.items() if (t, item) not in whole for band in bands]
        todo.sort(key=lambda x: len(self.texts[x[1]]))
        for at in range(0, len(todo), ALIGNED):
            some = todo[at : at + ALIGNED]
            ks = np.array([self.k[item] for _, item, _ in some], np.int64)
            low = np.array([band for _, _, band in some], np.int64) * (ks + 1) - ks
            got = banded([codes(self.texts[item]) for _, item, _ in some], [codes(texts[t]) for t, _, _ in some], low, 4 * ks + 2, ks)
            for (t, item, _), x in zip(some, got, strict=True):
                if x:
                    yield t, item, x

    def found(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, edits, start, end) for each text and passage with a place in the budget: the best, then the first."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if self.ids:
            parts, source, size = [], [], 0  # segments, and the text and place of each
            step = max(SEGMENT, 2 * self.overlap)
            for t, text in enumerate(texts):
                for a in range(0, max(len(text) - self.overlap, 1), step):
                    parts.append(text[a : a + step + self.overlap])
                    source.append((t, a))
                    size += len(parts[-1])
                    if size >= TEXT_CHARS:
                        self._best(parts, source, best)
                        parts, source, size = [], [], 0
            if parts:
                self._best(parts, source, best)
        out = [(t, self.ids[i], *x) for (t, i), x in best.items()]
        if self.automaton:
            for t, text in enumerate(texts):
                seen = set()
                for end, (p, ids) in self.automaton.iter(text):
                    for i in ids:
                        if i not in seen:
                            seen.add(i)
                            out.append((t, i, 0, end + 1 - len(p), end + 1))
        return out

    def _best(self, parts: list[str], source: list[tuple[int, int]], best: dict) -> None:
        joined = np.concatenate([x for p in parts for x in (codes(p), np.array([0xFFFFFFFF], np.uint32))])
        limits = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts]))).astype(np.int64)
        for s, item, (edits, start, end) in self.aligned(parts, self.bands(joined, limits)):
            t, a = source[s]
            got = edits, start + a, end + a
            best[t, item] = min(best.get((t, item), got), got)


def merged(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, more_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of keys with counts as one."""
    if not len(keys):
        return more, more_counts
    keys, counts = np.concatenate((keys, more)), np.concatenate((counts, more_counts))
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[cut], np.add.reduceat(counts, cut)


def banded(ps: list[np.ndarray], ts: list[np.ndarray], low: np.ndarray, width: np.ndarray, k: np.ndarray) -> list[tuple[int, int, int] | None]:
    """For each passage and text: the least edits between the passage and any part of the text on the diagonals low to
    low + width - 1, if at most k, with the part.

    All are aligned together: a row for each character of the passages, a cell for each diagonal. Cells hold edits * big
    - start, so that of equal edits the later start, the shorter part, wins. What is over its budget is taken out.
    """
    big, far = 1 << 32, 1 << 60
    m, n = np.array([len(p) for p in ps]), np.array([len(t) for t in ts])
    out: list[tuple[int, int, int] | None] = [None] * len(ps)
    text, first = np.concatenate([*ts, np.zeros(1, np.uint32)]), np.cumsum(n) - n
    chars = np.zeros((len(ps), int(m.max())), np.uint32)
    for i, p in enumerate(ps):
        chars[i, : len(p)] = p
    cells = np.arange(int(width.max()))
    d = low[:, None] + cells
    outside = cells >= width[:, None]
    row = np.where((d >= 0) & (d <= n[:, None]) & ~outside, -d, far)  # no character yet: begins anywhere for nothing
    drift, who = cells * big, np.arange(len(ps))
    for i in range(chars.shape[1]):
        j = d + i  # the cell's character of the text
        ok = (j >= 0) & (j < n[:, None])
        same = text[np.where(ok, first[:, None] + j, 0)] == chars[:, i, None]
        step = np.where(ok, row + np.where(same, 0, big), far)  # match or replace
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + big)  # leave out a character of the passage
        shut = outside | (j < -1) | (j >= n[:, None])
        step[shut] = far
        row = np.minimum.accumulate(step - drift, axis=1) + drift  # take in characters of the text
        row[shut] = far
        done = m == i + 1
        if done.any() or i % 16 == 15:
            least = row.min(axis=1)
            edits = -(-least // big)
            for x in np.flatnonzero(done & (edits <= k) & (least < far // 2)).tolist():
                e, v = int(edits[x]), int(least[x])
                out[int(who[x])] = e, e * big - v, int(d[x, int(row[x].argmin())]) + int(m[x])
            on = ~done & (edits <= k)
            if not on.any():
                break
            row, d, outside, chars, first, n, m, k, who = (y[on] for y in (row, d, outside, chars, first, n, m, k, who))
    return out


PAIRS_FOUND = "doc_id long, item_id long, edits int, start long, end long"


def groups_of(items: DataFrame, id_column: str, text_column: str, block_bytes: int, group_bytes: int) -> Iterator[list[list[tuple[int, str]]]]:
    """The passages in groups of about group_bytes, each a list of blocks of about block_bytes; one group on the driver at a time."""
    rows = items.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t")).where("t is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = -(-size // group_bytes)
    for b in range(n):
        mine = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) if n > 1 else rows
        group, held = [[]], 0
        for r in mine.toLocalIterator():
            if held > block_bytes:
                group.append([])
                held = 0
            group[-1].append((r["i"], normal(r["t"])))
            held += 64 + len(r["t"].encode())
        yield group


def leaks(df: DataFrame, items: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", q: int = Q, share: float = BUDGET, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, item_id, edits, start, end): a row for each document and passage that stands in it; places are in normal(text).

    Where there is more than one group of passages, each group's pairs are written before the next is sent.
    """
    spark = common.ready(df.sparkSession)
    rows = df.select(F.col(id_column).cast("long").alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_t"))
    rows, parts, waiting = common.spread(rows), [], None
    for group in groups_of(items, item_column, item_text_column, block_bytes, group_bytes):
        if waiting is not None:
            parts.append(common.kept(waiting, "leaks"))
        sent = spark.sparkContext.broadcast(group)

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            blocks = sent.value
            built = Passages(blocks[0], q, share) if len(blocks) == 1 else None
            ids, texts, chars = [], [], 0

            def found() -> Iterator[pa.RecordBatch]:
                for block in blocks:
                    got = (built or Passages(block, q, share)).found(texts)
                    if got:
                        t, item, edits, start, end = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in t], pa.int64()), pa.array(item, pa.int64()), pa.array(edits, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "edits", "start", "end"])

            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    ids.append(i)
                    texts.append(normal(t.as_py()))
                    chars += len(texts[-1])
                    if chars >= (TEXT_CHARS if built else WAITING):
                        yield from found()
                        ids, texts, chars = [], [], 0
            if texts:
                yield from found()

        waiting = rows.mapInArrow(common.tidy(task), PAIRS_FOUND)
    if waiting is None:
        return spark.createDataFrame([], PAIRS_FOUND)
    for part in parts:
        waiting = waiting.unionByName(part)
    return waiting


def op9_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark passages in all documents."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
