"""Token ids in wavelet matrices.

Documents in ascending order of their ids are encoded with a tokenizers vocabulary; every run of documents of about
``SHARD_TOKENS`` tokens becomes one file, a shard. In it the ids stand as a wavelet matrix (Claude, Navarro and Ordóñez
2015): one plane of bits for each bit of an id, from the highest, every plane ordered by the bits before it. The file holds
with each plane the number of set bits before each 512th place, so a plane answers rank and select, and the file answers which
id stands at a place, how often an id comes before a place, and where its k-th occurrence is. Planes are compressed in blocks of
BLOCK bits and everything has a known place, so that one such answer reads a few blocks of each plane and not the file.

Encoding: the vocabulary drops white space, and no token spans it. So of the words (runs without ASCII white space) of
some megabytes of texts each different one is encoded once by the library, many of them in one text, and the ids of a
text are those of its words. Words that are not plain letters with plain punctuation behind them, and texts that hold a
special string or a separator that libraries see differently, are given to the library as they are.

Defined cases: a null text is empty and has the end id alone; null ids come first; rows without an id or of one id are in the
order of the table; a very long text is encoded whole and makes a long shard; an empty table gives no shards; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import vocabulary

MAGIC = b"TWM2"
SHARD_TOKENS = 1 << 22
#: Bits from one stored rank to the next, and bits of a compressed block.
STEP, BLOCK = 512, 1 << 17
#: Bytes of texts whose words are encoded together, and words of one text that is given to the library.
TEXT_BYTES, TOGETHER = 12 << 20, 200
#: Words whose ids a worker holds.
HELD_WORDS = 1 << 20
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: What keeps a text from being cut into words.
WHOLE = "<\\||[\x1c-\x1f]|İ"


Read = Callable[[int, int], bytes]


class Plane:
    """A plane of bits in a file: ranks before each STEP, places of blocks, blocks. read(start, length) reads bytes of the file."""

    def __init__(self, n: int, ones: int, at: int, read: Read) -> None:
        self.n, self.total, self.at, self.read = n, ones, at, read
        self.steps, self.blocks = -(-n // STEP) + 1, -(-n // BLOCK)
        self.held: dict[int, np.ndarray] = {}

    @staticmethod
    def packed(bits: np.ndarray) -> bytes:
        data = np.packbits(bits)
        wide = np.zeros(-(-len(data) // (STEP // 8)) * (STEP // 8), np.uint8)
        wide[: len(data)] = data
        ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(wide).reshape(-1, STEP // 8).sum(axis=1, dtype=np.uint32)))).astype("<u4")
        press = zstandard.ZstdCompressor(level=1).compress
        blocks = [press(data[i : i + BLOCK // 8].tobytes()) for i in range(0, len(data), BLOCK // 8)]
        return ranks.tobytes() + np.cumsum([0, *map(len, blocks)]).astype("<u4").tobytes() + b"".join(blocks)

    @cached_property
    def ranks(self) -> np.ndarray:
        return np.frombuffer(self.read(self.at, 4 * self.steps), "<u4")

    def block(self, b: int) -> np.ndarray:
        """The bytes of a block; the last few are held."""
        if (got := self.held.get(b)) is None:
            at = self.at + 4 * self.steps
            a, z = np.frombuffer(self.read(at + 4 * b, 8), "<u4").tolist()
            got = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.read(at + 4 * (self.blocks + 1) + a, z - a)), np.uint8)
            while len(self.held) > 3:
                del self.held[next(iter(self.held))]
            self.held[b] = got
        return got

    def bytes(self) -> np.ndarray:
        """The whole plane, with zeros up to a whole step."""
        at = self.at + 4 * self.steps
        ends = np.frombuffer(self.read(at, 4 * (self.blocks + 1)), "<u4").tolist()
        data, open_ = self.read(at + 4 * (self.blocks + 1), ends[-1]), zstandard.ZstdDecompressor().decompress
        out = b"".join(open_(data[a:z]) for a, z in zip(ends, ends[1:], strict=False))
        return np.frombuffer(out + bytes(-len(out) % (STEP // 8)), np.uint8)

    def bit(self, i: int) -> bool:
        return bool(self.block(i // BLOCK)[i % BLOCK // 8] >> (7 - i % 8) & 1)

    def ones(self, i: int) -> int:
        """Set bits before place i: the rank at the step before it, and the bits from there."""
        step, rest = divmod(i, STEP)
        before = int(self.ranks[step]) if "ranks" in self.__dict__ else int.from_bytes(self.read(self.at + 4 * step, 4), "little")
        if not rest:
            return before
        part = self.block(i // BLOCK)[step * STEP % BLOCK // 8 : (i - 1) % BLOCK // 8 + 1]
        last = int(part[-1]) >> (-i % 8)
        return before + int(np.bitwise_count(part[:-1]).sum()) + last.bit_count()

    def ones_at(self, places: np.ndarray, data: np.ndarray) -> np.ndarray:
        """ones() of many places; data is bytes()."""
        step, rest = places // STEP, places % STEP
        rows = np.concatenate((data, np.zeros(STEP // 8, np.uint8))).reshape(-1, STEP // 8)[step]
        bits = np.clip(rest[:, None] - 8 * np.arange(STEP // 8), 0, 8)
        return self.ranks[step].astype(np.int64) + np.bitwise_count(rows & (0xFF00 >> bits & 0xFF).astype(np.uint8)).sum(axis=1, dtype=np.int64)

    def select(self, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of this kind."""
        before = self.ranks.astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(self.steps, dtype=np.int64) * STEP, self.n) - before
        s = int(np.searchsorted(before, k, "right")) - 1
        part = np.unpackbits(self.block(s * STEP // BLOCK)[s * STEP % BLOCK // 8 :][: STEP // 8])
        return s * STEP + int(np.flatnonzero(part == bit)[k - int(before[s])])


class WaveletMatrix:
    """A sequence of n unsigned integers as planes of bits, the most significant bit of an id first."""

    def __init__(self, n: int, planes: list[Plane]) -> None:
        self.n, self.planes = n, planes

    @staticmethod
    def bits_of(ids: np.ndarray) -> list[np.ndarray]:
        """The planes' bits."""
        seq, planes = ids, []
        for b in range(max(1, int(ids.max(initial=0)).bit_length()) - 1, -1, -1):
            bit = (seq & ids.dtype.type(1 << b)) != 0
            planes.append(bit)
            if b:
                seq = np.concatenate((np.compress(~bit, seq), np.compress(bit, seq)))
        return planes

    def _bit(self, value: int, level: int) -> int:
        return value >> (len(self.planes) - 1 - level) & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for p in self.planes:
            one = p.bit(i)
            value = value << 1 | one
            ones = p.ones(i)
            i = self.n - p.total + ones if one else i - ones
        return value

    def rank(self, value: int, i: int) -> int:
        """How often an id stands before place i."""
        if value >> len(self.planes):
            return 0
        low = 0
        for level, p in enumerate(self.planes):
            a, b = p.ones(low), p.ones(i)
            low, i = (self.n - p.total + a, self.n - p.total + b) if self._bit(value, level) else (low - a, i - b)
        return i - low

    def ranks(self, value: int, places: np.ndarray) -> np.ndarray:
        """rank() of many places, which reads whole planes."""
        at = np.concatenate(([0], places)).astype(np.int64)
        if value >> len(self.planes):
            return np.zeros(len(places), np.int64)
        for level, p in enumerate(self.planes):
            ones = p.ones_at(at, self._data[level])
            at = self.n - p.total + ones if self._bit(value, level) else at - ones
        return at[1:] - at[0]

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of an id: down to where its occurrences stand together, then back up."""
        if k >= self.count(value):
            raise IndexError(f"{value} comes {self.count(value)} times")
        low = 0
        for level, p in enumerate(self.planes):
            a = p.ones(low)
            low = self.n - p.total + a if self._bit(value, level) else low - a
        i = low + k
        for level in range(len(self.planes) - 1, -1, -1):
            p, one = self.planes[level], self._bit(value, level)
            i = p.select(one, i - (self.n - p.total) if one else i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    @cached_property
    def _data(self) -> list[np.ndarray]:
        return [p.bytes() for p in self.planes]

    def decode(self, kind=np.uint32) -> np.ndarray:
        """All ids in order: from the last plane up, each plane says which ids stood on its two sides."""
        seq = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            bit, z = np.unpackbits(self._data[level], count=self.n).view(bool), self.n - self.planes[level].total
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~bit)] = seq[:z]
            up[np.flatnonzero(bit)] = seq[z:] | kind(1 << (len(self.planes) - 1 - level))
            seq = up
        return seq


def packed(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """A shard file: magic, length of the head, head as JSON, then what the head has the lengths of: doc ids, which of them are
    null and numbers of tokens, each compressed; planes."""
    press = zstandard.ZstdCompressor(level=1).compress
    docs = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), lengths.astype("<u4").tobytes()]
    docs, bits = [press(x) for x in docs], WaveletMatrix.bits_of(ids)
    planes = [Plane.packed(b) for b in bits]
    head = json.dumps({"n": len(ids), "sections": [len(x) for x in docs], "planes": [len(x) for x in planes], "ones": [int(b.sum()) for b in bits]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *docs, *planes])


class Shard:
    """A shard file, of which only what is asked for is read."""

    def __init__(self, read: Read) -> None:
        start = read(0, 8)
        if start[:4] != MAGIC:
            raise ValueError("not a shard file")
        (size,) = struct.unpack_from("<I", start, 4)
        self.head, self.read, at, planes = json.loads(read(8, size)), read, 8 + size, []
        self.sections = []
        for n in self.head["sections"]:
            self.sections.append((at, n))
            at += n
        for n, ones in zip(self.head["planes"], self.head["ones"], strict=True):
            planes.append(Plane(self.head["n"], ones, at, read))
            at += n
        self.matrix = WaveletMatrix(self.head["n"], planes)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids and numbers of tokens."""
        ids, null, lengths = (zstandard.ZstdDecompressor().decompress(self.read(*x)) for x in self.sections)
        return [None if x else d for d, x in zip(np.frombuffer(ids, "<i8").tolist(), null, strict=True)], np.frombuffer(lengths, "<u4")

    @classmethod
    def of(cls, data: bytes) -> Shard:
        return cls(lambda start, length: data[start : start + length])


def opened(uri: str) -> Shard:
    """A shard file that is read by places."""
    fs, path = common.file_system(uri)
    file = fs.open_input_file(path)

    def read(start: int, length: int) -> bytes:
        file.seek(start)
        return file.read(length)

    return Shard(read)


def gathered(ids: np.ndarray, at: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The runs of ids that begin at the places and have the numbers given, one behind the other."""
    ends = np.cumsum(number)
    return ids[np.repeat(at - (ends - number), number) + np.arange(int(ends[-1]) if len(ends) else 0)]


class WordEncoder:
    """A tokenizers vocabulary whose words end in a token that says so, and that drops white space."""

    def __init__(self, data: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data)
        size = self.library.get_vocab_size()
        mark = json.loads(data)["model"].get("end_of_word_suffix") or ""
        self.kind = np.dtype("<u2") if size < 1 << 16 else np.dtype("<u4")
        self.ends = np.array([bool(mark) and (self.library.id_to_token(i) or "").endswith(mark) for i in range(size)])
        self.forget()

    def forget(self) -> None:
        """The words of letters that are held: their strings, all of their ids, and each one's place and number in them."""
        self.known, self.known_ids = pa.array([], pa.string()), np.zeros(0, self.kind)
        self.known_at, self.known_number = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of texts as they are."""
        return [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def of_letters(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words that are letters only, or no letters: all ids, and each word's place and number in them. Words are
        held from one batch to the next, HELD_WORDS at most, after which all are forgotten."""
        place = pc.index_in(words, value_set=self.known)
        if len(self.known) + place.null_count > HELD_WORDS:
            self.forget()
            place = pc.index_in(words, value_set=self.known)
        place = place.fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            some = words.take(pa.array(new))
            ids, at, number = self.fresh_letters(some)
            place[new] = len(self.known) + np.arange(len(new))
            self.known_at = np.concatenate((self.known_at, len(self.known_ids) + at))
            self.known_number = np.concatenate((self.known_number, number))
            self.known_ids, self.known = np.concatenate((self.known_ids, ids)), pa.concat_arrays([self.known, some])
        return self.known_ids, self.known_at[place], self.known_number[place]

    def fresh_letters(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """of_letters() of words that aren't held.

        Such a word is one part, and the last token of a part says that it is; many words go to the library as one text.
        """
        at, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        strings, found, size = words.to_pylist(), [], 0
        for i in range(0, len(strings), TOGETHER):
            some = strings[i : i + TOGETHER]
            (ids,) = self.plain([" ".join(some)])
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):  # a word fell into parts after all
                each = self.plain(some)
                ids, stops = np.concatenate(each), np.cumsum([len(x) for x in each])
            number[i : i + TOGETHER] = np.diff(stops, prepend=0)
            at[i : i + TOGETHER] = size + stops - number[i : i + TOGETHER]
            found.append(ids)
            size += len(ids)
        return np.concatenate([*found, np.zeros(0, self.kind)]), at, number

    def of_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words: all ids, and each word's place and number in them. Letters with punctuation behind them
        are two parts, of which each different one is encoded once."""
        core = pc.utf8_rtrim(words, PUNCTUATION)
        # letters that come apart when they are normalised may join what stands behind them
        plain = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False).copy()
        for i in np.flatnonzero(plain & ~pc.string_is_ascii(core).to_numpy(zero_copy_only=False)).tolist():
            plain[i] = unicodedata.is_normalized("NFC", core[i].as_py())
        simple = pa.array(plain)
        mine, other = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (simple, pc.invert(simple)))
        core = core.filter(simple)
        letters = pc.utf8_lower(core).dictionary_encode()
        sizes, full = pc.binary_length(core).to_numpy(zero_copy_only=False), words.filter(simple)
        tailed = np.flatnonzero(sizes < pc.binary_length(full).to_numpy(zero_copy_only=False))
        tails = pa.array([w[len(c) :] for w, c in zip(full.take(pa.array(tailed)).to_pylist(), core.take(pa.array(tailed)).to_pylist(), strict=True)], pa.string()).dictionary_encode()
        ids1, at1, n1 = self.of_letters(letters.dictionary)
        ids2, at2, n2 = self.of_letters(tails.dictionary)
        each = self.plain(words.take(pa.array(other, pa.int64())).to_pylist())
        ids = np.concatenate([ids1, ids2, *each])
        first, tail = letters.indices.to_numpy(), tails.indices.to_numpy()
        # one unit for each word that is a single part, two for letters with a tail
        units = np.ones(len(words), np.int64)
        units[mine[tailed]] = 2
        place = np.cumsum(units) - units
        at, number = np.zeros(int(units.sum()), np.int64), np.zeros(int(units.sum()), np.int64)
        at[place[mine]], number[place[mine]] = at1[first], n1[first]
        at[place[mine[tailed]] + 1], number[place[mine[tailed]] + 1] = len(ids1) + at2[tail], n2[tail]
        number[place[other]] = [len(x) for x in each]
        at[place[other]] = len(ids1) + len(ids2) + np.cumsum(number[place[other]]) - number[place[other]]
        out, ends = gathered(ids, at, number), np.cumsum(number)
        last = ends[place + units - 1] if len(words) else ends
        total = np.diff(last, prepend=0)
        return out, last - total, total

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, one text behind the other, and the number of each."""
        whole = pc.match_substring_regex(texts, WHOLE)
        split = pc.ascii_split_whitespace(pc.if_else(whole, "", texts))
        coded = split.flatten().dictionary_encode()
        ids, at, number = self.of_words(coded.dictionary)
        word = coded.indices.to_numpy()
        out = gathered(ids, at[word], number[word])
        edges = np.concatenate(([0], np.cumsum(number[word])))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        lengths = np.diff(edges)
        if pc.any(whole).as_py():
            own = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
            pieces, last = [], 0
            for i, x in zip(own.tolist(), self.plain(texts.take(pa.array(own)).to_pylist()), strict=True):
                pieces += [out[last : edges[i]], x]
                last, lengths[i] = edges[i], len(x)
            out = np.concatenate([*pieces, out[last:]])
        return out, lengths


_made: dict[str, WordEncoder] = {}


def encoder(data: str) -> WordEncoder:
    key = hashlib.sha256(data.encode()).hexdigest()
    if key not in _made:
        _made[key] = WordEncoder(data)
    return _made[key]


SHARDS = "part int, shard int, file string, docs long, tokens long"


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int, *, id_column: str = "doc_id", text_column: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards and returns (part, shard, file, docs, tokens): shards in order of part and shard hold the
    documents in ascending order. Files have names of their own from each attempt, so a task may run again."""
    spark = common.ready(df.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the place in the table deals rows of one id, or of none, over several ranges
    rows = df.select(F.col(id_column).cast("long").alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_t"), F.monotonically_increasing_id().alias("_n"))
    order = [F.col("_id").asc_nulls_first(), F.col("_n")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("_id", "_t")
    sent = spark.sparkContext.broadcast(tokenizer)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, part = encoder(sent.value), TaskContext.get().partitionId()
        held: list[tuple[list, np.ndarray, np.ndarray]] = []  # doc ids, numbers of tokens, tokens
        waiting: list[pa.RecordBatch] = []
        shard = 0

        def encode() -> None:
            table = pa.Table.from_batches(waiting)
            waiting.clear()
            ids, lengths = e.encode(table.column(1).combine_chunks())
            ends = np.cumsum(lengths + 1) - 1
            seq = np.full(len(ids) + len(lengths), end_id, e.kind)
            inside = np.ones(len(seq), bool)
            inside[ends] = False
            seq[inside] = ids
            held.append((table.column(0).to_pylist(), lengths + 1, seq))

        def close(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            """Files of whole documents until fewer tokens are left than a shard has, or none."""
            nonlocal shard
            docs, lengths, seq = [d for h in held for d in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            held.clear()
            ends, first, before = np.cumsum(lengths), 0, 0
            while first < len(docs) and (all_of_it or ends[-1] - before >= shard_tokens):
                last = min(int(np.searchsorted(ends, before + shard_tokens)) + 1, len(docs))
                z = int(ends[last - 1])
                file = f"{part:06d}-{shard:06d}-{uuid.uuid4().hex}.twm"
                common.write_file(f"{folder}/{file}", packed(seq[before:z], docs[first:last], lengths[first:last]))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([file]), pa.array([last - first]), pa.array([z - before])], names=["part", "shard", "file", "docs", "tokens"])
                first, before, shard = last, z, shard + 1
            if first < len(docs):
                held.append((docs[first:], lengths[first:], seq[before:]))

        size = 0
        for b in batches:
            waiting.append(b)
            size += b.nbytes
            if size >= TEXT_BYTES:
                encode()
                size = 0
                yield from close(False)
        if waiting:
            encode()
        if held:
            yield from close(True)

    return rows.mapInArrow(task, SHARDS)


def read(shards: DataFrame, folder: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_end_ids) of every document, from the shards' files. start counts the tokens of all
    documents before it: of earlier parts (one row a part goes to the driver), of earlier shards, and in the shard.
    n_end_ids: how often the end id stands in the document, by rank at its two ends."""
    from pyspark.sql import Window

    spark = common.ready(shards.sparkSession)
    before, total = {}, 0
    for r in shards.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect():
        before[r["part"]] = total
        total += r["n"]
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = shards.select("part", "file", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("at"))
    n = max(1, shards.count())
    dealt = files.repartition(min(n, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, file, at in zip(*[c.to_pylist() for c in b.columns], strict=True):
                shard = Shard.of(common.read_file(f"{folder}/{file}"))  # all of it is asked for
                m, (ids, lengths) = shard.matrix, shard.documents()
                seq = m.decode(np.uint16 if len(m.planes) <= 16 else np.uint32)
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                marks = np.diff(m.ranks(end_id, np.concatenate(([0], ends))))
                crc = [zlib.crc32(seq[a:z].astype("<u4").tobytes()) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(ids, pa.int64()), pa.array(starts + at + before[part]), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(marks)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "n_end_ids"])

    return dealt.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long, n_end_ids long")


END_ID = 2


def op4_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as wavelet shards and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = common.scratch(spark, "wavelet")
    shards = common.kept(write(docs, folder, vocabulary("word_bpe_49k.json").decode(), END_ID), "shards")
    return read(shards, folder, END_ID)
