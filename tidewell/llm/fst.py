"""Token counts by a finite-state transducer that is compiled from a vocabulary.

The vocabulary is of scored pieces: adjacent symbols merge where their join is a piece, best score first, leftmost among
equals. Such merges have a local form: the tokens of a prefix are the tokens of a shorter prefix and one more piece, the
only one that ends there and that stays apart from the token before it. Hence a deterministic transducer reads the
text from left to right. Its state is the longest suffix that a piece could still extend, with the last token and the
relative count at each place in it; a transition is annotated with the change of the token count. States and transitions
are made when they are first needed; what a transition is depends on the vocabulary alone.

Chunks: a text is read in chunks of CHUNK characters, and a chunk is a map from states to (state, count). Maps compose
associatively, so those of a text are composed pairwise, in rounds, as in a parallel prefix scan. A map holds the entry
states that matter: the start for a first chunk, and for a later one the state that the OVERLAP characters before it lead
to, which hardly ever depends on what is before those; if another state comes in after all, the chunk is run for it too. Texts
over LONG characters are cut into rows, so that their chunks are run by many tasks; their maps, a row for each chunk, are then
composed.

Inside a chunk: no piece has a space mark after another character, so a space mark after one always leads from the start
state. What stands between two such places is one transition of the transducer with the count that its characters
have together; a worker remembers those of short words.

Defined cases: a null text is empty; an empty text has no tokens; null ids and repeated rows are returned as they come;
very long texts are cut as described; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import vocabulary

SPACE = "▁"
#: Characters of a chunk.
CHUNK = 1 << 16
#: Characters before a chunk that tell its entry state, and characters of a text over which its chunks become rows.
OVERLAP, LONG = 256, 1 << 20
#: States that a worker keeps; beyond it, after a chunk, it starts anew.
STATES = 250_000
#: Words that a worker remembers, and characters of the longest.
MEMORY, WORD = 450_000, 64

#: (suffix that a piece could extend, last token at each place in it, relative count at each place)
State = tuple[str, tuple, tuple]
START: State = ("", (None,), (0,))


class ChunkMap:
    """A map from states to (state, count): of a chunk's text, or of two maps one after the other. What it is asked for again
    it knows already."""

    def __init__(self, fst: Transducer, text: str = "", parts: tuple[ChunkMap, ...] = ()) -> None:
        self.fst, self.text, self.parts = fst, text, parts
        self.known: dict[State, tuple[State, int]] = {}

    def __call__(self, state: State) -> tuple[State, int]:
        if (got := self.known.get(state)) is None:
            if self.parts:
                mid, a = self.parts[0](state)
                end, b = self.parts[1](mid)
                got = end, a + b
            else:
                got = self.fst.run(self.text, state)
            self.known[state] = got
        return got


def composed(a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """First a, then b, for all entry states that a knows."""
    out = ChunkMap(a.fst, parts=(a, b))
    for state in a.known:
        out(state)
    return out


class Transducer:
    def __init__(self, scores: dict[str, float], fallback: bool = True) -> None:
        """scores: the pieces that merges can make. Characters that are no piece count their UTF-8 bytes (fallback) or one."""
        self.scores, self.fallback = scores, fallback
        self.longest = max(map(len, scores), default=1)
        self.resets = not any(b == SPACE != a for p in scores for a, b in zip(p, p[1:], strict=False))
        self.prefixes = {p[:i] for p in scores for i in range(1, len(p))}
        self.own = {p: p for p in scores}  # one object for each piece, however many states hold it
        self.apart: dict[tuple[str, str], bool] = {}
        self.memory: dict[str, int] = _Words(self)
        self.clear()

    def clear(self) -> None:
        self.states: list[State] = [START]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def merged(self, text: str) -> list[str]:
        """The pieces by definition: merge the best pair until none is left. For short strings."""
        s = list(text)
        while len(s) > 1:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if a + b in self.scores), default=None)
            if best is None:
                break
            i = -best[1]
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s

    def stays_apart(self, a: str, b: str) -> bool:
        if (found := self.apart.get((a, b))) is None:
            found = self.apart[a, b] = self.merged(a + b) == ([a, b] if b else [a])
        return found

    def step(self, state: int, c: str) -> tuple[int, int]:
        """The transition of a state by a character: next state and change of the count. Makes it if it is new."""
        suffix, lasts, counts = self.states[state]
        if self.resets and c == SPACE and suffix[-1:] != SPACE:
            suffix, lasts, counts = "", (None,), (0,)
            if state and (move := self.moves[0].get(c)):
                self.moves[state][c] = move
                return move
        s = suffix + c
        if c not in self.scores and c not in self.prefixes:
            new, gain = ("", (None,), (0,)), len(c.encode("utf-8", "surrogatepass")) if self.fallback else 1
        else:
            for n in range(len(s), 0, -1):
                t, at = s[-n:], len(s) - n
                if (n == 1 or t in self.scores) and (lasts[at] is None or self.stays_apart(lasts[at], t)) and self.merged_is(t):
                    break
            else:
                raise AssertionError(f"no piece ends {s!r}")
            weight = 1 if t in self.scores else len(t.encode()) if self.fallback else 1
            gain = counts[at] + weight
            keep = next(n for n in range(len(s), -1, -1) if n == 0 or s[-n:] in self.prefixes)
            lasts, counts = (*lasts, self.own.get(t, t)), (*(x - gain for x in counts), 0)
            new = (s[-keep:] if keep else "", lasts[len(s) - keep :], counts[len(s) - keep :])
        if (to := self.number.get(new)) is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
            self.moves.append({})
        self.moves[state][c] = to, gain
        return to, gain

    def merged_is(self, t: str) -> bool:
        """Whether a piece is what its own characters merge to; a piece that isn't never comes out."""
        return self.stays_apart(t, "")

    def walked(self, text: str, state: int = 0) -> tuple[int, int]:
        """The state after a normalised text, and the change of the count, character by character."""
        moves, n = self.moves, 0
        for c in text:
            move = moves[state].get(c) or self.step(state, c)
            state, gain = move
            n += gain
        return state, n

    def run(self, text: str, state: State = START) -> tuple[State, int]:
        """The state after a chunk of a normalised text, and the change of the count."""
        if (at := self.number.get(state)) is None:
            at = self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        m = _RESET.search(text) if self.resets else None
        if not m:
            end, n = self.walked(text, at)
        else:
            _, n = self.walked(text[: m.start()], at)
            body = text[m.start() + 1 :]
            *words, last = body.split(SPACE) if SPACE * 2 not in text else [x[1:] for x in _UNIT.findall(text, m.start())]
            n += sum(map(self.memory.__getitem__, words))
            end, more = self.walked(SPACE + last)
            n += more
        out = self.states[end]
        self.trim()
        return out, n

    def entered(self, before: str) -> State:
        """The entry state that a chunk most likely has, from the characters before it."""
        return self.run(before[-OVERLAP:])[0] if before else START

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """The tokens of a text, by the maps of its chunks."""
        if not text:
            return 0
        n = SPACE + text.replace(" ", SPACE)
        maps = []
        for i in range(0, len(n), chunk):
            maps.append(ChunkMap(self, n[i : i + chunk]))
            maps[-1](self.entered(n[max(0, i - OVERLAP) : i]))
        while len(maps) > 1:
            maps = [composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0](START)[1]

    def trim(self) -> None:
        if len(self.states) > STATES:
            self.clear()
        if len(self.memory) > MEMORY:
            self.memory.clear()
        if len(self.apart) > 2 * STATES:
            self.apart.clear()


#: A place that leads from the start state: a space mark after another character; and what stands from one to the next.
_RESET = re.compile(f"(?<=[^{SPACE}]){SPACE}")
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")


class _Words(dict):
    """Word -> tokens of the word with a space mark before it. Long ones are not remembered."""

    def __init__(self, fst: Transducer) -> None:
        self.fst = fst

    def __missing__(self, word: str) -> int:
        n = self.fst.walked(SPACE + word)[1]
        if len(word) <= WORD:
            self[word] = n
        return n


_made: dict[str, Transducer] = {}


def transducer(model: bytes) -> Transducer:
    """The worker's transducer for a sentencepiece model of type BPE with identity normalisation and a space mark in front."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _made:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = range(sp.get_piece_size())
        pieces = [i for i in n if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        probe = "Aé éﬁ   \t\n x "
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model's normalisation is not the identity with a space mark in front")
        _made[key] = Transducer({sp.id_to_piece(i): sp.get_score(i) for i in pieces}, any(sp.is_byte(i) for i in n))
    return _made[key]


def counted(df: DataFrame, model: bytes, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, n_bytes, n_tokens) of every whole text."""
    spark = common.ready(df.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = df.select(F.col(id_column), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_t"))
    sent = spark.sparkContext.broadcast(model)
    schema = rows.select(id_column, "n_bytes").schema.add("n_tokens", "long")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = transducer(sent.value)
        for b in batches:
            n = np.fromiter(map(f.count, b.column(2).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], names=schema.names)

    whole = rows.where(F.col("n_bytes") <= LONG)
    out = common.spread(whole).mapInArrow(task, schema)
    long = common.kept(rows.where(F.col("n_bytes") > LONG).select(F.monotonically_increasing_id().alias("_key"), "*"), "long")
    if not long.head(1):
        return out
    totals = long_counts(long.select("_key", "_t"), sent)
    return out.unionByName(long.drop("_t").join(totals, "_key").select(*schema.names))


def _to_text(state: State) -> str:
    return json.dumps(state)


def _from_text(text: str) -> State:
    suffix, lasts, counts = json.loads(text)
    return suffix, tuple(lasts), tuple(counts)


MAPS = "_key long, i int, entry string, exit string, n long"


def long_counts(texts: DataFrame, sent, chunk: int | None = None) -> DataFrame:
    """(_key, n_tokens) of (_key, _t), written texts. Each chunk is a row; a text is settled when its maps compose from the start to
    its end; chunks that another state came into are run for it, and the maps are composed again."""
    size = chunk or CHUNK

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n = SPACE + t.as_py().replace(" ", SPACE)
                for i, at in enumerate(range(0, len(n), size)):
                    before = n[max(0, at - OVERLAP) : at]
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([i], pa.int32()), pa.array([before]), pa.array([n[at : at + size]])], names=["_key", "i", "before", "t"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = transducer(sent.value)
        for b in batches:
            out = []
            for key, i, before, t, entry in zip(*[c.to_pylist() for c in b.columns], strict=True):
                state = _from_text(entry) if entry is not None else f.entered(before)
                end, n = f.run(t, state)
                out.append((key, i, _to_text(state), _to_text(end), n))
            if out:
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["_key", "i", "entry", "exit", "n"])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(_key, n_tokens, i, entry): the total, or the first chunk that lacks the state which comes into it."""
        start = _to_text(START)
        for t in common.groups(batches, ["_key"]):
            maps: list[dict[str, tuple[str, int]]] = []
            for i, entry, end, n in zip(*[t[c].to_pylist() for c in ("i", "entry", "exit", "n")], strict=True):
                if i == len(maps):
                    maps.append({})
                maps[i][entry] = end, n
            level = maps
            while len(level) > 1:
                level = [{e: (y[0], n + y[1]) for e, (x, n) in a.items() if (y := b.get(x))} for a, b in zip(level[::2], level[1::2], strict=False)] + ([level[-1]] if len(level) % 2 else [])
            total, stuck, at = level[0].get(start), None, start
            if total is None:
                for k, m in enumerate(maps):
                    if at not in m:
                        stuck = k
                        break
                    at = m[at][0]
            yield pa.RecordBatch.from_arrays([t["_key"].combine_chunks()[:1], pa.array([total and total[1]], pa.int64()), pa.array([stuck], pa.int32()), pa.array([None if stuck is None else at], pa.string())], names=["_key", "n_tokens", "i", "entry"])

    chunks = common.kept(texts.mapInArrow(cut, "_key long, i int, before string, t string").repartition("_key", "i"), "chunks")
    maps = common.kept(chunks.withColumn("entry", F.lit(None).cast("string")).mapInArrow(mapped, MAPS), "maps")
    while True:
        by_text = maps.repartition("_key").sortWithinPartitions("_key", "i")
        out = common.kept(by_text.mapInArrow(settled, "_key long, n_tokens long, i int, entry string"), "totals")
        open_ = out.where("i is not null").select("_key", "i", "entry")
        if not open_.head(1):
            return out.select("_key", "n_tokens")
        maps = common.kept(maps.unionByName(chunks.join(open_, ["_key", "i"]).mapInArrow(mapped, MAPS)), "maps")


TOKEN_LIMIT = 4096


def op7_token_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents with the 32k piece vocabulary."""
    out = counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
