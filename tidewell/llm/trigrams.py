"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regex is turned into a Boolean query over the three-character strings that every match must hold (the
analysis of Cox 2012: sets of exact strings, prefixes and suffixes, combined bottom-up). The documents are indexed by the
trigrams of all queries: postings are arrays of row ids by trigram and block. A query intersects and unites its
postings block by block; only those candidates are verified by the regex. A rule without a mandatory trigram has no
query and scans everything.

Case is folded in the index, and a literal outside ASCII, whose folding may differ, counts as unknown, so a candidate set can be
too large but never too small.

Positions of matches come from the text itself: the pieces between the matches (split) and the matches have known
lengths, whose running sums are the starts.

Defined cases: a null text is empty; null ids are ids like any other; rows that share an id are all verified; very long texts
are scanned whole; an empty table gives no rows; extra columns, whatever their names, are ignored unless they are carried.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

try:
    import re._parser as sre
except ImportError:  # before Python 3.11
    import sre_parse as sre

#: Row ids in a posting at most.
BLOCK = 4096
#: Strings in a set of the analysis at most; larger sets become a query.
SET_MAX = 32


@dataclass(frozen=True)
class Rule:
    """kind names the rule; matches whose ``group`` has fewer than ``least`` characters are dropped.

    ``gate`` is an equivalent test that a text can only pass if it has a match that is long enough.
    """

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    gate: str | None = None


#: The patterns and least lengths of the base, in the order that breaks ties.
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
]


# Boolean queries: True (everything), a trigram, ("and", frozenset) or ("or", frozenset)


def _all(parts) -> object:
    flat: set = set()
    for p in parts:
        if p is not True:
            flat |= p[1] if isinstance(p, tuple) and p[0] == "and" else {p}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _any(parts) -> object:
    flat: set = set()
    for p in parts:
        if p is True:
            return True
        flat |= p[1] if isinstance(p, tuple) and p[0] == "or" else {p}
    held = {p: p[1] if isinstance(p, tuple) and p[0] == "and" else {p} for p in flat}
    flat = {p for p in flat if not any(held[q] < held[p] for q in flat)}  # a or (a and b) is a
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def _of(strings) -> object:
    """What a text must hold if it holds one of the strings."""
    return _any([_all(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


@dataclass
class _Info:
    """exact: all strings that match, or None if too many. Else prefixes and suffixes that a match must have one of."""

    exact: set | None
    prefix: set
    suffix: set
    query: object

    def simple(self) -> _Info:
        if self.exact is not None and len(self.exact) > SET_MAX:
            return _Info(None, {s[:2] for s in self.exact}, {s[-2:] for s in self.exact}, _all([self.query, _of(self.exact)]))
        if self.exact is None:
            q = _all([self.query, _of(self.prefix), _of(self.suffix)])
            pre, suf = {s[:2] for s in self.prefix}, {s[-2:] for s in self.suffix}
            return _Info(None, pre if len(pre) <= SET_MAX else {""}, suf if len(suf) <= SET_MAX else {""}, q)
        return self


_ANY = lambda: _Info(None, {""}, {""}, True)


def _join(x: _Info, y: _Info) -> _Info:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= SET_MAX * 4:
        return _Info({a + b for a, b in product(x.exact, y.exact)}, set(), set(), _all([x.query, y.query])).simple()
    xs, ys = (x.exact if x.exact is not None else x.suffix), (y.exact if y.exact is not None else y.prefix)
    across = _of({a + b for a, b in product(xs, ys)}) if len(xs) * len(ys) <= SET_MAX * SET_MAX else True
    pre = {a + b for a, b in product(x.exact, ys)} if x.exact is not None and len(x.exact) * len(ys) <= SET_MAX * 4 else x.prefix if x.exact is None else {s[:2] for s in x.exact}
    suf = {a + b for a, b in product(xs, y.exact)} if y.exact is not None and len(xs) * len(y.exact) <= SET_MAX * 4 else y.suffix if y.exact is None else {s[-2:] for s in y.exact}
    return _Info(None, pre, suf, _all([x.query, y.query, across])).simple()


def _either(infos: list[_Info]) -> _Info:
    if all(i.exact is not None for i in infos):
        return _Info(set().union(*[i.exact for i in infos]), set(), set(), _any([i.query for i in infos]) if any(i.query is not True for i in infos) else True).simple()
    full = [_Info(None, i.exact, i.exact, _all([i.query, _of(i.exact)])) if i.exact is not None else i for i in infos]
    return _Info(None, set().union(*[i.prefix for i in full]), set().union(*[i.suffix for i in full]), _any([i.query for i in full])).simple()


def _fold(c: int) -> str:
    return chr(c + 32) if 65 <= c <= 90 else chr(c)


def _known(lo: int, hi: int) -> bool:
    """Whether lower() leaves these characters alone but for A to Z; other alphabets fold in ways of their own."""
    return lo < 128 and hi < 128


def _walk(tree) -> _Info:
    out = _Info({""}, set(), set(), True)
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            one = _Info({_fold(arg)}, set(), set(), True) if _known(arg, arg) else _ANY()
        elif name == "IN":
            chars: set | None = set()
            for o, v in arg:
                if chars is None or str(o) in ("NEGATE", "CATEGORY"):
                    chars = None
                elif str(o) == "LITERAL" and _known(v, v):
                    chars.add(_fold(v))
                elif str(o) == "RANGE" and _known(*v) and v[1] - v[0] < 64:
                    chars |= {_fold(c) for c in range(v[0], v[1] + 1)}
                else:
                    chars = None
            one = _ANY() if chars is None or len(chars) > SET_MAX // 4 else _Info(chars, set(), set(), True)
        elif name == "SUBPATTERN":
            one = _walk(arg[3])
        elif name == "BRANCH":
            one = _either([_walk(b) for b in arg[1]])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = arg
            if high == 1 and low == 0:
                one = _either([_Info({""}, set(), set(), True), _walk(body)])
            elif low == 0:
                one = _ANY()
            else:
                one = _walk(body)
                for _ in range(min(int(low), 4) - 1):
                    one = _join(one, _walk(body))
                if int(low) != high or int(low) > 4:
                    one = _join(one, _ANY())
        elif name == "AT":
            continue
        else:
            one = _ANY()
        out = _join(out, one)
    return out


def trigram_query(regex: str) -> object:
    """The Boolean trigram query of a regex, in lower case; True if there is no trigram that every match must hold."""
    i = _walk(sre.parse(regex))
    return _all([i.query, _of(i.exact)]) if i.exact is not None else _all([i.query, _of(i.prefix), _of(i.suffix)])


def trigrams_of(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def index(df: DataFrame, trigrams: list[str], *, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """Postings (trigram, block, ids): for the trigrams given, the ids of the rows that hold them, ids in order, about
    ``block`` to a posting at most: a block is a partition of the rows, or a hash class of its ids if it has more.

    The partition's number also keeps the optimizer from testing a row's trigrams once more for each later filter.
    """
    low = F.lower(F.coalesce(F.col(text_column), F.lit("")))
    rows = common.spread(df.select(F.col(id_column).alias("_id"), low.alias("_t")))
    classes = max(1, -(-df.count() // (block * max(1, common.partitions(rows)))))
    held = F.array_compact(F.array(*[F.when(F.contains("_t", F.lit(g)), F.lit(g)) for g in trigrams]))
    rows = rows.select("_id", held.alias("_g"), F.spark_partition_id().cast("long").alias("_p")).select("_id", "_p", F.explode("_g").alias("trigram"))
    return rows.groupBy("trigram", (F.col("_p") * classes + F.pmod(F.xxhash64("_id"), F.lit(classes))).alias("block")).agg(F.sort_array(F.collect_set(F.struct(F.col("_id").alias("id")))).alias("ids"))


def candidates(postings: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(kind, id): the rows that satisfy each query. Postings of a block meet in one row, where they are intersected and united."""
    by = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("p"))
    none = F.lit(None).cast(postings.schema["ids"].dataType)

    def ids(q) -> Column:
        if isinstance(q, str):
            return F.coalesce(F.try_element_at("p", F.lit(q)), F.array_compact(F.array(none[0])))
        parts = [ids(x) for x in sorted(q[1], key=str)]
        out = parts[0]
        for x in parts[1:]:
            out = F.array_intersect(out, x) if q[0] == "and" else F.array_union(out, x)
        return out

    parts = [by.select(F.lit(kind).alias("kind"), F.explode(ids(q)).alias("x")) for kind, q in queries.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("kind", F.col("x.id").alias("id"))


def spans_of(text: str, rule: Rule, order: int) -> Column:
    """The rule's matches in a column: structs (start, kind_order, end, kind) in code points, short ones dropped."""
    whole = F.regexp_extract_all(F.col(text), F.lit(rule.regex), F.lit(0))
    part = F.regexp_extract_all(F.col(text), F.lit(rule.regex), F.lit(rule.group))
    between = F.split(F.col(text), rule.regex, -1)
    walk = F.aggregate(
        F.arrays_zip(between.alias("b"), whole.alias("m"), part.alias("g")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,o:int,end:int,kind:string>>").alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["b"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
            F.when(
                F.coalesce(F.length(x["g"]), F.lit(0)) >= rule.least,
                F.concat(acc["found"], F.array(F.struct((acc["at"] + F.length(x["b"])).alias("start"), F.lit(order).alias("o"), (acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("end"), F.lit(rule.kind).alias("kind")))),
            ).otherwise(acc["found"]).alias("found"),
        ),
    )
    return walk["found"]


def scan(df: DataFrame, rules: list[Rule] | None = None, *, id_column: str = "doc_id", text_column: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """Every row's id (_id), its text (_t), the columns to carry by their new names, and spans: all matches of all rules by start, then the rules' order.

    The candidates' ids, with the kinds to verify, are joined back by id: broadcast if they are counted to few, else by
    a shuffle join on the unique ids. Rules without a query are verified on every row.
    """
    rules = rules or RULES
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) is not True}
    rows = df.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_t"), *[c.alias(k) for k, c in (carry or {}).items()])
    rows = common.spread(rows)
    if queries:
        grams = sorted(set().union(*map(trigrams_of, queries.values())))
        found = candidates(common.kept(index(df, grams, id_column=id_column, text_column=text_column), "postings"), queries)
        flags = common.kept(found.groupBy("id").agg(F.collect_set("kind").alias("_kinds")), "candidates")
        rows = common.join_small_or_salted(rows, flags.withColumnRenamed("id", "_id"), "_id", "_id", salts=1)
    empty = F.array().cast("array<struct<start:int,o:int,end:int,kind:string>>")
    each = []
    for i, r in enumerate(rules):
        test = F.coalesce(F.array_contains("_kinds", r.kind), F.lit(False)) if r.kind in queries else F.lit(True)
        if r.gate:
            test &= F.col("_t").rlike(r.gate)
        each.append(F.when(test, spans_of("_t", r, i)).otherwise(empty))
    out = F.concat(*each)
    return rows.select("_id", "_t", *(carry or []), F.sort_array(out).alias("spans"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: str, spans: str) -> Column:
    """The text with every span, overlapping ones as one, replaced by [kind of the first]."""
    walk = F.aggregate(
        F.col(spans),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.when(
            x["start"] >= acc["at"],
            F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(F.col(text), acc["at"] + 1, x["start"] - acc["at"]), F.concat(F.lit("["), x["kind"], F.lit("]")))).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, walk).otherwise(F.col(text))


def op3_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs)
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    out = found.select(F.col("_id").alias("doc_id"), n("assign"), n("access"), n("hex"), joined("spans").alias("spans"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


OP3_SQL = r"""
WITH r(kind, o, re, grp, least) AS (VALUES
  ('assign', 0, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 16),
  ('hex', 2, '[0-9a-f]+', 0, 32)),
x AS (
  SELECT doc_id, kind, o, least, CASE kind WHEN 'assign' THEN regexp_extract_all(t, re, 0) ELSE regexp_extract_all(t, re, 0) END AS m,
         CASE kind WHEN 'assign' THEN regexp_extract_all(t, re, 2) ELSE regexp_extract_all(t, re, 0) END AS g,
         string_split_regex(t, re) AS b
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), r),
y AS (
  SELECT doc_id, kind, o, least, unnest(m) AS m, unnest(g) AS g, unnest(b[1:len(m)]) AS b, unnest(range(len(m))) AS i FROM x),
z AS (
  SELECT doc_id, kind, o, least, length(m) AS n, length(g) AS gn,
         sum(length(b) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM y),
s AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || (e - n)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - n, o) AS spans
  FROM z WHERE gn >= least GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM (SELECT doc_id FROM documents) d LEFT JOIN s USING (doc_id)
"""
