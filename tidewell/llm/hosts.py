"""Host-level quality rules, in DataFrame functions only.

Every document is measured by rules on its words, lines and symbols. Failures are counted by host, and each host's failure
rate is drawn towards the rate of all hosts by a beta prior that is fitted to the spread of the hosts themselves: a host
with few documents is judged mostly by the prior, one with many by its own documents. The verdict is joined back to its documents:

- a host that by its posterior fails a rule more often than hosts do (its mean less ``Z`` standard deviations is over the prior's
  mean) is *strict* in it, and its documents that fail the rule go;
- a host that fails a rule, or the base, in most of its documents (its mean less ``Z_BAD`` standard deviations is over ``BAD``) is *bad*,
  and all its documents go.

So a document with a lapse stays where such lapses are rare and goes where they are the habit; a good document goes only with a bad host.

Defined cases: a null text has no words and fails the base; a null host is a host of its own; repeated rows count and
are returned as often as they come; very long texts are measured whole, in their own row; an empty table gives no rows; extra
columns, whatever their names, are ignored unless they are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
#: In percent of the words, and of the lines with a word.
MAX_REPEAT, MAX_SYMBOLS, MAX_DUP_LINES = 50, 20, 30
#: Tenths of a character that a text's words may have on average.
WORD_LENGTH = 20, 120
SYMBOLS = "#*$%&|<>"
#: The rules of a document: ``base`` stands for short ones and those that repeat themselves, which go whatever their host.
RULES = ("base", "symbols", "lines", "lengths")
#: Standard deviations of the posterior for a strict host and for a bad one, and the rate of a bad one.
Z, Z_BAD, BAD = 0.5, 1.96, 0.5
#: Documents that the prior counts for at most: it keeps hosts apart whose rates differ no more than chance would have it.
MOST_STRENGTH = 100.0


def measured(df: DataFrame, text_column: str, carry: dict[str, Column]) -> DataFrame:
    """carry's columns, and per row the measures of its whole text.

    Repeated windows: the windows' hashes are sorted with their places in the row itself, so no row leaves its task.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    a = common.spread(df.select(*[c.alias(k) for k, c in carry.items()], text.alias("_t")))
    a = a.withColumn("_w", F.filter(F.split("_t", common.WORD_SPACE), lambda x: x != ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = a.withColumn("_l", lines)
    without = lambda chars: F.length(F.translate("_t", chars, ""))
    a = a.select(
        *carry,
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        without(" \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length("_t") - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
    )
    hashes = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.col("_w")[i], F.col("_w")[i + 1], F.col("_w")[i + 2])))
    a = a.withColumn("_h", hashes).drop("_w")
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    a = a.withColumn("_s", F.when(again, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_h")
    near = lambda x, k: F.coalesce(F.get("_s", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False))
    a = a.withColumn("_p", F.sort_array(F.transform(F.filter("_s", near), lambda x: x["i"]))).drop("_s")
    gain = F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3))))
    total = F.coalesce(F.aggregate(gain, F.lit(0), lambda x, y: x + y), F.lit(0)).cast("long")
    a = a.withColumn("n_repeat_words", total).drop("_p")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    fails = {
        "base": base,
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words"),
        "lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"),
        "lengths": (10 * F.col("word_chars") < WORD_LENGTH[0] * F.col("n_words")) | (10 * F.col("word_chars") > WORD_LENGTH[1] * F.col("n_words")),
    }
    return a.select("*", base.alias("base_failed"), *[c.alias(f"f_{r}") for r, c in fails.items()])


def host_verdicts(rows: DataFrame, host: str, rules: tuple[str, ...]) -> DataFrame:
    """(host, host_docs, rate_<rule>, strict_<rule>..., bad) for each host of rows, which hold f_<rule>; rate is the posterior mean.

    The prior of a rule, from one row of sums over the hosts: mean m of all documents; variance between hosts v, less
    what chance alone gives; strength s = m(1 - m)/v - 1, from 1 to MOST_STRENGTH. The posterior of k failures among n documents
    is the beta distribution of k + m s and n - k + (1 - m) s.
    """
    by = rows.groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), *[F.sum(F.col(f"f_{r}").cast("long")).alias(f"k_{r}") for r in rules])
    by = common.kept(by, "hosts")
    n = F.col("host_docs")
    s = by.agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("hosts"), *[x for r in rules for x in (F.sum(f"k_{r}").alias(f"k_{r}"), F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / n).alias(f"q_{r}"))]).first()
    rates, strict, bad = [], [], F.lit(False)
    for r in rules:
        m = (s[f"k_{r}"] or 0) / max(s["n"] or 0, 1)
        spread = (s[f"q_{r}"] or 0) / max(s["n"] or 0, 1) - m * m - m * (1 - m) * s["hosts"] / max(s["n"] or 0, 1)
        strength = min(max(m * (1 - m) / spread - 1, 1.0), MOST_STRENGTH) if spread > 0 else MOST_STRENGTH
        mean = (F.col(f"k_{r}") + m * strength) / (n + strength)
        deviation = F.sqrt(mean * (1 - mean) / (n + strength + 1))
        rates.append(mean.alias(f"rate_{r}"))
        strict.append((mean - Z * deviation > m).alias(f"strict_{r}"))
        bad |= mean - Z_BAD * deviation > BAD
    return by.select(host, "host_docs", *rates, *strict, bad.alias("bad"))


def judged(df: DataFrame, *, id_column: str = "doc_id", host_column: str = "source", text_column: str = "text", carry: dict[str, Column] | None = None, rules: tuple[str, ...] = RULES) -> DataFrame:
    """The measures of every row, its host's size, rates and verdicts, and kept. The measured rows are written once and read twice; with columns
    to carry, which may be as large as the table, a stored table is measured twice instead."""
    rows = measured(df, text_column, {"_id": F.col(id_column), "_host": F.col(host_column)} | (carry or {}))
    if carry and common.stored(df):
        rows = rows.withColumn("_read", F.monotonically_increasing_id())  # a filter isn't pushed below it, where it would make every measure again
    else:
        rows = common.kept(rows, "measured").withColumn("_read", F.lit(0))
    hosts = host_verdicts(rows, "_host", rules)
    both = common.join_small_or_salted(rows, hosts, "_host")
    gone = F.col("base_failed") | F.col("bad")
    for r in rules:
        gone |= F.col(f"strict_{r}") & F.col(f"f_{r}")
    return both.withColumn("kept", ~gone & (F.col("_read") >= 0)).drop("_read")


OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged, with source as the host."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs).select(F.col("_id").alias("doc_id"), *OUT, F.col("_host").alias("host"))


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT row_id, unnest(l) AS x, unnest(range(len(l))) AS i
  FROM (SELECT row_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM d)),
g AS (
  SELECT row_id, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM w WINDOW o AS (PARTITION BY row_id ORDER BY i)),
c AS (
  SELECT row_id, i, z IS NOT NULL AND count(*) OVER (PARTITION BY row_id, x, y, z) > 1 AS again FROM g),
r AS (
  SELECT row_id, count(*) AS n_words, count(*) FILTER (hit) AS n_repeat_words
  FROM (SELECT row_id, again OR coalesce(lag(again) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS hit
        FROM c WINDOW o AS (PARTITION BY row_id ORDER BY i)) GROUP BY row_id),
l AS (
  SELECT row_id, count(*) - count(DISTINCT x) AS n_dup_lines, count(*) AS n_lines
  FROM (SELECT row_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY row_id),
m AS (
  SELECT d.doc_id, source, coalesce(n_words, 0)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN r USING (row_id) LEFT JOIN l USING (row_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS f1, 100 * n_symbols > 20 * n_words AS f2,
         100 * n_dup_lines > 30 * n_lines AS f3, 10 * word_chars < 20 * n_words OR 10 * word_chars > 120 * n_words AS f4 FROM m),
h AS (
  SELECT source, count(*)::DOUBLE AS n, unnest([1, 2, 3, 4]) AS rule,
         unnest([count(*) FILTER (f1), count(*) FILTER (f2), count(*) FILTER (f3), count(*) FILTER (f4)])::DOUBLE AS k
  FROM f GROUP BY source),
p AS (
  SELECT rule, sum(k) / sum(n) AS m, count(*) AS hosts, sum(n) AS docs, sum(k * k / n) / sum(n) AS q FROM h GROUP BY rule),
s AS (
  SELECT rule, m, CASE WHEN q - m * m - m * (1 - m) * hosts / docs > 0
    THEN least(greatest(m * (1 - m) / (q - m * m - m * (1 - m) * hosts / docs) - 1, 1), 100) ELSE 100 END AS strength FROM p),
b AS (
  SELECT source, rule, m, (k + m * strength) / (n + strength) AS mean, n + strength + 1 AS size FROM h JOIN s USING (rule)),
v AS (
  SELECT source, bool_or(rule = 2 AND hit) AS s2, bool_or(rule = 3 AND hit) AS s3, bool_or(rule = 4 AND hit) AS s4, bool_or(low > 0.5) AS bad
  FROM (SELECT source, rule, mean - 0.5 * sqrt(mean * (1 - mean) / size) > m AS hit, mean - 1.96 * sqrt(mean * (1 - mean) / size) AS low FROM b) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 AS base_failed,
       NOT (f1 OR bad OR (s2 AND f2) OR (s3 AND f3) OR (s4 AND f4)) AS kept, f.source AS host
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
