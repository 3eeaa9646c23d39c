"""The pipeline against its definition."""

import base64
import hashlib
import os
import sys

import numpy as np
import public_tokenizers as P

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute
from test_near import survivors

import corpus_pipeline
from tidewell.llm import leaks


def test_pipeline(spark, sf):
    import tiktoken

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    items = [leaks.normal(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()}
    docs = brute.judged(docs, sources)
    docs = {d: docs[d] for d in survivors(list(docs.items()))}
    edits = lambda p, n: brute.edits_within(p, n) <= leaks.budget(len(p), leaks.Q, leaks.BUDGET)
    docs = {d: t for d, t in docs.items() if not any(p in (n := leaks.normal(t)) or (len(n) < 4000 and edits(p, n)) for p in items)}
    docs = {d: brute.masked(t) for d, t in docs.items()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {d: (len(ids := tik.encode_ordinary(t)), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())) for d, t in docs.items()}
    assert {r[0]: tuple(r[1:]) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).withColumn("_id", docs_extra())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_odd_rows(spark, sf):
    """Nulls and repeated rows pass every stage, and one of each group of copies stays; an empty table stays empty."""
    text = " ".join(f"w{i}" for i in range(60)) + " token = abcdefgh1"
    other = " ".join(f"v{i}" for i in range(60)) + " token = abcdefgh1"
    rows = [(1, text, "en", "s", 10), (1, text, "en", "s", 10), (None, text, None, None, None), (None, other, None, None, None), (2, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    got = sorted(((r["doc_id"], r["text"][-8:], r["n_chars"] == len(r["text"])) for r in docs.collect()), key=repr)
    assert got == sorted([(1, "[assign]", True), (None, "[assign]", True)], key=repr)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf)
        assert none.count() == 0
