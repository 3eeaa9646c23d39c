"""From raw documents to token ids: five stages, each written as Parquet in the shared folder and read by the next.

Quality rules drop documents; of each group of near-duplicates one row stays, of the smallest id; documents that hold
a benchmark passage go; secrets are masked in the text; what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, common, hosts, leaks, simhash, trigrams


def _carried(docs: DataFrame) -> dict:
    return {f"_c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}


def _back(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of docs from their carried names, or changed."""
    return rows.select(*[changed.get(c, F.col(f"_c{i}")).cast(docs.schema[i].dataType).alias(c) for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go.

    A null or empty text has no words and goes; a null source is a host of its own; null and repeated ids are rows like others; of rows
    that are alike all stay or go; very long texts are measured whole, in their own row; columns may have any names; no rows give none.
    """
    return _back(hosts.judged(docs, carry=_carried(docs)).where("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: of the smallest id, nulls last.

    Groups are linked by SimHash fingerprints of five-word shingles in BK-trees, each link verified by a Jaccard similarity of 0.8
    or more. Rows are told apart by a key of their own, so null and repeated ids are rows like others, and of rows that are alike one
    stays; texts without words, null ones too, are copies of each other; very long texts are compared whole; columns may have any names.
    """
    rows, key = common.keyed(docs, "near")
    groups = common.kept(simhash.similar_groups(rows, key=key).join(rows.select(F.col(key).alias("row"), F.col("doc_id").alias("id")), "row"), "near")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "digest", "row")
    first = common.kept(groups.groupBy("root").agg(F.min(place).alias("first")), "first")
    gone = common.join_small_or_salted(groups, first, "root").where("row <> first.row").select("row")
    return common.without_ids(rows, common.kept(gone, "near"), key).drop(key)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a passage of the benchmark go, whatever their ids.

    Null and empty texts hold none; rows that are alike go together; very long texts are searched whole, in segments; a null or
    empty passage is in no text; columns may have any names; an empty benchmark takes nothing out.
    """
    rows, key = common.keyed(docs, "leaks")
    found = leaks.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_column=key)
    return common.without_ids(rows, common.kept(found.select("doc_id").distinct(), "leaks"), key).drop(key)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by its kind in brackets; n_chars follows the text.

    All rows stay, null, empty and repeated ones too, with or without an id; a null text stays null; texts without a secret stay as they are, and
    so does their n_chars; overlapping secrets are one, named by the first; very long texts are scanned whole; columns may have any names.
    """
    found = trigrams.scan(docs, carry=_carried(docs))
    text = F.when(F.col(f"_c{docs.columns.index('text')}").isNotNull(), trigrams.masked("_t", "spans"))
    found = found.withColumn("_masked", text)
    return _back(found, docs, text=F.col("_masked"), n_chars=F.when(F.size("spans") > 0, F.length("_masked")).otherwise(F.col(f"_c{docs.columns.index('n_chars')}")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document that is left.

    A null text is encoded like an empty one, to no ids; null and repeated ids and rows that are alike come as often as they are; very
    long texts are encoded whole; other columns, whatever their names, are left out; no rows give none.
    """
    import public_tokenizers

    return bpe.digests(docs, bpe.vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("byte-level BPE", encode),
]

#: The stages on fingerprints, edits and merges have no SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.kept(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
