"""Null and repeated ids, and rows that are alike: each row of the result is that of its text, whatever its id."""

from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewell.llm import registry

TEXTS = ["password = 'abcdefgh12' " + "deadbeef" * 5, None, "", " ".join(f"w{i % 70}" for i in range(90)) + "\nsame line\nsame line", "é漢字🙂 it's 12345"]


def write(at, rows):
    at.mkdir()
    ids, texts = ([r[k] for r in rows] for k in (0, 1))
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "source": pa.array([None] * len(rows), pa.string()), "clash": texts}), at / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([7], pa.int64()), "text": [" ".join(f"w{i}" for i in range(20, 50))]}), at / "benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["op3_secret_trigrams", "op6_host_rules", "op7_token_fst", "op8_byte_bpe"])
def test_rows_are_judged_by_their_texts(spark, tmp_path, name):
    query = registry.queries()[name]
    plain = query(spark, write(tmp_path / "plain", list(enumerate(TEXTS)))).drop("kept", "host")
    by_text = {r["doc_id"]: tuple(r[c] for c in plain.columns if c != "doc_id") for r in plain.collect()}
    rows = [(i, k) for k in range(len(TEXTS)) for i in (None, None, 1, 1, 9)]
    odd = query(spark, write(tmp_path / "odd", [(i, TEXTS[k]) for i, k in rows])).select(plain.columns)
    got = Counter((r["doc_id"], tuple(r[c] for c in plain.columns if c != "doc_id")) for r in odd.collect())
    assert got == Counter((i, by_text[k]) for i, k in rows)


def test_leaks_of_odd_ids(spark, tmp_path):
    rows = [(None, TEXTS[3]), (4, TEXTS[3]), (4, TEXTS[3]), (5, TEXTS[0]), (None, None)]
    found = registry.queries()["op9_qgram_leaks"](spark, write(tmp_path / "odd", rows))
    assert {r["doc_id"] for r in found.collect()} == {4, None}
