"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fim, fst, hilbert, hosts, leaks, lloyd, minhash, repeats, simhash, trigrams, warc, wavelet


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        hilbert.op1_hilbert_shards, warc.op2_warc_index, trigrams.op3_secret_trigrams, wavelet.op4_wavelet_shards, simhash.op5_simhash_bktree,
        hosts.op6_host_rules, fst.op7_token_fst, bpe.op8_byte_bpe, leaks.op9_qgram_leaks, repeats.op10_rabin_karp_windows, fim.op11_fim_chunks,
        minhash.op12_circulant_minhash, lloyd.op13_lloyd,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_index": warc.OP2_SQL, "op3_secret_trigrams": trigrams.OP3_SQL, "op6_host_rules": hosts.OP6_SQL, "op10_rabin_karp_windows": repeats.OP10_SQL, "op11_fim_chunks": fim.OP11_SQL, "op12_circulant_minhash": minhash.OP12_SQL, "op13_lloyd": lloyd.OP13_SQL}
