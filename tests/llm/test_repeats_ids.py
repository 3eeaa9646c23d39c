"""Documents without an id or of one id, whose texts have the same 16-bit checksum."""

import random
import zlib

from tidewell.llm import repeats


def test_equal_checksums(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(30))
    by_crc, pair = {}, None
    while pair is None:
        text = " ".join(f"w{rng.randrange(10**9)}" for _ in range(5)) + " " + passage
        key = zlib.crc32(text.encode()) & 0xFFFF
        pair = (by_crc[key], text) if key in by_crc else None
        by_crc[key] = text
    for i in (None, 7):
        rows = [(i, pair[0]), (i, pair[1]), (9, "x " + passage)]
        got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r["n_removed"] for r in got.collect()) == [0, 30, 30]
