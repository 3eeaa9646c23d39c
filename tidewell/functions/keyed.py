"""Random numbers that depend on a seed and a row's key alone, so that a sample is the same whenever it is computed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keyed numbers are whole and lie in [0, RANGE).
RANGE = 1 << 32
#: Parts of a sample for subsampling errors.
PARTS = 100


class Fast(str):
    """A seed whose numbers come from Spark's own 64-bit hash, at a fraction of the cost of MD5."""


def unit(seed: int | str, keys: list[str]) -> Column:
    """A whole number in [0, RANGE). The default can be computed in any SQL: the first 32 bits of MD5 over seed and keys,
    joined by bars. Keys must be whole numbers or strings. Seeds that are ``Fast`` take another hash."""
    if isinstance(seed, Fast):
        return F.shiftrightunsigned(F.xxhash64(F.lit(str(seed)), *keys), 32)
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def unit_sql(seed: int | str, keys: list[str]) -> str:
    """unit() as SQL text for engines that read 0x strings as numbers."""
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 8))::BIGINT"


def below(p: float) -> int:
    """The bound under which a keyed number falls with chance p."""
    return min(RANGE, max(0, int(p * RANGE)))


def part(seed: int | str, keys: list[str]) -> Column:
    """The subsample of a row, 0 to PARTS - 1, independent of whether it is drawn."""
    other = Fast(f"{seed}/part") if isinstance(seed, Fast) else f"{seed}/part"
    return F.floor(unit(other, keys) * PARTS / RANGE).cast("double")
