"""Statements on samples: CREATE r% [UNIFORM | STRATIFIED | UNIVERSE] SAMPLE OF t [ON c], DROP | DELETE [r%] [kind] SAMPLES OF t."""

from __future__ import annotations

import re
from dataclasses import dataclass

_CREATE = re.compile(r"\s*CREATE\s+([\d.]+)\s*%\s+(?:(UNIFORM|STRATIFIED|UNIVERSE)\s+)?SAMPLE\s+OF\s+([\w.]+)(?:\s+ON\s+(\w+))?\s*;?\s*", re.I)
_DROP = re.compile(r"\s*(?:DROP|DELETE)\s+(?:([\d.]+)\s*%\s+)?(?:(UNIFORM|STRATIFIED|UNIVERSE)\s+)?SAMPLES\s+OF\s+([\w.]+)\s*;?\s*", re.I)


@dataclass(frozen=True)
class Create:
    table: str
    ratio: float
    kind: str | None
    column: str | None


@dataclass(frozen=True)
class Drop:
    table: str
    ratio: float | None
    kind: str | None


def parse(sql: str) -> Create | Drop | None:
    """The statement, or None for any other SQL. Stratified and universe samples need a column, a uniform one has none."""
    if m := _CREATE.fullmatch(sql):
        kind = m[2].lower() if m[2] else None
        if (kind in ("stratified", "universe") and not m[4]) or (kind == "uniform" and m[4]):
            raise ValueError(f"{kind} and ON don't fit in: {sql}")
        return Create(m[3], float(m[1]) / 100, kind, m[4])
    if m := _DROP.fullmatch(sql):
        return Drop(m[3], float(m[1]) / 100 if m[1] else None, m[2].lower() if m[2] else None)
    return None
