"""The decision what to do with a sample after a batch. No Spark in here."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from enum import Enum


class Action(Enum):
    UPDATE = "update"
    ADAPTIVE = "adaptive"
    RESAMPLE = "resample"


@dataclass
class Flags:
    adaptive: bool = False
    force_resample: bool = False
    force_update: bool = False
    skip: bool = False


@dataclass
class State:
    """What a sample's policy remembers: attenuation, which makes repeated extensions harder."""

    attenuation: float = 1.0


@dataclass
class Decision:
    action: Action
    need: int
    m: int
    ratio: float
    state: State = field(default_factory=State)


def attenuated(att: float, rows: int, batch: int, m: int) -> float:
    """att + ln((rows - batch) / (batch - m)) / ln(m), where that is defined; else att."""
    if m <= 1 or batch <= m or rows <= batch:
        return att
    return att + math.log((rows - batch) / (batch - m)) / math.log(m)


def decide(need: int, size: int, rows: int, batch: int, ratio: float, state: State, flags: Flags | None = None, overflow: float = 1.01) -> Decision:
    """rows is the table with the batch. A sample that is large enough is updated in place. One that is too small is
    extended if that is allowed and the batch is large against the shortfall, and drawn anew otherwise."""
    flags = flags or Flags()
    m = 10 * max(need - size, 0)
    if (need > size or flags.force_resample) and not flags.force_update:
        if not flags.force_resample and flags.adaptive and m * state.attenuation <= batch:
            return Decision(Action.ADAPTIVE, need, m, ratio, State(attenuated(state.attenuation, rows, batch, m)))
        return Decision(Action.RESAMPLE, need, m, max(ratio, overflow * need / max(rows, 1)), State(1.0))
    return Decision(Action.UPDATE, need, m, ratio, State(state.attenuation))


def log_choose(n: int, k: int) -> float:
    return -math.inf if k < 0 or k > n else math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def chance_enough(old_rows: int, size: int, need: int, m: int) -> float:
    """The chance that of need rows drawn from old_rows and m new ones at most size come from the old."""
    whole = log_choose(old_rows + m, need)
    return sum(math.exp(log_choose(old_rows, x) + log_choose(m, need - x) - whole) for x in range(max(0, need - m), min(size, need) + 1))


def break_even(old_rows: int, size: int, need: int, level: float = 0.75) -> int:
    """The least number of new rows for which that chance reaches the level: doubled until it does, then bisected."""
    low, high = 0, 1
    while chance_enough(old_rows, size, need, high) < level:
        low, high = high, high * 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if chance_enough(old_rows, size, need, mid) >= level else (mid, high)
    return high
