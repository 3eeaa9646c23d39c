import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidewell.operators import ddl
from tidewell.plans import query as q
from tidewell.plans.policy import Action, Flags, State, attenuated, break_even, chance_enough, decide


def test_enough_is_updated():
    d = decide(100, 100, 1000, 10, 0.1, State(1.5))
    assert (d.action, d.state.attenuation, d.m) == (Action.UPDATE, 1.5, 0)


def test_short_is_drawn_anew_and_resets():
    d = decide(200, 100, 1000, 10, 0.1, State(1.5))
    assert (d.action, d.state.attenuation, d.ratio) == (Action.RESAMPLE, 1.0, pytest.approx(0.202))


def test_extension_needs_a_large_batch():
    assert decide(110, 100, 10000, 100, 0.1, State(), Flags(adaptive=True)).action is Action.ADAPTIVE
    assert decide(110, 100, 10000, 99, 0.1, State(), Flags(adaptive=True)).action is Action.RESAMPLE
    assert decide(110, 100, 10000, 150, 0.1, State(1.6), Flags(adaptive=True)).action is Action.RESAMPLE


def test_forced():
    assert decide(1, 100, 1000, 10, 0.1, State(), Flags(force_resample=True)).action is Action.RESAMPLE
    assert decide(200, 100, 1000, 10, 0.1, State(), Flags(force_update=True)).action is Action.UPDATE
    assert decide(1, 100, 1000, 10, 0.1, State(), Flags(force_resample=True, force_update=True)).action is Action.UPDATE


@given(st.floats(-5, 5), st.integers(0, 10**9), st.integers(0, 10**6), st.integers(0, 10**6))
def test_attenuation_is_always_a_number(att, rows, batch, m):
    assert math.isfinite(attenuated(att, rows, batch, m))


def test_break_even_is_least():
    m = break_even(5000, 200, 230)
    assert chance_enough(5000, 200, 230, m) >= 0.75 > chance_enough(5000, 200, 230, m - 1)


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("CREATE 10% UNIFORM SAMPLE OF a.t", ddl.Create("a.t", 0.1, "uniform", None)),
        ("create 2.5 % stratified sample of t on c;", ddl.Create("t", 0.025, "stratified", "c")),
        ("CREATE 5% SAMPLE OF t", ddl.Create("t", 0.05, None, None)),
        ("CREATE 5% UNIVERSE SAMPLE OF t ON k", ddl.Create("t", 0.05, "universe", "k")),
        ("DROP SAMPLES OF t", ddl.Drop("t", None, None)),
        ("DELETE SAMPLES OF t", ddl.Drop("t", None, None)),
        ("DROP 10% UNIFORM SAMPLES OF t", ddl.Drop("t", 0.1, "uniform")),
        ("SELECT 1", None),
    ],
)
def test_statements(sql, want):
    got = ddl.parse(sql)
    assert got == want or (got and want and abs(got.ratio - want.ratio) < 1e-12)


def test_statement_without_column():
    with pytest.raises(ValueError):
        ddl.parse("CREATE 10% STRATIFIED SAMPLE OF t")


def test_pool():
    w = q.PAGE_COUNTS
    p = q.pool(w)
    assert len({x.sql() for x in p}) == 60
    assert len(q.except_columns(p, {w.count, w.size}, {w.group})) == 24
    assert len(q.only_columns(p, {w.count, w.size}, {w.group})) == 27
    assert [x.agg for x in p] == sorted(x.agg for x in p)
