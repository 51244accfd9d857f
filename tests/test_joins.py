"""Interval joins of static streams against all pairs."""

import random

import pytest
from helpers import ms

from freshet.operators.joins import stream_join


@pytest.mark.parametrize("how", ["inner", "left", "right"])
@pytest.mark.parametrize("within", [0, 7, 1000])
def test_against_all_pairs(spark, how, within):
    pick = random.Random(within)
    make = lambda n: [(None if pick.random() < 0.05 else pick.randrange(4000), pick.choice([1, 2, None]), pick.choice(["a", None]), k) for k in range(n)]
    left, right = make(150), make(120)
    frame = lambda rows: spark.createDataFrame([(None if t is None else ms(t), *rest) for t, *rest in rows], "event_time timestamp, k long, s string, n long")
    keyed = lambda rows: [r for r in rows if r[1] is not None or r[2] is not None]
    a, b = keyed(left), keyed(right)
    pairs = [(x, y) for x in a for y in b if x[1:3] == y[1:3] and None not in (x[0], y[0]) and abs(x[0] - y[0]) <= within]
    want = [(x[3], y[3]) for x, y in pairs]
    if how == "left":
        want += [(x[3], None) for x in a if x not in [p[0] for p in pairs]]
    if how == "right":
        want += [(None, y[3]) for y in b if y not in [p[1] for p in pairs]]
    got = stream_join(frame(left), frame(right), [("k", "k"), ("s", "s")], within, how)
    assert got.columns == ["event_time", "l_event_time", "l_k", "l_s", "l_n", "r_event_time", "r_n"]
    assert sorted(((r["l_n"], r["r_n"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
