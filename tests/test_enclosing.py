"""Intervals around intervals, against all pairs."""

import random

import pytest

import srcloom.operators.enclosing as en

SCHEMA = "id long, user long, start long, end long"


def brute(inner, outer):
    out = {}
    for i, u, s, e in inner:
        fit = [(os, -oe, -o) for o, ou, os, oe in outer if None not in (u, s, e, ou, os, oe) and ou == u and os <= s and oe >= e and o != i]
        out[i] = -max(fit)[2] if fit else None
    return out


@pytest.mark.parametrize("rows", [3, 7, 100_000])
def test_enclosing_matches_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(en, "ROWS", rows)  # many small bins, or one
    random.seed(rows)
    made = []
    for k in range(160):
        start = random.randrange(40)
        made.append((k, 0 if k % 3 else random.randrange(3), start, start + random.choice([0, 1, 2, 5, 9, 60])))
    made += [(500, None, 1, 2), (501, 0, None, 2), (502, 0, 1, None), (503, 0, 0, 1000), (504, 1, 10, 3)]
    df = spark.createDataFrame(made, SCHEMA)
    assert {r.id: r.outerId for r in en.enclosing(df, df, "user").collect()} == brute(made, made)
    few = [(1000 + k, u, s, e) for k, (_, u, s, e) in enumerate(made[:60])]
    assert {r.id: r.outerId for r in en.enclosing(spark.createDataFrame(few, SCHEMA), df, "user").collect()} == brute(few, made)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 1, 1, 1)], SCHEMA)
    assert en.enclosing(none, one, "user").count() == 0
    assert [r.outerId for r in en.enclosing(one, none, "user").collect()] == [None]


def test_a_stack_holds_what_can_be_innermost():
    s = en.Stack()
    for end, own in ((100, "a"), (50, "b"), (60, "c"), (20, "d")):
        s.put(end, own)
    assert s.ids == ["a", "c", "d"]  # b ends before c, which starts later
    assert [s.find(e, "") for e in (10, 20, 21, 60, 61, 101)] == ["d", "d", "c", "c", "a", None] and s.find(20, "d") == "c"
