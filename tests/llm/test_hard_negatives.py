"""Hard negatives."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from srcloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows):
    """Results by plain loops over all pairs."""
    own = {}
    for d, v, label, *_ in rows:
        if d is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own[(d, math.fmod(label + 1, 10) if d % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v))] = 1
    out = []
    for d, label, v in own:
        if d % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), e, other == label) for e, other, w in own if (e, other, w) != (d, label, v))
        for p, e, same in [x for x in scored if x[2]][:5]:
            fit = [(s, f) for s, f, same in scored if not same and 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(d, e, k + 1, f, -p, -s) for k, (s, f) in enumerate(fit)]
    return Counter(out)


def made(kind, n=700, d=12):
    random.seed(n + d)
    rng = np.random.default_rng(7)
    spread = np.array([3.0 / (1 + k) for k in range(d)])
    rows = []
    for k in range(n):
        v = rng.normal(size=d) * spread
        if kind == "hot" and k % 3 == 0:
            v = spread + rng.normal(size=d) * 0.01
        if kind == "ties":
            v = np.round(v)
        rows.append((k, [float(x) for x in v], random.randrange(10 if kind != "ties" else 3), "x"))
    return rows


@pytest.mark.parametrize("kind", ["plain", "hot", "ties"])
def test_mined_negatives_match_brute_force(spark, monkeypatch, kind):
    if kind != "plain":  # many small blocks and slices
        monkeypatch.setattr(hn, "ROWS", 100)
        monkeypatch.setattr(hn, "ANCHORS", 3)
        monkeypatch.setattr(hn, "SLICE", 2)
        monkeypatch.setattr(hn, "PAIRS", 7)
    rows = made(kind)
    got = Counter(tuple(r) for r in hn.mine(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows) and len(got) > 30


def test_odd_rows(spark):
    rows = made("plain", 150, 3)
    rows += [(200, None, 1, "x"), (300, [1.0, None, 2.0], 1, "x"), (400, [float("nan")] * 3, 1, "x"), (401, [float("inf"), 0.0, 0.0], 1, "x"), (500, [1.0, 1.0, 1.0], None, "x"), (None, [1.0, 1.0, 1.0], 1, "x"), (600, [], 2, "x"), (601, [0.5], 2, "x"), (700, [1e30, 0.0, 0.0], 2, "x"), (800, [-1.0, -1.0, -1.0], 99, None)]
    rows += rows[:20] + [(0, [0.5, 0.5, 0.5], 2, "again")]
    want = brute([r for r in rows if r[0] != 700])
    assert Counter(tuple(r) for r in hn.mine(spark.createDataFrame(rows, SCHEMA)).collect()) == want
    assert hn.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hn.mine(spark.createDataFrame([(100, [], 1, "x")], SCHEMA)).count() == 0


def test_most_pairs_go_early():
    """With a rotation that gathers what vectors share, few pairs are multiplied as whole numbers."""
    rng = np.random.default_rng(3)
    d, n = 32, 4000
    basis = np.linalg.qr(rng.normal(size=(d, d)))[0]
    v = np.floor((rng.normal(size=(n, d)) * np.r_[np.full(6, 200.0), np.full(d - 6, 5.0)]) @ basis).astype(np.int64)
    turn = np.linalg.eigh((v.T @ v) / n)[1][:, ::-1].copy()
    assert np.abs(turn.T @ turn - np.eye(d)).max() < 1e-12
    ends = [8, 16, 24, 32]
    a, b = hn.Side(v[:200], turn, ends), hn.Side(v, turn, ends)
    kth = lambda bounds: np.partition(bounds, n - 5, axis=1)[:, n - 5]
    i, j = hn.survivors(a, b, 0, ends, np.ones((200, n), bool), kth, None)
    exact = v[:200] @ v.T
    assert len(i) < 0.02 * exact.size
    best = np.sort(exact, axis=1)[:, -5]
    assert {(x, y) for x, y in zip(*np.nonzero(exact >= best[:, None]))} <= set(zip(i.tolist(), j.tolist()))
    assert (hn.products(a, b, i, j) == exact[i, j]).all()


def test_bounds_hold_for_any_lengths():
    rng = np.random.default_rng(4)
    for size in (1.0, 1e3, 1e6, 3e7):
        v = np.floor(rng.normal(size=(300, 16)) * size).astype(np.int64)
        turn = np.linalg.eigh((v.T.astype(float) @ v))[1][:, ::-1].copy()
        ends = [4, 8, 12, 16]
        a, b = hn.Side(v[:40], turn, ends), hn.Side(v, turn, ends)
        exact = v[:40] @ v.T
        low, high = np.quantile(exact, 0.97, axis=1), np.quantile(exact, 0.99, axis=1)
        i, j = hn.survivors(a, b, 0, ends, np.ones(exact.shape, bool), lambda _, low=low: low, high)
        inside = (exact >= low[:, None]) & (exact <= high[:, None])
        assert {(x, y) for x, y in zip(*np.nonzero(inside))} <= set(zip(i.tolist(), j.tolist()))


def test_vectors_of_several_lengths():
    column = pa.chunked_array([pa.array([[1, 2, 3], [], [4]], pa.list_(pa.int64())), pa.array([[5, 6]], pa.list_(pa.int64()))])
    assert hn._matrix(column, 3).tolist() == [[1, 2, 3], [0, 0, 0], [4, 0, 0], [5, 6, 0]]
    assert hn._matrix(pa.array([[9, 9], [1, 2], [3, 4]], pa.list_(pa.int64()))[1:], 2).tolist() == [[1, 2], [3, 4]]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_its_sql(spark, sf):
    import duckdb

    path = f"/root/testdata/{sf}/embeddings.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    assert Counter(tuple(r) for r in hn.mine(spark.read.parquet(path)).collect()) == Counter(db.execute(hn.SQL).fetchall())
