from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import ann
from framelake.llm.ann import nearest
from framelake.llm.hilbert import hilbert_keys

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k):
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, q in usable:
        if i % 20 == 0:
            scored = sorted((-float(q @ v), j) for j, v in usable if j != i)
            out[i] = [j for _, j in scored[:k]]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(100, None), (120, [0.0] * 8), (140, [1.0, None] + [0.0] * 6), (160, [float("nan")] + [1.0] * 7), (180, [float("inf")] * 8)]
    rows += [(200 + i, [1.0] + [0.0] * 7) for i in range(30)]  # ties
    found = nearest(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA), F.col("vec_id") % 20 == 0, k=5)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute(rows, 5)


def test_fewer_than_k_and_empty(spark):
    rows = [(0, [1.0, 0.0], None), (1, [0.5, 0.5], None), (1, [0.5, 0.5], None)]
    found = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, k=20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 1, 0.5)]
    assert nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("lengths", [False, True])
def test_recall(spark, monkeypatch, lengths):
    monkeypatch.setattr(ann, "LEAST_WINDOW", 60)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if lengths:
        v *= rng.uniform(0.5, 2, size=(3000, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    found = nearest(spark.createDataFrame([(i, x, None) for i, x in rows], SCHEMA), F.col("vec_id") % 20 == 0)
    got = {(r["query_id"], r["vec_id"]) for r in found.collect()}
    want = {(q, j) for q, js in brute(rows, 20).items() for j in js}
    assert len(got & want) >= 0.9 * len(want)


def test_recall_at_default_settings(spark):
    """12,000 isotropic rows: no cluster helps. And as many in clusters, where the measured window stays far below the table."""
    rng = np.random.default_rng(5)
    n, seen = 12_000, []
    measured = ann._measured
    for centres in (0, 300):
        v = rng.normal(size=(n, 32)) if not centres else rng.normal(size=(centres, 32))[rng.integers(0, centres, n)] + 0.15 * rng.normal(size=(n, 32))
        v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
        docs = spark.createDataFrame([(i, x.tolist(), None) for i, x in enumerate(v)], SCHEMA)
        ann._measured = lambda *a: seen.append(measured(*a)) or seen[-1]
        try:
            found = nearest(docs, F.col("vec_id") % 20 == 0).toPandas()
        finally:
            ann._measured = measured
        x = v.astype(float)
        s = x[::20] @ x.T
        s[np.arange(len(s)), np.arange(0, n, 20)] = -9
        want = {(20 * i, int(j)) for i, row in enumerate(np.argsort(-s, axis=1)[:, :20]) for j in row}
        got = set(zip(found["query_id"].tolist(), found["vec_id"].tolist(), strict=True))
        assert len(got) == len(found) == n and len(got & want) >= 0.9 * len(want)
        some = found.sample(500, random_state=1)
        for q, j, score in zip(some["query_id"], some["vec_id"], some["score"], strict=True):
            exact = 0.0
            for a, b in zip(x[q].tolist(), x[j].tolist(), strict=True):
                exact += a * b
            assert score == exact
    assert seen[1] < 0.01 * n < seen[0]


def test_lengths_that_differ_are_searched_apart(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=2).tolist()) for i in range(40)] + [(40, [1.0, 2.0, 3.0]), (60, [1.0, 0.5, 0.0]), (80, [1.0]), (61, [0.0, 3.0, 0.0])]
    found = nearest(spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA), F.col("vec_id") % 20 == 0, k=5)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {i: js for n in (1, 2, 3) for i, js in brute([r for r in rows if len(r[1]) == n], 5).items() if js}
    assert got == want and got[40] == [61, 60]


@pytest.mark.parametrize("lengths", [False, True])
def test_a_third_are_copies(spark, monkeypatch, lengths):
    monkeypatch.setattr(ann, "LEAST_WINDOW", 60)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = v.round(3)  # sums of equal vectors are equal
    if lengths:
        v *= rng.uniform(0.5, 2, size=(3000, 1))
    v[rng.permutation(3000)[:1000]] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    found = nearest(spark.createDataFrame([(i, x, None) for i, x in rows], SCHEMA), F.col("vec_id") % 20 == 0)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(rows, 20)
    copies = {i for i in want if (v[i] == v[0]).all()}
    assert len(copies) > 30 and all(got[i] == want[i] for i in copies)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.9 * sum(map(len, want.values()))


def test_ids_with_several_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 40, rng.normal(size=4).tolist()) for i in range(100)] + [(7, [9.0, 9.0, 9.0, 9.0])] * 2
    found = nearest(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA), F.col("vec_id") == 0, k=20).collect()
    v = {i: [np.array(x, np.float32).astype(float) for j, x in rows if j == i] for i in range(40)}
    want = sorted((-max(float(a @ b) for a in v[0] for b in v[i]), i) for i in range(1, 40))[:20]
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"])] == [i for _, i in want]


def test_hilbert_walks_to_neighbours():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
        keys = hilbert_keys(grid, bits)
        assert len(set(keys.tolist())) == len(grid)
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
