"""Operator 13: whitening of embeddings."""

import random

import numpy as np
import pytest

from headrace.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)


def usable(rows):
    kept = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    longest = max((len(v) for _, v in kept), default=0)
    return [(i, [int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v]) for i, v in kept if len(v) == longest]


@pytest.mark.parametrize("shift", [0, -100_000, 2**40])
def test_cross_products(shift):
    x = np.random.default_rng(1).integers(-900, 900, (333, 5)) + shift
    sums, products = whitening.cross_products(x)
    exact = x.astype(object)
    want = exact.T @ exact
    assert sums == exact.sum(0).tolist()
    assert all(products[i][j] == want[i, j] for i in range(5) for j in range(i, 5))


def test_whitened(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 50)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1 + d) + (300.0 if d == 3 else 0) for d in range(10)]) for i in range(400)]
    rows += [(400, rows[0][1]), (400, rows[0][1]), (None, rows[1][1]), (401, None), (402, []), (403, [None] * 10), (404, [float("nan")] * 10),
             (405, [1.0] * 9 + [float("inf")]), (406, [1.0, 2.0]), (407, [-200.0] * 10)]
    kept = usable(rows)
    x = np.array([v for _, v in kept], object)
    n, s = len(x), x.sum(0)
    apart = n * x - s
    covariance = (apart.T @ apart).astype(float) / n**3
    values, basis = np.linalg.eigh(covariance)
    got = whitening.whitened(vectors(spark, rows)).collect()
    assert len(got) == 8 * len(kept)
    wanted = sorted((str(i), sum(int(a) ** 2 for a in line)) for (i, _), line in zip(kept, apart))
    for k in range(8):
        part = [r for r in got if r.component == k + 1]
        assert sorted((str(r.vec_id), int(r.deviation)) for r in part) == wanted
        assert {r.n for r in part} == {n} and abs(part[0].explained - values[-1 - k] / values.sum()) < 1e-9
        own = np.sort(np.abs((apart / n).astype(float) @ basis[:, -1 - k] / np.sqrt(values[-1 - k])))
        assert np.allclose(np.sort([abs(r.whitened) for r in part]), own, atol=1e-7)
    assert {r.identity_error < 1e-9 for r in got} == {True}


def test_no_variance_and_no_rows(spark):
    flat = whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in flat] == [(None, None, None, 0)] * 4
    line = whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0])])).collect()
    assert sorted((r.component, r.whitened if r.whitened is None else round(abs(r.whitened), 9)) for r in line if r.component == 1) == [(1, 1.0)] * 2
    assert all(r.whitened is None for r in line if r.component == 2) and line[0].identity_error < 1e-12
    for none in ([], [(1, None)], [(2, [])]):
        df = vectors(spark, none) if none else vectors(spark, [(1, None)]).filter("false")
        assert whitening.whitened(df).collect() == []


def test_exact_beyond_64_bits(spark):
    rows = [(i, [float(2**40 * (i % 2)), 0.5]) for i in range(6)]
    x = np.array([v for _, v in usable(rows)], object)
    want = ((6 * x - x.sum(0)) ** 2).sum(1).tolist()
    got = {(r.vec_id, int(r.deviation)) for r in whitening.whitened(vectors(spark, rows)).collect()}
    assert got == {(i, w) for (i, _), w in zip(rows, want)} and max(want) > 2**63
    with pytest.raises(Exception, match="2\\^42"):
        whitening.whitened(vectors(spark, [(1, [1e30])])).collect()
