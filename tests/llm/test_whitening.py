import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinelake.llm import whitening


def brute(rows):
    """By length: ids, n, exact deviations, eigenvalues and vectors from a dense solver, centred rows."""
    by = defaultdict(list)
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            by[len(v)].append((i, [math.floor(64 * x) + 1_000_000 for x in v]))
    out = {}
    for d, own in by.items():
        n, s = len(own), [sum(x) for x in zip(*(v for _, v in own))]
        deviation = [sum((n * x - t) ** 2 for x, t in zip(v, s)) for _, v in own]
        centred = np.array([[(n * x - t) / n for x, t in zip(v, s)] for _, v in own]).reshape(n, d)
        values, columns = np.linalg.eigh(centred.T @ centred / n)
        out[d] = ([i for i, _ in own], n, deviation, values[::-1], columns[:, ::-1], centred)
    return out


def check(got, rows, tight=True):
    want = brute(rows)
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter((i, k + 1) for d, x in want.items() for i in x[0] for k in range(min(32, d)))
    for d, (ids, n, deviation, values, columns, centred) in want.items():
        for k in range(min(32, d)):
            own = {r["vec_id"]: r for r in got if r["component"] == k + 1 and r["n"] == n}
            mine = np.array([own[i]["whitened"] for i in ids])
            assert [own[i]["deviation"] for i in ids] == deviation
            assert all(abs(own[i]["explained"] - values[k] / values.sum()) <= 1e-9 * max(values[k] / values.sum(), 1e-6) for i in ids)
            assert all(own[i]["identity_error"] < 1e-9 for i in ids)
            if tight:
                theirs = centred @ columns[:, k] / np.sqrt(values[k])
                assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-7


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, 0.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, n int, whitened double").repartition(3)


def vecs(n, d, seed=0):
    rng = np.random.default_rng(seed)
    turn = rng.normal(size=(d, d)) * np.exp(-np.arange(d) / 4)  # eigenvalues over several orders
    return [(i, (rng.normal(size=d) @ turn.T + 3).astype(np.float32).tolist()) for i in range(n)]


def test_equals_a_dense_solver(spark):
    rows = vecs(500, 40) + [(9000, None), (9001, [float("nan")] * 40), (9002, [1.0] * 39 + [None]), (9003, [float("-inf")] * 40)]
    check(whitening.whiten(table(spark, rows)).collect(), rows)


def test_lengths_stand_alone(spark):
    rows = vecs(60, 5) + [(1000 + i, v) for i, v in vecs(70, 3, 1)] + [(5000, []), (5001, [])]
    check(whitening.whiten(table(spark, rows)).collect(), rows)
    with pytest.raises(ValueError, match="lengths"):
        whitening.whiten(table(spark, [(i, [1.0] * (i + 1)) for i in range(whitening.LENGTHS + 1)]))


def test_no_variance(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]  # rank one
    got = whitening.whiten(table(spark, rows)).collect()
    assert all(r["whitened"] == 0 for r in got if r["component"] > 1)
    first = np.array([r["whitened"] for r in got if r["component"] == 1])
    assert abs(first.var() - 1) < 1e-9
    assert all(r["identity_error"] < 1e-9 and abs(r["explained"] - (r["component"] == 1)) < 1e-12 for r in got)
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0])])).collect()
    assert sorted(map(tuple, one)) == [(1, 1, 1, 0, 0.0, 0.0, 0.0), (1, 2, 1, 0, 0.0, 0.0, 0.0)]
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []


def test_large_and_huge_entries(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=4) * 2.0**40).tolist()) for i in range(50)]
    got = whitening.whiten(table(spark, rows, "double")).collect()
    want = brute(rows)[4]
    assert all(r["identity_error"] < 1e-9 for r in got)
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: min(v, 2**63 - 1) for i, v in zip(want[0], want[2])}
    assert len(whitening.whiten(table(spark, [(i, [1e300 * (i - 3), 1.0]) for i in range(6)], "double")).collect()) == 12


def test_repeated_rows_and_null_ids(spark):
    rows = vecs(30, 6)
    got = whitening.whiten(table(spark, rows + [rows[3]] * 200 + [(None, rows[4][1])])).collect()
    assert len(got) == 231 * 6 and {r["n"] for r in got} == {231}
    assert len({r["whitened"] for r in got if r["vec_id"] == 3}) == 6
    assert got[0]["identity_error"] < 1e-9


def test_jacobi_keeps_small_eigenvalues_accurate():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 17, 64):
        scale = 10.0 ** -np.linspace(0, 9, d)
        core = np.eye(d) + 0.2 * (lambda g: (g + g.T) / (2 * np.sqrt(d)))(rng.normal(size=(d, d)))
        v = core * scale[:, None] * scale[None]  # graded: relative accuracy is possible
        values, columns = whitening.jacobi(v)
        assert np.all(np.diff(values) <= 0)
        assert np.abs(columns.T @ columns - np.eye(d)).max() < 1e-12
        assert np.abs(columns.T @ v @ columns - np.diag(values)).max() < 1e-14
        exact = 1 / np.linalg.eigvalsh(np.linalg.inv(core) / scale[:, None] / scale[None])[-1:]  # the smallest, from the inverse
        assert abs(values[-1] / exact[0] - 1) < 1e-6
