import itertools

import numpy as np
import pytest

from kinelake.llm import ann


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(v)), None)
    good = list(good)
    out = {}
    for i, v in good:
        if i % 100 == 0:
            d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = d[:k]
    return out


def as_lists(got):
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    return out


def clustered(n, d, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, d))
    return [(i, (centres[i % 20] + 0.3 * rng.normal(size=d)).astype(np.float32).tolist()) for i in range(n)]


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 300)
    monkeypatch.setattr(ann, "ASKS", 7)
    rows = clustered(6000, 16)
    rows += [(10_000 + i, rows[3][1]) for i in range(500)]  # one vector with very many rows, queries among them
    table = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    got, want = as_lists(ann.search(table, table["vec_id"] % 100 == 0).collect()), brute(rows, 10)
    assert set(got) == set(want)
    hits = [len({j for _, j in got[q]} & {j for _, j in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
    for q in want:
        known = dict((j, d) for d, j in want[q])
        assert len(got[q]) == 10 and got[q] == sorted(got[q])
        assert all(abs(known[j] - d) < 1e-12 for d, j in got[q] if j in known)
    assert got[10_000] == [(0.0, j) for j in [3, *range(10_001, 10_010)]]


def test_left_out_vectors_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [float("inf"), 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (None, [1.0, 1.0]), (200, [0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = as_lists(ann.search(table, table["vec_id"] % 100 == 0).collect())
    assert got == brute(rows, 10)


def test_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(table, table["vec_id"] % 100 == 0).count() == 0


@pytest.mark.parametrize("hashes", [0, 2, 5])
def test_visits_are_the_best_of_all_moves_in_order(hashes):
    point = np.random.default_rng(1).random((3, hashes))
    every = list(itertools.product((0, -1, 1), repeat=hashes))

    def cost(p, move):
        return sum({0: 0, -1: f**2, 1: (1 - f) ** 2}[int(x)] for f, x in zip(p, move, strict=True))

    for most in (1, 7, 3**hashes):
        for p, moves in zip(point, ann.Hashing(1.0, hashes, 1, 1).visits(point, most), strict=True):
            assert np.allclose([cost(p, m) for m in moves], sorted(cost(p, m) for m in every)[:most])
            assert len({tuple(m) for m in moves}) == min(most, len(every)) and not moves[0].any()


def test_ties_go_to_smaller_ids(spark):
    """All distances are equal, so only ids decide."""
    rows = [(i, np.eye(64)[i % 64].tolist()) for i in range(64)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = as_lists(ann.search(table, table["vec_id"] % 16 == 0).collect())
    assert {q: [j for _, j in near] for q, near in got.items()} == {q: [j for j in range(12) if j != q][:10] for q in (0, 16, 32, 48)}


def test_ties_within_a_block_far_from_the_origin(spark):
    """The expanded form of the distance loses these; the exact distances decide."""
    rows = [(i, [1e8 + (i % 7), 1e8]) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert as_lists(ann.search(table, table["vec_id"] % 100 == 0).collect()) == brute(rows, 10)


def test_hashes_grow_with_the_rows():
    sample = np.array([v for _, v in clustered(2000, 16)])
    assert [ann.fit(sample, n).hashes for n in (100, 2_000, 10**6)] == sorted({ann.fit(sample, n).hashes for n in (100, 2_000, 10**6)})
    assert ann.fit(sample, 10**6).hashes >= 7


def test_blocks_leave_out_what_lies_beyond_the_bound(spark):
    """The k nearest of those within the bound, the vector on the bound included."""
    rows = clustered(400, 8)
    vectors = spark.createDataFrame(rows, "group_id long, v array<float>")
    stored = np.array([v for _, v in rows], dtype=np.float64)
    far = {q: np.sqrt(((stored - stored[q]) ** 2).sum(axis=1)) for q in (0, 1, 2)}
    bounds = {0: float("inf"), 1: float(np.sort(far[1])[4]), 2: 0.0}
    index = spark.createDataFrame([(0, 0, i) for i, _ in rows], "spot int, key long, group_id long")
    visits = spark.createDataFrame([(0, 0, q, b) for q, b in bounds.items()], "spot int, key long, group_id long, within double")
    got = {}
    for r in ann.nearest_in_blocks(index, visits, vectors, 11).collect():
        got.setdefault(r["query"], set()).add(r["group_id"])
    assert got == {q: {int(i) for i in np.argsort(d, kind="stable")[:11] if d[i] <= bounds[q]} for q, d in far.items()}
    assert [len(got[q]) for q in (0, 1, 2)] == [11, 5, 1]
