import hashlib
import math

import numpy as np
import pytest

from kinelake.llm import centroids, vectors


def brute(rows, k=8, rounds=10, length=64):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    for r in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for _, v in kept]
        if r < rounds:
            for j in range(len(c)):
                own = [v for (_, v), (_, at) in zip(kept, found) if at == j]
                if own:
                    c[j] = [sum(x) // len(own) for x in zip(*own)]
    of = [sum(d for d, at in found if at == j) for j in range(len(c))]
    most = 2**63 - 1
    return sorted(((i, j, min(d, most), min(of[j], most), min(sum(of), most), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found)), key=str)


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 7, 0) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, d int").repartition(3)


def vecs(n, d=64, scale=1.0, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(9, d))
    return [(i, (scale * (centre[i % 9] + 0.4 * rng.normal(size=d))).astype(np.float32).tolist()) for i in range(n)]


def test_equals_integer_arithmetic(spark):
    rows = vecs(300)
    rows += [(7, rows[4][1])] * 40 + [(None, rows[5][1]), (1000, [0.0] * 64)]  # repeated rows, a null id, zeros
    rows += [(2000, None), (2001, [None] * 64), (2002, [float("nan")] * 64), (2003, [float("inf")] * 64), (2004, [1.0] * 63), (2005, []), (2006, [1.0] * 65)]
    got = sorted(map(tuple, centroids.cluster(table(spark, rows)).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("scale", [3e3, 3e5, 2e6, 1e30])
def test_beyond_the_bound_of_float64(spark, scale):
    rows = vecs(40, scale=scale, seed=2) + vecs(20, seed=3)
    got = sorted(map(tuple, centroids.cluster(table(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_doubles_whose_scaled_value_overflows(spark):
    rows = [(i, [1.7e308 if i % 2 else -1.5e308] + [0.1 * i] * 63) for i in range(12)]
    got = sorted(map(tuple, centroids.cluster(table(spark, rows, "double")).collect()), key=str)
    assert got == brute(rows)


def test_few_rows_and_none(spark):
    rows = vecs(3)
    assert sorted(map(tuple, centroids.cluster(table(spark, rows)).collect()), key=str) == brute(rows)
    assert centroids.cluster(table(spark, [])).collect() == []
    assert centroids.cluster(table(spark, [(1, None)])).collect() == []


def test_the_three_arithmetics_agree():
    rng = np.random.default_rng(5)
    for reach in (100, 10**6):
        x = rng.integers(-reach, reach, (50, 64))
        c = vectors.as_objects(rng.integers(-reach, reach, 8 * 64)).reshape(8, 64)
        x[:8] = c.astype(np.int64)
        slow = [min((sum((int(a) - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for v in x]
        for rows in (x.astype(np.float64), vectors.as_objects(x.ravel()).reshape(x.shape)):
            best, distance = centroids.nearest(rows, c)
            assert [(int(d), int(j)) for d, j in zip(distance, best)] == slow


def test_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = sorted(con.execute(centroids.cluster_sql()).fetchall(), key=str)
    got = centroids.cluster(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).collect()
    assert sorted(map(tuple, got), key=str) == want
