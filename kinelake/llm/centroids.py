"""Clustering around centroids in exact integers.

Components become integers, floor(1024 * x). Squared distances come from the expansion
|x|^2 - 2 x.c + |c|^2 over blocks of rows, the products in one float64 matrix multiplication
(BLAS). With the largest magnitudes m and w of a block and of the centroids, every partial
sum stays within d * (m + w)^2; below 2^53 float64 is therefore exact whatever the order of
summing. A block beyond that bound is worked in 64-bit integers, and beyond 2^63 in Python
integers, by differences.

Each round is one pass over the blocks: ``RDD.treeAggregate`` adds counts and sums of every
cluster (k x d integers, whatever the number of rows), and the driver floors sum / count.
The last pass gives each row its cluster. Rows of one cluster never meet in a task, so hot
clusters and repeated vectors need no care. Blocks stand in the shared scratch folder; a
round depends on nothing but them and the centroids.

Cases: rows whose vector is null, of another length, or holds null or non-finite components
take no part; vectors of zeros do; repeated rows are clustered each; a row whose id is null
takes part with a null id (its key is that of an empty id); rows of equal keys start in the
order of their components; with fewer rows than ``k`` each starts a centroid; an empty table
gives no rows; distances and inertias beyond a long are given as the largest long (the
clusters themselves stay exact); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm import vectors
from kinelake.llm.scratch import map_batches, materialise
from kinelake.llm.vectors import EXACT, LONG, as_objects, column_sums, integers, matrix

K, ROUNDS, SCALE, LENGTH, SEED = 8, 10, 1024, 64, 3


def magnitude(rows: np.ndarray) -> int:
    return int(np.abs(rows).max(initial=0))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smaller number of equals, and the exact squared distance."""
    bound = x.shape[1] * (magnitude(x) + magnitude(centroids)) ** 2
    if x.dtype != object and bound < EXACT:
        c = centroids.astype(np.float64)
        square = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    else:
        kind = np.int64 if bound <= LONG else object
        wide = x.astype(np.int64) if x.dtype != object else x
        wide, c = wide.astype(kind), centroids.astype(kind)
        square = np.stack([((wide - row) ** 2).sum(axis=1) for row in c], axis=1)
    best = np.argmin(square, axis=1)
    distance = square[np.arange(len(x)), best]
    return best, distance if distance.dtype == object else distance.astype(np.int64)


def exact_sum(values: np.ndarray) -> int:
    return int(values.sum()) if values.dtype != object and len(values) * magnitude(values) <= LONG else sum(map(int, values))


def totals(rdd, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, sums of components, distance summed) of each cluster, exact, from one pass over all blocks."""
    k, d = centroids.shape
    zero = (np.zeros(k, dtype=object), np.zeros((k, d), dtype=object), np.zeros(k, dtype=object))

    def add(so_far, x):
        best, distance = nearest(x, centroids)
        count, total, inertia = (part.copy() for part in so_far)
        for j in np.unique(best):
            own = best == j
            count[j] += int(own.sum())
            total[j] += column_sums(x[own])
            inertia[j] += exact_sum(distance[own])
        return count, total, inertia

    return rdd.treeAggregate(zero, add, lambda a, b: tuple(p + q for p, q in zip(a, b, strict=True)))


def first_centroids(rows: DataFrame, id_col: str, vector_col: str, k: int, scale: int, length: int, seed: int) -> np.ndarray:
    """The ``k`` rows with the smallest sha256 of ``seed:id``, in that order."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    usable = rows.select(key.alias("key"), v.alias("v")).where(vectors.finite(F.col("v")) & (F.size("v") == length))
    some = np.array([r["v"] for r in usable.orderBy("key", "v").limit(k).collect()], dtype=np.float64).reshape(-1, length)
    return as_objects(integers(some, scale).ravel()).reshape(-1, length)


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row that takes part."""
    centroids = first_centroids(rows, id_col, vector_col, k, scale, length, seed)
    packed = vectors.blocks(rows, id_col, vector_col, length)
    kind = vectors.component_type(packed)
    packed = materialise(packed, "centroid-blocks")
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], schema)
    rdd = packed.select("v").rdd.map(lambda row: integers(matrix(row[0], length, kind), scale))
    for _ in range(rounds):
        count, total, _ = totals(rdd, centroids)
        centroids = np.stack([total[j] // count[j] if count[j] else centroids[j] for j in range(len(centroids))])
    _, _, inertias = totals(rdd, centroids)
    of_all = min(sum(inertias), LONG)
    of_cluster = np.array([min(x, LONG) for x in inertias], dtype=np.int64)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches):
        for batch in batches:
            for ids, raw in zip(batch.column(0), batch.column(1), strict=True):
                best, distance = nearest(integers(matrix(raw.as_py(), length, kind), scale), centroids)
                distance = np.array([min(x, LONG) for x in distance], dtype=np.int64) if distance.dtype == object else distance
                columns = [ids.values, pa.array(best, pa.int32()), pa.array(distance), pa.array(of_cluster[best]), pa.array(np.full(len(best), of_all)), pa.array([digests[j] for j in best], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return map_batches(packed.select("ids", "v"), run, schema)


def cluster_sql(k: int = K, rounds: int = ROUNDS, scale: int = SCALE, length: int = LENGTH, seed: int = SEED) -> str:
    """The same over the table ``embeddings``, each round written out."""
    parts = [
        f"""kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {length} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "cells AS MATERIALIZED (SELECT rid, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM kept)",
        f"""first AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS j, rid FROM kept QUALIFY j < {k})""",
        "c0 AS MATERIALIZED (SELECT j, i, x AS c FROM first JOIN cells USING (rid))",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT rid, min(struct_pack(d := d, j := j)) AS m FROM (SELECT rid, j, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM cells JOIN c{r} USING (i) GROUP BY rid, j) GROUP BY rid)""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT m.j AS j, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN cells USING (rid) GROUP BY ALL)""")
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.j, o.i, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), o.c) AS c FROM c{r} o LEFT JOIN s{r} USING (j, i))""")
    parts.append(f"h AS (SELECT j, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY j)")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(m.j AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.j) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN h ON h.j = m.j"""
    )
