"""Approximate nearest neighbours by multiprobe p-stable hashing.

A hash is the floor of (a . v + b) / width for a Gaussian a; a table's bucket is the
tuple of ``hashes`` of them, of which there are more the more vectors there are, so that
a bucket keeps about ``BUCKET`` vectors. Every distinct vector stands in one bucket of
each table. A query visits, in each table, its own bucket and those that differ by one
step in some hashes, in order of estimated success: by the sum of squared distances from
the query's projections to the sides it would cross (never further than one step). The
first visits of that order are found hash by hash: the best m of a sum of independent
choices are among the best m of the sum so far. Each visited bucket gives its nearest
vectors by exact distance; the tables' lists are merged.

The width, and how many buckets a query visits, are fitted on a bounded sample
(``fit_rows``): for the sample's true neighbours the rank of their bucket in that order is
known, and as many buckets are visited as make the tables together reach ``target``; of
a few widths the one that compares fewest vectors is taken. Neighbours in a sample are
farther than in the whole, so this errs on the safe side.

The visits are made in two rounds. The first visits of the first table, the square root of
all in number, give each query a distance within which its k nearest lie; the second round
makes all other visits and returns only vectors within that distance, so the rows that a
query gathers hardly grow with the number of its visits.

Equal vectors are one vector with its smallest ids (k + 1 are enough for any
answer). The vectors of a bucket are cut into blocks of about ``BLOCK``, its queries into
parts of about ``ASKS``, and each part meets each block in a group of its own. Only visits
to buckets that hold a vector are moved. Queries that found under k vectors are compared
with all, in the same blocks and parts.

Cases: vectors that are null, all zero, or hold null or non-finite components take no
part, as query or candidate; vectors of different lengths never meet; repeated rows (equal
id and vector) are one; of vectors at one distance, however many, those with the smaller
ids stand first; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.llm.scratch import map_batches, materialise

FIT_ROWS, FIT_QUERIES = 4096, 256
TARGET = 0.97
TABLES = 3
#: Vectors of a bucket, about; vectors of a block and queries of a part, about.
BUCKET, BLOCK, ASKS = 200, 4096, 1024
#: Widths that are tried, in distances of the sample's neighbours.
WIDTHS = (1.5, 2.0, 3.0, 4.0)


@dataclass
class Hashing:
    width: float
    hashes: int
    tables: int
    probes: int
    seed: int = 17

    @property
    def first(self) -> int:
        """Visits of the first round."""
        return int(np.ceil(np.sqrt(self.probes)))

    def projections(self, rows: np.ndarray, table: int) -> np.ndarray:
        rng = np.random.default_rng([self.seed, table, rows.shape[1]])
        directions = rng.normal(size=(rows.shape[1], self.hashes))
        return (rows @ directions + rng.uniform(0, self.width, self.hashes)) / self.width

    def visits(self, projected: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` promising moves (rows x moves x hashes, steps of -1, 0, 1) for each row of projections, best first."""
        part = projected - np.floor(projected)
        n = len(part)
        cost, moves = np.zeros((n, 1)), np.zeros((n, 1, 0), dtype=np.int8)
        for i in range(self.hashes):
            sides = np.stack([np.zeros(n), (1 - part[:, i]) ** 2, part[:, i] ** 2], axis=1)  # by step 0, 1, -1
            total = (cost[:, :, None] + sides[:, None]).reshape(n, -1)
            order = np.argsort(total, axis=1, kind="stable")[:, :most]
            cost = np.take_along_axis(total, order, axis=1)
            step = np.array([0, 1, -1], dtype=np.int8)[order % 3]
            moves = np.concatenate([np.take_along_axis(moves, (order // 3)[:, :, None], axis=1), step[:, :, None]], axis=2)
        return moves


def bucket_key(cells: np.ndarray) -> np.ndarray:
    """One long for each row of integers."""
    key = np.zeros(cells.shape[:-1], dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(cells.shape[-1]):
            key = (key ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def neighbours(sample: np.ndarray, asked: int, k: int) -> tuple[np.ndarray, float]:
    """The k nearest rows of the first ``asked`` rows, themselves left out, and the median of their distances."""
    queries = sample[:asked]
    square = (queries**2).sum(axis=1)[:, None] + (sample**2).sum(axis=1)[None] - 2 * queries @ sample.T
    square[np.arange(len(queries)), np.arange(len(queries))] = np.inf
    near = np.argpartition(square, k, axis=1)[:, :k]
    return near, float(np.sqrt(max(np.median(np.take_along_axis(square, near, axis=1)), 1e-24)))


def needed_visits(hashing: Hashing, sample: np.ndarray, near: np.ndarray, target: float) -> tuple[int, float] | None:
    """Visits by which the tables together reach ``target`` of the neighbours, and the sample's rows then compared; None if they don't reach it."""
    cells = [hashing.projections(sample, table) for table in range(hashing.tables)]
    deltas = [(c := np.floor(p).astype(np.int64))[near] - c[: len(near), None] for p in cells]
    reachable = np.any([(np.abs(d) <= 1).all(axis=-1) for d in deltas], axis=0)
    if reachable.mean() < target:
        return None
    most, everything = 16, 3**hashing.hashes
    code = 3 ** np.arange(hashing.hashes, dtype=np.int64)
    while True:
        ranks, compared = [], 0.0
        for projected, delta in zip(cells, deltas, strict=True):
            moves = hashing.visits(projected[: len(near)], most)
            codes = ((moves.astype(np.int64) + 1) * code).sum(axis=-1)
            wanted = np.where((np.abs(delta) <= 1).all(axis=-1), ((delta + 1) * code).sum(axis=-1), -1)
            same = codes[:, None, :] == wanted[:, :, None]
            ranks.append(np.where(same.any(axis=-1), same.argmax(axis=-1), most))
        best = np.sort(np.min(ranks, axis=0).ravel())
        visits = int(best[min(len(best) - 1, int(np.ceil(target * len(best))))]) + 1
        if visits <= most or most >= everything:
            break
        most = min(4 * most, everything)
    visits = min(visits, everything)
    for projected in cells:
        cell = np.floor(projected).astype(np.int64)
        stored = np.sort(bucket_key(cell))
        asked = bucket_key(cell[: len(near), None] + hashing.visits(projected[: len(near)], visits))
        compared += float((np.searchsorted(stored, asked, "right") - np.searchsorted(stored, asked, "left")).sum())
    return visits, compared


def fit(sample: np.ndarray, rows: int, k: int = 10, target: float = TARGET, tables: int = TABLES) -> Hashing:
    """Choose width, number of hashes and visits from ``sample`` (float64 rows), for an index of ``rows`` vectors."""
    hashes = max(0, int(np.rint(np.log(max(rows, 1) / BUCKET) / np.log(3))))
    if len(sample) < k + 2:
        return Hashing(1.0, 0, 1, 1)
    near, distance = neighbours(sample, FIT_QUERIES, k)
    while True:
        found = []
        for width in WIDTHS:
            hashing = Hashing(width * distance, hashes, tables, 1)
            if got := needed_visits(hashing, sample, near, target):
                hashing.probes = got[0]
                found.append((got[1], width, hashing))
        if found:
            return min(found, key=lambda x: x[:2])[2]
        hashes -= 1  # no hashes are one bucket, which reaches any target


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the rows that take part."""
    v = F.col(f"`{vector_col}`")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(v, group_id, ids): distinct vectors with their ``keep`` smallest ids, the first of which names the vector."""
    first = rows.dropDuplicates(["vec_id", "v"]).withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= keep)
    return first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("v", F.col("ids")[0].alias("group_id"), "ids")


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 matrix) for each length of vector."""
    rows = [np.asarray(x, dtype=np.float64) for x in column.to_pylist()]
    lengths = np.array([len(x) for x in rows])
    return [(at, np.stack([rows[i] for i in at])) for at in (np.flatnonzero(lengths == n) for n in np.unique(lengths))]


def placed(rows: DataFrame, hashing: Hashing, visits: list[tuple[int, int]] | None = None) -> DataFrame:
    """(spot, key, group_id) for each bucket that a vector stands in or, as a query, visits; spot is the table.

    ``visits`` has the first visit and the end of the visits to make in each table.
    """

    def run(batches):
        for batch in batches:
            for at, matrix in _matrix(batch.column(1)):
                for table in range(hashing.tables):
                    projected = hashing.projections(matrix, table)
                    cells = np.floor(projected).astype(np.int64)
                    cells = np.concatenate([cells, np.full((len(cells), 1), matrix.shape[1])], axis=1)
                    if visits is not None:
                        begin, end = visits[table]
                        step = max(1, (1 << 18) // max(end, 1))
                        for a in range(0, len(cells) if begin < end else 0, step):
                            moves = np.pad(hashing.visits(projected[a : a + step], end)[:, begin:], ((0, 0), (0, 0), (0, 1)))
                            keys = bucket_key(cells[a : a + step, None] + moves)
                            yield from rows_of(batch, table, keys.ravel(), np.repeat(at[a : a + step], keys.shape[1]))
                    else:
                        yield from rows_of(batch, table, bucket_key(cells), at)

    def rows_of(batch, table, keys, owner):
        for a in range(0, len(keys), 1 << 16):
            some = keys[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), table, dtype=np.int32)), pa.array(some), batch.column(0).take(pa.array(owner[a : a + (1 << 16)]))], ["spot", "key", "group_id"])

    return map_batches(rows.select("group_id", "v"), run, "spot int, key long, group_id long")


def nearest_in_blocks(index: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query, group_id, score): the k nearest of each block a query meets, from (spot, key, group_id) of vectors and (spot, key, group_id, within) of visits.

    A bucket's vectors are cut into blocks, its queries into parts. ``vectors`` (group_id, v) gives both their components.
    Vectors farther than ``within`` are left out.
    """
    queries = materialise(queries, "ann-visits")
    stored = index.groupBy("spot", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = queries.groupBy("spot", "key").agg(F.ceil(F.count(F.lit(1)) / ASKS).cast("int").alias("parts"))
    sizes = materialise(stored.join(asked, ["spot", "key"]), "ann-buckets")

    def dealt(rows: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        """Each row once for every group of its own block or part."""
        mine = F.pmod(F.xxhash64("group_id"), F.col({"block": "blocks", "part": "parts"}[own])).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col({"block": "blocks", "part": "parts"}[other]) - 1))
        rows = rows.join(sizes, ["spot", "key"]).withColumn(own, mine).withColumn(other, every)
        return rows.select("spot", "key", "block", "part", (F.col("within") if asks else F.lit(None).cast("double")).alias("within"), "group_id")

    both = dealt(index, "block", "part", False).unionByName(dealt(queries, "part", "block", True)).join(vectors.select("group_id", "v"), "group_id")

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("within").is_valid().to_numpy(zero_copy_only=False)
        within = group.column("within").to_numpy(zero_copy_only=False)
        ids = group.column("group_id").to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        for at, matrix in _matrix(group.column("v").combine_chunks()):
            ask, has = np.flatnonzero(asks[at]), np.flatnonzero(~asks[at])
            if not len(has):
                continue
            stored, own = matrix[has], ids[at[has]]
            square = (stored**2).sum(axis=1)
            n = min(len(has), k)
            for a in range(0, len(ask), 256):
                some, limit = matrix[ask[a : a + 256]], within[at[ask[a : a + 256]]]
                own_square = (some**2).sum(axis=1)
                rough = square[None] - 2 * some @ stored.T
                # The rough distances leave out the query's own square and round; all rows within the rounding of the n-th are compared exactly.
                slack = 8 * (matrix.shape[1] + 4) * np.finfo(np.float64).eps * (square.max() + own_square)
                most = np.minimum(np.partition(rough, n - 1, axis=1)[:, n - 1], limit**2 - own_square)
                row, column = np.nonzero(rough <= (most + slack)[:, None])
                exact = np.concatenate([np.zeros(0), *(np.sqrt(((stored[column[i : i + 65536]] - some[row[i : i + 65536]]) ** 2).sum(axis=1)) for i in range(0, len(row), 65536))])
                order = np.lexsort((own[column], exact, row))
                order = order[exact[order] <= limit[row[order]]]
                row, column, exact = row[order], column[order], exact[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < n
                out.append((ids[at[ask[a : a + 256]]][row[first]], own[column[first]], exact[first]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query", "group_id", "score"), columns, strict=True)))

    return both.groupBy("spot", "key", "block", "part").applyInArrow(run, "query long, group_id long, score double")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct vectors of each query."""
    once = found.groupBy("query", "group_id").agg(F.min("score").alias("score"))
    order = W.partitionBy("query").orderBy("score", "group_id")
    return once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET, tables: int = TABLES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each row where ``is_query`` (over the id column) holds."""
    rows = usable(vectors, id_col, vector_col)
    distinct = materialise(distinct_vectors(rows, k + 1), "ann-vectors")
    n = distinct.count()
    # Somewhat more are drawn than needed, by hash, and the first of them kept.
    drawn = distinct.where(F.pmod(F.xxhash64(F.lit(5), "group_id"), F.lit(1_000_000_000)) < 1_000_000_000 * min(1.0, 1.5 * fit_rows / max(n, 1)))
    sample = _matrix(pa.array([r[0] for r in drawn.orderBy(F.xxhash64("group_id"), "group_id").limit(fit_rows).select("v").collect()]))
    hashing = fit(max((m for _, m in sample), key=len) if sample else np.zeros((0, 1)), n, k, target, tables)

    asking = materialise(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct().join(distinct.select("v", "group_id"), "v").select("query_id", "group_id"), "ann-asking")
    queries = distinct.join(asking.select("group_id").distinct(), "group_id", "left_semi").select("group_id", "v")
    index = materialise(placed(distinct, hashing), "ann-index")
    endless = F.lit(float("inf")).alias("within")
    opening = placed(queries, hashing, [(0, hashing.first if table == 0 else 0) for table in range(hashing.tables)])
    near = materialise(best_of(nearest_in_blocks(index.where("spot = 0"), opening.select("*", endless), distinct, k + 1), k + 1), "ann-near")
    # A query with k + 1 vectors in hand needs none beyond the last of them.
    bounds = near.groupBy(F.col("query").alias("group_id")).agg(F.when(F.count(F.lit(1)) > k, F.max("score")).alias("within"))
    others = placed(queries, hashing, [(hashing.first if table == 0 else 0, hashing.probes) for table in range(hashing.tables)])
    others = others.join(bounds, "group_id", "left").withColumn("within", F.coalesce("within", endless))
    best = materialise(best_of(near.unionByName(nearest_in_blocks(index, others, distinct, k + 1)), k + 1), "ann-found")
    short = queries.join(best.groupBy(F.col("query").alias("group_id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k + 1, n)), "group_id", "left_anti")
    short = materialise(short, "ann-short")
    if not short.isEmpty():
        everywhere = [F.lit(-1).alias("spot"), F.size("v").cast("long").alias("key"), "group_id"]
        best = best_of(best.unionByName(nearest_in_blocks(materialise(distinct.select(*everywhere), "ann-everywhere"), short.select(*everywhere, endless), distinct, k + 1)), k + 1)

    listed = best.join(distinct.select("group_id", "ids"), "group_id").select("query", "score", F.explode("ids").alias("vec_id"))
    order = W.partitionBy("query").orderBy("score", "vec_id")
    lists = listed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    answers = lists.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    without = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    per_query = asking.join(answers, F.col("group_id") == F.col("query")).select("query_id", F.posexplode(without).alias("at", "x"))
    return per_query.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
