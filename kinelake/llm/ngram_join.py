"""Jaccard self-join over word n-grams, by token-combination prefixes.

Texts become sets of hashed word shingles. In one order of all shingles, rare before
frequent, two similar sets share many of their first ones: a set of n shingles lacks at
most e = n - ceil(t * n) of them in any similar set. A prefix of e + s shingles has s
in common with it then, and s is chosen to grow with e, so that chance hits fall short. Rare shingles are indexed one by one. Frequent ones are cut
into classes by hash and indexed as pairs within a class; each class that the prefix
touches lengthens it by one, as one shared shingle in a class makes no pair. Pairs of
sets with s signatures in common are candidates, and candidates are verified on the
whole sets.

The order comes from two counters of fixed size over all documents, of shingles and of
words: a shingle is frequent if its counter stands out of the mean, and the rarer its
words, the earlier it stands. Any order gives the same links; a good one gives few
candidates.

Equal sets are one set from the start. Signatures shared by up to ``SMALL`` sets give
pairs, which count what they share. Those shared by more are cut into bands of like size,
as similar sets have like sizes; bands of up to ``SMALL`` sets give pairs too, larger ones only
tie their sets together. A similar pair has half of its s signatures of one kind, or more than half of
the other in one band, so pairs with fewer are no candidates, nor are sets tied that have fewer; and of a set's
ties in a band the commonest, which together are too few for a link, are left out. Otherwise chance ties, of which there are
more in larger tables, would chain most sets into one component. Sets tied in any way form a
candidate component, which is cut into cells of bounded size (by hash, within classes of
like size, since similar sets have like sizes). A signature that very many sets may hold, by
the counter of its shingles, is counted in parts and its parts added up. A task compares the sets of one cell, or
of two, by a sparse product and returns a spanning forest of their links and the number of
each set's links, so neither all pairs of a group nor a whole group ever meets in one task
or leaves one as rows. Each two sets are compared in one cell, so the numbers add up over
cells. ``set_links`` returns the links themselves, as many as there are.

Cases: null and blank texts have empty sets, linked with nothing; texts of under ``k``
words have one shingle, the whole sequence; equal texts and repeated rows share a
component; null ids count as the largest; very long texts are hashed in parts and are one
set; an empty table gives no rows; other columns
are ignored by ``join`` and carried along by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.llm.components import components
from kinelake.llm.exact_dedup import first_id
from kinelake.llm.scratch import join_hot_split, key_bitmap, map_batches, materialise

#: Signatures that candidates share: SHARED, and one more for each SHARED_STEP shingles that may be missing.
SHARED, SHARED_STEP = 3, 8
#: Counters for the order of shingles; the bound of what is broadcast.
COUNTER_BITS = 22
#: Sets per signature up to which pairs are listed.
SMALL = 16
#: The band of signatures that aren't cut by size.
NO_BAND = -1
#: Most sets, and about most shingles, of a cell.
CELL_SETS, CELL_SHINGLES = 256, 1 << 18
#: Sets of a signature, by its shingles' counter, that one task takes, or this many times the counters' mean; more are counted in parts.
PART_SETS, PART_MEANS = 2048, 4
#: The side of sets that are all compared with each other.
INNER = 2
BITMAP_BITS = 23

_PIECE = 1 << 18
_BLOCKS = 16
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_LETTER = np.random.default_rng(3).integers(1 << 62, size=256, dtype=np.uint64)[_FOLD.astype(np.int64)] | np.uint64(1)
_LOWER = bytes(_FOLD.astype(np.uint8))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64, for places of a piece."""
    base = 0xD6E8FEB86659FD93
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        column = np.full(_PIECE + 1, b, dtype=np.uint64)
        column[0] = 1
        both.append(np.multiply.accumulate(column))
    return both[0], both[1]


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Parts of up to _PIECE bytes that end at blanks; a longer word is a part of its own."""
    start, size = 0, len(raw)
    while start < size:
        end = start + _PIECE
        if end < size:
            window = np.flatnonzero(_BLANK[np.frombuffer(raw, np.uint8, _PIECE, start)])
            if len(window):
                end = start + int(window[-1]) + 1
            else:
                while end < size and not _BLANK[raw[end]]:
                    end += 1
        yield raw[start:end]
        start = end


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in order, A-Z taken as a-z."""
    out = []
    power, inverse = _powers()
    for piece in _pieces(text.encode("utf-8", "surrogatepass")):
        letters = np.frombuffer(piece, dtype=np.uint8)
        inside = np.concatenate(([False], ~_BLANK[letters], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if len(letters) > _PIECE:
            out += [np.array([xxhash.xxh64_intdigest(piece[a:b].translate(_LOWER))], dtype=np.uint64) for a, b in zip(starts, ends, strict=True)]
            continue
        with np.errstate(over="ignore"):
            sums = np.concatenate(([np.uint64(0)], np.cumsum(_LETTER[letters] * power[: len(letters)], dtype=np.uint64)))
            out.append(mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words, in order; of fewer words the whole as one."""
    k = min(k, len(words))
    if not k:
        return words
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        h = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            h = mixed(h * _GOLD + words[i : i + n])
    return h


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit name of a set of sorted distinct shingles."""
    return int(np.array(xxhash.xxh64_intdigest(shingles.tobytes(), seed=len(shingles)), dtype=np.uint64).view(np.int64))


def classes(scheme: int) -> int:
    """Classes of frequent shingles for sets of 2 ** scheme shingles and more."""
    return max(1, (1 << scheme) // 4)


class Threshold:
    """Similarity of num / den or more, in whole numbers."""

    def __init__(self, num: int, den: int = 100):
        self.num, self.den = num, den

    def least_overlap(self, n: int) -> int:
        """Shingles that any set similar to one of n has in common with it, at least."""
        return -(-self.num * n // self.den)

    def possible(self, n: int) -> bool:
        """Whether a set of n can be similar to a different one."""
        return self.num * (n + 1) <= self.den * n

    def shared(self, n: int) -> int:
        """Signatures that a set of n has in common with any similar set whose prefix doesn't end before its own."""
        missing = n - self.least_overlap(n)
        return max(1, min(SHARED + missing // SHARED_STEP, n - missing - classes(n.bit_length() - 1)))

    def links(self, overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.den + self.num) * overlap >= self.num * (a + b)


def counter_of(hashes: np.ndarray) -> np.ndarray:
    """The counter of each shingle or word."""
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _pressed(counts: np.ndarray) -> bytes:
    """Counters of a block, compressed: a task's 32 MB of them, mostly zeros, would fill the JVM that writes and shuffles them."""
    return pa.compress(counts.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)


def _counts(pressed: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(pressed, ((1 << COUNTER_BITS) // _BLOCKS) * 4, codec="zstd", asbytes=True), dtype=np.uint32)


def sets_and_counts(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """One row a document (doc_id, text_hash, n, set_id), and for each task the counters' parts (what, block, counts)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "text_hash", "n", "set_id", "what", "block", "counts"]

    def run(batches):
        counters = np.zeros((2, 1 << COUNTER_BITS), dtype=np.uint32)
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            sizes, ids = [], []
            for text in batch.column(2):
                words = word_hashes(text.as_py() or "")
                shingles = np.unique(shingle_hashes(words, k))
                np.add.at(counters[0], counter_of(shingles), 1)
                np.add.at(counters[1], counter_of(words), 1)
                sizes.append(len(shingles))
                ids.append(set_id(shingles))
            m = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        if id_type is not None:
            for what in (0, 1):
                for block, part in enumerate(np.split(counters[what], _BLOCKS)):
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([what], pa.int32()), pa.array([block], pa.int32()), pa.array([_pressed(part)], pa.binary())], names)

    schema = f"doc_id {kind}, text_hash long, n long, set_id long, what int, block int, counts binary"
    text = F.col(f"`{text_col}`")
    return map_batches(docs.select(F.col(f"`{id_col}`"), F.xxhash64(text).alias("text_hash"), text), run, schema)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for what, block, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = (what, block)
            sums[at] = np.minimum(sums.get(at, 0) + _counts(counts).astype(np.uint64), np.iinfo(np.uint32).max)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in sums], pa.int32()), pa.array([b for _, b in sums], pa.int32()), pa.array([_pressed(v) for v in sums.values()], pa.binary())], ["what", "block", "counts"])


#: Which shingle counters are frequent, each word counter's log count (0 to 255), and in how many parts a signature of a shingle is counted.
Tables = tuple[np.ndarray, np.ndarray, np.ndarray]
#: The same as blocks of bytes: for shingles bits, the counters of several parts and those parts; for words the log counts.
Packed = list[tuple[int, int, bytes, bytes, bytes]]


def order_tables(counted: DataFrame) -> Packed:
    """The tables of the order, from the tasks' counters.

    Sums go through a tree: tasks' parts meet in groups by their block and a hash, then by block. Tasks make the tables too, block by block, so
    the driver gets a third of the counters' size at most, and no counters.
    """
    schema = "what int, block int, counts binary"
    spread = counted.select("what", "block", "counts").repartition(8 * _BLOCKS, "what", "block", (F.rand(1) * 8).cast("int"))
    once = map_batches(spread, _added, schema)

    # In one Python worker with the sums: a step of its own would start, and keep, a second worker for each of an executor's cores.
    def totals(batches):
        for batch in _added(batches):
            sums = [int(_counts(c.as_buffer()).sum(dtype=np.uint64)) for c in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], ["what", "block", "counts", "total"])

    added = map_batches(once.repartition(_BLOCKS, "what", "block"), totals, f"{schema}, total long")
    added = materialise(added, "counters")
    mean = (added.where("what = 0").agg(F.sum("total")).first()[0] or 0) / (1 << COUNTER_BITS)

    def packed(batches):
        for batch in batches:
            for what, block, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = _counts(counts).astype(np.uint64)
                if what:
                    own = np.minimum(255, 8 * np.log2(1 + n)).astype(np.uint8).tobytes(), b"", b""
                else:
                    parts = np.clip(np.ceil(n / max(PART_SETS, PART_MEANS * mean)), 1, np.iinfo(np.uint16).max).astype(np.uint16)
                    several = np.flatnonzero(parts > 1)
                    own = np.packbits(n > mean + 4 * math.sqrt(mean) + 8).tobytes(), several.astype(np.uint32).tobytes(), parts[several].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((what, block, *own), (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], ["what", "block", "body", "several", "parts"])

    rows = map_batches(added.select("what", "block", "counts"), packed, "what int, block int, body binary, several binary, parts binary").collect()
    return [(r["what"], r["block"], bytes(r["body"]), bytes(r["several"]), bytes(r["parts"])) for r in rows]


def unpacked(blocks: Packed) -> Tables:
    """The tables from their blocks; counters of blocks that aren't there are 0."""
    size = 1 << COUNTER_BITS
    width = size // _BLOCKS
    frequent, rarity, parts = np.zeros(size, dtype=bool), np.zeros(size, dtype=np.uint8), np.ones(size, dtype=np.uint16)
    for what, block, body, several, cut in blocks:
        at = slice(block * width, (block + 1) * width)
        if what:
            rarity[at] = np.frombuffer(body, dtype=np.uint8)
        else:
            frequent[at] = np.unpackbits(np.frombuffer(body, dtype=np.uint8)).astype(bool)
            parts[at][np.frombuffer(several, dtype=np.uint32)] = np.frombuffer(cut, dtype=np.uint16)
    return frequent, rarity, parts


def signatures(words: np.ndarray, k: int, t: Threshold, tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct shingles, signatures, parts of each signature) of a text's words."""
    frequent, rarity, parts = tables
    windows = shingle_hashes(words, k)
    shingles, first = np.unique(windows, return_index=True)
    n = len(shingles)
    if not t.possible(n):
        return shingles, shingles[:0], np.zeros(0, dtype=np.int32)
    commonness = rarity[counter_of(words)].astype(np.uint64)
    m = len(windows)
    score = sum(commonness[i : i + m] for i in range(min(k, len(words))))[first]
    often = frequent[counter_of(shingles)]
    need = n - t.least_overlap(n) + t.shared(n)
    rare = shingles[~often]
    rare = rare[np.argsort(score[~often], kind="stable")[:need]]
    need -= len(rare)
    found, cut = [mixed(rare)], [parts[counter_of(rare)]]
    if need > 0:
        common = shingles[often]
        common = common[np.argsort(score[often], kind="stable")]
        level = n.bit_length() - 1
        for scheme in (level, level - 1) if t.least_overlap(n) < 1 << level else (level,):
            a, b, pairs = _pairs(common, need, scheme)
            found.append(pairs)
            cut.append(np.minimum(parts[counter_of(a)], parts[counter_of(b)]))
    return shingles, np.concatenate(found), np.concatenate(cut).astype(np.int32)


def _pairs(common: np.ndarray, need: int, scheme: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one shingle, the other, signature) of the pairs within classes, over the shortest prefix that has ``need`` shingles besides each class's first."""
    kind = ((common * _GOLD) >> np.uint64(40)) % np.uint64(classes(scheme))
    by_class = np.argsort(kind, kind="stable")
    grouped = kind[by_class]
    begins = np.concatenate(([True], grouped[1:] != grouped[:-1]))
    rank = np.arange(len(common)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
    later = np.empty(len(common), dtype=bool)
    later[by_class] = rank > 0
    length = int(np.searchsorted(np.cumsum(later), need)) + 1
    chosen = by_class[by_class < length]
    values, grouped = common[chosen], kind[chosen]
    lower, upper, out = [common[:0]], [common[:0]], [common[:0]]
    for gap in range(1, len(values)):
        same = grouped[gap:] == grouped[:-gap]
        if not same.any():
            break
        a, b = values[gap:][same], values[:-gap][same]
        lower.append(np.minimum(a, b))
        upper.append(np.maximum(a, b))
        with np.errstate(over="ignore"):
            out.append(mixed(mixed(lower[-1]) * _GOLD + upper[-1] + np.uint64(scheme + 1)))
    return np.concatenate(lower), np.concatenate(upper), np.concatenate(out)


def signature_rows(docs: DataFrame, k: int, t: Threshold, packed: Packed, text_col: str) -> DataFrame:
    """(sig, parts, set_id, n, least) for the signatures of each set, once for each task that has it; a similar set shares ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        tables = unpacked(shared.value)
        seen: set[int] = set()
        for batch in batches:
            sigs, parts, ids, sizes, least = [], [], [], [], []
            for text in batch.column(0):
                shingles, own, cut = signatures(word_hashes(text.as_py() or ""), k, t, tables)
                name = set_id(shingles)
                if len(own) and name not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(name)
                    sigs.append(own.view(np.int64))
                    parts.append(cut)
                    ids.append(np.full(len(own), name, dtype=np.int64))
                    sizes.append(np.full(len(own), len(shingles), dtype=np.int32))
                    least.append(np.full(len(own), t.shared(t.least_overlap(len(shingles))), dtype=np.int32))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sigs, parts, ids, sizes, least)], ["sig", "parts", "set_id", "n", "least"])

    return map_batches(docs.select(F.col(f"`{text_col}`")), run, "sig long, parts int, set_id long, n int, least int")


def size_class(t: Threshold) -> Column:
    """A class for each size ratio of 1 / t; similar sets are in the same class or in neighbouring ones."""
    return F.floor(F.log(F.col("n")) / F.lit(math.log(t.den / t.num) * 1.0001)).cast("int")


def candidate_edges(rows: DataFrame, t: Threshold) -> DataFrame:
    """(u, v): pairs of sets to verify, or ties between the sets of a signature that many share."""
    part = F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")
    of = W.partitionBy("sig", "part")
    rows = rows.withColumn("part", part).withColumn("lo", F.min("set_id").over(of)).withColumn("hi", F.max("set_id").over(of)).where("lo <> hi or parts > 1")
    once = rows.dropDuplicates(["sig", "part", "set_id"])
    counted = once.withColumn("cnt", F.count(F.lit(1)).over(of)).withColumn("members", F.sum(F.xxhash64("set_id").cast("decimal(20,0)")).over(of).cast("decimal(38,0)"))
    counted = materialise(counted.select("sig", "part", "parts", "set_id", "n", "least", "lo", "cnt", "members"), "signature-parts")
    columns = ["members", "cnt", "lo", "set_id", "n", "least"]
    whole, cut = counted.where("parts = 1").select(*columns), counted.where("parts > 1")
    sums = cut.select("sig", "part", "lo", "cnt", "members").distinct().groupBy("sig").agg(F.min("lo").alias("lo"), F.sum("cnt").alias("cnt"), F.sum("members").cast("decimal(38,0)").alias("members"))
    added = join_hot_split(cut.select("sig", "set_id", "n", "least"), sums.where("cnt > 1"), ["sig"], "cnt", cut.count())
    # Signatures with the same sets count together.
    same = materialise(whole.unionByName(added.select(*columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("w")), "signature-groups")
    # Of signatures that many share, a set stands in the bands of its size class and of the next; two sets meet in the larger class's.
    band = ["members", "cnt", "band"]
    spread = same.where(F.col("cnt") > SMALL).withColumn("band", F.explode(F.array(size_class(t), size_class(t) + 1)))
    spread = materialise(spread.select(*band, "set_id", "n", "least", "w"), "signature-bands")
    sets = spread.groupBy(*band).agg(F.count(F.lit(1)).alias("sets"))
    spread = materialise(join_hot_split(spread, sets.where("sets > 1"), band, "sets", spread.count()), "counted-bands")
    large = spread.where(F.col("sets") > SMALL)
    tied = [F.sum(F.when(F.col("band") == size_class(t) + i, F.col("w")).otherwise(0)).alias(f"tied_{i}") for i in (0, 1)]
    listed = same.where(F.col("cnt") <= SMALL).select("members", "cnt", F.lit(NO_BAND).alias("band"), "set_id", "n", "least", "w")
    listed = listed.unionByName(spread.where(F.col("sets") <= SMALL).select(*listed.columns)).withColumn("class", size_class(t))
    listed = listed.join(large.groupBy("set_id").agg(*tied), "set_id", "left").fillna(0, ["tied_0", "tied_1"])
    mine = ["set_id", "n", "least", "class", "tied_0", "tied_1"]
    other = listed.select(*band, *[F.col(c).alias(f"v_{c}") for c in mine])
    meet = F.greatest("class", "v_class")
    sizes = (F.least("n", "v_n") * t.den >= F.greatest("n", "v_n") * t.num) & (F.col("set_id") < F.col("v_set_id")) & F.col("band").isin(NO_BAND, meet)
    needed = F.greatest("least", "v_least")
    both = F.least(*[F.when(F.col(f"{p}class") == meet, F.col(f"{p}tied_0")).otherwise(F.col(f"{p}tied_1")) for p in ("", "v_")])
    pairs = listed.join(other, band).where(sizes).groupBy(F.col("set_id").alias("u"), F.col("v_set_id").alias("v"), needed.alias("needed"), both.alias("tied")).agg(F.sum("w").alias("w"))
    pairs = pairs.where((2 * F.col("w") >= F.col("needed")) & (F.col("w") + F.col("tied") >= F.col("needed"))).select("u", "v")
    # Other similar sets share ``ties`` or more in one band, so each keeps one of those though its commonest are left out.
    ties = F.floor(F.col("least") / 2) + 1
    rest = W.partitionBy("set_id", "band").orderBy(F.desc("sets"), "members", "cnt").rowsBetween(W.unboundedPreceding, W.currentRow)
    kept = materialise(large.withColumn("so_far", F.sum("w").over(rest)).where(F.col("so_far") >= ties).select(*band, "set_id"), "ties")
    first = kept.groupBy(*band).agg(F.min("set_id").alias("lo"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    tie = join_hot_split(kept, first, band, "sets", kept.count()).select(F.col("set_id").alias("u"), F.col("lo").alias("v")).where("u <> v").distinct()
    return pairs.unionByName(tie)


def stored_sets(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(set_id, n, shingles as bytes) of the sets in ``wanted`` (doc_id, set_id), hashed again from one document each.

    A bitmap of fixed size finds most of those documents, so few other texts are hashed.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP_BITS))
    shared = docs.sparkSession.sparkContext.broadcast(key_bitmap(wanted, bit, BITMAP_BITS).tobytes())

    def run(batches):
        bitmap = np.frombuffer(shared.value, dtype=np.uint8)
        seen: set[int] = set()
        for batch in batches:
            bits = batch.column(0).to_numpy()
            wanted = np.flatnonzero(bitmap[bits >> 3] >> (bits & 7).astype(np.uint8) & 1)
            texts = batch.column(1)
            names, sizes, bodies = [], [], []
            for i in wanted:
                shingles = np.unique(shingle_hashes(word_hashes(texts[int(i)].as_py() or ""), k))
                name = set_id(shingles)
                if len(shingles) and name not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(name)
                    names.append(name)
                    sizes.append(len(shingles))
                    bodies.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary())], ["set_id", "n", "body"])

    looked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).select(bit.alias("bit"), "text")
    return map_batches(looked, run, "set_id long, n long, body binary").dropDuplicates(["set_id"])


def cells(light: DataFrame, t: Threshold) -> DataFrame:
    """From (set_id, label, n): (bin, cell, side, set_id), every set once for each cell it belongs to; sides are 0 and 1, or INNER for a cell of one part.

    A component that fits one cell is one; many such share a bin, a task's input. A larger
    one has a class for each size ratio of 1 / t, cut by hash; similar sets are in the same
    class or in neighbouring ones, and each two parts that may hold a link make a cell.
    """
    whole = light.groupBy("label").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    fits = (F.col("sets") <= CELL_SETS) & (F.col("shingles") <= CELL_SHINGLES)
    whole = materialise(whole.withColumn("fits", fits), "candidate-components")
    volume = whole.where("fits").agg(F.sum("shingles")).first()[0] or 0
    bins = max(1, math.ceil(volume / (4 * CELL_SHINGLES)), light.sparkSession.sparkContext.defaultParallelism)
    placed = light.join(whole.select("label", "fits"), "label").withColumn("class", size_class(t))
    parts_of = F.greatest(F.ceil(F.count(F.lit(1)) / CELL_SETS), F.ceil(F.sum("n") / CELL_SHINGLES)).cast("int")
    classes = materialise(placed.where("not fits").groupBy("label", "class").agg(parts_of.alias("parts")), "cell-classes")

    def parts(shift: int, name: str) -> DataFrame:
        return classes.select("label", (F.col("class") + shift).alias("class"), F.col("parts").alias(name))

    alone = placed.where("fits").select(F.pmod(F.xxhash64("label"), F.lit(bins)).alias("bin"), F.col("label").alias("cell"), F.lit(INNER).alias("side"), "set_id")
    cut = placed.where("not fits").join(parts(0, "here"), ["label", "class"]).join(parts(1, "below"), ["label", "class"], "left").join(parts(-1, "above"), ["label", "class"], "left")
    cut = cut.withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("here")).cast("int"))
    members = F.expr(f"""concat(
      transform(sequence(0, here - 1), x -> named_struct('low', class, 'a', least(part, x), 'high', class, 'b', greatest(part, x), 'side', if(x < part, 1, if(x = part, {INNER}, 0)))),
      if(above is null, array(), transform(sequence(0, above - 1), x -> named_struct('low', class, 'a', part, 'high', class + 1, 'b', x, 'side', 0))),
      if(below is null, array(), transform(sequence(0, below - 1), x -> named_struct('low', class - 1, 'a', x, 'high', class, 'b', part, 'side', 1))))""")
    many = cut.withColumn("c", F.explode(members))
    cell = F.xxhash64("label", "c.low", "c.a", "c.high", "c.b")
    return alone.unionByName(many.select(cell.alias("bin"), cell.alias("cell"), F.col("c.side").cast("int").alias("side"), "set_id"))


def overlaps(bodies: list[np.ndarray], sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, overlap matrix): common shingles of each set of side 0 with each of side 1, or of all with all on one side."""
    tokens = np.concatenate(bodies)
    owner = np.repeat(np.arange(len(bodies)), [len(b) for b in bodies])
    _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
    held = count[column] > 1
    owner, column = owner[held], column[held]
    _, column = np.unique(column, return_inverse=True)
    rows = columns = np.arange(len(bodies))
    if sides.any() and not sides.all():
        rows, columns = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    out = np.zeros((len(rows), len(columns)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (start, start + width))
        part = np.zeros((len(bodies), width), dtype=np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        out += part[rows] @ part[columns].T
    return rows, columns, np.rint(out).astype(np.int64)


def forest(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray, size: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows and columns."""
    near = np.zeros((size, size), dtype=bool)
    near[np.ix_(rows, columns)] = linked
    near |= near.T
    fresh, out = np.ones(size, dtype=bool), []
    for root in range(size):
        if fresh[root]:
            fresh[root] = False
            stack = [root]
            while stack:
                found = np.flatnonzero(near[stack.pop()] & fresh)
                fresh[found] = False
                out += [(root, int(x)) for x in found]
                stack += found.tolist()
    return out


def verified_edges(placed: DataFrame, t: Threshold, every: bool = False) -> DataFrame:
    """(u, v, w) for each cell: links that join all sets that its links join (or ``every`` link), and, with no v, how many documents u is linked with."""

    def run(group: pa.Table) -> pa.Table:
        cell = group.column("cell").to_numpy()
        side = group.column("side").to_numpy()
        ids, sizes, docs = (group.column(c).to_numpy() for c in ("set_id", "n", "docs"))
        bodies = group.column("body").combine_chunks()
        order = np.argsort(cell, kind="stable")
        us, vs, nodes, degrees = [], [], [], []
        for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            inner = bool((side[at] == INNER).all())
            # Sets of one side alone meet in the cell of their own part.
            if len(at) > 1 and (inner or len(np.unique(side[at])) > 1):
                own = [np.frombuffer(bodies[int(i)].as_buffer(), dtype=np.uint64) for i in at]
                rows, columns, common = overlaps(own, np.zeros_like(side[at]) if inner else side[at])
                n, weight = sizes[at], docs[at].astype(np.int64)
                linked = t.links(common, n[rows][:, None], n[columns][None])
                if inner:
                    np.fill_diagonal(linked, False)
                sums = np.zeros(len(at), dtype=np.int64)
                sums[rows] += linked @ weight[columns]
                if not inner:
                    sums[columns] += linked.T @ weight[rows]
                found = np.flatnonzero(sums)
                nodes += ids[at[found]].tolist()
                degrees += sums[found].tolist()
                if every:
                    a, b = np.nonzero(np.triu(linked) if inner else linked)
                    edges = zip(rows[a], columns[b], strict=True)
                else:
                    edges = forest(linked, rows, columns, len(at))
                for x, y in edges:
                    us.append(int(ids[at[x]]))
                    vs.append(int(ids[at[y]]))
        return pa.table({"u": pa.array(us + nodes, pa.int64()), "v": pa.array(vs + [None] * len(nodes), pa.int64()), "w": pa.array([None] * len(us) + degrees, pa.int64())})

    return placed.groupBy("bin").applyInArrow(run, "u long, v long, w long")


def compared(docs: DataFrame, k: int, t: Threshold, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n, set_id) of every document, and the candidate sets in their cells."""
    found = materialise(sets_and_counts(docs, k, id_col, text_col), "shingle-sets")
    sets = found.where("what is null").select("doc_id", "text_hash", "n", "set_id")
    tables = order_tables(found.where("what is not null"))
    nodes = components(candidate_edges(signature_rows(docs, k, t, tables, text_col), t))
    one = sets.where("n > 0").groupBy("set_id").agg(first_id(F.col("doc_id")).alias("doc_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    wanted = materialise(one.join(nodes.withColumnRenamed("node", "set_id"), "set_id"), "candidate-sets")
    placed = materialise(cells(wanted.select("set_id", "label", "n"), t), "cells")
    return sets, stored_sets(docs, wanted, k, id_col, text_col).join(wanted.select("set_id", "docs"), "set_id").join(placed, "set_id")


def labelled(docs: DataFrame, k: int, t: Threshold, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, n, set_id, label, near) of every document; those of a component have one label, near counts linked documents of other sets."""
    sets, bodies = compared(docs, k, t, id_col, text_col)
    verified = materialise(verified_edges(bodies, t), "verified")
    near = verified.where("v is null").groupBy(F.col("u").alias("set_id")).agg(F.sum("w").alias("near"))
    labels = components(verified.where("v is not null").select("u", "v")).withColumnRenamed("node", "set_id").join(near, "set_id")
    rows = sets.join(labels, "set_id", "left")
    return materialise(rows.withColumn("label", F.coalesce("label", "set_id")).withColumn("near", F.coalesce("near", F.lit(0))), "shingle-labels")


def set_links(docs: DataFrame, k: int = 5, threshold: Threshold | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(u, v), u < v: every link between two different sets, once, by the set_id that ``join`` gives their documents."""
    t = threshold or Threshold(80)
    links = verified_edges(compared(docs, k, t, id_col, text_col)[1], t, every=True).where("v is not null")
    return links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def join(docs: DataFrame, k: int = 5, threshold: Threshold | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, set_id, component_id (smallest id reachable by links), n_links (other documents that it is linked with, equal sets included)."""
    own = labelled(docs, k, threshold or Threshold(80), id_col, text_col)
    full, total = own.where("n > 0"), own.count()
    groups = full.groupBy("label").agg(first_id(F.col("doc_id")).alias("component_id"), F.count(F.lit(1)).alias("members"))
    equal = full.groupBy("set_id").agg(F.count(F.lit(1)).alias("equal"))
    rows = join_hot_split(full, materialise(groups, "shingle-components"), ["label"], "members", total)
    rows = join_hot_split(rows, materialise(equal, "equal-sets"), ["set_id"], "equal", total)
    columns = ["doc_id", F.col("n").alias("n_shingles"), "set_id", "component_id", "n_links"]
    rows = rows.withColumn("n_links", F.col("near") + F.col("equal") - 1)
    return rows.select(*columns).unionByName(own.where("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("n_links", F.lit(0).cast("long")).select(*columns))


def keep_one(docs: DataFrame, k: int = 5, threshold: Threshold | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay if each component keeps its row with the smallest id, all columns unchanged.

    Rows without words stay. Of repeated rows (equal id and text) one stays.
    """
    own = labelled(docs, k, threshold or Threshold(80), id_col, text_col)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    first = own.where("n > 0").groupBy("label").agg(least.alias("first")).select("first.doc_id", "first.text_hash")
    kept = first.unionByName(own.where("n = 0").select("doc_id", "text_hash").distinct())

    def keyed(one: Column) -> list[Column]:
        return [F.coalesce(one.cast("string"), F.lit("")).alias("_i"), one.isNull().alias("_no_i")]

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(F.col(f"`{text_col}`")).alias("_h"), *keyed(F.col(f"`{id_col}`")))
    key = ["_h", "_i", "_no_i"]
    met = rows.join(kept.select(F.col("text_hash").alias("_h"), *keyed(F.col("doc_id"))), key, "left_semi")
    return met.dropDuplicates(key).select("_row.*")
