"""Document fingerprints by locally consistent parsing.

A text (its UTF-8 bytes) is parsed into phrases, the phrases into phrases of phrases, and so
on until one phrase is left. At each level

* equal neighbours form one run;
* deterministic coin tossing gives each symbol a label from the lowest bit in which it
  differs from its left neighbour, 2 * position + bit; repeated, that leaves six labels, and
  neighbours still differ;
* a phrase begins where a label exceeds both its neighbours, so phrases have about three
  symbols and at most a constant number of them;
* a phrase is named by a hash of the symbols and run lengths in it.

A cut depends on a few symbols to its left and one to its right. Equal substrings are
therefore cut alike, and their phrases named alike, except near their ends, wherever they
stand; no dictionary of names is shared.

The fingerprint lists, for each level that has at most ``4 * KEEP`` different names, their
number and the ``KEEP`` smallest names (32 bits). As levels shrink by about three, two
texts of similar length share a level whose names are listed completely. ``likeness`` takes the
highest level at which both have at least ``ENOUGH`` names, else the lowest both list, and gives
the Dice coefficient of the two sets of names (from the smallest names where a list is cut).

``with_edits`` needs each document's successor by id. Rows are dealt into cells of ascending
keys, cut at quantiles of a bounded sample; whole texts are shuffled once, into these
cells, sorted there, and passed through one after another with one row of look-ahead. The first row
of each cell is also sent to the cell before. The key ends with a hash of the row's number,
so even very many rows of one id are dealt over several cells.

Cases: a null text counts as empty; empty texts have the empty fingerprint, which is like
itself (1) and nothing else (0); texts of one symbol have one phrase; rows of equal id
follow each other by a hash of their texts, null ids come last; of equal rows each is the
next one's successor; a single document is its own successor; a text is parsed whole, several
together up to ``PART`` bytes, and a longer one alone, which takes some 40 bytes of memory for each of
its own; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.scratch import map_batches, materialise

KEEP, ENOUGH = 32, 12
#: Bytes of text parsed together.
PART = 1 << 20
#: Rows of a cell, about, and the most cells; sampled rows a cell.
CELL_ROWS, CELLS, SAMPLED = 8_000, 50_000, 8

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tosses(bits: int) -> np.ndarray:
    """The label for each pair (left << bits | own) of symbols of so many bits; 0 where both are equal."""
    left, own = np.divmod(np.arange(1 << 2 * bits, dtype=np.uint32), 1 << bits)
    differ = left ^ own
    at = np.bitwise_count((differ & -differ.astype(np.int64)) - 1).astype(np.uint32)
    return np.where(differ == 0, 0, 2 * at + ((own >> np.minimum(at, 31)) & 1)).astype(np.uint8)


_OF_BYTES, _OF_7, _OF_4, _OF_3 = _tosses(8), _tosses(7), _tosses(4), _tosses(3)
_NAMES = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse, at least ``n``."""
    if n not in _POWERS:
        most = max(n, PART)
        if most not in _POWERS:
            base, inverse = int(_ODD), pow(int(_ODD), -1, 1 << 64)
            with np.errstate(over="ignore"):
                made = []
                for x in (base, inverse):
                    column = np.full(most, x, dtype=np.uint64)
                    column[0] = 1
                    made.append(np.multiply.accumulate(column))
            if most > PART:
                return made[0], made[1]
            _POWERS[most] = (made[0], made[1])
        return _POWERS[most]
    return _POWERS[n]


def toss(labels: np.ndarray, at: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    pair = np.zeros(len(labels), dtype=np.uint16)
    pair[1:] = labels[:-1]
    pair[at] = 0
    pair <<= bits
    pair |= labels
    return table[pair]


def phrases(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of texts that begin at ``at`` (bytes, or names of the level below), and where the texts begin among them."""
    n = len(symbols)
    change = np.empty(n, dtype=bool)
    change[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=change[1:])
    change[at] = True
    own = np.flatnonzero(change)
    runs = None
    if len(own) < n:
        runs = np.diff(own, append=n)
        symbols, at = symbols[own], np.searchsorted(own, at)
        n = len(symbols)

    if symbols.dtype == np.uint8:
        labels = toss(toss(toss(symbols, at, _OF_BYTES, 8), at, _OF_4, 4), at, _OF_3, 3)
        values = _NAMES[symbols]
    else:
        left = np.zeros(n, dtype=np.uint64)
        left[1:] = symbols[:-1]
        left[at] = 0
        left ^= symbols
        lowest = left & (~left + np.uint64(1))
        labels = (2 * np.bitwise_count(lowest - np.uint64(1)).astype(np.uint8)) & 127
        labels |= (symbols & lowest) != 0
        labels = toss(toss(toss(labels, at, _OF_7, 7), at, _OF_4, 4), at, _OF_3, 3)
        values = symbols.copy()
    if runs is not None:
        long = np.flatnonzero(runs > 1)
        with np.errstate(over="ignore"):
            values[long] = mixed(values[long] + runs[long].astype(np.uint64) * _ODD)

    begins = np.zeros(n, dtype=bool)
    if n > 2:
        begins[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    begins[at[1:] - 1] = False
    begins[at] = True
    starts = np.flatnonzero(begins)
    with np.errstate(over="ignore"):
        up, down = powers(n)
        values *= up[:n]
        np.cumsum(values, out=values)
        names = values[np.append(starts[1:] - 1, n - 1)]
        names[1:] -= values[starts[1:] - 1]
        names *= down[starts]
    return mixed(names ^ _ODD), np.searchsorted(starts, at)


def _lists(names: np.ndarray, at: np.ndarray, texts: np.ndarray, level: int, out: list[list[str]]) -> None:
    """Adds each text's list of this level to ``out``."""
    owner = np.repeat(np.arange(len(at), dtype=np.uint64), np.diff(at, append=len(names)))
    keys = np.sort((owner << np.uint64(40)) | (names >> np.uint64(24)))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    first = np.searchsorted(keys, np.arange(len(at) + 1, dtype=np.uint64) << np.uint64(40))
    count = np.diff(first)
    short = ((keys >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes().hex()
    for i in np.flatnonzero(count <= 4 * KEEP):
        a = int(first[i])
        out[texts[i]].append(f"{level}:{count[i]}:{short[8 * a : 8 * (a + min(int(count[i]), KEEP))]}")


def parse(texts: list[bytes]) -> list[str]:
    """The fingerprint of each text, all parsed together."""
    out: list[list[str]] = [[] for _ in texts]
    live = np.array([i for i, t in enumerate(texts) if t], dtype=np.int64)
    if not len(live):
        return [""] * len(texts)
    at = np.concatenate([[0], np.cumsum([len(texts[i]) for i in live])])[:-1].astype(np.int64)
    symbols = np.frombuffer(b"".join(texts[i] for i in live), dtype=np.uint8)
    level = 0
    while len(live):
        level += 1
        symbols, at = phrases(symbols, at)
        _lists(symbols, at, live, level, out)
        size = np.diff(at, append=len(symbols))
        if (size == 1).any():
            symbols = symbols[np.repeat(size > 1, size)]
            live, size = live[size > 1], size[size > 1]
            at = np.cumsum(size) - size
    return [",".join(lists) for lists in out]


def fingerprints(texts: list[bytes]) -> list[str]:
    """The fingerprint of each text; texts up to PART bytes in all are parsed together."""
    out: list[str] = []
    some: list[bytes] = []
    size = 0
    for text in texts:
        if some and (size + len(text) > PART or len(some) >= 1 << 14):
            out += parse(some)
            some, size = [], 0
        some.append(text)
        size += len(text)
    return out + parse(some) if some else out


def _levels(fingerprint: str) -> dict[int, tuple[int, frozenset[str]]]:
    found = {}
    for part in fingerprint.split(",") if fingerprint else ():
        level, count, names = part.split(":")
        found[int(level)] = (int(count), frozenset(names[i : i + 8] for i in range(0, len(names), 8)))
    return found


def likeness(one: str, two: str) -> float:
    """From 0 to 1; equal fingerprints have 1."""
    return _likeness(one, two, _levels(one), _levels(two))


def _likeness(one: str, two: str, a: dict, b: dict) -> float:
    if one == two:
        return 1.0
    both = a.keys() & b.keys()
    if not both:
        return 0.0
    level = max((k for k in both if min(a[k][0], b[k][0]) >= ENOUGH), default=min(both))
    (n, x), (m, y) = a[level], b[level]
    if max(n, m) <= KEEP:
        return 2 * len(x & y) / (n + m)
    smallest = sorted(x | y)[:KEEP]
    share = sum(v in x and v in y for v in smallest) / len(smallest)
    return 2 * share / (1 + share)


def fingerprint_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each row; nothing is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(fingerprints([t.encode() for t in texts]), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return map_batches(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), run, f"doc_id {kind}, n_chars long, fingerprint string")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the key by whose ascending order ids descend: last (a null id), turned id, hash of the text, hash of the row's number."""
    turned = F.bitwise_not(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0).cast("long")))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").isNull().cast("int").alias("k0"), turned.alias("k1"), F.xxhash64(text).alias("k2"), F.xxhash64(F.monotonically_increasing_id()).alias("k3"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))


KEY = ["k0", "k1", "k2", "k3"]


def _sortable(k0, k1, k2, k3) -> np.ndarray:
    """Keys as bytes whose order is that of the keys; a last byte keeps trailing zeros significant."""
    out = np.empty((len(k0), 26), dtype=np.uint8)
    out[:, 0] = np.asarray(k0) + 1
    for i, k in enumerate((k1, k2, k3)):
        turned = np.asarray(k).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        out[:, 1 + 8 * i : 9 + 8 * i] = turned.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 25] = 1
    return np.ascontiguousarray(out).view("S26").ravel()


def cell_of(rows: DataFrame, count: int, cells: int) -> Column:
    """The cell of a key, between cuts at quantiles of a sample of about ``SAMPLED`` rows a cell."""
    share = min(1.0, cells * SAMPLED / max(count, 1))
    some = rows.select(*KEY).where(F.pmod(F.xxhash64(F.lit(11), *KEY), F.lit(1_000_000_000)) < int(1_000_000_000 * share)).toPandas()
    found = np.sort(_sortable(*(some[k].to_numpy() for k in KEY))) if len(some) else np.zeros(0, "S26")
    cuts = np.unique(found[np.linspace(0, len(found) - 1, cells + 1).astype(int)[1:-1]]) if len(found) else found

    @F.pandas_udf("int")
    def cell(k0: pd.Series, k1: pd.Series, k2: pd.Series, k3: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, _sortable(k0, k1, k2, k3), side="right").astype(np.int32))

    return cell(*KEY)


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the
    next document's, by descending id; the first document follows the last.
    """
    rows = keyed(docs, id_col, text_col)
    n = rows.count()
    cells = cells or max(1, min(CELLS, max(math.ceil(n / CELL_ROWS), 4 * docs.sparkSession.sparkContext.defaultParallelism)))
    dealt = rows.withColumn("cell", cell_of(rows, n, cells))
    # The first row of each cell, one small row a cell, and the cell before it.
    firsts = materialise(dealt.select("cell", F.struct(*KEY).alias("k")).groupBy("cell").agg(F.min("k").alias("k")), "fingerprint-cells")
    order = sorted(r["cell"] for r in firsts.select("cell").collect())
    before = docs.sparkSession.createDataFrame([(c, order[i - 1]) for i, c in enumerate(order)], "cell int, goes_to int")
    tails = dealt.join(F.broadcast(firsts.join(F.broadcast(before), "cell").select("goes_to", *[F.col(f"k.{k}").alias(k) for k in KEY])), KEY)
    tails = tails.drop("cell").withColumnRenamed("goes_to", "cell").withColumn("tail", F.lit(1))
    both = dealt.withColumn("tail", F.lit(0)).unionByName(tails)
    in_order = both.repartition(math.ceil((len(order) + 1) / 2), "cell")  # about two cells each, as a hash deals them
    in_order = in_order.sortWithinPartitions("cell", "tail", *KEY).select("cell", "tail", "doc_id", "text")
    return map_batches(in_order, edited_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edited_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, tail, doc_id, text) in the order of their cells: each but the tails with what it has in common with the row after it."""
    held: tuple | None = None
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        prints = fingerprints([row[3].encode() for row in rows])
        now = [(*row, print_) for row, print_ in zip(rows, prints, strict=True)]
        if held:
            now.insert(0, held)
        held = now[-1]
        asked = [(one, two) for one, two in zip(now, now[1:], strict=False) if not one[1]]
        if not asked:
            continue
        edited = []
        for one, two in asked:
            half = len(one[3]) // 2
            edited.append((one[3][: len(one[3]) - half] + two[3][:half]).encode())
        edits = fingerprints(edited)
        out = []
        for (one, two), text, edit in zip(asked, edited, edits, strict=True):
            own = _levels(one[4])
            out.append((one[2], len(one[3]), hashlib.sha256(text).hexdigest(), one[4], edit, _likeness(one[4], edit, own, _levels(edit)), _likeness(one[4], two[4], own, _levels(two[4]))))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
