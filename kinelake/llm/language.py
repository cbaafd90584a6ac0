"""Language identification by nearest centroid.

A text becomes a vector of hashed character 1- to 3-grams: square-rooted counts times
inverse document frequency, normalised. Each language has a few centroids, found by
spherical k-means over a sample of labelled documents: of each language, at most its even
share of ``fit_rows`` distinct texts, those with the smallest hashes; a document gets the language of the centroid with the
largest cosine. Distance-based rejection: for texts of like length, a cosine below
``slack`` times the 1 % quantile that sample texts of that length reach is marked.

Cases: null texts and texts without a letter are ``und`` with score 0 and count as
rejected; so is everything when no labelled document can be learned from. Repeated
rows are predicted alike and are one text of the sample; a null id hashes as an empty
string; an empty table has no languages and no predictions; very long texts are counted a
part at a time; other columns, the label column included, are no input of a prediction,
and ``accepted`` carries them along whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.llm.scratch import map_batches

UNKNOWN = "und"
DIMENSIONS = 2048
#: Labelled documents that the centroids are fitted on, at most; the rest are not needed.
FIT_ROWS = 3000
CENTROIDS = 3
MAX_LANGUAGES = 500
SLACK = 0.6
_STEP = 1 << 20
_CUTS = (4, 8, 16, 32, 64, 128, 256, 512)
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    """Whether some character is of a Unicode letter category; fractions and other numbers are not."""
    return bool(text) and any(map(str.isalpha, text))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of the lower-cased text; ASCII non-letters count as one blank. Long texts go in steps that overlap by two."""
    out = np.zeros(DIMENSIONS, dtype=np.int64)
    text = text.lower()
    for start in range(0, max(len(text), 1), _STEP):
        piece = " " + text[max(0, start - 2) if start else 0 : start + _STEP] + " "
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        blank = (codes < 128) & ~((codes >= 97) & (codes <= 122))
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        codes = np.where(blank, np.uint32(32), codes)[keep]
        key = np.zeros(len(codes), dtype=np.uint32)
        for n in range(3):
            if n >= len(codes):
                break
            key = (key[: len(codes) - n] + codes[n:]) * _MULTIPLIERS[n]
            out += np.bincount(key >> np.uint32(32 - 11), minlength=DIMENSIONS)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floors: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.sqrt(counts) * self.idf).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, rejected."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        counts = ngram_counts(text)
        cosines = self.centroids @ self.vector(counts)
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[self.owner[best]], score, score < self.floors[length_bin(counts)]


def length_bin(counts: np.ndarray) -> int:
    return min(31, int(np.log2(1 + counts.sum())))


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres start at the row nearest the mean, then at the row farthest from all before."""
    centres = rows[[int(np.argmax(rows @ rows.mean(axis=0)))]]
    while len(centres) < min(k, len(rows)):
        centres = np.vstack([centres, rows[[int(np.argmin((rows @ centres.T).max(axis=1)))]]])
    for _ in range(rounds):
        near = np.argmax(rows @ centres.T, axis=1)
        centres = unit(np.vstack([rows[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))]))
    return centres


def fit_sample(languages: list[str], counts: np.ndarray, heads: list[str], k: int = CENTROIDS, slack: float = SLACK) -> Model:
    """Fit on rows of n-gram counts with their languages; ``heads`` are the texts' beginnings, to learn the cosines of short texts."""
    names = sorted(set(languages))
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1 if len(counts) else np.ones(DIMENSIONS)
    model = Model(names, idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(32))
    if not names:
        return model
    rows = model.vector(counts)
    labels = np.array([names.index(x) for x in languages])
    centres = [spherical_kmeans(rows[labels == c], k) for c in range(len(names))]
    model.centroids = np.vstack(centres).astype(np.float32)
    model.owner = np.concatenate([np.full(len(c), i) for i, c in enumerate(centres)])
    seen: dict[int, list[float]] = {}
    for row, count in zip(rows, counts, strict=True):
        seen.setdefault(length_bin(count), []).append(float((model.centroids @ row).max()))
    for head in heads:
        for cut in _CUTS:
            if len(head) > cut and has_letter(head[:cut]):
                count = ngram_counts(head[:cut])
                seen.setdefault(length_bin(count), []).append(float((model.centroids @ model.vector(count)).max()))
    for size in range(len(model.floors)):  # cosines rise with length, so a length the sample lacks takes the floor below
        known = seen.get(size, [])
        model.floors[size] = slack * np.quantile(known, 0.01) if len(known) >= 20 else model.floors[size - 1] if size else 0.0
    return model


def held_out(id_column: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", fit_rows: int = FIT_ROWS, k: int = CENTROIDS, seed: int = 11) -> Model:
    """Fit on at most ``fit_rows`` distinct texts of ``labelled``, as many of each language where there are enough."""
    rows = labelled.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("draw", F.xxhash64(F.lit(seed), "text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return fit_sample([], np.zeros((0, DIMENSIONS)), [])
    each = max(1, fit_rows // len(sizes))
    # Somewhat more are drawn than needed, by hash, so that copies are one; then each language is cut at its share.
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.5 * each / n))])
    drawn = rows.where(F.pmod("draw", F.lit(1_000_000)) < shares[F.col("lang")] * 1_000_000).dropDuplicates(["lang", "draw"])
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1_000_000)), "draw"))
    sample = drawn.withColumn("nth", nth).where(F.col("nth") <= each).select("lang", "text")

    def run(batches):
        for batch in batches:
            langs, counts, heads = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if has_letter(text):
                    langs.append(lang)
                    counts.append(ngram_counts(text).astype(np.float32).tobytes())
                    heads.append(text[: _CUTS[-1] + 1])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(counts, pa.binary()), pa.array(heads, pa.string())], ["lang", "counts", "head"])

    got = map_batches(sample, run, "lang string, counts binary, head string").toPandas().sort_values(["lang", "head", "counts"])
    counts = np.array([np.frombuffer(x, dtype=np.float32) for x in got["counts"]]).reshape(-1, DIMENSIONS)
    return fit_sample(list(got["lang"]), counts, list(got["head"]), k)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = shared.value
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], ["doc_id", "lang_pred", "score", "rejected"])

    return map_batches(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, all columns unchanged; no row is moved."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keeps(texts):
        return texts.map(lambda t: not shared.value.predict(t)[2])

    return docs.where(keeps(F.col(f"`{text_col}`")))
