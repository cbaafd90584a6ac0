"""Text quality by a regularised quadratic discriminant.

Statistics of each document, transformed to be roughly normal, are modelled by one
Gaussian a class. Class covariances are shrunk towards the pooled covariance and a
scaled identity; their Cholesky factors are computed once and used for every
document's Mahalanobis distances. The score is the logistic function of the
difference of the log densities plus log priors.

The classes' sums and sums of products come from all labelled rows, as one Spark
aggregation; only those sums reach the driver.

Cases: null and empty texts have the statistics of an empty text and get a score; ids
with conflicting labels or a null label are not learned from; with under two rows in
a class every score is that of the prior (0.5 without labels); repeated rows are
scored alike, and each is learned from; a null id hashes as an empty string and has no
label; an empty table of documents gives no rows; very long texts are counted a part at a
time; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.language import held_out
from kinelake.llm.scratch import map_batches

STATISTICS = ("log_chars", "log_words", "word_length", "upper", "digit", "punctuation", "symbol", "pipe", "non_ascii", "log_line_length", "repeated_lines", "distinct_words", "adjacent_repeats", "top_word")
#: Weights of the pooled covariance and of the scaled identity.
TO_POOLED, TO_IDENTITY = 0.2, 0.05

_LOWER, _UPPER, _DIGIT, _BLANK, _PUNCT, _SYMBOL, _PIPE, _OTHER = range(8)


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, dtype=np.uint8)
    for kind, letters in ((_LOWER, "abcdefghijklmnopqrstuvwxyz"), (_UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_DIGIT, "0123456789"), (_BLANK, " \t\n\x0b\x0c\r"), (_PUNCT, ".,;:?!'\"()-"), (_SYMBOL, "#$%&*+/<=>@[\\]^_`{}~"), (_PIPE, "|")):
        table[list(letters.encode())] = kind
    return table


_CLASS = _classes()


def _logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of STATISTICS. Counting runs over a megabyte at a time."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.zeros(8, dtype=np.int64)
    for start in range(0, len(raw), 1 << 20):
        kinds += np.bincount(_CLASS[np.frombuffer(raw, np.uint8, min(1 << 20, len(raw) - start), start)], minlength=8)
    words = text.split()
    lines = [line for line in text.split("\n") if line]
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    n, seen = len(words), len(raw) - int(kinds[_BLANK])
    adjacent = sum(map(str.__eq__, words, words[1:]))
    return [
        float(np.log1p(len(text))),
        float(np.log1p(n)),
        float(np.log1p(seen / n)) if n else 0.0,
        _logit(kinds[_UPPER], seen),
        _logit(kinds[_DIGIT], seen),
        _logit(kinds[_PUNCT], seen),
        _logit(kinds[_SYMBOL], seen),
        _logit(kinds[_PIPE], seen),
        _logit(kinds[_OTHER], seen),
        float(np.log1p(len(text) / max(1, len(lines)))),
        _logit(len(lines) - len(set(lines)), len(lines)),
        _logit(len(counts), n),
        _logit(adjacent, n),
        _logit(max(counts.values(), default=0), n),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, x (array<double>) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [statistics(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "held_out", "x"])

    selected = docs.select(F.col(f"`{id_col}`"), held_out(F.col(f"`{id_col}`")).alias("held_out"), F.col(f"`{text_col}`"))
    return map_batches(selected, run, f"doc_id {kind}, held_out boolean, x array<double>")


@dataclass
class Gaussian:
    mean: np.ndarray
    whitener: np.ndarray  # inverse of the covariance's lower Cholesky factor, made once
    log_det: float
    log_prior: float

    def log_density(self, rows: np.ndarray) -> np.ndarray:
        white = (rows - self.mean) @ self.whitener.T
        return self.log_prior - 0.5 * (self.log_det + (white**2).sum(axis=1))


@dataclass
class Discriminant:
    classes: tuple[Gaussian, Gaussian] | None
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(rows), self.prior)
        low, high = self.classes
        return 1.0 / (1.0 + np.exp(-np.clip(high.log_density(rows) - low.log_density(rows), -500, 500)))


def from_sums(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """``sums``: for class 0 and 1 the number of rows, the sum, and the sum of outer products."""
    n = {c: sums[c][0] if c in sums else 0.0 for c in (0, 1)}
    everything = n[0] + n[1]
    prior = n[1] / everything if everything else 0.5
    if min(n.values()) < 2:
        return Discriminant(None, prior)
    means = {c: sums[c][1] / n[c] for c in (0, 1)}
    scatter = {c: sums[c][2] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)}
    pooled = (scatter[0] + scatter[1]) / everything
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    classes = []
    for c in (0, 1):
        covariance = (1 - to_pooled - to_identity) * scatter[c] / n[c] + to_pooled * pooled + to_identity * scale
        factor = np.linalg.cholesky(covariance)
        classes.append(Gaussian(means[c], np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()), float(np.log(n[c] / everything))))
    return Discriminant((classes[0], classes[1]), prior)


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Discriminant:
    """Fit on the rows of ``stats`` that aren't held out and have a label 0 or 1."""
    d = len(STATISTICS)
    known = labels.select("doc_id", F.col(f"`{label_col}`").cast("int").alias("label")).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    known = known.where("label = other and label in (0, 1)").select("doc_id", "label")
    rows = stats.where("not held_out").join(known, "doc_id")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = F.col("x")
    sums = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x[i]) for i in range(d)]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("p"))
    got = {}
    for row in sums.collect():
        products = np.zeros((d, d))
        for (i, j), v in zip(pairs, row["p"], strict=True):
            products[i, j] = products[j, i] = v
        got[row["label"]] = (float(row["n"]), np.array(row["s"]), products)
    return from_sums(got)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = np.array(batch.column(2).to_pylist(), dtype=np.float64).reshape(-1, len(STATISTICS))
            scores = model.score(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return map_batches(stats.select("doc_id", "held_out", "x"), run, f"doc_id {kind}, held_out boolean, score double, predicted int")
