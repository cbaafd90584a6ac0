"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import ann, bpe, centroids, exact_dedup, fingerprints, language, license_scan, mixing, ngram_join, pii, quality, token_histogram, whitening
from kinelake.llm.scratch import materialise


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches and revealing terms in every text; tests compare the matches with the patterns themselves."""
    rows = pii.all_spans(table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in pii.KINDS[: pii.BASE]]
    return rows.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_secret", "n_term", "n_spans")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded; no SQL has the tokenizer, so tests compare with the library on whole texts."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the first batch of an empty index."""
    docs = table(spark, sf_dir, "documents")
    index = exact_dedup.scratch_index(spark)
    try:
        rows = materialise(exact_dedup.deduplicate(docs, index), "op3")
    finally:
        index.drop()
    return rows.withColumnRenamed("digest", "text_sha256")


OP3_SQL = r"""
WITH h AS (
  SELECT doc_id, sha256(coalesce(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), '')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""


def op4_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of encoded lengths of all documents with its suffix sums; tests compare with brute force."""
    lengths = token_histogram.encoded_lengths(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    return token_histogram.suffix_sums(token_histogram.histogram(lengths))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, Jaccard 0.85; too slow for SQL on whole tables, so tests compare with all pairs of a fixture."""
    return ngram_join.join(table(spark, sf_dir, "documents"), 4, ngram_join.Threshold(85))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100; tests measure recall against brute force."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out; tests measure held-out accuracy."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    return language.predict(docs, model).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices and licence texts anywhere in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels of those not held out; tests measure held-out accuracy."""
    stats = materialise(quality.document_statistics(table(spark, sf_dir, "documents")), "statistics")
    return quality.score(stats, quality.fit(stats, table(spark, sf_dir, "labels")))


def op10_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. The draws have no SQL; tests check targets, bounds and unbiasedness."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and the next document; tests compare with phrases parsed by plain loops."""
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds over all vectors of 64 components."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All finite vectors, whitened; no SQL has eigenvectors, so tests compare with a dense solver."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_histogram": op4_token_histogram,
    "op5_ngram_join": op5_ngram_join,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_quality": op9_quality,
    "op10_pivotal_mix": op10_pivotal_mix,
    "op11_fingerprints": op11_fingerprints,
    "op12_centroids": op12_centroids,
    "op13_whitening": op13_whitening,
}
SQL = {
    "op3_exact_dedup": OP3_SQL,
    "op8_license_scan": license_scan.scan_sql(),
    "op12_centroids": centroids.cluster_sql(),
}
