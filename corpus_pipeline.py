"""A pipeline that prepares documents for training, as a chain of stages over Parquet.

Each stage is a function of (spark, docs, sf_dir) whose result is written and read again
as the next one's docs. All but the last return the columns of documents.

Cases, in every stage: an empty table gives an empty table; other columns go along unchanged, whatever their names (the last
stage keeps its own columns only); very long texts are worked whole; what each stage does with nulls, empty texts, ties
and repeated rows is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import bpe, exact_dedup, language, mixing, ngram_join
from kinelake.llm.queries import tokenizer_path
from kinelake.llm.scratch import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected (no letter, or too far from every centroid) go.

    The centroids are learned from the input's own labelled documents, held-out ones left aside. Null and empty texts have no
    letter and go; repeated rows stay or go together; of equal cosines the language first by code point counts, which decides about no row.
    """
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    return language.accepted(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays; a null text equals an empty one, null ids come last, and of repeated rows one stays."""
    index = exact_dedup.scratch_index(spark, docs.schema["doc_id"].dataType)
    try:
        return exact_dedup.keep_first(docs, index)  # what it needs of the index is materialised
    finally:
        index.drop()


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the row with the smallest id stays.

    Null and empty texts, and texts without words, are linked with nothing and stay; of repeated rows (equal id and text) one stays, as
    the links of equal texts are those of one set; null ids come last.
    """
    return ngram_join.keep_one(docs, 5, ngram_join.Threshold(80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source comes near its target of words; a row stands as often as the mix takes it.

    Documents without words (null, empty, blank) are no part of a target and keep one row each; a null source is one of its own; repeated rows get counts that differ by one at most; draws depend on ids only, so reruns agree.
    """
    return mixing.apply_mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as token ids: doc_id, source, lang, n_tokens, ids, lossless (the ids decode to the text). Null and empty texts have no tokens; repeated rows are encoded alike."""
    return bpe.encode_columns(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), keep=["doc_id", "source", "lang"])


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: The mix's draws and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
