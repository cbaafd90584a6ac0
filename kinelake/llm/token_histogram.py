"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by encoded length. Running sums over the histogram, never over
documents, then answer for every context limit how many documents and tokens there
are, how many exceed the limit, and how many tokens remain if texts are cut there. The
sums are taken in two steps, within blocks of lengths and over the blocks, so no task
holds the whole histogram.

Cases: null and empty texts have length 0 and a row like any other; repeated rows count
each; an empty table has an empty histogram, from which ``answer`` returns zeros and
null quantiles; very long texts are encoded in parts and are one length; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.llm import bpe
from kinelake.llm.scratch import map_batches, materialise

BLOCK = 512


def encoded_lengths(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = bpe.PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe.read_ranks(rank_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = bpe.Codec(shared.value, pattern)
        for batch in batches:
            sizes = [len(codec.encode(text.as_py() or "")) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return map_batches(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), run, f"doc_id {kind}, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) for each length that occurs."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row a length L that occurs: its documents and tokens, those of all documents of L or more, the documents
    of L or less with their share of all (the quantile that L is), and the tokens left when every text is cut at L."""
    hist = materialise(hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "histogram")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = W.orderBy("block").rowsBetween(1, W.unboundedFollowing)
    beyond = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"), F.sum("d").over(W.partitionBy()).alias("docs"), F.sum("t").over(W.partitionBy()).alias("tokens"))
    here = W.partitionBy("block").orderBy("n_tokens").rowsBetween(0, W.unboundedFollowing)
    length = F.col("n_tokens")
    out = hist.join(beyond, "block").select(
        length,
        "n_docs",
        (F.col("n_docs") * length).alias("tokens_at"),
        (F.sum("n_docs").over(here) + F.col("docs_after")).alias("docs_from"),
        (F.sum(F.col("n_docs") * length).over(here) + F.col("tokens_after")).alias("tokens_from"),
        "docs",
        "tokens",
    )
    up_to = F.col("docs") - F.col("docs_from") + F.col("n_docs")
    cut = F.col("tokens") - F.col("tokens_from") + length * F.col("docs_from")
    return out.select("n_tokens", "n_docs", "tokens_at", "docs_from", "tokens_from", up_to.alias("docs_up_to"), (up_to / F.col("docs")).alias("quantile"), cut.alias("truncated_tokens"), "docs", "tokens")


def answer(sums: DataFrame, limits: list[int], quantiles: list[float]) -> tuple[dict[int, dict], dict[float, int | None]]:
    """For each limit the documents above it and the tokens left after cutting there; for each quantile its length.

    A limit between two lengths that occur is answered from the next longer one, so any limit is exact.
    """
    total = sums.agg(F.max("docs"), F.max("tokens")).first()
    docs, tokens = total[0] or 0, total[1] or 0
    above = {}
    if limits:
        aggs = []
        for limit in limits:
            longer = F.col("n_tokens") > limit
            aggs += [F.coalesce(F.max(F.when(longer, F.col("docs_from"))), F.lit(0)), F.coalesce(F.max(F.when(longer, F.col("tokens_from"))), F.lit(0))]
        row = sums.agg(*aggs).first()
        above = {limit: {"docs": docs, "tokens": tokens, "docs_over": row[2 * i], "truncated_tokens": tokens - row[2 * i + 1] + limit * row[2 * i]} for i, limit in enumerate(limits)}
    at = {}
    if quantiles:
        row = sums.agg(*[F.min(F.when(F.col("docs_up_to") >= F.ceil(F.lit(q) * F.col("docs")), F.col("n_tokens"))) for q in quantiles]).first()
        at = {q: row[i] for i, q in enumerate(quantiles)}
    return above, at
