"""Exact length histogram of a corpus.

Documents are counted by encoded length. Suffix sums over the lengths answer, for every context limit:
how many documents reach it, how many tokens they hold, and how many tokens stay when every document
is cut there. The sums go over buckets of lengths first, so that no task sees all lengths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm import tokens as T
from ledgerlake.llm.common import cut, table

BUCKET = 1024


def token_lengths(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """One column n_tokens, a row per document; null text has no tokens."""
    path = path or T.default_path()

    def count(batches):
        enc = T.encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(
                [len(enc.encode(t.as_py() or "")) // 4 for t in batch.column(0)], pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col)).mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs, docs_ge and tokens_ge (documents of that length or more, and their tokens),
    truncated_tokens (tokens left when every document is cut at n_tokens), share_le (part of the
    documents that fit). One row per length that occurs; an empty table gives none."""
    hist = cut(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
               .withColumn("b", F.floor(F.col("n_tokens") / BUCKET)), "lengths")
    sums = hist.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("bt"))
    behind = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # one row per BUCKET lengths: bounded by the longest document, not by the number of documents
    after = sums.select("b", F.coalesce(F.sum("bd").over(behind), F.lit(0)).alias("ad"),
                        F.coalesce(F.sum("bt").over(behind), F.lit(0)).alias("at"))
    total = hist.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("all_tokens"))
    w = Window.partitionBy("b").orderBy(F.col("n_tokens").desc())
    return (hist.join(after, "b").join(F.broadcast(total))
            .withColumn("docs_ge", F.col("ad") + F.sum("n_docs").over(w))
            .withColumn("tokens_ge", F.col("at") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(w))
            .select("n_tokens", "n_docs", "docs_ge", "tokens_ge",
                    (F.col("all_tokens") - F.col("tokens_ge") + F.col("docs_ge") * F.col("n_tokens")).alias("truncated_tokens"),
                    ((F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("all_docs")).alias("share_le")))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut at any limit: n_docs, tokens."""
    n = F.col("n_tokens")
    return histogram.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
                         F.coalesce(F.sum(F.col("n_docs") * F.least(n, F.lit(limit))), F.lit(0)).alias("tokens"))


def length_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The least length that at least the share q of the documents does not exceed."""
    return histogram.filter(F.col("share_le") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def op4_token_counts(spark, sf_dir):
    return length_histogram(token_lengths(table(spark, sf_dir, "documents")))
