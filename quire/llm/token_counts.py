"""Token counts from an exact length histogram.

Every whole text is encoded once; only its length goes on. Documents are aggregated by encoded length (partial sums
before the shuffle), and suffix and prefix sums over the histogram answer, for every context limit L that is some
document's length: how many documents fit, how many tokens stay if every document is truncated to L, how many are cut.
`totals_at` and `quantiles` read the same histogram for any other limit or share, so one scan serves all questions.

The histogram has one row per distinct length. Its running sums are taken in two levels (blocks of 64 lengths, then
the blocks' totals), so no task holds more than a block or the list of blocks.

The vocabulary is a file of byte-pair ranks; the driver reads it and broadcasts its bytes (bounded by `most_bytes`).

Rows: a null or empty text has length 0. Texts in which special tokens are spelled out are ordinary text. Long runs
without a break are encoded whole. An empty table gives no rows. Columns other than the text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenising pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 64


def encoding(vocabulary: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_lengths(
    docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, most_bytes: int = 16 << 20
) -> DataFrame:
    """One row (n_tokens) per document."""
    raw = Path(vocabulary).read_bytes()
    if len(raw) > most_bytes:
        raise ValueError(f"the vocabulary is larger than most_bytes={most_bytes}")
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(shared.value, pattern)
        for batch in batches:
            n = [len(coder.encode_ordinary(x)) if x else 0 for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(n, np.int64))], ["n_tokens"])

    return docs.select(text_col).mapInArrow(part, "n_tokens long")


def histogram(docs: DataFrame, **options) -> DataFrame:
    """Rows (n_tokens, n_docs)."""
    return with_lengths(docs, **options).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """For each length L in the histogram: what a context limit of L keeps and cuts."""
    hist = hist.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK))
    tokens = F.col("n_docs") * F.col("n_tokens")
    sums = hist.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum(tokens).alias("_t"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    blocks = sums.select(
        "_block",
        F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d0"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"),
        F.sum("_d").over(every).alias("docs"),
        F.sum("_t").over(every).alias("tokens"),
    )
    upto = Window.partitionBy("_block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(blocks, "_block").select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        "docs",
        "tokens",
        (F.col("_d0") + F.sum("n_docs").over(upto)).alias("docs_within"),
        (F.col("_t0") + F.sum(tokens).over(upto)).alias("tokens_within"),
    )
    cut = F.col("docs") - F.col("docs_within")
    kept = F.col("tokens_within") + cut * F.col("context_limit")
    return out.select(
        "context_limit",
        "n_docs",
        "docs_within",
        cut.alias("docs_cut"),
        kept.alias("tokens_kept"),
        (F.col("tokens") - kept).alias("tokens_cut"),
        (F.col("docs_within") / F.col("docs")).alias("quantile"),
        F.col("tokens").alias("total_tokens"),
    )


def totals_at(hist: DataFrame, context_limits: list[int]) -> DataFrame:
    """Rows (context_limit, tokens_kept, docs_cut) for any limits, each one sum over the histogram."""
    sums = []
    for k, limit in enumerate(context_limits):
        sums += [
            F.sum(F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(limit))).alias(f"k{k}"),
            F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs")).otherwise(0)).alias(f"c{k}"),
        ]
    one = hist.agg(*sums)
    rows = F.array(
        *(
            F.struct(
                F.lit(limit).cast("long").alias("context_limit"),
                F.coalesce(F.col(f"k{k}"), F.lit(0)).alias("tokens_kept"),
                F.coalesce(F.col(f"c{k}"), F.lit(0)).alias("docs_cut"),
            )
            for k, limit in enumerate(context_limits)
        )
    )
    return one.select(F.inline(rows))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """Rows (share, n_tokens): the smallest length that at least that share of the documents does not exceed."""
    points = limits(hist).agg(*(F.min(F.when(F.col("quantile") >= s, F.col("context_limit"))).alias(f"q{k}") for k, s in enumerate(shares)))
    rows = F.array(*(F.struct(F.lit(s).alias("share"), F.col(f"q{k}").alias("n_tokens")) for k, s in enumerate(shares)))
    return points.select(F.inline(rows))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits(stored(histogram(table(spark, sf_dir, "documents"))))
