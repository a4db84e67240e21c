"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer.

Documents are tokenised in tasks and leave them as (length, documents) counts, so that the corpus itself is never shuffled.
Suffix sums over the lengths are made in blocks: inside a block by a window, across blocks from the blocks' totals.

Defined results: null text counts as empty and has length 0; repeated rows count each; ids are not read, so null ones do no
harm; an empty table gives no rows; extra columns are ignored. Texts are tokenised whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.llm.common import shared_dir
from dyadflow.llm.packing import texts_of, tokenizer


def count_lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_each
        for batch in batches:
            seen = Counter(len(ids) // 4 for ids in encode(texts_of(batch, "text")))
            yield pa.RecordBatch.from_pydict({"length": list(seen), "n_docs": list(seen.values())})

    return run


def length_histogram(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """Rows (length, n_docs): how many documents have exactly so many tokens."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(count_lengths(tokenizer_path), "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def context_limits(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """For each length that occurs, taken as a context limit: documents and tokens at or below it, documents above it, the
    quantile that it is (share of documents at or below) and the tokens left when every document is cut to it.

    A limit between two lengths has the counts of the lower one; its tokens_cut is tokens_upto + limit * docs_over.
    """
    shared_dir(histogram.sparkSession)
    counted = histogram.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / block)).checkpoint()
    # a row for each block: the longest text's length over `block` at most
    blocks = counted.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.select("block", F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("block_tokens").over(above), F.lit(0)).alias("later_tokens"))
    total = blocks.agg(F.sum("block_docs").alias("all_docs"), F.sum("block_tokens").alias("all_tokens")).head()
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    over = counted.select("length", "n_docs", "block", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)).alias("d"), F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("t")).join(later, "block")
    docs_over, tokens_over = F.col("d") + F.col("later_docs"), F.col("t") + F.col("later_tokens")
    all_docs, all_tokens = F.lit(total["all_docs"] or 0).cast("long"), F.lit(total["all_tokens"] or 0).cast("long")
    return over.select(
        "length",
        "n_docs",
        (all_docs - docs_over).alias("docs_upto"),
        docs_over.alias("docs_over"),
        (all_tokens - tokens_over).alias("tokens_upto"),
        (all_tokens - tokens_over + F.col("length") * docs_over).alias("tokens_cut"),
        ((all_docs - docs_over) / all_docs).alias("quantile"),
    )
