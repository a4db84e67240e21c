"""Cleaning and packing of a corpus: language, exact copies, near copies, benchmark passages, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. The two
dedup stages number the rows they are given and keep one row of each group by that number, so copies that share an id, or
have none, go too; a null id is a value like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.llm import bags, exact, language, packing, phrases
from dyadflow.llm.common import shared_dir, table, written

#: A document whose language is less certain than this, or that has no letter, is rejected; where no document names its language, only the latter.
MIN_LANGUAGE_SCORE = 0.35
VOCABULARY = "word_bpe_49k.json"


def whole(docs: DataFrame):
    """A row of docs as one column, so that no name of a stage's own can clash with one of its columns."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.trained(docs)
    if model is None:
        # nothing to learn from: no text's language is known, and only those without a letter are rejected
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = docs.select(whole(docs), language.judged(docs, model).alias("found"))
    return judged.where((F.col("found.lang_pred") != language.UNDETERMINED) & (F.col("found.score") >= MIN_LANGUAGE_SCORE)).select("doc.*")


def kept_rows(spark: SparkSession, docs: DataFrame, groups: Callable[..., DataFrame]) -> DataFrame:
    """The rows of docs that groups() keeps; the numbers that tell rows apart are written once, so that every reader sees the same."""
    shared_dir(spark)
    # a checkpoint: unlike a written table, it can go before Spark ends (spark.cleaner.referenceTracking.cleanCheckpoints)
    numbered = docs.select(whole(docs), F.monotonically_increasing_id().alias("row")).checkpoint()
    # written, so that their size is known before the join: while they are few, the documents are not shuffled
    dropped = written(groups(numbered.select("row", "doc.doc_id", "doc.text"), row_col="row").where("not kept").select("row"))
    return numbered.join(dropped, "row", "left_anti").select("doc.*")


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(spark, docs, exact.exact_groups)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(spark, docs, bags.near_classes)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are told apart by id and text: rows that share both have one verdict."""
    judged = phrases.keyed_verdicts(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    gone = judged.where("contaminated").select(F.col("k.id").alias("gone_id"), F.col("k.h").alias("gone_h")).distinct()
    keyed = docs.select(whole(docs), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    return keyed.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left_anti").select("doc.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("language", known_language),
    ("exact_dedup", one_of_equal),
    ("near_dedup", one_of_near),
    ("decontamination", not_contaminated),
    ("packing", sequences),
]
#: SQL has neither the language model, the signatures nor the tokenizer: see test_pipeline in tests/llm/test_brute_force.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)
