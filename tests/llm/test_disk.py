"""What the text operators write and shuffle."""

import corpus_pipeline
from pyspark.sql import functions as F

from dyadflow.llm import phrases


def test_dedup_stages_write_no_table_of_documents(spark, monkeypatch):
    """A written table stays until Spark ends, and so would the documents of each stage."""
    kept = []
    monkeypatch.setattr(corpus_pipeline, "written", lambda df, write=corpus_pipeline.written: (kept.append(df.columns), write(df))[1])
    docs = spark.createDataFrame([(i, f"text number {i // 2} of many") for i in range(40)], "doc_id long, text string")
    assert corpus_pipeline.one_of_equal(spark, docs, "").count() == 20
    assert kept == [["row"]]


def test_windows_go_by_number(spark):
    """Neither the text of a window nor words around terms that lead no phrase are shuffled or stored."""
    docs = spark.createDataFrame([(1, "rare one two three common common"), (2, "common one rare"), (3, None)], "doc_id long, text string")
    windows = phrases.windows_of(spark.createDataFrame([("a", "rare one two")], "item_id string, text string"), "item_id", "text", 3).withColumn("w", F.lit(7).cast("long"))
    terms = windows.select(F.explode("terms").alias("term"))
    rarest = phrases.rarest_terms(windows, phrases.term_counts(docs, "text", terms, 3))
    index = phrases.build_index(docs, "doc_id", "text", rarest.groupBy("term").agg(F.max(F.col("rank") == 1).alias("leads")), 2, 3)
    assert {(r.term, r.near is None) for r in index.collect()} == {("two", False), ("one", True)}
    found = phrases.phrase_matches(index, rarest, 2)
    assert found.columns == ["k", "w", "start", "len"] and [tuple(r)[1:] for r in found.collect()] == [(7, 0, 3)]
    assert phrases.proximity_matches(index, rarest, 2, 2).columns == ["k", "w"]
