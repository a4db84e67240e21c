"""What the operators do with repeated rows, null ids and unlabelled tables: every row counts, one row of a group stays."""

import inspect
import random
from collections import Counter

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from dyadflow.llm import exact, language, passages, quality, registry, repeats, suffixes

DOCS = "doc_id long, text string, lang string"


def test_exact_groups_count_every_row(spark):
    rows = [(7, "a b"), (7, "a b"), (7, "ab"), (9, "a  b"), (9, "a  b"), (None, "x y z"), (None, "x y z"), (None, "xyz"), (1, "solo"), (None, "solo too"), (2, None), (3, ""), (4, "twin"), (4, "twin")]
    docs = spark.createDataFrame([(*r, None) for r in rows], DOCS).repartition(3)
    got = exact.exact_groups(docs, memtable_rows=2).toPandas()
    with duckdb.connect() as db:
        db.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
        want = db.sql(registry.oracle_sql()["op6_exact_dedup"]).fetchall()
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    ours = [tuple(None if v != v else v for v in r) for r in got[columns].itertuples(index=False, name=None)]
    assert Counter(ours) == Counter((a, b, n, h) for a, b, n, _, h in want)
    assert len(got) == len(rows) and (got.groupby("text_sha256")["kept"].sum() == 1).all()
    assert (got[got["kept"]]["doc_id"].isna() == got[got["kept"]]["keep_id"].isna()).all()


def test_dedup_stages_leave_one_row_of_a_group(spark):
    base = " ".join(f"tok{i}" for i in range(80))
    other = " ".join(f"far{i}" for i in range(80))
    third = " ".join(f"new{i}" for i in range(80))
    equal = [(5, base), (5, base), (5, base), (None, other), (None, other), (1, "solo"), (5, "of the same id"), (None, "no id")]
    docs = spark.createDataFrame([(*r, None) for r in equal], DOCS).repartition(3)
    got = corpus_pipeline.one_of_equal(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter((r[0], r[1]) for r in got.collect()) == Counter(set(equal))
    near = [(5, base), (5, base + " more"), (5, base), (None, other), (None, other + " end"), (3, third), (2, third + " end"), (2, third), (None, "..."), (None, "!"), (1, "solo"), (None, "no id")]
    docs = spark.createDataFrame([(*r, None) for r in near], DOCS).repartition(3)
    got = [(r[0], r[1]) for r in corpus_pipeline.one_of_near(spark, docs, "").collect()]
    starts = Counter((doc, text.split()[0]) for doc, text in got)
    assert starts == Counter([(5, "tok0"), (None, "far0"), (2, "new0"), (None, "..."), (None, "!"), (1, "solo"), (None, "no")])


def line_in_different_surroundings(unit):
    rng = random.Random(3)
    if unit == "word":
        line, letters, gap = " ".join(f"line{i}" for i in range(30)), [f"x{i}" for i in range(5000)], " "
    else:
        line, letters, gap = "a line of 45 bytes that all documents have in", "abcdefghijklmnopqrstuvwxyz0123456789", ""
    around = lambda n: gap.join(rng.choices(letters, k=n))
    texts = [gap.join((around(60), line, around(60))) for _ in range(400)]
    copies = [gap.join((around(5), texts[i], around(5))) for i in range(0, 400, 20)]
    return [(i % 300 if i % 7 else None, t) for i, t in enumerate(texts + copies + texts[:3])]


@pytest.mark.parametrize("rule", [repeats.Windows("word", 35, 8), repeats.Windows("byte", 50, 16)])
def test_a_crowded_anchor_is_dealt_to_many_shards(spark, rule):
    docs = spark.createDataFrame([(*r, None) for r in line_in_different_surroundings(rule.unit)], DOCS).repartition(3)

    def decide(found):
        n = int(found.units.window_starts().sum())
        assert n < (3000 if rule.unit == "word" else 6000), f"{n} windows of {len(found.ids)} texts in one shard, longest {int((found.units.last - found.units.first).max())}"
        return passages.occurs_twice(found)

    def finish(bucket, answers):
        return pd.DataFrame({"id": bucket.ids})

    parts = {"crowd": 20} if "crowd" in inspect.signature(repeats.repeated_windows).parameters else {}
    assert repeats.repeated_windows(docs, "doc_id", "text", rule, decide, finish, "id long", bucket_bytes=4000, **parts).count() == 423


@pytest.mark.parametrize(("operator", "unit"), [(passages.remove_recurring, "word"), (suffixes.remove_earlier, "byte")])
def test_crowded_anchors_give_the_same_rows(spark, operator, unit):
    docs = spark.createDataFrame([(*r, None) for r in line_in_different_surroundings(unit)], DOCS).repartition(3)
    whole = Counter(map(tuple, operator(docs, crowd=10**9).collect()))
    assert sum(n for row, n in whole.items() if row[2]) > 20
    assert Counter(map(tuple, operator(docs, crowd=0, bucket_bytes=20_000).collect())) == whole
    assert Counter(map(tuple, operator(docs, crowd=20).collect())) == whole


def test_quality_threshold_is_one_of_all_labelled_documents(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("documents", "labels"))
    seen = []
    of_all = quality.best_quantile
    monkeypatch.setattr(quality, "best_quantile", lambda scored: seen.append(scored.groupBy("label").count().collect()) or of_all(scored))
    quality.score_documents(docs, labels, sample=10).limit(0).collect()
    learned = labels.where("quality IN (0, 1)").join(docs, "doc_id").where(language.fold("doc_id", 5) != 0)
    assert {r["label"]: r["count"] for r in seen[0]} == {r["quality"]: r["count"] for r in learned.groupBy("quality").count().collect()}
    assert sum(r["count"] for r in seen[0]) > 60


def test_stages_leave_clashing_columns_alone(spark):
    base = " ".join(f"tok{i}" for i in range(80))
    names = ["_judged", "found", "row", "_row", "doc", "gone_id", "h", "id", "label"]
    rows = [(i, t, "en", *[f"{n}{i}" for n in names]) for i, t in enumerate([base, base, base + " more", "a sentence", "another one"])]
    docs = spark.createDataFrame(rows, DOCS + "".join(f", {n} string" for n in names)).repartition(2)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "/root/testdata/sf0.001").checkpoint()
        assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter(r for r in rows if r[0] not in (1, 2))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "/root/testdata/sf0.001").checkpoint()
    assert empty.count() == 0


def test_language_stage_keeps_unlabelled_documents(spark):
    texts = [None, "", "...", "123 !", "Ein Satz", "a sentence", "é", "a sentence"]
    docs = spark.createDataFrame([(i if i % 3 else None, t, None) for i, t in enumerate(texts)], DOCS)
    got = corpus_pipeline.known_language(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter(tuple(r) for r in docs.collect() if any(c.isalpha() for c in r[1] or ""))


def test_dedup_stages_do_not_shuffle_the_documents(spark):
    """Few rows are dropped, and their number is known before they are joined away: the documents are not shuffled for it."""
    docs = spark.createDataFrame([(i, f"text number {i // 2} of many", None) for i in range(200)], DOCS)
    for stage in (corpus_pipeline.one_of_equal, corpus_pipeline.one_of_near):
        plan = stage(spark, docs, "")._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
