"""Scores of op4 and op8 recomputed in plain Python; the shuffled index of op3; empty tables."""

import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadflow.llm import exact, language, phrases, quality, urls

DATA = "/root/testdata/sf0.001"
MIX, FULL = [int(m) for m in language.MIX], (1 << 64) - 1


def gram(points, shift):
    """The hash of one, two or three characters."""
    h = points[0] * MIX[0]
    if len(points) == 2:
        h ^= points[1] * MIX[1] + MIX[2] & FULL
    if len(points) == 3:
        h ^= (points[1] * MIX[1] + MIX[0] & FULL) ^ (points[2] * MIX[2] + MIX[1] & FULL)
    h &= FULL
    return ((h ^ h >> 31) * MIX[1] & FULL) >> shift


def letters(text):
    out = []
    for c in text.lower():
        if c.isalpha():
            out.append(ord(c))
        elif out and out[-1] != 32:
            out.append(32)
    return [32, *out, 32]


def language_grams(text):
    p = letters(text)
    found = p[1:-1]
    rows = [(c,) for c in found] + list(zip(p, p[1:], strict=False)) + list(zip(p, p[1:], p[2:], strict=False))
    return Counter(gram(r, 40) % (1 << 32) % language.BUCKETS for r in rows)


def unit(counts, idf=None):
    x = {k: math.log1p(n) * (1.0 if idf is None else idf[k]) for k, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {k: v / norm for k, v in x.items()} if norm else x


def softmax(z):
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


def test_language_scores_equal_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = language.trained(docs)
    classes, idf, w, t = pickle.loads(zlib.decompress(model))
    got = docs.select("doc_id", "text", language.judged(docs, model).alias("f")).select("doc_id", "text", "f.*").collect()
    assert len(got) > 50
    for r in got:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        x = unit(language_grams(r["text"]), idf)
        p = softmax([sum(float(w[k, c]) * v for k, v in x.items()) / t for c in range(len(classes))])
        assert r["score"] == pytest.approx(max(p), rel=1e-4) and r["lang_pred"] == classes[p.index(max(p))]


def test_weights_equal_plain_ftrl():
    draw, alpha, beta, l1, l2 = random.Random(4), 1.0, 1.0, 0.02, 0.02
    model, z, n = language.Ftrl(12, 3), {}, {}

    def weight(i, c):
        at = z.get((i, c), 0.0)
        return 0.0 if abs(at) <= l1 else -(at - math.copysign(l1, at)) / ((beta + math.sqrt(n.get((i, c), 0.0))) / alpha + l2)

    for _ in range(200):
        x = {i: draw.random() for i in sorted(draw.sample(range(12), 4))}
        label = draw.randrange(3)
        model.learn(np.array(list(x)), np.array(list(x.values())), label)
        now = {(i, c): weight(i, c) for i in x for c in range(3)}
        p = softmax([sum(now[i, c] * v for i, v in x.items()) for c in range(3)])
        for (i, c), w in now.items():
            g = (p[c] - (c == label)) * x[i]
            before = n.get((i, c), 0.0)
            z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w
            n[i, c] = before + g * g
    got = model.weights()
    assert all(got[i, c] == pytest.approx(weight(i, c), abs=1e-9) for i in range(12) for c in range(3))


def test_null_ids_are_not_learned_from(spark):
    rows = [(i if i % 2 else None, "aber nicht doch" if i % 2 else "qui que quoi", "de" if i % 2 else "fr") for i in range(40)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in got.collect()} == {"de"}


def quality_features(text):
    if not text:
        return {quality.BUCKETS + quality.SHAPE - 1: 1.0}
    p = [32 if c.isspace() else 48 if c.isdecimal() else (1 << 21) + ord(c.lower()[0]) if c.isupper() else ord(c) for c in text]
    counts = Counter(gram(r, 50) for r in [(c,) for c in p] + list(zip(p, p[1:], strict=False)) + list(zip(p, p[1:], p[2:], strict=False)))
    words, lines = text.split(), text.split("\n")
    n, kinds = max(1, len(words)), len(set(words))
    shape = [kinds / n, kinds / n * math.log1p(n) / 8, min(20.0, len(text) / n) / 10, math.log1p(len(text)) / 10, len(set(lines)) / len(lines)]
    return unit(counts) | {quality.BUCKETS + i: v for i, v in enumerate(shape)}


def test_quality_scores_equal_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "A1 b2\n\nÉé Straße 99"), (-4, "\n"), (-5, "word " * 50)]
    docs = docs.unionAll(spark.createDataFrame(odd, "doc_id long, text string"))
    weights = np.random.default_rng(2).normal(size=quality.BUCKETS + quality.SHAPE)
    for r in docs.withColumn("s", quality.worth(weights)(F.col("text"))).collect():
        assert r["s"] == pytest.approx(sum(float(weights[k]) * v for k, v in quality_features(r["text"]).items()), abs=1e-4)


def test_shuffled_index_gives_the_same_rows(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(docs.limit(5)).unionAll(spark.createDataFrame([(None, "alpha beta"), (None, "alpha beta"), (None, None), (-7, ""), (-8, "beta gamma " * 300)], docs.schema))
    first = docs.where("length(text) > 400").select(F.col("text")).head()["text"]
    items = spark.createDataFrame([("a", "alpha beta"), ("b", "beta gamma beta"), ("c", first[50:350]), ("d", "gamma")], "item_id string, text string")
    key = lambda r: tuple(str(v) for v in r)
    want = sorted(phrases.decontaminate(docs, items).collect(), key=key)
    monkeypatch.setattr(phrases, "BROADCAST_TERMS", 0)
    assert sorted(phrases.decontaminate(docs, items).collect(), key=key) == want
    assert any(r["n_hit"] == 600 for r in want) and sum(r["n_hit"] == 2 for r in want) == 2


def test_index_of_many_terms(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BROADCAST_TERMS", 0)
    docs = spark.createDataFrame([(i, "alpha beta gamma") for i in range(50)], "doc_id long, text string")
    index = phrases.build_index(docs, "doc_id", "text", spark.createDataFrame([("beta",)], "term string"), 1, 2)
    assert sorted((r["pos"], r["near_from"], r["near"]) for r in index.collect()) == [(1, 0, ["alpha", "beta", "gamma"])] * 50


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_groups(docs).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int")).count() == 0
