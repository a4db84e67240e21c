"""Operators that SQL does not express, against plain Python over the smallest documents and over odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from dyadflow.llm import bags, exact, language, lengths, passages, phrases, quality, suffixes, urls

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, digest int, label string"
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(30_000))


def odd_rows():
    base = " ".join(f"tok{i}" for i in range(80))
    texts = [None, "", " \t\n", "one", "one", base, base, base + " more", "x " + base, LONG, LONG + " end", "ab" * 60, "é" * 60, "...", "Two words"]
    rows = [(i, t, "en" if i % 2 else None, None, None, "e", 1, None) for i, t in enumerate(texts)]
    return [*rows, (None, base, "en", "s", 1, None, None, None), (5, base, "en", "s", 1, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    given = docs.select("doc_id", "text").toPandas()
    odd = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    return [(docs, list(given.itertuples(index=False, name=None))), (odd, [r[:2] for r in odd_rows()]), (spark.createDataFrame([], SCHEMA), [])]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_passages(tables):
    for docs, rows in tables:
        seen, split = Counter(), []
        for doc, text in rows:
            words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
            split.append((doc, words))
            seen.update(tuple(words[i : i + 35]) for i in range(len(words) - 34))
        want = []
        for doc, words in split:
            gone = set()
            for i in range(len(words) - 34):
                if seen[tuple(words[i : i + 35])] > 1:
                    gone.update(range(i, i + 35))
            kept = " ".join(w for i, w in enumerate(words) if i not in gone)
            want.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
        assert rows_of(passages.remove_recurring(docs)) == sorted(want, key=repr)


def test_suffixes(tables):
    for docs, rows in tables:
        first = {}
        order = lambda doc: 2**63 - 1 if doc is None else doc
        for doc, text in rows:
            data = (text or "").encode()
            for i in range(len(data) - 49):
                s = data[i : i + 50]
                first[s] = min(first.get(s, 2**63), order(doc))
        want = []
        for doc, text in rows:
            data = (text or "").encode()
            gone = bytearray(len(data))
            for i in range(len(data) - 49):
                if first[data[i : i + 50]] < order(doc):
                    gone[i : i + 50] = b"\1" * 50
            kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
            want.append((doc, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
        assert rows_of(suffixes.remove_earlier(docs)) == sorted(want, key=repr)
        # many small batches, levels and ranges of the order
        assert rows_of(suffixes.remove_earlier(docs, batch=40, most=500)) == sorted(want, key=repr)


def words_of(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]


def brute_classes(rows):
    """Components over all pairs whose bags of five words have a weighted Jaccard similarity of 0.8."""
    bag = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words_of(t)) else Counter() for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = (bag[i] & bag[j]).total()
            if both and both >= 0.8 * (bag[i].total() + bag[j].total() - both):
                root[find(i)] = find(j)
    classes = {}
    for i, (doc, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(doc)
    return classes.values()


def test_near_classes(tables):
    for docs, rows in tables:
        if rows and rows[0][1] is None:
            rows = [r for r in rows if words_of(r[1])]
            docs = docs.where("length(regexp_replace(text, '[^a-zA-Z0-9é]', '')) > 0")
        want = sorted(((doc, min(x for x in c if x is not None), len(c)) for c in brute_classes(rows) for doc in c), key=repr)
        got = rows_of(bags.near_classes(docs).select("doc_id", "class_id", "class_size"))
        assert got == want


def edited_copies():
    """Groups of edited copies of one text each, whose edits recur, with shorter, longer and far ones among them."""
    rng, rows = random.Random(7), []
    for g in range(3):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(240)]
        added = [[f"g{g}a{k}x{i}" for i in range(40)] for k in range(4)]
        for _ in range(90):
            own = list(base)
            for _ in range(rng.choice((0, 1, 3, 6, 9, 12))):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            own = own[: rng.choice((240, 240, 225, 200, 170))] + rng.choice(added + [[], []])
            rows.append((len(rows), " ".join(own)))
    return rows


def test_no_link_of_a_bucket_is_lost(spark):
    rows = edited_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bags_of = [bags.bags([bags.word_text(t)], 5)[1:] for _, t in rows]
    keys = [bags.band_keys(bags.bag_minhash(np.zeros(len(h), np.int64), h, w, 1, 120), 20)[0].tolist() for h, w in bags_of]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if any(a == b for a, b in zip(keys[i], keys[j], strict=True)) and bags.overlap(bags_of[i], bags_of[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {i: find(i) for i in range(len(rows))}
    assert 10 < len(set(want.values())) < 200
    got = {r[0]: r[1] for r in bags.near_classes(docs, few=0).select("doc_id", "class_id").collect()}
    assert got == want


def test_signatures_estimate_weighted_jaccard():
    a = bags.bags([b" ".join(b"v%d" % (i % 150) for i in range(700))], 1)
    b = bags.bags([b" ".join(b"v%d" % (i % 150 + 30) for i in range(900))], 1)
    h = [bags.bag_minhash(*x, 1, 4096)[0] for x in (a, b)]
    assert abs((h[0] == h[1]).mean() - bags.overlap(a[1:], b[1:])) < 0.03


def test_token_lengths(tables):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for docs, rows in tables:
        n = [len(model.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
        want = [(k, n.count(k), sum(x <= k for x in n), sum(x > k for x in n), sum(x for x in n if x <= k), sum(min(x, k) for x in n), sum(x <= k for x in n) / len(n)) for k in set(n)]
        got = lengths.context_limits(lengths.length_histogram(docs, "word_bpe_49k.json"), block=64)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_language(spark, tables):
    docs, rows = tables[0]
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"] & got["lang"].notna() & (got["lang_pred"] != "und")]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.9
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    odd = language.identify(tables[1][0]).toPandas()
    assert len(odd) == len(tables[1][1])
    assert (odd["lang_pred"] == "und").sum() == sum(not any(c.isalpha() for c in t or "") for _, t in tables[1][1])
    assert language.identify(tables[2][0]).count() == 0


def test_quality(spark, tables):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    got = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out AND quality is not null").toPandas()
    good, bad = (got[got["quality"] == q]["score"].to_numpy() for q in (1, 0))
    # held-out documents: area under the curve, and how the threshold parts them
    assert len(bad) > 5 and (good[:, None] > bad[None, :]).mean() > 0.95
    assert (got["predicted"] == got["quality"]).mean() > 0.9
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for odd, rows in tables[1:]:
        scored = quality.score_documents(odd, labels).toPandas()
        assert len(scored) == len(rows) and scored["score"].between(0, 1).all()
        assert quality.score_documents(odd, labels.limit(0)).count() == len(rows)


def test_quality_takes_long_repeats(spark):
    texts = ["buy " * 100_000, "x" * 3_000_000, "\n" * 50_000, "é" * 5, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    got = quality.score_documents(docs, labels).toPandas()
    assert len(got) == 6 and got["score"].between(0, 1).all()


def test_bradley_terry_weights_are_the_least_loss():
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(40, 6, replace=False)).astype(np.int32), rng.normal(size=6).astype(np.float32)) for _ in range(30)]
    labels = rng.integers(0, 2, 30)
    better, worse = quality.preference_pairs(labels, 4)
    assert (labels[better] == 1).all() and (labels[worse] == 0).all() and len(better) == 4 * min(labels.sum(), 30 - labels.sum())
    edges = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])])
    w = quality.bradley_terry(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), edges, better, worse, 0.01, 3000)
    dense = np.zeros((30, len(w)))
    for k, (i, x) in enumerate(rows):
        dense[k, i] = x
    gap = dense[better] - dense[worse]
    slope = -(gap / (1 + np.exp(gap @ w))[:, None]).mean(axis=0) + 0.01 * w
    assert np.abs(slope).max() < 1e-4


def test_exact_and_phrases_take_odd_rows(spark, tables):
    odd, rows = tables[1]
    body = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    got = exact.exact_groups(odd).toPandas()
    assert set(got["text_sha256"]) == {hashlib.sha256(b.encode()).hexdigest() for b in body}
    kept = got[got["kept"]]["text_sha256"]
    assert set(kept) == set(got["text_sha256"])
    items = spark.createDataFrame([("a", rows[5][1]), ("b", "one"), ("c", None), (None, "two words"), ("d", "")], "item_id string, text string")
    hit = phrases.decontaminate(odd, items).toPandas().set_index("doc_id")
    assert len(hit) == len(rows) and hit.loc[8, "n_hit"] == 80 and hit.loc[3, "contaminated"] and hit.loc[14, "n_hit"] == 2
    near = phrases.decontaminate(spark.createDataFrame([(1, "tok1 x tok2 tok3 end"), (2, "tok9"), (3, "tok1 tok2 tok3")], "doc_id long, text string"), spark.createDataFrame([("a", "tok1 tok2 tok3"), ("b", "end")], "item_id string, text string"))
    assert sorted((r["doc_id"], r["n_hit"], r["n_near"]) for r in near.collect()) == [(1, 1, 2), (2, 0, 0), (3, 3, 1)]
    for a, b in ((odd.limit(0), items), (odd, items.limit(0))):
        assert phrases.decontaminate(a, b).where("n_hit > 0").count() == 0


def test_urls_take_odd_rows(spark):
    urls_ = [None, "", "no scheme", "http://A.Com/en/1", "https://example.com/en/71?x=1", "x://net/de/", "http://sub.example.net/de/8#f", "http://example.org", "http://notcom/en/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls_)], "page_id long, url string, host int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = [tuple(r)[1:5] for r in urls.judge(pages, labels).orderBy("page_id").collect()]
    none = ("", "", None, "allow")
    assert got == [none, none, none, ("a.com", "/en/1", "com/en/", "block"), ("example.com", "/en/71", "example.com/en/7", "allow"), ("net", "/de/", "net/de/", "allow"), ("sub.example.net", "/de/8", "example.net/de/8", "block"), ("example.org", "", None, "allow"), ("notcom", "/en/", None, "allow")]


def test_mined_url_rules(spark):
    """All combinations of tokens, counted one by one, against FP-growth, pruning and the index; labels made up by host and path."""
    rng = random.Random(11)
    rows = []
    for i in range(240):
        host = rng.choice(["good.example.edu", "spam.example.info", "mixed.example.info"])
        section = rng.choice(["news", "deals"])
        rows.append((i, f"https://{host}/{section}/{i}?{rng.choice(['a', 'b'])}=1", host.startswith("spam") or (host.startswith("mixed") and section == "deals")))
    pages = spark.createDataFrame([r[:2] for r in rows] + [(3, rows[3][1]), (None, rows[4][1]), (500, None)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if bad else 1) for i, _, bad in rows if i % 2], "doc_id long, quality int")
    got = urls.judge(pages, labels, min_support=0.01, min_confidence=0.9, min_count=5)
    assert Counter(r["verdict"] for r in got.where("page_id < 240").dropDuplicates(["page_id"]).collect()) == Counter("block" if bad else "allow" for _, _, bad in rows)
    assert got.count() == 243 and got.where("page_id = 3").select("verdict").distinct().count() == 1
    base = pages.limit(240).select("page_id", "url").withColumns({"host": urls.host_of(F.col("url")), "path": urls.path_of(F.col("url"))})
    tokens = {r[0]: frozenset(r[1]) for r in base.select("page_id", urls.url_tokens(F.col("url"), F.col("host"), F.col("path"))).collect()}
    learned = [(tokens[i], bad) for i, _, bad in rows if i % 2]
    rules = urls.mine_rules(spark.createDataFrame([(sorted(t), bad) for t, bad in learned], "tokens array<string>, bad boolean"), 0.01, 0.9, 5)
    seen = {frozenset(r["antecedent"]): (r["confidence"], r["lift"]) for r in rules.collect()}
    share = sum(bad for _, bad in learned) / len(learned)
    every = {frozenset(c) for t, _ in learned for n in range(1, len(t) + 1) for c in combinations(sorted(t), n)}
    strong = {}
    for c in every:
        own = [bad for t, bad in learned if c <= t]
        if sum(own) >= 5 and sum(own) / len(own) >= 0.9 and sum(own) / len(own) >= 1.2 * share:
            strong[c] = (sum(own) / len(own), sum(own) / len(own) / share)
    want = {c: v for c, v in strong.items() if not any(d < c for d in strong)}
    assert seen.keys() == want.keys() and all(seen[c] == pytest.approx(want[c]) for c in want)


def test_letters_decide_what_has_a_language(spark):
    texts = ["½ ² ①", "一", "ª", "_1", "é", "\u0301"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    assert [got[i] == "und" for i in range(6)] == [not any(c.isalpha() for c in t) for t in texts]


def test_pipeline(spark, tables):
    docs, rows = tables[0]
    text = dict(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r[0] for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, DATA).checkpoint()
        kept = {r[0] for r in docs.select("doc_id").collect()}
        gone = before - kept
        assert len(kept) == docs.count() and kept <= before
        if name == "language":
            assert all(d in gone for d in before if not any(c.isalpha() for c in text[d] or "")) and len(kept) > 0.9 * len(before)
        if name == "exact_dedup":
            bodies = [re.sub(r"[\x20\x09-\x0D]", "", text[d]) for d in kept]
            assert len(set(bodies)) == len(bodies) == len({re.sub(r"[\x20\x09-\x0D]", "", text[d]) for d in before})
        if name == "near_dedup":
            assert kept == {min(c) for c in brute_classes([(d, text[d]) for d in before])}
        if name == "decontamination":
            judged = phrases.decontaminate(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet"))
            assert gone == {r[0] for r in judged.where("contaminated").select("doc_id").collect()} & before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert set(packed["doc_id"]) == kept
    assert isinstance(packed, pd.DataFrame) and corpus_pipeline.ORACLE_SQL is None
    odd = tables[1][0]
    for _, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, DATA).checkpoint()
    assert odd.count() > 0
