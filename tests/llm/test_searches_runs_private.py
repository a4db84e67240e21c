"""Hard negatives, periodic runs and personal data against plain Python, over the smallest tables and over odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadflow.llm import negatives, periods, private, registry

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, found string, spans int, runs string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Periodic runs


def runs_of(w, least=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                out.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def run_row(doc, text, planted=True):
    w = words_of(text)
    n = len(w)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_of(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    start, length, q = best
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    return doc, len(runs), start, length, q, None if q is None else 1000 * length // q, sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in gone)), n


def fibonacci(n):
    a, b = "a", "a b"
    while len(b) < 2 * n:
        a, b = b, b + " " + a
    return b[: 2 * n]


def odd_texts():
    rnd = random.Random(1)
    out = [None, "", " \t\r\n\x0b\x0c", "one", "a " * 13, "a b " * 6, "a b " * 5 + "a", "x " + "a b c " * 9 + "d", fibonacci(300), "é\x1cé " * 20, "w w " * 12, "a " * 3000, "\n".join(["one line that repeats"] * 7), "Deux mots, " * 40 + "fin " * 20]
    for _ in range(60):
        w = [rnd.choice("ab" if rnd.random() < 0.5 else "abc") for _ in range(rnd.randrange(120))]
        out.append(" ".join(w))
        p = rnd.randrange(1, 40)
        out.append(" ".join([f"t{rnd.randrange(50)}" for _ in range(p)] * rnd.randrange(1, 6)))
    return out


def test_runs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    odd = [*enumerate(odd_texts()), (None, "a b " * 30), (4, "a " * 13), (4, "a " * 13)]
    for rows, table in ((given, docs), (odd, spark.createDataFrame([(*r, "x", 1, "y") for r in odd], SCHEMA).repartition(3)), ([], spark.createDataFrame([], SCHEMA))):
        assert rows_of(periods.digests(periods.periodic_runs(periods.with_planted_tails(table)))) == sorted((run_row(*r) for r in rows), key=repr)
        plain = rows_of(periods.digests(periods.periodic_runs(table)))
        assert plain == sorted((run_row(*r, planted=False) for r in rows), key=repr)
    assert sum(run_row(*r)[1] for r in given) > 5


@pytest.mark.parametrize("step", [1, 3, 10**9])
@pytest.mark.parametrize("least", [2, 12, 30])
def test_catchers_give_the_same_runs_for_every_slicing(step, least):
    rnd = random.Random(step)
    for text in odd_texts():
        w = words_of(text)[: 400 if step > 1 else 120]
        number = {}
        ids = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
        catch = periods.SquareCatchers(least)
        for at in range(0, len(ids), step):
            catch.append(ids[at : at + step])
            if rnd.random() < 0.01:
                assert catch.runs() == runs_of(w[: at + step], least)
        assert catch.runs() == runs_of(w, least)


def test_long_texts_and_small_streams():
    texts = [b"a " * 200_000, b"", b" ".join(b"%d" % (i * i % 7) for i in range(100_000)), "ü ".encode() * 40]
    for stream in (10, periods.STREAM):
        assert [(n, r) for n, r, _ in periods.documents_runs(texts, stream=stream)] == [(200_000, [(0, 200_000, 1)]), (0, []), (100_000, [(0, 100_000, 7)]), (40, [(0, 40, 1)])]


# Personal data


def plain_of(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(d[0::2] + [x for y in d[1::2] for x in divmod(2 * y, 10)]) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def test_plain_finds_on_random_texts():
    rnd = random.Random(3)
    for _ in range(4000):
        text = "".join(rnd.choice("ab1234.@@.-+ ()0é４") for _ in range(rnd.randrange(60)))
        assert private.plain_spans(text) == plain_of(text)
        assert [s[:3] for s in private.private_spans(text) if s[3]] == plain_of(text)


DISGUISES = [
    ("write to jane [at] example [dot] com now", [("email", "jane [at] example [dot] com")]),
    ("jane dot doe at mail dot example dot org.", [("email", "jane dot doe at mail dot example dot org")]),
    ("jаne@exаmple.com", [("email", "jаne@exаmple.com")]),
    ("😀 jane＠example．com", [("email", "jane＠example．com")]),
    ("jane@exam​ple.com", [("email", "jane@exam​ple.com")]),
    ("ja​ne(a​t)example{d​ot}com", [("email", "ja​ne(a​t)example{d​ot}com")]),
    ("jane @ example.com", [("email", "jane @ example.com")]),
    ("juan arroba ejemplo punto es", [("email", "juan arroba ejemplo punto es")]),
    ("card 4111 1111 1111 ll11 ok", [("card", "4111 1111 1111 ll11")]),
    ("four one one one one one one one one one one one one one one one", [("card", "four one one one one one one one one one one one one one one one")]),
    ("one nine two dot one six eight dot zero dot one two.", [("ip", "one nine two dot one six eight dot zero dot one two")]),
    ("plus one four five six five five five five zero five eight", [("phone", "plus one four five six five five five five zero five eight")]),
    ("+1 (456) five five five, five zero five eight thanks", [("phone", "+1 (456) five five five, five zero five eight")]),
    ("plus double four two oh seven nine four six oh nine five eight", [("phone", "plus double four two oh seven nine four six oh nine five eight")]),
    ("más tres cuatro nueve uno dos tres cuatro cinco seis", [("phone", "más tres cuatro nueve uno dos tres cuatro cinco seis")]),
    ("+٤٩ ١٢٣٤٥٦٧٨٩", [("phone", "+٤٩ ١٢٣٤٥٦٧٨٩")]),
    *[(clean, []) for clean in ("we arrive at example.com soon", "meet at noon. dot com bubble", "look at the dot com era", "one two three go", "uno dos tres", "почта@пример.рф", "un deux trois quatre cinq six sept huit neuf", "[at] (dot) @ .", "10l0 O0 I1")],
]


@pytest.mark.parametrize(("text", "found"), DISGUISES)
def test_disguised(text, found):
    spans = private.private_spans(text)
    assert [(kind, text[a:b]) for kind, a, b, _ in spans] == found
    assert not any(plain for *_, plain in spans)
    assert len(private.masked(text, spans)) == len(text) + sum(len(k) + 2 - len(x) for k, x in found)


def private_row(doc, text):
    text = text or ""
    plain = plain_of(text)
    said = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (doc, *[sum(s[0] == k for s in plain) for k in private.KINDS], sha(said(plain)))


def test_private_of_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    long = "word " * 4000 + "a@b.c " + "4111111111111111 " * 3
    odd = [*enumerate([None, "", " ", long, "1" * 2000, "a" * 2000, "é@é.é", *[t for t, _ in DISGUISES]]), (None, "a@b.c"), (1, "+1 234 567 89"), (1, "+1 234 567 89")]
    for rows, table in ((given, docs), (odd, spark.createDataFrame([(*r, "x", 1, "y") for r in odd], SCHEMA).repartition(3)), ([], spark.createDataFrame([], SCHEMA))):
        made = private.digests(private.find_private(table))
        assert rows_of(made.drop("spans", "n_added")) == sorted((private_row(*r) for r in rows), key=repr)
        texts = {(r.doc_id, r.masked) for r in private.find_private(table, with_text=True).collect()}
        assert texts == {(i, private.masked(t or "", private.private_spans(t or ""))) for i, t in rows}
    # nothing is added to the given texts, which hold no disguise
    assert private.digests(private.find_private(docs)).where("n_added > 0").count() == 0


# Hard negatives


def negatives_of(rows, k=5):
    """rows (id, label, vec), ids not null."""
    dims = max((len(v) for _, _, v in rows), default=0)
    v = [[*map(int, x), *[0] * (dims - len(x))] for _, _, x in rows]
    out = []
    for i, (a, label, _) in enumerate(rows):
        if a is None or a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v[i], v[j], strict=True)), 2**63 - 1 if b is None else b, other == label, b) for j, (b, other, _) in enumerate(rows))
        for s, _, same, b in [x for x in scored if x[2] and x[3] != a][:k]:
            fits = [(n, nid) for n, _, own, nid in scored if not own and 80 * -s <= 100 * -n <= 100 * -s][:k]
            out += [(a, b, r + 1, nid, -s, -n) for r, (n, nid) in enumerate(fits)]
    return sorted(out, key=repr)


def vectors(n, dims, rnd, copies=0):
    base = [[rnd.gauss(0, 40) for _ in range(dims)] for _ in range(12)]
    out = [(i, rnd.choice([0, 0, 0, 1, 2, 3]), [math.floor(x + rnd.gauss(0, 25)) for x in rnd.choice(base)]) for i in range(n)]
    return out + [(n + i, i % 2, out[0][2]) for i in range(copies)]


@pytest.mark.parametrize(("tile_rows", "leaf_rows", "sample"), [(2048, 128, 16_384), (40, 4, 16_384), (16, 3, 30)])
def test_negatives_are_exact(spark, tile_rows, leaf_rows, sample):
    rows = vectors(700, 6, random.Random(tile_rows), copies=90) + [(None, 1, [5, 5]), (None, 0, [300] * 6), (901, 1, []), (200, 3, [40] * 6)]
    points = spark.createDataFrame(rows, "id long, label long, vec array<long>").repartition(3)
    found = negatives.hard_negatives(points, F.col("id") % 100 == 0, tile_rows=tile_rows, leaf_rows=leaf_rows, sample=sample)
    assert rows_of(found) == negatives_of(rows)


def test_tiles_and_boxes(spark):
    rows = vectors(3000, 8, random.Random(7), copies=1500)
    points = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row long, id long, label long, vec array<long>")
    tree = negatives.packed(points, tile_rows=100, leaf_rows=10, sample=1000).collect()
    assert sum(t.n for t in tree) == len(rows) and max(t.n for t in tree) <= 400
    for t in tree:
        tile = negatives.Tile(t)
        q = np.array([[3.0, -2, 5, 0, 1, 1, -7, 2], [0.0] * 8])
        least, most = negatives.bounds(tile.low, tile.high, q)
        for leaf in range(tile.n_leaves):
            scores = np.stack([tile.scores(leaf, x.astype(np.int64)) for x in q])
            assert (scores <= most[:, leaf][:, None]).all() and (scores >= least[:, leaf][:, None]).all()
        assert t.label_low == t.label_high or t.n <= 100


def test_boxes_are_left_out():
    """Of two far heaps a search of one reads no leaf of the other."""
    rnd = np.random.default_rng(1)
    v = np.concatenate([rnd.integers(90, 110, (300, 4)), rnd.integers(-110, -90, (300, 4))])
    rows = negatives.pd.DataFrame({"id": np.arange(600), "label": 0, "vec": list(v)})
    tile = negatives.Tile(next(negatives.packed_tile(10)((0, 0), rows).itertuples(index=False)))
    read = []
    scores, tile.scores = tile.scores, lambda leaf, q: read.append(leaf) or scores(leaf, q)
    query = negatives.pd.DataFrame({"q": [0], "id": [-1], "label": [0], "same": [True], "vec": [np.array([100] * 4)], "low": [[negatives.LOWEST]], "high": [[negatives.HIGHEST]], "kth": [[negatives.LOWEST]]})
    assert len(negatives.search_tile(tile, query, 5)) == 5
    assert len(read) < tile.n_leaves / 3


def test_rows_that_take_no_part_and_large_numbers(spark):
    schema = "vec_id long, embedding array<double>, label int, row string, tile string"
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, None], 1), (2, [float("nan"), 1.0], 1), (3, [float("inf"), 0.0], 2), (4, None, 1), (5, [1.0, 1.9], None), (6, [0.9, 2.0], 1), (8, [1.0, 2.0], 2), (9, [1e30, 1e30], 3), (100, [1e30, 1.0], 3), (7, [0.99, 2.0], 0), (14, [1.0, 2.0], 9)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    points = [tuple(r) for r in negatives.contract_points(table).collect()]
    assert {p[0] for p in points} == {0, 6, 8, 9, 100, 7, 14} and dict((p[0], p[1]) for p in points)[14] == 0
    found = rows_of(negatives.contract_negatives(table))
    small = [r for r in negatives_of([p for p in points if p[0] not in (9, 100)])]
    assert [r for r in found if r[0] == 0] and [r for r in found if r[0] == 0 and 9 not in r and 100 not in r] == [r for r in small if r[0] == 0]
    assert rows_of(negatives.contract_negatives(spark.createDataFrame([], schema))) == []


def test_registered():
    assert {"op11_hard_negatives", "op12_periodic_runs", "op13_private_data"} <= set(registry.queries())


# Mining of url rules (its other tests are in test_brute_force.py)


def mined(spark, rows, *bounds, **more):
    from dyadflow.llm import urls

    return {tuple(r.antecedent): (round(r.confidence, 9), round(r.support, 9)) for r in urls.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), *bounds, **more).collect()}


def test_deep_shared_paths_are_one_item(spark):
    """Forty pages of thirty shared segments: every subset of the segments is frequent, and says the same."""
    deep = [f"p:segment{i}" for i in range(30)]
    rows = [([*deep, f"q:{i % 7}"], i % 10 != 0) for i in range(40)] + [(["h:other", f"q:{i % 7}"], False) for i in range(60)]
    assert mined(spark, rows, 0.01, 0.7, 10) == {(s,): (0.9, 0.36) for s in deep}
    # all rows share the path: it tells nothing
    assert mined(spark, [(deep, i % 2 == 0) for i in range(40)], 0.01, 0.4, 5) == {}
    assert mined(spark, [], 0.01, 0.4, 5) == {}


def test_wide_rows_are_mined_up_to_pairs(spark):
    """Each row lacks one of forty segments, so no two segments are in the same rows: pairs are as far as it goes."""
    segments = [f"p:{i:02d}" for i in range(40)]
    rows = [([x for j, x in enumerate(segments) if j != i % 40], i % 3 != 0) for i in range(160)] + [(["h:bad", "h:pair", *segments[:3]], True)] * 20 + [(["h:pair", "h:odd"], False)] * 20
    got = mined(spark, rows, 0.01, 0.9, 10, widest=14)
    sets = [(frozenset(t), bad) for t, bad in rows]
    n, bad_share = len(rows), sum(b for _, b in sets) / len(rows)
    want = {}
    for a in range(len(segments) + 3):
        for pair in {("h:bad", "h:pair", "h:odd", *segments)[a]} and [(("h:bad", "h:pair", "h:odd", *segments)[a],)] + [tuple(sorted((("h:bad", "h:pair", "h:odd", *segments)[a], x))) for x in segments]:
            own = [b for t, b in sets if set(pair) <= t]
            if len(set(pair)) == len(pair) and sum(own) >= 10 and sum(own) / len(own) >= 0.9 and sum(own) / len(own) / bad_share >= 1.2:
                want[pair] = (round(sum(own) / len(own), 9), round(sum(own) / n, 9))
    general = {r for r in want if not any(set(o) < set(r) for o in want)}
    assert {r: v for r, v in got.items() if "h:pair" not in r or len(r) == 1} == {r: want[r] for r in general if "h:pair" not in r or len(r) == 1}
    assert ("h:bad",) in got
