"""Rows that near-duplicate search makes and shuffles."""

import random
from collections import Counter

from pyspark.sql import functions as F

from dyadflow.llm import bags


def test_few_rows_pass_the_bitmap(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    chosen = rows.where("id % 400 = 0")
    got = Counter(r.id for r in bags.perhaps_in(rows, chosen, "h").collect())
    assert max(got.values()) == 1 and {i for i in range(0, 20_000, 400)} <= got.keys() and len(got) < 60
    assert bags.perhaps_in(rows, chosen.limit(0), "h").count() == 0


def test_nodes_become_a_row_for_each_cell_of_their_star(spark):
    """Cells in which a star has no node are known before its nodes are multiplied."""
    stars = [(bytes([i]), b"l", 100 + 15 * (i % 2), 100, 80, False, list(range(30)), bytes([i]), b"l") for i in range(1, 9)]
    made = spark.createDataFrame(stars, "a binary, b binary, n_a long, n_b long, both long, same boolean, rest array<long>, label_a binary, label_b binary")
    buckets = bags.next_buckets(made, 0.8)
    assert "explode(sequence(" not in buckets._jdf.queryExecution().optimizedPlan().toString()
    sizes = Counter(r.n for r in buckets.groupBy("key").agg(F.count("*").alias("n")).collect())
    assert sizes == {8: 1, 4: 2}


def test_shingles_of_one_component_do_not_become_rows(spark):
    """What two components of a star hold stays, wherever its holders are dealt; of all else hardly anything does."""
    rng, rows = random.Random(3), []  # about 31,500 shingles
    for i in range(300):
        star, label = rng.choice((b"l", b"m")), rng.choice((0, i + 1))
        own = [i * 1000 + j for j in range(60)]
        rows.append((bytes([i // 256, i % 256]), star, [*own, *rng.sample(range(-500, 0), 5), *range(-2000 - 40 * label, -1960 - 40 * label)], b"%d" % label if label else star, star))
    stars = spark.createDataFrame(rows, "a binary, b binary, rest array<long>, label_a binary, label_b binary").repartition(5)
    holders = {}
    for _, star, rest, label, _ in rows:
        for one in rest:
            holders.setdefault((bytes(star), one), set()).add(label)
    want = {(a, s): {x for x in rest if len(holders[s, x]) > 1} for a, s, rest, *_ in rows}
    for most in (10, 10**6):
        got = {(bytes(r.a), bytes(r.b)): set(r.rest) for r in bags.perhaps_shared(stars, most).collect()}
        assert got.keys() == want.keys() and all(want[k] <= got[k] for k in want)
        assert sum(map(len, got.values())) < sum(map(len, want.values())) + 100
    assert bags.perhaps_shared(stars.limit(0)).count() == 0
