"""Near-duplicate groups by BagMinHash over multisets of word shingles.

Each document is a bag of shingles (five words; a shorter text is one shingle). A shingle of weight w owns the part [0, w) of
a line that is cut at the powers of two; on each part runs a Poisson process in time whose points have a place, found by
halving the part, and a register. A register keeps the earliest point that falls below the weight, so that two bags agree in
a register with the probability of their weighted Jaccard similarity. Processes are followed in order of time and left once
their time is past the latest register.

Registers are cut into bands. Texts of equal words are one node, and nodes with an equal band stand in one bucket. A bucket's
pairs are never listed: its nodes meet its leader, and those that stay apart from the leader go into smaller buckets, which
hold every pair that can still be similar (see near_links and next_buckets). Comparisons are exact: overlap of the bags at
`similarity` or more. Classes are connected components.

Words are those of `phrases`: A-Z lower-cased, ASCII other than letters and digits parts them.

Defined results: a text without a word, null too, is alone in its class; null ids come last in the choice of the kept row
and stay null; repeated rows get a row each with equal class and size, and exactly one row of a class is kept, whichever ids its
rows share; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.llm.common import id_or_last, id_or_null, written
from dyadflow.llm.repeats import Units, Windows, joined, word_hashes

U = np.uint64
STEP, FIRST, SECOND = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Bytes of text whose signatures are made at a time.
AT_ONCE = 1_000_000
#: Rows of two digests that one task takes.
FEW_ROWS = 250_000
#: Ratio of the sizes that bound a cell of sizes.
CELL = 1.02
#: Shingles outside leaders whose places are marked at a time.
MARKED = 1_000_000
#: Bits of the filter that rows pass before they are shuffled to a chosen few (4 MB), and bits of one of its rows, which Spark fixes.
FILTER_BITS, BITMAP_BITS = 1 << 25, 1 << 15


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * FIRST
    x = (x ^ (x >> U(27))) * SECOND
    return x ^ (x >> U(31))


def bags(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, weight) of all texts, ordered by text and hash; every text has a word."""
    units = Units(texts, Windows("word", shingle, 1))
    words = word_hashes(units.data, units.starts, units.ends, 0)
    starts = np.flatnonzero(units.window_starts())
    of = np.searchsorted(units.first, starts, side="right") - 1
    hashes = joined(words, shingle, 0)[starts] if len(starts) else np.empty(0, U)
    short = np.flatnonzero(units.last - units.first < shingle)
    whole = np.array([joined(words[units.first[i] : units.last[i]], int(units.last[i] - units.first[i]), 0)[0] for i in short], U)
    of, hashes = np.concatenate([of, short]), np.concatenate([hashes, whole])
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    edge = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])])) if len(of) else np.empty(0, np.int64)
    return of[edge], hashes[edge], np.diff(np.append(edge, len(of)))


def bag_minhash(of: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Registers (n x registers) of n bags given as rows (bag, element, weight)."""
    parts = []
    low, level = 0, 0
    while len(own := np.flatnonzero(weight > low)):
        high = max(1, 2 * low)
        parts.append((of[own], scramble(element[own] + np.array([level], U) * STEP), weight[own], np.full(len(own), low), np.full(len(own), high - low)))
        low, level = high, level + 1
    earliest = np.full(n * registers, np.inf)
    if not parts:
        return earliest.reshape(n, registers)
    bag, seed, top, low, span = (np.concatenate(x) for x in zip(*parts, strict=True))
    time = np.zeros(len(bag))
    latest = np.full(n, np.inf)
    point = 0
    while len(bag):
        point += 1
        r = scramble(seed + np.array([point], U) * STEP)
        time = time - np.log(((r >> U(11)).astype(float) + 1) * 2.0**-53) / span
        stay = time <= latest[bag]
        bag, seed, top, low, span, time, r = (x[stay] for x in (bag, seed, top, low, span, time, r))
        r = scramble(r ^ SECOND)
        register = ((r >> U(32)) * U(registers) >> U(32)).astype(np.int64)
        # the high bits of the rest choose a half of the part, a half of that, and so on
        place = low + ((r & U(0xFFFFFFFF)) * span.astype(U) >> U(32)).astype(np.int64)
        below = place < top
        np.minimum.at(earliest, (bag * registers + register)[below], time[below])
        open_bags = np.unique(bag)
        latest[open_bags] = earliest.reshape(n, registers)[open_bags].max(axis=1)
    return earliest.reshape(n, registers)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A signed 64-bit key for each band, different from band to band."""
    cut = signature.view(U).reshape(len(signature), bands, -1)
    key = np.broadcast_to(scramble(np.arange(1, bands + 1, dtype=U) * STEP), cut.shape[:2]).copy()
    for i in range(cut.shape[2]):
        key = scramble(key * FIRST + cut[:, :, i])
    return key.view(np.int64)


#: What each byte becomes: A-Z in lower case, other letters, digits and bytes beyond ASCII as they are, all else a space.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SIGNED = "id long, h long, row long, digest binary, bands array<long>"


def word_text(text: str) -> bytes:
    """The words of a text with one space between them."""
    return b" ".join(text.encode("utf-8", "replace").translate(FOLDED).split())


def sign(shingle: int, bands: int, rows: int):
    """mapInPandas: (id, h, row, text) to (id, h, row, digest, bands); a text without a word has no digest and no bands."""

    def made(ids: list, hashes: list, numbers: list, texts: list[bytes]) -> pd.DataFrame:
        some = [i for i, t in enumerate(texts) if t]
        of, element, weight = bags([texts[i] for i in some], shingle)
        keys = iter(band_keys(bag_minhash(of, element, weight, len(some), bands * rows), bands)) if some else iter(())
        signed = [(hashlib.md5(t).digest(), next(keys)) if t else (None, np.empty(0, np.int64)) for t in texts]
        return pd.DataFrame({"id": ids, "h": hashes, "row": numbers, "digest": [x[0] for x in signed], "bands": [x[1] for x in signed]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, texts in slices(zip(batch["id"].tolist(), batch["h"].tolist(), batch["row"].tolist(), strict=True), batch["text"]):
                yield made(*map(list, zip(*keys, strict=True)), [word_text(t) for t in texts])

    return run


def stored(shingle: int):
    """mapInPandas: (digest, text) to (digest, n, hashes, weights), the bag of a text; no weights where all are 1."""

    def made(digests: list, texts: list[bytes]) -> pd.DataFrame:
        of, element, weight = bags(texts, shingle)
        edges = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
        own = [(element[a:b], weight[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        rows = [(d, int(w.sum()), h.astype("<u8").tobytes(), b"" if w.max() == 1 else w.astype("<u4").tobytes()) for d, (h, w) in zip(digests, own, strict=True)]
        return pd.DataFrame(rows, columns=["digest", "n", "hashes", "weights"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for digests, texts in slices(batch["digest"], batch["text"]):
                yield made(digests, [word_text(t) for t in texts])

    return run


def slices(keys: Iterable, texts: Iterable[str]) -> Iterator[tuple[list, list[str]]]:
    """Rows of a batch, about AT_ONCE letters at a time."""
    own, some, size = [], [], 0
    for key, text in zip(keys, texts, strict=True):
        own.append(key)
        some.append(text)
        size += len(text)
        if size > AT_ONCE:
            yield own, some
            own, some, size = [], [], 0
    if own:
        yield own, some


def unpacked(hashes: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(hashes, "<u8")
    return h, np.frombuffer(weights, "<u4").astype(np.int64) if weights else np.ones(len(h), np.int64)


def common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, np.ndarray]:
    """(size of the common part of two bags, what of a's weights lies outside b); a bag is (sorted hashes, weights)."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    inside = np.where(b[0][at] == a[0], np.minimum(b[1][at], a[1]), 0)
    return int(inside.sum()), a[1] - inside


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    both = common(a, b)[0]
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def outside(a: tuple[np.ndarray, np.ndarray], rest: np.ndarray) -> np.ndarray:
    """All of a's shingles that its partner lacks; copies count as different ones."""
    own = np.flatnonzero(rest)
    copies = np.repeat(a[0][own], rest[own])
    again = np.arange(len(copies)) - np.repeat(np.cumsum(rest[own]) - rest[own], rest[own])
    return np.where(again > 0, scramble(copies + again.astype(U) * STEP), copies).view(np.int64)


MET = "a binary, b binary, n_a long, n_b long, both long, same boolean, rest array<long>"


def met(similarity: float, with_rest: bool = False):
    """mapInPandas: bags of pairs (a, b) to MET: sizes, the common part, whether the two are similar; with_rest, a's shingles outside b."""
    nothing = np.empty(0, np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known, bag, rows = None, None, []
            for a, b, *packed in batch[["a", "b", "hashes_a", "weights_a", "hashes_b", "weights_b"]].itertuples(index=False):
                if b != known:
                    known, bag = b, unpacked(*packed[2:])
                one = unpacked(*packed[:2])
                both, rest = common(one, bag)
                n_a, n_b = int(one[1].sum()), int(bag[1].sum())
                rows.append((a, b, n_a, n_b, both, both >= similarity * (n_a + n_b - both), outside(one, rest) if with_rest else nothing))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MET.split(", ")])

    return run


@contextmanager
def small_batches(spark: SparkSession, rows: int = 200) -> Iterator[None]:
    """Within this, Arrow batches have so many rows at most: rows with two bags are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def gathered(df: DataFrame, n: int) -> DataFrame:
    """A table of at most n rows in partitions of about FEW_ROWS; in a single one, joins and groups of it need no shuffle."""
    return df.coalesce(n // FEW_ROWS + 1)


def perhaps_in(df: DataFrame, chosen: DataFrame, hash_col: str) -> DataFrame:
    """The rows of df whose 64-bit hash can be one of chosen's, by a bitmap of a fixed size: few others are left, and none of chosen's is lost."""
    at = lambda df: F.pmod(F.col(hash_col), F.lit(FILTER_BITS))
    placed = chosen.select(at(chosen).alias("at"))
    bits = placed.groupBy(F.floor(F.col("at") / BITMAP_BITS).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP_BITS).alias("bits"))
    asked = df.withColumn("_at", at(df)).join(F.broadcast(bits), F.floor(F.col("_at") / BITMAP_BITS) == F.col("part"))
    byte = F.conv(F.hex(F.substring("bits", ((F.col("_at") % BITMAP_BITS) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return asked.where(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1).select(df.columns)


def places(leaders: Iterable[bytes], rest: list[np.ndarray]) -> np.ndarray:
    """The filter's bits for all shingles in rest, each under its star's leader."""
    star = scramble(np.frombuffer(b"".join((bytes(b) + bytes(8))[:8] for b in leaders), "<u8") + STEP)
    return (scramble(np.concatenate(rest).view(U) ^ np.repeat(star, [len(r) for r in rest])) % U(FILTER_BITS)).astype(np.int64)


def bits_of(at: np.ndarray, parts: np.ndarray) -> list[bytes]:
    """The rows `parts` of a filter in which the bits `at` are set."""
    out = np.zeros((len(parts), BITMAP_BITS), bool)
    out[np.searchsorted(parts, at // BITMAP_BITS), at % BITMAP_BITS] = True
    return [row.tobytes() for row in np.packbits(out, axis=1, bitorder="little")]


MARKS = "part long, once binary, twice binary, linked binary"


def marks(most: int):
    """mapInPandas: (b, label_a, label_b, rest) to MARKS: bits of shingles that one component beside the leader's holds, that several hold, and that the leader's holds."""

    def made(at: list, labels: list, linked: list) -> pd.DataFrame:
        at, label, linked = (np.concatenate(x) for x in (at, labels, linked))
        parts = np.unique(at // BITMAP_BITS)
        apart = np.unique(np.stack([at[~linked], label[~linked]]), axis=1)[0]
        once, n = np.unique(apart, return_counts=True)
        return pd.DataFrame({"part": parts, "once": bits_of(once, parts), "twice": bits_of(once[n > 1], parts), "linked": bits_of(at[linked], parts)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, size, number = [], 0, {}
        for batch in batches:
            rest, n = batch["rest"].tolist(), batch["rest"].map(len)
            label = [number.setdefault(bytes(x), len(number)) for x in batch["label_a"]]
            own.append((places(batch["b"], rest), np.repeat(label, n), np.repeat((batch["label_a"] == batch["label_b"]).to_numpy(), n)))
            size += int(n.sum())
            if size > most:
                yield made(*zip(*own, strict=True))
                own, size, number = [], 0, {}
        if size:
            yield made(*zip(*own, strict=True))

    return run


def merged(rows: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas: the MARKS of a part to (part, bits), the bits that shingles of two components have set."""
    once, shared, linked = (np.zeros(BITMAP_BITS // 8, np.uint8) for _ in range(3))
    for row in rows.itertuples(index=False):
        own = np.frombuffer(row.once, np.uint8)
        shared |= np.frombuffer(row.twice, np.uint8) | (once & own)
        once |= own
        linked |= np.frombuffer(row.linked, np.uint8)
    return pd.DataFrame({"part": rows["part"].iloc[:1], "bits": [(shared | (once & linked)).tobytes()]})


def perhaps_shared(stars: DataFrame, most: int = MARKED) -> DataFrame:
    """Stars with those shingles of `rest` alone that two components of the star can hold, by a bitmap of a fixed size: none that two hold is lost.

    Most shingles outside a leader are one text's own. They are marked and left out while they still are arrays: as rows, they
    would be shuffled twice only to be found alone.
    """
    spark = stars.sparkSession
    bits = np.zeros((FILTER_BITS // BITMAP_BITS, BITMAP_BITS // 8), np.uint8)
    for part, own in stars.select("b", "label_a", "label_b", "rest").mapInPandas(marks(most), MARKS).groupBy("part").applyInPandas(merged, "part long, bits binary").collect():
        bits[part] = np.frombuffer(own, np.uint8)
    sent = spark.sparkContext.broadcast(bits.ravel())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rest = batch["rest"].tolist()
            at = places(batch["b"], rest)
            stay = np.split(sent.value[at >> 3] >> (at & 7) & 1 == 1, np.cumsum([len(r) for r in rest])[:-1])
            yield batch.assign(rest=[r[s] for r, s in zip(rest, stay, strict=True)])

    out = written(stars.mapInPandas(run, stars.schema))
    sent.destroy()
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): the smallest node of the component, by smallest neighbours and jumps."""
    n = edges.count()
    both = gathered(written(gathered(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), n).distinct()), n)
    labels = gathered(written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label"))), n)
    while True:
        # the label of the row before (`old`) comes along, so that a round is one written table and one count of it
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("binary").alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        least = gathered(near.unionByName(own), n).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = gathered(written(least.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old")), n)
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")


def linked(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """(node, label) of components after further links (a, b): only the components that they join are worked on."""
    if links.isEmpty():
        return labels
    edges = written(with_label(with_label(links, labels, "a", "label_a"), labels, "b", "label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).where("a <> b").distinct())
    if edges.isEmpty():
        return labels
    joined = components(edges)
    if labels is None:
        return joined
    moved = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    fresh = joined.join(labels.select("node"), "node", "left_anti").select("node", "label")
    out = written(moved.unionByName(fresh))
    return gathered(out, out.count())


def with_label(rows: DataFrame, labels: DataFrame | None, node: str, name: str) -> DataFrame:
    """Rows with the label of a node's component; a node without a link is its own."""
    if labels is None:
        return rows.withColumn(name, F.col(node))
    named = labels.select(F.col("node").alias(node), F.col("label").alias(name))
    return rows.join(named, node, "left").withColumn(name, F.coalesce(name, node))


def differing(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs (a, b) of nodes in different components."""
    return with_label(with_label(pairs, labels, "a", "label_a"), labels, "b", "label_b").where("label_a <> label_b").select("a", "b")


def leaders(buckets: DataFrame, n: int) -> DataFrame:
    """Each node of n rows of buckets (key, node) with each leader of its buckets: (a, b, order), those with much company first.

    A bucket's leader is the node with the most company in all its buckets: the text that the others are edits of, if it is there.
    """
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = gathered(written(buckets.join(sizes, "key")), n)
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    best = members.join(company, "node").groupBy("key").agg(F.min(F.struct((-F.col("company")).alias("order"), F.col("node").alias("leader"))).alias("best"))
    led = members.select("key", "node").join(best.select("key", "best.leader", "best.order"), "key")
    return gathered(written(led.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"), "order").distinct()), n)


def next_buckets(stars: DataFrame, similarity: float) -> DataFrame:
    """Buckets (key, node) in which nodes of a star can still meet a similar one of another component.

    Let x and y have met the leader l, x the smaller one. They are similar only if they share s / (1 + s) * (x + y), which
    needs x to be of s * y or more. What they share lies in l, at most min(x & l, y & l) of it, or outside l. So either
    that much of both lies in l, and they meet in the bucket of small ones; or they share what lacks outside l, their need.
    Then, in an order of shingles that is the same for all nodes, the first that they share outside l is followed by
    need - 1 more, and they meet in the bucket of that shingle. Shingles that one component alone holds link nobody and do
    not count; the rarest in the star come first, so that a passage that many hold does not bring them together once more.

    The need follows from both sizes, so buckets are cut by the size of the smaller one, in cells of 2 %: x stands in the
    cell of its own size, y in all from s * y to y that some node of the star has. A bucket without a node that can be the
    smaller one is left out, and a bucket never holds l itself.
    """
    # a node's shingles are many rows: those that one component alone holds are left out, and its stars dealt out evenly, before that
    parts = int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stars = perhaps_shared(stars).repartition(parts, "a", "b")
    cell_of = lambda size: F.floor(F.log(size) / math.log(CELL)).cast("int")
    share = similarity / (1 + similarity)
    nodes = stars.select("b", F.col("a").alias("node"), F.col("label_a").alias("label"), "n_a", "both", cell_of(F.col("n_a")).alias("own"))
    sizes = written(nodes.select("b", "own").distinct())
    # the cells of a star below each of its cells, once for all nodes there: a node becomes one row for each cell that some node has
    below = sizes.withColumn("cell", F.explode(F.sequence(cell_of(similarity * F.pow(F.lit(CELL), F.col("own"))) - 1, F.col("own"))))
    reached = written(below.join(sizes.withColumnRenamed("own", "cell"), ["b", "cell"]).groupBy("b", "own").agg(F.collect_list("cell").alias("cells")))
    low = F.greatest(F.pow(F.lit(CELL), F.col("cell")), similarity * F.col("n_a")) - 1e-6
    need = lambda partner: F.greatest(F.lit(1), F.ceil(share * (F.col("n_a") + partner) - F.col("both") - 1e-6)).cast("int")
    least = cell_of(similarity * F.col("n_a") - 1e-6)
    placed = nodes.join(reached, ["b", "own"]).withColumn("cell", F.explode(F.filter("cells", lambda c: c >= least)))
    placed = placed.select("b", "node", "label", "n_a", "both", "cell", low.alias("low"), need(low).alias("need"), F.when(F.col("cell") == F.col("own"), need(F.col("n_a"))).alias("own_need"))

    held = stars.select("b", F.col("a").alias("node"), F.col("label_a").alias("label"), F.explode("rest").alias("one"))
    useful = held.groupBy("b", "one").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("b", "one", "n")
    ordered = held.drop("label").join(useful, ["b", "one"]).groupBy("b", "node").agg(F.sort_array(F.collect_list(F.struct("n", "one"))).alias("ones"))
    first = F.posexplode(F.slice("ones", F.lit(1), F.size("ones") - F.col("need") + 1)).alias("at", "found")
    shared = placed.join(ordered, ["b", "node"]).where(F.size("ones") >= F.col("need")).select("b", "cell", "node", "label", (F.size("ones") - F.col("own_need")).alias("upto"), first)
    shared = shared.select(F.xxhash64("b", "cell", "found.one").alias("key"), "node", "label", F.expr("coalesce(at <= upto, false)").alias("smaller"))
    up_to = F.col("both") / share - F.col("n_a") + 1e-6
    small = placed.where(up_to >= F.col("low")).select(F.xxhash64("b", "cell", F.lit("small")).alias("key"), "node", "label", (F.col("own_need").isNotNull() & (up_to >= F.col("n_a"))).alias("smaller"))
    every = shared.unionByName(small)
    sets = [F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]]
    mixed = every.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.max("smaller").alias("any_smaller"), *sets).where("least <> most AND any_smaller")
    # nodes that share one shingle outside l mostly share more: of buckets with the same nodes one is enough
    different = mixed.groupBy("n", "x0", "x1").agg(F.min("key").alias("key")).select("key")
    return every.select("key", "node").join(different, "key")


def near_links(buckets: DataFrame, bag_of: DataFrame, similarity: float, few: int = 4) -> DataFrame | None:
    """(node, label) of all nodes that have a link; a link joins similar nodes of one bucket (key, node). None without a link.

    Round by round each node meets the leaders of its buckets. A node that is still in another component than a leader is
    apart in that leader's star. Where up to `few` nodes of a star are apart, these meet all of it, so that a node of the
    star gives `few` rows at most; the nodes of other stars go on into the next round's buckets. `few` grows fourfold with
    each round, so that the rounds end. No link is lost: see next_buckets.
    """

    def meet(pairs: DataFrame, with_rest: bool = False) -> DataFrame:
        # pairs that are few are no work for many tasks, and only their bags have to move
        pairs, n = pairs.select("a", "b"), pairs.count()
        nodes = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()
        near = (lambda df: F.broadcast(df)) if n <= FEW_ROWS else (lambda df: df)
        used = bag_of.join(near(nodes), "digest", "left_semi")
        one = used.select(F.col("digest").alias("a"), F.col("hashes").alias("hashes_a"), F.col("weights").alias("weights_a"))
        two = used.select(F.col("digest").alias("b"), F.col("hashes").alias("hashes_b"), F.col("weights").alias("weights_b"))
        made = one.join(near(pairs), "a").join(two, "b").coalesce(n // 1000 + 1)
        with small_batches(bag_of.sparkSession):
            return written(made.mapInPandas(met(similarity, with_rest), MET))

    def similar(seen: DataFrame) -> DataFrame:
        return seen.where("same").select("a", "b")

    labels, waiting = None, None
    while True:
        n = buckets.count()
        rays = leaders(gathered(buckets, n), n)
        if waiting is None:
            # a large group has several leaders, one for some buckets, another for others: each node meets the one with the most company first
            pairs = written(rays.groupBy("a").agg(F.min(F.struct("order", "b")).alias("first")).select("a", "first.b"))
        else:
            pairs = written(differing(rays, labels).unionByName(waiting).distinct())
        labels = linked(labels, similar(meet(pairs)))
        # and the others only while it is in another component than they
        if waiting is None and not (others := written(differing(rays.join(pairs, ["a", "b"], "left_anti"), labels))).isEmpty():
            labels = linked(labels, similar(meet(others)))
        stars = gathered(written(with_label(with_label(rays, labels, "a", "label_a"), labels, "b", "label_b").drop("order")), n)
        apart = written(stars.where("label_a <> label_b").groupBy("b").agg(F.count(F.lit(1)).alias("n_apart")))
        size = bag_of.select(F.col("digest").alias("a"), F.col("n").alias("n_a"))
        sized = stars.join(apart.where(F.col("n_apart") <= few), "b").join(size, "a")
        one, two = sized.where("label_a <> label_b"), sized.select("b", F.col("a").alias("y"), F.col("n_a").alias("n_y"), F.col("label_a").alias("label_y"))
        close = F.least("n_a", "n_y") >= similarity * F.greatest("n_a", "n_y") - 1e-9
        # these pairs meet with those of the next round
        waiting = written(one.join(two, "b").where((F.col("label_a") != F.col("label_y")) & close).select(F.least("a", "y").alias("a"), F.greatest("a", "y").alias("b")).distinct())
        crowded = gathered(written(stars.join(apart.where(F.col("n_apart") > few), "b", "left_semi").select("a", "b")), n)
        if not crowded.isEmpty():
            # what lies outside the leader is kept for these pairs alone
            profiles = meet(crowded, with_rest=True)
            buckets = written(next_buckets(with_label(with_label(profiles, labels, "a", "label_a"), labels, "b", "label_b"), similarity).distinct())
        if crowded.isEmpty() or buckets.isEmpty():
            return linked(labels, similar(meet(waiting)))
        few = 4 * max(few, 1)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bands: int = 20, rows: int = 6, row_col: str | None = None, few: int = 4) -> DataFrame:
    """One row per document: id, class_id (the smallest id of its class), class_size (rows), kept (true once in each class), text_hash (xxhash64 of the text, null as empty).

    With row_col, a column of unique numbers, that column comes first, and of rows with the smallest id the smallest number is kept.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(id_or_last(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"))
    with small_batches(docs.sparkSession, 1000):
        signed = written(base.select("id", "h", "row", "text").mapInPandas(sign(shingle, bands, rows), SIGNED))
    # texts of equal words are one node
    placed = signed.where("digest IS NOT NULL").select(F.explode("bands").alias("key"), F.col("digest").alias("node")).distinct()
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    buckets = written(placed.join(shared, "key"))
    # one row stands for all of equal words; its text is read from the documents again, and its bag kept
    needed = buckets.select(F.col("node").alias("digest")).distinct()
    # written, so that their size is known before the join; the other texts are not shuffled, but for a few that a bitmap lets pass
    chosen = written(signed.join(needed, "digest", "left_semi").groupBy("digest").agg(F.min(F.struct("id", "h")).alias("row")).select("digest", "row.id", "row.h"))
    texts = perhaps_in(base.drop("row"), chosen, "h").join(chosen, ["id", "h"]).groupBy("digest").agg(F.first("text").alias("text"))
    with small_batches(docs.sparkSession, 1000):
        bag_of = written(texts.mapInPandas(stored(shingle), "digest binary, n long, hashes binary, weights binary"))
    labels = near_links(buckets, bag_of, similarity, few)

    alone = F.coalesce("digest", F.concat(F.lit(b"alone"), F.col("row").cast("string").cast("binary")))
    rows_of = signed.select("id", "h", "row", alone.alias("digest"))
    classed = written(with_label(rows_of, labels, "digest", "label"))
    best_row = F.min(F.struct("id", F.col("row").alias("keep_row"))).alias("best")
    classes = classed.groupBy("label").agg(best_row, F.count(F.lit(1)).alias("class_size")).select("label", F.col("best.id").alias("class_id"), "best.keep_row", "class_size")
    return classed.join(classes, "label").select(
        *([F.col("row").alias(row_col)] if row_col else []), id_or_null("id").alias(id_col), id_or_null("class_id").alias("class_id"), "class_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("h").alias("text_hash")
    )
