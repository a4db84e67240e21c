"""Hard negatives by an STR-packed R-tree over integer vectors.

Sort-tile-recursive packing deals the rows to tiles: slabs by label first, so that most boxes hold one label, then by the
coordinates that spread most. The slabs' cuts are fitted on a sample (`sample` rows, by a hash of the row); every row is then
dealt by them, and a tile that comes out too large, as with many equal vectors, is parted by row numbers. Each tile is packed in its
task into leaves and levels of bounding boxes. A box bounds the inner product with a query coordinate by coordinate: the larger
and the smaller of q*low and q*high, summed.

A search finds, for each query and each of its score windows, the first `k` rows by score, then id. It goes best first: every query visits the
tile with the highest bound, which gives each window its k-th score so far; then the tiles, and in them the boxes from a
queue, that still reach a window and are not strictly below its k-th score. Queries meet tiles in blocks, so no task holds more than
a tile and `slice_rows` queries. The search is exact: scores are whole numbers (float arithmetic below 2^53, long or unbounded numbers
above, where results saturate), and a bound is widened by its rounding error.

Defined results: rows with a null label, vector or component, or one that is not finite, take no part; rows with the anchor's id are never its
positives; repeated rows each count; a null id comes after all others among ties and is no anchor; shorter vectors count as
followed by zeros; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dyadflow.llm.common import id_or_last, id_or_null, written

LOWEST, HIGHEST = -(2**63), 2**63 - 1
TREE = "tile long, part long, n long, label_low long, label_high long, low array<double>, high array<double>, labels binary, ids binary, kind string, vectors binary, leaves binary"
HIT = "q long, w long, id long, score long"


def saturated(values: np.ndarray) -> np.ndarray:
    if values.dtype == object:
        values = np.array([min(max(int(v), LOWEST), HIGHEST) for v in values], np.int64)
    return values.astype(np.int64)


# Packing


def slabs(p: int, axes: int) -> int:
    """Slabs of the next axis so that p tiles come out of so many axes."""
    return max(1, math.ceil(p ** (1 / max(1, axes))))


def label_groups(labels: np.ndarray, share: float, most: float) -> list[float]:
    """Cuts between labels: neighbours stay together while they have at most `most` rows; a row of `labels` stands for `share` rows."""
    values, counts = np.unique(labels, return_counts=True)
    cuts, held = [], 0.0
    for value, n in zip(values, counts * share, strict=True):
        if held and held + n > most:
            cuts.append(float(value))
            held = 0.0
        held += n
    return cuts


def fitted(labels: np.ndarray, vectors: np.ndarray, share: float, most: int) -> tuple:
    """Nodes (axis, cuts, children) down to tiles (numbers); axis -1 is the label."""
    count = [0]
    spread = np.argsort(-vectors.var(axis=0), kind="stable") if len(vectors) else np.arange(0)

    def tile():
        count[0] += 1
        return count[0] - 1

    def by_axis(v: np.ndarray, axes: list[int]):
        p = math.ceil(len(v) * share / most)
        if p <= 1 or not axes:
            return tile()
        x = np.sort(v[:, axes[0]])
        s = slabs(p, len(axes))
        cuts = np.unique(x[[len(x) * i // s for i in range(1, s)]]) if s > 1 else x[:0]
        at = np.searchsorted(cuts, v[:, axes[0]], "right")
        return axes[0], cuts, [by_axis(v[at == i], axes[1:]) for i in range(len(cuts) + 1)]

    def axes_for(n: int) -> list[int]:
        return spread[: max(1, int(math.log2(max(2.0, n * share / most)) / 2))].tolist()

    cuts = np.array(label_groups(labels, share, most))
    at = np.searchsorted(cuts, labels, "right")
    root = (-1, cuts, [by_axis(vectors[at == i], axes_for(int((at == i).sum()))) for i in range(len(cuts) + 1)])
    return root, count[0]


def tile_of(root, labels: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros(len(labels), np.int64)

    def walk(node, rows: np.ndarray) -> None:
        if isinstance(node, int):
            out[rows] = node
            return
        axis, cuts, children = node
        at = np.searchsorted(cuts, labels[rows] if axis < 0 else vectors[rows, axis], "right")
        for i, child in enumerate(children):
            if len(own := rows[at == i]):
                walk(child, own)

    walk(root, np.arange(len(labels)))
    return out


def packed_order(labels: np.ndarray, vectors: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of the leaves, and where each leaf begins (and the end)."""
    spread = np.argsort(-vectors.astype(np.float64).var(axis=0), kind="stable")
    order: list[np.ndarray] = []

    def walk(rows: np.ndarray, axes: list[int]) -> None:
        p = math.ceil(len(rows) / leaf_rows)
        if p <= 1 or not axes:
            order.extend(np.array_split(rows, p))
            return
        rows = rows[np.argsort(vectors[rows, axes[0]], kind="stable")]
        for part in np.array_split(rows, min(p, slabs(p, len(axes)))):
            walk(part, axes[1:])

    for label in np.unique(labels):
        rows = np.flatnonzero(labels == label)
        walk(rows, spread[: max(1, int(math.log2(max(2, len(rows) / leaf_rows)) / 2))].tolist())
    return np.concatenate(order), np.cumsum([0, *map(len, order)])


def stacked(column) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0))


def packed_tile(leaf_rows: int):
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        labels, vectors = rows["label"].to_numpy(np.int64), stacked(rows["vec"]).astype(np.int64)
        order, leaves = packed_order(labels, vectors, leaf_rows)
        labels, ids, vectors = labels[order], rows["id"].to_numpy(np.int64)[order], vectors[order]
        kind = np.result_type(np.min_scalar_type(vectors.min(initial=0)), np.min_scalar_type(vectors.max(initial=0)), np.int8)
        kind = kind if kind.kind == "i" else np.dtype(np.int64)
        row = (key[0], key[1], len(ids), labels.min(), labels.max(), vectors.min(axis=0).astype(float), vectors.max(axis=0).astype(float), labels.tobytes(), ids.tobytes(), kind.str, vectors.astype(kind).tobytes(), leaves.astype(np.int64).tobytes())
        return pd.DataFrame([row], columns=[f.split()[0] for f in TREE.split(", ")])

    return build


def packed(points: DataFrame, tile_rows: int = 2048, leaf_rows: int = 128, sample: int = 16_384) -> DataFrame:
    """The tree of points (row, id, label, vec of one length), a row for each tile, written."""
    n = points.count()
    some = points.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, sample / max(1, n)))).select("label", "vec").toPandas()
    vectors = stacked(some["vec"]).astype(np.float64)
    if not len(some):  # a few rows of which the sample has none
        vectors = np.zeros((0, points.select(F.size("vec")).head()[0] if n else 0))
    root, tiles = fitted(some["label"].to_numpy(np.int64), vectors, n / max(1, len(some)), tile_rows)

    def place(batches):
        for rows in batches:
            rows["tile"] = tile_of(root, rows["label"].to_numpy(np.int64), stacked(rows["vec"]).astype(np.float64))
            yield rows

    placed = points.mapInPandas(place, "row long, id long, label long, vec array<long>, tile long")
    placed = written(placed)
    large = placed.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / (2 * tile_rows)).alias("parts"))
    parted = placed.join(large, "tile").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    return written(parted.groupBy("tile", "part").applyInPandas(packed_tile(leaf_rows), TREE))


# Search


def bounds(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at least, at most) of the inner products of each query with what lies in each box."""
    up, down = np.maximum(q, 0.0), np.minimum(q, 0.0)
    slack = 1e-12 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def fits(label_low: np.ndarray, label_high: np.ndarray, label: int, same: bool) -> np.ndarray:
    """Boxes that can hold a row of that label, or of another."""
    return (label_low <= label) & (label <= label_high) if same else (label_low < label_high) | (label_low != label)


class Tile:
    """A tile's rows and its boxes, level by level: leaves first, the last box is the root."""

    def __init__(self, row, fan: int = 8):
        self.labels, self.ids = np.frombuffer(row.labels, np.int64), np.frombuffer(row.ids, np.int64)
        self.raw = np.frombuffer(row.vectors, row.kind).reshape(int(row.n), -1)
        self.vectors = self.raw.astype(np.float64)
        self.largest = float(np.abs(self.vectors).max(initial=0.0))
        self.starts = np.frombuffer(row.leaves, np.int64)
        at = self.starts[:-1]
        low, high = np.minimum.reduceat(self.vectors, at, axis=0), np.maximum.reduceat(self.vectors, at, axis=0)
        label_low, label_high = np.minimum.reduceat(self.labels, at), np.maximum.reduceat(self.labels, at)
        self.n_leaves = len(at)
        self.children: list[range] = [range(0)] * self.n_leaves
        levels, begin = [(low, high, label_low, label_high)], 0
        while len(levels[-1][0]) > 1:
            low, high, label_low, label_high = levels[-1]
            at = np.arange(0, len(low), fan)
            self.children += [range(begin + int(i), begin + min(int(i) + fan, len(low))) for i in at]
            begin += len(low)
            levels.append((np.minimum.reduceat(low, at, axis=0), np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(label_low, at), np.maximum.reduceat(label_high, at)))
        self.low, self.high, self.label_low, self.label_high = (np.concatenate([x[i] for x in levels]) for i in range(4))

    def scores(self, leaf: int, q: np.ndarray) -> np.ndarray:
        a, b = self.starts[leaf], self.starts[leaf + 1]
        most = self.largest * float(np.abs(q.astype(np.float64)).max(initial=0.0)) * max(1, len(q))
        if most < 2**53:
            return self.vectors[a:b] @ q.astype(np.float64)
        return self.raw[a:b].astype(object).dot(q.astype(object)) if most >= 2**62 else self.raw[a:b].astype(np.int64) @ q


def first_rows(held: tuple, score: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    score, ids = np.concatenate([held[0], score]), np.concatenate([held[1], ids])
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def search_tile(tile: Tile, queries: pd.DataFrame, k: int) -> list[tuple]:
    """Best-first search of each query (q, id, label, same, vec, low, high, kth) in a tile: (q, w, id, score)."""
    vectors = stacked(queries["vec"]).astype(np.int64)
    out: list[tuple] = []
    for begin in range(0, len(queries), 256):
        least, most = bounds(tile.low, tile.high, vectors[begin : begin + 256].astype(np.float64))
        for at, row in enumerate(queries.iloc[begin : begin + 256].itertuples(index=False)):
            low, high = np.asarray(row.low, np.float64), np.asarray(row.high, np.float64)
            floor = np.maximum(low, np.asarray(row.kth, np.float64))
            open_box = fits(tile.label_low, tile.label_high, row.label, row.same) & (least[at] <= high.max())
            ub, top = np.minimum(most[at], high.max()), len(tile.children) - 1
            none = np.empty(0), np.empty(0, np.int64)
            held = [none] * len(low)
            queue = [(-ub[top], top)] if open_box[top] else []
            while queue:
                bound, node = heapq.heappop(queue)
                if -bound < floor.min():
                    break  # strictly below the k-th score of every window, and so are all that follow
                if node >= tile.n_leaves:
                    for child in tile.children[node]:
                        if open_box[child] and ub[child] >= floor.min():
                            heapq.heappush(queue, (-ub[child], child))
                    continue
                own = slice(tile.starts[node], tile.starts[node + 1])
                score = saturated(tile.scores(node, vectors[begin + at]))
                ok = (tile.labels[own] == row.label) & (tile.ids[own] != row.id) if row.same else tile.labels[own] != row.label
                inside = (score >= floor[:, None]) & (score <= high[:, None]) & ok
                for w in np.flatnonzero(inside.any(axis=1)):
                    held[w] = first_rows(held[w], score[inside[w]], tile.ids[own][inside[w]], k)
                    if len(held[w][0]) == k:
                        floor[w] = max(floor[w], held[w][0][-1])
            out += [(row.q, w, int(i), int(s)) for w, (scores, ids) in enumerate(held) for s, i in zip(scores, ids, strict=True)]
    return out


def reached(boxes: DataFrame, queries: DataFrame, slice_rows: int, box_rows: int = 1024) -> DataFrame:
    """(q, tile, part, most): the tiles whose box reaches a window of a query; queries and boxes meet in blocks."""
    slices = max(1, math.ceil(queries.count() / slice_rows))
    blocks = max(1, math.ceil(boxes.count() / box_rows))
    left = queries.select("q", "label", "same", "vec", "low", "high", F.pmod(F.xxhash64("q"), F.lit(slices)).alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = boxes.select("tile", "part", "label_low", "label_high", F.col("low").alias("box_low"), F.col("high").alias("box_high"), F.pmod(F.xxhash64("tile", "part"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")).alias("slice"))

    def meet(queries: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(boxes):
            least, most = bounds(stacked(boxes["box_low"]), stacked(boxes["box_high"]), stacked(queries["vec"]).astype(np.float64))
            label_low, label_high, tile, part = (boxes[c].to_numpy() for c in ("label_low", "label_high", "tile", "part"))
            for i, row in enumerate(queries.itertuples(index=False)):
                ok = fits(label_low, label_high, row.label, row.same) & (most[i] >= min(row.low)) & (least[i] <= max(row.high))
                out.append(pd.DataFrame({"q": row.q, "tile": tile[ok], "part": part[ok], "most": most[i][ok]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "tile": [], "part": [], "most": []})

    return left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInPandas(meet, "q long, tile long, part long, most double")


def visit(tree: DataFrame, wanted: DataFrame, queries: DataFrame, k: int, slices: int) -> DataFrame:
    """Searches the tiles that queries want (q, tile, part); a tile meets its queries slice by slice."""
    left = wanted.join(queries, "q").withColumn("slice", F.pmod(F.xxhash64("q"), F.lit(slices)))
    right = tree.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")))
    keys = ("tile", "part", "slice")

    def meet(queries: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        found = [hit for row in tiles.itertuples(index=False) for hit in search_tile(Tile(row), queries, k)] if len(queries) else []
        return pd.DataFrame(found, columns=["q", "w", "id", "score"])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, HIT)


def search(tree: DataFrame, queries: DataFrame, k: int, slice_rows: int = 4096) -> DataFrame:
    """(q, w, id, score, rank): for each window w of each query the first k rows by score, then id.

    queries (q, id, label, same, vec, low, high), written: rows of the label are wanted where `same`, else of other labels; low and high
    are the windows' ends.
    """
    slices = max(1, math.ceil(queries.count() / slice_rows))
    tiles = written(reached(tree.select("tile", "part", "label_low", "label_high", "low", "high"), queries, slice_rows))
    best = tiles.groupBy("q").agg(F.max(F.struct("most", "tile", "part")).alias("best")).select("q", "best.tile", "best.part")
    unknown = F.transform("low", lambda x: F.lit(LOWEST).cast("long"))
    seen = written(visit(tree, best, queries.withColumn("kth", unknown), k, slices))
    # the k-th score that each window has from its best tile; none where it has fewer
    kth = seen.groupBy("q", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("s"))
    known = queries.join(kth, "q", "left").withColumn("kth", F.transform("low", lambda x, i: F.coalesce(F.try_element_at("s", i.cast("long")), F.lit(LOWEST).cast("long")))).drop("s")
    needed = F.array_min(F.zip_with("low", "kth", lambda a, b: F.greatest(a, b)))
    rest = tiles.join(best, ["q", "tile", "part"], "left_anti").join(known.select("q", needed.alias("needed")), "q").where(F.col("most") >= F.col("needed")).select("q", "tile", "part")
    both = seen.unionByName(visit(tree, rest, known, k, slices))
    order = Window.partitionBy("q", "w").orderBy(F.desc("score"), "id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def whole_numbers(vector: Column, scale: float = 256.0) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def takes_part(vector: Column, label: Column) -> Column:
    return label.isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def hard_negatives(points: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100, tile_rows: int = 2048, leaf_rows: int = 128, sample: int = 16_384) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of points (id, label long, vec array<long>, no nulls in the last two).

    An anchor's positives are the first rows of its label; its negatives for each are the first of other labels whose score is between these
    percentages of the positive's.
    """
    spark = points.sparkSession
    longest = points.agg(F.max(F.size("vec"))).head()[0]
    if longest is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    padded = F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(max(1, longest)) - F.size("vec")))
    points = written(points.select(F.monotonically_increasing_id().alias("row"), id_or_last("id").alias("id"), F.col("label").cast("long").alias("label"), padded.alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")))
    tree = packed(points.drop("anchor"), tile_rows, leaf_rows, sample)
    anchors = points.where("anchor").select(F.col("row").alias("q"), "id", "label", "vec")
    everything = [F.array(F.lit(x).cast("long")).alias(name) for name, x in (("low", LOWEST), ("high", HIGHEST))]
    near = written(search(tree, written(anchors.select("*", F.lit(True).alias("same"), *everything)), positives).select("q", F.col("id").alias("positive"), "score", F.col("rank").alias("place")))
    # ceil and floor of the percentages in whole numbers; windows without a number in them go
    low, high = (f"CAST(score AS DECIMAL(20, 0)) * {p}" for p in (low_percent, high_percent))
    ends = F.expr(f"struct(score, {low} DIV 100 + IF({low} > 0 AND {low} % 100 <> 0, 1, 0) AS low, {high} DIV 100 - IF({high} < 0 AND {high} % 100 <> 0, 1, 0) AS high)")
    windows = near.select("q", ends.alias("end")).where("end.low <= end.high").groupBy("q").agg(F.array_sort(F.collect_set("end")).alias("ends"))
    asked = written(anchors.join(windows, "q").select("q", "id", "label", "vec", F.lit(False).alias("same"), F.col("ends.low").alias("low"), F.col("ends.high").alias("high"), F.col("ends.score").alias("scores")))
    found = search(tree, asked.drop("scores"), negatives)
    named = found.join(asked.select("q", F.col("id").alias("anchor"), "scores"), "q").select("q", "anchor", F.element_at("scores", (F.col("w") + 1).cast("int")).alias("score"), "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    return near.join(named, ["q", "score"]).select(id_or_null("anchor").alias("anchor_id"), id_or_null("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), id_or_null("negative").alias("negative_id"), F.col("score").alias("positive_score"), "negative_score")


def contract_points(embeddings: DataFrame) -> DataFrame:
    """The contract's input: labels of every seventh id moved on by one, components times 256 rounded down."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.where(takes_part(F.col("embedding"), F.col("label"))).select(F.col("vec_id").alias("id"), label.cast("long").alias("label"), whole_numbers(F.col("embedding")).alias("vec"))


def contract_negatives(embeddings: DataFrame) -> DataFrame:
    return hard_negatives(contract_points(embeddings), F.col("id") % 100 == 0)
