"""Quality scores by Bradley-Terry pairwise ranking.

A document's worth is a linear function of features of its whole text: hashed n-grams of one to three characters, where a
capital is its small letter with a mark and every digit is a zero, and a few numbers on its length and on how often words
and lines recur. Preference pairs put a labelled good document against a labelled bad one; the weights minimise the
logistic loss on the differences of their features, with an L2 penalty. A quantile of the scores of all labelled documents
outside the held-out fold, chosen where the two classes part best, becomes the threshold; scores are scaled so that it lies
at `cut`.

Bounds: the weights are fitted in one task on features of about `sample` labelled documents of each class (at most
BUCKETS + 6 numbers for each, whatever its text), with `partners` pairs for each of the smaller class. Threshold and spread
come from all that may be learned from. Every text is scored once, in Arrow batches.

Defined results: null text counts as empty; a document labelled several times has its lowest label; rows are scored one by
one, so repeated rows get equal results; null ids stay null and are never learned from; without both labels in the
training rows every score is the cut; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadflow.llm.common import written
from dyadflow.llm.language import MIX, fold

BUCKETS = 1 << 14
SHAPE = 6
#: Letters that are turned into n-grams at a time.
STRETCH = 1 << 19
_CHARS = [chr(i) if not 0xD800 <= i <= 0xDFFF else " " for i in range(0x3000)]
#: What a character counts as: its small letter, marked where it is a capital; 0 for a digit; a space for white space.
KIND = np.array([32 if c.isspace() else 48 if c.isdecimal() else (1 << 21) + ord(c.lower()[0]) if c.isupper() else i for i, c in enumerate(_CHARS)], np.uint64)


def grams(text: str) -> np.ndarray:
    """How often each bucket of n-grams occurs in a stretch of text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    p = np.where(points < len(KIND), KIND[np.minimum(points, len(KIND) - 1)], points.astype(np.uint64))
    a, b, c = p * MIX[0], p * MIX[1], p * MIX[2]
    all_grams = np.concatenate([a, a[:-1] ^ (b[1:] + MIX[2]), a[:-2] ^ (b[1:-1] + MIX[0]) ^ (c[2:] + MIX[1])])
    return np.bincount((((all_grams ^ (all_grams >> np.uint64(31))) * MIX[1]) >> np.uint64(64 - 14)).astype(np.int64), minlength=BUCKETS)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features that are not 0, their values) of a whole text; that it is empty is a feature."""
    if not text:
        return np.array([BUCKETS + SHAPE - 1], np.int32), np.ones(1, np.float32)
    counts = np.zeros(BUCKETS, np.int64)
    words, lines, n_words, n_lines = set(), set(), 0, 0
    for at in range(0, len(text), STRETCH):
        part = text[at : at + STRETCH]
        counts += grams(text[max(0, at - 2) : at + STRETCH])
        own, rows = part.split(), part.split("\n")
        words.update(map(hash, own))
        lines.update(map(hash, rows))
        n_words, n_lines = n_words + len(own), n_lines + len(rows)
    ids = np.flatnonzero(counts)
    x = np.log1p(counts[ids])
    n = max(1, n_words)
    shape = [len(words) / n, len(words) / n * math.log1p(n) / 8, min(20.0, len(text) / n) / 10, math.log1p(len(text)) / 10, len(lines) / n_lines]
    return np.append(ids, BUCKETS + np.arange(5)).astype(np.int32), np.append(x / np.sqrt(x @ x), shape).astype(np.float32)


def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas: (text, label, order) to (ids, x, label, order)."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            rows = batch.iloc[at : at + 256]
            found = [features(t) for t in rows["text"]]
            yield pd.DataFrame({"ids": [f[0] for f in found], "x": [f[1] for f in found], "label": rows["label"].to_numpy(), "order": rows["order"].to_numpy()})


def bradley_terry(ids: np.ndarray, x: np.ndarray, edges: np.ndarray, better: np.ndarray, worse: np.ndarray, penalty: float, rounds: int) -> np.ndarray:
    """Weights of least logistic loss on the differences of the rows better[k] and worse[k], by accelerated gradient steps.

    The rows lie end to end in (ids, x), bounded by edges.
    """
    size, row = BUCKETS + SHAPE, np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    w, last = np.zeros(size), np.zeros(size)
    # no difference is longer than the sum of two rows: the step that no curvature of the loss outruns
    longest = np.sqrt(np.bincount(row, x.astype(float) ** 2)).max()
    step = 1 / (0.25 * (2 * longest) ** 2 + penalty)
    for k in range(rounds):
        ahead = w + k / (k + 3) * (w - last)
        s = np.bincount(row, ahead[ids] * x)
        push = -1 / (1 + np.exp(np.clip(s[better] - s[worse], -40, 40))) / len(better)
        pull = np.bincount(better, push, len(s)) - np.bincount(worse, push, len(s))
        last, w = w, ahead - step * (np.bincount(ids, pull[row] * x, size) + penalty * ahead)
    return w


def preference_pairs(labels: np.ndarray, partners: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (better, worse): each row of the smaller class meets `partners` of the other, in turn."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    turns = np.minimum(partners, len(many))
    first = np.repeat(few, turns)
    other = many[(np.repeat(np.arange(len(few)), turns) + np.tile(np.arange(turns), len(few)) * len(few)) % len(many)]
    return (other, first) if few is bad else (first, other)


def fit(partners: int, penalty: float, rounds: int):
    """applyInPandas: the weights, learned from one bounded sample of (ids, x, label, order)."""

    def run(sample: pd.DataFrame) -> pd.DataFrame:
        rows = sample.sort_values("order")
        labels = rows["label"].to_numpy()
        if len(set(labels.tolist())) < 2:
            return pd.DataFrame({"weights": [np.zeros(BUCKETS + SHAPE)]})
        ids, x = np.concatenate(rows["ids"].tolist()), np.concatenate(rows["x"].tolist())
        edges = np.concatenate([[0], np.cumsum([len(r) for r in rows["ids"]])])
        return pd.DataFrame({"weights": [bradley_terry(ids, x, edges, *preference_pairs(labels, partners), penalty, rounds)]})

    return run


def worth(weights: np.ndarray):
    """A pandas UDF: the worth of each text."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = np.empty(len(batch))
            for i, text in enumerate(batch):
                ids, x = features(text or "")
                out[i] = weights[ids] @ x
            yield pd.Series(out)

    return score


def best_quantile(scored: DataFrame, steps: int = 200) -> tuple[float, float, float]:
    """(threshold, its quantile, spread) of the scores s of rows (s, label): the quantile with the best mean of both classes' recalls."""
    grid = [i / steps for i in range(steps + 1)]
    cuts = scored.agg(F.percentile_approx("s", grid, 100_000).alias("cuts")).head()["cuts"]
    if not cuts:
        return 0.0, 0.0, 1.0
    cells = scored.select(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("s"))).alias("cell"), "label").groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    good, bad = np.zeros(steps + 2), np.zeros(steps + 2)
    for r in cells:
        (good if r["label"] == 1 else bad)[r["cell"]] += r["n"]
    # a row of cell c passes the cuts 0 .. c - 1
    kept = good[::-1].cumsum()[::-1][1:] / max(1, good.sum())
    dropped = 1 - bad[::-1].cumsum()[::-1][1:] / max(1, bad.sum())
    i = int(np.argmax(kept + dropped))
    # half way to the next score below: clean documents just above keep a margin
    at = (cuts[i] + cuts[max(0, i - 1)]) / 2
    return float(at), grid[i], float(max(1e-6, cuts[3 * steps // 4] - cuts[steps // 4]))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_fold: int = 0, cut: float = 0.3, sample: int = 1000, partners: int = 8, penalty: float = 1e-4, rounds: int = 150) -> DataFrame:
    """One row per document: id, held_out, score, predicted. Rows of the fold `held_fold` are not learned from."""
    held = F.coalesce(fold(id_col, folds) == held_fold, F.lit(False))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("label"))
    learned = known.where(~held)
    n = {r["label"]: r["n"] for r in learned.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # labels are drawn before the texts are joined, so only the sample's texts are turned into features
    share = F.when(F.col("label") == 1, min(1.0, sample / max(1, n.get(1, 0)))).otherwise(min(1.0, sample / max(1, n.get(0, 0))))
    chosen = learned.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_003)) < share * 1_000_003)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the sample is bounded: its ids go to the documents, not the documents to them
    rows = docs.select(id_col, text.alias("text")).join(F.broadcast(chosen), id_col).select("text", "label", F.xxhash64(id_col, "text").alias("order"))
    made = rows.mapInPandas(featured, "ids array<int>, x array<float>, label int, order long")
    found = made.groupBy(F.lit(0).alias("one")).applyInPandas(fit(partners, penalty, rounds), "weights array<double>").head()
    weights = np.array(found["weights"]) if found else np.zeros(BUCKETS + SHAPE)
    scored = written(docs.select(F.col(id_col), held.alias("held_out"), worth(weights)(text).alias("s")))
    at, _, spread = best_quantile(scored.join(learned, id_col).select("s", "label"))
    logit = float(np.log(cut / (1 - cut)))
    score = F.lit(1.0) / (1 + F.exp(-(F.lit(logit) + (F.col("s") - at) / spread)))
    return scored.select(id_col, "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))
