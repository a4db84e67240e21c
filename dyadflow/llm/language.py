"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character n-grams (1 to 3 letters, words padded by a space) of the whole text, weighted by
log(1 + count) times inverse document frequency and scaled to length one. Document frequencies are counted over all
labelled training documents. The weights are learned by follow-the-regularised-leader (FTRL-proximal) with L1 and L2
penalties, which leaves most of them at zero; a single temperature, fitted on training documents that the weights have not
seen, calibrates the probabilities.

Bounds: the weights are fitted on a sample of about `per_language` documents of each language (rows chosen by a hash of
the id); the model has `buckets` times the number of languages weights, whatever the corpus.

Defined results: null text, or text without a letter, is "und" with score 0; with no labelled document every text is "und";
rows are judged one by one, so repeated rows get equal results; null ids stay null and are never learned from; extra columns
are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
BUCKETS = 1 << 16
#: Documents of a training batch of features; texts longer than this many letters are hashed in stretches of it.
STRETCH = 1 << 20
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def fold(id_col: str, parts: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def code_points(text: str) -> np.ndarray:
    """Lower-cased letters of a text as numbers; everything between letters is one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = LETTER[np.minimum(points, len(LETTER) - 1)]
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return points[keep]


ANY_LETTER = regex.compile(r"\p{L}")
LETTER = np.array([chr(i).isalpha() if not 0xD800 <= i <= 0xDFFF else False for i in range(0x30000)] + [False])


def features(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the whole text: (buckets that occur, how often)."""
    counts: np.ndarray | None = None
    ids, n = np.empty(0, np.uint32), np.empty(0, np.int64)
    for at in range(0, max(1, len(text)), STRETCH):
        p = np.concatenate([[np.uint32(32)], code_points(text[max(0, at - 2) : at + STRETCH]), [np.uint32(32)]]).astype(np.uint64)
        a, b, c = p * MIX[0], p * MIX[1], p * MIX[2]
        two, three = a[:-1] ^ (b[1:] + MIX[2]), a[:-2] ^ (b[1:-1] + MIX[0]) ^ (c[2:] + MIX[1])
        grams = np.concatenate([a[1:-1], two, three])
        grams = (((grams ^ (grams >> np.uint64(31))) * MIX[1]) >> np.uint64(40)).astype(np.uint32) % np.uint32(buckets)
        if len(text) > STRETCH:
            counts = np.bincount(grams, minlength=buckets) + (0 if counts is None else counts)
        else:
            grams.sort()
            edge = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            ids, n = grams[edge], np.diff(np.append(edge, len(grams)))
    if counts is not None:
        ids = np.flatnonzero(counts).astype(np.uint32)
        n = counts[ids]
    return ids, n


def weighted(ids: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(n) * idf[ids]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def count_documents(buckets: int):
    """mapInPandas: how many texts of a task hold each bucket; one row for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, docs = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                seen[features(text, buckets)[0]] += 1
                docs += 1
        used = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": np.append(used, -1), "docs": np.append(seen[used], docs)})

    return run


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal with elastic-net penalties, one weight vector for each class."""

    def __init__(self, buckets: int, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((buckets, classes)), np.zeros((buckets, classes))

    def weights(self, ids=slice(None)) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, ids: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(ids)
        gap = softmax(x @ w)
        gap[label] -= 1.0
        g = np.outer(x, gap)
        n = self.n[ids]
        self.z[ids] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[ids] += g * g


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by a golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(buckets: int, classes: list[str], epochs: int):
    """applyInPandas: learn from one bounded sample (text, lang, order); the model is one binary row."""

    def run(sample: pd.DataFrame) -> pd.DataFrame:
        idf = np.asarray(sample["idf"].dropna().iloc[0])
        rows = sample.dropna(subset=["text"]).sort_values(["order", "text"])
        made = [(ids, weighted(ids, n, idf).astype(np.float32), classes.index(lang)) for (ids, n), lang in zip((features(t, buckets) for t in rows["text"]), rows["lang"], strict=True)]
        held = [m for i, m in enumerate(made) if i % 5 == 0]
        model = Ftrl(buckets, len(classes))
        for _ in range(epochs):
            for i, m in enumerate(made):
                if i % 5:
                    model.learn(*m)
        w = model.weights()
        t = fit_temperature(np.array([x @ w[ids] for ids, x, _ in held]).reshape(-1, len(classes)), np.array([y for *_, y in held], dtype=int))
        return pd.DataFrame({"model": [zlib.compress(pickle.dumps((classes, idf.astype(np.float32), w.astype(np.float32), t)))]})

    return run


def train(labelled: DataFrame, per_language: int = 1000, epochs: int = 3, buckets: int = BUCKETS) -> bytes | None:
    """The model from rows (text, lang, order); order is a hash of the id. None if there is no row."""
    spark = labelled.sparkSession
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    seen = np.zeros(buckets + 1)
    for r in labelled.select("text").mapInPandas(count_documents(buckets), "bucket int, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).collect():
        seen[r["bucket"]] = r["docs"]
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    # a row is in the sample if its hash lies below the share of its language: the same rows at every run
    drawn = labelled.where(F.pmod(F.xxhash64("order", "text"), F.lit(1_000_003)) < share * 1_000_003).select("text", "lang", F.xxhash64("order").alias("order"))
    stated = spark.createDataFrame([(None, None, None, idf.tolist())], "text string, lang string, order long, idf array<double>")
    sample = drawn.withColumn("idf", F.lit(None).cast("array<double>")).unionByName(stated)
    return bytes(sample.groupBy(F.lit(0).alias("one")).applyInPandas(fit(buckets, sorted(sizes), epochs), "model binary").head()["model"])


def predict(model: bytes | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if model is not None:
            classes, idf, w, t = pickle.loads(zlib.decompress(model))
        for batch in batches:
            langs, scores = [], []
            for text, known in zip(batch["text"], batch["known"], strict=True):
                lang, score = UNDETERMINED, 0.0
                if known and model is not None:
                    ids, n = features(text)
                    p = softmax((weighted(ids, n, idf) @ w[ids]) / t)
                    lang, score = classes[int(p.argmax())], float(p.max())
                langs.append(lang)
                scores.append(score)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return run


def held_out(id_col: str, folds: int = 3, held_fold: int = 1) -> Column:
    return F.coalesce(fold(id_col, folds) == held_fold, F.lit(False))


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **training) -> bytes | None:
    """The model, learned from the documents that have an id and are not held out."""
    learned = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col))
    return train(learned.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("order")), **training)


def judged(docs: DataFrame, model: bytes | None, text_col: str = "text") -> Column:
    """struct(lang_pred, score) for each row's text."""
    run = predict(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from run(pd.DataFrame({"text": t.fillna(""), "known": [bool(ANY_LETTER.search(x)) for x in t.fillna("")]}) for t in texts)

    return judge(F.col(text_col))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **training) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score. Held-out rows are not learned from."""
    model = trained(docs, id_col, text_col, lang_col, **training)
    found = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), judged(docs, model, text_col).alias("found"))
    return found.select(id_col, "held_out", "found.lang_pred", "found.score")
