"""Periodic runs of words, found online by dyadic square catchers.

Words are appended to a stream, one or many at a time. Each power of two K has a catcher for every completed block of K words
(it begins at a multiple of K). A square of period q with 2K <= q < 4K holds such a block whole in its first half, and the
block comes again q words later; so the suffix of K words that ends in each appended word is compared with the two blocks
whose distance lies in that range. A match is widened to both sides into the longest stretch that keeps the distance; it stays
open while appended words go on with it, and is a run once two periods long. Squares of one run give the same stretch and
merge; a match inside a run whose period is at most K can only repeat that run and is left out, which keeps a text of one
word at n log n steps.

Suffixes and blocks are compared by a polynomial hash of the words, and every run is compared word by word before it is
reported. Documents share a stream, parted by words that occur once and so lie in no run. A document's rows stay in their
task: nothing is shuffled. Memory is about 50 bytes a word of the stream, which is `STREAM` words or one longer document.

Defined results: null, empty and blank texts have no words and no runs; rows are judged one by one, so repeated rows get equal
results and null ids stay null; ties of runs by start, then period; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a stream, and of a slice that is appended at once.
STREAM = 1 << 18
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
LEAST = 12
FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def mixed(words: np.ndarray) -> np.ndarray:
    """64-bit numbers, different for different words."""
    x = words.astype(np.uint64) + BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SquareCatchers:
    """The maximal runs of a growing stream of words (numbers): append(), then runs(). No run is longer than `longest`, where given."""

    def __init__(self, least: int = LEAST, longest: int | None = None):
        self.least, self.track, self.longest = least, min(least, LEAST), longest or 1 << 62
        self.n = 0
        self.words = np.zeros(64, np.int64)
        self.prefix = np.zeros(65, np.uint64)
        self.powers = np.ones(65, np.uint64)
        self.open = np.empty((0, 3), np.int64)  # start, end, period of stretches that reach the stream's end
        self.done = np.empty((0, 3), np.int64)  # the same of runs

    def append(self, words: np.ndarray) -> None:
        for at in range(0, len(words), STREAM):
            self._slice(words[at : at + STREAM])

    def _grow(self, words: np.ndarray) -> None:
        t0, t1 = self.n, self.n + len(words)
        if 3 * t1 // 2 + 64 > len(self.words):  # a level reads a third beyond the end
            more = 2 * t1 + 64
            for name, size in (("words", more), ("prefix", more + 1), ("powers", more + 1)):
                old = getattr(self, name)
                setattr(self, name, np.zeros(size, old.dtype))
                getattr(self, name)[: len(old)] = old
        self.words[t0:t1] = words
        steps = np.full(len(words), BASE, np.uint64)
        self.powers[0] = 1
        self.powers[t0 + 1 : t1 + 1] = np.multiply.accumulate(steps) * self.powers[t0]
        self.prefix[t0 + 1 : t1 + 1] = np.add.accumulate(mixed(words) * self.powers[t0:t1]) + self.prefix[t0]
        self.n = t1

    def _same(self, i: np.ndarray, j: np.ndarray, size) -> np.ndarray:
        """Whether the words from i on and from j on (i < j) are the same for `size` words, by their hash."""
        p = self.prefix
        return (p[i + size] - p[i]) * self.powers[j - i] == p[j + size] - p[j]

    def _forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on and from j on agree, up to the stream's end."""
        out = np.zeros(len(i), np.int64)
        step = 1 << min(self.n - int(j.min()), self.longest).bit_length() if len(j) else 0
        while step:
            rest = np.flatnonzero(j + out + step <= self.n)
            rest = rest[self._same(i[rest] + out[rest], j[rest] + out[rest], step)]
            out[rest] += step
            step >>= 1
        return out

    def _backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j agree."""
        out = np.zeros(len(i), np.int64)
        step = 1 << min(int(i.max()), self.longest).bit_length() if len(i) else 0
        while step:
            rest = np.flatnonzero(i - out - step >= 0)
            rest = rest[self._same(i[rest] - out[rest] - step, j[rest] - out[rest] - step, step)]
            out[rest] += step
            step >>= 1
        return out

    def _slice(self, words: np.ndarray) -> None:
        if not len(words):
            return
        t0 = self.n
        self._grow(words)
        if len(self.open):
            self.open[:, 1] += self._forward(self.open[:, 1] - self.open[:, 2], self.open[:, 1])
            self._close(self.open)
        j = np.arange(max(1, t0), self.n)
        j = j[self.words[j] == self.words[j - 1]]
        j = j[np.diff(j, prepend=-2) > 1]  # the first of each stretch of one word
        self._widen(j - 1, j, 1)
        k = 1
        while 3 * k <= min(self.n, self.longest):
            self._level(k, t0)
            k *= 2

    def _level(self, k: int, t0: int) -> None:
        """Compares the suffixes of k words that end in the words from t0 on with the two blocks 2k to 4k words before them."""
        first, last = max(2 * k, t0 - k + 1), self.n - k
        if first > last:
            return
        r0, r1 = first // k, last // k + 1
        p = self.prefix
        suffix = (p[r0 * k + k : r1 * k + k] - p[r0 * k : r1 * k]).reshape(r1 - r0, k)
        starts, lags = [], []
        for c in (2, 3):
            r = max(r0, c)
            if r >= r1:
                continue
            edges = p[(r - c) * k : (r1 - c) * k + 1 : k]
            block = edges[1:] - edges[:-1]
            hit = np.flatnonzero((block[:, None] * self.powers[c * k : c * k + k][None, :] == suffix[r - r0 :]).ravel())
            j = hit + r * k
            j = j[(j >= first) & (j <= last)]
            b = (j // k - c) * k
            starts.append(b)
            lags.append(j - b)
        b, q = np.concatenate(starts), np.concatenate(lags)
        if len(b):
            known = np.concatenate([self.done, self.open[self._is_run(self.open)]])
            known = known[known[:, 2] <= k]
            if len(known):
                known = known[np.argsort(known[:, 0], kind="stable")]
                at = np.searchsorted(known[:, 0], b, "right") - 1
                inside = (at >= 0) & (np.maximum.accumulate(known[:, 1])[at] >= b + q + k)
                b, q = b[~inside], q[~inside]
            self._widen(b, b + q, k)

    def _is_run(self, s: np.ndarray) -> np.ndarray:
        return s[:, 1] - s[:, 0] >= np.maximum(self.track, 2 * s[:, 2])

    def _widen(self, b: np.ndarray, j: np.ndarray, size: int) -> None:
        if not len(b):
            return
        found = np.stack([b - self._backward(b, j), j + size + self._forward(b + size, j + size), j - b], axis=1)
        self._close(np.concatenate([self.open, found]))

    def _close(self, stretches: np.ndarray) -> None:
        stretches = np.unique(stretches, axis=0)
        goes_on = stretches[:, 1] == self.n
        self.open, ended = stretches[goes_on], stretches[~goes_on]
        ended = ended[self._is_run(ended)]
        if len(ended):
            self.done = np.unique(np.concatenate([self.done, ended]), axis=0)

    def _exact(self, start: int, end: int, q: int) -> Iterator[tuple[int, int, int]]:
        """The stretch itself if its words keep the period and its neighbours don't; else what the words show of this period."""
        w, n = self.words, self.n
        if np.array_equal(w[start : end - q], w[start + q : end]) and (not start or w[start - 1] != w[start - 1 + q]) and (end == n or w[end] != w[end - q]):
            yield start, end, q
            return
        same = np.flatnonzero(np.diff((w[: n - q] == w[q:n]).astype(np.int8), prepend=0, append=0))
        yield from ((int(s), int(e) + q, q) for s, e in zip(same[::2], same[1::2], strict=True))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run so far, by start, then period."""
        least: dict[tuple[int, int], int] = {}
        both = np.concatenate([self.done, self.open])
        for s, e, q in both[self._is_run(both)].tolist():
            for start, end, period in self._exact(s, e, q):
                if end - start >= max(self.least, 2 * period):
                    least[start, end] = min(period, least.get((start, end), period))
        return sorted((s, e - s, q) for (s, e), q in least.items())


def words_of(text: bytes, number: dict[bytes, int]) -> np.ndarray:
    """Numbers of a text's words (parted by ASCII white space), a piece of the text at a time; new words get the next number."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in b" \t\n\r\v\f":
            end += 1
        words = text[at:end].split()
        out.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.int64)


def collapsed(words: np.ndarray, runs: list[tuple[int, int, int]], names: list[bytes]) -> bytes:
    """The words outside what follows each run's first period."""
    if runs:
        gone = np.zeros(len(words), bool)
        for start, length, period in runs:
            gone[start + period : start + length] = True
        words = words[~gone]
    return b" ".join([names[i] for i in words.tolist()])


def documents_runs(texts: Iterable[bytes], least: int = LEAST, stream: int = STREAM) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs, collapsed text) of each text; as many texts as make `stream` words share a stream."""
    number: dict[bytes, int] = {}
    held: list[np.ndarray] = []

    def done() -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
        catch = SquareCatchers(least, max(map(len, held)))
        ends = np.cumsum([len(w) + 1 for w in held])
        parted = [x for i, w in enumerate(held) for x in (w, np.array([-1 - i]))]
        catch.append(np.concatenate(parted))
        own: list[list[tuple[int, int, int]]] = [[] for _ in held]
        for start, length, period in catch.runs():
            at = int(np.searchsorted(ends, start, "right"))
            own[at].append((start - (int(ends[at - 1]) if at else 0), length, period))
        names = list(number)
        for w, r in zip(held, own, strict=True):
            yield len(w), r, collapsed(w, r, names)

    size = 0
    for text in texts:
        held.append(words_of(text, number))
        size += len(held[-1]) + 1
        if size >= stream:
            yield from done()
            held, size = [], 0
            number.clear()
    if held:
        yield from done()


def found_runs(least: int = LEAST):
    """The function of a text column, in Arrow batches."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(one)), ("collapsed", pa.string())])
        for batch in batches:
            texts = batch.cast(pa.large_binary())
            n, offsets, flat, kept = [], [0], [], []
            for words, runs, text in documents_runs((x.as_py() or b"" for x in texts), least):
                n.append(words)
                flat += runs
                offsets.append(len(flat))
                kept.append(text)
            parts = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
            runs_of = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(one)))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), runs_of, pa.array(kept, pa.binary()).cast(pa.string())], fields=list(kind))

    return F.arrow_udf(run, FOUND)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_words, runs, collapsed) of each row: its maximal runs of at least `least` words and two periods, and its text with
    one space between the words and only the first period of each run."""
    found = docs.select(F.col(id_col), found_runs(least)(F.col(text_col)).alias("found"))
    return found.select(id_col, "found.n_words", "found.runs", "found.collapsed")


def with_planted_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text), the contract's input: where the id's checksum ends in 0, the words from some place on repeat what is there.

    Words and numbers are columns of their own, as a lambda would make them anew for each word.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    planted = F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False))
    split = F.when(planted, F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    parted = docs.select(F.col(id_col), F.col(text_col).alias("text"), split.alias("words"), F.floor(h / 10).alias("g")).withColumn("n", F.size("words"))
    placed = parted.withColumn("a", F.when(F.col("n") > 0, F.pmod("g", "n")).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod(F.col("g"), F.lit(8))))).cast("int"))
    tail = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda i: F.element_at("words", F.col("a") + F.pmod(i, F.col("p")) + 1))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return placed.select(id_col, F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of what periodic_runs() gives."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    made = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
    start, period, length = -F.col("m.start"), -F.col("m.period"), F.col("m.length")
    exponent = F.expr("(1000 * m.length) DIV (-m.period)")
    return made.select(id_col, "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
