"""Removal of long byte strings that an earlier document holds, by a logarithmic family of suffix arrays.

Documents are ordered by id. Candidate stretches of text come from `repeats`, sharded by content. In a shard they are taken
in batches of rising id: a batch gets its suffix array, is scanned against each level of the index in one merge, so that
every suffix finds the earliest document with the same first `length` bytes, and then becomes a level itself; levels of
about the same size are merged, so that there are logarithmically many.

Suffixes are ordered and compared by their first `length` bytes, as bytes. A shard goes through the index in ranges of that
order, one after the other, so that no more than about `most` suffixes are held as strings at a time.

Defined results: null text counts as empty; a text shorter than `length` bytes loses none; documents of one id do not take
from each other; null ids come last and stay null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadflow.llm.common import id_or_null
from dyadflow.llm.repeats import CROWD, Bucket, Stretches, Windows, covered, marked_windows, repeated_windows

RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def beginnings(data: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """The first `length` bytes of the suffixes at these places, as strings that numpy orders bytewise."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[place]).view(f"S{length}").ravel()


@dataclass
class SuffixArray:
    """Places of suffixes in the order of their text, those with the same beginning once, with their earliest document.

    The order is that of the first `length` bytes: what comes after them decides no match. Two neighbours whose common
    prefix is that long are one entry, so the array of common prefixes need not be kept.
    """

    place: np.ndarray
    doc: np.ndarray

    @classmethod
    def built(cls, place: np.ndarray, doc: np.ndarray, text: np.ndarray) -> tuple[SuffixArray, np.ndarray]:
        """The array of suffixes that begin with `text`, and the entry of each."""
        order = np.argsort(text, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = text[order[1:]] != text[order[:-1]]
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        edge = np.flatnonzero(new)
        return cls(place[order[edge]], np.minimum.reduceat(doc[order], edge)), entry

    def merged(self, other: SuffixArray, data: np.ndarray, length: int) -> SuffixArray:
        """Both arrays in one order; an entry of both keeps the earlier document."""
        mine, theirs = (beginnings(data, x.place, length) for x in (self, other))
        at = np.searchsorted(mine, theirs)
        found = np.minimum(at, len(mine) - 1)
        both = mine[found] == theirs
        doc = self.doc.copy()
        np.minimum.at(doc, found[both], other.doc[both])
        return SuffixArray(np.insert(self.place, at[~both], other.place[~both]), np.insert(doc, at[~both], other.doc[~both]))

    def earliest(self, text: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
        """For beginnings in order, the earliest document that has them; the largest number where there is none."""
        mine = beginnings(data, self.place, length)
        at = np.minimum(np.searchsorted(mine, text), len(mine) - 1)
        return np.where(mine[at] == text, self.doc[at], NEVER)


class LogarithmicIndex:
    """Suffix arrays of geometrically growing sizes over one text; batches come in the order of their documents."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.levels: list[SuffixArray] = []

    def add(self, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Take in a batch; returns, for each of its suffixes, the earliest document with the same beginning."""
        batch, entry = SuffixArray.built(place, doc, beginnings(self.data, place, self.length))
        text, first = beginnings(self.data, batch.place, self.length), batch.doc.copy()
        for level in self.levels:
            first = np.minimum(first, level.earliest(text, self.data, self.length))
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2].place) <= 2 * len(self.levels[-1].place):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last, self.data, self.length)
        return first[entry]


NEVER = np.iinfo(np.int64).max


def parts_by_beginning(data: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """(part of each suffix, number of parts): ranges of the suffixes' order, by their first bytes, of about `most` each."""
    n = len(starts) // most + 1
    if n == 1:
        return np.zeros(len(starts), np.uint16), 1
    head = lambda place: beginnings(data, place, 8).view(">u8").astype(np.uint64)
    seen = np.sort(head(starts[:: max(1, len(starts) // 100_000)]))
    cuts = np.unique(seen[np.arange(1, n) * len(seen) // n])
    return np.concatenate([np.searchsorted(cuts, head(starts[a : a + most]), side="right").astype(np.uint16) for a in range(0, len(starts), most)]), len(cuts) + 1


def earlier_document(batch: int, most: int):
    """`batch` suffixes or so, of whole documents, are taken in at a time; `most` suffixes or so, a range of their order, are held at a time."""

    def decide(found: Stretches) -> np.ndarray:
        """Marks windows that also start in a document with a smaller id."""
        units, length = found.units, found.units.rule.length
        marked = np.zeros(units.n, bool)
        starts = np.flatnonzero(units.window_starts()).astype(np.uint32)
        if not len(starts):
            return marked
        n = np.maximum(units.last - units.first - length + 1, 0)
        of = np.repeat(np.arange(len(n), dtype=np.uint32), n)
        part, parts = parts_by_beginning(units.data, starts, most)
        order = np.argsort(found.ids, kind="stable")
        turn = np.empty(len(n), np.int64)
        turn[order] = (np.cumsum(n[order]) - 1) // (batch * parts)
        for p in range(parts):
            inside = np.flatnonzero(part == p)
            own_turn = turn[of[inside]]
            index = LogarithmicIndex(units.data, length)
            for t in np.unique(own_turn):
                own = inside[own_turn == t]
                doc = found.ids[of[own]]
                marked[starts[own]] = index.add(starts[own], doc) < doc
        return marked

    return decide


def finish(bucket: Bucket, answers: pd.DataFrame) -> pd.DataFrame:
    units = bucket.units
    gone = covered(units, marked_windows(bucket, answers, first_stays=True))
    rows = []
    for doc, text, a, b in zip(bucket.ids.tolist(), bucket.texts, units.first.tolist(), units.last.tolist(), strict=True):
        own = gone[a:b]
        removed = int(own.sum())
        spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if removed else 0
        kept = units.data[a:b][~own].tobytes() if removed else text
        rows.append((doc, len(text), removed, spans, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])


def remove_earlier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, anchor: int = 16, batch: int = 60_000, most: int = 200_000, bucket_bytes: int = 4_000_000, crowd: int = CROWD) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = repeated_windows(docs, id_col, text_col, Windows("byte", length, anchor), earlier_document(batch, most), finish, RESULT, bucket_bytes, crowd)
    return found.select(id_or_null("id").alias(id_col), *[F.col(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])
