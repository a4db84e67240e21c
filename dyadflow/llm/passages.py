"""Removal of passages that recur, word for word, anywhere in the corpus.

A window is a run of `length` words. Windows that start in two places or more are confirmed through `repeats`; maximal runs
of confirmed windows are the recurring passages. Those that a bucket of documents holds are compiled into Aho-Corasick
automata of bounded size, and all documents of the bucket are streamed through them to locate every occurrence; the words
that an occurrence covers are removed.

Defined results: null text has no words; a document of fewer words than a window loses none; repeated rows are two places;
null ids stay null; an empty table gives no rows; extra columns are ignored. Windows are judged on the input alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadflow.llm.common import id_or_null
from dyadflow.llm.repeats import CROWD, Bucket, Stretches, Windows, marked_windows, repeated_windows

RESULT = "id long, n_words long, n_removed long, kept_sha256 string"


def occurs_twice(found: Stretches) -> np.ndarray:
    """Marks windows whose words occur at two places: equal under two independent 64-bit fingerprints."""
    units = found.units
    marked = np.zeros(units.n, bool)
    starts = np.flatnonzero(units.window_starts())
    if not len(starts):
        return marked
    one, two = units.fingerprints(1)[starts], units.fingerprints(2)[starts]
    order = np.lexsort((two, one))
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    marked[starts[order[twice]]] = True
    marked[starts] |= np.repeat(found.multi, units.last - units.first - units.rule.length + 1)
    return marked


def passages(bucket: Bucket, marked: np.ndarray) -> list[str]:
    """The different recurring passages of a bucket, each between single spaces; a byte is a character."""
    # a run of windows ends where the next text begins, for no window starts in a text's last words
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    a, b = bucket.units.span(edge[::2], edge[1::2] - 1)
    text = bucket.units.buffer
    return sorted({f" {text[i:j].decode('latin-1')} " for i, j in zip(a.tolist(), b.tolist(), strict=True)})


def automata(phrases: list[str], letters: int) -> Iterator[ahocorasick.Automaton]:
    """Automata over all phrases, each of about `letters` letters at most (one phrase at least)."""
    at = 0
    while at < len(phrases):
        built, size = ahocorasick.Automaton(), 0
        while at < len(phrases) and (not size or size + len(phrases[at]) <= letters):
            built.add_word(phrases[at], len(phrases[at]))
            size += len(phrases[at])
            at += 1
        built.make_automaton()
        yield built


def locate(texts: list[bytes], phrases: list[str], letters: int) -> list[np.ndarray]:
    """For each text, the letters (of the text with a space at either end) that an occurrence of a phrase covers, as marks."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for automaton in automata(phrases, letters):
        for own, text in zip(spans, texts, strict=True):
            last = None
            for end, n in automaton.iter(f" {text.decode('latin-1')} "):
                start = end - n + 1
                # runs of matches are joined as they come
                if last and start <= last[1]:
                    last = (min(start, last[0]), end)
                else:
                    if last:
                        own.append(last)
                    last = (start, end)
            if last:
                own.append(last)
    out = []
    for own, text in zip(spans, texts, strict=True):
        change = np.zeros(len(text) + 3, np.int32)
        for a, b in own:
            change[a] += 1
            change[b + 1] -= 1
        out.append(np.cumsum(change)[:-1] > 0)
    return out


def finish(letters: int):
    def run(bucket: Bucket, answers: pd.DataFrame) -> pd.DataFrame:
        phrases = passages(bucket, marked_windows(bucket, answers, first_stays=False))
        rows = []
        for doc, text, hit in zip(bucket.ids.tolist(), bucket.texts, locate(bucket.texts, phrases, letters), strict=True):
            words = text.split()
            kept = text
            removed = 0
            if hit.any():
                ends = np.cumsum([len(w) + 1 for w in words])
                gone = hit[ends - 1]  # the mark of a word's last letter
                removed = int(gone.sum())
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
            rows.append((doc, len(words), removed, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return run


def remove_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, anchor: int = 8, bucket_bytes: int = 4_000_000, letters: int = 1_000_000, crowd: int = CROWD) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256."""
    found = repeated_windows(docs, id_col, text_col, Windows("word", length, anchor), occurs_twice, finish(letters), RESULT, bucket_bytes, crowd)
    return found.select(id_or_null("id").alias(id_col), *[F.col(c) for c in ("n_words", "n_removed", "kept_sha256")])
