"""Finding all repeated windows of a corpus: sequences of a fixed number of words, or of bytes, that start in several places.

Sending every window through a shuffle would cost many times the corpus. Each window therefore belongs to an anchor: the
run of `anchor` units in it with the smallest hash. Equal windows have equal anchors, and neighbouring windows share
theirs, so that only one position in about twelve is an anchor. Documents are dealt into buckets of bounded size by a hash
of their id and text, and three rounds follow.

1. Each bucket sends the set of its anchors' hashes, with the number of different stretches around each, to shards cut by
   hash. A shard answers which of them occur twice, and which are crowded: have more than `crowd` stretches in all.
2. Each bucket sends, for these alone, the stretch of text that the anchor's windows cover, once for each different
   stretch. A shard holds all windows of its anchors, decides on each by the method of the operator at hand, and answers
   with a bit for each window. Windows of crowded anchors go singly, once for each different window of a bucket, to the
   shard of their own fingerprint.
3. Each bucket turns these bits into covered units of its documents.

All that moves beside the documents, which are dealt out once, is a few bytes for each anchor and the text of recurring
ones. Hashes spread evenly over shards; a stretch that a third of all documents share is sent once by each bucket, and one
that they hold in different surroundings is crowded, so no shard gets a row for each document. Nothing is capped: an anchor hash that collides only costs a needless answer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadflow.llm.common import id_or_last

U = np.uint64
_RANDOM = np.random.default_rng(20240521)
#: One random number for each byte, and odd multipliers, for anchors (0) and for two window fingerprints (1, 2).
TABLE = _RANDOM.integers(0, 2**64, size=(3, 256), dtype=U)
ODD = _RANDOM.integers(0, 2**64, size=(3, 8), dtype=U) | U(1)
WORD_POWERS = _RANDOM.integers(0, 2**64, size=3, dtype=U) | U(1)
#: Units that are hashed at a time: a processor's cache holds their hashes, and a very long text needs no more memory.
STRETCH = 1 << 15
#: Different stretches of one anchor beyond which its windows are dealt out singly.
CROWD = 2000
ASK = "shard int, bucket long, single boolean, which binary, ids binary, lens binary, multi binary, text binary"


@dataclass(frozen=True)
class Windows:
    """What a window is: `length` units, found through anchors of `anchor` units (a power of two)."""

    unit: str  # "word" or "byte"
    length: int
    anchor: int


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


def word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of text in which single spaces part them."""
    gap = np.flatnonzero(text == 32)
    starts, ends = np.append(0, gap + 1), np.append(gap, len(text))
    keep = ends > starts
    return starts[keep], ends[keep]


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A hash for each word, made in stretches of whole words."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + STRETCH)))
        lens = ends[at:to] - starts[at:to]
        first = np.cumsum(lens) - lens
        inside = np.arange(int(lens.sum())) - np.repeat(first, lens)
        powers = np.cumprod(np.full(int(lens.max()), WORD_POWERS[which], U))
        letters = text[starts[at] : ends[to - 1]]
        letters = letters[letters != 32]
        out[at:to] = mix(np.add.reduceat(TABLE[which][letters] * powers[inside], first) + lens.astype(U))
        at = to
    return out


def joined(h: np.ndarray, length: int, which: int) -> np.ndarray:
    """Hashes of all runs of `length` units, put together from runs whose lengths are powers of two."""
    powers, size, j = {1: h}, 1, 0
    while size * 2 <= length:
        h = h[:-size] * ODD[which][j] + h[size:]
        size, j = size * 2, j + 1
        powers[size] = h
    done, out = size, powers[size]
    while done < length:
        part = 1 << ((length - done).bit_length() - 1)
        more = powers[part][done:]
        n = min(len(out), len(more))
        out = out[:n] * ODD[which][6] + more[:n]
        done += part
    return mix(out[: len(powers[1]) - length + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


class Units:
    """Texts laid end to end and cut into units; `first` and `last` bound each text's units."""

    def __init__(self, texts: list[bytes], rule: Windows):
        self.rule = rule
        self.buffer = (b" " if rule.unit == "word" else b"").join(texts)
        data = np.frombuffer(self.buffer, np.uint8)
        self.data = data
        if rule.unit == "word":
            self.starts, self.ends = word_bounds(data)
            edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
            bounds = np.searchsorted(self.starts, edges)
        else:
            self.starts = self.ends = None
            bounds = np.cumsum([0, *map(len, texts)])
        self.first, self.last = bounds[:-1], bounds[1:]
        self.n = int(bounds[-1])

    def hashes(self, which: int, a: int, b: int) -> np.ndarray:
        if self.starts is None:
            return TABLE[which][self.data[a:b]]
        return word_hashes(self.data, self.starts[a:b], self.ends[a:b], which)

    def window_starts(self) -> np.ndarray:
        """Marks the units at which a whole window begins."""
        valid = np.zeros(self.n + 1, np.int8)
        long = self.last - self.first >= self.rule.length
        np.add.at(valid, self.first[long], 1)
        np.add.at(valid, self.last[long] - self.rule.length + 1, -1)
        return np.cumsum(valid[:-1], dtype=np.int8).view(bool)

    def fingerprints(self, which: int) -> np.ndarray:
        """Fingerprints of all runs of a window's length, also across texts (see window_starts)."""
        length, out = self.rule.length, []
        for a in range(0, self.n - length + 1, STRETCH):
            out.append(joined(self.hashes(which, a, min(self.n, a + STRETCH + length - 1)), length, which))
        return np.concatenate(out) if out else np.empty(0, U)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first window, last window) of each anchor, in order."""
        rule, valid = self.rule, self.window_starts()
        width = rule.length - rule.anchor + 1
        hashes, firsts, lasts = [], [], []
        for a in range(0, self.n - rule.length + 1, STRETCH):
            h = joined(self.hashes(0, a, min(self.n, a + STRETCH + rule.length - 1)), rule.anchor, 0)
            place = np.arange(len(h), dtype=U)
            best = sliding_min((h & ~U(0xFFFFFFFF)) | place, width) & U(0xFFFFFFFF)
            own = valid[a : a + len(best)]
            # an anchor's windows are consecutive: its first comes after another anchor's, or after no window, and so on
            differs = best[1:] != best[:-1]
            first = np.flatnonzero(own & np.concatenate([[True], differs | ~own[:-1]]))
            last = np.flatnonzero(own & np.concatenate([differs | ~own[1:], [True]]))
            hashes.append(h[best[first].astype(np.int64)])
            firsts.append(a + first)
            lasts.append(a + last)
        if not hashes:
            return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)

    def span(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the buffer the windows first .. last lie."""
        end = last + self.rule.length
        return (first, end) if self.starts is None else (self.starts[first], self.ends[end - 1])


class Bucket:
    """The documents of one bucket, by id, with their anchors."""

    def __init__(self, docs: pd.DataFrame, rule: Windows):
        docs = docs.sort_values("id", kind="stable")
        self.ids = docs["id"].to_numpy(np.int64)
        raw = [t.encode("utf-8", "replace") for t in docs["text"]]
        self.texts = [b" ".join(t.split()) for t in raw] if rule.unit == "word" else raw
        self.units = Units(self.texts, rule)
        self.hash, self.begin, self.end = self.units.anchors()
        self.doc = np.searchsorted(self.units.first, self.begin, side="right") - 1
        # texts without a unit share their first unit with the next text: the last of them is the one that holds it

    def stretches(self, chosen: np.ndarray) -> list[bytes]:
        a, b = self.units.span(self.begin[chosen], self.end[chosen])
        text = self.units.buffer
        return [text[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Anchors' hashes are minima and lie close to 0, so they are mixed anew before they are dealt out."""
    return (((mix(hashes * ODD[0][7]) >> U(32)) * U(shards)) >> U(32)).astype(np.int64)


def by_shard(shard: np.ndarray) -> list[tuple[int, slice]]:
    """Slices of a sorted array of shards."""
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else np.array([0])
    return [(int(shard[a]), slice(a, b)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


#: An anchor hash as sent: its highest 47 bits, a bit that tells that it occurs twice here, and 16 bits with the number of stretches here.
HASH_BITS, TWICE, COUNT = U(17), U(1 << 16), U(0xFFFF)


def different_stretches(bucket: Bucket, place: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each different anchor hash, the number of different stretches of the bucket's texts around it."""
    count = np.ones(len(n), np.int64)
    again = np.flatnonzero(n[place] > 1)
    if len(again):
        pairs = set(zip(place[again].tolist(), bucket.stretches(again), strict=True))
        many = np.bincount([at for at, _ in pairs], minlength=len(n))
        count = np.maximum(count, many)
    return count


def send_anchors(rule: Windows, shards: int):
    """Round 1, a bucket: each different anchor hash, whether it occurs twice here, and its number of stretches."""

    def run(key, docs: pd.DataFrame) -> pd.DataFrame:
        bucket = Bucket(docs, rule)
        different, place, n = np.unique(bucket.hash, return_inverse=True, return_counts=True)
        count = np.minimum(different_stretches(bucket, place, n), int(COUNT)).astype(U)
        sent = ((different >> HASH_BITS) << HASH_BITS) | np.where(n > 1, TWICE, U(0)) | count
        shard = shard_of(different, shards)
        order = np.argsort(shard, kind="stable")
        rows = [(s, key[0], sent[order[cut]].astype("<u8").tobytes()) for s, cut in by_shard(shard[order])]
        return pd.DataFrame(rows, columns=["shard", "bucket", "sent"])

    return run


def answer_recurring(crowd: int):
    """Round 1, a shard: two bits for each hash sent, set if it occurs twice anywhere, and if it has more than `crowd` stretches."""

    def run(asked: pd.DataFrame) -> pd.DataFrame:
        sent = [np.frombuffer(s, "<u8") for s in asked["sent"]]
        every = np.concatenate(sent)
        values, where, n = np.unique(every >> HASH_BITS, return_inverse=True, return_counts=True)
        recurs = n > 1
        recurs[where[(every & TWICE) != 0]] = True
        crowded = np.bincount(where, (every & COUNT).astype(float), len(values)) > crowd
        bits, singly, at = [], [], 0
        for s in sent:
            own = where[at : at + len(s)]
            bits.append(np.packbits(recurs[own]).tobytes())
            singly.append(np.packbits(crowded[own]).tobytes())
            at += len(s)
        return pd.DataFrame({"bucket": asked["bucket"], "shard": asked["shard"], "bits": bits, "crowded": singly})

    return run


def windows_of(bucket: Bucket, chosen: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(start, text) of the single windows of the chosen anchors, in the order of their documents."""
    n = bucket.end[chosen] - bucket.begin[chosen] + 1
    starts = np.repeat(bucket.begin[chosen], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    a, b = bucket.units.span(starts, starts)
    text = bucket.units.buffer
    return starts, [text[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]


def once_each(places: list[int], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(first place, occurs again, text) of the different texts."""
    seen: dict[bytes, int] = {}
    firsts, multi, different = [], bytearray(), []
    for i, text in zip(places, texts, strict=True):
        at = seen.setdefault(text, len(firsts))
        if at == len(firsts):
            firsts.append(i)
            multi.append(0)
            different.append(text)
        else:
            multi[at] = 1
    return np.array(firsts, np.int64), np.frombuffer(bytes(multi), np.uint8), different


def send_stretches(rule: Windows, shards: int):
    """Round 2, a bucket: each different stretch of a recurring anchor, or window of a crowded one, from the document of the smallest id."""

    def run(key, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in ASK.split(", ")]
        bucket = Bucket(docs, rule) if len(docs) else None
        if bucket is None or not len(bucket.hash):
            return pd.DataFrame([], columns=names)
        different, place = np.unique(bucket.hash, return_inverse=True)
        dealt = shard_of(different, shards)
        turn = np.argsort(dealt, kind="stable")
        cuts = by_shard(dealt[turn])

        def told(column: str) -> np.ndarray:
            bits = dict(zip(answers["shard"], answers[column], strict=True))
            each = np.empty(len(different), bool)
            each[turn] = np.concatenate([np.unpackbits(np.frombuffer(bits[s], np.uint8))[: cut.stop - cut.start] for s, cut in cuts])
            return each[place]

        recurs, crowded = told("bits"), told("crowded")
        rows = []

        def send(single: bool, which: np.ndarray, doc: np.ndarray, shard: np.ndarray, flags: np.ndarray, texts: list[bytes]) -> None:
            order = np.argsort(shard, kind="stable")
            ids = bucket.ids[doc]
            for s, cut in by_shard(shard[order]):
                own = order[cut]
                parts = [texts[i] for i in own]
                rows.append((s, key[0], single, which[own].astype("<u4").tobytes(), ids[own].tobytes(), np.array([len(p) for p in parts], "<u4").tobytes(), flags[own].tobytes(), b"".join(parts)))

        chosen = np.flatnonzero(recurs & ~crowded)
        which, flags, texts = once_each(chosen.tolist(), bucket.stretches(chosen))
        send(False, which, bucket.doc[which], shard_of(bucket.hash[which], shards), flags, texts)
        chosen = np.flatnonzero(recurs & crowded)
        if len(chosen):
            starts, texts = windows_of(bucket, chosen)
            which, flags, texts = once_each(starts.tolist(), texts)
            send(True, which, bucket.doc[np.searchsorted(bucket.begin, which, side="right") - 1], shard_of(bucket.units.fingerprints(1)[which], shards), flags, texts)
        return pd.DataFrame(rows, columns=names)

    return run


@dataclass
class Stretches:
    """All stretches of a shard: their units, and the document and multiplicity of each."""

    units: Units
    ids: np.ndarray
    multi: np.ndarray


def answer_windows(rule: Windows, decide: Callable[[Stretches], np.ndarray]):
    """Round 2, a shard: `decide` marks windows (by the unit at which they start); a bit goes back for each window sent."""

    def run(asked: pd.DataFrame) -> pd.DataFrame:
        texts, sizes = [], []
        for lens, text in zip(asked["lens"], asked["text"], strict=True):
            ends = np.cumsum(np.frombuffer(lens, "<u4").astype(np.int64)).tolist()
            texts += [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            sizes.append(len(ends))
        units = Units(texts, rule)
        found = Stretches(units, np.frombuffer(b"".join(asked["ids"]), np.int64), np.frombuffer(b"".join(asked["multi"]), np.uint8).astype(bool))
        marked = decide(found)
        edges = np.cumsum([0, *sizes])
        bits = []
        valid = units.window_starts()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            lo, hi = (int(units.first[a]), int(units.last[b - 1])) if b > a else (0, 0)
            bits.append(np.packbits(marked[lo:hi][valid[lo:hi]]).tobytes())
        return pd.DataFrame({"bucket": asked["bucket"], "single": asked["single"], "which": asked["which"], "bits": bits})

    return run


def marked_windows(bucket: Bucket, answers: pd.DataFrame, first_stays: bool) -> np.ndarray:
    """Marks the units of a bucket at which a repeated window starts.

    With first_stays, a window counts as repeated if it also starts in a document with a smaller id; else if it starts
    anywhere else.
    """
    marked = np.zeros(bucket.units.n, bool)
    if not len(answers):
        return marked
    single = answers["single"].astype(bool)
    _mark_stretches(bucket, answers[~single], first_stays, marked)
    _mark_singly(bucket, answers[single], first_stays, marked)
    return marked


def _mark_stretches(bucket: Bucket, answers: pd.DataFrame, first_stays: bool, marked: np.ndarray) -> None:
    if not len(answers):
        return
    which = [np.frombuffer(w, "<u4").astype(np.int64) for w in answers["which"]]
    begin, n = bucket.begin, bucket.end - bucket.begin + 1
    bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[: int(n[own].sum())] for own, b in zip(which, answers["bits"], strict=True)]).view(bool)
    first = np.concatenate(which)
    sizes = n[first]
    marked[np.repeat(begin[first] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(bits))] = bits
    # further stretches of the same anchors, which can be copies of those sent
    sent = np.sort(bucket.hash[first])
    at = np.minimum(np.searchsorted(sent, bucket.hash), len(sent) - 1)
    further = sent[at] == bucket.hash
    further[first] = False
    also = np.flatnonzero(further)
    if not len(also):
        return
    source = first[np.isin(bucket.hash[first], bucket.hash[also])]
    known = dict(zip(bucket.stretches(source), source.tolist(), strict=True))
    ids = bucket.ids[bucket.doc]
    for i, text in zip(also.tolist(), bucket.stretches(also), strict=True):
        if (of := known.get(text)) is None:
            continue
        a, b, size = begin[i], begin[of], n[i]
        if not first_stays:
            marked[a : a + size] = marked[b : b + size] = True
        else:
            marked[a : a + size] = True if ids[i] != ids[of] else marked[b : b + size]


def _mark_singly(bucket: Bucket, answers: pd.DataFrame, first_stays: bool, marked: np.ndarray) -> None:
    """The same for the windows of crowded anchors, which were sent one by one."""
    if not len(answers):
        return
    sent = [np.frombuffer(w, "<u4").astype(np.int64) for w in answers["which"]]
    verdict = {i: bool(v) for own, bits in zip(sent, answers["bits"], strict=True) for i, v in zip(own.tolist(), np.unpackbits(np.frombuffer(bits, np.uint8))[: len(own)], strict=True)}
    anchor_of = lambda starts: np.searchsorted(bucket.begin, starts, side="right") - 1
    crowded = np.unique(bucket.hash[anchor_of(np.concatenate(sent))])
    starts, texts = windows_of(bucket, np.flatnonzero(np.isin(bucket.hash, crowded)))
    ids = bucket.ids[bucket.doc[anchor_of(starts)]]
    places: dict[bytes, list[int]] = {}
    for at, text in enumerate(texts):
        places.setdefault(text, []).append(at)
    for own in places.values():
        bit, first = verdict[int(starts[own[0]])], ids[own[0]]
        for at in own:
            marked[starts[at]] = True if (ids[at] != first if first_stays else len(own) > 1) else bit


def covered(units: Units, marked: np.ndarray) -> np.ndarray:
    """Units that lie in a marked window."""
    out, reach = marked.copy(), 1
    while reach < units.rule.length:
        step = min(reach, units.rule.length - reach)
        out[step:] |= out[:-step].copy()
        reach += step
    return out


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, rule: Windows, decide: Callable[[Stretches], np.ndarray], finish: Callable[[Bucket, pd.DataFrame], pd.DataFrame], result: str, bucket_bytes: int = 4_000_000, crowd: int = CROWD) -> DataFrame:
    """Run the three rounds; `finish` turns a bucket and the answers to it into the rows of `result`."""
    rows = docs.select(id_or_last(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // bucket_bytes + 1)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(buckets))).groupBy("bucket")
    sent = dealt.applyInPandas(send_anchors(rule, buckets), "shard int, bucket long, sent binary")
    recurring = sent.groupBy("shard").applyInPandas(answer_recurring(crowd), "bucket long, shard int, bits binary, crowded binary")
    asked = dealt.cogroup(recurring.groupBy("bucket")).applyInPandas(send_stretches(rule, buckets), ASK)
    answers = asked.groupBy("shard").applyInPandas(answer_windows(rule, decide), "bucket long, single boolean, which binary, bits binary")

    def last(key, own: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        return finish(Bucket(own, rule), answered)

    return dealt.cogroup(answers.groupBy("bucket")).applyInPandas(last, result)
