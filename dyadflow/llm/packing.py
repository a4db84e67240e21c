"""Packing of tokenised documents into sequences of a fixed length, online and with bounded space.

Each task keeps a fixed number of open windows. A document's last piece (longer ones are first cut into full windows) goes
whole into the open window that it fills best; if it fits none, the fullest window is emitted and a new one is opened. What
is open at the end of a task is its leftovers. They are sent on with their token ids, gathered for a fixed number of tasks,
laid best-fit-decreasing into new windows, and the windows that stay well short of full are joined end to end, cutting
pieces where a sequence ends, so that each such group leaves one sequence with padding.

Token ids are made per distinct word and remembered, within a number of bytes: the tokenizer drops white space and never
looks across it, so a text's ids are the ids of its words one after the other.

Defined results: null text counts as empty and gives the closing id alone; repeated rows are packed once each; null ids stay
null; an empty table gives no rows; extra columns are ignored. Texts are tokenised whole, whatever their length.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PLACED = PIECE + ", merge_group long, ids binary"
#: ASCII marks that the tokenizer always parts from letters before them.
MARKS = b".,;:!?%&$#*|)"
#: Letters of text that are split into words at a time, and what parts words.
SLICE, BLANK = 1 << 20, re.compile("[ \\t\\n\\r\\x0b\\x0c]")
#: Sequence ids: the task, then the window within the task; those of the merge start above all of these.
WINDOWS_PER_TASK, MERGED = 1 << 30, 1 << 60


class Memory:
    """Ids by word within about `limit` bytes: what was not asked for while half of it filled up is forgotten."""

    #: About what a key and its value take in a dict beside their letters and ids.
    ENTRY = 170

    def __init__(self, limit: int):
        self.young: dict = {}
        self.old: dict = {}
        self.limit, self.used = limit, 0

    def missing(self, keys: set) -> list:
        """Those of the keys that are not known; the others can be read from `young` until the next call."""
        if self.used > self.limit // 2:
            self.old, self.young, self.used = self.young, {}, 0
        young, old = self.young, self.old
        away = [key for key in keys if key not in young]
        self.add({key: old[key] for key in away if key in old})
        return [key for key in away if key not in old]

    def add(self, found: dict) -> None:
        self.young.update(found)
        self.used += sum(map(len, found)) + sum(map(len, found.values())) + self.ENTRY * len(found)


class WordTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, with a memory of words bounded in bytes."""

    def __init__(self, path: str, remember: int = 200_000_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.words, self.cores = Memory(remember), Memory(remember // 2)
        self.marks: dict[bytes, bytes] = {b"": b""}
        self.longest = longest

    def alone(self, words: list[bytes]) -> list[bytes]:
        encoded = self.model.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in encoded]

    def letters(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words of letters alone, many to a call: the tokenizer takes each as a word of its own."""
        found: dict[bytes, bytes] = {}
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            encoded = self.model.encode(b" ".join(some).decode("utf-8"), add_special_tokens=False)
            of, ids = np.array(encoded.word_ids), np.array(encoded.ids, "<u4").tobytes()
            edges = [0, *(4 * (np.flatnonzero(of[1:] != of[:-1]) + 1)).tolist(), len(ids)]
            if len(edges) == len(some) + 1:
                found.update(zip(some, [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)], strict=True))
            else:
                found.update(zip(some, self.alone(some), strict=True))
        return found

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words not met before. Letters with a few ASCII marks after them are put together from the two parts."""
        parts: dict[bytes, tuple[bytes, bytes]] = {}
        other: list[bytes] = []
        longest = self.longest
        for w in words:
            core = w.rstrip(MARKS)
            mark = w[len(core) :]
            if len(core) > longest or len(mark) > 4:
                other.append(w)
            elif core.isalpha():  # ASCII letters alone, of which the tokenizer takes capitals for small ones
                parts[w] = core.lower(), mark
            elif (text := core.decode("utf-8")).isalpha() and is_normalized("NFC", text):
                parts[w] = core, mark
            else:
                other.append(w)
        if cores := self.cores.missing({c for c, _ in parts.values()}):
            self.cores.add(self.letters(sorted(cores)))
        if len(self.marks) > 10_000:
            self.marks = {b"": b""}
        ends = sorted({m for _, m in parts.values()} - self.marks.keys())
        self.marks.update(zip(ends, self.alone(ends), strict=True))
        known, marks = self.cores.young, self.marks
        found = {w: known[c] + marks[m] if m else known[c] for w, (c, m) in parts.items()}
        found.update(zip(other, self.alone(other), strict=True))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of a few texts."""
        split = [t.encode("utf-8", "replace").split() for t in texts]
        long: dict[bytes, bytes] = {}
        if new := self.words.missing(set().union(*split)):
            found = self.learn(new)
            long = {w: found.pop(w) for w in new if len(w) > self.longest}
            self.words.add(found)
        known = self.words.young | long if long else self.words.young
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def encode_each(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of one text after the other; texts are split into words SLICE letters at a time, long ones in stretches."""
        some: list[str] = []
        size = 0
        for text in texts:
            if len(text) > SLICE:
                yield from self.encode(some)
                some, size = [], 0
                yield b"".join(ids for part in stretches(text) for ids in self.encode([part]))
                continue
            some.append(text)
            size += len(text)
            if size > SLICE:
                yield from self.encode(some)
                some, size = [], 0
        yield from self.encode(some)


def stretches(text: str) -> Iterator[str]:
    """A long text, cut at white space."""
    at = 0
    while at < len(text):
        gap = BLANK.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def texts_of(batch: pa.RecordBatch, column: str, rows: int = 64) -> Iterator[str]:
    """The texts of a batch; only a few are strings of Python at a time."""
    for at in range(0, batch.num_rows, rows):
        yield from batch.column(column).slice(at, rows).to_pylist()


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker; path is a file, or the bare name of a file of the installed vocabulary package."""
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if "/" in path:
            _TOKENIZERS[path] = WordTokenizer(path)
        else:
            import public_tokenizers

            _TOKENIZERS[path] = WordTokenizer(public_tokenizers.path(path))
    return _TOKENIZERS[path]


class OpenWindows:
    """At most `most` open windows, kept by free space."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.free: list[tuple[int, int]] = []  # (free space, window), sorted
        self.pieces: dict[int, list] = {}
        self.next = 0

    def place(self, piece: tuple, length: int) -> list | None:
        """Put a piece where it fits best; returns the pieces of a window that had to be emitted."""
        out = None
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                _, fullest = self.free.pop(0)
                out = (fullest, self.pieces.pop(fullest))
            room, window = self.size, self.next
            self.next += 1
            self.pieces[window] = []
        self.pieces[window].append((piece, self.size - room, length))
        if room > length:
            insort(self.free, (room - length, window))
        else:
            full = (window, self.pieces.pop(window))
            assert out is None or room == self.size
            return [x for x in (out, full) if x]
        return [out] if out else []


def pack_partition(path: str, size: int, open_windows: int, end_id: int, tasks_per_merge: int):
    """mapInArrow: (doc_id, text) to PLACED, the pieces of emitted windows and, without a sequence, the leftovers."""
    tail = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encode = tokenizer(path).encode_each
        windows = OpenWindows(size, open_windows)
        rows: list[tuple] = []

        def emit(window: int, pieces: list) -> None:
            for (doc, start, tokens, ids), offset, length in pieces:
                rows.append((doc, start, length, zlib.crc32(ids), tokens, task * WINDOWS_PER_TASK + window, offset, None, None))

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts_of(batch, "text")), strict=True):
                ids += tail
                tokens = len(ids) // 4
                for start in range(0, tokens, size):
                    part = ids[4 * start : 4 * (start + size)]
                    for window in windows.place((doc, start, tokens, part), len(part) // 4):
                        emit(*window)
                if len(rows) > 10_000:
                    yield frame(rows)
                    rows.clear()
        for _, pieces in sorted(windows.pieces.items()):
            for (doc, start, tokens, ids), _, length in pieces:
                rows.append((doc, start, length, zlib.crc32(ids), tokens, None, None, task // tasks_per_merge, ids))
        yield frame(rows)

    return run


def frame(rows: list[tuple]) -> pa.RecordBatch:
    fields = [c.split() for c in PLACED.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(values), pa.binary() if kind == "binary" else pa.int64()) for values, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def merge_leftovers(size: int, well_filled: float):
    """Best-fit-decreasing over the leftover pieces of one group; windows short of `well_filled` are joined and cut."""

    def merged(group: int, left: list[tuple]) -> list[tuple]:
        left.sort(key=lambda p: (-p[1], p[0] is None, p[0] or 0, p[2]))
        bins = OpenWindows(size, len(left) + 1)
        closed: list[list] = []
        for doc, length, start, tokens, ids in left:
            closed += [pieces for _, pieces in bins.place((doc, start, tokens, ids), length)]
        loose = []
        for _, pieces in sorted(bins.pieces.items()):
            if sum(p[2] for p in pieces) >= well_filled * size:
                closed.append(pieces)
            else:
                loose += [p[0] for p in pieces]
        joined: list = []
        room = size
        for doc, start, tokens, ids in loose:
            while ids:
                part, ids = ids[: 4 * room], ids[4 * room :]
                joined.append(((doc, start, tokens, part), size - room, len(part) // 4))
                start += len(part) // 4
                room -= len(part) // 4
                if not room:
                    closed.append(joined)
                    joined, room = [], size
        if joined:
            closed.append(joined)
        first = MERGED + group * WINDOWS_PER_TASK
        return [(doc, start, length, zlib.crc32(ids), tokens, first + i, offset) for i, pieces in enumerate(closed) for (doc, start, tokens, ids), offset, length in pieces]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PIECE.split(", ")]
        current, left = None, []
        for batch in batches:
            done = batch["merge_group"].isna()
            if done.any():
                yield batch.loc[done, names]
            rest = batch[~done]
            out: list[tuple] = []
            for doc, length, start, tokens, group, ids in zip(rest["doc_id"], rest["length"], rest["start"], rest["doc_tokens"], rest["merge_group"], rest["ids"], strict=True):
                if group != current and left:
                    out += merged(int(current), left)
                    left = []
                current = group
                left.append((None if pd.isna(doc) else int(doc), int(length), int(start), int(tokens), bytes(ids)))
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
        if left:
            yield pd.DataFrame(merged(int(current), left), columns=names).astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, open_windows: int = 64, end_id: int = 2, tasks_per_merge: int = 8, well_filled: float = 0.99) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of sequences of at most `size` tokens."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = rows.mapInArrow(pack_partition(tokenizer_path, size, open_windows, end_id, tasks_per_merge), PLACED)
    # closed pieces are dealt out by their sequence, leftovers by their group: no key holds more than a group's bounded rows
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(parts, F.coalesce("merge_group", "sequence_id")).sortWithinPartitions("merge_group")
    return dealt.mapInPandas(merge_leftovers(size, well_filled), PIECE)
