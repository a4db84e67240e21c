"""Exact deduplication through a log-structured merge index of text digests.

Texts are compared without the white space characters U+0020 and U+0009 to U+000D. Each task keeps a memtable from
digest to (best row, count); when it is full, it is flushed as a run sorted by digest, cut at the shard borders, with a
filter of the digests in it. Compaction takes all runs of a shard, lets the filters name the digests that can be in
more than one run, merges those, and keeps for each digest the row with the most code points and then the smallest
identifier. Only digests of more than one document leave compaction; their rows are hits, whose normalised bytes are
compared with the kept row's. Rows that fail this comparison are grouped anew by a second digest and kept apart.

A digest that a third of all rows share has one entry in each run, and the join that brings results back to rows is an
ordinary sort-merge join that adaptive execution splits.

Defined results: every input row gives one row and counts in its group, repeated rows and rows of null id too; null text
counts as empty; a null id comes after every other id; exactly one row of a group is kept, and of rows with the same id and
as many code points it is any one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadflow.llm.common import id_or_last, id_or_null, shared_dir

BLANKS = "[\\x20\\x09-\\x0D]+"
RUN = "shard int, run string, digests binary, ids array<long>, points array<long>, counts array<long>, filter binary"
GROUP = "digest binary, keep_id long, keep_points long, group_size long"
DIGEST = np.dtype("S32")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def _bits(digests: np.ndarray, size: int) -> np.ndarray:
    """Three bit positions for each digest (rows of 32 bytes), taken from the digest itself."""
    return digests.view(np.uint64).reshape(-1, 4)[:, :3] % np.uint64(size)


def make_filter(digests: np.ndarray) -> np.ndarray:
    size = max(64, 12 * len(digests))
    filled = np.zeros(size, dtype=bool)
    filled[_bits(digests, size)] = True
    return filled


def may_hold(filled: np.ndarray, digests: np.ndarray) -> np.ndarray:
    return filled[_bits(digests, len(filled))].all(axis=1)


def _as_rows(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 32)


def flush_runs(shards: int, memtable_rows: int):
    """A mapInPandas function: rows (digest, id, points) to sorted runs cut into shards."""

    def better(a: tuple, b: tuple) -> tuple:
        return (a if (-a[0], a[1]) <= (-b[0], b[1]) else b)[:2] + (a[2] + b[2],)

    def flushed(table: dict[bytes, tuple], run: str) -> Iterator[pd.DataFrame]:
        keys = sorted(table)
        digests = _as_rows(keys)
        shard = (digests[:, :4].copy().view(">u4").ravel().astype(np.uint64) * np.uint64(shards)) >> np.uint64(32)
        edges = np.flatnonzero(np.diff(shard)) + 1
        rows = []
        for block in np.split(np.arange(len(keys)), edges):
            values = [table[keys[i]] for i in block]
            own = np.ascontiguousarray(digests[block])
            rows.append((int(shard[block[0]]), run, own.tobytes(), [v[1] for v in values], [v[0] for v in values], [v[2] for v in values], np.packbits(make_filter(own)).tobytes()))
        yield pd.DataFrame(rows, columns=["shard", "run", "digests", "ids", "points", "counts", "filter"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        table: dict[bytes, tuple] = {}
        n = 0
        for batch in batches:
            for digest, doc, points, count in zip(batch["digest"], batch["id"].tolist(), batch["points"].tolist(), batch["n"].tolist(), strict=True):
                row = (points, doc, count)
                table[digest] = better(table[digest], row) if digest in table else row
            if len(table) >= memtable_rows:
                yield from flushed(table, f"{part}-{n}")
                table, n = {}, n + 1
        if table:
            yield from flushed(table, f"{part}-{n}")

    return run


def compact(shard: pd.DataFrame) -> pd.DataFrame:
    """Merge all runs of one shard; digests of one document only are left out."""
    runs = shard.sort_values("run").reset_index(drop=True)
    digests = [np.frombuffer(d, dtype=np.uint8).reshape(-1, 32) for d in runs["digests"]]
    counts = [np.asarray(c, dtype=np.int64) for c in runs["counts"]]
    filters = [np.unpackbits(np.frombuffer(f, dtype=np.uint8)).astype(bool)[: max(64, 12 * len(d))] for f, d in zip(runs["filter"], digests, strict=True)]
    picked = [c > 1 for c in counts]
    if len(runs) > 1:
        # one counting filter for the shard: a digest can be elsewhere only if all its places were filled by two runs or more
        size = max(64, 12 * sum(map(len, digests)))
        twice, once = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        for d in digests:
            bits = np.unique(_bits(np.ascontiguousarray(d), size))
            twice[bits] |= once[bits]
            once[bits] = True
        picked = [p | may_hold(twice, np.ascontiguousarray(d)) for p, d in zip(picked, digests, strict=True)]
        if len(runs) <= 8:
            # few runs: ask each other run's own filter too
            for i, d in enumerate(digests):
                others = np.zeros(len(d), dtype=bool)
                for j, f in enumerate(filters):
                    if j != i:
                        others |= may_hold(f, np.ascontiguousarray(d))
                picked[i] &= others | (counts[i] > 1)
    keys = np.concatenate([d[p] for d, p in zip(digests, picked, strict=True)])
    merged = pd.DataFrame(
        {
            "digest": list(map(bytes, keys)),
            "id": np.concatenate([np.asarray(x, dtype=np.int64)[p] for x, p in zip(runs["ids"], picked, strict=True)]),
            "points": np.concatenate([np.asarray(x, dtype=np.int64)[p] for x, p in zip(runs["points"], picked, strict=True)]),
            "n": np.concatenate([c[p] for c, p in zip(counts, picked, strict=True)]),
        }
    )
    merged = merged.sort_values(["digest", "points", "id"], ascending=[True, False, True])
    out = merged.groupby("digest", sort=False).agg(keep_id=("id", "first"), keep_points=("points", "first"), group_size=("n", "sum")).reset_index()
    return out[out["group_size"] > 1]


def digest_groups(rows: DataFrame, shards: int, memtable_rows: int = 200_000) -> DataFrame:
    """Digests of more than one row, from rows (digest binary, id long, points long, n long)."""
    runs = rows.select("digest", "id", "points", "n").mapInPandas(flush_runs(shards, memtable_rows), RUN)
    return runs.groupBy("shard").applyInPandas(compact, GROUP)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = 200_000, shard_rows: int = 500_000, row_col: str | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size (rows), kept (true once in each group of equal texts), text_sha256.

    With row_col, a column of unique numbers, that column comes first, and of rows that tie the smallest number is kept.
    """
    shared_dir(docs.sparkSession)
    # the rows of a shard bound what a compaction holds
    shards = docs.count() // shard_rows + int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col)
    given = [F.col(row_col).alias("row")] if row_col else []
    named = [F.col("row").alias(row_col)] if row_col else []
    base = docs.select(id_or_last(id_col).alias("id"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("points"), normalised(text).alias("body"), *given)
    base = base.withColumn("digest", F.unhex(F.sha2("body", 256)))
    # repeated rows are one entry with their number; the row is read off only where an entry is a single row
    one = [F.min("row").alias("row")] if row_col else []
    small = base.groupBy("digest", "id").agg(F.max("points").alias("points"), F.count(F.lit(1)).alias("n"), *one)
    groups = digest_groups(small, shards, memtable_rows)
    alone = small.join(groups, "digest", "left_anti").select(*named, "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    # all texts are dealt out once; the hits among them are kept where every executor can read them again
    hits = base.join(groups, "digest")
    hits = (hits if row_col else hits.withColumn("row", F.monotonically_increasing_id())).checkpoint()
    kept = hits.where((F.col("id") == F.col("keep_id")) & (F.col("points") == F.col("keep_points"))).groupBy("digest").agg(F.first("body").alias("kept_body"))
    verified = hits.join(kept, "digest").select(
        "digest", "id", "points", "row", F.when(F.col("body") == F.col("kept_body"), F.lit("")).otherwise(F.sha2("body", 512)).alias("other")
    )
    classes = verified.groupBy("digest", "other").agg(
        F.min(F.struct((-F.col("points")).alias("p"), F.col("id").alias("keep_id"), F.col("row").alias("keep_row"))).alias("best"), F.count(F.lit(1)).alias("group_size")
    ).select("digest", "other", "best.keep_id", "best.keep_row", "group_size")
    together = verified.join(classes, ["digest", "other"]).select(*named, "id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return alone.unionByName(together).select(*([row_col] if row_col else []), id_or_null("id").alias(id_col), id_or_null("keep_id").alias("keep_id"), "group_size", "kept", "text_sha256")
