import struct
import zlib

import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dyadflow.llm.packing import pack

WORDS = "the quick brown fox, jumps! over Éclair über l'été don't x2y 3,000 ... naïvé 日本 a b".split(" ")


def texts():
    out = [None, "", " \t ", "A", "word " * 9000, "l'eau\x1cthe 's 't"]
    out += [" ".join(WORDS[(i * 7 + j) % len(WORDS)] for j in range(i * 13 % 900)) for i in range(120)]
    return out


def check_pieces(pieces: pd.DataFrame, ids: dict, size: int):
    for doc, rows in pieces.groupby("doc_id"):
        rows = rows.sort_values("start")
        assert rows["start"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]]
        assert rows["length"].sum() == len(ids[doc]) == rows["doc_tokens"].iloc[0]
        for start, n, crc in zip(rows["start"], rows["length"], rows["ids_crc32"], strict=True):
            part = ids[doc][start : start + n]
            assert zlib.crc32(struct.pack(f"<{n}I", *part)) == crc
    for _, rows in pieces.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]]
        assert rows["length"].sum() <= size


@pytest.mark.parametrize(("size", "open_windows"), [(4096, 64), (128, 3)])
def test_every_id_lies_in_one_piece(spark, size, open_windows):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, offset string, length int").repartition(3)
    pieces = pack(docs, "word_bpe_49k.json", size=size, open_windows=open_windows, tasks_per_merge=2).toPandas()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*model.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    assert set(pieces["doc_id"]) == set(ids)
    check_pieces(pieces, ids, size)
    used = pieces.groupby("sequence_id")["length"].sum()
    assert used.sum() / (len(used) * size) > (0.9 if size == 4096 else 0.8)


def test_empty_table_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert pack(spark.createDataFrame([], schema), "word_bpe_49k.json").count() == 0
    rows = pack(spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b")], schema), "word_bpe_49k.json").collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 3), (False, 3), (True, 3)]
