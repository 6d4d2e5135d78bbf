import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from convomill.llm import packing
from convomill.llm.tokens import ByteEncoder, WordEncoder

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "a b  c\n d \n e\t\tf", "The cat's 12 hats, isn't it?\nYes.", " lead", "trail ", "é ñ ß x", "x\x1cy z", "a <|endoftext|> b", "<|startoftext|>", "日本 語 テスト", "A" * 3000, "x\r\ny", "a b c", "don't DON'T we'll", "a|b | c ||", "x.!! y... z., 's", "İ ß É ǅ", "word,"]


@pytest.mark.parametrize(("path", "kind"), [(BYTES, ByteEncoder), (WORDS, WordEncoder)])
def test_piecewise_ids_are_the_tokenizers_ids(spark, path, kind):
    texts = TEXTS + [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    encoder, whole = kind(path), Tokenizer.from_file(path)
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text[:50]


def test_column_generation_reaches_the_bound():
    lengths, demand = [3, 5, 7], [30, 20, 10]
    used = packing.patterns_of(lengths, demand, 16)
    total = sum(np.array(p) * c for p, c in used)
    assert total.tolist() == demand
    assert all(p @ np.array(lengths) <= 16 for p, _ in used)
    assert sum(c for _, c in used) <= -(-(90 + 100 + 70) // 16) + 2


def test_pack_covers_each_id_once(spark):
    docs = spark.createDataFrame([(1, "word " * 5000, 9), (2, None, 9), (3, "", 9), (3, "", 9), (4, "short text", 9), (None, "no id", 9)] + [(i, f"text {i} " * (i % 37), 9) for i in range(10, 200)], "doc_id long, text string, length int")
    out = [r.asDict() for r in packing.pack_documents(docs, BYTES, with_ids=True).collect()]
    whole = Tokenizer.from_file(BYTES)
    by_doc = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for r in docs.where("doc_id != 3").collect():
        ids = [x for p in sorted(by_doc[r["doc_id"]], key=lambda p: p["start"]) for x in p["ids"]]
        assert ids == [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]
    by_seq = {}
    for r in out:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    used = sum(r["length"] for r in out)
    assert sorted(by_seq) == list(range(len(by_seq))) and len(by_seq) <= used // 2048 + 3
    rows = packing.sequences(packing.pack_documents(docs, BYTES, with_ids=True)).collect()
    assert sum(len(r["input_ids"]) for r in rows) == used


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), BYTES).count() == 0
