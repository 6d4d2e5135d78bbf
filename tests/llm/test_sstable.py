import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from convomill.llm import sstable

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip_and_lookup(spark):
    rows = [(i * 7 - 300, f"Text number {i} " * (i % 40), "x") for i in range(800)] + [(5, None, "x"), (None, "null id", "x"), (9, "", "x")] + [(70, f"copy {i % 3}", "x") for i in range(50)] + [(10**15, "long " * 60000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    whole = Tokenizer.from_file(WORDS)
    shards = sstable.write_shards(docs, WORDS)
    got = sstable.read_shards(shards).collect()
    want = {(d, zlib.crc32(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, t, _ in rows}
    assert len(got) == len(rows) and {(r.doc_id, r.ids_crc32) for r in got} == want
    at, last = 0, -(10**18)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (r.doc_id if r.doc_id is not None else -(10**18)) >= last
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else last
    found = sstable.lookup(shards, spark.createDataFrame([(70,), (5,), (123456789,), (1,), (70,), (10**16,), (-(10**16),)], "doc_id long")).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in found)[:2] == [(1, len(whole.encode("Text number 43 " * 3, add_special_tokens=False).ids) + 1), (5, 1)] and len(found) == 52
    assert [len(r.ids) for r in sstable.lookup(shards, spark.createDataFrame([(None,)], "doc_id long")).collect()] == [len(whole.encode("null id", add_special_tokens=False).ids) + 1]
    path = shards.first().path
    reader = sstable.ShardReader(path)
    assert sum(reader.may_have(10**12 + i) for i in range(1000)) < 50
    assert list(reader)[0][0] is None


def test_empty(spark):
    assert sstable.read_shards(sstable.write_shards(spark.createDataFrame([], "doc_id long, text string"), WORDS)).count() == 0
    assert sstable.lookup(sstable.write_shards(spark.createDataFrame([], "doc_id long, text string"), WORDS), spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_ids_that_do_not_fit():
    writer = sstable.ShardWriter(io.BytesIO(), 2)
    writer.add(sstable.key_bytes(1), np.array([70000], "<u4").tobytes())
    with pytest.raises(ValueError, match="does not fit"):
        writer.close()
