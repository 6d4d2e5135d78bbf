import random
import zlib
from itertools import pairwise

from convomill.llm import shards


def brute(sizes, n):
    best = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    for _ in range(n - 1):
        best = [min((max(best[j], sum(sizes[j:i])) for j in range(i + 1)), default=0) for i in range(len(sizes) + 1)]
    return best[-1]


def test_capacity_is_the_minimax():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 14))]
        n = rng.randint(1, 6)
        want = brute(sizes, n)
        assert shards.smallest_capacity(sizes, n) == want
        got = shards.cut(sizes, n)
        assert got == sorted(got) and max(got) < n and all(b - a <= 1 for a, b in pairwise(got))
        assert max(sum(s for s, g in zip(sizes, got, strict=True) if g == k) for k in set(got)) <= want


def test_shards(spark):
    rows = [(i, f"t{i}" * (i % 50), 0) for i in range(2000)] + [(5000 + i, "hot text", 0) for i in range(900)] + [(1, None, 0), (2, "", 0), (None, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = shards.minimax_shards(docs, 16).collect()
    assert len(out) == len(rows)
    text_of = {}
    for i, t, _ in rows:
        text_of.setdefault((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())), t)
    assert {(r.doc_id, r["size"], r.text_crc32) for r in out} == set(text_of)
    shard_of = {}
    for r in out:
        assert shard_of.setdefault(r.text_crc32, r.shard) == r.shard
    for k in range(16):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    total, hot = sum(r["size"] for r in out), 900 * 9
    sizes = [sum(r["size"] for r in out if r.shard == k) for k in range(16)]
    assert max(sizes) <= max(hot + 200, total / 16 + 300)


def test_empty(spark):
    assert shards.minimax_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_texts_and_equal_rows(spark):
    long = "é" * 1_500_000
    rows = [(1, long), (2, long), (3, "a"), (3, "a"), (3, "a"), (4, None), (None, "b")]
    out = shards.minimax_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted(r["size"] for r in out) == [1, 2, 2, 2, 2, 3_000_001, 3_000_001]
    assert len({r.shard for r in out if r["size"] > 9}) == 1 and len({r.shard for r in out if r.doc_id == 3}) == 1
    for k in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
