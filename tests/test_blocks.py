"""Duplicates by packed blocks: whole, and what goes to disk is no multiple of the texts."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from convomill.operators import similarity, text_blocks, vectors, word_blocks
from convomill.operators.ratio import Ratio


def shuffled(spark):
    """Bytes that all stages so far have shuffled or spilled to disk."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).diskBytesSpilled() for i in range(stages.size()))


def texts(n, seed, words=60, vocabulary=400):
    """Random texts, one in five a changed copy of another, one in five an exact one."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = [f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(rng.randint(1, words))]
        if i % 5 == 1:
            t = out[rng.randrange(len(out))].split()
            t[rng.randrange(len(t))] = "changed"
        out.append(out[rng.randrange(len(out))] if i % 5 == 2 else " ".join(t))
    return out


def frame(spark, found, parity):
    return spark.createDataFrame([(i, t) for i, t in enumerate(found) if i % 2 == parity], "rep long, norm string").repartition(3)


def smallest(found, parity):
    reps = {}
    for i, t in enumerate(found):
        if i % 2 == parity:
            reps.setdefault(t, i)
    return reps


def jaccard(a, b):
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("threshold", [0.3, 0.492, 0.9])
def test_word_blocks_equal_brute_force(spark, monkeypatch, threshold):
    """Many small blocks, steps of few meetings; of equal texts the smallest identifier alone."""
    monkeypatch.setattr(similarity, "SALTED", 70)
    monkeypatch.setattr(word_blocks, "STEP", 500)
    found = texts(400, 1)
    want = {(i, k): jaccard(a, b) for a, i in smallest(found, 0).items() for b, k in smallest(found, 1).items() if jaccard(a, b) >= threshold}
    rows = similarity.jaccard_join(frame(spark, found, 0), frame(spark, found, 1), threshold, distinct=True).collect()
    assert {(r.left_id, r.right_id): r.jaccard for r in rows} == want and len(rows) == len(want) > 20


def test_words_are_not_shuffled(spark):
    """Words went to their counts, back to their texts and to those they meet, and so did all meetings: 17 times the input."""
    found = texts(4000, 2, words=400, vocabulary=20_000)
    left, right = frame(spark, found, 0).cache(), frame(spark, found, 1).cache()
    assert left.count() + right.count() == len(found)
    before = shuffled(spark)
    assert similarity.jaccard_join(left, right, 0.492, distinct=True).count() > 100
    assert shuffled(spark) - before < 0.5 * sum(map(len, found))


def test_ratio_equals_difflib():
    rng = random.Random(3)
    for _ in range(600):
        letters = rng.choice(["ab", "abc é", "abcdefghijklmnopqrstuvwxyz 0123", "aaaaaaaaabcdefghijkl "])
        b = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 50, 199, 200, 201, 600])))
        a = list(b)
        for _ in range(rng.randint(0, 12)):
            at = rng.randint(0, len(a))
            a[at : at + rng.choice([0, 0, 9])] = rng.choice(["x", "hello", "zz ", ""])
        a = "".join(a) if rng.random() < 0.8 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        want = SequenceMatcher(None, a, b).ratio()
        assert Ratio(b)(a) == want and Ratio(b)(a, 0.82) in ({want} if want >= 0.82 else {want, 0.0})


def test_texts_of_pairs_are_moved_once(spark, monkeypatch):
    """Whole over many blocks of texts; a group of near copies does not move its texts for each of its pairs."""
    monkeypatch.setattr(text_blocks, "CHARACTERS", 5_000)
    found = texts(300, 4)
    near = lambda a, b: jaccard(a, b) >= 0.6 * 0.82 and SequenceMatcher(None, a, b).ratio() >= 0.82
    want = {(i, k): SequenceMatcher(None, a, b).ratio() for a, i in smallest(found, 0).items() for b, k in smallest(found, 1).items() if near(a, b)}
    rows = similarity.string_duplicates(frame(spark, found, 0), frame(spark, found, 1), 0.82, distinct=True).collect()
    assert {(r.left_id, r.right_id): r.ratio for r in rows} == want and len(rows) == len(want) > 20
    group = [" ".join(f"word{k}" for k in range(300)) + f" n{i}" for i in range(160)]
    before = shuffled(spark)
    assert similarity.string_duplicates(frame(spark, group, 0), frame(spark, group, 1)).count() == 80 * 80
    assert shuffled(spark) - before < 4 * sum(map(len, group))


def test_a_turn_is_compared_until_it_is_caught(spark, monkeypatch):
    """The smallest card of each turn, from groups of near copies and blocks of a few texts."""
    monkeypatch.setattr(text_blocks, "CHARACTERS", 3_000)
    found = texts(200, 5) + [" ".join(f"word{k}" for k in range(60)) + f" n{i % 30}" for i in range(60)]
    turns = frame(spark, found, 0).selectExpr("rep turn_id", "norm prompt", "'' answer")
    cards = frame(spark, found, 1).selectExpr("rep card_id", "norm front", "'' back")
    near = lambda a, b: jaccard(a, b) >= 0.6 * 0.82 and SequenceMatcher(None, a, b).ratio() >= 0.82
    want = {i: min((k for k, b in enumerate(found) if k % 2 and near(a, b)), default=None) for i, a in enumerate(found) if i % 2 == 0}
    assert {r.turn_id: r.card_id for r in similarity.lexical_duplicates(turns, cards, 0.82).collect()} == want
    all_pairs = similarity.string_duplicates(frame(spark, found, 0), frame(spark, found, 1), distinct=True).count()
    some = similarity.string_duplicates(frame(spark, found, 0), frame(spark, found, 1), distinct=True, first=True).count()
    assert some < all_pairs / 3


def test_a_query_is_not_shuffled_to_each_bucket(spark):
    """Near-random vectors ask most buckets: a query went to each with its vector."""
    rng = np.random.default_rng(1)
    q, c = (spark.createDataFrame([(i + at, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, 32)))], "vec_id long, embedding array<double>") for n, at in ((600, 0), (2500, 10_000)))
    before = shuffled(spark)
    assert vectors.approximate_matches(q, c, 3).count() == 1800
    assert shuffled(spark) - before < 2 * (600 + 2500) * 32 * 8


@pytest.mark.parametrize("k", [1, 3, 20])
def test_chunks_keep_ties_and_blocks(spark, monkeypatch, k):
    """Small chunks, equal vectors in several blocks and chunks: the smaller identifier first."""
    monkeypatch.setattr(vectors, "CHUNK", 40)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(700, 3)))
    x[~x.any(1)] = 1.0
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    score = np.round(unit[:100] @ unit[100:].T, 12)
    want = {i: [int(j) + 100 for j in np.lexsort((np.arange(600), -row))[:k]] for i, row in enumerate(score)}
    q, c = (spark.createDataFrame([(i, [float(y) for y in x[i]]) for i in ids], "vec_id long, embedding array<double>") for ids in (range(100), range(100, 700)))
    got = {}
    for r in vectors.top_matches(q, c, k, rows=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.card_id)
    assert got == want


def test_a_text_is_not_shuffled_to_each_block(spark):
    """Vectors of short texts lie in many blocks at like angles: each was asked with a copy of the vector."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(12))) for i in range(9000)]
    turns, cards = (spark.createDataFrame([r for r in rows if (r[0] % 3 == 0) == turn], "id long, text string") for turn in (True, False))
    before = shuffled(spark)
    found = vectors.text_matches(turns, cards, 0.95, vectors.hashed_words(64))
    assert found.count() == 3000
    assert shuffled(spark) - before < 3 * 9000 * 64
