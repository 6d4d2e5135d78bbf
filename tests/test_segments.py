import itertools

from pyspark.sql import functions as F

from convomill.operators import segments


def greedy(shifts, chars):
    n, cuts = len(shifts), [0]
    if n <= 10 and chars <= 8000:
        return [None] * n
    for i in range(1, n):
        if shifts[i] and i - cuts[-1] >= 2:
            cuts.append(i)
    if len(cuts) == 1 and n > 10:
        cuts = list(range(0, n, 10))
    return [sum(c <= i for c in cuts) for i in range(n)]


def test_segments_equal_the_greedy_loop(spark):
    cases = [(c, 9000) for n in range(1, 10) for c in itertools.product([False, True], repeat=n)] + [((False,) * 25, 100), ((False, *[True] * 11), 100), ((False,) * 5, 100)]
    rows = [(k, i, s, chars // len(c) + 1) for k, (c, chars) in enumerate(cases) for i, s in enumerate((False, *c[1:]))]
    got = {}
    df = spark.createDataFrame(rows, "path int, turn_index int, shift boolean, size int")
    for r in segments.topic_segments(df, ["path"], F.col("size")).orderBy("path", "turn_index").collect():
        got.setdefault(r.path, []).append(r.part)
    for k, (c, chars) in enumerate(cases):
        assert got[k] == greedy((False, *c[1:]), chars), c


def test_batches_keep_null_keys_and_scores(spark):
    """Null scores last, null keys first in their score; at any size."""
    for n in (4, 2000):
        rows = [(f"c{i:05d}", float(i % 3)) for i in range(n)] + [(None, 1.0), ("x", None), (None, None)]
        df = spark.createDataFrame(rows, "conversation_id string, aggregate_score double")
        got = segments.make_batches(df, 8).orderBy("place").collect()
        want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is not None, r[0] or ""))
        assert [(r.conversation_id, r.aggregate_score) for r in got] == want and [r.place for r in got] == list(range(n + 3)) and [r.batch for r in got] == [i // 8 + 1 for i in range(n + 3)]


def test_batches_and_caps(spark):
    c = spark.createDataFrame([(f"c{i:02d}", float(i % 4)) for i in range(20)], "conversation_id string, aggregate_score double")
    got = segments.make_batches(c, 8).orderBy("place").collect()
    assert [r.place for r in got] == list(range(20)) and [r.batch for r in got] == [1] * 8 + [2] * 8 + [3] * 4
    assert [r.conversation_id for r in got][:3] == ["c03", "c07", "c11"]
    files = spark.createDataFrame([("a", 3, 10), ("b", 2, 20), ("c", 1, 5)], "path string, mtime int, n_conversations int")
    assert [r.path for r in segments.soft_cap(files, 24).collect()] == ["a", "b"]
    cards = spark.createDataFrame([(i, "ab"[i % 10 == 0]) for i in range(30)], "note_id int, deck string")
    picked = segments.stratified_cards(cards, 4).collect()
    assert sorted(r.note_id for r in picked) == [0, 1, 2, 10]
