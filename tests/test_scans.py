import itertools
import random

import pytest
from pyspark.sql import functions as F

from convomill.operators import segments, turns
from convomill.operators.scans import scanned


@pytest.mark.parametrize("inclusive", [True, False])
def test_scans_equal_one_pass(spark, inclusive):
    """Null keys, orders and values, gaps, blocks of any size, columns of our own names."""
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([1, 2, None]), rng.choice(["x", "y", None])) for i in sorted(rng.sample(range(-40, 200), 90))] + [("a", None, 5, "first"), ("c", None, None, None)]
    df = spark.createDataFrame(rows, "k string, at int, n int, v string").withColumn("scan", F.lit(1))
    want = {}
    for key in ("a", "b", "c", None):
        total, last = 0, None
        for k, at, n, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0)):
            seen = (v or last) if inclusive else last
            total, last = total + (n or 0), v or last
            want[k, at] = (total, seen)
    for block in (1, 3, 1000):
        got = scanned(df, ["k"], "at", block, {"total": F.col("n")}, {"last": F.col("v")}, inclusive)
        assert {(r.k, r.at): (r.total, r["last"]) for r in got.collect()} == want and got.columns == [*df.columns, "total", "last"]


def test_pairing_in_blocks_equals_pairing_by_windows(spark):
    """All short sequences of what an entry can be."""
    kinds = [("user", "q"), ("user", " "), ("assistant", "a"), ("assistant", ""), ("assistant", '{"content_type": "code"}'), ("tool", "t")]
    rows = [(f"{i}", 3 * pos, role, f"t{pos}", f"{text}{pos}" if text.strip() and text[0] != "{" else text) for i, seq in enumerate(s for n in range(1, 5) for s in itertools.product(kinds, repeat=n)) for pos, (role, text) in enumerate(seq)]
    df = spark.createDataFrame(rows, "path string, pos int, role string, ts_raw string, text string")
    assert sorted(turns.pair_turns(df, spread=4).collect(), key=str) == sorted(turns.pair_turns(df).collect(), key=str)


def test_one_path_of_a_third_of_all_rows_is_spread(spark):
    n = 30_000
    hot = spark.range(n).select(F.lit("hot").alias("path"), F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.lit("t").alias("ts_raw"), F.concat(F.lit("text "), "id").alias("text"))
    rest = spark.range(2 * n).select(F.concat(F.lit("p"), (F.col("id") % 5000).cast("string")).alias("path"), F.floor(F.col("id") / 5000).alias("pos"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("t").alias("ts_raw"), F.lit("x").alias("text"))
    got = turns.pair_turns(hot.unionByName(rest), spread=500)
    assert got.where("path = 'hot'").count() == n / 3 and got.where("path = 'hot'").agg(F.max("turn_index")).first()[0] == n / 3 - 1
    entries = hot.unionByName(rest).select("path", "pos", F.lit(1).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        tasks = scanned(entries, ["path"], "pos", 500, {"s": F.col("n")}).where("path = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 0.5 * n


def test_entries_and_segments_in_blocks(spark):
    body = "\n".join(line for i in range(40) for line in (f"[2025-01-01 00:{i:02d}] {('user', 'Human', 'assistant')[i % 3]}:", *[f"line {j}" for j in range(i % 4)]))
    parts = spark.createDataFrame([("p", f"before\n{body}"), ("q", "no header"), ("r", "[t] tool:")], "path string, body string")
    assert sorted(turns.parse_entries(parts, spread=3).collect(), key=str) == sorted(turns.parse_entries(parts).collect(), key=str)
    rng = random.Random(2)
    rows = [(k, i, i > 0 and rng.random() < 0.5, rng.choice([10, 900])) for k in range(60) for i in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "path int, turn_index int, shift boolean, size int")
    by = lambda x: sorted(x.collect(), key=str)
    for block in (1, 4, 100):
        assert by(segments.topic_segments(df, ["path"], F.col("size"), spread=block)) == by(segments.topic_segments(df, ["path"], F.col("size")))
