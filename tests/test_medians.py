import random
import statistics

from pyspark.sql import functions as F

from convomill.operators import progress


def test_medians_equal_sorting(spark):
    """Odd and even counts, equal and negative values, all of the range, null keys and values."""
    rng = random.Random(1)
    make = {"wide": lambda: rng.randint(-(2**62), 2**62), "near": lambda: 10**15 + rng.randint(0, 50), "same": lambda: -7, "steps": lambda: rng.randint(-3, 3) << 20, None: lambda: rng.randint(0, 9)}
    rows = [(k, f()) for k, f in make.items() for _ in range(rng.randint(150, 201))] + [("one", 5), ("two", -4), ("two", -1), ("none", None)]
    got = {r.k: r["median"] for r in progress.exact_medians(spark.createDataFrame(rows, "k string, v long"), "k", "v").collect()}
    want = {}
    for key in {k for k, v in rows if v is not None}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        twice = values[(len(values) - 1) // 2] + values[len(values) // 2]
        want[key] = abs(twice) // 2 * (1 if twice >= 0 else -1)
        assert abs(want[key] - statistics.median(values)) <= max(1, abs(want[key]) * 1e-9)
    assert got == want
    assert progress.exact_medians(spark.createDataFrame([], "k string, v long"), "k", "v").count() == 0


def test_a_run_of_half_of_all_cards(spark):
    n = 40_000
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.pmod(F.xxhash64("id"), F.lit(10**12)))
    cards = spark.range(n).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("r"), (F.col("id") % 50).cast("string"))).alias("run_id"), F.when(F.col("id") % 7 > 0, at).alias("at"))
    got = {r.run_id: r.median_micros for r in progress.run_time_stats(cards).collect()}
    want = {r.run_id: r.m for r in cards.groupBy("run_id").agg(F.percentile(F.unix_micros("at"), F.lit(0.5)).cast("long").alias("m")).collect()}
    assert got == want and len(got) == 26
