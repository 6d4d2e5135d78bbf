"""Weekly progress, streaks, runs and throughput."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import week_label, week_start
from ..sources.shared import written

#: Bits of a value that are told apart at once.
DIGIT = 20


def weekly_progress(files: DataFrame, processed: DataFrame, runs: DataFrame, as_of: str, weeks: int = 12) -> DataFrame:
    """Per week back from the week of as_of. files: path, day; processed: path, cards_generated, processed_at; runs: day, cards."""
    spark = files.sparkSession
    monday = week_start(F.lit(as_of).cast("date"))
    spine = spark.range(weeks).select(F.date_sub(monday, (F.col("id") * 7).cast("int")).alias("week"))
    p = processed.select("path", "cards_generated", F.col("processed_at").cast("date").alias("done")).withColumn("has", F.lit(1))
    by_file = files.withColumn("week", week_start(F.col("day"))).join(p.select("path", "has"), "path", "left").groupBy("week").agg(F.count("*").alias("total"), F.count("has").alias("processed"))
    by_done = p.withColumn("week", week_start(F.col("done"))).groupBy("week").agg(F.sum("cards_generated").alias("file_cards"))
    by_run = runs.withColumn("week", week_start(F.col("day"))).groupBy("week").agg(F.sum("cards").alias("run_cards"))
    x = spine.join(by_file, "week", "left").join(by_done, "week", "left").join(by_run, "week", "left").na.fill(0)
    return x.select("week", week_label(F.col("week")).alias("label"), "total", "processed", (F.col("total") - F.col("processed")).alias("remaining"), (F.col("file_cards") + F.col("run_cards")).alias("cards"))


def streaks(weekly: DataFrame) -> DataFrame:
    """current, longest and active_weeks: runs of weeks with something processed; the current one ends at the newest week."""
    x = weekly.select("week", (F.col("processed") > 0).alias("active")).withColumn("i", F.row_number().over(Window.orderBy(F.desc("week"))))  # one row per week of the window
    islands = x.where("active").withColumn("island", F.col("i") - F.row_number().over(Window.orderBy("i"))).groupBy("island").agg(F.count("*").alias("n"), F.min("i").alias("from_i"))
    return islands.agg(F.coalesce(F.max(F.when(F.col("from_i") == 1, F.col("n"))), F.lit(0)).alias("current_streak"), F.coalesce(F.max("n"), F.lit(0)).alias("longest_streak"), F.coalesce(F.sum("n"), F.lit(0)).alias("active_weeks"))


def progress_summary(files: DataFrame, processed: DataFrame, weekly: DataFrame) -> DataFrame:
    seen = files.join(processed.select("path").withColumn("has", F.lit(1)), "path", "left").agg(F.count("*").alias("total"), F.count("has").alias("processed"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    cards = processed.agg(F.coalesce(F.sum("cards_generated"), F.lit(0)).alias("cards"))
    pct = F.when(F.col("total") > 0, F.round(100.0 * F.col("processed") / F.col("total"), 6)).otherwise(0.0)
    return seen.crossJoin(cards).crossJoin(streaks(weekly)).withColumn("pct", pct)  # single rows


def throughput(snapshots: DataFrame, last: int = 10) -> DataFrame:
    """Rates and remaining hours from (at, done, total) overall and over the last snapshots; rows only where something was done."""
    newest = snapshots.orderBy(F.desc("at"), F.desc("done")).limit(last)
    both = snapshots.withColumn("scope", F.lit("overall")).unionByName(newest.withColumn("scope", F.lit("recent")))
    g = both.groupBy("scope").agg(F.min("at").alias("t0"), F.max("at").alias("t1"), F.min("done").alias("d0"), F.max("done").alias("d1"), F.max("total").alias("total"))
    hours = (F.unix_timestamp("t1") - F.unix_timestamp("t0")) / 3600.0
    g = g.withColumns({"progress": F.col("d1") - F.col("d0"), "hours": hours}).where("progress > 0 and hours > 0")
    rate = F.col("progress") / F.col("hours")
    left = F.col("total") - F.col("d1")
    return g.select("scope", "progress", F.round(rate, 6).alias("per_hour"), F.round(rate / 60, 6).alias("per_minute"), left.alias("remaining"), F.round(left / rate, 6).alias("hours_left"))


def exact_medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key and median (of two middle values the mean, towards zero) of whole numbers; null values don't count, null keys are a key like any other.

    Values are counted, then by their bits but the last DIGIT, then but the
    last two DIGITs. The median's leading bits are found among the few counts
    of the last table, the next bits below those alone, and so on: no task
    holds all values of a key, and none more than 2**DIGIT counts but for
    the leading bits.
    """
    v = written(rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).cast("long").alias("b")).agg(F.count("*").alias("n")))
    levels = [v]
    for _ in range(2):
        levels.append(levels[-1].groupBy("k", F.shiftright("b", DIGIT).alias("b")).agg(F.sum("n").alias("n")))
    whole = Window.partitionBy("k")
    total = F.sum("n").over(whole)
    ranks = F.explode(F.array(F.struct(F.lit(1).alias("which"), F.expr("(total - 1) div 2").alias("rank")), F.struct(F.lit(2).alias("which"), F.expr("total div 2").alias("rank")))).alias("t")
    x = levels[-1].withColumn("total", total).select("k", "b", "n", ranks).select("k", "b", "n", "t.*")
    for level in (*levels[-2::-1], None):
        before = F.coalesce(F.sum("n").over(Window.partitionBy("k", "which").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = x.withColumn("before", before).where("rank >= before and rank < before + n").select("k", "which", "b", (F.col("rank") - F.col("before")).alias("rank"))
        if level is None:
            break
        top = at.select(F.col("k").alias("tk"), "which", F.col("b").alias("tb"), "rank")
        x = level.join(top, F.col("k").eqNullSafe(F.col("tk")) & (F.shiftright("b", DIGIT) == F.col("tb"))).select("k", "b", "n", "which", "rank")
    return at.groupBy(F.col("k").alias(key)).agg(F.expr("cast(sum(cast(b as decimal(38,0))) / 2 as decimal(38,1))").alias("m")).select(key, F.expr("cast(m as bigint)").alias("median"))


def run_time_stats(cards: DataFrame) -> DataFrame:
    """Per run: first, last and median card time (microseconds), cards with a time, cards. A run of most cards is no single task."""
    micros = F.unix_micros("at").alias("micros")
    stats = cards.groupBy("run_id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("at").alias("n_timed"), F.count("*").alias("n_cards"))
    middle = exact_medians(cards.select("run_id", micros), "run_id", "micros").withColumnRenamed("run_id", "of_run")
    x = stats.join(middle, F.col("run_id").eqNullSafe(F.col("of_run")), "left")
    return x.select("run_id", "first_at", "last_at", F.col("median").alias("median_micros"), "n_timed", "n_cards")


def run_time(run_id):
    return F.try_to_timestamp(F.substring(run_id, 5, 15), F.lit("yyyyMMdd-HHmmss"))


def run_order(runs: DataFrame, limit: int, descending: bool = True, include_empty: bool = True) -> DataFrame:
    """Runs (run_id, median_micros, n_cards) by median card time, or else by the time in their name."""
    x = runs if include_empty else runs.where("n_cards > 0")
    at = F.coalesce("median_micros", F.unix_micros(run_time(F.col("run_id"))))
    x = x.withColumn("sort_micros", at)
    key = F.desc("sort_micros") if descending else F.asc("sort_micros")
    return x.orderBy(key, "run_id").limit(limit)


def run_stats(batches: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return batches.groupBy("run_id").agg(F.count_if("ok").alias("success_batches"), F.count_if(~F.col("ok")).alias("failed_batches"), *[total(c) for c in ("cards", "kept", "seen", "flagged", "skipped")])
