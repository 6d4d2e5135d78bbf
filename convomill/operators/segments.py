"""Topic segments, caps, samples and batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOPIC_MARKERS, any_of
from ..sources.shared import written
from .features import conversation_signals, in_order, key_topics
from .scans import scanned

MAX_TURNS, MAX_CHARS, LOW_OVERLAP, MIN_GAP = 10, 8000, 0.2, 2
DECK_PARTS = 64


def topic_shifts(turns: DataFrame, keys: list[str]) -> DataFrame:
    """turns with shift: a topic marker in the prompt, or few terms in common with the turn before."""
    before = F.lag("key_terms").over(Window.partitionBy(*keys).orderBy("turn_index"))
    common = F.size(F.array_intersect("before", "key_terms")) / F.greatest(F.size("before"), F.size("key_terms"))
    low = F.when((F.size("before") > 0) & (F.size("key_terms") > 0), common < LOW_OVERLAP).otherwise(False)
    return turns.withColumn("before", before).withColumn("shift", (F.col("turn_index") > 0) & (any_of(F.lower("prompt"), TOPIC_MARKERS) | F.coalesce(low, F.lit(False)))).drop("before")


def topic_segments(turns: DataFrame, keys: list[str], chars: Column, spread: int | None = None) -> DataFrame:
    """turns (with shift) with part (null: not split; else from 1) and part_index.

    Every second turn of a run of shifts splits, from the first that is at
    least MIN_GAP into the conversation: that equals taking shifts greedily
    with the gap between them. Without a split, long ones are cut in even
    blocks. spread: turns to a task's block, for conversations too long for
    one task.
    """
    if spread:
        return _spread_segments(turns, keys, chars, spread)
    w = Window.partitionBy(*keys).orderBy("turn_index")
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    island = F.max(F.when(~F.col("shift"), F.col("turn_index"))).over(upto) + 1
    x = turns.withColumn("base", F.greatest(island, F.lit(MIN_GAP)))
    x = x.withColumn("split", F.col("shift") & (F.col("turn_index") >= F.col("base")) & ((F.col("turn_index") - F.col("base")) % 2 == 0))
    x = x.withColumns({"n": F.count("*").over(whole), "chars": F.sum(chars).over(whole), "splits": F.sum(F.col("split").cast("int")).over(whole), "run": F.sum(F.col("split").cast("int")).over(upto) + 1})
    x = x.withColumn("part", _part())
    index = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("turn_index")) - 1
    return x.withColumn("part_index", index).drop("base", "split", "n", "chars", "splits", "run")


def _part() -> Column:
    """From n, chars and splits of the conversation, and run: which of its splits a turn follows."""
    long = (F.col("n") > MAX_TURNS) | (F.col("chars") > MAX_CHARS)
    even = F.when(F.col("n") > MAX_TURNS, F.floor(F.col("turn_index") / MAX_TURNS) + 1).otherwise(1)
    return F.when(long, F.when(F.col("splits") > 0, F.col("run")).otherwise(even)).cast("long")


def _spread_segments(turns: DataFrame, keys: list[str], chars: Column, block: int) -> DataFrame:
    """topic_segments() by scans in blocks of turns; what holds for a whole conversation is counted and joined."""
    x = scanned(turns, keys, "turn_index", block, lasts={"island": F.when(~F.col("shift"), F.col("turn_index"))}).withColumn("base", F.greatest(F.col("island") + 1, F.lit(MIN_GAP)))
    split = F.col("shift") & (F.col("turn_index") >= F.col("base")) & ((F.col("turn_index") - F.col("base")) % 2 == 0)
    x = scanned(x.withColumn("split", split), keys, "turn_index", block, {"run": F.col("split").cast("long")}).withColumn("run", F.col("run") + 1)
    whole = x.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(chars).alias("chars"), F.sum(F.col("split").cast("long")).alias("splits"))
    x = x.join(whole.withColumnsRenamed({k: f"whole_{k}" for k in keys}), reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"whole_{k}")) for k in keys])).withColumn("part", _part())
    parts = [*keys, "part"]
    x = scanned(x, parts, "turn_index", block, {"part_index": F.lit(1).cast("long")}).withColumn("part_index", (F.col("part_index") - 1).cast("int"))
    return x.select(*turns.columns, "part", "part_index")


def segment_conversations(turns: DataFrame, keys: list[str], name: str = "conversation_id") -> DataFrame:
    """Segments (turns with part and part_index, signals and key_terms) as conversations: turn_index anew, the identifier with its part, aggregates, topics and turns of each segment alone; the turns' context_id stays."""
    part = F.coalesce("part", F.lit(0)).alias("part")
    named = F.when(F.col("part").isNull(), F.col(name)).otherwise(F.concat(name, F.lit("_part"), F.col("part").cast("string"))).alias("segment_id")
    x = turns.select(*keys, part, named, F.col("part_index").alias("turn_index"), *[c for c in turns.columns if c not in {*keys, "part", "part_index", "turn_index", "segment_id"}])
    by, x = [*keys, "part", "segment_id"], written(x)
    topics = key_topics(x, by).withColumnRenamed("terms", "key_topics")
    whole = conversation_signals(x, by, more=[in_order(["context_id", "score"])]).join(topics, by, "left")
    return whole.withColumn("key_topics", F.coalesce("key_topics", F.array().cast("array<string>")))


def newest_files(files: DataFrame, n: int = 300) -> DataFrame:
    return files.orderBy(F.desc("mtime"), "path").limit(n)


def soft_cap(files: DataFrame, cap: int = 24) -> DataFrame:
    """Files (with n_conversations, in order of mtime) up to the one that reaches the cap."""
    before = F.sum("n_conversations").over(Window.orderBy(F.desc("mtime"), "path").rowsBetween(Window.unboundedPreceding, -1))
    # the order is over the newest files only, which newest_files() bounds
    return files.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < cap).drop("before")


def top_turns_per_file(turns: DataFrame, min_score: float = 1.2, per_file: int = 3, cap: int = 24) -> DataFrame:
    """At most per_file passing turns of each file in turn order, the first cap of them in file order."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy("turn_index"))
    return turns.where(F.col("score") >= min_score).withColumn("file_rank", rank).where(F.col("file_rank") <= per_file).orderBy("path", "turn_index").limit(cap)


def stratified_cards(cards: DataFrame, limit: int, order: str = "note_id", deck: str = "deck") -> DataFrame:
    """All cards if few; else the first of each deck, filled up in order.

    No more than the first limit of a deck can be among them. They are found
    in two steps, in hash parts of a deck and then over the parts' first ones,
    so that a deck of a third of all cards is no single task.
    """
    per_deck = cards.groupBy(deck).agg(F.count("*").alias("deck_n"), F.min(order).alias("deck_first"))
    totals = per_deck.agg(F.sum("deck_n").alias("n"), F.greatest(F.lit(1), F.floor(F.lit(limit) / F.count("*"))).alias("per"))
    x = cards.withColumn("deck_part", F.pmod(F.xxhash64(order), F.lit(DECK_PARTS)))
    for by in ([deck, "deck_part"], [deck]):
        x = x.withColumn("deck_rank", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("deck_rank") <= limit)
    own, first = x[deck].eqNullSafe(per_deck[deck]), [*[x[c] for c in cards.columns], x["deck_rank"], per_deck["deck_first"]]
    x = x.join(per_deck, own).select(*first).crossJoin(F.broadcast(totals))  # one row
    chosen = (F.col("deck_rank") <= F.col("per")) & (F.col("n") > limit)
    tier = F.when(F.col("n") <= limit, 1).when(chosen, 0).otherwise(1)
    return x.withColumn("tier", tier).orderBy("tier", F.when(F.col("tier") == 0, F.col("deck_first")), order).limit(limit).select(*cards.columns)


def make_batches(conversations: DataFrame, size: int = 8, key: str = "conversation_id") -> DataFrame:
    """Numbered blocks in descending order of score (null last), ties by key (null first), from 1; every row is in one.

    The rows are sorted over ranges of score and key together, so that a
    common score is spread over many tasks, and written; a row's place is the
    number of rows in the ranges before plus its place in its own.
    """
    order, n = [F.desc("aggregate_score"), F.asc(key)], int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = written(conversations.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("own_place", F.monotonically_increasing_id()))
    part = F.shiftright("own_place", 33)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = x.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each range
    place = F.col("before") + F.col("own_place").bitwiseAND((1 << 33) - 1)
    x = x.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("place", place)
    return x.select(*conversations.columns, (F.floor(F.col("place") / size) + 1).cast("long").alias("batch"), "place")
