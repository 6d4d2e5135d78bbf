"""Review decisions and their analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCEPTED = ["accept", "edit"]
IMPORTED = ["imported", "duplicate", "imported_or_duplicate"]


def review_filter(cards: DataFrame, deck: str = "all", min_confidence: float = 0.0, duplicates: str = "all", threshold: float = 0.7) -> DataFrame:
    """duplicates: all, duplicates_only or unique_only; a card counts as one by its score, else by its stored flag."""
    x = cards.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    x = x if deck == "all" else x.where(F.col("deck") == deck)
    is_dup = F.coalesce(F.col("similarity_score") >= threshold, F.col("is_likely_duplicate"), F.lit(False))
    return {"all": x, "duplicates_only": x.where(is_dup), "unique_only": x.where(~is_dup)}[duplicates]


def review_stats(cards: DataFrame, decisions: DataFrame) -> DataFrame:
    x = cards.join(decisions.select("card_id", "action"), "card_id", "left")
    n = F.count("*")
    return x.agg(n.alias("total"), F.count("action").alias("reviewed"), *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("accept", "reject", "edit", "skip")], (n - F.count("action")).alias("remaining"), F.round(F.coalesce(F.try_divide(100.0 * F.count("action"), n), F.lit(0.0)), 6).alias("pct"))


def run_status(runs: DataFrame, cards: DataFrame, decisions: DataFrame) -> DataFrame:
    """Complete: every card decided, or an empty list. A run without a list is not."""
    c, d = cards.groupBy("run_id").agg(F.count("*").alias("n_cards")), decisions.groupBy("run_id").agg(F.count("*").alias("n_decisions"))
    x = runs.join(c, "run_id", "left").join(d, "run_id", "left").na.fill(0, ["n_cards", "n_decisions"])
    done = F.col("has_list") & ((F.col("n_cards") == 0) | (F.col("n_decisions") >= F.col("n_cards")))
    return x.select("run_id", "n_cards", "n_decisions", done.alias("complete"), (F.col("has_list") & (F.col("n_cards") == 0)).alias("empty"))


def bulk_accept(cards: DataFrame, decisions: DataFrame, threshold: float = 0.90) -> DataFrame:
    return cards.where(F.col("confidence") >= threshold).join(decisions.select("card_id"), "card_id", "left_anti").select("card_id", F.lit("accept").alias("action"))


def export_accepted(cards: DataFrame, decisions: DataFrame) -> DataFrame:
    """The accepted cards, as edited where they were; card_id gives their order."""
    x = cards.join(decisions.where(F.col("action").isin(ACCEPTED)).select("card_id", "action", "edited_front"), "card_id")
    return x.select("card_id", "action", F.coalesce("edited_front", "front").alias("front"), "deck")


def export_feedback(cards: DataFrame, decisions: DataFrame) -> DataFrame:
    return cards.select("card_id", "deck", "confidence").join(decisions.select("card_id", "action", "reason", "decided_at"), "card_id")


def pending_import(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("action").isin(ACCEPTED) & ~F.coalesce("import_status", F.lit("pending")).isin(IMPORTED)).select("card_id", "action")


def acceptance_rate(cards: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per deck and confidence band (tenths); duplicate_precision: of the cards flagged as likely duplicates, the share that was rejected (null: none flagged)."""
    x = cards.join(decisions.select("card_id", "action"), "card_id").withColumn("band", F.floor(F.col("confidence") * 10).cast("long"))
    n, flagged = F.count("*"), F.coalesce(F.col("is_likely_duplicate"), F.lit(False))
    rate = lambda a: F.round(F.count_if(F.col("action").isin(a)) / n, 6)
    precision = F.round(F.try_divide(F.count_if(flagged & (F.col("action") == "reject")), F.count_if(flagged)), 6)
    return x.groupBy("deck", "band").agg(n.alias("n"), rate(ACCEPTED).alias("acceptance_rate"), rate(["edit"]).alias("edit_rate"), precision.alias("duplicate_precision"))


def import_counts(results: DataFrame) -> DataFrame:
    """failed is what is neither: none, since every result has an identifier or has not."""
    n = F.count("*")
    return results.agg(F.count("note_id").alias("imported"), F.count_if(F.col("note_id").isNull()).alias("duplicates"), (n - F.count("note_id") - F.count_if(F.col("note_id").isNull())).alias("failed"))
