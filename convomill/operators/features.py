"""Signals, scores, terms and conversation aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def turn_signals(turns: DataFrame, prompt: str = "prompt", answer: str = "answer", heuristics: bool = True) -> DataFrame:
    """turns with the seven signals and the score."""
    if not heuristics:
        return turns.withColumn("score", F.lit(1.0)).withColumn("heuristics_skipped", F.lit(True))
    p, a, low = F.col(prompt), F.col(answer), F.lower(F.col(answer))
    out = turns.withColumns({
        "question_like": t.question_like(p), "definition_like": t.any_of(low, t.DEFINITION_PHRASES), "bullet_count": t.bullet_count(a), "heading_count": t.occurrences(a, "### "),
        "code_blocks": t.occurrences(a, "```"), "answer_length": F.length(a), "imperative": t.any_of(F.lower(p), t.IMPERATIVE_PHRASES),
    })
    c, zero = F.col, F.lit(0.0)
    parts = [
        F.when(c("question_like"), 1.0).otherwise(zero),
        F.when(c("definition_like"), 0.45).otherwise(zero),
        F.when(c("bullet_count") > 0, F.least(F.lit(0.35) + F.lit(0.03) * c("bullet_count"), F.lit(0.65))).otherwise(zero),
        F.when(c("heading_count") > 0, F.least(F.lit(0.25) + F.lit(0.05) * c("heading_count"), F.lit(0.45))).otherwise(zero),
        F.when(c("code_blocks") > 0, 0.2).otherwise(zero),
        F.when(c("answer_length").between(80, 2200), 0.55).when(c("answer_length") > 2200, 0.2).otherwise(zero),
        F.when(c("imperative"), 0.2).otherwise(zero),
    ]
    return out.withColumn("score", F.round(sum(parts[1:], parts[0]), 4))


def ranked_terms(texts: DataFrame, keys: list[str], text: Column, limit: int) -> DataFrame:
    """keys and terms: the most frequent terms of each text, ties by first occurrence."""
    words = texts.select(*keys, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(t.TERM), F.lit(0))).alias("pos", "word")).where(~F.col("word").isin(t.STOPWORDS))
    counted = words.groupBy(*keys, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first"))
    top = counted.withColumn("rank", best).where(F.col("rank") <= limit)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda r: r["word"]).alias("terms"))


def with_key_terms(turns: DataFrame, keys: list[str], answer: str = "answer", limit: int = 6) -> DataFrame:
    """turns with key_terms; turns without any term have none."""
    terms = ranked_terms(turns, keys, F.concat("prompt", F.lit(" "), answer), limit).withColumnRenamed("terms", "key_terms")
    return turns.join(terms, keys, "left").withColumn("key_terms", F.coalesce("key_terms", F.array().cast("array<string>")))


def key_topics(turns: DataFrame, keys: list[str], order: str = "turn_index", limit: int = 8) -> DataFrame:
    """keys and terms: terms of all turns' key terms in order."""
    joined = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "key_terms"))), lambda r: r["key_terms"])), " ")
    return ranked_terms(turns.groupBy(*keys).agg(joined.alias("all_terms")), keys, F.col("all_terms"), limit)


def conversation_signals(turns: DataFrame, keys: list[str], order: str = "turn_index", chars: str = "answer_length", more: list[Column] | None = None) -> DataFrame:
    """Aggregates of scored turns, and more of the same pass; the engagement bonus is in aggregate_score only."""
    exact = F.sum(F.col("score").cast("decimal(10,4)")).cast("double")
    later = F.col(order) > 0
    count = lambda c: F.count_if(c)
    out = turns.groupBy(*keys).agg(
        F.count("*").alias("turn_count"),
        F.round(exact, 3).alias("total_score"),
        count(F.col("question_like")).alias("question_turns"),
        count(F.col("definition_like")).alias("definition_turns"),
        count(F.col("code_blocks") > 0).alias("code_turns"),
        F.sum("bullet_count").alias("total_bullets"),
        F.sum("heading_count").alias("total_headings"),
        F.max(F.length("prompt")).alias("max_user_prompt_chars"),
        count(later & t.any_of(F.lower("prompt"), t.FOLLOWUP_PHRASES)).alias("followup_turns"),
        count(later & t.any_of(F.lower("answer"), t.CORRECTION_PHRASES)).alias("correction_turns"),
        F.sum(F.length("prompt") + F.col(chars)).alias("total_char_count"),
        *(more or []),
    )
    bonus = F.when((F.col("turn_count") >= 2) & (F.col("question_turns") > 0), 0.5).otherwise(0.0)
    return out.withColumns({"avg_score": F.round(F.col("total_score") / F.col("turn_count"), 6), "has_mega_paste": F.col("max_user_prompt_chars") > 20000, "aggregate_score": F.round(F.col("total_score") + bonus, 4)})


def assembled(turns: DataFrame, keys: list[str], columns: list[str], order: str = "turn_index") -> DataFrame:
    """One row per conversation with its turns in order."""
    return turns.groupBy(*keys).agg(in_order(columns, order))


def in_order(columns: list[str], order: str = "turn_index") -> Column:
    """The aggregate turns: columns of all rows as structs, in order."""
    return F.array_sort(F.collect_list(F.struct(order, *columns))).alias("turns")
