"""File filters, seen identifiers, and state tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text

NAME_DATE = r"(\d{4}-\d{2}-\d{2})"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def date_bounds(spec: str | None) -> tuple[str, str]:
    """First day and day after the last, as strings; empty: open."""
    if not spec:
        return "", ""
    if ":" in spec:
        start, _, end = spec.partition(":")
        return start.strip(), end.strip()
    if re.fullmatch(r"\d{4}-\d{2}", spec):
        year, month = map(int, spec.split("-"))
        return f"{spec}-01", f"{year + month // 12}-{month % 12 + 1:02d}-01"
    return spec, ""


def filter_date_range(files: DataFrame, spec: str | None) -> DataFrame:
    """Files whose name's date lies in the range, or has none. A range without a start keeps all."""
    start, end = date_bounds(spec)
    if not start:
        return files
    day = F.regexp_extract(file_name(F.col("path")), NAME_DATE, 1)
    return files.where((day == "") | ((day >= start) & ((day < end) if end else F.lit(True))))


def glob_pattern(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c, end = glob[i], glob.find("]", i + 2) if glob[i] == "[" else -1
        if end > 0:
            inside = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return out


def filter_exclude_glob(files: DataFrame, globs: list[str]) -> DataFrame:
    """Files whose name matches none of the patterns."""
    return files.where(~file_name(F.col("path")).rlike("(?s)^(" + "|".join(map(glob_pattern, globs)) + ")$")) if globs else files


def filter_unprocessed(files: DataFrame, processed: DataFrame) -> DataFrame:
    return files.join(processed.select("path"), "path", "left_anti")


def filter_zero_card(files: DataFrame, processed: DataFrame) -> DataFrame:
    return files.join(processed.where("cards_generated = 0").select("path"), "path", "left_semi")


def filter_unprocessed_or_zero(files: DataFrame, processed: DataFrame) -> DataFrame:
    return files.join(processed.where("cards_generated != 0").select("path"), "path", "left_anti")


def filter_seen(conversations: DataFrame, seen: DataFrame, zero_card_files: DataFrame | None = None) -> DataFrame:
    """Conversations not seen; those of zero-card files pass all the same."""
    ids = seen.select("conversation_id").distinct().withColumn("was_seen", F.lit(True))
    x = conversations.join(ids, "conversation_id", "left")
    fresh = F.col("was_seen").isNull()
    if zero_card_files is not None:
        x = x.join(zero_card_files.select("path").distinct().withColumn("zero", F.lit(True)), "path", "left")
        fresh = fresh | F.col("zero").isNotNull()
    return x.where(fresh).select(*conversations.columns)


def find_stubs(files: DataFrame, turns: DataFrame) -> DataFrame:
    return files.join(turns.select("path").distinct(), "path", "left_anti")


def dated_files(files: DataFrame) -> DataFrame:
    """Files without hidden path parts that have a date in their name, else in another part: with day."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith("."))
    in_parts = F.filter(F.transform(parts, lambda p: F.regexp_extract(p, NAME_DATE, 1)), lambda d: d != "")
    found = F.coalesce(F.nullif(F.regexp_extract(file_name(F.col("path")), NAME_DATE, 1), F.lit("")), F.try_element_at(in_parts, F.lit(1)))
    return files.where(~hidden).withColumn("day", F.try_to_timestamp(found, F.lit("yyyy-MM-dd")).cast("date")).where("day is not null")


def latest_per_key(records: DataFrame, key: str, at: str) -> DataFrame:
    """The last record of each key; of equal times the one that compares greatest."""
    rest = [c for c in records.columns if c != key]
    row = F.max(F.struct(at, *[c for c in rest if c != at])).alias("r")
    return records.groupBy(key).agg(row).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def union_ids(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("conversation_id")
    for t in tables[1:]:
        out = out.unionByName(t.select("conversation_id"))
    return out.distinct()


def migrate_turns(turns: DataFrame) -> DataFrame:
    """Conversations from single turns of the older state: grouped by path, terms in order of first occurrence."""
    w = Window.partitionBy("source_path").orderBy(F.coalesce("turn_index", F.lit(0)), "context_id")
    x = turns.withColumn("source_path", F.coalesce("source_path", F.lit("unknown"))).withColumn("i", F.row_number().over(w) - 1)
    terms = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "key_terms"))), lambda r: r["key_terms"])))
    return x.groupBy("source_path").agg(
        F.count("*").alias("turn_count"),
        F.round(F.sum(F.col("score").cast("decimal(10,4)")).cast("double") / F.count("*"), 6).alias("aggregate_score"),
        F.sum(F.length("answer")).alias("total_char_count"),
        F.slice(terms, 1, 10).alias("key_topics"),
        F.sha2(F.concat(F.first("source_path"), F.lit(":migrated")), 256).alias("conversation_id"),
    )


def files_decided(conversations: DataFrame, skipped: DataFrame, rejected: DataFrame, seen: DataFrame) -> DataFrame:
    """Files of which every conversation is decided, with the status they get."""
    def mark(df: DataFrame, name: str) -> DataFrame:
        return df.select("conversation_id").distinct().withColumn(name, F.lit(True))

    x = conversations
    for df, name in ((skipped, "skip"), (rejected, "reject"), (seen, "seen")):
        x = x.join(mark(df, name), "conversation_id", "left")
    decided = F.col("skip").isNotNull() | F.col("reject").isNotNull() | F.col("seen").isNotNull()
    per = x.groupBy("path").agg(F.every(decided).alias("all_decided"), F.bool_or(F.col("reject").isNotNull()).alias("any_rejected"))
    return per.where("all_decided").select("path", F.when(F.col("any_rejected"), "stage1_rejected").otherwise("dedup_skipped").alias("status"))


def months_with_work(files: DataFrame) -> DataFrame:
    month = F.substring(F.regexp_extract(file_name(F.col("path")), NAME_DATE, 1), 1, 7)
    return files.withColumn("month", month).where("month != ''").groupBy("month").agg(F.count("*").alias("n_files")).orderBy(F.desc("month"))


def reconcile_seen(files: DataFrame, processed: DataFrame, seen: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Unprocessed files (path, conversation_id) that no pattern excludes and whose identifier is a seen one, the last _part suffix aside."""
    base = seen.select(F.regexp_replace("conversation_id", "^(.*)_part.*$", "$1").alias("conversation_id")).distinct()
    left = filter_exclude_glob(filter_unprocessed(files, processed), exclude or [])
    return left.join(base, "conversation_id", "left_semi").select("path", F.lit("reconciled").alias("status"))


def reconcile_stubs(files: DataFrame, processed: DataFrame, turns: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Unprocessed files that no pattern excludes and that have no turn."""
    left = filter_exclude_glob(filter_unprocessed(files, processed), exclude or [])
    return find_stubs(left, turns).select("path", F.lit("stub_file").alias("status"))


def book_files(processed: DataFrame, conversations: DataFrame, cards: DataFrame, at: Column) -> DataFrame:
    """processed (path, cards_generated, processed_at, status) with the files of a run's conversations (path, conversation_id), each with the number of its cards, unless it has a row already."""
    new = cards_per_file(filter_unprocessed(conversations, processed), cards)
    return processed.select("path", "cards_generated", "processed_at", "status").unionByName(new.select("path", F.col("cards").alias("cards_generated"), at.alias("processed_at"), F.lit("generated").alias("status")))


def run_record(conversations: DataFrame, run_dir: str, at: Column) -> DataFrame:
    """The row that a run adds to the history."""
    n = F.countDistinct("conversation_id")
    return conversations.agg(n.alias("contexts_sent"), n.alias("conversations_sent")).select(F.lit(run_dir).alias("run_dir"), at.alias("timestamp"), "contexts_sent", "conversations_sent")


def cards_per_file(conversations: DataFrame, cards: DataFrame) -> DataFrame:
    n = cards.groupBy("conversation_id").agg(F.count("*").alias("n"))
    return conversations.select("path", "conversation_id").distinct().join(n, "conversation_id", "left").groupBy("path").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cards"))


def missing_decks(cards: DataFrame, existing: DataFrame) -> DataFrame:
    return cards.select("deck").distinct().join(existing.select("deck"), "deck", "left_anti")


def load_cards(notes: DataFrame, decks: list[str]) -> DataFrame:
    """Notes of the chosen decks that have a front or a back (if only of white space), in the decks' order, with normalised sides."""
    x = notes.where(F.col("deck").isin(decks)).where("not (coalesce(front, '') = '' and coalesce(back, '') = '')")
    place = F.array_position(F.array(*map(F.lit, decks)), F.col("deck"))
    return x.withColumns({"deck_order": place, "front_norm": normalize_text(F.coalesce("front", F.lit(""))), "back_norm": normalize_text(F.coalesce("back", F.lit("")))})


def card_context(cards: DataFrame, turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """cards with the path and prompt of their turn: by context_id, else by conversation and turn. conversations (conversation_id, title, url, key_topics, turn_count) adds what the turn's conversation has."""
    kept = {"path": "path", "prompt": "prompt", "found_in": "conversation_id"}

    def side(n: int, **keys: str) -> DataFrame:
        return turns.select(*[F.col(c).alias(k) for k, c in keys.items()], *[F.col(c).alias(f"{k}_{n}") for k, c in kept.items()])

    x = cards.join(side(1, c="context_id").dropDuplicates(["c"]), F.col("context_id") == F.col("c"), "left").join(side(2, v="conversation_id", i="turn_index"), (F.col("conversation_id") == F.col("v")) & (F.col("turn_index") == F.col("i")), "left")
    x = x.select(*[cards[k] for k in cards.columns], *[F.coalesce(f"{k}_1", f"{k}_2").alias(k) for k in kept])
    if conversations is None:
        return x.drop("found_in")
    about = conversations.select(F.col("conversation_id").alias("found_in"), *[F.col(c).alias(f"conversation_{c}") for c in ("title", "url", "key_topics", "turn_count")])
    return x.join(about, "found_in", "left").drop("found_in")


def apply_decisions(conversations: DataFrame, decisions: DataFrame, strict: bool = False) -> DataFrame:
    """Conversations (with batch) to go on with: kept ones, or the whole batch where none is kept."""
    kept = decisions.where("keep and conversation_id is not null").select("batch", "conversation_id").distinct().withColumn("kept", F.lit(True))
    x = conversations.join(kept, ["batch", "conversation_id"], "left")
    some = kept.select("batch").distinct().withColumn("some", F.lit(True))
    x = x.join(some, "batch", "left")
    rule = F.col("kept").isNotNull() if strict else F.col("kept").isNotNull() | F.col("some").isNull()
    return x.where(rule).select(*conversations.columns)
