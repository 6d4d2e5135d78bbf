"""From transcript text to entries and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ANSWER_LIMIT, LINE_END, lines, non_content, strip
from .scans import scanned

# Fixed values.
ASSISTANT_START = "Assistant started conversation (no user prompt in export)"
ENTRY = r"(?i)^\[([^\]]+)\]\s+(user|human|assistant|tool):\s*$"


def joined(order: str, text: str, when: Column | None = None, sep: str = "\n\n") -> Column:
    """Texts in order, without nulls and those that `when` leaves out."""
    row = F.struct(order, text)
    rows = F.collect_list(F.when(when, row) if when is not None else row)
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r[text]), sep)


def transcript_parts(files: DataFrame) -> DataFrame:
    """path, header and body of transcripts (path, value), split at the first line that starts with three dashes."""
    at = F.instr("value", "\n---")
    rest = F.expr("substring(value, instr(value, '\n---') + 4)")
    body = F.when(at > 0, F.regexp_replace(rest, "^[^\n]*\n?", "")).otherwise("")
    return files.select("path", F.when(at > 0, F.expr("left(value, instr(value, '\n---') - 1)")).otherwise(F.col("value")).alias("header"), body.alias("body"))


def transcript_metadata(parts: DataFrame) -> DataFrame:
    """path, key, value of each header: title and `- key: value` lines; later ones win."""
    title = strip(F.regexp_extract("header", r"(?m)^#\s+(.+)$", 1))
    items = F.filter(lines(F.col("header")), lambda l: l.rlike("^- [^:]*:"))
    pairs = F.transform(items, lambda l, i: F.struct((i + 1).alias("i"), F.lower(strip(F.regexp_extract(l, r"^- ([^:]*):(.*)$", 1))).alias("key"), strip(F.regexp_extract(l, r"^- ([^:]*):(.*)$", 2)).alias("value")))
    first = F.when(title != "", F.array(F.struct(F.lit(0).alias("i"), F.lit("title").alias("key"), title.alias("value")))).otherwise(F.array().cast("array<struct<i:int,key:string,value:string>>"))
    return parts.select("path", F.explode(F.concat(first, pairs)).alias("p")).groupBy("path", F.col("p.key").alias("key")).agg(F.max_by("p.value", "p.i").alias("value"))


def parse_entries(parts: DataFrame, spread: int | None = None) -> DataFrame:
    """path, entry (from 0), role, ts_raw, text of a transcript's body. Lines before the first header are dropped. spread: lines to a task's block, for transcripts too long for one task."""
    rows = parts.select("path", F.posexplode(lines(F.col("body"))).alias("pos", "line"))
    head = F.col("line").rlike(ENTRY)
    if spread:
        rows = scanned(rows, ["path"], "pos", spread, {"entry": head.cast("long")}).withColumn("entry", F.col("entry") - 1)
    else:
        w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("entry", F.sum(head.cast("int")).over(w) - 1)
    rows = rows.where("entry >= 0").withColumn("head", head)
    role = F.lower(F.max(F.when(F.col("head"), F.regexp_extract("line", ENTRY, 2))))
    return rows.groupBy("path", "entry").agg(
        F.when(role == "human", "user").otherwise(role).alias("role"),
        strip(F.max(F.when(F.col("head"), F.regexp_extract("line", ENTRY, 1)))).alias("ts_raw"),
        strip(joined("pos", "line", ~F.col("head"), "\n")).alias("text"),
    )


def pair_turns(entries: DataFrame, path: str = "path", pos: str = "pos", spread: int | None = None) -> DataFrame:
    """path, turn_index, user_ts, prompt, assistant_ts, answer.

    A run of user entries opens a turn, the assistant entries up to the next
    user entry answer it. Blank users count as an opening only. Assistants
    before the first user answer a fixed prompt. Other roles take no part.
    spread: places to a task's block, for paths too long for one task; it
    moves the texts once more.
    """
    e = entries.select(F.col(path).alias("path"), F.col(pos).alias("pos"), "role", strip(F.coalesce("text", F.lit(""))).alias("text"), "ts_raw")
    e = e.where((F.col("role") == "user") | ((F.col("role") == "assistant") & (F.col("text") != "")))
    starts = lambda before: ((F.col("role") == "user") & (F.coalesce(before, F.lit("")) != "user")).cast("long")
    if spread:
        e = scanned(e, ["path"], "pos", spread, lasts={"before": F.col("role")}, inclusive=False)
        e = scanned(e, ["path"], "pos", spread, {"grp": starts(F.col("before"))})
    else:
        w = Window.partitionBy("path").orderBy("pos")
        e = e.withColumn("opens", starts(F.lag("role").over(w))).withColumn("grp", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    user, reply = (F.col("role") == "user") & (F.col("text") != ""), F.col("role") == "assistant"
    substance = reply & ~non_content(F.col("text"))
    g = e.groupBy("path", "grp").agg(
        joined("pos", "text", user).alias("users"),
        joined("pos", "text", substance).alias("replies"),
        F.max_by(F.when(reply, F.col("text")), F.when(reply, F.col("pos"))).alias("last_reply"),
        F.max_by(F.when(reply, F.col("ts_raw")), F.when(reply, F.col("pos"))).alias("assistant_ts"),
        F.min_by(F.when(user, F.col("ts_raw")), F.when(user, F.col("pos"))).alias("user_ts"),
    )
    g = g.where("last_reply is not null and (users != '' or grp = 0)")
    g = scanned(g, ["path"], "grp", spread, {"nth": F.lit(1).cast("long")}) if spread else g.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("grp")))
    start = F.col("grp") == 0
    return g.select(
        "path",
        (F.col("nth") - 1).alias("turn_index"),
        F.when(start, F.col("assistant_ts")).otherwise(F.col("user_ts")).alias("user_ts"),
        F.when(start, F.lit(ASSISTANT_START)).otherwise(F.col("users")).alias("prompt"),
        "assistant_ts",
        strip(F.when(F.col("replies") != "", F.col("replies")).otherwise(F.col("last_reply"))).alias("answer"),
    )


def build_turns(turns: DataFrame, answer_limit: int = ANSWER_LIMIT, first: Column | None = None) -> DataFrame:
    """Turns with conversation_id, context_id, answer_chars and the answer cut. first: the user_ts of the path's first turn, where turns has not all turns of a path."""
    first = F.first("user_ts").over(Window.partitionBy("path").orderBy("turn_index")) if first is None else first
    stamp = F.coalesce("user_ts", F.lit(""))
    return turns.select(
        "path", "turn_index",
        F.sha2(F.concat("path", F.lit(":"), F.coalesce(first, F.lit(""))), 256).alias("conversation_id"),
        F.sha2(F.concat("path", F.lit(":"), stamp, "prompt", "answer"), 256).alias("context_id"),
        "user_ts", "assistant_ts", "prompt",
        F.substring("answer", 1, answer_limit).alias("answer"),
        F.length("answer").alias("answer_chars"),
        F.col("answer").alias("full_answer"),
    )
