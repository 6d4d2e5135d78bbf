"""Transcript files: scan, render, change status, sinks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.text import slugify, strip
from .store import exists


def scan_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime and value of each transcript below root; column pruning and filters on path reach the scan."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("ignoreCorruptFiles", True).load(root)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), "value")


def render_transcripts(messages: DataFrame, base_url: str = "") -> DataFrame:
    """conversation_id, day, path and value of each conversation from message rows (title, pos, role, ts_raw, text, and created and updated where the export has them; else the messages' own times count).

    With base_url the header links to the conversation. A conversation
    without a title is named by its identifier in its path. Every
    conversation has a path of its own: of those of one title and day the one
    of the smallest identifier is named by the title alone, the others' names
    end in a part of their identifier's digest.
    """
    empty = F.lit("")
    stamp = F.when(F.coalesce("ts_raw", empty) != "", F.concat(F.lit("["), "ts_raw", F.lit("] "))).otherwise("")
    said = F.when(strip(F.coalesce("text", empty)) != "", F.concat(F.lit("\n"), "text")).otherwise("")
    block = F.concat(stamp, F.col("role"), F.lit(":"), said, F.lit("\n"))
    blocks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("block")))), lambda b: b["block"]), "\n")
    own = {"created", "updated"} <= set(messages.columns)
    first, last = (F.max("created"), F.max("updated")) if own else (F.min(F.nullif("ts_raw", empty)), F.max(F.nullif("ts_raw", empty)))
    g = messages.groupBy("conversation_id").agg(F.max("title").alias("title"), F.nullif(first, empty).alias("created"), F.nullif(last, empty).alias("updated"), blocks.alias("blocks"))
    named = F.nullif(F.col("title"), empty)
    day = F.substring(F.coalesce("created", "updated"), 1, 10)
    day = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day)
    name = slugify(F.coalesce(named, F.concat(F.lit("chat-"), F.col("conversation_id").cast("string"))))
    stem = F.when(day.isNotNull(), F.concat(F.replace(day, F.lit("-"), F.lit("/")), F.lit("/"), day, F.lit("_"), name)).otherwise(F.concat(F.lit("undated/"), name))
    link = F.concat(F.lit(f"- URL: {base_url}"), F.col("conversation_id").cast("string")) if base_url else F.lit(None).cast("string")
    facts = F.filter(F.array(link, F.concat(F.lit("- Created: "), "created"), F.concat(F.lit("- Updated: "), "updated")), lambda x: x.isNotNull())
    meta = F.when(F.size(facts) > 0, F.concat(F.array_join(facts, "\n"), F.lit("\n\n"))).otherwise("")
    value = F.concat(F.lit("# "), F.coalesce(named, F.lit("Untitled Chat")), F.lit("\n\n"), meta, F.lit("---\n\n"), "blocks")
    g = g.withColumn("stem", stem)
    first = g.groupBy(F.col("stem").alias("of")).agg(F.min("conversation_id").alias("first"), F.count("*").alias("named")).where("named > 1")
    own = F.concat("stem", F.lit("-"), F.left(F.sha2(F.coalesce(F.col("conversation_id").cast("string"), F.lit("")), 256), F.lit(12)))
    g = g.join(first, F.col("stem") == F.col("of"), "left")
    path = F.concat(F.when(F.col("first").isNull() | F.col("conversation_id").eqNullSafe(F.col("first")), F.col("stem")).otherwise(own), F.lit(".md"))
    return g.select("conversation_id", day.alias("day"), path.alias("path"), F.concat(F.regexp_replace(value, r"(?U)\s+$", ""), F.lit("\n")).alias("value"))


def write_transcripts(rendered: DataFrame, out: str) -> None:
    parts = F.split("day", "-")
    rows = rendered.withColumns({"year": F.coalesce(parts[0], F.lit("undated")), "month": parts[1], "day": parts[2]})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", "day").parquet(out)


DRAFT = "path string, status string, draft string, attempt string"


def _tree(root: str):
    return pafs.FileSystem.from_uri(root)


def _put(files, place: str, data: bytes) -> None:
    """Whole or not at all: written beside its place, then moved there."""
    draft = f"{place}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as f:
        f.write(data)
    files.move(draft, place)


@dataclass
class _Drafted(WriterCommitMessage):
    attempt: str


class _TreeWriter(DataSourceWriter):
    """Tasks write drafts and a manifest of them; the commit names the attempts that count; an abort leaves nothing."""

    def __init__(self, root: str, job: str):
        self._root, self._job = root, job

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, top = _tree(self._root)
        attempt = str(TaskContext.get().taskAttemptId())
        folder = f"_drafts/{self._job}/{attempt}"
        files.create_dir(f"{top}/{folder}", recursive=True)
        with files.open_output_stream(f"{top}/{folder}/manifest.json") as manifest:
            for n, (path, value) in enumerate(iterator):
                new, old, draft = value.encode(), None, None
                if files.get_file_info(f"{top}/{path}").type == pafs.FileType.File:
                    with files.open_input_file(f"{top}/{path}") as f:
                        old = f.read()
                if old != new:
                    draft = f"{folder}/{n}.md"
                    with files.open_output_stream(f"{top}/{draft}") as f:
                        f.write(new)
                status = "skipped" if old == new else "written" if old is None else "updated"
                manifest.write(json.dumps({"path": path, "status": status, "draft": draft, "attempt": attempt}).encode() + b"\n")
        return _Drafted(attempt)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, top = _tree(self._root)
        files.create_dir(f"{top}/_drafts/{self._job}", recursive=True)
        _put(files, f"{top}/_drafts/{self._job}/committed.json", json.dumps([m.attempt for m in messages if m]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, top = _tree(self._root)
        if files.get_file_info(f"{top}/_drafts/{self._job}").type == pafs.FileType.Directory:
            files.delete_dir(f"{top}/_drafts/{self._job}")


class MarkdownTree(DataSource):
    """The format markdown_tree: rows of path and value as drafts below root, under the name of a job."""

    @classmethod
    def name(cls) -> str:
        return "markdown_tree"

    def schema(self) -> str:
        return "path string, value string"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return _TreeWriter(self.options["root"], self.options["job"])


def write_markdown(rendered: DataFrame, root: str) -> DataFrame:
    """Writes each transcript (path, value) as a file of its own below root, where its text is new or another; path and status of each.

    Nothing changes at its place before all tasks have written their drafts
    and the commit names them; then a second job moves the drafts. A failed
    write leaves no file behind; one that fails after its commit is ended by
    publish(). Paths must be distinct, as render_transcripts() makes them.
    """
    spark, job = rendered.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(MarkdownTree)
    rendered.select("path", "value").write.format("markdown_tree").mode("append").option("root", root).option("job", job).save()
    return publish(spark, root, job)


def publish(spark: SparkSession, root: str, job: str) -> DataFrame:
    """Moves a committed job's drafts to their places, keeps its statuses below root/_commits, and gives them. It may be repeated, and goes on where it was cut off."""
    files, top = _tree(root)
    root, kept = root.rstrip("/"), f"{root.rstrip('/')}/_commits/{job}"
    if files.get_file_info(f"{top}/_commits/{job}/_SUCCESS").type != pafs.FileType.File:
        with files.open_input_file(f"{top}/_drafts/{job}/committed.json") as f:
            attempts = json.loads(f.read())  # a name for each task

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, top = _tree(root)
            for batch in batches:
                for path, draft in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if draft and files.get_file_info(f"{top}/{draft}").type == pafs.FileType.File:  # else a task before has moved it
                        files.create_dir(f"{top}/{path}".rpartition("/")[0], recursive=True)
                        files.move(f"{top}/{draft}", f"{top}/{path}")
                yield batch.select([0, 1])

        written = spark.read.schema(DRAFT).json(f"{root}/_drafts/{job}/*/manifest.json").where(F.col("attempt").isin(attempts)) if attempts else spark.createDataFrame([], DRAFT)
        written.mapInArrow(move, "path string, status string").write.mode("overwrite").parquet(kept)
    if files.get_file_info(f"{top}/_drafts/{job}").type == pafs.FileType.Directory:
        files.delete_dir(f"{top}/_drafts/{job}")
    return spark.read.schema("path string, status string").parquet(kept)


def upsert_status(new: DataFrame, existing: DataFrame) -> DataFrame:
    """path and status of each new text: written, skipped (equal bytes) or updated."""
    old = existing.select("path", F.col("value").alias("old"))
    status = F.when(F.col("old").isNull(), "written").when(F.col("old") == F.col("value"), "skipped").otherwise("updated")
    return new.join(old, "path", "left").select("path", status.alias("status"))


RUN_TURN = "turn_index int, context_id string, prompt string"


def write_run(conversations: DataFrame, cards: DataFrame, out: str) -> None:
    """Both with run_id; a run that is written again replaces itself."""
    for df, name in ((conversations, "conversations"), (cards, "cards")):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(f"{out}/{name}")


def run_turns(conversations: DataFrame) -> DataFrame:
    """The turns of stored conversations, one row each."""
    return conversations.select(*[c for c in ("run_id", "conversation_id") if c in conversations.columns], F.inline("turns"))


def read_run_turns(spark: SparkSession, out: str) -> DataFrame:
    """run_id, conversation_id and RUN_TURN of all runs' turns: from conversations, or of runs of the older layout, which have single turns (contexts) only, without a conversation_id."""
    def stored(name: str, schema: str) -> DataFrame:
        schema = f"{schema}, run_id string"
        return spark.read.schema(schema).json(f"{out}/{name}") if exists(spark, f"{out}/{name}") else spark.createDataFrame([], schema)

    whole = stored("conversations", f"conversation_id string, turns array<struct<{RUN_TURN.replace(' ', ': ').replace(',:', ',')}>>")
    older = stored("contexts", RUN_TURN).join(whole.select("run_id").distinct(), "run_id", "left_anti")
    return run_turns(whole).unionByName(older.withColumn("conversation_id", F.lit(None).cast("string")))
