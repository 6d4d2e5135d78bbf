"""Conversation exports in two dialects, as message rows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import convert_latex, format_iso, format_unix, strip, strip_citations

MAPPING = """
    id string, conversation_id string, title string, create_time double, update_time double,
    mapping map<string, struct<message: struct<id: string, author: struct<role: string>, create_time: double,
        content: string, metadata: struct<is_visually_hidden_from_conversation: boolean>>>>
"""
MESSAGES = """
    uuid string, name string, created_at string, updated_at string,
    chat_messages array<struct<sender: string, created_at: string,
        content: array<struct<type: string, text: string, thinking: string, name: string, message: string, content: array<struct<type: string, text: string>>>>,
        attachments: array<struct<file_name: string, file_type: string, file_size: long, extracted_content: string>>>>
"""
CONTENT = "content_type string, parts array<string>"
ATTACHMENT_LIMIT = 1000
MESSAGE = ["conversation_id", "title", "created", "updated", "pos", "role", "ts_raw", "text"]


def detect_format(records: DataFrame) -> str:
    """By the first record: messages if it has both a uuid and chat_messages, else mapping."""
    if {"uuid", "chat_messages"} <= set(records.columns):
        first = records.select("uuid", "chat_messages").first()
        if first is not None and first["uuid"] is not None and first["chat_messages"] is not None:
            return "messages"
    return "mapping"


def read_export(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def cleaned(text: Column) -> Column:
    """Without citation marks, formulas in dollar signs, without white space around."""
    return strip(convert_latex(strip_citations(text)))


def lines_of(*parts: Column) -> Column:
    """Arrays of lines as one text, without nulls."""
    return F.array_join(F.filter(F.concat(*parts), lambda x: x.isNotNull()), "\n")


def content_text(raw: Column, content: Column) -> Column:
    """Text parts joined by a blank line and cleaned, each image after them as a pointer; contents of other kinds as their JSON. raw: the content's JSON; content: the same, parsed."""
    kind = lambda p: F.get_json_object(p, "$.content_type")
    parts = F.coalesce(content["parts"], F.array().cast("array<string>"))
    body = cleaned(F.array_join(F.filter(parts, lambda p: p.isNotNull() & kind(p).isNull()), "\n\n"))
    images = F.transform(parts, lambda p: F.when(kind(p) == "image_asset", F.concat(F.lit("\n[image asset: "), F.get_json_object(p, "$.asset_pointer"), F.lit("]\n"))))
    both = lines_of(F.array(F.nullif(body, F.lit(""))), images)
    return F.when(content["content_type"] == "text", body).when(content["content_type"] == "multimodal_text", both).otherwise(F.coalesce(raw, F.lit("{}")))


def mapping_messages(records: DataFrame) -> DataFrame:
    """MESSAGE columns: all nodes by time and id, without hidden and empty messages. created and updated are the conversation's own times."""
    m = records.select(
        F.coalesce("id", "conversation_id").alias("conversation_id"), "title", format_unix(F.col("create_time")).alias("created"), format_unix(F.col("update_time")).alias("updated"), F.explode(F.map_values("mapping")).alias("node")
    ).select("conversation_id", "title", "created", "updated", F.col("node.message").alias("m"))
    m = m.where("m is not null").where(~F.coalesce(F.col("m.metadata.is_visually_hidden_from_conversation"), F.lit(False)))
    m = m.withColumn("content", F.from_json("m.content", CONTENT)).withColumn("text", content_text(F.col("m.content"), F.col("content")))
    m = m.where(strip(F.col("text")) != "")
    order = Window.partitionBy("conversation_id").orderBy(F.coalesce("m.create_time", F.lit(0.0)), F.coalesce("m.id", F.lit("")))
    role = F.coalesce(F.nullif(strip(F.col("m.author.role")), F.lit("")), F.lit("unknown"))
    return m.select("conversation_id", "title", "created", "updated", (F.row_number().over(order) - 1).alias("pos"), role.alias("role"), format_unix(F.col("m.create_time")).alias("ts_raw"), "text")


def block_lines(b: Column) -> Column:
    """A block's lines; null where it says nothing."""
    said, thought = F.nullif(cleaned(b["text"]), F.lit("")), F.nullif(cleaned(b["thinking"]), F.lit(""))
    name, inner = F.coalesce(b["name"], F.lit("unknown")), F.filter(b["content"], lambda c: c["type"] == "text")
    result = lines_of(F.array(F.concat(F.lit("**[Tool Result: "), name, F.lit("]**"))), F.transform(inner, lambda c: F.nullif(cleaned(c["text"]), F.lit(""))))
    return (
        F.when(b["type"] == "text", said)
        .when(b["type"] == "thinking", F.concat(F.lit("<details>\n<summary>Thinking</summary>\n\n"), thought, F.lit("\n\n</details>")))
        .when(b["type"] == "tool_use", F.concat(F.lit("**[Tool Use: "), name, F.lit("]** "), F.coalesce(b["message"], F.lit(""))))
        .when((b["type"] == "tool_result") & (F.size(b["content"]) > 0), result)
    )


def attachment_text(a: Column) -> Column:
    head = F.format_string("\n**[Attachment: %s]** (%s, %d bytes)\n", F.coalesce(a["file_name"], F.lit("unknown")), F.coalesce(a["file_type"], F.lit("")), F.coalesce(a["file_size"], F.lit(0)))
    body = a["extracted_content"]
    cut = F.when(F.length(body) > ATTACHMENT_LIMIT, "\n... (truncated)").otherwise("")
    details = F.concat(F.lit("\n<details>\n<summary>Attachment content</summary>\n\n```\n"), F.substring(body, 1, ATTACHMENT_LIMIT), cut, F.lit("\n```\n</details>"))
    return F.concat(head, F.when(F.coalesce(body, F.lit("")) != "", details).otherwise(""))


def chat_messages(records: DataFrame) -> DataFrame:
    """MESSAGE columns: messages in their order, blocks joined by line, attachments after them. A message without any content stays, with an empty text."""
    m = records.select(
        F.col("uuid").alias("conversation_id"), F.col("name").alias("title"), format_iso(F.col("created_at")).alias("created"), format_iso(F.col("updated_at")).alias("updated"), F.posexplode("chat_messages").alias("pos", "m")
    )
    none = F.array().cast("array<string>")
    text = lines_of(F.coalesce(F.transform("m.content", block_lines), none), F.coalesce(F.transform("m.attachments", attachment_text), none))
    role = F.coalesce(F.nullif(F.col("m.sender"), F.lit("")), F.lit("unknown"))
    return m.select("conversation_id", "title", "created", "updated", "pos", role.alias("role"), format_iso(F.col("m.created_at")).alias("ts_raw"), text.alias("text"))


# --- records of large files --------------------------------------------------

#: Bytes that one task reads of a file.
SPLIT = 64 << 20
RECORD = "path string, start long, record string, error string"
_SUMMARY = "path string, start long, end long, quotes long, outside long, inside long, first int"


def _opened(path: str):
    files, place = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return files.open_input_file(place)


def _escaped_first(file, start: int) -> bool:
    """Whether the byte at start is escaped: an odd number of backslashes stands before it."""
    n = 0
    while start - n > 0 and file.read_at(1, start - n - 1) == b"\\":
        n += 1
    return n % 2 == 1


def _quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Places of the quotes that no backslash escapes."""
    slash = data == 92
    at = np.arange(len(data))
    other = np.where(~slash, at, -1)
    before = np.maximum.accumulate(np.concatenate([[-1], other[:-1]])) if len(data) else other  # the last byte before each that is no backslash
    n = at - before - 1 + np.where(before < 0, int(escaped), 0)
    return np.flatnonzero((data == 34) & (n % 2 == 0))


def _depths(data: np.ndarray, quotes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of brackets, whether an even number of quotes stands before each, and its step up or down: places and steps, the latter 0 where the number is odd."""
    at = np.flatnonzero(((data | 32) == 123) | ((data | 32) == 125))  # [ { and ] } differ in one bit
    step = np.where((data[at] | 32) == 123, 1, -1)
    return at, np.where(np.searchsorted(quotes, at) % 2 == 0, step, 0)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: its quotes, and the change of depth if it starts outside a text, or inside one; first: the file's first byte that is no white space."""
    for batch in batches:
        rows = []
        for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with _opened(path) as file:
                escaped = _escaped_first(file, start)
                data = np.frombuffer(file.read_at(end - start, start), np.uint8)
            quotes = _quotes(data, escaped)
            at, step = _depths(data, quotes)
            every = np.where((data[at] | 32) == 123, 1, -1)
            head = bytes(data[:64]).removeprefix(b"\xef\xbb\xbf").lstrip()[:1] if start == 0 else b""
            rows.append((path, start, end, len(quotes), int(step.sum()), int((every - step).sum()), head[0] if head else -1))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.string(), *[pa.int64()] * 5, pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in _SUMMARY.split(", ")])


@dataclass
class Range(InputPartition):
    """Bytes of a file, and what stands open before them; base: the depth at which records start."""

    path: str
    start: int
    end: int
    depth: int
    inside: bool
    base: int


class _Records(DataSourceReader):
    def __init__(self, ranges: list[Range]):
        self._ranges = ranges

    def partitions(self) -> list[Range]:
        return self._ranges

    def read(self, partition: Range) -> Iterator[tuple]:
        """Records that start in the range; the last one may end behind it. What stands between records and is neither comma nor bracket is an error of its own."""
        p = partition
        with _opened(p.path) as file:
            size = file.size()
            data, end, escaped = b"", p.start, _escaped_first(file, p.start)
            while True:  # to the end of the range, then on until the last record is closed
                more = file.read_at(min(SPLIT, (p.end if end < p.end else size) - end), end)
                data, end = data + more, end + len(more)
                if end < p.end:
                    continue
                found, closed = _cut(data, p, escaped)
                if closed or end >= size or not more:
                    break
        yield from ((p.path, p.start + at, text, error) for at, text, error in found)


def _cut(data: bytes, p: Range, escaped: bool) -> tuple[list[tuple[int, str | None, str | None]], bool]:
    """(place, record, error) of what starts in p, and whether its last record is closed."""
    a = np.frombuffer(data, np.uint8)
    quotes = _quotes(a, escaped)
    at, step = _depths(a, quotes)
    if p.inside:
        step = np.where((a[at] | 32) == 123, 1, -1) - step
    at, step = at[step != 0], step[step != 0]
    depth = p.depth + np.cumsum(step)
    own = p.end - p.start
    opens = at[(step > 0) & (depth == p.base + 1)]
    closes = at[(step < 0) & (depth == p.base)] + 1
    if p.depth > p.base and len(closes):
        skipped = int(closes[0])  # of a record that starts before
        closes = closes[1:]
    else:
        skipped = 0 if p.depth <= p.base else own
    opens = opens[opens < own]
    out: list[tuple[int, str | None, str | None]] = []
    text = lambda x: x.decode("utf-8", "replace")
    last = skipped
    for i, start in enumerate(opens.tolist()):
        out += _between(data, last, start)
        if i >= len(closes):
            out.append((start, None, f"not closed: {text(data[start : start + 200])}"))
            return out, False
        last = int(closes[i])
        out.append((start, text(data[start:last]), None))
    if last < own:
        out += _between(data, last, own)
    return out, True


def _between(data: bytes, start: int, end: int) -> list[tuple[int, None, str]]:
    rest = data[start:end].removeprefix(b"\xef\xbb\xbf").strip(b"[], \t\r\n")
    return [(start, None, f"no record: {rest[:200].decode('utf-8', 'replace')}")] if rest else []


class ExportRecords(DataSource):
    """The format chat_export_records: option ranges, as export_records() makes them."""

    @classmethod
    def name(cls) -> str:
        return "chat_export_records"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: object) -> DataSourceReader:
        return _Records([Range(*r) for r in json.loads(self.options["ranges"])])


def export_records(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """path, start (byte), record (text) or error of each record of export files: one JSON array of objects, or objects one after another.

    A file is dealt to tasks by byte ranges of any place. A first pass gives
    of each range its quotes and the change of depth if it starts outside or
    inside a text; their sums (a row for each range) say what stands open at
    each range's start, so the second pass cuts out the records that start in
    it. A text or number between records is an error of its own.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split, "length").alias("end")).repartition(F.col("path"), F.col("start"))
    made, before = [], None
    for r in sorted(ranges.mapInArrow(_summary, _SUMMARY).collect(), key=lambda r: (r["path"], r["start"])):
        if before is None or before[0] != r["path"]:
            before = (r["path"], 0, False, int(r["first"] == ord("[")))
        _, depth, inside, base = before
        made.append((r["path"], r["start"], r["end"], depth, inside, base))
        before = (r["path"], depth + (r["inside"] if inside else r["outside"]), inside ^ (r["quotes"] % 2 == 1), base)
    spark.dataSource.register(ExportRecords)
    return spark.read.format("chat_export_records").option("ranges", json.dumps(made)).load()


def with_dialect(records: DataFrame) -> DataFrame:
    """records with dialect, each by its own: messages (has uuid and chat_messages), mapping (has a mapping), or null with an error."""
    v = F.try_parse_json("record")
    has = lambda path: F.try_variant_get(F.col("v"), path, "variant").isNotNull()
    x = records.withColumn("v", v)
    kind = F.when(has("$.uuid") & has("$.chat_messages"), "messages").when(has("$.mapping"), "mapping")
    why = F.when(F.col("v").isNull(), "no JSON").when(kind.isNull(), "of no known dialect")
    return x.withColumns({"dialect": kind, "error": F.coalesce("error", why)}).drop("v")


def read_messages(spark: SparkSession, path: str, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """MESSAGE rows of all records of export files, whatever dialect each has; and path, start and error of what could not be read."""
    x = with_dialect(export_records(spark, path, split))
    of = lambda dialect, schema: x.where((F.col("dialect") == dialect) & F.col("error").isNull()).select(F.from_json("record", schema).alias("r")).select("r.*")
    mapped, listed = mapping_messages(of("mapping", MAPPING)), chat_messages(of("messages", MESSAGES))
    return mapped.select(MESSAGE).unionByName(listed.select(MESSAGE)), x.where("error is not null").select("path", "start", "error")
