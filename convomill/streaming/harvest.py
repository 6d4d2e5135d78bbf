"""Streaming forms: incremental harvest, seen identifiers, weekly activity, sessions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import non_content, strip
from ..operators.features import turn_signals, with_key_terms
from ..operators.state import run_record
from ..operators.turns import ASSISTANT_START, build_turns
from ..sources.store import StateStore


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream of its files: of a folder all of them, of a single file that one alone."""
    path, reader = path.rstrip("/"), spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        folder, _, name = path.rpartition("/")
        path, reader = folder, reader.option("pathGlobFilter", re.sub(r"([\\*?{}\[\]])", r"\\\1", name))
    stream = reader.parquet(path)
    local = [c for c, kind in stream.dtypes if kind == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else stream


def drained(stream: DataFrame, out: str) -> DataFrame:
    """Runs a stream over what is there now, in append mode, and returns its output table. The checkpoint beside it lets a later run go on."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{out}/data").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/data")


def latest(stream: DataFrame, out: str, keys: list[str]) -> DataFrame:
    """Runs a stream in update mode: a batch keeps the rows that it changed under its own number (a repeated batch replaces itself); of each key the last one counts."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = stream.sparkSession.read.parquet(f"{out}/data").groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("r"))
    return rows.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(stream.columns)


def write_end(spark: SparkSession, path: str, key: str, at: str, time: str) -> None:
    """A row without a key at a time after all others: read as part of a stream, it moves the watermark on, so that what is open then ends."""
    spark.range(1).select(F.lit(None).cast("long").alias(key), F.lit(time).cast("timestamp").alias(at)).write.mode("overwrite").parquet(path)


TURN = "path string, turn_index long, user_ts string, prompt string, assistant_ts string, answer string"
_OPEN = "pos long, role string, grp long, turns long, users string, user_ts string, replies string, last_reply string, assistant_ts string, first_ts string"


class OpenTurn(StatefulProcessor):
    """Keeps of each path the turn that is not ended yet, and nothing of those before.

    Rows of a path: pos, role (user or assistant), text (stripped), substance
    (whether a reply counts as an answer), ts_raw. A batch's rows are taken
    by pos. Gives a row of kind finished for each turn that a new prompt
    ends, one of kind open with the turn as it stands (turn_index null if
    nothing is there yet), and one of kind late for each row at or before a
    place that an earlier batch has passed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._kept = handle.getValueState("open_turn", _OPEN)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        names = [c.split()[0] for c in _OPEN.split(", ")]
        held = self._kept.get()
        x = dict(zip(names, held, strict=True)) if held else dict.fromkeys(names) | {"pos": None, "role": "", "grp": 0, "turns": 0, "users": ""}
        out: list[tuple] = []
        passed = x["pos"]

        def turn(kind: str) -> tuple | None:
            if x["last_reply"] is None or not (x["users"] or x["grp"] == 0):
                return None
            first = x["grp"] == 0
            return (key[0], x["turns"], x["assistant_ts"] if first else x["user_ts"], ASSISTANT_START if first else x["users"], x["assistant_ts"], x["replies"] or x["last_reply"], x["first_ts"], kind)

        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch.astype(object).where(batch.notna(), None).sort_values("pos", kind="stable")
        for pos, role, text, substance, ts in zip(*(batch[c] for c in ("pos", "role", "text", "substance", "ts_raw")), strict=True):
            if passed is not None and pos <= passed:
                out.append((key[0], pos, ts, None, None, text, None, "late"))
                continue
            if role == "user":
                if x["role"] != "user":
                    if ended := turn("finished"):
                        first = x["first_ts"] if x["turns"] else ended[2]
                        out.append((*ended[:6], first, ended[7]))
                        x |= {"turns": x["turns"] + 1, "first_ts": first}
                    x |= {"grp": x["grp"] + 1, "users": "", "user_ts": None, "replies": None, "last_reply": None, "assistant_ts": None}
                if text:
                    x["user_ts"] = x["user_ts"] if x["users"] else ts
                    x["users"] = f"{x['users']}\n\n{text}" if x["users"] else text
            else:
                x |= {"last_reply": text, "assistant_ts": ts}
                if substance:
                    x["replies"] = f"{x['replies']}\n\n{text}" if x["replies"] else text
            x |= {"role": role, "pos": int(pos)}
        self._kept.update(tuple(x[n] for n in names))
        out.append(turn("open") or (key[0], None, None, None, None, None, None, "open"))
        frame = pd.DataFrame(out, columns=[*(c.split()[0] for c in TURN.split(", ")), "first_ts", "kind"], dtype=object)
        yield frame.astype({"turn_index": "Int64"})


def harvest(entries: DataFrame, out: str, then: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Turns of streamed entries (path, pos, role, ts_raw, text), as pair_turns() gives them of all entries so far.

    A batch reads its own rows and the open turns of their paths, whatever
    came before. It keeps its rows under its own number, so that a repeated
    batch replaces itself; then(turns, number) follows with its finished
    turns. A restarted stream goes on in the middle of a turn. Entries of a
    path must come by pos: those that come after later ones, or again, are in
    late_entries(), and change no turn.
    """
    spark = entries.sparkSession
    text = strip(F.coalesce("text", F.lit("")))
    e = entries.select("path", F.col("pos").cast("long").alias("pos"), "role", text.alias("text"), "ts_raw")
    e = e.where((F.col("role") == "user") | ((F.col("role") == "assistant") & (F.col("text") != ""))).withColumn("substance", ~non_content(F.col("text")))
    turns = e.groupBy("path").transformWithStateInPandas(OpenTurn(), f"{TURN}, first_ts string, kind string", "Append", "None")
    turns = turns.withColumn("answer", strip(F.col("answer")))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{out}/turns/batch={number}")
        if then:
            then(_kept(spark, out).where((F.col("batch") == number) & (F.col("kind") == "finished")).drop("batch", "kind"), number)

    with stateful(spark):
        turns.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return harvested(spark, out)


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """While a stream with arbitrary state starts: the state store that such streams need."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _kept(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{TURN}, first_ts string, batch long, kind string").parquet(f"{out}/turns")


def harvested(spark: SparkSession, out: str) -> DataFrame:
    """All finished turns, and of each path the open one as its last batch left it."""
    rows, names = _kept(spark, out), [c.split()[0] for c in TURN.split(", ")]
    last = rows.where("kind = 'open'").groupBy("path").agg(F.max_by(F.struct(*names), "batch").alias("r")).select("r.*").where("turn_index is not null")
    return rows.where("kind = 'finished'").select(names).unionByName(last)


def late_entries(spark: SparkSession, out: str) -> DataFrame:
    """path, pos, ts_raw and text of the entries that came too late or again: these paths are to be paired anew from their source."""
    return _kept(spark, out).where("kind = 'late'").select("path", F.col("turn_index").alias("pos"), F.col("user_ts").alias("ts_raw"), F.col("answer").alias("text"))


def bookkeeping(spark: SparkSession, root: str, run_dir: str) -> Callable[[DataFrame, int], None]:
    """For harvest(): each batch's finished turns with signals and terms below root/features, and the state tables, all under the batch's number."""
    store = StateStore(spark, f"{root}/state")

    def follow(turns: DataFrame, number: int) -> None:
        x = build_turns(turns, first=F.col("first_ts"))
        with_key_terms(turn_signals(x, answer="full_answer"), ["path", "turn_index"], answer="full_answer").write.mode("overwrite").parquet(f"{root}/features/batch={number}")
        now = F.current_timestamp()
        store.append("processed_files", x.select("path", now.alias("processed_at"), F.lit(0).alias("cards_generated"), F.lit("harvested").alias("status")).distinct(), number)
        store.append("seen_contexts", x.select("context_id"), number)
        store.append("run_history", run_record(x, f"{run_dir}/{number}", now), number)

    return follow


def dedup_ids(events: DataFrame, key: str, at: str, within: str = "60 days") -> DataFrame:
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark([key]).select(key)


def weekly_activity(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per week (from Monday) and kind."""
    week = F.window("ts", "7 days", "7 days", "4 days")
    return events.withWatermark("ts", late).groupBy(week.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("week"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user; in append mode a session is there when the watermark has passed its end. The row of write_end() closes all; its own session, without a user, is to be left out of the output, not of the stream."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("started"), "n")
