import random

from pyspark.sql import functions as F

from convomill.operators.features import turn_signals, with_key_terms
from convomill.operators.turns import build_turns, pair_turns
from convomill.plans import fixtures as fx
from convomill.sources.store import StateStore
from convomill.streaming import harvest

SF = "/root/testdata/sf0.001"
NAMES = [c.split()[0] for c in harvest.TURN.split(", ")]


def rows(df):
    return sorted(df.select(NAMES).collect(), key=str)


def feed(spark, tmp_path, parts):
    """A stream over a folder, and one step for each part: the part is written there, the stream goes on, and its turns come back."""
    source, out = f"file://{tmp_path}/source", f"file://{tmp_path}/out"
    for i, part in enumerate(parts):
        part.write.parquet(f"{source}/{i}")
        stream = spark.readStream.schema(part.schema).option("recursiveFileLookup", True).parquet(source)
        yield harvest.harvest(stream, out, harvest.bookkeeping(spark, f"{out}/kept", "run")), out


def test_harvest_goes_on_in_the_middle_of_a_turn(spark, tmp_path):
    """After each restart the turns are those of all entries so far; a batch writes only what it has touched; features and state follow."""
    entries = fx.entries(spark, SF)
    cuts = ["pos < 2 or conv_id % 3 = 0", "pos in (2, 3) and conv_id % 3 != 0", "pos > 3 and conv_id % 3 != 0"]
    upto = "false"
    for cut, (got, out) in zip(cuts, feed(spark, tmp_path, [entries.where(c) for c in cuts]), strict=True):
        upto = f"{upto} or {cut}"
        assert rows(got) == rows(pair_turns(entries.where(upto))) and got.count() > 0
    kept = spark.read.parquet(f"{out}/turns")
    for i, cut in enumerate(cuts):
        touched = {r.path for r in entries.where(cut).select("path").distinct().collect()}
        assert {r.path for r in kept.where(F.col("batch") == i).select("path").distinct().collect()} <= touched
    assert harvest.late_entries(spark, out).count() == 0
    finished = kept.where("kind = 'finished'").drop("batch", "kind")
    whole = build_turns(pair_turns(entries)).join(finished.select("path", "turn_index"), ["path", "turn_index"])
    features = spark.read.parquet(f"{out}/kept/features").drop("batch")
    keys = ["path", "turn_index", "conversation_id", "context_id", "score", "key_terms"]
    want = with_key_terms(turn_signals(whole, answer="full_answer"), ["path", "turn_index"], answer="full_answer")
    assert sorted(features.select(keys).collect(), key=str) == sorted(want.select(keys).collect(), key=str) and features.count() > 0
    state = StateStore(spark, f"{out}/kept/state")
    assert {r.context_id for r in state.read("seen_contexts").collect()} == {r.context_id for r in want.collect()}
    assert {r.path for r in state.read("processed_files").collect()} == {r.path for r in want.collect()} and state.read("run_history").count() == 3


def test_harvest_on_random_entries_one_batch_each(spark, tmp_path):
    """Blank prompts, assistants first, contents without substance, other roles, null texts and times, every cut."""
    rng = random.Random(6)
    text = {"user": ["", " ", "q one", "q two "], "assistant": ["", "a one", " a two", '{"content_type": "code"}'], "tool": ["t"]}
    made = []
    for path in range(40):
        for pos in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "tool"])
            made.append((f"p{path}", pos, role, rng.choice([None, f"t{pos}"]), rng.choice([*text[role], None]), rng.randrange(3) if pos else 0))
    last: dict = {}
    made = [(*r[:5], last.setdefault(r[0], 0) if r[1] == 0 else last.__setitem__(r[0], max(last[r[0]], r[5])) or last[r[0]]) for r in made]
    df = spark.createDataFrame(made, "path string, pos int, role string, ts_raw string, text string, part int")
    parts = [df.where(F.col("part") == i).drop("part") for i in range(3)]
    for i, (got, _) in enumerate(feed(spark, tmp_path, parts)):
        assert rows(got) == rows(pair_turns(df.where(F.col("part") <= i).drop("part")))


def test_late_and_repeated_entries_change_no_turn(spark, tmp_path):
    schema = "path string, pos int, role string, ts_raw string, text string"
    one = spark.createDataFrame([("p", 1, "user", "t1", "q"), ("p", 2, "assistant", "t2", "a")], schema)
    two = spark.createDataFrame([("p", 0, "user", "t0", "before"), ("p", 2, "assistant", "t2", "a"), ("p", 3, "user", "t3", "next"), ("p", 4, "assistant", "t4", "b")], schema)
    *_, (got, out) = feed(spark, tmp_path, [one, two])
    assert rows(got) == rows(pair_turns(one.unionByName(two.where("pos > 2"))))
    assert sorted((r.path, r.pos, r.ts_raw, r.text) for r in harvest.late_entries(spark, out).collect()) == [("p", 0, "t0", "before"), ("p", 2, "t2", "a")]


def test_weekly_counts_go_on(spark, tmp_path):
    events = fx.table(spark, SF, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    source, out = f"file://{tmp_path}/source", f"file://{tmp_path}/out"
    stream = lambda: spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(source)
    count = lambda df: {(str(r.week), r.event_type): r.n for r in df.collect()}
    whole = {}
    for r in events.select(F.date_trunc("week", "ts").alias("week"), "event_type").collect():
        whole[str(r.week), r.event_type] = whole.get((str(r.week), r.event_type), 0) + 1
    cut = "2024-01-15"
    events.where(F.col("ts") < cut).write.parquet(f"{source}/first")
    first = count(harvest.latest(harvest.weekly_activity(stream()), out, ["week", "event_type"]))
    events.where(F.col("ts") >= cut).write.parquet(f"{source}/second")
    both = count(harvest.latest(harvest.weekly_activity(stream()), out, ["week", "event_type"]))
    assert both == whole and sum(first.values()) < sum(both.values())


def test_a_table_beside_another_of_a_longer_name(spark, tmp_path):
    """One as a folder, one as a single file."""
    for name, n in (("t", 3), ("t_old", 5)):
        spark.range(n).coalesce(1).write.parquet(f"file://{tmp_path}/{name}")
    part = next((tmp_path / "t").glob("part-*.parquet"))
    part.rename(tmp_path / "one.parquet")
    (tmp_path / "one.parquet_old").write_bytes((tmp_path / "one.parquet").read_bytes())
    spark.range(3).coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/t")
    for name in ("t", "one.parquet"):
        stream = harvest.read_table(spark, f"file://{tmp_path}/{name}")
        assert harvest.drained(stream, f"file://{tmp_path}/out-{name}").count() == 3
