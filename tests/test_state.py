import json

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from convomill.operators import progress, review, state
from convomill.sources import exports, transcripts


def test_filters_and_state(spark):
    conv = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("c", "p3"), ("d", "p3")], "conversation_id string, path string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "conversation_id string")
    zero = spark.createDataFrame([("p2",)], "path string")
    assert sorted(r.conversation_id for r in state.filter_seen(conv, ids("a", "b"), zero).collect()) == ["b", "c", "d"]
    decided = {r.path: r.status for r in state.files_decided(conv, ids("a"), ids("c"), ids("d")).collect()}
    assert decided == {"p1": "dedup_skipped", "p3": "stage1_rejected"}
    records = spark.createDataFrame([("x", "2", 1), ("x", "3", 2), ("y", None, 3)], "path string, at string, n int")
    assert {r.path: r.n for r in state.latest_per_key(records, "path", "at").collect()} == {"x": 2, "y": 3}
    none = ids("zz_part1", "c_part2", "d_partial_part3")
    assert [r.path for r in state.reconcile_seen(conv, spark.createDataFrame([("p1",)], "path string"), none).collect()] == ["p3"]


def test_decisions_keep_a_batch_without_any_kept(spark):
    conv = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "batch int, conversation_id string")
    made = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", False)], "batch int, conversation_id string, keep boolean")
    assert sorted(r.conversation_id for r in state.apply_decisions(conv, made).collect()) == ["a", "c", "d"]
    assert sorted(r.conversation_id for r in state.apply_decisions(conv, made, strict=True).collect()) == ["a"]


def test_dated_files(spark):
    files = spark.createDataFrame([("a/.git/2025-01-01_x.md",), ("a/2025-02-03/x.md",), ("2025/10/23/x.md",), ("2025-13-45_x.md",)], "path string")
    assert [(r.path, str(r.day)) for r in state.dated_files(files).collect()] == [("a/2025-02-03/x.md", "2025-02-03")]


def test_weeks_and_streaks(spark):
    files = spark.createDataFrame([("a", date(2025, 1, 6)), ("b", date(2025, 1, 8)), ("c", date(2025, 1, 13)), ("d", date(2024, 12, 23))], "path string, day date")
    done = spark.createDataFrame([("a", 3, date(2025, 1, 14)), ("c", 1, date(2025, 1, 14)), ("d", 2, date(2024, 12, 30)), ("gone", 9, date(2025, 1, 14))], "path string, cards_generated int, processed_at date")
    runs = spark.createDataFrame([(date(2025, 1, 15), 5)], "day date, cards int")
    weekly = progress.weekly_progress(files, done, runs, "2025-01-16", 5)
    got = {str(r.week): (r.total, r.processed, r.remaining, r.cards) for r in weekly.collect()}
    assert got == {"2025-01-13": (1, 1, 0, 18), "2025-01-06": (2, 1, 1, 0), "2024-12-30": (0, 0, 0, 2), "2024-12-23": (1, 1, 0, 0), "2024-12-16": (0, 0, 0, 0)}
    assert tuple(progress.streaks(weekly).first()) == (2, 2, 3)
    none = progress.streaks(weekly.where("processed < 0")).first()
    assert tuple(none) == (0, 0, 0)


def test_throughput(spark):
    t = lambda h: datetime(2025, 1, 1, h)
    snapshots = spark.createDataFrame([(t(0), 0, 100), (t(2), 20, 100), (t(4), 60, 100)], "at timestamp, done long, total long")
    got = {r.scope: r for r in progress.throughput(snapshots, 2).collect()}
    assert (got["overall"].per_hour, got["recent"].per_hour, got["recent"].hours_left) == (15.0, 20.0, 2.0)
    assert progress.throughput(snapshots.where("done = 0")).count() == 0


def test_review(spark):
    cards = spark.createDataFrame([(1, "d", "f1", 0.95, 0.8, None), (2, "d", "f2", 0.5, None, True), (3, "e", "f3", None, 0.1, True)], "card_id int, deck string, front string, confidence double, similarity_score double, is_likely_duplicate boolean")
    keys = lambda df: sorted(r.card_id for r in df.collect())
    assert keys(review.review_filter(cards, duplicates="duplicates_only")) == [1, 2] and keys(review.review_filter(cards, "d", 0.6)) == [1]
    made = spark.createDataFrame([(1, "edit", "new", "failed"), (2, "accept", None, "imported")], "card_id int, action string, edited_front string, import_status string")
    assert {r.card_id: r.front for r in review.export_accepted(cards, made).collect()} == {1: "new", 2: "f2"}
    assert keys(review.pending_import(made)) == [1] and keys(review.bulk_accept(cards, made)) == []


def test_exports_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "c1", "title": "T", "mapping": {"n2": {"message": {"id": "m2", "author": {"role": "assistant"}, "create_time": 5.0, "content": {"content_type": "text", "parts": ["yes", "no"]}}}, "n1": {"message": {"id": "m1", "author": {"role": "user"}, "create_time": 1.0, "content": {"content_type": "text", "parts": ["hi"]}}}, "n0": {"message": null}, "h": {"message": {"id": "h", "author": {"role": "system"}, "content": {"content_type": "text", "parts": ["x"]}, "metadata": {"is_visually_hidden_from_conversation": true}}}}}]')
    records = exports.read_export(spark, str(tmp_path / "a.json"), exports.MAPPING)
    got = exports.mapping_messages(records).orderBy("pos").collect()
    assert exports.detect_format(records) == "mapping"
    assert [(r.pos, r.role, r.ts_raw, r.text) for r in got] == [(0, "user", "1970-01-01 00:00:01", "hi"), (1, "assistant", "1970-01-01 00:00:05", "yes\n\nno")]
    (tmp_path / "b.json").write_text('[{"uuid": "u", "name": "N", "chat_messages": [{"sender": "human", "created_at": "2025-01-01T00:00:00Z", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_result", "content": [{"type": "text", "text": "r"}, {"type": "image"}]}]}]}]')
    b = exports.read_export(spark, str(tmp_path / "b.json"), exports.MESSAGES)
    m = exports.chat_messages(b).first()
    assert exports.detect_format(b) == "messages" and m.text.endswith("</details>\n**[Tool Result: unknown]**\nr") and m.ts_raw == "2025-01-01 00:00:00"


def test_scan_render_and_status(spark, tmp_path):
    rows = [(1, "My Chat", 0, "user", "2025-01-02 03:04:05", "hi"), (2, None, 0, "user", "", "x")]
    r = transcripts.render_transcripts(spark.createDataFrame(rows, "conversation_id int, title string, pos int, role string, ts_raw string, text string"))
    got = {x.conversation_id: x for x in r.collect()}
    assert got[1].path == "2025/01/02/2025-01-02_my-chat.md" and got[2].path == "undated/chat-2.md" and "[2025-01-02 03:04:05] user:\nhi" in got[1].value
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.md").write_text(got[1].value)
    (tmp_path / "x" / "b.txt").write_text("no")
    scanned = transcripts.scan_transcripts(spark, str(tmp_path))
    assert [x.value for x in scanned.collect()] == [got[1].value]
    old = spark.createDataFrame([(got[1].path, "other")], "path string, value string")
    assert {x.status for x in transcripts.upsert_status(r, old).collect()} == {"updated", "written"}
    transcripts.write_transcripts(r, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("year") == "2025").count() == 1


def test_conversations_of_one_title_have_their_own_files(spark, tmp_path):
    rows = [(c, "Same", 0, "user", "2025-01-02 03:04:05", f"text {c}") for c in ("b", "a", "c", None)] + [("d", "Same", 0, "user", "", "x"), ("e", "Same", 0, "user", "", "y")]
    r = transcripts.render_transcripts(spark.createDataFrame(rows, "conversation_id string, title string, pos int, role string, ts_raw string, text string"))
    paths = {x.conversation_id: x.path for x in r.collect()}
    assert len(set(paths.values())) == 6 and paths["a"] == "2025/01/02/2025-01-02_same.md" and paths["d"] == "undated/same.md" and paths["b"].startswith("2025/01/02/2025-01-02_same-")
    root = (tmp_path / "md").as_uri()
    transcripts.write_markdown(r, root)
    assert sorted(x.value.split("text ")[-1][:1] for x in transcripts.scan_transcripts(spark, root).collect() if "text" in x.value) == sorted(["a", "b", "c", "N"])


def test_blank_notes_stay(spark):
    notes = spark.createDataFrame([(1, "d", "", ""), (2, "d", " ", ""), (3, "d", None, None), (4, "d", None, " "), (5, "e", "x", "y")], "note_id int, deck string, front string, back string")
    assert sorted(r.note_id for r in state.load_cards(notes, ["d"]).collect()) == [2, 4]


MAPPED = """[{"id": "conv-1", "title": "Chat", "create_time": 1700000000.0, "mapping": {
 "a": {"message": {"id": "a", "author": {"role": "user"}, "create_time": 1.0, "content": {"content_type": "text", "parts": ["Hello \\ue200cite\\ue202turn0\\ue201 world", "so \\\\( x^2 \\\\) and \\\\[ E = mc^2 \\\\]"]}}},
 "b": {"message": {"id": "b", "author": {"role": " "}, "create_time": 2.0, "content": {"content_type": "multimodal_text", "parts": [{"content_type": "image_asset", "asset_pointer": "file://p"}, "look", {"content_type": "audio"}]}}},
 "c": {"message": {"id": "c", "author": {"role": "tool"}, "create_time": 3.0, "content": {"content_type": "code", "language": "py", "text": "x"}}},
 "d": {"message": {"id": "d", "author": {"role": "tool"}, "create_time": 4.0, "content": {"content_type": "text", "parts": ["", null]}}}}},
 {"title": null, "mapping": {"a": {"message": {"id": "a", "author": {"role": "user"}, "content": {"content_type": "text", "parts": ["hi"]}}}}}]"""


def test_mapping_contents_and_header(spark, tmp_path):
    (tmp_path / "a.json").write_text(MAPPED)
    m = exports.mapping_messages(exports.read_export(spark, str(tmp_path / "a.json"), exports.MAPPING))
    got = {(r.conversation_id, r.pos): r for r in m.collect()}
    assert got["conv-1", 0].text == "Hello  world\n\nso $x^2$ and $$E = mc^2$$"
    assert (got["conv-1", 1].role, got["conv-1", 1].text) == ("unknown", "look\n\n[image asset: file://p]\n")
    assert got["conv-1", 2].text == '{"content_type": "code", "language": "py", "text": "x"}' and ("conv-1", 3) not in got
    files = {r.conversation_id: r for r in transcripts.render_transcripts(m, "https://custom.example/c/").collect()}
    assert files["conv-1"].value.startswith("# Chat\n\n- URL: https://custom.example/c/conv-1\n- Created: 2023-11-14 22:13:20\n\n---\n\n[1970-01-01 00:00:01] user:\nHello")
    assert files["conv-1"].path == "2023/11/14/2023-11-14_chat.md" and "look\n\n[image asset: file://p]\n\n\n[1970" in files["conv-1"].value
    assert files[None].value == "# Untitled Chat\n\n---\n\nuser:\nhi\n"


def test_message_blocks_and_files(spark, tmp_path):
    blocks = [{"type": "thinking", "thinking": " \\( y \\)"}, {"type": "text", "text": "a\ue200x\ue201 "}, {"type": "tool_use", "name": "search", "message": "go"}, {"type": "tool_result", "name": "search", "content": []}, {"type": "tool_result", "name": "find", "content": [{"type": "text", "text": " r "}, {"type": "image"}]}]
    record = {"uuid": "abc", "name": "Talk", "created_at": "2025-01-15T10:30:00Z", "updated_at": "2025-01-16T10:30:00+02:00", "chat_messages": [{"sender": "human", "content": []}, {"sender": "assistant", "created_at": "2025-01-15T10:31:00Z", "content": blocks}]}
    (tmp_path / "b.json").write_text(json.dumps([record]))
    m = exports.chat_messages(exports.read_export(spark, str(tmp_path / "b.json"), exports.MESSAGES))
    texts = {r.pos: r.text for r in m.collect()}
    assert texts == {0: "", 1: "<details>\n<summary>Thinking</summary>\n\n$y$\n\n</details>\na\n**[Tool Use: search]** go\n**[Tool Result: find]**\nr"}
    r = transcripts.render_transcripts(m)
    assert r.first().value.startswith("# Talk\n\n- Created: 2025-01-15 10:30:00\n- Updated: 2025-01-16 10:30:00\n\n---\n\nhuman:\n\n[2025-01-15 10:31:00] assistant:\n<details>")
    root = (tmp_path / "md").as_uri()
    status = lambda df: [x.status for x in transcripts.write_markdown(df, root).collect()]
    assert status(r) == ["written"] and status(r) == ["skipped"] and status(r.withColumn("value", F.lit("new"))) == ["updated"]
    assert (tmp_path / "md/2025/01/15/2025-01-15_talk.md").read_text() == "new"
    assert files_below(tmp_path / "md") == ["2025/01/15/2025-01-15_talk.md"]


def files_below(root):
    return sorted(str(x.relative_to(root)) for x in root.rglob("*") if x.is_file() and "_commits" not in x.parts)


def test_a_failed_write_leaves_nothing_and_a_cut_off_one_is_ended(spark, tmp_path):
    root, top = (tmp_path / "md").as_uri(), tmp_path / "md"
    rows = spark.createDataFrame([(f"2025/01/0{i}/a.md", f"text {i}") for i in range(1, 9)], "path string, value string").repartition(4)
    first = transcripts.write_markdown(rows.where("path < '2025/01/05'"), root)
    assert first.count() == 4 == first.count() and {r.status for r in first.collect()} == {"written"}  # read again, nothing is written again
    before = files_below(top)
    bad = rows.withColumn("value", F.when(F.col("path") == "2025/01/07/a.md", F.raise_error(F.lit("no"))).otherwise("other"))
    with pytest.raises(Exception, match="no"):
        transcripts.write_markdown(bad, root)
    assert files_below(top) == before and (top / "2025/01/01/a.md").read_text() == "text 1"
    spark.dataSource.register(transcripts.MarkdownTree)
    rows.withColumn("value", F.concat("value", F.lit("!"))).write.format("markdown_tree").mode("append").option("root", root).option("job", "cut").save()
    assert (top / "2025/01/01/a.md").read_text() == "text 1"  # committed, not yet moved
    stray = top / "_drafts/cut/999"
    stray.mkdir()
    (stray / "manifest.json").write_text('{"path": "2025/01/09/a.md", "status": "written", "draft": "_drafts/cut/999/0.md", "attempt": "999"}')
    (stray / "0.md").write_text("of an attempt that does not count")
    draft = next(x for x in (top / "_drafts/cut").rglob("0.md") if x.parent.name != "999")
    path = next(json.loads(line) for line in (draft.parent / "manifest.json").read_text().splitlines() if json.loads(line)["draft"].endswith(f"{draft.parent.name}/0.md"))["path"]
    (top / path).parent.mkdir(parents=True, exist_ok=True)
    draft.rename(top / path)  # as a task that was lost has left it
    for _ in range(2):
        status = {r.path: r.status for r in transcripts.publish(spark, root, "cut").collect()}
        assert status == {f"2025/01/0{i}/a.md": "updated" if i < 5 else "written" for i in range(1, 9)}
    assert files_below(top) == sorted(status) and all((top / p).read_text().endswith("!") for p in status)
    assert sorted(r.value for r in transcripts.scan_transcripts(spark, root).collect()) == [f"text {i}!" for i in range(1, 9)]
