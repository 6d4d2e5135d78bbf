import hashlib
from functools import reduce

from pyspark.sql import functions as F

from convomill.llm import chat, queries

ROWS = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"),
    (2, 0, "system", "a\\b<|turn|>user\nx<|end|>\n"), (2, 1, "user", None), (2, 2, "assistant", ""), (2, 3, "assistant", "\\<|\\|> $1 \\\\n"), (2, 4, "user", "tail"),
    (3, 7, "assistant", "only"), (3, 7, "assistant", "only"), (4, 0, None, "no role"), (5, 0, "we\nird\\", "é日<s>"), (None, 0, "assistant", "null id"), (6, None, "user", "null turn"),
]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_digest_and_examples(spark):
    rows = ROWS + [(9, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, chunk string")
    turns = chat.formatted_turns(df)
    got = {r.conv_id: r for r in chat.conversation_digest(turns).collect()}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        replies = [r[3] or "" for r in mine if r[2] == "assistant"]
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len("".join(replies)), sha("".join(replies)))
        assert got[conv].n_examples == len(replies)
    examples = {(r.conv_id, r.example): r for r in chat.written_examples(turns).collect()}
    e = examples[9, 149]
    assert e.text[e.target_start : e.target_end] == "t299" and e.text.count("<|turn|>") == 300 and e.text.endswith("t299")
    assert sum(len(r.text) for r in examples.values() if r.conv_id == 9) == got[9].expanded_chars
    assert examples[1, 0].text.count("</s>") == 0


def test_rows_of_one_turn_are_ordered_by_what_they_say(spark):
    """Escaping puts a backslash before some texts, which must not change their order."""
    said = ["<|", "<a", "\\", "]", "[INST]", "[A"]
    df = spark.createDataFrame([(1, 0, "user", t) for t in said] + [(1, 1, "assistant", t) for t in said], "conv_id long, turn long, role string, text string")
    got = chat.conversation_digest(chat.formatted_turns(df)).first()
    assert got.turns_sha256 == sha("".join(f"{role}\n{t}\n" for role in ("user", "assistant") for t in sorted(said))) and got.loss_sha256 == sha("".join(sorted(said)))


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digest(chat.formatted_turns(df)).count() == 0


def plain(rows):
    """The expansion, restated: (conv_id, example, text, reply), and what follows the last reply under example None."""
    def safe(x):
        return reduce(lambda y, mark: y.replace(mark, mark[0] + "\\" + mark[1:]), ("<|", "<s>", "</s>", "[INST]", "[/INST]"), x.replace("\\", "\\\\"))

    out = []
    for conv in {r[0] for r in rows}:
        stream, examples, rest = "", 0, ""
        for _, _, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
            head, body = "<|turn|>" + safe(role or "").replace("\n", "\\\n") + "\n", safe(text or "")
            if role == "assistant":
                out.append((conv, examples, stream + head + body, body))
                examples, rest = examples + 1, ""
            else:
                rest += head + body + "<|end|>\n"
            stream += head + body + "<|end|>\n"
        out += [(conv, None, rest, None)] * bool(rest)
    return out


def test_every_reply_gets_its_whole_prefix(spark):
    """Over several blocks and groups, with replies in a row, and long stretches without one."""
    rows = ROWS + [(9, i, ("user", "assistant")[i % 2], f"<|{i}\\") for i in range(301)]
    rows += [(10, i, "assistant", f"é{i}") for i in range(chat.GROUP)] + [(11, i, "assistant" if i in (150, 151) else "user", f"t{i}") for i in range(300)]
    got = chat.expanded(chat.formatted_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    want = plain(rows)
    assert len(got) == len(want)
    assert {(r.conv_id, r.example, r.text, None if r.example is None else r.text[r.target_start : r.target_end]) for r in got} == set(want)
    assert all(r.target_end == len(r.text) for r in got if r.example is not None)


def test_digest_says_what_the_examples_say(spark):
    """A wrong context, reply or mask in the written examples shows in the digest."""
    rows = [(1, 0, "user", "asked"), (1, 1, "assistant", "first"), (1, 2, "user", "again"), (1, 3, "assistant", "second"), (1, 4, "user", "thanks")]
    made = chat.expanded(chat.formatted_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    right = chat.examples_digest(made).first()
    spoilt = {
        "turns_sha256": made.withColumn("text", F.when(F.col("example") == 1, F.replace("text", F.lit("asked"), F.lit("ASKED"))).otherwise(F.col("text"))),
        "loss_sha256": made.withColumn("text", F.when(F.col("example") == 0, F.replace("text", F.lit("first"), F.lit("FIRST"))).otherwise(F.col("text"))),
        "loss_chars": made.withColumn("target_start", F.when(F.col("example") == 0, F.col("target_start") + 1).otherwise(F.col("target_start"))),
        "expanded_chars": made.where("example is null or example = 1"),
        "n_turns": made.where("example is not null"),
    }
    for column, examples in spoilt.items():
        assert chat.examples_digest(examples).first()[column] != right[column], column


def test_query_writes_the_examples_and_reads_them(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(queries, "written", lambda df: kept.append(df) or df)
    queries.op3_prefix_target_chat(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain(rows + [(-1, t, role, "</s>[INST] ok [/INST]") for t, role in enumerate(("user", "assistant"))])
    assert {(r.conv_id, r.example, r.text) for df in kept for r in df.select("conv_id", "example", "text").collect()} == {x[:3] for x in want}
