"""Prefix-target expansion of chat conversations [native].

Every assistant turn is an example of its own: all preceding turns are its
context, and only its reply is trainable. ``formatted_turns`` formats each
turn once, with its place in its conversation's stream; ``expanded`` joins
the turns of every prefix and so makes the examples: the text of one is the
whole stream up to ``target_end``, its loss mask is [target_start,
target_end). Turns after the last reply belong to no example and make a row
without a target. ``examples_digest`` reads all that back from these texts.

The examples of a conversation of n turns hold O(n**2) turns. That is the
method's output and is made as a whole; on the way to it only one stream for
GROUP examples is shuffled, and the examples of a long conversation are dealt
over many tasks.

A turn's form is ``<|turn|>ROLE\\nTEXT<|end|>\\n``. Inside roles and texts a
backslash goes before every backslash and into every control string (``<|``,
``<s>``, ``</s>``, ``[INST]``, ``[/INST]``), and before a line end in a role,
so no text can open or close a turn, and one replacement undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
GROUP = 64
START, END = "<|turn|>", "<|end|>\n"
_INSERT = r"(?=\\)|(?<=<)(?=\||/?s>)|(?<=\[)(?=/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _INSERT, r"\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn_index (from 0, by turn), chunk, before (replies before it), n_examples (of its conversation), example, target_start, target_end.

    Needs conv_id, turn, role and text; other columns are not read. Null text
    or role: empty. Rows of one turn number are ordered by role, then text.
    Only the role ``assistant`` is trained on. A null conv_id is a
    conversation like any other.

    Running sums go in two steps: within blocks of BLOCK turn numbers, then
    over the blocks, so that a long conversation is spread over many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head, body = F.concat(F.lit(START), F.regexp_replace(escaped(F.col("role")), "\n", "\\\\\n"), F.lit("\n")), escaped(F.col("text"))
    block = F.floor(F.col("turn") / BLOCK).alias("block")
    t = conversations.select(F.struct("conv_id", block).alias("key"), "turn", role.alias("role"), text.alias("text"))  # structs with equal nulls are equal
    t = t.withColumns({"target": (F.col("role") == "assistant").cast("long"), "size": F.length(head) + F.length(body) + F.lit(len(END))})
    w = Window.partitionBy("key").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"i": F.lit(1), "at": F.col("size"), "k": F.col("target")}
    inner = t.select("*", *[F.coalesce(F.sum(x).over(w), F.lit(0)).alias(c) for c, x in sums.items()])
    blocks = t.groupBy("key").agg(F.count("*").alias("i0"), F.sum("size").alias("at0"), F.sum("target").alias("k0"))
    over = Window.partitionBy("key.conv_id").orderBy("key.block").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("k0").over(Window.partitionBy("key.conv_id")).alias("n_examples")
    blocks = blocks.select("key", whole, *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(c) for c in ("i0", "at0", "k0")])
    x = inner.join(blocks, "key")  # by the key of the window, so that texts move once
    x = x.withColumns({"head": head, "body": body})  # only now: texts are ordered and moved as they are
    before, target = F.col("k") + F.col("k0"), F.col("target") == 1
    body_at = F.col("at") + F.col("at0") + F.length("head")
    return x.select(
        "key.conv_id",
        (F.col("i") + F.col("i0")).alias("turn_index"),
        F.concat("head", "body", F.lit(END)).alias("chunk"),
        before.alias("before"),
        "n_examples",
        F.when(target, before).alias("example"),
        F.when(target, body_at).alias("target_start"),
        F.when(target, body_at + F.length("body")).alias("target_end"),
    )


def _joined(*cols: str) -> Column:
    """The last of cols, joined in the order of the others; rows where it is null are left out."""
    rows = F.collect_list(F.when(F.col(cols[-1]).isNotNull(), F.struct(*cols)))
    return F.array_join(F.transform(F.array_sort(rows), lambda s: s[cols[-1]]), "")


def expanded(turns: DataFrame) -> DataFrame:
    """The expansion of formatted_turns(): conv_id, example (from 0), n_examples (of its conversation), text (all chunks up to the reply's end), target_start, target_end.

    Turns after a conversation's last reply make one more row, whose example
    and target are null. An empty table gives none; a null conv_id is a
    conversation like any other.

    A turn goes to the group of its own example and to all later groups of
    its conversation; a group's turns, joined, hold every prefix that its
    GROUP examples need. A group must fit in one string (2 GB), as its last
    example does.
    """
    group = lambda example: F.floor(example / GROUP)
    groups = F.when(F.col("before") < F.col("n_examples"), F.sequence(group(F.col("before")), group(F.col("n_examples") - 1))).otherwise(F.array(F.lit(None).cast("long")))
    span = F.when(group(F.col("example")) == F.col("group"), F.struct("example", "target_start", "target_end"))
    streams = turns.withColumn("group", F.explode(groups)).groupBy("conv_id", "group", "n_examples").agg(_joined("turn_index", "chunk").alias("stream"), F.collect_list(span).alias("spans"))
    x = streams.select("conv_id", "n_examples", "stream", F.explode_outer("spans").alias("span"))
    text = F.when(F.col("span").isNull(), F.col("stream")).otherwise(F.col("stream").substr(F.lit(1), F.col("span.target_end").cast("int")))
    return x.select("conv_id", "span.example", "n_examples", text.alias("text"), "span.target_start", "span.target_end")


def written_examples(turns: DataFrame) -> DataFrame:
    """The examples alone: conv_id, example, text, target_start, target_end. Conversations without an assistant turn have none."""
    return expanded(turns).where("example is not null").select("conv_id", "example", "text", "target_start", "target_end")


def read_back(examples: DataFrame) -> DataFrame:
    """What the texts of expanded() say: conv_id, example, chars, target_text (what the loss mask covers, unescaped); and for a conversation's last example and for the row behind it stream_chars and turns (role and text of each, unescaped), which together are all its turns."""
    masked = F.col("text").substr((F.col("target_start") + 1).cast("int"), (F.col("target_end") - F.col("target_start")).cast("int"))
    whole = F.when(F.col("example").isNull(), F.col("text")).when(F.col("example") + 1 == F.col("n_examples"), F.concat("text", F.lit(END)))
    head = r"(?s)^((?:[^\\\n]|\\.)*+)\n"
    body = lambda turn: F.regexp_replace(F.regexp_replace(turn, head, ""), r"<\|end\|>\n$", "")
    turns = F.transform(F.filter(F.split("whole", r"<\|turn\|>"), lambda t: t != ""), lambda t: F.struct(unescaped(F.regexp_extract(t, head, 1)).alias("role"), unescaped(body(t)).alias("text")))
    return examples.withColumn("whole", whole).select(
        "conv_id", "example", F.when(F.col("example").isNotNull(), F.length("text")).alias("chars"), unescaped(masked).alias("target_text"), F.length("whole").alias("stream_chars"), turns.alias("turns")
    )


def examples_digest(examples: DataFrame) -> DataFrame:
    """Per conversation what read_back() gives of expanded(): n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (each turn once), n_examples, expanded_chars (the examples' texts together).

    A digest needs the whole conversation in order, and so in one string (2 GB).
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = read_back(examples).withColumns({"said": said, "n": F.array_size("turns"), "behind": F.col("example").isNull()})
    whole = back.groupBy("conv_id").agg(
        _joined("behind", "said").alias("said"), _joined("example", "target_text").alias("loss"), F.sum("n").alias("n"), F.sum("stream_chars").alias("chars"), F.count("example").alias("ex"), F.sum("chars").alias("expanded")
    )
    return whole.select(
        "conv_id",
        F.col("n").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
        F.col("ex").alias("n_examples"),
        F.coalesce("expanded", F.lit(0)).cast("long").alias("expanded_chars"),
    )


def conversation_digest(turns: DataFrame) -> DataFrame:
    """examples_digest() of the expansion of formatted_turns()."""
    return examples_digest(expanded(turns))
