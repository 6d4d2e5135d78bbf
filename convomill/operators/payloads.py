"""Prompt inputs, parsed responses and note payloads."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_tags, strip, truncate_prompt

# A card's fields. Every field is read as text first, so that a number in quotes or a list as text costs no card.
CARD = ["conversation_id", "turn_index", "context_id", "deck", "card_style", "front", "back", "tags", "confidence", "notes", "depends_on"]
NUMBERS, LISTS = {"turn_index": "int", "confidence": "double"}, ["tags", "depends_on"]
SKIPS = "array<struct<conversation_id: string, turn_index: int, reason: string>>"
INSIGHTS = "array<struct<conversation_id: string, insight: string, misconceptions_corrected: array<string>>>"


# Fixed value: a backslash that starts no escape.
STRAY = r'\\(?!["\\/bfnrtu])'
NO_DECKS = "- (No decks specified - use your best judgment)"


def _batched(conversations: DataFrame, turns: DataFrame, of_turn: list[Column | str], of_conversation: list[Column | str]) -> DataFrame:
    """batch and candidates: its conversations in order, each with its turns in order."""
    t = turns.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", *of_turn))).alias("turns"))
    x = conversations.join(t, "conversation_id").select("batch", F.struct("conversation_id", *of_conversation, "turns").alias("item"))
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col("item.conversation_id").alias("k"), "item"))), lambda i: i["item"])
    return x.groupBy("batch").agg(items.alias("candidate_conversations"))


def filter_payload(conversations: DataFrame, turns: DataFrame, instructions: str) -> DataFrame:
    """batch and payload: instructions, a blank line, then the batch's conversations as JSON; prompts are cut to their limit."""
    x = _batched(conversations, turns, [truncate_prompt(F.col("prompt")).alias("user_prompt"), F.col("answer").alias("assistant_response")], [F.col("title").alias("source_title"), "key_topics", F.size("turns").alias("turn_count")])
    return x.select("batch", F.concat(F.lit(instructions + "\n\n"), F.to_json(F.struct("candidate_conversations"))).alias("payload"))


def generate_payload(conversations: DataFrame, turns: DataFrame, template: str, decks: list[str], signals: list[str] | None = None, aggregates: list[str] | None = None) -> DataFrame:
    """As filter_payload, with scores, the turns' signals and the conversations' aggregates (columns by name), and the deck list in place of {decks}; deck names are taken literally."""
    listed = "\n".join(f"- {d}" for d in decks) or NO_DECKS
    named = lambda columns, name: [F.struct(*columns).alias(name)] if columns else []
    of_turn = ["context_id", F.col("user_ts").alias("user_timestamp"), truncate_prompt(F.col("prompt")).alias("user_prompt"), F.col("answer").alias("assistant_answer"), F.round("score", 3).alias("score"), *named(signals, "signals")]
    of_conversation = [F.col("title").alias("source_title"), F.col("url").alias("source_url"), "key_topics", F.round("aggregate_score", 3).alias("aggregate_score"), *named(aggregates, "aggregate_signals")]
    x = _batched(conversations, turns, of_turn, of_conversation)
    given = F.array(*map(F.lit, decks)) if decks else F.array().cast("array<string>")
    body = F.to_json(F.struct(given.alias("available_decks"), "candidate_conversations"))
    return x.select("batch", F.concat(F.replace(F.lit(template), F.lit("{decks}"), F.lit(listed)), F.lit("\n\n"), body).alias("payload"))


def without_fence(text: str) -> str:
    body = text.strip()
    for opening in ("```json", "```"):
        if body.startswith(opening):
            body = body[len(opening) :]
            break
    return body.removesuffix("```").strip()


def embedded_value(text: str) -> object:
    """The first JSON value that starts at a brace or bracket."""
    decoder, last = json.JSONDecoder(), ValueError("no JSON value found")
    for m in re.finditer(r"[{\[]", text):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except ValueError as e:
            last = e
    raise last


def as_text(value: dict) -> str:
    """JSON with characters as they are; half of a surrogate pair, which no text can hold, stays an escape."""
    text = json.dumps(value, ensure_ascii=False)
    try:
        text.encode()
    except UnicodeEncodeError:
        return json.dumps(value)
    return text


def first_object(text: str | None) -> tuple[str | None, str | None]:
    """The first reading of a response that is a JSON object, else the last error: as it is, without its fence, with stray backslashes doubled, and the first value inside other text. A value too deep to be read is an error."""
    raw = (text or "").strip()
    plain = without_fence(raw)
    readings = [(json.loads, raw)] if raw[:1] in ("{", "[") else []
    readings += [(json.loads, plain), (json.loads, re.sub(STRAY, r"\\\\", plain)), (embedded_value, plain)]
    error = "not an object"
    for read, body in readings:
        try:
            value = read(body)
            if isinstance(value, dict):
                return as_text(value), None
        except (ValueError, RecursionError) as e:
            error = str(e)
    return None, error


def is_object(text: Column) -> Column:
    """Whether a text is one JSON object and nothing else. The reader stops behind the first value; only what closes both a list and an object around it ends there."""
    inside = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
    return F.when(text.startswith("{") & text.endswith("}"), inside).otherwise(False)


def plain_object(text: Column) -> Column:
    """A response's JSON object as it stands there: as it is, without its fence, or with stray backslashes doubled; else null."""
    raw = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    plain = F.regexp_replace(F.regexp_replace(raw, r"(?U)^```(json)?\s*", ""), r"(?U)\s*(```)?\s*$", "")
    doubled = F.regexp_replace(plain, STRAY, r"\\\\")
    return F.coalesce(*[F.when(is_object(x), x) for x in (raw, plain, doubled)])


def parse_responses(responses: DataFrame, text: str = "response") -> DataFrame:
    """responses with parsed (JSON text of an object, or null) and error (null where there is an object).

    Well-formed responses are read by built-in functions and keep their own
    spelling; only the others go to Python.
    """
    none = F.lit(None).cast("string")
    x = responses.withColumn("parsed", plain_object(F.col(text)))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [first_object(x) for x in frame[text]]
            yield frame.assign(parsed=[f[0] for f in found], error=[f[1] for f in found])

    schema = ", ".join(f"`{n}` {t}" for n, t in responses.dtypes) + ", parsed string, error string"
    odd = x.where("parsed is null").drop("parsed").mapInPandas(parse, schema)
    return x.where("parsed is not null").withColumn("error", none).unionByName(odd)


def listed(x: Column) -> Column:
    """A list of texts from a JSON list or a comma-separated text; null stays null."""
    return F.when(x.startswith("["), F.filter(F.transform(F.from_json(x, "array<string>"), strip), lambda t: t.isNotNull() & (t != ""))).when(x.isNotNull(), clean_tags(x))


def explode_cards(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per card of the parsed objects; no cards: no row. raw keeps fields outside the contract.

    Every element of cards is read by itself: one that is no object gives no
    row and costs no other (card_index counts it). Numbers may stand in
    quotes, lists may be comma-separated texts; what is neither is null.
    """
    raw = F.from_json(F.get_json_object("parsed", "$.cards"), "array<string>")
    x = parsed.select(*keys, F.posexplode(raw).alias("card_index", "raw")).where(F.coalesce(F.col("raw"), F.lit("")).startswith("{"))
    c = x.withColumn("c", F.from_json("raw", ", ".join(f"{n} string" for n in CARD))).where("c is not null")
    field = lambda n: F.col(f"c.{n}").try_cast(NUMBERS[n]) if n in NUMBERS else listed(F.col(f"c.{n}")) if n in LISTS else F.col(f"c.{n}")
    return c.select(*keys, "card_index", *[field(n).alias(n) for n in CARD], "raw")


def explode_skips(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind (conversation or turn), conversation_id, turn_index (null for conversations) and reason of what was skipped."""
    found = lambda name, kind: F.transform(F.coalesce(F.from_json(F.get_json_object("parsed", f"$.{name}"), SKIPS), F.array().cast(SKIPS)), lambda x: F.struct(F.lit(kind).alias("kind"), x["conversation_id"].alias("conversation_id"), x["turn_index"].alias("turn_index"), x["reason"].alias("reason")))
    return parsed.select(*keys, F.inline(F.concat(found("skipped_conversations", "conversation"), found("skipped_turns", "turn"))))


def explode_insights(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, conversation_id, insight and misconceptions_corrected."""
    return parsed.select(*keys, F.inline(F.from_json(F.get_json_object("parsed", "$.learning_insights"), INSIGHTS)))


# What is kept from conversion, in this order, the mark in its place, and the patterns of the conversion.
FORMULAS = [r"(?s)\\\[.*?\\\]", r"(?s)\\\(.*?\\\)", r"(?s)\$\$.*?\$\$", r"\$[^$\n]+\$"]


def _marked(text: Column, formulas: Column, pattern: str) -> tuple[Column, Column]:
    """text with a numbered mark for each match, and the formulas with the matches behind them."""
    found, parts, before = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern), F.size(formulas)
    mark = lambda i: F.concat(F.lit("__LATEX_"), (before + i).cast("string"), F.lit("__"))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, mark(i))).otherwise(p)), ""), F.concat(formulas, found)


def with_html(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the Markdown of column as HTML: fences, inline code, bold, italic, quotes, lists, line ends and paragraphs; formulas stay as they are. Empty texts stay empty, null ones null."""
    r, own = F.regexp_replace, f"{out}__"
    df = df.withColumns({f"{own}x": F.col(column), f"{own}f": F.array().cast("array<string>")})
    for pattern in FORMULAS:
        text, formulas = _marked(F.col(f"{own}x"), F.col(f"{own}f"), pattern)
        df = df.withColumns({f"{own}x": text, f"{own}f": formulas})
    y = r(r(F.col(f"{own}x"), r"(?s)```(\w*)\n?(.*?)```", "<pre>$2</pre>"), "`([^`]+)`", "<code>$1</code>")
    y = r(r(y, r"\*\*([^*]+)\*\*", "<b>$1</b>"), r"(?U)(?<![*\w])\*([^*]+)\*(?![*\w])", "<i>$1</i>")
    y = r(y, r"(?mdU)^>\s*(.+)$", "<blockquote>$1</blockquote>")
    bullet, number = r"(?U)^[-*+]\s+(.+)$", r"(?U)^\d+\.\s+(.+)$"

    def line(l: Column) -> Column:
        bare = strip(l)
        kind = F.when(bare.rlike(bullet), "ul").when(bare.rlike(number), "ol").otherwise("")
        item = lambda pattern: F.concat(F.lit("<li>"), F.regexp_extract(bare, pattern, 1), F.lit("</li>"))
        shown = F.when(kind == "ul", item(bullet)).when(kind == "ol", item(number)).when(bare != "", F.concat(l, F.lit("<br>"))).otherwise("")
        return F.struct(kind.alias("kind"), shown.alias("shown"))

    df = df.withColumn(f"{own}l", F.transform(F.split(y, "\n"), line))
    rows = F.col(f"{own}l")
    tag = lambda form, kind: F.when(kind != "", F.format_string(form, kind))

    def pieces(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(rows, i - 1)["kind"]).otherwise("")
        turns = x["kind"] != before
        return F.filter(F.array(F.when(turns, tag("</%s>", before)), F.when(turns, tag("<%s>", x["kind"])), x["shown"]), lambda p: p.isNotNull())

    last = F.filter(F.array(tag("</%s>", F.element_at(rows, -1)["kind"])), lambda p: p.isNotNull())
    y = F.array_join(F.concat(F.flatten(F.transform(rows, pieces)), last), "\n")
    y = r(r(y, r"\n\n+", "</p><p>"), r"\n", "")
    y = r(r(y, "<br>(</?(?:ul|ol|li|p|pre|blockquote)>)", "$1"), "<br>$", "")
    df = df.withColumn(f"{own}x", F.when(y.contains("</p><p>"), F.concat(F.lit("<p>"), y, F.lit("</p>"))).otherwise(y))
    numbered = F.transform(f"{own}f", lambda x, i: F.struct(F.concat(F.lit("__LATEX_"), i.cast("string"), F.lit("__")).alias("mark"), x.alias("x")))
    back = F.aggregate(numbered, F.col(f"{own}x"), lambda text, f: F.replace(text, f["mark"], f["x"]))
    return df.withColumn(out, F.when(F.coalesce(F.col(column), F.lit("")) == "", F.col(column)).otherwise(back)).drop(f"{own}x", f"{own}f", f"{own}l")


def build_notes(cards: DataFrame) -> DataFrame:
    """card_id, deck, model, fields and tags: Cloze where either side has a cloze mark, else Basic. Without a column tags there are none."""
    sides = {c: F.coalesce(c, F.lit("")) for c in ("front", "back")}
    cards = with_html(with_html(cards.withColumns(sides), "front", "front_html"), "back", "back_html")
    front, back = F.col("front_html"), F.col("back_html")
    cloze = F.col("front").rlike(r"\{\{c\d+::") | F.coalesce(F.col("back").rlike(r"\{\{c\d+::"), F.lit(False))
    tags = clean_tags(F.concat_ws(",", "tags")) if "tags" in cards.columns else F.array().cast("array<string>")
    text = F.when(F.trim(F.coalesce("back", F.lit(""))) != "", F.concat(front, F.lit("<br><br>"), back)).otherwise(front)
    return cards.select(
        "card_id", F.coalesce("deck", F.lit("Default")).alias("deck"), F.when(cloze, "Cloze").otherwise("Basic").alias("model"),
        F.when(cloze, text).otherwise(front).alias("field_1"), F.when(cloze, F.lit("")).otherwise(back).alias("field_2"), tags.alias("tags"),
    )
