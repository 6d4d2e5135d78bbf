"""Registered queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import features, payloads, progress, review, segments, similarity, state, turns
from ..operators import vectors as vector_search
from ..sources import exports, store, transcripts
from ..sources.shared import shared_path
from ..streaming import harvest
from . import fixtures as fx
from .fixtures import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Types that any engine has: whole numbers as long, days and times as text, arrays joined."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(name))
    return df.select(*out)


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def turns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.pair_turns(fx.entries(spark, sf_dir))


def long_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.pair_turns(fx.long_entries(spark, sf_dir))


def long_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_key_terms(features.turn_signals(long_turns(spark, sf_dir)), ["path", "turn_index"])


DAY = "substring(path, 1, 10)"

BUILT = "SELECT path, turn_index, sha256(path || ':' || coalesce(first_value(user_ts) OVER (PARTITION BY path ORDER BY turn_index), '')) AS conversation_id, sha256(path || ':' || coalesce(user_ts, '') || prompt || answer) AS context_id, user_ts, assistant_ts, prompt, substring(answer, 1, 2000) AS answer, length(answer)::BIGINT AS answer_chars FROM TURNS"

# --- sources -----------------------------------------------------------------


@query()
def scan_transcripts(spark, sf_dir):
    """Writes a file for each conversation, twice, and scans the folder."""
    out = shared_path(spark)
    rendered = transcripts.render_transcripts(messages_of(spark, sf_dir))
    for _ in range(2):
        transcripts.write_markdown(rendered, out)
    found = transcripts.scan_transcripts(spark, out)
    return found.select(F.regexp_extract("path", r"\d{4}/\d{2}/\d{2}/[^/]+$", 0).alias("path"), F.sha2("value", 256).alias("content"), F.length("value").alias("chars"))


def messages_of(spark, sf_dir):
    e = fx.entries(spark, sf_dir)
    return e.select(F.col("conv_id").alias("conversation_id"), F.concat(F.lit("Conv "), F.col("conv_id").cast("string")).alias("title"), "pos", "role", "ts_raw", "text")


TRIMMED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
MAPPED = f"""SELECT conv_id, pos, role, ts_raw, CASE pos % 4 WHEN 0 THEN {TRIMMED} WHEN 1 THEN {TRIMMED.replace("text", "text || chr(10) || chr(10) || 'so $x_1$ and $$y$$'")} WHEN 2 THEN {TRIMMED} || CASE WHEN {TRIMMED} = '' THEN '' ELSE chr(10) END || chr(10) || '[image asset: file://' || conv_id::VARCHAR || ']' || chr(10)
    ELSE '{{"content_type":"code","language":"x","text":"n"}}' END AS said FROM T"""


@query(sql("SELECT 'c' || conv_id::VARCHAR AS conversation_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS pos, role, ts_raw, said AS text FROM M WHERE said <> ''", "T", M=MAPPED))
def load_export_mapping(spark, sf_dir):
    """Contents: plain with a citation, two parts with formulas, with an image, of another kind; and hidden, empty and missing messages."""
    e = fx.entries(spark, sf_dir)
    content = lambda kind, *parts: F.to_json(F.struct(F.lit(kind).alias("content_type"), F.array(*parts).alias("parts")))
    image = F.format_string('{"content_type":"image_asset","asset_pointer":"file://%d"}', "conv_id")
    raw = (
        F.when(F.col("pos") % 4 == 0, content("text", F.concat("text", F.lit("\ue200cite\ue202turn\ue201"))))
        .when(F.col("pos") % 4 == 1, content("text", F.col("text"), F.lit("so \\( x_1 \\) and \\[ y\n\\]")))
        .when(F.col("pos") % 4 == 2, F.replace(content("multimodal_text", F.col("text"), F.lit("@image@")), F.lit('"@image@"'), image))
        .otherwise('{"content_type":"code","language":"x","text":"n"}')
    )
    message = lambda id, raw, hidden: F.concat(F.lit('{"message":{"id":"'), id, F.lit('","author":{"role":"'), "role", F.lit('"},"create_time":'), F.unix_timestamp("ts_raw").cast("string"), F.lit(',"content":'), raw, F.lit(f',"metadata":{{"is_visually_hidden_from_conversation":{hidden}}}}}}}'))
    key = F.lpad(F.col("pos").cast("string"), 9, "0")
    node = lambda id, value: F.concat(F.lit('"'), id, F.lit('":'), value)
    extra = F.concat(key, F.lit("h"))
    nodes = F.concat_ws(",", node(key, message(key, raw, "false")), node(extra, message(extra, F.lit('{"content_type":"text","parts":["secret"]}'), "true")), node(F.concat(key, F.lit("e")), message(F.concat(key, F.lit("e")), F.lit('{"content_type":"text","parts":[" ",null]}'), "false")), node(F.concat(key, F.lit("n")), F.lit('{"message":null}')))
    records = e.groupBy("conv_id").agg(F.concat(F.lit('{"id":"c'), F.col("conv_id").cast("string"), F.lit('","mapping":{'), F.array_join(F.collect_list(nodes), ","), F.lit("}}")).alias("j"))
    back = records.select(F.from_json("j", exports.MAPPING).alias("r")).select("r.*")
    return exports.mapping_messages(back).select("conversation_id", "pos", "role", "ts_raw", "text")


BLOCKS = f"""SELECT 'c' || conv_id::VARCHAR AS conversation_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS pos, role, ts_raw, CASE pos % 3
    WHEN 0 THEN concat_ws(chr(10), '<details>', '<summary>Thinking</summary>', '', 'hm $y$', '', '</details>', '**[Tool Result: calc]**', '42', nullif({TRIMMED}, ''))
    WHEN 1 THEN concat_ws(chr(10), '**[Tool Use: calc]** run', nullif({TRIMMED}, ''))
    ELSE concat_ws(chr(10), nullif({TRIMMED}, ''), '', '**[Attachment: a.txt]** (txt, 5 bytes)', '', '<details>', '<summary>Attachment content</summary>', '', '```', substring(text, 1, 1000) || CASE WHEN length(text) > 1000 THEN chr(10) || '... (truncated)' ELSE '' END, '```', '</details>') END AS text FROM T"""


@query(sql(BLOCKS, "T"))
def load_export_messages(spark, sf_dir):
    """Blocks of text with a citation, thinking with a formula, tool use, tool results and attachments."""
    e = fx.entries(spark, sf_dir)
    none, inner = F.lit(None).cast("string"), "array<struct<type:string,text:string>>"

    def block(kind, text=none, thinking=none, name=none, message=none, content=None):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), thinking.alias("thinking"), name.alias("name"), message.alias("message"), (F.lit(None) if content is None else content).cast(inner).alias("content"))

    said = block("text", F.concat("text", F.lit("\ue200cite\ue201")))
    thought = block("thinking", thinking=F.lit(" hm \\( y \\)\n"))
    found = block("tool_result", name=F.lit("calc"), content=F.array(F.struct(F.lit("text"), F.lit(" 42 \ue200c\ue201")), F.struct(F.lit("image"), F.lit("no")), F.struct(F.lit("text"), F.lit(" "))))
    blocks = F.when(F.col("pos") % 3 == 0, F.array(thought, found, block("tool_result", name=F.lit("void"), content=F.array()), said)).when(F.col("pos") % 3 == 1, F.array(block("tool_use", name=F.lit("calc"), message=F.lit("run")), said)).otherwise(F.array(said))
    attach = F.when(F.col("pos") % 3 == 2, F.array(F.struct(F.lit("a.txt").alias("file_name"), F.lit("txt").alias("file_type"), F.lit(5).alias("file_size"), F.col("text").alias("extracted_content"))))
    m = F.struct(F.col("role").alias("sender"), F.concat(F.replace("ts_raw", F.lit(" "), F.lit("T")), F.lit("Z")).alias("created_at"), blocks.alias("content"), attach.alias("attachments"))
    records = e.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", m.alias("m")))), lambda r: r["m"]).alias("chat_messages"))
    text = records.select(F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("uuid"), "chat_messages")).alias("j"))
    back = text.select(F.from_json("j", exports.MESSAGES).alias("r")).select("r.*")
    return exports.chat_messages(back).select("conversation_id", F.col("pos").cast("long").alias("pos"), "role", "ts_raw", "text")


RENDERED = """SELECT conv_id AS conversation_id, min(substring(ts_raw, 1, 10)) AS day, min(replace(substring(ts_raw, 1, 10), '-', '/') || '/' || substring(ts_raw, 1, 10) || '_conv-' || conv_id::VARCHAR || '.md') AS path,
    regexp_replace('# Conv ' || conv_id::VARCHAR || chr(10) || chr(10) || {link}'- Created: ' || min(ts_raw) || chr(10) || '- Updated: ' || max(ts_raw) || chr(10) || chr(10) || '---' || chr(10) || chr(10)
    || string_agg('[' || ts_raw || '] ' || role || ':' || CASE WHEN trim(text) = '' THEN '' ELSE chr(10) || text END || chr(10), chr(10) ORDER BY pos), '\\s+$', '') || chr(10) AS value FROM T GROUP BY conv_id"""
LINK = "'- URL: https://chat.example/c/' || conv_id::VARCHAR || chr(10) || "


@query(sql("SELECT conversation_id, day, path, sha256(value) AS content FROM R", "T", R=RENDERED.format(link=LINK)))
def render_transcripts(spark, sf_dir):
    return transcripts.render_transcripts(messages_of(spark, sf_dir), "https://chat.example/c/").select("conversation_id", "day", "path", F.sha2("value", 256).alias("content"))


ORACLES["scan_transcripts"] = sql("SELECT path, sha256(value) AS content, length(value) AS chars FROM R", "T", R=RENDERED.format(link=""))


@query(sql("SELECT path, CASE WHEN conv_id % 3 = 0 THEN 'written' WHEN conv_id % 3 = 1 THEN 'skipped' ELSE 'updated' END AS status FROM FILES", "FILES"))
def upsert_status(spark, sf_dir):
    new = fx.files(spark, sf_dir).select("path", "conv_id", F.col("mtime").alias("value"))
    old = new.where("conv_id % 3 != 0").select("path", F.when(F.col("conv_id") % 3 == 1, F.col("value")).otherwise("old").alias("value"))
    return transcripts.upsert_status(new.select("path", "value"), old)


NOTES = "SELECT doc_id AS note_id, source AS deck, CASE WHEN doc_id % 10 = 0 THEN ' ' WHEN doc_id % 10 = 7 THEN '' ELSE text END AS front, CASE WHEN doc_id % 20 = 0 OR doc_id % 20 = 7 THEN '' ELSE lang END AS back FROM documents"


def notes_of(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("note_id"), F.col("source").alias("deck"), F.when(F.col("doc_id") % 10 == 0, " ").when(F.col("doc_id") % 10 == 7, "").otherwise(F.col("text")).alias("front"), F.when((F.col("doc_id") % 20).isin(0, 7), "").otherwise(F.col("lang")).alias("back"))


@query(sql("SELECT note_id, deck, CASE deck WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END::BIGINT AS deck_order, trim(regexp_replace(lower(front), '[^a-z0-9]+', ' ', 'g')) AS front_norm, trim(regexp_replace(lower(back), '[^a-z0-9]+', ' ', 'g')) AS back_norm FROM NOTES WHERE deck IN ('src3', 'src1', 'src2') AND NOT (front = '' AND back = '')", NOTES=NOTES))
def load_cards(spark, sf_dir):
    return state.load_cards(notes_of(spark, sf_dir), ["src3", "src1", "src2"]).select("note_id", "deck", "deck_order", "front_norm", "back_norm")


@query(sql("SELECT CASE WHEN length(path) % 2 = 0 THEN 'run-1' ELSE 'run-0' END AS run_id, CASE WHEN length(path) % 2 = 0 THEN conversation_id END AS conversation_id, turn_index, length(prompt)::BIGINT AS prompt_chars FROM B", "TURNS", B=BUILT))
def run_turn_lookup(spark, sf_dir):
    """One run of conversations, written twice, and single turns of the older layout, of that run and of another."""
    out, b = shared_path(spark), turns.build_turns(turns_of(spark, sf_dir))
    new = features.assembled(b.where("length(path) % 2 = 0"), ["conversation_id"], ["context_id", "prompt"]).withColumn("run_id", F.lit("run-1"))
    for _ in range(2):
        transcripts.write_run(new, fx.cards(spark, sf_dir).select("card_id", "run_id"), out)
    older = F.when(F.expr("length(path) % 2 = 0"), "run-1").otherwise("run-0").alias("run_id")
    b.select("turn_index", "context_id", "prompt", older).write.partitionBy("run_id").json(f"{out}/contexts")
    return transcripts.read_run_turns(spark, out).select("run_id", "conversation_id", "turn_index", F.length("prompt").alias("prompt_chars"))


@query(sql("SELECT path, max(cards_generated) AS cards_generated, '2024-06-01' AS processed_at, 'reconciled' AS status FROM PROCESSED WHERE cards_generated = 0 GROUP BY path UNION ALL SELECT path, cards_generated, strftime(processed_at, '%Y-%m-%d'), 'generated' FROM PROCESSED WHERE cards_generated <> 0", "PROCESSED"))
def state_upsert(spark, sf_dir):
    p = fx.processed(spark, sf_dir).withColumn("status", F.lit("generated"))
    again = p.where("cards_generated = 0").withColumns({"processed_at": F.lit("2024-06-01").cast("date"), "status": F.lit("reconciled")})
    return state.latest_per_key(p.unionByName(again), "path", "processed_at")


MIGRATED = """SELECT path AS source_path, count(*) AS turn_count, round(sum(score::DECIMAL(10,4))::DOUBLE / count(*), 6) AS aggregate_score, sum(length(answer))::BIGINT AS total_char_count, sha256(path || ':migrated') AS conversation_id FROM SIG GROUP BY path"""


@query(sql("SELECT m.*, k.key_topics FROM M m LEFT JOIN K2 k ON m.source_path = k.path", "SIG", "TERMS", M=MIGRATED,
    K0="SELECT path, turn_index, unnest(key_terms) AS term, generate_subscripts(key_terms, 1) AS p FROM TERMS", K1="SELECT path, term, min(turn_index * 100 + p) AS o FROM K0 GROUP BY ALL",
    KR="SELECT *, row_number() OVER (PARTITION BY path ORDER BY o) AS r FROM K1", K2="SELECT path, string_agg(term, ',' ORDER BY o) AS key_topics FROM KR WHERE r <= 10 GROUP BY path"))
def migrate_turns(spark, sf_dir):
    x = features.with_key_terms(features.turn_signals(turns_of(spark, sf_dir)), ["path", "turn_index"])
    return state.migrate_turns(x.withColumnRenamed("path", "source_path").withColumn("context_id", F.lit("")))


HTML = r"'<p>line</p><p><ul><li>a <i>b</i></li><li>c</li></ul><ol><li>d</li></ol>use \(x*y*z\) and <code>k</code></p>'"


@query(sql(f"SELECT card_id, deck, CASE WHEN card_id % 6 = 0 THEN 'Cloze' ELSE 'Basic' END AS model, CASE WHEN card_id % 6 = 0 THEN '{{{{c1::x}}}} <b>' || front || '</b><br><br>' || {HTML} ELSE '<b>' || front || '</b>' END AS field_1, CASE WHEN card_id % 6 = 0 THEN '' ELSE {HTML} END AS field_2, 'a,b c' AS tags FROM CARDS", "CARDS"))
def build_notes(spark, sf_dir):
    c = fx.cards(spark, sf_dir)
    bold = F.concat(F.lit("**"), "front", F.lit("**"))
    back = F.lit("line\n\n- a *b*\n  + c\n1. d\nuse \\(x*y*z\\) and `k`")
    return payloads.build_notes(c.select("card_id", "deck", F.when(F.col("card_id") % 6 == 0, F.concat(F.lit("{{c1::x}} "), bold)).otherwise(bold).alias("front"), back.alias("back"), F.when(F.col("card_id") % 2 == 0, F.array(F.lit(" a, b c "), F.lit(""))).otherwise(F.array(F.lit("a"), F.lit("b c"))).alias("tags")))


# --- filters -----------------------------------------------------------------


@query(sql("SELECT path FROM FILES WHERE substring(path, 1, 10) >= '2024-02-01' AND substring(path, 1, 10) < '2024-03-01'", "FILES"))
def filter_date_range(spark, sf_dir):
    return state.filter_date_range(fx.files(spark, sf_dir), "2024-02").select("path")


@query(sql("SELECT path FROM FILES WHERE NOT (path GLOB '*_conv-1*.md' OR path GLOB '2024-0[34]-*')", "FILES"))
def filter_exclude_glob(spark, sf_dir):
    return state.filter_exclude_glob(fx.files(spark, sf_dir), ["*_conv-1*.md", "2024-0[34]-*"]).select("path")


@query(sql("SELECT path FROM FILES WHERE path NOT IN (SELECT path FROM PROCESSED)", "PROCESSED"))
def filter_unprocessed(spark, sf_dir):
    return state.filter_unprocessed(fx.files(spark, sf_dir), fx.processed(spark, sf_dir)).select("path")


@query(sql("SELECT path FROM PROCESSED WHERE cards_generated = 0", "PROCESSED"))
def filter_zero_card(spark, sf_dir):
    return state.filter_zero_card(fx.files(spark, sf_dir), fx.processed(spark, sf_dir)).select("path")


@query(sql("SELECT path FROM FILES WHERE path NOT IN (SELECT path FROM PROCESSED WHERE cards_generated <> 0)", "PROCESSED"))
def filter_unprocessed_or_zero(spark, sf_dir):
    return state.filter_unprocessed_or_zero(fx.files(spark, sf_dir), fx.processed(spark, sf_dir)).select("path")


@query(sql("SELECT path, conversation_id FROM FILES WHERE conversation_id NOT IN (SELECT conversation_id FROM SEEN) OR path IN (SELECT path FROM PROCESSED WHERE cards_generated = 0)", "PROCESSED", "SEEN"))
def filter_seen(spark, sf_dir):
    return state.filter_seen(fx.files(spark, sf_dir).select("path", "conversation_id"), fx.seen(spark, sf_dir), fx.processed(spark, sf_dir).where("cards_generated = 0"))


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click')")
def filter_non_content(spark, sf_dir):
    kind = F.expr("CASE event_type WHEN 'view' THEN 'thoughts' WHEN 'click' THEN 'CODE' WHEN 'error' THEN 'text' END")
    e = fx.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "signup", F.lit("{no json}")).otherwise(F.to_json(F.struct(kind.alias("content_type"), "props"))).alias("text"))
    return e.where(t.non_content(F.col("text"))).select("event_id")


@query(sql("SELECT path, turn_index, score FROM SIG WHERE score >= 1.2::DOUBLE", "SIG"))
def filter_min_score(spark, sf_dir):
    return features.turn_signals(turns_of(spark, sf_dir)).where(F.col("score") >= 1.2).select("path", "turn_index", "score")


@query(sql("SELECT path FROM FILES WHERE path NOT IN (SELECT path FROM TURNS)", "FILES", "TURNS"))
def find_stubs(spark, sf_dir):
    return state.find_stubs(fx.files(spark, sf_dir), turns_of(spark, sf_dir)).select("path")


@query(sql("SELECT path, substring(path, 1, 10) AS day FROM FILES WHERE conv_id % 9 <> 0 AND conv_id % 9 <> 1", "FILES"))
def scan_dated_files(spark, sf_dir):
    f = fx.files(spark, sf_dir)
    shown = F.when(F.col("conv_id") % 9 == 0, F.concat(F.lit(".hidden/"), "path")).when(F.col("conv_id") % 9 == 1, F.lit("a/undated.md")).when(F.col("conv_id") % 9 == 2, F.concat(F.substring("path", 1, 10), F.lit("/topic.md"))).otherwise(F.col("path"))
    return state.dated_files(f.select(F.col("path").alias("true_path"), shown.alias("path"))).select(F.col("true_path").alias("path"), "day")


@query(sql("SELECT card_id FROM CARDS WHERE deck = 'deck3' AND confidence >= 0.4::DOUBLE AND similarity_score >= 0.7::DOUBLE", "CARDS"))
def review_filter(spark, sf_dir):
    return review.review_filter(fx.cards(spark, sf_dir), "deck3", 0.4, "duplicates_only").select("card_id")


# --- text --------------------------------------------------------------------


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents")
def normalize_text(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", t.normalize_text(F.col("text")).alias("norm"))


@query("SELECT doc_id, coalesce(nullif(substring(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '[\\s/\\\\:]+', '-', 'g'), '[^a-z0-9._-]', '', 'g'), '-{2,}', '-', 'g'), 1, 120), ''), 'untitled') AS slug FROM documents")
def slugify(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", t.slugify(F.col("text")).alias("slug"))


@query("SELECT doc_id, '$' || lang || '$ and $$' || source || '$$ ' || text AS clean FROM documents")
def clean_message(spark, sf_dir):
    x = F.concat(F.lit("\\( "), "lang", F.lit(" \\) and \\["), "source", F.lit("\n\\]cite\nthis "), "text")
    return fx.table(spark, sf_dir, "documents").select("doc_id", t.convert_latex(t.strip_citations(x)).alias("clean"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS unix_text, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS iso_text, event_type AS other_text FROM events")
def format_timestamps(spark, sf_dir):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    return fx.table(spark, sf_dir, "events").select("event_id", t.format_unix(F.unix_timestamp("ts")).alias("unix_text"), t.format_iso(iso).alias("iso_text"), t.format_iso(F.col("event_type")).alias("other_text"))


@query(sql("SELECT path, turn_index, question_like, definition_like, bullet_count, heading_count, code_blocks, answer_length, imperative, score FROM SIG", "SIG"))
def turn_signals(spark, sf_dir):
    return features.turn_signals(turns_of(spark, sf_dir)).drop("user_ts", "assistant_ts", "prompt", "answer")


@query(sql("SELECT path, turn_index, array_to_string(key_terms, ',') AS key_terms FROM TERMS", "TERMS"))
def key_terms(spark, sf_dir):
    return features.ranked_terms(turns_of(spark, sf_dir), ["path", "turn_index"], F.concat("prompt", F.lit(" "), "answer"), 6).withColumnRenamed("terms", "key_terms")


@query(sql("SELECT path, turn_index, array_to_string(list_filter(list_transform(list_filter(list_transform(string_split(answer, chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: regexp_matches(l, '^[#*-]')), lambda l: trim(regexp_replace(l, '^[#*0-9. -]+', ''))), lambda l: l <> '')[1:4], ',') AS points FROM TURNS", "TURNS"))
def key_points(spark, sf_dir):
    return turns_of(spark, sf_dir).select("path", "turn_index", t.key_points(F.col("answer")).alias("points"))


@query(sql(BUILT, "TURNS"))
def build_turns(spark, sf_dir):
    return turns.build_turns(turns_of(spark, sf_dir)).drop("full_answer")


@query("SELECT doc_id, CASE WHEN length(text) > 4000 THEN substring(text, 1, 2800) || chr(10) || chr(10) || '[TRUNCATED: ' || format('{:,}', length(text) - 3600) || ' characters removed]' || chr(10) || chr(10) || right(text, 800) ELSE text END AS prompt FROM documents")
def truncate_prompt(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", t.truncate_prompt(F.col("text")).alias("prompt"))


@query("""WITH W AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS w FROM documents)
    SELECT a.doc_id, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE round(len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) END AS similarity FROM W a JOIN W b ON b.doc_id = a.doc_id + 1""")
def jaccard_pairs(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    return d.join(b, "doc_id").select("doc_id", F.round(t.jaccard(F.col("text"), F.col("next")), 6).alias("similarity"))


@query("""SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS parsed, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, NULL::VARCHAR AS none, strftime(date_trunc('second', ts) - INTERVAL 150 MINUTE, '%Y-%m-%d %H:%M:%S') AS shifted,
    strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute FROM events""")
def parse_user_ts(spark, sf_dir):
    e, at = fx.table(spark, sf_dir, "events"), lambda form: t.parse_user_time(F.date_format("ts", form))
    return e.select("event_id", at("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("parsed"), at("yyyy-MM-dd").alias("day"), t.parse_user_time(F.col("event_type")).alias("none"), at("' 'yyyy-MM-dd HH:mm:ss.SSS'+02:30'").alias("shifted"), at("yyyy-MM-dd HH:mm").alias("minute"))


@query(sql("SELECT card_id, CASE WHEN coalesce(is_likely_duplicate, false) THEN CASE WHEN similarity_score >= 0.95::DOUBLE THEN 'VERY HIGH' WHEN similarity_score >= 0.9::DOUBLE THEN 'HIGH' ELSE 'MODERATE' END END AS severity FROM CARDS", "CARDS"))
def duplicate_severity(spark, sf_dir):
    return fx.cards(spark, sf_dir).select("card_id", t.severity(F.coalesce("is_likely_duplicate", F.lit(False)), F.col("similarity_score")).alias("severity"))


# --- parsing and pairing -----------------------------------------------------


def rendered_parts(spark, sf_dir):
    r = transcripts.render_transcripts(messages_of(spark, sf_dir))
    return turns.transcript_parts(r.select("path", "value"))


@query(sql("SELECT p AS path, unnest(['title', 'created', 'updated']) AS key, unnest(['Conv ' || conv_id::VARCHAR, lo, hi]) AS value FROM G", "T", G="SELECT conv_id, min(ts_raw) AS lo, max(ts_raw) AS hi, min(replace(substring(ts_raw, 1, 10), '-', '/') || '/' || substring(ts_raw, 1, 10) || '_conv-' || conv_id::VARCHAR || '.md') AS p FROM T GROUP BY conv_id"))
def transcript_metadata(spark, sf_dir):
    return turns.transcript_metadata(rendered_parts(spark, sf_dir))


@query(sql(f"SELECT replace(substring(first, 1, 10), '-', '/') || '/' || substring(first, 1, 10) || '_conv-' || conv_id::VARCHAR || '.md' AS path, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS entry, role, ts_raw, {TRIMMED} AS text FROM E WHERE role IN ('user', 'assistant')", "T", E="SELECT *, min(ts_raw) OVER (PARTITION BY conv_id) AS first FROM T"))
def parse_entries(spark, sf_dir):
    return turns.parse_entries(rendered_parts(spark, sf_dir))


@query(sql("SELECT * FROM TURNS", "TURNS"))
def pair_turns(spark, sf_dir):
    return turns_of(spark, sf_dir)


@query(sql("SELECT * FROM TURNS", "TURNS"))
def pair_turns_spread(spark, sf_dir):
    """The same in blocks of two places, so that no task has a whole path."""
    return turns.pair_turns(fx.entries(spark, sf_dir), spread=2)


# --- features ----------------------------------------------------------------

SIGNALS = """SELECT path, count(*) AS turn_count, round(sum(score::DECIMAL(10,4))::DOUBLE, 3) AS total_score, count(*) FILTER (question_like) AS question_turns, count(*) FILTER (definition_like) AS definition_turns,
    count(*) FILTER (code_blocks > 0) AS code_turns, sum(bullet_count)::BIGINT AS total_bullets, sum(heading_count)::BIGINT AS total_headings, max(length(prompt))::BIGINT AS max_user_prompt_chars,
    count(*) FILTER (turn_index > 0 AND regexp_matches(lower(prompt), 'can you explain|what do you mean|i don''t understand|could you clarify|wait,|actually,|so you''re saying|let me make sure')) AS followup_turns,
    count(*) FILTER (turn_index > 0 AND regexp_matches(lower(answer), 'actually,|i should clarify|to correct|i was wrong|more accurately|let me rephrase')) AS correction_turns,
    sum(length(prompt) + answer_length)::BIGINT AS total_char_count FROM {sig} GROUP BY path"""
SIGNALS_OUT = "SELECT *, round(total_score / turn_count, 6) AS avg_score, max_user_prompt_chars > 20000 AS has_mega_paste, round(total_score + CASE WHEN turn_count >= 2 AND question_turns > 0 THEN 0.5::DOUBLE ELSE 0 END, 4) AS aggregate_score FROM SUMS"
CONVS = sql(SIGNALS_OUT, "SIG", SUMS=SIGNALS.format(sig="SIG"))


def conversations_of(spark, sf_dir):
    return features.conversation_signals(features.turn_signals(turns_of(spark, sf_dir)), ["path"])


@query(CONVS)
def conversation_signals(spark, sf_dir):
    return conversations_of(spark, sf_dir)


TOPICS = {
    "K0": "SELECT path, turn_index, unnest(key_terms) AS word, generate_subscripts(key_terms, 1) AS p FROM TERMS",
    "K1": "SELECT path, word, count(*) AS n, min(turn_index * 100 + p) AS o FROM K0 GROUP BY ALL",
    "K2": "SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, o) AS rank FROM K1",
}


@query(sql("SELECT path, string_agg(word, ',' ORDER BY rank) AS key_topics FROM K2 WHERE rank <= 8 GROUP BY path", "TERMS", **TOPICS))
def key_topics(spark, sf_dir):
    x = features.with_key_terms(turns_of(spark, sf_dir), ["path", "turn_index"])
    return features.key_topics(x, ["path"]).withColumnRenamed("terms", "key_topics")


@query(sql("SELECT path, count(*) AS n, string_agg(turn_index::VARCHAR || ':' || length(prompt)::VARCHAR || ':' || score::DECIMAL(10,4)::VARCHAR, ',' ORDER BY turn_index) AS turns FROM SIG GROUP BY path", "SIG"))
def build_conversations(spark, sf_dir):
    x = features.assembled(features.turn_signals(turns_of(spark, sf_dir)), ["path"], ["prompt", "score"])
    return x.select("path", F.size("turns").alias("n"), F.transform("turns", lambda r: F.concat_ws(":", r["turn_index"].cast("string"), F.length(r["prompt"]).cast("string"), r["score"].cast("decimal(10,4)").cast("string"))).alias("turns"))


# --- segments, caps, batches -------------------------------------------------

SHIFTS = {
    "B0": "SELECT t.path, t.turn_index, t.prompt, t.answer, coalesce(k.key_terms, []) AS terms FROM L_TURNS t LEFT JOIN L_TERMS k USING (path, turn_index)",
    "B1": "SELECT *, lag(terms) OVER (PARTITION BY path ORDER BY turn_index) AS before FROM B0",
    "B2": """SELECT *, turn_index > 0 AND (regexp_matches(lower(prompt), 'moving on|now, about|changing topic|different question|unrelated,|on another note|separately,|new question')
        OR coalesce(len(before) > 0 AND len(terms) > 0 AND len(list_intersect(before, terms))::DOUBLE / greatest(len(before), len(terms)) < 0.2::DOUBLE, false)) AS shift FROM B1""",
}


@query(sql("SELECT path, turn_index, shift FROM B2", "L_TURNS", "L_TERMS", **SHIFTS))
def topic_shift(spark, sf_dir):
    return segments.topic_shifts(long_terms(spark, sf_dir), ["path"]).select("path", "turn_index", "shift")


SPLITS = SHIFTS | {
    "B3": "SELECT *, greatest(coalesce(max(CASE WHEN NOT shift THEN turn_index END) OVER (PARTITION BY path ORDER BY turn_index ROWS UNBOUNDED PRECEDING), 0) + 1, 2) AS base, count(*) OVER (PARTITION BY path) AS n, sum(length(prompt) + length(answer)) OVER (PARTITION BY path) AS chars FROM B2",
    "B4": "SELECT *, shift AND turn_index >= base AND (turn_index - base) % 2 = 0 AS split FROM B3",
    "B5": "SELECT *, sum(split::INT) OVER (PARTITION BY path) AS splits, sum(split::INT) OVER (PARTITION BY path ORDER BY turn_index ROWS UNBOUNDED PRECEDING) + 1 AS run FROM B4",
    "B6": "SELECT path, turn_index, prompt, (CASE WHEN n > 10 OR chars > 8000 THEN CASE WHEN splits > 0 THEN run WHEN n > 10 THEN turn_index // 10 + 1 ELSE 1 END END)::BIGINT AS part FROM B5",
}


@query(sql("SELECT path, turn_index, part FROM B6", "L_TURNS", "L_TERMS", **SPLITS))
def topic_segments_spread(spark, sf_dir):
    """Segments found in blocks of three turns, so that no task has a whole conversation."""
    x = segments.topic_segments(segments.topic_shifts(long_terms(spark, sf_dir), ["path"]), ["path"], F.length("prompt") + F.length("answer"), spread=3)
    return x.select("path", "turn_index", "part")


SEGMENTS = SPLITS | {
    "B7": "SELECT *, row_number() OVER (PARTITION BY path, part ORDER BY turn_index) - 1 AS nth FROM B6",
    "Y0": "SELECT b.path, coalesce(b.part, 0) AS part, b.nth, unnest(k.key_terms) AS word, generate_subscripts(k.key_terms, 1) AS p FROM B7 b JOIN L_TERMS k USING (path, turn_index)",
    "Y1": "SELECT path, part, word, count(*) AS n, min(nth * 100 + p) AS o FROM Y0 GROUP BY ALL",
    "Y2": "SELECT *, row_number() OVER (PARTITION BY path, part ORDER BY n DESC, o) AS rank FROM Y1",
    "Y3": "SELECT path, part, string_agg(word, ',' ORDER BY rank) AS key_topics FROM Y2 WHERE rank <= 8 GROUP BY path, part",
    "Y4": """SELECT s.path, coalesce(s.part, 0) AS part, CASE WHEN any_value(s.part) IS NULL THEN 'id ' || s.path ELSE 'id ' || s.path || '_part' || any_value(s.part)::VARCHAR END AS segment_id, count(*) AS turn_count, min(s.turn_index) AS first_turn, round(sum(g.score::DECIMAL(10,4))::DOUBLE, 3) AS total_score, count(*) FILTER (g.question_like) AS question_turns,
        string_agg(s.nth::VARCHAR || ':' || s.path || s.turn_index::VARCHAR, ',' ORDER BY s.nth) AS turns FROM B7 s JOIN L_SIG g USING (path, turn_index) GROUP BY s.path, coalesce(s.part, 0)""",
}


@query(sql("SELECT y.*, coalesce(k.key_topics, '') AS key_topics FROM Y4 y LEFT JOIN Y3 k USING (path, part)", "L_TURNS", "L_TERMS", "L_SIG", **SEGMENTS))
def topic_segments(spark, sf_dir):
    x = segments.topic_segments(segments.topic_shifts(long_terms(spark, sf_dir), ["path"]), ["path"], F.length("prompt") + F.length("answer"))
    x = x.withColumns({"conversation_id": F.concat(F.lit("id "), "path"), "context_id": F.concat("path", F.col("turn_index").cast("string"))})
    shown = F.transform("turns", lambda r: F.concat_ws(":", r["turn_index"].cast("string"), r["context_id"]))
    s = segments.segment_conversations(x, ["path"])
    return s.select("path", "part", "segment_id", "turn_count", F.array_min(F.transform("turns", lambda r: F.replace(r["context_id"], F.col("path"), F.lit("")).cast("long"))).alias("first_turn"), "total_score", "question_turns", shown.alias("turns"), "key_topics")


@query(sql("SELECT path, mtime FROM FILES ORDER BY mtime DESC, path LIMIT 300", "FILES"))
def newest_files(spark, sf_dir):
    return segments.newest_files(fx.files(spark, sf_dir)).select("path", "mtime")


@query(sql("SELECT path, n_conversations FROM (SELECT *, coalesce(sum(n_conversations) OVER (ORDER BY mtime DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT * FROM FILES ORDER BY mtime DESC, path LIMIT 300)) WHERE before < 24", "FILES"))
def soft_cap(spark, sf_dir):
    return segments.soft_cap(segments.newest_files(fx.files(spark, sf_dir))).select("path", "n_conversations")


@query(sql("SELECT path, turn_index, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY turn_index) AS r FROM SIG WHERE score >= 1.2::DOUBLE) WHERE r <= 3 ORDER BY path, turn_index LIMIT 24", "SIG"))
def top_turns_per_file(spark, sf_dir):
    return segments.top_turns_per_file(features.turn_signals(turns_of(spark, sf_dir))).select("path", "turn_index", "score")


@query(sql("SELECT note_id, deck FROM (SELECT *, row_number() OVER (PARTITION BY deck ORDER BY note_id) AS r, min(note_id) OVER (PARTITION BY deck) AS f, count(*) OVER () AS n, (SELECT greatest(1, 50 // count(DISTINCT deck)) FROM NOTES) AS per FROM NOTES) ORDER BY CASE WHEN n > 50 AND r <= per THEN 0 ELSE 1 END, CASE WHEN n > 50 AND r <= per THEN f END, note_id LIMIT 50", NOTES=NOTES))
def stratified_cards(spark, sf_dir):
    return segments.stratified_cards(notes_of(spark, sf_dir), 50).select("note_id", "deck")


BATCHES = f"SELECT path, (row_number() OVER (ORDER BY aggregate_score DESC, path) - 1) // 8 + 1 AS batch, row_number() OVER (ORDER BY aggregate_score DESC, path) - 1 AS place FROM ({CONVS})"


def batches_of(spark, sf_dir):
    return segments.make_batches(conversations_of(spark, sf_dir), 8, "path")


@query(BATCHES)
def make_batches(spark, sf_dir):
    return batches_of(spark, sf_dir).select("path", "batch", "place")


# --- state -------------------------------------------------------------------


@query(sql("SELECT path, CASE WHEN bool_or(conv_id % 5 = 1) THEN 'stage1_rejected' ELSE 'dedup_skipped' END AS status FROM (SELECT *, conversation_id IN (SELECT conversation_id FROM SEEN) AS s FROM FILES) GROUP BY path HAVING bool_and(s OR conv_id % 5 IN (0, 1))", "SEEN"))
def files_decided(spark, sf_dir):
    f = fx.files(spark, sf_dir)
    return state.files_decided(f, f.where("conv_id % 5 = 0"), f.where("conv_id % 5 = 1"), fx.seen(spark, sf_dir))


@query(sql("SELECT substring(path, 1, 7) AS month, count(*) AS n_files FROM FILES WHERE path NOT IN (SELECT path FROM PROCESSED) GROUP BY 1", "PROCESSED"))
def months_with_work(spark, sf_dir):
    return state.months_with_work(state.filter_unprocessed(fx.files(spark, sf_dir), fx.processed(spark, sf_dir)))


@query(sql("SELECT path, 'reconciled' AS status FROM FILES WHERE path NOT IN (SELECT path FROM PROCESSED) AND conversation_id IN (SELECT regexp_replace(conversation_id, '_part.*$', '') FROM SEEN)", "PROCESSED", "SEEN"))
def reconcile_seen(spark, sf_dir):
    return state.reconcile_seen(fx.files(spark, sf_dir), fx.processed(spark, sf_dir), fx.seen(spark, sf_dir))


@query(sql("SELECT path, 'stub_file' AS status FROM FILES WHERE path NOT IN (SELECT path FROM PROCESSED) AND path NOT IN (SELECT path FROM TURNS) AND NOT path GLOB '2024-04-*'", "PROCESSED", "TURNS"))
def reconcile_stubs(spark, sf_dir):
    return state.reconcile_stubs(fx.files(spark, sf_dir), fx.processed(spark, sf_dir), turns_of(spark, sf_dir), ["2024-04-*"])


@query(sql("""SELECT path, cards_generated, strftime(processed_at, '%Y-%m-%d') AS processed_at, 'before' AS status FROM PROCESSED UNION ALL
    SELECT path, (SELECT count(*) FROM events e WHERE e.user_id = f.conv_id), '2024-06-01', 'generated' FROM FILES f WHERE path NOT IN (SELECT path FROM PROCESSED)""", "PROCESSED"))
def book_files(spark, sf_dir):
    """A run over all files: those that have a row keep it."""
    f = fx.files(spark, sf_dir)
    e = fx.table(spark, sf_dir, "events").join(f.select(F.col("conv_id").alias("user_id"), "conversation_id"), "user_id")
    return state.book_files(fx.processed(spark, sf_dir).withColumn("status", F.lit("before")), f, e, F.lit("2024-06-01").cast("date"))


@query(sql("""SELECT 'files' AS name, count(*) AS n, sum(cards_generated)::BIGINT AS total FROM (SELECT path, CASE WHEN cards_generated = 0 THEN 7 ELSE cards_generated END AS cards_generated FROM PROCESSED)
    UNION ALL SELECT 'seen', count(*), 0 FROM (SELECT conversation_id FROM SEEN UNION SELECT conversation_id FROM FILES WHERE conv_id % 2 = 0) UNION ALL SELECT 'history', 2, (SELECT count(*) FROM SEEN) + (SELECT count(*) FROM FILES WHERE conv_id % 2 = 0)""", "PROCESSED", "SEEN"))
def state_store(spark, sf_dir):
    """Two runs write to the stored state, the second one twice; then it is read."""
    kept = store.StateStore(spark, shared_path(spark))
    p, at = fx.processed(spark, sf_dir).withColumn("status", F.lit("generated")), F.lit("2024-06-01").cast("timestamp")
    again, fresh = p.where("cards_generated = 0").withColumn("cards_generated", F.lit(7)), fx.files(spark, sf_dir).where("conv_id % 2 = 0")
    for version, files, seen in ((1, p, fx.seen(spark, sf_dir)), (2, again, fresh), (2, again, fresh)):
        kept.append("processed_files", files, version)
        kept.append("seen_conversations", seen, version)
        kept.append("run_history", state.run_record(seen, f"run-{version}", at), version)
    whole = lambda name, df, total: df.agg(F.count("*").alias("n"), total.alias("total")).select(F.lit(name).alias("name"), "n", "total")
    parts = [whole("files", kept.read("processed_files"), F.sum("cards_generated")), whole("seen", kept.read("seen_conversations"), F.lit(0).cast("long")), whole("history", kept.read("run_history"), F.sum("conversations_sent"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(sql("SELECT f.path, count(e.event_id) AS cards FROM FILES f LEFT JOIN events e ON e.user_id = f.conv_id GROUP BY f.path", "FILES"))
def cards_per_file(spark, sf_dir):
    f = fx.files(spark, sf_dir)
    e = fx.table(spark, sf_dir, "events").join(f.select(F.col("conv_id").alias("user_id"), "conversation_id"), "user_id")
    return state.cards_per_file(f, e)


@query(sql("SELECT DISTINCT deck FROM CARDS WHERE deck NOT IN ('deck0', 'deck5')", "CARDS"))
def missing_decks(spark, sf_dir):
    return state.missing_decks(fx.cards(spark, sf_dir), spark.createDataFrame([("deck0",), ("deck5",)], "deck string"))


@query(sql("""SELECT path, turn_index, CASE WHEN turn_index % 3 <> 2 THEN prompt END AS prompt, CASE WHEN turn_index % 3 <> 2 THEN 'Title ' || path END AS title, CASE WHEN turn_index % 3 <> 2 THEN 'https://chat.example/' || path END AS url,
    CASE WHEN turn_index % 3 <> 2 THEN coalesce(key_topics, '') END AS key_topics, CASE WHEN turn_index % 3 <> 2 THEN count(*) OVER (PARTITION BY path) END AS turn_count FROM B LEFT JOIN K3 USING (path)""", "TURNS", "TERMS", B=BUILT, **TOPICS, K3="SELECT path, string_agg(word, ',' ORDER BY rank) AS key_topics FROM K2 WHERE rank <= 8 GROUP BY path"))
def card_context(spark, sf_dir):
    b = turns.build_turns(turns_of(spark, sf_dir))
    c = b.select(F.col("path").alias("p"), F.when(F.col("turn_index") % 3 == 0, F.col("context_id")).otherwise("none").alias("context_id"), F.when(F.col("turn_index") % 3 == 1, F.col("conversation_id")).alias("conversation_id"), "turn_index")
    topics = features.key_topics(features.with_key_terms(turns_of(spark, sf_dir), ["path", "turn_index"]), ["path"]).withColumnRenamed("terms", "key_topics")
    about = b.groupBy("path", "conversation_id").agg(F.count("*").alias("turn_count")).join(topics, "path", "left").select("conversation_id", F.concat(F.lit("Title "), "path").alias("title"), F.concat(F.lit("https://chat.example/"), "path").alias("url"), F.coalesce("key_topics", F.array().cast("array<string>")).alias("key_topics"), "turn_count")
    x = state.card_context(c, b, about)
    return x.select(F.col("p").alias("path"), "turn_index", "prompt", *[F.col(f"conversation_{n}").alias(n) for n in ("title", "url", "key_topics", "turn_count")])


@query(sql("SELECT path, batch FROM (SELECT *, bool_or(place % 3 = 0 AND batch % 2 = 0) OVER (PARTITION BY batch) AS any_kept FROM B) WHERE NOT any_kept OR (place % 3 = 0 AND batch % 2 = 0)", B=BATCHES))
def apply_decisions(spark, sf_dir):
    b = batches_of(spark, sf_dir).withColumn("conversation_id", F.col("path"))
    d = b.select("batch", "conversation_id", ((F.col("place") % 3 == 0) & (F.col("batch") % 2 == 0)).alias("keep"))
    return state.apply_decisions(b, d).select("path", "batch")


# --- duplicates --------------------------------------------------------------


def sides(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", t.normalize_text(F.col("text")).alias("norm"))
    return tuple(d.where((F.col("doc_id") % 2 == k) & (F.col("norm") != "")).select(F.col("doc_id").alias("rep"), "norm") for k in (0, 1))


@query("""WITH N AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents), R AS (SELECT doc_id % 2 AS side, norm, min(doc_id) AS id FROM N WHERE norm <> '' GROUP BY ALL),
    W AS (SELECT DISTINCT side, id, unnest(string_split(norm, ' ')) AS word FROM R), S AS (SELECT side, id, count(*) AS n FROM W GROUP BY ALL),
    P AS (SELECT a.id AS l, b.id AS r, count(*) AS c FROM W a JOIN W b ON a.word = b.word AND a.side = 0 AND b.side = 1 GROUP BY ALL)
    SELECT l AS left_id, r AS right_id, round(c::DOUBLE / (x.n + y.n - c), 6) AS jaccard FROM P JOIN S x ON x.side = 0 AND x.id = l JOIN S y ON y.side = 1 AND y.id = r WHERE c::DOUBLE / (x.n + y.n - c) >= 0.492::DOUBLE""")
def jaccard_join(spark, sf_dir):
    return similarity.jaccard_join(*sides(spark, sf_dir), 0.492, distinct=True).withColumn("jaccard", F.round("jaccard", 6))


def turn_card_texts(spark, sf_dir):
    """Every second document is a turn, with its text in the prompt, the answer or both; the others are cards likewise."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", t.normalize_text(F.col("text")).alias("norm"))
    shown = lambda when, name, other: F.when(F.expr(when), F.col("norm")).otherwise(F.concat(F.lit(other), "source") if other else "").alias(name)
    t_, c = (d.where(F.col("doc_id") % 2 == k) for k in (0, 1))
    return t_.select(F.col("doc_id").alias("turn_id"), shown("doc_id % 3 != 0", "prompt", "question "), shown("doc_id % 3 != 1", "answer", "answer "), F.col("n_chars").alias("score")), c.select(F.col("doc_id").alias("card_id"), shown("doc_id % 5 < 3", "front", ""), shown("doc_id % 5 > 1", "back", ""))


def turn_card_vectors(spark, sf_dir):
    """Vectors of turns and cards are those of the same number."""
    e = fx.table(spark, sf_dir, "embeddings")
    return tuple(e.where(F.col("vec_id") % 2 == k).select(F.col("vec_id").alias(key), "embedding") for k, key in enumerate(("turn_id", "card_id")))


def turn_card_sides(spark, sf_dir):
    """Both, joined."""
    return tuple(x.join(e, key, "left") for x, e, key in zip(turn_card_texts(spark, sf_dir), turn_card_vectors(spark, sf_dir), ("turn_id", "card_id"), strict=True))


LEXICAL = """WITH N AS (SELECT doc_id, source, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents), V AS (
    SELECT 'front' AS side, 0 AS card, doc_id, CASE WHEN doc_id % 3 <> 0 THEN norm ELSE 'question ' || source END AS norm FROM N WHERE doc_id % 2 = 0 UNION ALL SELECT 'front', 1, doc_id, CASE WHEN doc_id % 5 < 3 THEN norm ELSE '' END FROM N WHERE doc_id % 2 = 1 UNION ALL
    SELECT 'back', 0, doc_id, CASE WHEN doc_id % 3 <> 1 THEN norm ELSE 'answer ' || source END FROM N WHERE doc_id % 2 = 0 UNION ALL SELECT 'back', 1, doc_id, CASE WHEN doc_id % 5 > 1 THEN norm ELSE '' END FROM N WHERE doc_id % 2 = 1),
    R AS (SELECT side, card, norm, min(doc_id) AS id FROM V WHERE norm <> '' GROUP BY ALL), W AS (SELECT DISTINCT side, card, id, unnest(string_split(norm, ' ')) AS word FROM R), S AS (SELECT side, card, id, count(*) AS n FROM W GROUP BY ALL),
    P AS (SELECT a.side, a.id AS l, b.id AS r, count(*) AS c FROM W a JOIN W b ON a.side = b.side AND a.word = b.word AND a.card = 0 AND b.card = 1 GROUP BY ALL)
    SELECT P.side, l AS turn_id, r AS card_id, round(c::DOUBLE / (x.n + y.n - c), 6) AS score FROM P JOIN S x ON x.side = P.side AND x.card = 0 AND x.id = l JOIN S y ON y.side = P.side AND y.card = 1 AND y.id = r WHERE c::DOUBLE / (x.n + y.n - c) >= 0.492::DOUBLE"""


@query(LEXICAL)
def lexical_join(spark, sf_dir):
    """The word gate on both sides: prompts against fronts, answers against backs."""
    return similarity.lexical_join(*turn_card_texts(spark, sf_dir), 0.492).withColumn("score", F.round("score", 6))


@query()
def string_dedup(spark, sf_dir):
    return similarity.lexical_join(*turn_card_texts(spark, sf_dir), 0.492, 0.82).withColumn("score", F.round("score", 6))


@query()
def lexical_dedup(spark, sf_dir):
    return similarity.lexical_duplicates(*turn_card_texts(spark, sf_dir), 0.82)


def vectors(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")


KNN = """SELECT q AS query_id, r AS rank, c AS card_id, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS r FROM (SELECT a.vec_id AS q, b.vec_id AS c, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
    FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)) WHERE r <= {k}"""


@query(f"SELECT query_id, rank, card_id, round(score, 4) AS score FROM ({KNN.format(k=3)})")
def knn_topk(spark, sf_dir):
    return similarity.top_matches(*vectors(spark, sf_dir), 3).withColumn("score", F.round("score", 4))


@query(f"SELECT query_id, card_id, round(score, 4) AS score, score >= 0.3::DOUBLE AS is_duplicate FROM ({KNN.format(k=1)})")
def semantic_dedup(spark, sf_dir):
    return similarity.semantic_duplicates(*vectors(spark, sf_dir), 0.3).withColumn("score", F.round("score", 4))


@query()
def approximate_topk(spark, sf_dir):
    """By hash tables: tests hold its recall against knn_topk and its scores against the vectors."""
    return vector_search.approximate_matches(*vectors(spark, sf_dir), 3).withColumn("score", F.round("score", 4))


@query(f"SELECT query_id, card_id, round(score, 4) AS score FROM ({KNN.format(k=1)}) WHERE score >= 0.35::DOUBLE")
def near_vectors(spark, sf_dir):
    """Only the queries with a card within the angle; blocks beyond it are not asked."""
    return vector_search.near_matches(*vectors(spark, sf_dir), 0.35).withColumn("score", F.round("score", 4))


WORD_VECTORS = {
    "V0": "SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM documents",
    "V1": "SELECT doc_id, ('0x' || substring(md5(word), 1, 8))::BIGINT AS h FROM V0 WHERE word <> ''",
    "V2": "SELECT doc_id, h // 2 % 64 AS i, sum(1 - 2 * (h % 2))::DOUBLE AS x FROM V1 GROUP BY ALL",
    "V3": "SELECT doc_id, sum(x * x) AS n FROM V2 GROUP BY doc_id HAVING sum(x * x) > 0",
    "V4": "SELECT V2.doc_id, i, x, n FROM V2 JOIN V3 USING (doc_id)",
    "V5": "SELECT a.doc_id AS q, b.doc_id AS c, round(sum(a.x * b.x) / sqrt(any_value(a.n) * any_value(b.n)), 12) AS s FROM V4 a JOIN V4 b ON a.i = b.i AND a.doc_id % 2 = 0 AND b.doc_id % 2 = 1 GROUP BY ALL",
    "V6": "SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS r FROM V5",
}


@query(sql("SELECT d.doc_id AS query_id, c AS card_id, round(s, 4) AS score, coalesce(s >= 0.95::DOUBLE, false) AS is_duplicate FROM documents d LEFT JOIN V6 ON V6.q = d.doc_id AND r = 1 WHERE d.doc_id % 2 = 0", **WORD_VECTORS))
def text_semantic_dedup(spark, sf_dir):
    """Vectors from the texts themselves, by a model that hashes words."""
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = vector_search.text_matches(d.where("id % 2 = 0"), d.where("id % 2 = 1"), 0.95, vector_search.hashed_words(64))
    return found.withColumn("score", F.round("score", 4))


@query()
def hybrid_dedup(spark, sf_dir):
    return similarity.duplicate_turns(*turn_card_texts(spark, sf_dir), "hybrid", 0.82, 0.3, turn_card_vectors(spark, sf_dir))


@query()
def prune_turns(spark, sf_dir):
    return similarity.prune_turns(*turn_card_texts(spark, sf_dir), "hybrid", 0.82, 0.3, turn_card_vectors(spark, sf_dir)).select("turn_id", "score")


@query(f"""SELECT t.doc_id AS turn_id, t.n_chars AS score FROM documents t LEFT JOIN ({KNN.format(k=1).replace("embeddings", "(SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))")}) k ON k.query_id = t.doc_id WHERE t.doc_id % 2 = 0 AND coalesce(k.score < 0.3::DOUBLE, true)""")
def prune_turns_semantic(spark, sf_dir):
    return similarity.prune_turns(*turn_card_sides(spark, sf_dir), "semantic", vector_threshold=0.3).select("turn_id", "score")


@query(f"""SELECT query_id % 25 AS conversation_id, count(*) AS turn_count, coalesce(string_agg(query_id::VARCHAR, ',' ORDER BY query_id) FILTER (score >= 0.3::DOUBLE), '') AS duplicate_turns,
    coalesce(string_agg(query_id::VARCHAR, ',' ORDER BY query_id) FILTER (score < 0.3::DOUBLE), '') AS non_duplicate_turns, bool_and(score >= 0.3::DOUBLE) AS dropped FROM ({KNN.format(k=1)}) GROUP BY 1""")
def prune_conversations(spark, sf_dir):
    d = similarity.semantic_duplicates(*vectors(spark, sf_dir), 0.3)
    return similarity.prune_conversations(d.select((F.col("query_id") % 25).alias("conversation_id"), F.col("query_id").alias("turn_index"), "is_duplicate"))


@query(f"""SELECT a.vec_id AS note_id, coalesce(score >= 0.3::DOUBLE, false) AS is_likely_duplicate, coalesce(round(score, 4), 0) AS similarity_score, b.source AS deck, substring(b.text, 1, 200) AS front
    FROM embeddings a LEFT JOIN ({KNN.format(k=1)}) k ON a.vec_id = k.query_id LEFT JOIN documents b ON b.doc_id = k.card_id WHERE a.vec_id % 2 = 0""")
def flag_duplicates(spark, sf_dir):
    q, c = vectors(spark, sf_dir)
    existing = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.col("source").alias("deck"), F.col("text").alias("front"), F.col("lang").alias("back"))
    flagged = similarity.flag_duplicates(q.select(F.col("vec_id").alias("note_id")), similarity.top_matches(q, c, 1), existing, 0.3)
    f = F.col("duplicate_flags")
    return flagged.select("note_id", f["is_likely_duplicate"].alias("is_likely_duplicate"), f["similarity_score"].alias("similarity_score"), f["matched_card"]["deck"].alias("deck"), f["matched_card"]["front"].alias("front"))


# --- progress ----------------------------------------------------------------

AS_OF = "2024-05-15"
WEEKS = {
    "SPINE": f"SELECT date_trunc('week', DATE '{AS_OF}')::DATE - (7 * i)::INT AS week FROM range(12) r(i)",
    "FW": "SELECT date_trunc('week', substring(f.path, 1, 10)::DATE)::DATE AS week, count(*) AS total, count(p.path) AS processed FROM FILES f LEFT JOIN PROCESSED p ON f.path = p.path GROUP BY 1",
    "PW": "SELECT date_trunc('week', processed_at)::DATE AS week, sum(cards_generated)::BIGINT AS cards FROM PROCESSED GROUP BY 1",
    "RW": "SELECT date_trunc('week', ts)::DATE AS week, count(*) AS cards FROM events WHERE event_type = 'signup' GROUP BY 1",
    "WEEKLY": """SELECT s.week, CASE WHEN month(s.week) = month(s.week + 6) THEN strftime(s.week, '%b %d') || ' - ' || day(s.week + 6)::VARCHAR WHEN year(s.week) = year(s.week + 6) THEN strftime(s.week, '%b %d') || ' - ' || strftime(s.week + 6, '%b %d')
        ELSE strftime(s.week, '%b %d, %Y') || ' - ' || strftime(s.week + 6, '%b %d, %Y') END AS label, coalesce(total, 0) AS total, coalesce(processed, 0) AS processed, coalesce(total, 0) - coalesce(processed, 0) AS remaining,
        coalesce(PW.cards, 0) + coalesce(RW.cards, 0) AS cards FROM SPINE s LEFT JOIN FW ON FW.week = s.week LEFT JOIN PW ON PW.week = s.week LEFT JOIN RW ON RW.week = s.week""",
    "RANKED": "SELECT *, row_number() OVER (ORDER BY week DESC) AS i FROM WEEKLY",
    "ISLES": "SELECT i - row_number() OVER (ORDER BY i) AS k, i FROM RANKED WHERE processed > 0",
    "RUNS": "SELECT k, count(*) AS n, min(i) AS from_i FROM ISLES GROUP BY k",
    "STREAKS": "SELECT coalesce(max(CASE WHEN from_i = 1 THEN n END), 0) AS current_streak, coalesce(max(n), 0) AS longest_streak, coalesce(sum(n), 0)::BIGINT AS active_weeks FROM RUNS",
}


def weekly_of(spark, sf_dir):
    f = state.dated_files(fx.files(spark, sf_dir))
    runs = fx.table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("ts").cast("date").alias("day"), F.lit(1).alias("cards"))
    return progress.weekly_progress(f, fx.processed(spark, sf_dir), runs, AS_OF)


@query(sql("SELECT strftime(week, '%Y-%m-%d') AS week, label, total, processed, remaining, cards FROM WEEKLY", "PROCESSED", **WEEKS))
def weekly_progress(spark, sf_dir):
    return weekly_of(spark, sf_dir)


@query(sql("SELECT * FROM STREAKS", "PROCESSED", **WEEKS))
def streaks(spark, sf_dir):
    return progress.streaks(weekly_of(spark, sf_dir))


@query(sql("""SELECT (SELECT count(*) FROM FILES) AS total, (SELECT count(*) FROM PROCESSED) AS processed, (SELECT min(substring(path, 1, 10)) FROM FILES) AS first_day, (SELECT max(substring(path, 1, 10)) FROM FILES) AS last_day,
    (SELECT coalesce(sum(cards_generated), 0)::BIGINT FROM PROCESSED) AS cards, s.*, round(100.0::DOUBLE * (SELECT count(*) FROM PROCESSED) / (SELECT count(*) FROM FILES), 6) AS pct FROM STREAKS s""", "PROCESSED", **WEEKS))
def progress_summary(spark, sf_dir):
    return progress.progress_summary(state.dated_files(fx.files(spark, sf_dir)), fx.processed(spark, sf_dir), weekly_of(spark, sf_dir))


@query("""WITH B AS (SELECT 'run-' || strftime(ts, '%Y%m%d') AS run_id, event_type <> 'error' AS ok, event_id % 5 AS cards, event_id % 3 AS kept, 3 AS seen, event_id % 2 AS flagged, event_id % 4 AS skipped FROM events)
    SELECT run_id, count(*) FILTER (ok) AS success_batches, count(*) FILTER (NOT ok) AS failed_batches, sum(cards)::BIGINT AS cards, sum(kept)::BIGINT AS kept, sum(seen)::BIGINT AS seen, sum(flagged)::BIGINT AS flagged, sum(skipped)::BIGINT AS skipped FROM B GROUP BY run_id""")
def run_stats(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    n = lambda k: (F.col("event_id") % k)
    return progress.run_stats(e.select(F.concat(F.lit("run-"), F.date_format("ts", "yyyyMMdd")).alias("run_id"), (F.col("event_type") != "error").alias("ok"), n(5).alias("cards"), n(3).alias("kept"), F.lit(3).alias("seen"), n(2).alias("flagged"), n(4).alias("skipped")))


THROUGHPUT = """WITH D AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1), S AS (SELECT h, sum(n) OVER (ORDER BY h)::BIGINT AS done, 2 * (SELECT count(*) FROM events) AS total FROM D),
    A AS (SELECT 'overall' AS scope, * FROM S UNION ALL SELECT 'recent', * FROM (SELECT * FROM S ORDER BY h DESC LIMIT 10)),
    G AS (SELECT scope, max(done) - min(done) AS progress, date_diff('second', min(h), max(h)) / 3600.0::DOUBLE AS hours, max(total) - max(done) AS remaining FROM A GROUP BY scope)
    SELECT scope, progress, round(progress / hours, 6) AS per_hour, round(progress / hours / 60, 6) AS per_minute, remaining, round(remaining / (progress / hours), 6) AS hours_left FROM G WHERE progress > 0 AND hours > 0"""


@query(THROUGHPUT)
def throughput_eta(spark, sf_dir):
    """Snapshots are read from log lines, as a batch run writes them."""
    e = fx.table(spark, sf_dir, "events")
    by_hour = e.groupBy(F.date_trunc("hour", "ts").alias("at")).agg(F.count("*").alias("n"))
    total = e.agg((2 * F.count("*")).alias("total"))
    s = by_hour.withColumn("done", F.sum("n").over(Window.orderBy("at"))).crossJoin(total)  # one row an hour, and a single row
    log = s.select(F.format_string("[%s] progress %d/%d", F.date_format("at", "yyyy-MM-dd HH:mm:ss"), "done", "total").alias("line"))
    part = lambda i: F.regexp_extract("line", r"^\[([^\]]+)\] progress (\d+)/(\d+)$", i)
    return progress.throughput(log.select(F.to_timestamp(part(1)).alias("at"), part(2).cast("long").alias("done"), part(3).cast("long").alias("total")))


TIMED = "SELECT *, CASE WHEN substring(run_id, 12, 1) <> '2' THEN made_at END AS card_at FROM CARDS"
RUN_TIMES = sql("SELECT run_id, min(card_at) AS first_at, max(card_at) AS last_at, trunc(quantile_cont(epoch_us(card_at), 0.5))::BIGINT AS median_micros, count(card_at) AS n_timed, count(*) AS n_cards FROM TIMED GROUP BY run_id", "CARDS", TIMED=TIMED)


def timed_cards(spark, sf_dir):
    """The cards of some runs have no time."""
    return fx.cards(spark, sf_dir).withColumn("at", F.when(F.substring("run_id", 12, 1) != "2", F.col("at")))


@query(f"SELECT run_id, strftime(date_trunc('second', first_at), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(date_trunc('second', last_at), '%Y-%m-%d %H:%M:%S') AS last_at, median_micros, n_timed, n_cards FROM ({RUN_TIMES})")
def run_time_stats(spark, sf_dir):
    return progress.run_time_stats(timed_cards(spark, sf_dir))


@query(f"SELECT run_id, coalesce(median_micros, epoch_us(strptime(substring(run_id, 5), '%Y%m%d-%H%M%S'))) AS sort_micros FROM ({RUN_TIMES}) ORDER BY 2 DESC, 1 LIMIT 20")
def run_order(spark, sf_dir):
    return progress.run_order(progress.run_time_stats(timed_cards(spark, sf_dir)), 20).select("run_id", "sort_micros")


# --- review ------------------------------------------------------------------


@query(sql("SELECT count(*) AS total, count(action) AS reviewed, count(*) FILTER (action = 'accept') AS n_accept, count(*) FILTER (action = 'reject') AS n_reject, count(*) FILTER (action = 'edit') AS n_edit, count(*) FILTER (action = 'skip') AS n_skip, count(*) - count(action) AS remaining, round(100.0::DOUBLE * count(action) / count(*), 6) AS pct FROM CARDS LEFT JOIN DECISIONS USING (card_id)", "DECISIONS"))
def review_stats(spark, sf_dir):
    return review.review_stats(fx.cards(spark, sf_dir), fx.decisions(spark, sf_dir))


@query(sql("SELECT r.run_id, coalesce(c.n, 0) AS n_cards, coalesce(d.n, 0) AS n_decisions, r.has_list AND (coalesce(c.n, 0) = 0 OR coalesce(d.n, 0) >= coalesce(c.n, 0)) AS complete, r.has_list AND coalesce(c.n, 0) = 0 AS empty FROM R r LEFT JOIN C c USING (run_id) LEFT JOIN D d USING (run_id)", "DECISIONS",
    R="SELECT DISTINCT run_id, substring(run_id, 12, 1) <> '3' AS has_list FROM CARDS UNION ALL SELECT 'run-20200101-000000', true", C="SELECT run_id, count(*) AS n FROM CARDS GROUP BY 1", D="SELECT run_id, count(*) AS n FROM DECISIONS GROUP BY 1"))
def run_status(spark, sf_dir):
    c = fx.cards(spark, sf_dir)
    runs = c.select("run_id", (F.substring("run_id", 12, 1) != "3").alias("has_list")).distinct().unionByName(spark.createDataFrame([("run-20200101-000000", True)], "run_id string, has_list boolean"))
    return review.run_status(runs, c, fx.decisions(spark, sf_dir))


@query(sql("SELECT card_id, 'accept' AS action FROM CARDS WHERE confidence >= 0.9::DOUBLE AND card_id NOT IN (SELECT card_id FROM DECISIONS)", "DECISIONS"))
def bulk_accept(spark, sf_dir):
    return review.bulk_accept(fx.cards(spark, sf_dir), fx.decisions(spark, sf_dir))


@query(sql("SELECT c.card_id, d.action, coalesce(d.edited_front, c.front) AS front, c.deck FROM CARDS c JOIN DECISIONS d USING (card_id) WHERE d.action IN ('accept', 'edit')", "DECISIONS"))
def export_accepted(spark, sf_dir):
    return review.export_accepted(fx.cards(spark, sf_dir), fx.decisions(spark, sf_dir))


@query(sql("SELECT c.card_id, c.deck, c.confidence, d.action, d.reason, strftime(date_trunc('second', d.decided_at), '%Y-%m-%d %H:%M:%S') AS decided_at FROM CARDS c JOIN DECISIONS d USING (card_id)", "DECISIONS"))
def export_feedback(spark, sf_dir):
    return review.export_feedback(fx.cards(spark, sf_dir), fx.decisions(spark, sf_dir))


@query(sql("SELECT card_id, action FROM DECISIONS WHERE action IN ('accept', 'edit') AND coalesce(import_status, 'pending') NOT IN ('imported', 'duplicate', 'imported_or_duplicate')", "DECISIONS"))
def pending_import(spark, sf_dir):
    return review.pending_import(fx.decisions(spark, sf_dir))


@query("SELECT user_id AS card_id, strftime(date_trunc('second', max(ts)), '%Y-%m-%d %H:%M:%S') AS decided_at, arg_max(event_type, ts) AS action FROM events GROUP BY user_id")
def latest_decision(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("card_id"), F.col("event_type").alias("action"), F.col("ts").alias("decided_at"))
    return state.latest_per_key(e, "card_id", "decided_at")


@query(sql("SELECT deck, floor(confidence * 10)::BIGINT AS band, count(*) AS n, round(count(*) FILTER (action IN ('accept', 'edit'))::DOUBLE / count(*), 6) AS acceptance_rate, round(count(*) FILTER (action = 'edit')::DOUBLE / count(*), 6) AS edit_rate, round(count(*) FILTER (is_likely_duplicate AND action = 'reject')::DOUBLE / nullif(count(*) FILTER (is_likely_duplicate), 0), 6) AS duplicate_precision FROM CARDS JOIN DECISIONS USING (card_id) GROUP BY 1, 2", "DECISIONS"))
def acceptance_rate(spark, sf_dir):
    return review.acceptance_rate(fx.cards(spark, sf_dir), fx.decisions(spark, sf_dir))


@query("SELECT count(*) FILTER (event_id % 3 <> 0) AS imported, count(*) FILTER (event_id % 3 = 0) AS duplicates, 0::BIGINT AS failed FROM events")
def import_counts(spark, sf_dir):
    return review.import_counts(fx.table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("note_id")))


# --- payloads and responses --------------------------------------------------


def payload_parts(spark, sf_dir):
    x = features.turn_signals(turns_of(spark, sf_dir))
    topics = features.key_topics(features.with_key_terms(x, ["path", "turn_index"]), ["path"]).withColumnRenamed("terms", "key_topics")
    c = batches_of(spark, sf_dir).join(topics, "path", "left").select(F.col("path").alias("conversation_id"), "batch", F.col("path").alias("title"), F.concat(F.lit("https://chat.example/"), "path").alias("url"), "key_topics", "aggregate_score", "turn_count", "question_turns")
    return c, x.withColumn("conversation_id", F.col("path")).withColumn("context_id", F.sha2("path", 256))


PAYLOAD = {
    "K3": "SELECT path, list(word ORDER BY rank) AS key_topics FROM K2 WHERE rank <= 8 GROUP BY path",
    "B": BATCHES,
    "P": "SELECT path, turn_index, CASE WHEN length(prompt) > 4000 THEN substring(prompt, 1, 2800) || chr(10) || chr(10) || '[TRUNCATED: ' || format('{:,}', length(prompt) - 3600) || ' characters removed]' || chr(10) || chr(10) || right(prompt, 800) ELSE prompt END AS prompt, answer, user_ts, score, question_like, bullet_count FROM SIG",
    "F1": "SELECT path, list({'turn_index': turn_index, 'user_prompt': prompt, 'assistant_response': answer} ORDER BY turn_index) AS turns FROM P GROUP BY path",
    "F2": "SELECT batch, list({'conversation_id': path, 'source_title': path, 'key_topics': key_topics, 'turn_count': len(turns), 'turns': turns} ORDER BY path) AS candidate_conversations FROM B JOIN F1 USING (path) JOIN K3 USING (path) GROUP BY batch",
    "G1": "SELECT path, list({'turn_index': turn_index, 'context_id': sha256(path), 'user_timestamp': user_ts, 'user_prompt': prompt, 'assistant_answer': answer, 'score': round(score, 3), 'signals': {'question_like': question_like, 'bullet_count': bullet_count}} ORDER BY turn_index) AS turns FROM P GROUP BY path",
    "G2": f"SELECT batch, list({{'conversation_id': path, 'source_title': path, 'source_url': 'https://chat.example/' || path, 'key_topics': key_topics, 'aggregate_score': round(c.aggregate_score, 3), 'aggregate_signals': {{'turn_count': c.turn_count, 'question_turns': c.question_turns}}, 'turns': turns}} ORDER BY path) AS candidate_conversations FROM B JOIN G1 USING (path) JOIN K3 USING (path) JOIN ({CONVS}) c USING (path) GROUP BY batch",
}


@query(sql("SELECT batch, 'Decide which conversations to keep.' || chr(10) || chr(10) || to_json({'candidate_conversations': candidate_conversations}) AS payload FROM F2", "SIG", "TERMS", **TOPICS, **PAYLOAD))
def filter_payload(spark, sf_dir):
    return payloads.filter_payload(*payload_parts(spark, sf_dir), "Decide which conversations to keep.")


@query(sql("SELECT batch, 'Write cards for these decks:' || chr(10) || '- A $deck' || chr(10) || '- B {x}' || chr(10) || chr(10) || to_json({'available_decks': ['A $deck', 'B {x}'], 'candidate_conversations': candidate_conversations}) AS payload FROM G2", "SIG", "TERMS", **TOPICS, **PAYLOAD))
def generate_payload(spark, sf_dir):
    return payloads.generate_payload(*payload_parts(spark, sf_dir), "Write cards for these decks:\n{decks}", ["A $deck", "B {x}"], ["question_like", "bullet_count"], ["turn_count", "question_turns"])


def responses_of(spark, sf_dir):
    d = F.concat(F.lit('{"cards": [{"conversation_id": "c'), F.col("user_id").cast("string"), F.lit('", "turn_index": 1, "deck": "d", "front": "f", "back": "b", "tags": ["x"], "confidence": 0.5, "extra": 1}, {"front": "second", "depends_on": ["x", "y"]}], "skipped_conversations": [{"conversation_id": "k", "reason": "thin"}], "skipped_turns": [{"conversation_id": "k", "turn_index": 2, "reason": "chat"}], "learning_insights": [{"conversation_id": "k", "insight": "i", "misconceptions_corrected": ["m", "n"]}]}'))
    kinds = F.expr("CASE event_id % 5 WHEN 0 THEN j WHEN 1 THEN concat('```json\\n', j, '\\n```') WHEN 2 THEN concat('Here you are: ', j, ' done') WHEN 3 THEN replace(j, '\"f\"', '\"\\\\\\\\alpha\"') ELSE 'no json' END")
    return fx.table(spark, sf_dir, "events").withColumn("j", d).select("event_id", "user_id", kinds.alias("response"))


@query(r"""SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN '{"cards": [{"conversation_id": "c' || user_id::VARCHAR || '", "turn_index": 1, "deck": "d", "front": ' || CASE WHEN event_id % 5 = 3 THEN '"\\alpha"' ELSE '"f"' END
    || ', "back": "b", "tags": ["x"], "confidence": 0.5, "extra": 1}, {"front": "second", "depends_on": ["x", "y"]}], "skipped_conversations": [{"conversation_id": "k", "reason": "thin"}], "skipped_turns": [{"conversation_id": "k", "turn_index": 2, "reason": "chat"}], "learning_insights": [{"conversation_id": "k", "insight": "i", "misconceptions_corrected": ["m", "n"]}]}' END AS parsed FROM events""")
def parse_responses(spark, sf_dir):
    return payloads.parse_responses(responses_of(spark, sf_dir)).select("event_id", "parsed")


@query("SELECT event_id, i AS card_index, CASE WHEN i = 0 THEN 'c' || user_id::VARCHAR END AS conversation_id, CASE WHEN i = 1 THEN 'second' WHEN event_id % 5 = 3 THEN chr(92) || 'alpha' ELSE 'f' END AS front, CASE WHEN i = 0 THEN 0.5::DOUBLE END AS confidence, CASE WHEN i = 0 THEN '1' END AS extra, CASE WHEN i = 1 THEN 'x,y' END AS depends_on FROM events, range(2) r(i) WHERE event_id % 5 <> 4")
def explode_cards(spark, sf_dir):
    c = payloads.explode_cards(payloads.parse_responses(responses_of(spark, sf_dir)), ["event_id"])
    return c.select("event_id", "card_index", "conversation_id", "front", "confidence", F.get_json_object("raw", "$.extra").alias("extra"), "depends_on")


@query("SELECT event_id, kind, 'k' AS conversation_id, CASE WHEN kind = 'turn' THEN 2 END::BIGINT AS turn_index, CASE WHEN kind = 'turn' THEN 'chat' ELSE 'thin' END AS reason FROM events, (VALUES ('turn'), ('conversation')) v(kind) WHERE event_id % 5 <> 4")
def explode_skips(spark, sf_dir):
    return payloads.explode_skips(payloads.parse_responses(responses_of(spark, sf_dir)), ["event_id"])


@query("SELECT event_id, 'k' AS conversation_id, 'i' AS insight, 'm,n' AS misconceptions_corrected FROM events WHERE event_id % 5 <> 4")
def explode_insights(spark, sf_dir):
    return payloads.explode_insights(payloads.parse_responses(responses_of(spark, sf_dir)), ["event_id"])


# --- streaming ---------------------------------------------------------------


@query(sql("SELECT * FROM TURNS", "TURNS"))
def stream_harvest(spark, sf_dir):
    out = shared_path(spark)
    fx.entries(spark, sf_dir).write.parquet(f"{out}/source")
    return harvest.harvest(harvest.read_table(spark, f"{out}/source"), f"{out}/harvest")


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup_ids(spark, sf_dir):
    stream = harvest.read_table(spark, f"{sf_dir}/events.parquet")
    return harvest.drained(harvest.dedup_ids(stream, "user_id", "ts"), shared_path(spark))


@query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d %H:%M:%S') AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_weekly(spark, sf_dir):
    return harvest.latest(harvest.weekly_activity(harvest.read_table(spark, f"{sf_dir}/events.parquet")), shared_path(spark), ["week", "event_type"])


@query("""WITH L AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events), S AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM L)
    SELECT user_id, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM S GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    out = shared_path(spark)
    harvest.write_end(spark, f"{out}/end", "user_id", "ts", "2100-01-01")
    stream = harvest.read_table(spark, f"{sf_dir}/events.parquet").select("user_id", "ts").unionByName(harvest.read_table(spark, f"{out}/end"))
    return harvest.drained(harvest.sessions(stream), out).where("user_id is not null")
