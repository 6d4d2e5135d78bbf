"""Working views over the given tables, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decorated transcript entries: conv_id, pos, path, role, ts_raw, text."""
    c = table(spark, sf_dir, "conversations")
    s = F.col("conv_id") + F.col("turn")
    user = F.expr("CASE pmod(conv_id + turn, 5) WHEN 0 THEN concat('What ', text, '?') WHEN 1 THEN concat('Can you explain ', text) WHEN 2 THEN concat('Moving on, ', text) WHEN 3 THEN concat('Show me ', text) ELSE text END")
    reply = F.when(s % 4 == 0, F.concat("text", F.lit("\n- first point\n- second point"))).when(s % 4 == 1, F.concat(F.lit("This refers to "), "text", F.lit("\n### Details\n")))
    reply = reply.when(s % 4 == 2, F.concat("text", F.lit("\n```\nx = 1\n```"))).otherwise(F.concat(F.lit("Actually, "), "text"))
    two = lambda x: F.lpad((1 + x).cast("string"), 2, "0")
    path = F.concat(F.lit("2024-"), two(F.col("conv_id") % 4), F.lit("-"), two(F.col("conv_id") % 28), F.lit("_conv-"), F.col("conv_id").cast("string"), F.lit(".md"))
    at = F.expr("date_format(timestampadd(MINUTE, turn, timestampadd(HOUR, conv_id, timestamp'2024-01-01')), 'yyyy-MM-dd HH:mm:ss')")
    text = F.when((F.col("conv_id") % 11 == 5) & (F.col("turn") == 2), " ").when(F.col("role") == "user", user).when(F.col("role") == "assistant", reply).otherwise(F.col("text"))
    role = F.when((F.col("conv_id") % 7 == 3) & (F.col("turn") == 0), "assistant").otherwise(F.col("role"))
    return c.select("conv_id", F.col("turn").alias("pos"), path.alias("path"), role.alias("role"), at.alias("ts_raw"), text.alias("text"))


def long_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight conversations make one; every six entries share a theme."""
    e = entries(spark, sf_dir).withColumn("long_id", F.floor(F.col("conv_id") / 8))
    e = e.withColumn("at", F.row_number().over(Window.partitionBy("long_id").orderBy("conv_id", "pos")) - 1)
    x = F.expr("chr(97 + pmod(floor(at / 6), 26))")
    theme = F.repeat(F.concat(F.lit("theme"), x, F.lit(" focus"), x, F.lit(" ")), 12)
    return e.select(F.concat(F.lit("long-"), F.col("long_id").cast("string")).alias("path"), F.col("at").cast("long").alias("pos"), "role", "ts_raw", F.concat("text", F.lit(" "), theme).alias("text"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per conversation: path, conv_id, conversation_id, mtime, n_conversations."""
    g = entries(spark, sf_dir).groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.max("ts_raw").alias("mtime"))
    return g.select("path", "conv_id", F.sha2("path", 256).alias("conversation_id"), "mtime", (1 + F.col("conv_id") % 3).alias("n_conversations"))


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).where("conv_id % 3 = 0")
    return f.select("path", (F.col("conv_id") % 5).alias("cards_generated"), F.expr("date_add(to_date(substring(path, 1, 10)), 9)").alias("processed_at"))


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).where("conv_id % 4 = 1")
    return f.select(F.when(F.col("conv_id") % 8 == 1, F.concat("conversation_id", F.lit("_part2"))).otherwise(F.col("conversation_id")).alias("conversation_id"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed cards from events, a card per event that is no sign-up."""
    e = table(spark, sf_dir, "events").where("event_type != 'signup'")
    deck = F.concat(F.lit("deck"), (F.col("user_id") % 7).cast("string"))
    run = F.expr("concat('run-', date_format(ts, 'yyyyMMdd'), '-120000')")
    return e.select(
        F.col("event_id").alias("card_id"), "user_id", deck.alias("deck"), F.concat(F.lit("front "), "props").alias("front"), (F.pmod(F.col("event_id") * 37, F.lit(100)) / 100.0).alias("confidence"),
        (F.pmod(F.col("event_id") * 53, F.lit(100)) / 100.0).alias("similarity_score"), F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 3 == 0).alias("is_likely_duplicate"), run.alias("run_id"), F.col("ts").cast("timestamp").alias("at"), "event_type",
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on three cards in four."""
    c = cards(spark, sf_dir).where("card_id % 4 != 0")
    action = F.expr("CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'edit' ELSE 'skip' END")
    status = F.expr("CASE card_id % 5 WHEN 0 THEN 'imported' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'failed' END")
    edited = F.when(F.col("event_type") == "click", F.concat(F.lit("edited "), "front"))
    return c.select("card_id", "run_id", action.alias("action"), F.concat(F.lit("reason "), "event_type").alias("reason"), edited.alias("edited_front"), status.alias("import_status"), F.col("at").alias("decided_at"))


SQL = {
    "T": """SELECT conv_id, turn AS pos, '2024-' || lpad((1 + conv_id % 4)::VARCHAR, 2, '0') || '-' || lpad((1 + conv_id % 28)::VARCHAR, 2, '0') || '_conv-' || conv_id::VARCHAR || '.md' AS path,
        CASE WHEN conv_id % 7 = 3 AND turn = 0 THEN 'assistant' ELSE role END AS role,
        strftime(TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn), '%Y-%m-%d %H:%M:%S') AS ts_raw,
        CASE WHEN conv_id % 11 = 5 AND turn = 2 THEN ' '
             WHEN role = 'user' THEN CASE (conv_id + turn) % 5 WHEN 0 THEN 'What ' || text || '?' WHEN 1 THEN 'Can you explain ' || text WHEN 2 THEN 'Moving on, ' || text WHEN 3 THEN 'Show me ' || text ELSE text END
             WHEN role = 'assistant' THEN CASE (conv_id + turn) % 4 WHEN 0 THEN text || chr(10) || '- first point' || chr(10) || '- second point' WHEN 1 THEN 'This refers to ' || text || chr(10) || '### Details' || chr(10)
                  WHEN 2 THEN text || chr(10) || '```' || chr(10) || 'x = 1' || chr(10) || '```' ELSE 'Actually, ' || text END
             ELSE text END AS text FROM conversations""",
    "L0": "SELECT *, conv_id // 8 AS long_id, row_number() OVER (PARTITION BY conv_id // 8 ORDER BY conv_id, pos) - 1 AS nth FROM T",
    "TL": "SELECT 'long-' || long_id::VARCHAR AS path, nth AS pos, role, ts_raw, text || ' ' || repeat('theme' || chr((97 + (nth // 6) % 26)::INT) || ' focus' || chr((97 + (nth // 6) % 26)::INT) || ' ', 12) AS text FROM L0",
    "FILES": "SELECT path, min(conv_id) AS conv_id, sha256(path) AS conversation_id, max(ts_raw) AS mtime, 1 + min(conv_id) % 3 AS n_conversations FROM T GROUP BY path",
    "PROCESSED": "SELECT path, conv_id % 5 AS cards_generated, substring(path, 1, 10)::DATE + 9 AS processed_at FROM FILES WHERE conv_id % 3 = 0",
    "SEEN": "SELECT CASE WHEN conv_id % 8 = 1 THEN conversation_id || '_part2' ELSE conversation_id END AS conversation_id FROM FILES WHERE conv_id % 4 = 1",
    "CARDS": """SELECT event_id AS card_id, user_id, 'deck' || (user_id % 7)::VARCHAR AS deck, 'front ' || props AS front, (event_id * 37 % 100)::DOUBLE / 100 AS confidence, (event_id * 53 % 100)::DOUBLE / 100 AS similarity_score,
        CASE WHEN event_id % 13 <> 0 THEN event_id % 3 = 0 END AS is_likely_duplicate, 'run-' || strftime(ts, '%Y%m%d') || '-120000' AS run_id, ts AS made_at, event_type FROM events WHERE event_type <> 'signup'""",
    "DECISIONS": """SELECT card_id, run_id, CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'edit' ELSE 'skip' END AS action, 'reason ' || event_type AS reason,
        CASE WHEN event_type = 'click' THEN 'edited ' || front END AS edited_front, CASE card_id % 5 WHEN 0 THEN 'imported' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'failed' END AS import_status, made_at AS decided_at FROM CARDS WHERE card_id % 4 <> 0""",
}
NEEDS = {"L0": ["T"], "TL": ["T", "L0"], "FILES": ["T"], "PROCESSED": ["T", "FILES"], "SEEN": ["T", "FILES"], "DECISIONS": ["CARDS"]}


def _pairing(source: str, prefix: str) -> None:
    """Views of turns, their signals and their terms over an entry view."""
    p = prefix
    SQL[f"{p}K"] = f"SELECT path, pos, role, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS text, ts_raw FROM {source} WHERE role = 'user' OR (role = 'assistant' AND trim(text) <> '')"
    SQL[f"{p}G"] = f"SELECT *, CASE WHEN role = 'user' AND coalesce(lag(role) OVER (PARTITION BY path ORDER BY pos), '') <> 'user' THEN 1 ELSE 0 END AS opens FROM {p}K"
    SQL[f"{p}H"] = f"SELECT *, sum(opens) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM {p}G"
    SQL[f"{p}A"] = f"""SELECT path, grp, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (role = 'user' AND text <> ''), '') AS users,
        coalesce(string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (role = 'assistant'), '') AS replies, arg_max(ts_raw, pos) FILTER (role = 'assistant') AS assistant_ts,
        arg_min(ts_raw, pos) FILTER (role = 'user' AND text <> '') AS user_ts FROM {p}H GROUP BY path, grp"""
    SQL[f"{p}TURNS"] = f"""SELECT path, row_number() OVER (PARTITION BY path ORDER BY grp) - 1 AS turn_index, CASE WHEN grp = 0 THEN assistant_ts ELSE user_ts END AS user_ts,
        CASE WHEN grp = 0 THEN 'Assistant started conversation (no user prompt in export)' ELSE users END AS prompt, assistant_ts, replies AS answer FROM {p}A WHERE replies <> '' AND (users <> '' OR grp = 0)"""
    SQL[f"{p}S0"] = f"""SELECT *, (contains(prompt, '?') OR regexp_matches(lower(prompt), '^(what|why|how|when|where|who|which|explain|describe|define|list|compare|give|teach) ')) AS question_like,
        regexp_matches(lower(answer), 'stands for|is defined as|refers to|meaning:|means that|definition') AS definition_like,
        len(list_filter(string_split(answer, chr(10)), lambda l: regexp_matches(trim(l), '^(-|\\*|[123]\\.)')))::BIGINT AS bullet_count,
        ((length(answer) - length(replace(answer, '### ', ''))) // 4)::BIGINT AS heading_count, ((length(answer) - length(replace(answer, '```', ''))) // 3)::BIGINT AS code_blocks,
        length(answer)::BIGINT AS answer_length, regexp_matches(lower(prompt), 'walk me through|show me|give me|steps') AS imperative FROM {p}TURNS"""
    SQL[f"{p}SIG"] = f"""SELECT *, round(CASE WHEN question_like THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN definition_like THEN 0.45::DOUBLE ELSE 0 END
        + CASE WHEN bullet_count > 0 THEN least(0.35::DOUBLE + 0.03::DOUBLE * bullet_count, 0.65::DOUBLE) ELSE 0 END + CASE WHEN heading_count > 0 THEN least(0.25::DOUBLE + 0.05::DOUBLE * heading_count, 0.45::DOUBLE) ELSE 0 END
        + CASE WHEN code_blocks > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN answer_length BETWEEN 80 AND 2200 THEN 0.55::DOUBLE WHEN answer_length > 2200 THEN 0.2::DOUBLE ELSE 0 END
        + CASE WHEN imperative THEN 0.2::DOUBLE ELSE 0 END, 4) AS score FROM {p}S0"""
    stop = "'" + "','".join(STOPWORDS) + "'"
    SQL[f"{p}W0"] = f"SELECT path, turn_index, regexp_extract_all(lower(prompt || ' ' || answer), '[a-z][a-z0-9\\\\-]{{3,}}') AS l FROM {p}TURNS"
    SQL[f"{p}W1"] = f"SELECT path, turn_index, unnest(l) AS word, generate_subscripts(l, 1) AS p FROM {p}W0"
    SQL[f"{p}W2"] = f"SELECT path, turn_index, word, count(*) AS n, min(p) AS first FROM {p}W1 WHERE word NOT IN ({stop}) GROUP BY ALL"
    SQL[f"{p}W3"] = f"SELECT *, row_number() OVER (PARTITION BY path, turn_index ORDER BY n DESC, first) AS rank FROM {p}W2"
    SQL[f"{p}TERMS"] = f"SELECT path, turn_index, list(word ORDER BY rank) AS key_terms FROM {p}W3 WHERE rank <= 6 GROUP BY path, turn_index"
    chain = ["K", "G", "H", "A", "TURNS"]
    base = NEEDS.get(source, []) + [source]
    for i, name in enumerate(chain):
        NEEDS[f"{p}{name}"] = base + [p + c for c in chain[:i]]
    turns = base + [p + c for c in chain]
    NEEDS[f"{p}S0"], NEEDS[f"{p}SIG"] = turns, [*turns, f"{p}S0"]
    for i, name in enumerate(words := ["W0", "W1", "W2", "W3", "TERMS"]):
        NEEDS[f"{p}{name}"] = turns + [p + w for w in words[:i]]


_pairing("T", "")
_pairing("TL", "L_")


def sql(query: str, *views: str, **more: str) -> str:
    """query with the views it needs; more: views of its own, by name."""
    names = list(dict.fromkeys(n for v in views for n in [*NEEDS.get(v, []), v]))
    parts = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {query}" if parts else query
