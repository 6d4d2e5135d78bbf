"""The queries of this subpackage, by name, over the tables in sf_dir."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, jaccard, lm, packing, pii, quality, rules, runs, shards, sstable, trie
from .storage import table, written


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash").distinct()


def op2_column_generation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, seq_len=2048)


def op3_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.examples_digest(written(chat.expanded(chat.formatted_turns(rows))))


def op4_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read_shards(sstable.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, width=2))


def op5_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.minimax_shards(table(spark, sf_dir, "documents"), n_shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_co_training_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


def op7_adaptive_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op8_ivf_pq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op10_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(pii.find_spans(table(spark, sf_dir, "documents")))


def op11_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rules.quality_rules(table(spark, sf_dir, "documents"))
    return x.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op12_baier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = d.withColumns({"h": h, "w": F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))})
    d = d.withColumns({"n": F.size("w"), "g": F.floor(F.col("h") / 10)})
    d = d.withColumn("a", (F.col("g") % F.greatest("n", F.lit(1))).cast("int"))
    d = d.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.transform(F.sequence("a", F.col("n") - 1), lambda i: F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")))
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text"))
    return runs.run_digest(runs.periodic_runs(d.select("doc_id", text.alias("text"))))


def op13_splitter_skeleton_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = written(trie.conversation_paths(table(spark, sf_dir, "conversations")))
    bases = paths.where(F.col("conv_id") % 20 == 0).select("conv_id", F.substring("path", 1, 3 * trie.SIZE).alias("path"), F.slice("words", 1, 3).alias("words"))
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    x = paths.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 20, "h": own.cast("int")})
    return trie.prefix_trie(trie.headed(x, bases, "base", "h"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_template_decontamination, op2_column_generation_packing, op3_prefix_target_chat, op4_sstable_shards, op5_minimax_shards, op6_co_training_quality, op7_adaptive_jaccard, op8_ivf_pq_neighbours, op9_deleted_interpolation, op10_skip_chain_pii, op11_distribution_divergence, op12_baier_runs, op13_splitter_skeleton_trie)}


def _escaped_length(x: str) -> str:
    """SQL for the length of a text with a backslash in each control string and before each backslash."""
    marks = ["chr(92)", "'<|'", "'<s>'", "'</s>'", "'[INST]'", "'[/INST]'"]
    return f"(length({x}) + " + " + ".join(f"(length({x}) - length(replace({x}, {m}, ''))) // length({m})" for m in marks) + ")"


CHAT_SQL = f"""
WITH C AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
S AS (SELECT *, 8 + {_escaped_length("role")} + length(role) - length(replace(role, chr(10), '')) + 1 + {_escaped_length("text")} + 8 AS size FROM C),
R AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM S),
G AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(size)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples,
    coalesce(sum(upto - 8) FILTER (role = 'assistant'), 0)::BIGINT AS expanded_chars FROM R GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, n_examples, expanded_chars FROM G"""

JACCARD_SQL = """
WITH RECURSIVE W AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
S AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM W),
N AS (SELECT doc_id, count(*) AS n FROM S GROUP BY doc_id),
P AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM S x JOIN S y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
L AS (SELECT a, b FROM P JOIN N x ON x.doc_id = a JOIN N y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
R(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT R.x, L.b FROM R JOIN L ON R.y = L.a)
SELECT d.doc_id, coalesce(N.n, 0) AS n_shingles, k.component_id FROM documents d LEFT JOIN N ON N.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM R GROUP BY x) k ON k.x = d.doc_id"""


#: crc32 four bits at a time: the remainders of the 16 values of half a byte.
_HALVES = [reduce(lambda c, _: c >> 1 ^ 0xEDB88320 * (c & 1), range(4), i) for i in range(16)]


def _crc32(x: str) -> str:
    """SQL for the unsigned crc32 of an ASCII text."""
    halves = f"flatten(list_transform(string_split({x}, ''), lambda s: [ascii(s) & 15, ascii(s) >> 4]))"
    return f"xor(list_reduce({halves}, lambda c, b: xor(c >> 4, {_HALVES}[(xor(c, b) & 15) + 1]), 4294967295::BIGINT), 4294967295)"


TRIE_SQL = f"""
WITH O AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
H AS (SELECT *, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM O),
R AS (SELECT H.conv_id, list_concat(coalesce(b.t[1:H.h], []), H.t[H.h + 1:]) AS t FROM H LEFT JOIN O b ON b.conv_id = H.conv_id - H.conv_id % 20),
P AS (SELECT conv_id, len(t) AS n, unnest(range(len(t) + 1)) AS depth, t FROM R),
N AS (SELECT t[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM P GROUP BY ALL),
C AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM N WHERE depth > 0 GROUP BY ALL),
X AS (SELECT N.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN N.depth = 0 THEN 0 ELSE len(regexp_extract_all(N.p[N.depth].text, '[^\\x20\\x09-\\x0D]+')) END AS own FROM N LEFT JOIN C ON C.p = N.p AND C.depth = N.depth),
U AS (SELECT p, n_children, own, unnest(range(depth + 1)) AS up FROM X),
S AS (SELECT p[1:up] AS p, up AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM U GROUP BY ALL)
SELECT X.conv_id, X.depth, a.conv_id AS parent_conv_id, X.n_convs, X.n_children, S.n_leaves, S.saved_tokens, X.ends_sha256
FROM X JOIN S ON S.p = X.p AND S.depth = X.depth LEFT JOIN X a ON X.depth > 0 AND a.p = X.p[1:X.depth - 1] AND a.depth = X.depth - 1"""


def _distance(p: str, q: str) -> str:
    """SQL for the Jensen-Shannon distance of two lists of shares."""
    term = lambda x, y: f"CASE WHEN {x}[i] > 0 THEN {x}[i] * log2(2 * {x}[i] / ({x}[i] + {y}[i])) ELSE 0 END"
    bits = f"list_sum(list_transform(range(1, len({p}) + 1), lambda i: {term(p, q)} + {term(q, p)}))"
    return f"CASE WHEN {p} IS NOT NULL AND {q} IS NOT NULL THEN sqrt(greatest(0.0::DOUBLE, {bits} / 2)) END"


def _reference_sql(rows: str) -> str:
    means = ", ".join(f"[{', '.join(f'avg({c}[{i}])' for i in range(1, n + 1))}] AS {c}_mean" for c, n in (("p_classes", len(rules.CLASSES)), ("p_common", rules.COMMON + 1)))
    return f"(SELECT lang, {means} FROM {rows} WHERE {_LONG} GROUP BY lang)"


def _distances_sql(rows: str, means: str) -> str:
    nearest = f"list_min(list_transform((SELECT list(p_classes_mean) FROM {means}), lambda q: {_distance('p_classes', 'q')}))"
    return f"""(SELECT x.*, CASE WHEN n_chars >= {rules.FEW_CHARS} THEN CASE WHEN m.lang IS NOT NULL THEN {_distance('p_classes', 'p_classes_mean')} ELSE {nearest} END END AS char_distance,
    CASE WHEN n_words >= {rules.FEW_WORDS} THEN {_distance('p_common', 'p_common_mean')} END AS word_distance FROM {rows} x LEFT JOIN {means} m ON x.lang = m.lang)"""


def _near_sql(wider: float = 1.0) -> str:
    return f"(coalesce(char_distance, 0) <= {rules.FAR_CHARS * wider}::DOUBLE AND coalesce(word_distance, 0) <= sqrt({(rules.FAR_WORDS * wider) ** 2}::DOUBLE + {rules.NOISE}::DOUBLE / greatest(n_words, 1)))"


_LONG = f"p_common IS NOT NULL AND n_words >= {rules.FEW_WORDS} AND n_chars >= {rules.FEW_CHARS}"
_K = len(rules.CLASSES)
_COUNTED = {"lower": "[^a-z]", "upper": "[^A-Z]", "digit": "[^0-9]", "blank": r"[^\x20\x09-\x0D]", "stop": r"[^.,;:!?\x27\x22()-]", "wide": r"[\x00-\x7F]"}
_COUNTS = ", ".join(f"length(regexp_replace(text, '{pattern}', '', 'g')) AS c_{name}" for name, pattern in _COUNTED.items())
DIVERGENCE_SQL = f"""
WITH D AS (SELECT doc_id, lang, text IS NOT NULL AS given, coalesce(text, '') AS text FROM documents),
W AS (SELECT doc_id, lang, given, text, length(text) AS n_chars, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, {_COUNTS} FROM D),
V AS (SELECT *, list_transform(w, lambda x: trim(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?''"()-')) AS v FROM W),
G0 AS (SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS g FROM W WHERE len(w) > 5),
G1 AS (SELECT doc_id, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM G0),
G2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM G1),
G AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM G2, range(5) t(k) WHERE n > 1 GROUP BY doc_id),
L0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM D),
L AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM L0 WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
F0 AS (SELECT DISTINCT doc_id, lang, unnest(v) AS word FROM V WHERE lang IS NOT NULL AND given),
F1 AS (SELECT lang, word, count(*) AS n FROM F0 WHERE word <> '' AND strlen(word) <= {rules.WORD_BYTES} GROUP BY ALL),
F2 AS (SELECT lang FROM D WHERE lang IS NOT NULL AND given GROUP BY lang HAVING count(*) >= {rules.LEAST_DOCUMENTS} ORDER BY count(*) DESC, lang LIMIT {rules.LANGUAGES}),
F3 AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM F1 WHERE lang IN (FROM F2)),
F4 AS (SELECT lang, list(word ORDER BY r) AS top FROM F3 WHERE r <= {rules.COMMON} GROUP BY lang),
H0 AS (SELECT V.doc_id, F4.lang, n_chars, len(w) AS n_words, n_chars - c_blank AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    [c_lower, c_upper, c_digit, c_blank, c_stop, n_chars - c_lower - c_upper - c_digit - c_blank - c_stop - c_wide, c_wide] AS classes,
    CASE WHEN F4.lang IS NOT NULL THEN list_transform(range(1, {rules.COMMON + 1}), lambda i: len(list_filter(v, lambda x: x = top[i]))) END AS common
    FROM V LEFT JOIN L USING (doc_id) LEFT JOIN G USING (doc_id) LEFT JOIN F4 ON F4.lang = V.lang),
H AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEATED} * n_words AS base_failed, CASE WHEN n_chars > 0 THEN list_transform(classes, lambda x: x / n_chars) END AS p_classes,
    CASE WHEN n_words > 0 AND common IS NOT NULL THEN list_transform(list_append(common, n_words - list_sum(common)), lambda x: x / n_words) END AS p_common FROM H0),
B AS (SELECT * FROM H WHERE NOT base_failed),
M0 AS (SELECT lang, list_concat(p_classes, p_common) AS p FROM B WHERE {_LONG}), M1 AS (SELECT lang, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM M0),
M2 AS (SELECT lang, i, floor(x * {rules.STEPS})::BIGINT AS step, count(*) AS n FROM M1 GROUP BY ALL),
M3 AS (SELECT *, sum(n) OVER (PARTITION BY lang, i ORDER BY step) AS upto, sum(n) OVER (PARTITION BY lang, i) AS whole FROM M2),
M4 AS (SELECT lang, i, min(step) AS step FROM M3 WHERE 2 * upto >= whole GROUP BY ALL), M5 AS (SELECT lang, list(step ORDER BY i) AS m FROM M4 GROUP BY lang),
R1 AS (SELECT lang, list_transform(m[1:{_K}], lambda x: x / list_sum(m[1:{_K}])) AS p_classes_mean, list_transform(m[{_K + 1}:], lambda x: x / list_sum(m[{_K + 1}:])) AS p_common_mean FROM M5),
X1 AS {_distances_sql("B", "R1")}, N1 AS (SELECT * FROM X1 WHERE {_near_sql(rules.LOOSE)}),
R2 AS {_reference_sql("N1")}, X2 AS {_distances_sql("H", "R2")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_near_sql()} AS kept, round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance FROM X2"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; tests hold the others against brute force."""
    return {"op3_prefix_target_chat": CHAT_SQL, "op7_adaptive_jaccard": JACCARD_SQL, "op11_distribution_divergence": DIVERGENCE_SQL, "op13_splitter_skeleton_trie": TRIE_SQL}
