"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, phrases and limits that results depend on.
QUESTION_WORDS = ["what", "why", "how", "when", "where", "who", "which", "explain", "describe", "define", "list", "compare", "give", "teach"]
STOPWORDS = [
    "the", "and", "for", "that", "with", "from", "this", "have", "into", "your", "about", "they", "their", "them", "over", "each", "such", "also", "been", "than",
    "just", "will", "only", "much", "more", "used", "very", "make", "made", "even", "most", "like", "some", "what", "when", "where", "how", "why",
]
DEFINITION_PHRASES = ["stands for", "is defined as", "refers to", "meaning:", "means that", "definition"]
IMPERATIVE_PHRASES = ["walk me through", "show me", "give me", "steps"]
FOLLOWUP_PHRASES = ["can you explain", "what do you mean", "i don't understand", "could you clarify", "wait,", "actually,", "so you're saying", "let me make sure"]
CORRECTION_PHRASES = ["actually,", "i should clarify", "to correct", "i was wrong", "more accurately", "let me rephrase"]
TOPIC_MARKERS = ["moving on", "now, about", "changing topic", "different question", "unrelated,", "on another note", "separately,", "new question"]
TERM = r"[a-z][a-z0-9\\-]{3,}"
PROMPT_LIMIT, ANSWER_LIMIT = 4000, 2000
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def lines(x: Column) -> Column:
    """The lines of a text; a line end at the very end starts no further line."""
    parts = F.split(x, LINE_END)
    return F.when((F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def any_of(x: Column, phrases: list[str]) -> Column:
    return x.rlike("|".join(p.replace(".", r"\.") for p in phrases))


def normalize_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def slugify(x: Column) -> Column:
    dashed = F.regexp_replace(F.lower(strip(x)), r"[\s/\\:]+", "-")
    kept = F.regexp_replace(F.regexp_replace(dashed, "[^a-z0-9._-]", ""), "-{2,}", "-")
    return F.coalesce(F.nullif(F.substring(kept, 1, 120), F.lit("")), F.lit("untitled"))


def strip_citations(x: Column) -> Column:
    return F.regexp_replace(x, "(?s)\ue200.*?\ue201", "")


def convert_latex(x: Column) -> Column:
    display = F.regexp_replace(x, r"(?s)\\\[\s*(.*?)\s*\\\]", r"\$\$$1\$\$")
    return F.regexp_replace(display, r"(?s)\\\(\s*(.*?)\s*\\\)", r"\$$1\$")


def format_unix(x: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(x), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def format_iso(x: Column) -> Column:
    """An ISO time in its own offset, to the second; anything else as it is."""
    iso = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"
    return F.when(x.isNull(), "").when(x.rlike(iso), F.concat_ws(" ", F.regexp_extract(x, iso, 1), F.regexp_extract(x, iso, 2))).otherwise(x)


def parse_user_time(x: Column) -> Column:
    """An ISO time: a day, with hours to fractions of a second, and an offset (else the session's zone); or a day with minutes or seconds whose parts lack leading zeros; null for anything else."""
    time = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
    y = F.regexp_replace(strip(x), ",", ".")
    part = lambda i: F.regexp_extract(y, time, i)
    zone = F.regexp_replace(part(5), r"^([+-]\d{2}):?(\d{2})?$", "$1:$2")
    clock = F.concat(F.substring(part(1), 1, 3), F.when(part(2) == "", ":00:00").when(part(3) == "", F.concat(part(2), F.lit(":00"))).otherwise(part(2)))
    offset = F.when(zone.endswith(":"), F.concat(zone, F.lit("00"))).otherwise(zone)
    full = F.concat(F.substring(y, 1, 10), F.when(part(1) == "", "").otherwise(F.concat(clock, offset)))
    short = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:\s+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?$"
    two = lambda i: F.lpad(F.regexp_extract(y, short, i), 2, "0")
    filled = F.concat(F.regexp_extract(y, short, 1), F.lit("-"), two(2), F.lit("-"), two(3), F.lit(" "), two(4), F.lit(":"), two(5), F.lit(":"), two(6))
    return F.when(y.rlike(time), full.try_cast("timestamp")).when(y.rlike(short), filled.try_cast("timestamp"))


def truncate_prompt(x: Column, limit: int = PROMPT_LIMIT) -> Column:
    head, tail = limit * 7 // 10, limit * 2 // 10
    removed = F.length(x) - head - tail
    notice = F.concat(F.lit("\n\n[TRUNCATED: "), F.format_number(removed, 0), F.lit(" characters removed]\n\n"))
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, head), notice, F.right(x, F.lit(tail)))).otherwise(x)


def question_like(prompt: Column) -> Column:
    return prompt.contains("?") | F.lower(prompt).rlike("^(" + "|".join(QUESTION_WORDS) + ") ")


def bullet_count(answer: Column) -> Column:
    return F.size(F.filter(lines(answer), lambda l: strip(l).rlike(r"^(-|\*|[123]\.)")))


def occurrences(x: Column, what: str) -> Column:
    return ((F.length(x) - F.length(F.replace(x, F.lit(what), F.lit("")))) / len(what)).cast("int")


def key_points(answer: Column, limit: int = 4) -> Column:
    marked = F.filter(F.transform(lines(answer), strip), lambda l: l.rlike("^[#*-]"))
    cleaned = F.transform(marked, lambda l: strip(F.regexp_replace(l, "^[#*0-9. -]+", "")))
    return F.slice(F.filter(cleaned, lambda l: l != ""), 1, limit)


def non_content(text: Column) -> Column:
    """A JSON object of a content type that carries no answer."""
    kind = F.lower(F.get_json_object(strip(text), "$.content_type"))
    return strip(text).rlike(r"(?s)^\{.*\}$") & F.coalesce(kind.isin("thoughts", "reasoning_recap", "code"), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    """Of the word sets of two texts; 0 if either has no word."""
    x, y = (F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != "")) for t in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def severity(flagged: Column, score: Column) -> Column:
    return F.when(flagged, F.when(score >= 0.95, "VERY HIGH").when(score >= 0.90, "HIGH").otherwise("MODERATE"))


def week_start(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def week_label(start: Column) -> Column:
    """Like Nov 27 - Dec 03; within one month the end is a bare day; with years where they differ."""
    end = F.date_add(start, 6)
    same_month = (F.month(start) == F.month(end)) & (F.year(start) == F.year(end))
    return (
        F.when(same_month, F.concat_ws(" - ", F.date_format(start, "MMM dd"), F.dayofmonth(end).cast("string")))
        .when(F.year(start) == F.year(end), F.concat_ws(" - ", F.date_format(start, "MMM dd"), F.date_format(end, "MMM dd")))
        .otherwise(F.concat_ws(" - ", F.date_format(start, "MMM dd, yyyy"), F.date_format(end, "MMM dd, yyyy")))
    )


def clean_tags(x: Column) -> Column:
    """The trimmed, non-empty tags of a comma-separated text."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), strip), lambda tag: tag != "")
