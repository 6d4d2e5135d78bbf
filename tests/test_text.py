from datetime import date

import pytest
from pyspark.sql import functions as F

from convomill.functions import text as t
from convomill.operators import features, payloads, state


def one(spark, expression, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'date' if isinstance(v, date) else 'double' if isinstance(v, float) else 'string'}" for n, v in zip(names, values, strict=True)))
    return df.select(expression(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(("f", "x", "want"), [
    (t.normalize_text, "  Hello,  Wörld! ", "hello w rld"), (t.normalize_text, "", ""), (t.slugify, " My Chat: a/b\\c  d! ", "my-chat-a-b-c-d"), (t.slugify, "???", "untitled"), (t.slugify, "x" * 200, "x" * 120),
    (t.strip_citations, "acite\nxb", "ab"), (t.convert_latex, "\\[ x \\] and \\( y \\)", "$$x$$ and $y$"), (t.format_iso, "2025-01-02T03:04:05.678Z", "2025-01-02 03:04:05"), (t.format_iso, "soon", "soon"),
    (t.truncate_prompt, "x" * 4000, "x" * 4000), (t.truncate_prompt, "x" * 6000, "x" * 2800 + "\n\n[TRUNCATED: 2,400 characters removed]\n\n" + "x" * 800),
    (t.bullet_count, "- a\n* b\n1. c\n10. d\n**bold**\n---\n1.5", 6), (t.key_points, "# H\n- 1. one\n*\ntext\n- two\n- three\n- four", ["H", "one", "two", "three"]), (t.question_like, "What is it", True), (t.question_like, "whatever", False), (t.question_like, "ok?", True),
    (t.non_content, '{"content_type": "reasoning_recap"}', True), (t.non_content, '{"content_type": "text"}', False), (t.non_content, "[1]", False),
])
def test_functions(spark, f, x, want):
    assert one(spark, f, x) == want


def test_jaccard_weeks_and_times(spark):
    assert one(spark, t.jaccard, "a b c", "b c d") == 0.5 and one(spark, t.jaccard, "", "a") == 0.0
    labels = [one(spark, lambda d: t.week_label(t.week_start(d)), d) for d in (date(2025, 11, 28), date(2025, 12, 3), date(2025, 12, 31))]
    assert labels == ["Nov 24 - 30", "Dec 01 - 7", "Dec 29, 2025 - Jan 04, 2026"]
    assert str(one(spark, t.parse_user_time, "2025-01-02T03:04:05Z")) == "2025-01-02 03:04:05" and one(spark, t.parse_user_time, "never") is None


def test_score_and_terms(spark):
    turn = spark.createDataFrame([(1, "What is X? show me steps", "It stands for X.\n- a\n- b\n### H\n```x```" + "y" * 80)], "id int, prompt string, answer string")
    r = features.turn_signals(turn).first()
    assert (r.question_like, r.definition_like, r.bullet_count, r.heading_count, r.code_blocks, r.imperative) == (True, True, 2, 1, 2, True)
    assert r.score == pytest.approx(1.0 + 0.45 + 0.41 + 0.30 + 0.2 + 0.55 + 0.2)
    terms = features.ranked_terms(spark.createDataFrame([(1, "Beta alpha beta gamma with alpha2 the-end abc")], "id int, text string"), ["id"], F.col("text"), 3).first()
    assert terms.terms == ["beta", "alpha", "gamma"]


def test_dates_and_globs(spark):
    assert state.date_bounds("2025-12") == ("2025-12-01", "2026-01-01") and state.date_bounds(" a : b ") == ("a", "b") and state.date_bounds("2025-01-01") == ("2025-01-01", "")
    files = spark.createDataFrame([("d/2025-10-01_a.md",), ("d/2025-11-01_b.md",), ("d/none.md",)], "path string")
    assert [r.path for r in state.filter_date_range(files, "2025-10").collect()] == ["d/2025-10-01_a.md", "d/none.md"]
    assert state.filter_date_range(files, ":2025-10-15").count() == 3
    assert [r.path for r in state.filter_exclude_glob(files, ["*_[!b].md", "n?ne.md"]).collect()] == ["d/2025-11-01_b.md"]


@pytest.mark.parametrize(("text", "ok"), [('{"a": 1}', True), ('```json\n{"a": 1}\n```', True), ('x {"a": 1} y', True), ("[1, 2]", False), ("", False), (None, False), ('{"a": "\\alpha"}', True), ('[1] {"a": 1}', False), ('```\n{"a": 1}', True), ('```python {"a": 1}```', True), ('x {"a": "\\alpha"}', False)])
def test_responses(text, ok):
    assert (payloads.first_object(text)[0] is not None) == ok


@pytest.mark.parametrize(("text", "want"), [
    ("p\n\nq", "<p>p</p><p>q</p>"), ("- x\n- y\n1. z\nend", "<ul><li>x</li><li>y</li></ul><ol><li>z</li></ol>end"), ("+ a\n  * b", "<ul><li>a</li><li>b</li></ul>"), ("a\nb", "a<br>b"),
    ("**b** *i* 2*3*4 `c*d*`", "<b>b</b> <i>i</i> 2*3*4 <code>c*d*</code>"), ("```py\nk = 1\n```", "<pre>k = 1</pre>"), ("> q\n> r", "<blockquote>q</blockquote><blockquote>r</blockquote>"),
    ("\\(a*b*c\\) and \\[x\n*y*\\] and $a*b*$ *i*", "\\(a*b*c\\) and \\[x\n*y*\\] and $a*b*$ <i>i</i>"), ("", ""), (None, None),
])
def test_markdown(spark, text, want):
    assert payloads.with_html(spark.createDataFrame([(text,)], "x string"), "x", "h").first()["h"] == want


@pytest.mark.parametrize(("text", "want"), [
    ("2025-01-02", "2025-01-02 00:00:00"), ("2025-01-02 03:04", "2025-01-02 03:04:00"), (" 2025-01-02T03:04:05.25+02:30 ", "2025-01-02 00:34:05.250000"), ("2025-01-02 03:04:05-0130", "2025-01-02 04:34:05"), ("2025-01-02T03:04+02", "2025-01-02 01:04:00"), ("2025-13-02", None), ("2025", None), ("", None),
    ("2025-1-2 3:04", "2025-01-02 03:04:00"), ("2025-1-2 3:4:5", "2025-01-02 03:04:05"), ("2025-1-2", "2025-01-02 00:00:00"), ("2025-1-2T3:04", None), ("2025-1-2 3", None),
])
def test_user_times(spark, text, want):
    got = one(spark, t.parse_user_time, text)
    assert (got and str(got)) == want
