import random
import re
from collections import Counter

import pytest

from convomill.llm import rules

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def base_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    inside = {i + k for i, g in enumerate(windows) if n[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed)


def test_repeated_words():
    rng = random.Random(3)
    for _ in range(500):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        for width in (1, 2, 5, 6):
            windows = Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
            want = {i + k for i in range(len(words) - width + 1) if windows[tuple(words[i : i + width])] > 1 for k in range(width)}
            assert rules.repeated_words([w.encode() for w in words], width) == len(want)


def sentence(rng, n, common=("the", "of", "and", "to")):
    return " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("etaoinshr") for _ in range(rng.randint(3, 9))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus():
    """Prose of two languages, as much junk as prose, and texts too short to tell."""
    rng = random.Random(5)
    rows = [(i, "en", sentence(rng, 150), "clean") for i in range(60)] + [(100 + i, "xx", sentence(rng, 150, ("le", "la", "et", "un")), "clean") for i in range(30)]
    rows += [(200 + i, "en", sentence(rng, 150).upper().replace(" ", "!! "), "junk") for i in range(20)] + [(300 + i, "en", " | ".join(sentence(rng, 150).split()), "junk") for i in range(15)]
    rows += [(400 + i, "en", sentence(rng, 150, ("le", "la", "et", "un")), "other") for i in range(5)] + [(500, "en", sentence(rng, 20).upper(), "short"), (501, "yy", sentence(rng, 60), "short"), (502, None, sentence(rng, 150).upper(), "junk"), (503, None, sentence(rng, 150), "clean")]
    return rows


def test_verdicts(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, lang string, text string, kind string")
    rows = {r.doc_id: r for r in rules.quality_rules(df).collect()}
    for i, _, text, kind in corpus:
        assert tuple(rows[i][c] for c in BASE) == base_of(text)
        if kind != "short":
            assert rows[i].kept == (kind == "clean"), (i, kind, rows[i])
    assert rows[500].kept and rows[500].char_distance is None and rows[501].kept and rows[501].word_distance is None


def test_odd_rows(spark, corpus):
    """Null, empty and very long texts, null languages, ties and repeated rows, columns of our own names; every row has its own."""
    line = "one two three four five six seven eight nine ten"
    odd = [(None, "en", line), (1, None, None), (2, "en", ""), (3, "en", " \n\t\n"), (4, "en", f"{line}\n{line}\n \n \n{line} é|日"), (4, "en", f"{line}\n{line}\n \n \n{line} é|日"), (5, "zz", line), (6, "en", sentence(random.Random(1), 200_000)), (7, "en", "a\x0bb\x0cc\rd \x1ce　f g h i j k l")]
    rows = odd + [r[:3] for r in corpus]
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], "doc_id long, lang string, text string, n_words int, key string, kept double")
    got = rules.quality_rules(df).collect()
    assert Counter((r.doc_id, *[r[c] for c in BASE]) for r in got) == Counter((r[0], *base_of(r[2])) for r in rows)
    assert all(r.kept is not None and not (r.kept and r.base_failed) for r in got)
    assert rules.quality_rules(df.limit(0)).count() == 0
    few = rules.quality_rules(df.where("doc_id in (5, 6)")).collect()  # no language is large enough: the fixed rules decide
    assert {r.doc_id: r.kept for r in few} == {5: True, 6: True}
