import math
import re
import zlib
from collections import Counter

import pytest

from convomill.llm import lm


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["</s>"]


def test_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 30_000)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(300).collect()] + [(-1, None), (-2, ""), (None, "É a B\x0bc"), (-3, "x" * 3_000_000 + " y")]
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fold int")).collect()}
    held = {d: zlib.crc32(str(d).encode() if d is not None else b"") % 10 == 0 for d, _ in rows}
    train = [words(t) for d, t in rows if not held[d]]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for d, t in rows:
        r, ws = got[d], words(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
    pair = Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))
    known = Counter({**c, "<s>": len(train)})
    h = [d for d in held if held[d]]
    assert sum(got[d].score for d in h) > sum(got[d].base_score for d in h)
    # the model written out: counts without the weighing fold give the weights, all counts the scores
    fold = {d: lm.fold_of(d) for d, _ in rows}
    rest = [words(t) for d, t in rows if fold[d] not in (lm.HELD_OUT, lm.WEIGHING)]
    rest_c, rest_pair = Counter({**Counter(w for t in rest for w in t), "<s>": len(rest)}), Counter(p for t in rest for p in zip(["<s>", *t], t, strict=False))
    rest_n, bins = sum(len(t) for t in rest), Counter()
    bucket = lambda x: min(int(math.log2(x)) + 1 if x else 0, lm.BUCKETS - 1)
    level = lambda f: round(lm.BINS * math.log2(f)) if f else -999
    for d, t in rows:
        if fold[d] == lm.WEIGHING:
            for a, b in zip(["<s>", *words(t)], words(t), strict=False):
                bins[bucket(rest_c[a]), level(rest_pair[a, b] / rest_c[a] if rest_c[a] else 0), level(rest_c[b] / rest_n)] += 1
    learned = lm.weights([(*k, x) for k, x in bins.items()], lm.Totals(n, v, len(train)))
    for d, t in rows:
        total = 0.0
        for a, b in zip(["<s>", *words(t)], words(t), strict=False):
            w = learned[bucket(known[a])]
            total += math.log10(w[0] * (pair[a, b] / known[a] if known[a] else 0) + w[1] * c[b] / n + w[2] / (v + 1))
        assert got[d].score == pytest.approx(total, rel=1e-6), d
    # the model's probabilities of all words after a context sum to one: with the weights of its bucket
    mix = lm.weights([(3, -2, -8, 10), (3, -999, -9, 5)], lm.Totals(n, v, len(train)))
    assert mix.sum(1) == pytest.approx([1] * lm.BUCKETS)
    for context in ("<s>", train[0][0]):
        w = mix[3]
        total = sum(w[0] * pair[context, x] / known[context] + w[1] * c[x] / n + w[2] / (v + 1) for x in c) + w[2] / (v + 1)
        assert total == pytest.approx(1)


def test_expectation_maximisation_recovers_weights():
    # tokens drawn so that the pair estimate explains 3 in 4
    totals = lm.Totals(1000, 99, 10)
    w = lm.weights([(5, 0, -999, 750), (5, -999, 0, 250)], totals)
    assert w[5][0] == pytest.approx(0.75, abs=0.01) and w[5][1] == pytest.approx(0.25, abs=0.01)


def test_repeated_rows_count_each(spark):
    rows = [(i, f"a b w{i % 3}") for i in range(30)] + [(7, "a b w1")] * 3 + [(7, "other text of one number")]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    train = [words(t) for d, t in rows if zlib.crc32(str(d).encode()) % 10]
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {sum(map(len, train))}
    assert len({(r.score, r.base_score) for r in got if r.doc_id == 7}) == 2


def test_empty(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
