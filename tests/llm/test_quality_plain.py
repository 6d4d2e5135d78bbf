"""The quality classifier against a plain restatement: sets of words for hashes, counts by loops, weights by general minimisation of the written loss."""

import math
import re
import zlib

import numpy as np

from convomill.llm import quality

SF = "/root/testdata/sf0.001"
FOLDS = quality.FOLDS


def words_of(text):
    """With their punctuation, and without: every ASCII mark divides then."""
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return set(re.findall(r"[^\x20\x09-\x0D]+", low)) | set(re.findall(r"(?:[0-9a-z]|[^\x00-\x7F])+", low))


def layout(text):
    """What the page looks like, without language and source."""
    data = (text or "").encode()
    count = lambda test: sum(map(test, data))
    upper, lower, digits, high = count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122), count(lambda b: 48 <= b <= 57), count(lambda b: b >= 128)
    size, lines, gaps = max(len(data), 1), data.count(b"\n") + 1, count(lambda b: b in b"\t\n\x0b\x0c\r ")
    shown = count(lambda b: 33 <= b <= 126)
    marks = data.count(b"#") + data.count(b"$") + data.count(b"%") + data.count(b"&") + data.count(b"*")
    return [
        math.log1p(len(data)), math.log(lines), math.log1p(len(data) / lines), len(data) / (gaps + 1) / 10, upper / max(upper + lower + high, 1), digits / size, (shown - digits - upper - lower) / size,
        min(len(zlib.compress(data, 1)) / size, 2), data.count(b"!") / size, data.count(b"|") / size, marks / size, float(not data),
    ]


def fit(x, y):
    """Minimises the ridge logistic loss over standardised columns, the intercept free, by Newton steps with halving."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    ridge = np.r_[1e-6, np.ones(x.shape[1])]
    loss = lambda w: np.logaddexp(0, z @ w).sum() - y @ (z @ w) + (ridge * w * w).sum() / 2
    w = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-(z @ w)))
        slope = z.T @ (p - y) + ridge * w
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge), slope)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-9:
            size /= 2
        w = w - size * step
        if np.abs(slope).max() < 1e-9:
            break
    return lambda v: np.c_[np.ones(len(v)), (np.asarray(v, float) - mean) / scale] @ w


def text_view(words, y, rest):
    """Features by the counts of the documents in rest (indexes): a function of word sets."""
    n, bad = {}, {}
    for i in rest:
        for w in words[i]:
            n[w] = n.get(w, 0) + 1
            bad[w] = bad.get(w, 0) + 1 - y[i]
    total, total_bad = len(rest), sum(1 - y[i] for i in rest)
    least, spreads = min(8.0, 2 + total / 1000), min(3.0, 1 + math.log10(max(total, 1)) / 2)
    odds = {}
    for w in n:
        value = math.log((bad[w] + 0.5) / (n[w] - bad[w] + 0.5)) - math.log((total_bad + 0.5) / (total - total_bad + 0.5))
        if n[w] >= least and abs(value) >= 1 and abs(value) >= spreads * math.sqrt(1 / (bad[w] + 0.5) + 1 / (n[w] - bad[w] + 0.5)):
            odds[w] = value

    def features(d):
        hit = [odds[w] for w in d if w in odds]
        high = sorted((v for v in hit if v > 0), reverse=True)
        return [sum(high[:1]), sum(high[:3]), math.log1p(len(high)), sum(high) / len(d) if d else 0.0, math.log1p(sum(v < 0 for v in hit))]

    return features


def test_scores_equal_the_plain_rules(spark):
    """Words, odds, features, exchange, fits, calibration and combination; given only which document serves in which fold and pool."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r for r in docs.collect()}
    sample = sorted(quality.sampled(docs, labels).select("doc_id", "fold", "y", "pool").collect(), key=lambda r: r.doc_id)
    words = [words_of(texts[r.doc_id].text) for r in sample]
    origin = lambda rows: quality.metadata([None] * len(rows), [r.lang for r in rows], [r.source for r in rows])[:, 12:]  # noqa: E731  places of languages and sources
    meta_of = lambda rows: np.c_[[layout(r.text) for r in rows], origin(rows)].astype(np.float32).astype(float)
    meta = meta_of([texts[r.doc_id] for r in sample])
    fold = [r.fold for r in sample]
    labelled = [i for i, r in enumerate(sample) if r.pool is None]
    own = {v: {i: sample[i].y for i in labelled} for v in ("text", "meta")}

    def both(view):
        """Views fitted without each fold, and on all."""
        y = own[view]
        rests = [[i for i in y if fold[i] != f] for f in range(FOLDS)] + [list(y)]
        if view == "meta":
            return [lambda i, m=fit(meta[r], [y[k] for k in r]): m(meta[i]) for r in rests]
        views = [text_view(words, y, r) for r in rests]
        crossed = [fit([views[fold[i]](words[i]) for i in r], [y[i] for i in r]) for f, r in enumerate(rests)]
        out = [lambda i, f=f: crossed[f](np.array([views[f](words[k]) for k in i])) for f in range(FOLDS)]
        return [*out, lambda i: crossed[FOLDS](np.array([views[FOLDS](words[k]) for k in i])), (views[FOLDS], crossed[FOLDS])]

    for turn in range(quality.ROUNDS):
        fresh = [i for i, r in enumerate(sample) if r.pool == turn]
        if not fresh:
            continue
        p = {v: 1 / (1 + np.exp(-both(v)[FOLDS](fresh))) for v in ("text", "meta")}
        more = {}
        for view, other in (("text", "meta"), ("meta", "text")):
            sure = sorted((k for k in range(len(fresh)) if abs(p[view][k] - 0.5) >= quality.CONFIDENT - 0.5), key=lambda k: -abs(p[view][k] - 0.5))
            growth = max(1, min(quality.GROWTH, len(labelled) // 4))
            more[other] = {fresh[k]: float(p[view][k] > 0.5) for k in sure[:growth]}
        for v in own:
            own[v] = own[v] | more[v]
    text, page = both("text"), both("meta")
    raw = {"text": np.zeros(len(sample)), "meta": np.zeros(len(sample))}
    for f in range(FOLDS):
        mine = [i for i in range(len(sample)) if fold[i] == f]
        if mine:
            raw["text"][mine], raw["meta"][mine] = text[f](mine), page[f](mine)
    y = [float(sample[i].y) for i in labelled]
    scaled = {v: fit(raw[v][labelled, None], y) for v in raw}
    together = fit(np.c_[[scaled[v](raw[v][labelled, None]) for v in ("text", "meta")]].T, y)
    every = sorted(texts.values(), key=lambda r: r.doc_id)
    view, model = text[FOLDS + 1]
    last = fit(meta[list(own["meta"])], list(own["meta"].values()))
    a = scaled["text"](model(np.array([view(words_of(r.text)) for r in every]))[:, None])
    b = scaled["meta"](last(meta_of(every))[:, None])
    want = 1 / (1 + np.exp(-np.c_[a, b, together(np.c_[a, b])]))
    got = {r.doc_id: r for r in quality.scored(docs, quality.fitted(docs, labels)).collect()}
    mine = np.array([[got[r.doc_id].text_score, got[r.doc_id].meta_score, got[r.doc_id].score] for r in every])
    assert np.abs(mine - want).max() < 1e-4, np.abs(mine - want).max(0)
    assert [got[r.doc_id].accepted for r in every] == (want[:, 2] >= 0.5).tolist()


def test_ties_and_the_cut_of_a_pool(spark, monkeypatch):
    """A score of just the threshold is accepted; a pool's documents of equal confidence are taken in their order, and no more than may grow."""
    docs = spark.createDataFrame([(i, f"word{i % 7} and more", "en", "s") for i in range(60)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = quality.scored(docs, quality.fitted(docs, labels)).collect()
    middle = sorted(r.score for r in rows)[30]
    monkeypatch.setattr(quality, "THRESHOLD", middle)
    again = quality.scored(docs, quality.fitted(docs, labels)).collect()
    assert {r.doc_id for r in again if r.accepted} == {r.doc_id for r in rows if r.score >= middle} and any(r.score == middle for r in again)
    monkeypatch.setattr(quality, "CONFIDENT", 0.5)
    monkeypatch.setattr(quality, "GROWTH", 2)
    first, second = (quality.co_train(quality.sampled(d, labels)) for d in (docs, docs.orderBy("text")))
    assert np.array_equal(first.text.odds, second.text.odds) and np.array_equal(first.meta.weight, second.meta.weight)
