"""Quality classifier by co-training of a text view and a page-metadata view.

The text view sees which words a document has, with and without their
punctuation: each word's log odds of rejected against accepted documents, kept
if it lies clear of chance, summarised per document. The metadata view sees
language, source and the page's layout (length, lines, shares of capitals,
digits and symbols, repetition), never a word. Each is a logistic regression.
In every round each view labels a fresh pool of unlabelled documents, and those
it is confident of join the other view's training set; after the last exchange
both are fitted once more. All is cross-fitted in FOLDS folds: a document's
words are judged by the other folds' counts, and both views are calibrated and
combined on labelled documents' logits from fits without their fold. Then every
document is scored.

What the models are fitted on is bounded: LABELLED labelled documents and
ROUNDS pools of POOL unlabelled ones, those of the smallest hashes. Their words
stay on the executors: a round counts words by fold and label there, and the
driver gets the words that lie clear of chance and a few numbers a document.
Scores cover whole texts of all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import word_hashes
from .storage import written

LABELLED, POOL, ROUNDS, CONFIDENT, GROWTH = 12_000, 6_000, 3, 0.97, 1_000
FOLDS, MIN_ODDS, KINDS, FEATURES = 5, 1.0, 32, 5
THRESHOLD = 0.5
ALL = FOLDS
META = 12 + 2 * KINDS
COUNTED_AT_ONCE = 4_000_000


def metadata(texts: list[str | None], langs: list[str | None], sources: list[str | None]) -> np.ndarray:
    """Layout and origin of each page; null language or source is a value of its own."""
    out = np.zeros((len(texts), META))
    for i, (text, lang, source) in enumerate(zip(texts, langs, sources, strict=True)):
        data = (text or "").encode("utf-8", "surrogatepass")
        n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        size, letters = max(len(data), 1), n[65:91].sum() + n[97:123].sum() + n[128:].sum()
        gaps, lines = n[9:14].sum() + n[32], n[10] + 1
        symbols = n[33:127].sum() - n[48:58].sum() - n[65:91].sum() - n[97:123].sum()
        packed = len(zlib.compress(data, 1))
        out[i, :12] = [
            np.log1p(len(data)), np.log(lines), np.log1p(len(data) / lines), len(data) / (gaps + 1) / 10, n[65:91].sum() / max(letters, 1), n[48:58].sum() / size, symbols / size,
            np.minimum(packed / size, 2), n[33] / size, n[124] / size, (n[35:39].sum() + n[42]) / size, float(len(data) == 0),
        ]
        out[i, 12 + zlib.crc32((lang or "").encode()) % KINDS] = 1
        out[i, 12 + KINDS + zlib.crc32((source or "").encode()) % KINDS] = 1
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        """Newton's method with a ridge penalty; the first weight is the unpenalised intercept."""
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.c_[np.ones(len(x)), (x - mean) / scale]
        w, penalty = np.zeros(z.shape[1]), np.r_[1e-6, np.full(x.shape[1], ridge)]
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(x)), (x - self.mean) / self.scale] @ self.weight


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def clear_of_chance(total: float) -> tuple[float, float]:
    """The documents that a word needs, and by how many spreads its odds must lie off, among total documents: few documents have few words that chance could raise."""
    return min(8.0, 2 + total / 1000), min(3.0, 1 + np.log10(max(total, 1)) / 2)


@dataclass
class TextView:
    """odds: a row for each fold, of the counts without it, and one for all; 0 where a word isn't clear of chance. models: likewise, on the same rows' features."""

    words: np.ndarray
    odds: np.ndarray
    models: list[Logistic]

    def logit(self, documents: list[np.ndarray]) -> np.ndarray:
        return self.models[ALL].logit(word_features(self.words, self.odds[ALL], documents))


def word_features(words: np.ndarray, odds: np.ndarray, documents: list[np.ndarray]) -> np.ndarray:
    """documents: sorted distinct word hashes of each."""
    out = np.zeros((len(documents), FEATURES))
    for i, d in enumerate(documents):
        if len(words) and len(d):
            at = np.minimum(np.searchsorted(words, d), len(words) - 1)
            hit = odds[at[words[at] == d]]
            bad = np.sort(hit[hit > 0])[::-1]
            out[i] = [bad[:1].sum(), bad[:3].sum(), np.log1p(len(bad)), bad.sum() / len(d), np.log1p((hit < 0).sum())]
    return out


@dataclass
class CoTrained:
    text: TextView
    meta: Logistic
    calibration: tuple[Logistic, Logistic]
    together: Logistic

    def scores(self, documents: list[np.ndarray], meta: np.ndarray) -> np.ndarray:
        """Columns: calibrated text view, calibrated metadata view, both together."""
        views = [c.logit(x[:, None]) for c, x in zip(self.calibration, (self.text.logit(documents), self.meta.logit(meta)), strict=True)]
        return probability(np.stack([*views, self.together.logit(np.stack(views, 1))], 1))


@dataclass
class Training:
    """One view's documents: sorted identifiers and labels."""

    ids: np.ndarray
    y: np.ndarray

    def of(self, ids: np.ndarray) -> np.ndarray:
        """Labels; nan of documents outside."""
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, self.y[at], np.nan)

    def joined_by(self, ids: np.ndarray, y: np.ndarray) -> Training:
        ids, y = np.r_[self.ids, ids], np.r_[self.y, y]
        order = np.argsort(ids, kind="stable")
        return Training(ids[order], y[order])


def word_counts(sample: DataFrame, training: Training) -> DataFrame:
    """word, and by fold the training documents that have it (n0, ...) and the rejected ones of them (bad0, ...)."""
    shared = sample.sparkSession.sparkContext.broadcast(training)  # bounded by the sample

    def tally(held: list[np.ndarray], bad: list[np.ndarray]) -> pa.RecordBatch:
        keys, place = np.unique(np.concatenate(held), return_inverse=True)
        cols = [pa.array((keys >> np.uint64(3)).astype(np.int64)), pa.array((keys & np.uint64(7)).astype(np.int32)), pa.array(np.bincount(place)), pa.array(np.bincount(place, np.concatenate(bad)).astype(np.int64))]
        return pa.RecordBatch.from_arrays(cols, ["word", "fold", "n", "bad"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bad, size = [], [], 0
        for batch in batches:
            y = shared.value.of(np.asarray(batch.column(0)))
            for label, fold, data in zip(y.tolist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = np.frombuffer(data.as_buffer(), np.uint32)
                if label == label and len(words):
                    held.append(words.astype(np.uint64) << np.uint64(3) | np.uint64(fold))
                    bad.append(np.full(len(words), 1 - label))
                    size += len(words)
                    if size > COUNTED_AT_ONCE:
                        yield tally(held, bad)
                        held, bad, size = [], [], 0
        if held:
            yield tally(held, bad)

    rows = sample.select("doc_id", "fold", "words").mapInArrow(count, "word long, fold int, n long, bad long")
    return rows.groupBy("word").agg(*[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for c in ("n", "bad") for f in range(FOLDS)])


def log_odds(n, bad, total: float, total_bad: float, log):
    return log((bad + 0.5) / (n - bad + 0.5)) - float(np.log((total_bad + 0.5) / (total - total_bad + 0.5)))


def fit_text(sample: DataFrame, folds: dict[str, np.ndarray], training: Training) -> tuple[TextView, np.ndarray]:
    """The text view, and of each document of the sample (by identifier) its features by the counts without its own fold and by all."""
    ids, fold_of = folds["doc_id"], folds["fold"]
    y = training.of(ids)
    known = ~np.isnan(y)
    rest = [known & (fold_of != f) for f in range(FOLDS)] + [known]
    totals = [(float(r.sum()), float((1 - y[r]).sum())) for r in rest]

    def without(c: str, f: int, of):
        return sum((of(f"{c}{g}") for g in range(FOLDS) if g != f), 0 * of(f"{c}0"))

    def far(f: int):
        n, bad = without("n", f, F.col), without("bad", f, F.col)
        least, spreads = clear_of_chance(totals[f][0])
        odds = F.abs(log_odds(n, bad, *totals[f], F.log))
        return (n >= least) & (odds >= MIN_ODDS) & (odds >= spreads * F.sqrt(1 / (bad + 0.5) + 1 / (n - bad + 0.5)))

    any_far = far(ALL)
    for f in range(FOLDS):
        any_far = any_far | far(f)
    found = word_counts(sample, training).where(any_far).toArrow().sort_by("word")  # bounded by the sample
    words = np.asarray(found.column("word")).astype(np.uint32)
    odds = np.zeros((FOLDS + 1, len(words)))
    number = lambda c: np.asarray(found.column(c), float)
    for f in range(FOLDS + 1):
        n, bad = without("n", f, number), without("bad", f, number)
        least, spreads = clear_of_chance(totals[f][0])
        value = log_odds(n, bad, *totals[f], np.log)
        odds[f] = np.where((n >= least) & (np.abs(value) >= MIN_ODDS) & (np.abs(value) >= spreads * np.sqrt(1 / (bad + 0.5) + 1 / (n - bad + 0.5))), value, 0)
    shared = sample.sparkSession.sparkContext.broadcast((words, odds))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, odds = shared.value
        for batch in batches:
            documents = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(2)]
            own = [word_features(words, odds[f], [d])[0] for f, d in zip(batch.column(1).to_pylist(), documents, strict=True)]
            both = np.c_[np.array(own).reshape(-1, FEATURES), word_features(words, odds[ALL], documents)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in both], pa.binary())], ["doc_id", "x"])

    rows = sample.select("doc_id", "fold", "words").mapInArrow(describe, "doc_id long, x binary").toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(rows.column("x").to_pylist())).reshape(-1, 2 * FEATURES)
    models = [Logistic.fit(x[r, :FEATURES], y[r]) for r in rest]
    return TextView(words, odds, models), x


def co_train(sample: DataFrame) -> CoTrained | None:
    """sample: doc_id, fold, y (null: unlabelled), pool (the round that a hidden or missing label serves; null: training), words, meta. None if the labels are all alike."""
    rows = sample.select("doc_id", "fold", "y", "pool", "meta").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return None
    folds = {c: np.asarray(rows.column(c)) for c in ("doc_id", "fold")}
    ids, fold_of, pool = folds["doc_id"], folds["fold"], np.array([-1 if v is None else v for v in rows.column("pool").to_pylist()])
    meta = np.frombuffer(b"".join(rows.column("meta").to_pylist()), np.float32).reshape(len(ids), -1)
    labelled = pool < 0
    truth = np.array([0.0 if v is None else float(v) for v in rows.column("y").to_pylist()])
    if any(len(np.unique(truth[labelled & (fold_of != f)])) < 2 for f in range(FOLDS)):
        return None
    own = {view: Training(ids[labelled], truth[labelled]) for view in ("text", "meta")}
    growth = max(1, min(GROWTH, int(labelled.sum()) // 4))

    def fit_meta(without: int | None = None) -> Logistic:
        y = own["meta"].of(ids)
        use = ~np.isnan(y) & (fold_of != (-1 if without is None else without))
        return Logistic.fit(meta[use], y[use])

    for turn in range(ROUNDS):
        fresh = np.flatnonzero(pool == turn)
        if not len(fresh):
            continue
        text, x = fit_text(sample, folds, own["text"])
        p = {"text": probability(text.models[ALL].logit(x[fresh, FEATURES:])), "meta": probability(fit_meta().logit(meta[fresh]))}
        for view, other in (("text", "meta"), ("meta", "text")):
            sure = np.flatnonzero(np.abs(p[view] - 0.5) >= CONFIDENT - 0.5)
            sure = sure[np.argsort(-np.abs(p[view][sure] - 0.5), kind="stable")][:growth]
            own[other] = own[other].joined_by(ids[fresh[sure]], (p[view][sure] > 0.5).astype(float))
    text, x = fit_text(sample, folds, own["text"])
    raw = [np.zeros(len(ids)), np.zeros(len(ids))]
    for f in range(FOLDS):
        mine = fold_of == f
        raw[0][mine], raw[1][mine] = text.models[f].logit(x[mine, :FEATURES]), fit_meta(f).logit(meta[mine])
    y = truth[labelled]
    calibration = tuple(Logistic.fit(r[labelled, None], y) for r in raw)
    both = np.stack([c.logit(r[labelled, None]) for c, r in zip(calibration, raw, strict=True)], 1)
    return CoTrained(text, fit_meta(), calibration, Logistic.fit(both, y))


def _inputs(docs: DataFrame, key: str, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))


def _views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    short = lambda h: (h >> np.uint64(32)).astype(np.uint32)
    for at in range(0, batch.num_rows, 256):
        rows = batch.slice(at, 256)
        texts, langs, sources = (rows.column(i).to_pylist() for i in (1, 2, 3))
        words = [np.unique(np.concatenate([short(x) for x in h])) for h in zip(word_hashes(texts), word_hashes(texts, marks=False), strict=True)]
        yield at, rows.num_rows, words, metadata(texts, langs, sources)


def sampled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """What co_train() takes, written: LABELLED labelled documents at most and ROUNDS * POOL others, by their identifiers' hashes.

    The pools are unlabelled documents; where these are too few, labelled
    ones beyond LABELLED join them with their labels hidden, and where there
    is neither, every fourth labelled one. Of texts that share an identifier
    the one of the smallest hash counts.
    """
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good.cast("int")).alias("y"))
    every = _inputs(docs, key, text, lang, source)
    h = F.xxhash64("doc_id")
    ids = every.select("doc_id").where("doc_id is not null").distinct().join(known, "doc_id", "left").withColumn("h", h)
    labelled = ids.where("y is not null").orderBy("h", "doc_id").limit(LABELLED)
    rest = ids.join(F.broadcast(labelled.select("doc_id")), "doc_id", "left_anti")  # LABELLED rows
    pool = rest.orderBy(F.col("y").isNotNull(), "h", "doc_id").limit(ROUNDS * POOL)
    chosen = written(labelled.withColumn("hidden", F.lit(False)).unionByName(pool.withColumn("hidden", F.lit(True))))
    if not chosen.where("hidden").count():
        chosen = chosen.withColumn("hidden", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0)
    turn = F.when(F.col("hidden"), F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(ROUNDS)).cast("int"))
    chosen = chosen.select("doc_id", "y", turn.alias("pool"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, words, meta in _views(batch):
                part = batch.slice(at, n)
                cols = [pa.array([w.tobytes() for w in words], pa.binary()), pa.array([m.tobytes() for m in meta.astype(np.float32)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in (0, 4, 5, 6)), *cols], ["doc_id", "fold", "y", "pool", "words", "meta"])

    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang", "source")).alias("d")
    picked = every.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "fold", "y", "pool").agg(first)  # LABELLED + ROUNDS * POOL rows
    rows = picked.select("doc_id", "d.text", "d.lang", "d.source", "fold", "y", "pool").mapInArrow(read, "doc_id long, fold int, y int, pool int, words binary, meta binary")
    return written(rows)


def fitted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> CoTrained | None:
    """The classifier of quality = 1 and toxic = 0. None without labels, or where all are alike in a fold's rest."""
    return co_train(sampled(docs, labels, key, text, lang, source))


def scored(docs: DataFrame, model: CoTrained | None, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Every document: doc_id, text_score, meta_score, score (probability of being accepted), accepted (score >= THRESHOLD).

    Null and empty texts are scored as pages without words; repeated rows are
    repeated. Without a model (no labels, or all alike) scores are null and
    all documents are accepted. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, words, meta in _views(batch):
                s = shared.value.scores(words, meta) if shared.value else None
                cols = [pa.array(s[:, i]) if shared.value else pa.nulls(n, pa.float64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *cols], ["doc_id", "text_score", "meta_score", "score"])

    out = _inputs(docs, key, text, lang, source).mapInArrow(score, "doc_id long, text_score double, meta_score double, score double")
    return out.withColumn("accepted", F.coalesce(F.col("score") >= THRESHOLD, F.lit(True)))


def accepted_documents(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs without those that the classifier rejects; columns and rows as they are, whatever other columns there are.

    Null and empty texts are scored as pages without words; each repeated row
    is judged by its own text. Without labels, or where all are alike, all
    stay. An empty table stays empty.
    """
    model = fitted(docs, labels, text=text, lang=lang, source=source)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [docs.columns.index(c) for c in (text, lang, source)]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view = pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(i) for i in at]], ["id", "text", "lang", "source"])
            for start, n, words, meta in _views(view):
                yield batch.slice(start, n).filter(pa.array(shared.value.scores(words, meta)[:, 2] >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
