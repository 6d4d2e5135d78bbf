"""Word bigram model with deleted interpolation, learned from and scoring whole texts.

P(w | h) = a2 c(h w) / c(h) + a1 c(w) / N + a0 / (V + 1), where the weights
depend on the bucket (power of two) of the context's frequency c(h) and come
from expectation-maximisation on a fold of the training documents, which is
deleted as a whole from the counts that predict it. A text's words are
followed by one end token; its first token's context is a start mark.

The plan. Documents are gathered in chunks of tokens, written once: a chunk
has its distinct words (sorted 64-bit hashes) and its tokens as places among
them. Each chunk sends every distinct word and word pair once, with its count
in training documents, to the part that owns its hash range; the parts add up
and answer with a count for each hash asked, in order. So a hot word costs one
entry a chunk, no pair of document and word is ever a row, and the corpus is
never joined word by word. The chunk then has all counts it needs. What passes
the driver: N, V, the number of documents, and a histogram of quantised
estimates whose size is bounded by its bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix, word_hashes
from .storage import written

CHUNK_TOKENS, PART_ENTRIES = 2_000_000, 1_500_000
FOLDS, HELD_OUT, WEIGHING = 10, 0, 1
BUCKETS, BINS, ROUNDS = 48, 4, 100
_U = np.uint64
END, START = _U(0xE17D), _U(0x57A27)


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of their places, compressed."""
    raw = np.ascontiguousarray(a)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T if len(raw) else np.empty(0, np.uint8)
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpacked(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(dtype).ravel()


def _packed_sorted(a: np.ndarray) -> bytes:
    return _packed(np.diff(a, prepend=_U(0)))


def _unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, "u8"), dtype=_U)


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


CHUNKS = "chunk long, fold int, n_tokens long, n_docs long, doc_ids array<long>, lengths array<int>, words binary, tokens binary"


def chunked(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Chunks hold documents of one kind of fold only: held out, weighing, or other."""

    def row(number: int, fold: int, docs_in: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(hashes)
        words, tokens = np.unique(flat, return_inverse=True)
        values = [number, fold, len(flat), len(docs_in), docs_in, [len(h) for h in hashes], _packed_sorted(words), _packed(tokens.astype("<u4"))]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["chunk", "fold", "n_tokens", "n_docs", "doc_ids", "lengths", "words", "tokens"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, tuple[list, list]] = {}
        size: dict[int, int] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                for doc, h in zip(ids[at : at + 256], word_hashes(batch.column(1)[at : at + 256].to_pylist()), strict=True):
                    fold = min(fold_of(doc), 2)
                    docs_in, hashes = held.setdefault(fold, ([], []))
                    docs_in.append(doc)
                    hashes.append(np.append(h, END))
                    size[fold] = size.get(fold, 0) + len(h) + 1
                    if size[fold] >= CHUNK_TOKENS:
                        yield row(number, fold, *held.pop(fold))
                        number, size[fold] = number + 1, 0
        for fold, (docs_in, hashes) in held.items():
            yield row(number, fold, docs_in, hashes)
            number += 1

    return docs.select(F.col(key).cast("long"), text).mapInArrow(gather, CHUNKS)


def _pairs(words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token with its context, and where documents begin."""
    h, first = words[tokens], np.cumsum(lengths) - lengths
    before = np.roll(h, 1)
    before[first] = START
    return mix(before * _U(0x9E3779B97F4A7C15) + h), first


def _split(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    bounds = np.array([-(-(k << 64) // parts) for k in range(1, parts)], _U) if parts > 1 else np.empty(0, _U)
    return np.searchsorted(sorted_hashes, bounds)


def asked(chunks: DataFrame, parts: int) -> DataFrame:
    """What each chunk asks of each part: sorted hashes of words and pairs, and their counts in training documents."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, fold, lengths, words, tokens in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words, tokens = _unpacked_sorted(words), _unpacked(tokens, "<u4").astype(np.int64)
                pairs, n_pairs = np.unique(_pairs(words, tokens, np.array(lengths))[0], return_counts=True)
                n_words = np.bincount(tokens, minlength=len(words))
                cells = [np.split(a, _split(h, parts)) for h, a in ((words, words), (words, n_words), (pairs, pairs), (pairs, n_pairs))]
                train = fold != HELD_OUT
                rows = [(p, chunk, fold == WEIGHING, _packed_sorted(w), _packed(nw.astype("<u4") * train), _packed_sorted(b), _packed(nb.astype("<u4") * train)) for p, (w, nw, b, nb) in enumerate(zip(*cells, strict=True)) if len(w) or len(b)]
                types = [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["part", "chunk", "weighing", "words", "n_words", "pairs", "n_pairs"])

    return chunks.select("chunk", "fold", "lengths", "words", "tokens").mapInArrow(ask, "part int, chunk long, weighing boolean, words binary, n_words binary, pairs binary, n_pairs binary")


def answered(questions: DataFrame) -> DataFrame:
    """For each question the counts over all chunks, in its order, and over all but the weighing ones (rest_, for a weighing chunk only); new_words: in one row of a part its number of words that training has."""

    def answer(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in table.column_names}
        out, new = {}, 0
        for what in ("words", "pairs"):
            hashes = [_unpacked_sorted(x) for x in cols[what]]
            counts = np.concatenate([_unpacked(x, "<u4") for x in cols["n_" + what]])
            unique, place = np.unique(np.concatenate(hashes), return_inverse=True)
            lengths = [len(h) for h in hashes]
            weighing = np.repeat(cols["weighing"], lengths)
            total = np.bincount(place, counts, len(unique)).astype("<u8")
            rest = total - np.bincount(place, counts * weighing, len(unique)).astype("<u8")
            cuts = np.cumsum(lengths)[:-1]
            out[what] = [_packed(x) for x in np.split(total[place], cuts)]
            out["rest_" + what] = [_packed(x) if own else None for x, own in zip(np.split(rest[place], cuts), cols["weighing"], strict=True)]
            new = int((total > 0).sum()) if what == "words" else new
        binary = {f"{c}_{what}": pa.array(out[("rest_" if c == "rest" else "") + what], pa.binary()) for c in ("c", "rest") for what in ("words", "pairs")}
        return pa.table({"chunk": cols["chunk"], "part": pa.array(cols["part"], pa.int32()), **binary, "new_words": [new] + [0] * (table.num_rows - 1)})

    return questions.groupBy("part").applyInArrow(answer, "chunk long, part int, c_words binary, c_pairs binary, rest_words binary, rest_pairs binary, new_words long")


@dataclass
class Totals:
    tokens: int
    words: int
    docs: int


@dataclass
class Counts:
    """A chunk's tokens with all counts: of the token, of its context, of both together."""

    doc_ids: list
    lengths: np.ndarray
    word: np.ndarray
    context: np.ndarray
    pair: np.ndarray


def _counts(row: tuple, totals: Totals, kind: str = "c") -> Counts:
    """kind: c for the counts of all training documents, rest without the weighing ones; totals are those of the same documents."""
    _, _, doc_ids, lengths, words, tokens, parts = row
    lengths, words, tokens = np.array(lengths), _unpacked_sorted(words), _unpacked(tokens, "<u4").astype(np.int64)
    parts = sorted(parts, key=lambda p: p["part"])
    c_words = np.concatenate([_unpacked(p[f"{kind}_words"], "<u8") for p in parts]).astype(float)
    c_pairs = np.concatenate([_unpacked(p[f"{kind}_pairs"], "<u8") for p in parts]).astype(float)
    pairs, first = _pairs(words, tokens, lengths)
    _, place = np.unique(pairs, return_inverse=True)
    word = c_words[tokens]
    context = np.roll(word, 1)
    context[first] = totals.docs
    return Counts(doc_ids, lengths, word, context, c_pairs[place])


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, np.log2(np.maximum(context, 1)).astype(int) + 1, 0), BUCKETS - 1)


def _estimates(pair: np.ndarray, context: np.ndarray, word: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    return np.where(context > 0, pair / np.maximum(context, 1), 0), word / max(tokens, 1)


def weights(histogram: list[tuple[int, int, int, int]], totals: Totals) -> np.ndarray:
    """Mixture weights (bucket by: pair, word, uniform) by expectation-maximisation. A bucket without tokens takes the weights of all together."""
    out = np.full((BUCKETS, 3), 1 / 3)
    if histogram:
        bucket, q2, q1, n = np.array(histogram, float).T
        f = np.stack([np.where(q2 > -999, 2.0 ** (q2 / BINS), 0), np.where(q1 > -999, 2.0 ** (q1 / BINS), 0), np.full(len(n), 1 / (totals.words + 1))], 1)

        def fitted(of: np.ndarray) -> np.ndarray:
            w = np.full(3, 1 / 3)
            for _ in range(ROUNDS):
                share = f[of] * w
                share /= share.sum(1, keepdims=True)
                w = (share * n[of, None]).sum(0) + 1e-6
                w /= w.sum()
            return w

        out[:] = fitted(np.ones(len(n), bool))
        for b in np.unique(bucket).astype(int):
            out[b] = fitted(bucket == b)
    out[0, 1:] += out[0, 0] / 2  # an unseen context says nothing
    out[0, 0] = 0
    return out


def score_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on documents whose crc32(key as text) mod FOLDS is not HELD_OUT,
    scores all. Null text: empty, one end token. Null key: held out. Repeated
    rows count each. An empty table gives an empty result. Other columns are
    not read.
    """
    chunks = written(chunked(docs, text, key))
    sums = chunks.agg(
        F.sum("n_tokens").alias("all"), F.sum(F.when(F.col("fold") != HELD_OUT, F.col("n_tokens"))).alias("tokens"), F.sum(F.when(F.col("fold") != HELD_OUT, F.col("n_docs"))).alias("docs"),
        F.sum(F.when(~F.col("fold").isin(HELD_OUT, WEIGHING), F.col("n_tokens"))).alias("rest_tokens"), F.sum(F.when(~F.col("fold").isin(HELD_OUT, WEIGHING), F.col("n_docs"))).alias("rest_docs"),
    ).first()
    parts = 1 + (sums["all"] or 0) // PART_ENTRIES
    answers = written(answered(asked(chunks, parts)))
    totals = Totals(sums["tokens"] or 0, answers.agg(F.sum("new_words")).first()[0] or 0, sums["docs"] or 0)
    rest = Totals(sums["rest_tokens"] or 0, totals.words, sums["rest_docs"] or 0)
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("part", "c_words", "c_pairs", "rest_words", "rest_pairs")).alias("parts"))
    joined = chunks.select("chunk", "fold", "doc_ids", "lengths", "words", "tokens").join(by_chunk, "chunk")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = _counts(tuple(col[i].as_py() for col in batch.columns), rest, "rest")
                f2, f1 = _estimates(c.pair, c.context, c.word, rest.tokens)
                with np.errstate(divide="ignore"):
                    q = [np.where(f > 0, np.round(BINS * np.log2(f)), -999).astype(int) for f in (f2, f1)]
                rows, n = np.unique(np.stack([_bucket(c.context), *q], 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int32()) for x in rows.T], pa.array(n, pa.int64())], ["bucket", "q2", "q1", "n"])

    histogram = joined.where(F.col("fold") == WEIGHING).mapInArrow(estimate, "bucket int, q2 int, q1 int, n long").groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).collect()
    mixture = weights([tuple(r) for r in histogram], totals)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = tuple(col[i].as_py() for col in batch.columns)
                c = _counts(row, totals)
                first = np.cumsum(c.lengths) - c.lengths
                f2, f1 = _estimates(c.pair, c.context, c.word, totals.tokens)
                w = mixture[_bucket(c.context)]
                model = np.log10(w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] / (totals.words + 1))
                base = np.log10((c.word + 0.1) / (totals.tokens + 0.1 * (totals.words + 1)))
                n = len(c.lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.doc_ids, pa.int64()), pa.array([row[1] == HELD_OUT] * n), pa.array(c.lengths, pa.int64()), pa.array(np.add.reduceat((c.word > 0).astype(np.int64), first)), pa.array([totals.tokens] * n, pa.int64()), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(model, first))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return joined.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
