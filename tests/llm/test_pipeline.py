import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from convomill.llm import quality
from convomill.llm.storage import written
from test_jaccard import brute as components
from test_pii import brute as personal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frames(spark):
    """The documents, and what each stage makes of its predecessor's."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF)))
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages_keep_columns_and_all_take_effect(frames):
    docs, counts = frames[0], [f.count() for f in frames[:-1]]
    assert all(f.columns == docs.columns for f in frames[:-1])
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4]
    packed = frames[-1]
    assert packed.select("doc_id").distinct().count() == counts[4]
    assert "@" not in " ".join(w for r in frames[4].collect() for w in r.text.split() if "example.com" in w)


def test_classifier_row_by_row(spark, frames):
    """The stage keeps what the fitted model accepts, each document scored by itself, and no other."""
    docs, labels = frames[0], spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fitted(docs, labels)
    rows = docs.collect()
    words = lambda t: np.unique(np.concatenate([(h >> np.uint64(32)).astype(np.uint32) for marks in (True, False) for h in quality.word_hashes([t], marks=marks)]))
    score = {r.doc_id: model.scores([words(r.text)], quality.metadata([r.text], [r.lang], [r.source]))[0, 2] for r in rows}
    assert set(texts(frames[1])) == {d for d, s in score.items() if s >= quality.THRESHOLD}


def test_near_duplicates_equal_brute_force(frames):
    before = sorted(texts(frames[1]).items())
    first = components(before, 5, 80, 100)
    assert texts(frames[2]) == {d: t for d, t in before if first[d][1] == d}


def test_decontamination_between_two_bounds(spark, frames):
    """Documents that hold six of an item's windows of eight words, or all of a shorter one's, go; those that share no window of eight template words stay."""
    plain = lambda t: re.findall(r"[^\W_]+", t.lower())
    blurred = lambda t: ["#" if re.search("[0-9]", w) else w for w in plain(t)]
    windows = lambda w: {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept, gone = set(texts(frames[3])), 0
    for d, t in texts(frames[2]).items():
        hits = [len(windows(plain(t)) & windows(plain(i))) for i in items]
        if any(n >= min(6, len(windows(plain(i)))) for n, i in zip(hits, items, strict=True) if len(plain(i)) >= 8):
            assert d not in kept
            gone += 1
        elif not any(windows(blurred(t)) & windows(blurred(i)) for i in items):
            assert d in kept
    assert gone == len(texts(frames[2])) - len(kept)


def test_personal_data_are_gone_and_nothing_else(frames):
    new = texts(frames[4])
    for d, t in texts(frames[3]).items():
        spans = personal(t)
        parts, end = [], 0
        for kind, s, e in spans:
            if s >= end:
                parts += [t[end:s], f"<{kind.upper()}>"]
            end = max(end, e)
        assert new[d] == "".join([*parts, t[end:]]) or len(new[d]) < len(t)
        if not re.search("[0-9@]", t):
            assert new[d] == t


def test_packing_holds_each_id_once(frames):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, used = {}, {}
    for r in frames[-1].collect():
        pieces.setdefault(r.doc_id, []).append(r)
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, t in texts(frames[4]).items():
        ids, at = [*whole.encode(t or "", add_special_tokens=False).ids, 1], 0
        for p in sorted(pieces[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_null_and_clashing_columns(spark):
    names = ["text_hash", "rep", "h", "cell", "part", "score", "length"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    rows = [(1, None, None, None, None, *[None] * 7), (2, "", "en", "s", 0, *"abcdefg"), (3, "some words of one text that is here twice", "en", "s", 40, *"abcdefg"), (4, "some words of one text that is here twice", None, "t", 40, *"abcdefg"), (None, "a text without an identifier", "en", "s", 9, *"abcdefg")]
    for docs, left in ((spark.createDataFrame(rows, schema), 4), (spark.createDataFrame([], schema), 0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = written(stage(spark, docs, SF))
            assert i == 4 or [f.name for f in docs.schema] == [*["doc_id", "text", "lang", "source", "n_chars"], *names]
        assert docs.select(F.coalesce("doc_id", F.lit(-1))).distinct().count() == left


def test_long_texts_ties_and_repeated_rows(spark):
    """A text of over a megabyte with a copy and a near copy, equal rows, and texts that differ in their identifiers alone: equal ones are judged alike, the smallest identifier stays, all ids are packed."""
    rng = np.random.default_rng(2)
    vocab = [r.text.split()[0] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 20").limit(150).collect()]
    long = " ".join(np.array(vocab)[rng.integers(len(vocab), size=200_000)])
    near = long.replace(" ", " changed ", 1)
    short = " ".join(np.array(vocab)[rng.integers(len(vocab), size=60)])
    rows = [(20, long), (10, long), (30, near), (40, short), (40, short), (41, short), (50, short[::-1])]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(long) > 1_000_000
    judged = written(corpus_pipeline.classify(spark, docs, SF))
    kept = {r.doc_id for r in judged.select("doc_id").distinct().collect()}
    assert len(kept & {10, 20}) in (0, 2) and len(kept & {40, 41}) in (0, 2)
    single = written(corpus_pipeline.near_duplicates(spark, docs, SF))
    assert sorted(r.doc_id for r in single.select("doc_id").collect()) == [10, 40, 40, 50]
    clean = written(corpus_pipeline.redact(spark, written(corpus_pipeline.decontaminate(spark, single, SF)), SF))
    assert sorted(r.doc_id for r in clean.select("doc_id").collect()) == [10, 40, 40, 50]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {r.doc_id: len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in clean.collect()}
    got = {r.doc_id: r.n for r in corpus_pipeline.pack(spark, clean, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == {d: k * (2 if d == 40 else 1) for d, k in n.items()}
