import random

import numpy as np

from convomill.llm import quality


def corpus(n=1500):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(600)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        kind = rng.choice(["good"] * 7 + ["toxic", "toxic", "junk"])
        if kind == "toxic":
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vilea,", "vileb", "Vilec."]))
        if kind == "junk":
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "en", f"src{i % 5}", kind))
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    odd = [(9000, None, None, None, "odd"), (9001, "", "en", "x", "odd"), (9002, "w " * 100000, "en", "x", "odd"), (None, "abcd", "en", "x", "odd")]
    docs = spark.createDataFrame([(*r[:4], 1.0) for r in rows + odd], "doc_id long, text string, lang string, source string, score double")
    table = spark.createDataFrame(labels + labels[:3], "doc_id long, quality int, toxic int")
    model = quality.fitted(docs, table)
    got = {r.doc_id: r.accepted for r in quality.scored(docs, model).collect()}
    assert len(got) == len(rows) + len(odd)
    unseen = [r for r in rows if r[0] % 2 == 0]
    assert np.mean([got[r[0]] == (r[4] == "good") for r in unseen]) > 0.95
    assert np.mean([got[r[0]] for r in unseen if r[4] == "good"]) > 0.98
    kept = quality.accepted_documents(docs, table)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if v}


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.accepted for r in quality.scored(docs, quality.fitted(docs, none)).collect()] == [True, True]
    assert quality.accepted_documents(docs, none).count() == 2
    assert quality.scored(docs.limit(0), quality.fitted(docs.limit(0), none)).count() == 0


def test_every_document_labelled_and_texts_of_one_identifier(spark):
    rows, _ = corpus(300)
    twice = [(7, "another text", "en", "x", "odd"), (7, rows[7][1], "en", "src2", "good")]
    docs = spark.createDataFrame([(*r[:4], r[4]) for r in rows + twice], "doc_id long, text string, lang string, source string, y string")
    labels = spark.createDataFrame([(r[0], int(r[4] != "junk"), int(r[4] == "toxic")) for r in rows] + [(None, 1, 0), (9999, None, None)], "doc_id long, quality int, toxic int")
    first, again = (quality.sampled(d, labels) for d in (docs, docs.orderBy(docs["text"].desc())))
    assert first.count() == 300 and first.where("pool is not null").count() > 30
    key = lambda r: r.doc_id
    assert sorted(first.collect(), key=key) == sorted(again.collect(), key=key)
    scores = {(r.doc_id, r.score) for r in quality.scored(docs, quality.co_train(first)).collect()}
    assert scores == {(r.doc_id, r.score) for r in quality.scored(docs, quality.co_train(again)).collect()}


def test_few_labels_reject_junk(spark):
    """What is known to be bad goes at the smallest size too."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.accepted_documents(docs, labels).join(labels, "doc_id")
    assert kept.where("quality = 0").count() < 0.5 * labels.where("quality = 0").count()
    assert kept.where("quality = 1 and toxic = 0").count() == labels.where("quality = 1 and toxic = 0").count()
