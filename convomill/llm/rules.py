"""Quality rules: fixed counts, and how far a text's characters and common words are from its language's.

A text has two histograms: its characters by class, and its words by common
word of its language (a class for all others). The reference of a language is
the mean of its documents' histograms, each document with the same weight. The
Jensen-Shannon distance (root of the divergence in bits, from 0 to 1) between
text and reference decides (of words with an allowance for the noise of a
sample of so many), and only where the text is long enough for its
histogram to say something: FEW_CHARS characters, FEW_WORDS words.

The common words of a language are the COMMON words of at most WORD_BYTES
bytes that most of its documents hold. References are fitted twice, so that a
source full of junk does not become the norm: first each class's median over
the documents that pass the fixed rules (in steps of 1 / STEPS, counted, not
sorted), then the mean over those of them that are near the medians, with the
bounds widened by LOOSE. Only the
LANGUAGES largest languages of at least LEAST_DOCUMENTS documents have a
reference; a text of another language, or of none, is held against the nearest
reference of characters alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

SYMBOLS = "#*$%&|<>"
#: Classes of characters; letters beyond ASCII are one class, and so is all else.
CLASSES = ("lower", "upper", "digit", "blank", "stop", "symbol", "wide")
COMMON, WORD_BYTES, LANGUAGES, LEAST_DOCUMENTS = 32, 8, 256, 10
FEW_CHARS, FEW_WORDS = 300, 100
FAR_CHARS, FAR_WORDS = 0.28, 0.33
#: Bits by which the words of a text stray from their own law: divided by their number.
NOISE = COMMON / (8 * math.log(2))
LOOSE, STEPS, PARTS = 1.25, 1000, 64
MIN_WORDS, REPEATED, WINDOW = 10, 20, 5
#: Words counted before they are sent on, texts taken apart at once, bytes counted at once.
FLUSH, ROWS, SLICE = 400_000, 256, 1 << 20

_BLANK = b" \t\n\x0b\x0c\r"
_CLASS = np.full(256, 6, np.int64)
_CLASS[128:192] = 7  # later bytes of a character
_CLASS[:128] = 5
for _b in range(128):
    _c = chr(_b)
    if _c.islower():
        _CLASS[_b] = 0
    elif _c.isupper():
        _CLASS[_b] = 1
    elif _c.isdigit():
        _CLASS[_b] = 2
    elif _b in _BLANK:
        _CLASS[_b] = 3
    elif _c in ".,;:!?'\"()-":
        _CLASS[_b] = 4
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ENDS = b".,;:!?'\"()-"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of width words that occur twice or more in the text; windows are compared by exact names, pair by pair."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    names, size = ids, 1
    while size < width:
        step = min(size, width - size)  # windows of size + step words are two of size words that may overlap
        both = names[: len(names) - step] * len(words) + names[step:]
        size += step
        if size < width:
            names = np.unique(both, return_inverse=True)[1]
        else:
            names = both
    s = np.sort(names)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    place = np.minimum(np.searchsorted(twice, names), len(twice) - 1)
    again = np.flatnonzero(twice[place] == names)
    inside = np.zeros(len(words), bool)
    for k in range(width):
        inside[again + k] = True
    return int(inside.sum())


def class_counts(data: bytes) -> np.ndarray:
    """Characters of each class; bytes are counted in slices, so a very long text takes no more room."""
    view = np.frombuffer(data, np.uint8)
    counts = sum((np.bincount(view[at : at + SLICE], minlength=256) for at in range(0, len(view), SLICE)), np.zeros(256, np.int64))
    return np.bincount(_CLASS, counts, minlength=8)[:7].astype(np.int64)


def _plain(words: list[bytes]) -> list[bytes]:
    """Words as they are counted: A-Z in lower case, without sentence marks around, short ones only."""
    return [w for w in (x.strip(_ENDS) for x in words) if 0 < len(w) <= WORD_BYTES]


def common_words(documents: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, word, rank from 0: the COMMON words of each of the largest languages; ties to the smaller word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        docs: Counter = Counter()

        def full() -> pa.RecordBatch:
            rows = [(k, w, n) for k, c in held.items() for w, n in c.items()] + [(k, b"", n) for k, n in docs.items()]
            held.clear()
            docs.clear()
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())], ["lang", "word", "n"])

        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(name, Counter()).update(set(_plain(body.encode("utf-8", "surrogatepass").translate(_LOWER).split())))
                docs[name] += 1
            if sum(map(len, held.values())) > FLUSH:
                yield full()
        yield full()

    parts = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string"), F.col(text).cast("string")).mapInArrow(count, "lang string, word binary, n long")
    counts = written(parts.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    largest = counts.where((F.col("word") == F.lit(b"")) & (F.col("n") >= LEAST_DOCUMENTS)).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    rows = counts.where(F.col("word") != F.lit(b"")).join(F.broadcast(largest), "lang").withColumn("part", F.pmod(F.xxhash64("word"), F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):  # a large language in parts, then the parts' first words
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "word")) - 1).where(F.col("rank") < COMMON)
    return rows.select("lang", "word", "rank")


_FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<long>"


def features(documents: DataFrame, common: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """key, lang (null if it has no reference), the fixed counts, and the histograms: classes, and common (counts by rank, all other words last)."""
    table: dict[str, dict[bytes, int]] = {}
    for r in common.collect():  # at most COMMON * LANGUAGES short words
        table.setdefault(r["lang"], {})[bytes(r["word"])] = r["rank"]
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            langs, rows = [], []
            for name, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                body = body or ""
                data = body.encode("utf-8", "surrogatepass")
                words = data.split()
                lines = [x for x in data.split(b"\n") if x.strip(_BLANK)]
                classes = class_counts(data)
                own, found = ranks.get(name), []
                langs.append(name if own is not None else None)
                if own is not None:
                    counts = Counter(map(own.get, (w.strip(_ENDS) for w in data.translate(_LOWER).split())))
                    found = [counts.get(i, 0) for i in range(COMMON)]
                    found.append(len(words) - sum(found))
                rows.append((len(words), len(body) - int(classes[3]), sum(map(body.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), classes.tolist(), found))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["key", "lang", *[c.split()[0] for c in _FEATURES.split(", ")]])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("key"), F.col(lang).cast("string"), F.col(text).cast("string")).mapInArrow(measure, f"key {kind}, lang string, {_FEATURES}").withColumnRenamed("key", key)


def shares(counts: Column) -> Column:
    """A histogram as shares of its sum; null where the sum is nothing."""
    whole = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(whole > 0, F.transform(counts, lambda x: x / whole))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares: the root of the divergence in bits."""
    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    bits = F.aggregate(F.zip_with(p, q, lambda x, y: term(x, y) + term(y, x)), F.lit(0.0), lambda a, x: a + x)
    return F.when(bits.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), bits / 2)))


def _mean(column: str, size: int) -> Column:
    return F.array(*[F.avg(F.col(column)[i]) for i in range(size)]).alias(f"{column}_mean")


def _long_enough(measured: DataFrame) -> DataFrame:
    return measured.where("lang is not null and p_common is not null").where((F.col("n_words") >= FEW_WORDS) & (F.col("n_chars") >= FEW_CHARS))


def medians(measured: DataFrame) -> DataFrame:
    """lang, p_classes_mean and p_common_mean: the median share of each class over the documents that are long enough, made to sum to 1."""
    x = _long_enough(measured).select("lang", F.posexplode(F.concat("p_classes", "p_common")).alias("i", "x"))
    steps = x.groupBy("lang", "i", F.floor(F.col("x") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("lang", "i")  # STEPS + 1 rows at most
    half = steps.withColumns({"upto": F.sum("n").over(by.orderBy("step")), "whole": F.sum("n").over(by)}).where("2 * upto >= whole").groupBy("lang", "i").agg(F.min("step").alias("step"))
    listed = half.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "step"))), lambda r: r["step"]).alias("m"))
    k = len(CLASSES)
    return listed.select("lang", shares(F.slice("m", 1, k)).alias("p_classes_mean"), shares(F.slice("m", k + 1, COMMON + 1)).alias("p_common_mean"))


def references(measured: DataFrame) -> DataFrame:
    """lang, p_classes_mean and p_common_mean: the mean shares of the documents that are long enough."""
    return _long_enough(measured).groupBy("lang").agg(_mean("p_classes", len(CLASSES)), _mean("p_common", COMMON + 1))


def distances(measured: DataFrame, means: DataFrame) -> DataFrame:
    """measured with char_distance and word_distance, null where the text is too short or has no reference to be held against."""
    means = F.broadcast(means.select(F.col("lang").alias("ref_lang"), "p_classes_mean", "p_common_mean"))  # at most LANGUAGES rows
    near = measured.join(means, F.col("lang") == F.col("ref_lang"), "left")
    every = F.broadcast(means.agg(F.collect_list("p_classes_mean").alias("every")))  # one row
    nearest = F.array_min(F.transform("every", lambda q: divergence(F.col("p_classes"), q)))
    chars = F.when(F.col("ref_lang").isNotNull(), divergence(F.col("p_classes"), F.col("p_classes_mean"))).otherwise(nearest)
    words = divergence(F.col("p_common"), F.col("p_common_mean"))
    return near.crossJoin(every).withColumns({"char_distance": F.when(F.col("n_chars") >= FEW_CHARS, chars), "word_distance": F.when(F.col("n_words") >= FEW_WORDS, words)}).drop("ref_lang", "p_classes_mean", "p_common_mean", "every")


def _near(wider: float = 1.0) -> Column:
    return (F.coalesce("char_distance", F.lit(0.0)) <= FAR_CHARS * wider) & (F.coalesce("word_distance", F.lit(0.0)) <= F.sqrt((FAR_WORDS * wider) ** 2 + F.lit(NOISE) / F.greatest("n_words", F.lit(1))))


def quality_rules(documents: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Per row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    Null and empty texts have no words, so the fixed rules drop them. Without
    any reference (an empty or very small table) the fixed rules decide alone.
    Repeated rows count each and get a row each. Other columns are not read.
    """
    measured = features(documents, common_words(documents, lang, text), key, lang, text)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    measured = written(measured.withColumns({"base_failed": failed, "n_chars": F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x), "p_classes": shares(F.col("classes")), "p_common": shares(F.col("common"))}))
    passed = measured.where("not base_failed")
    second = references(distances(passed, medians(passed)).where(_near(LOOSE)))
    x = distances(measured, written(second))
    return x.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & _near()).alias("kept"), "char_distance", "word_distance")
