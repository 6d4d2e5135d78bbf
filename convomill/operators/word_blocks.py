"""Word sets of texts in packed blocks, and the pairs of two blocks whose sets are alike.

A block has some thousand texts: their identifiers, and their distinct words
as numbers in a list of 64-bit hashes, packed. Two tables of blocks are held
against each other pair by pair where they lie, so neither words nor meetings
are shuffled: what goes to disk are the blocks, some times, and the pairs found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from ..sources.shared import written

#: Words of a block at most (a text stays whole), classes by which words are counted, meetings and cells that a step has in memory.
WORDS, CLASSES, STEP = 2_000_000, 1 << 20, 1_000_000
SETS = "n binary, asks binary, words binary, hashes binary"


def _packed(words: np.ndarray) -> bytes:
    """Numbers below 2**31, rising within a text: differences, lowest bytes first, compressed."""
    planes = np.diff(words.astype(np.int32), prepend=np.int32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()
    return pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpacked(data: pa.Buffer, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 4 * size), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int32).ravel(), dtype=np.int32)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans, one span after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n, dtype=np.int64) - n


def _sorted_within(words: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """words (below size) rising within each of the texts of n words."""
    key = np.repeat(np.arange(len(n), dtype=np.int64) * size, n) + words
    key.sort()
    return (key % max(1, size)).astype(np.int32)


def _class(hashes: np.ndarray) -> np.ndarray:
    return hashes & (CLASSES - 1)


# --- building ----------------------------------------------------------------


def _gather(texts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of the rows (id, digest, words) of a task."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made, task = [], [0, 0], 0, TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            nonlocal held, size, made
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t.column("words").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.int64()))
            hashes, words = np.unique(np.asarray(lists.flatten(), np.int64), return_inverse=True)
            n = np.asarray(lists.value_lengths(), np.int32)
            whole = lambda c: pa.array([c.combine_chunks().to_pylist()], pa.list_(c.type))
            out = pa.RecordBatch.from_arrays([pa.array([task << 20 | made]), pa.array([len(words)]), whole(t.column("id")), whole(t.column("digest")), pa.array([n.tobytes()]), pa.array([_packed(_sorted_within(words.ravel(), n, len(hashes)))]), pa.array([hashes.tobytes()])], ["block", "size", "ids", "digests", "n", "words", "hashes"])
            held, size, made = [], [0, 0], made + 1
            return out

        for batch in batches:
            at = 0
            ends = np.cumsum(np.asarray(batch.column(2).value_lengths(), np.int64))
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                to = min(batch.num_rows, at + texts - size[0], max(at + 1, int(np.searchsorted(ends, before + WORDS - size[1], "right"))))
                held.append(batch.slice(at, to - at))
                size = [size[0] + to - at, size[1] + ends[to - 1] - before]
                at = to
                if size[0] >= texts or size[1] >= WORDS // 2:
                    yield block()
        if held:
            yield block()

    return gather


def _gathered(rows: DataFrame, texts: int) -> DataFrame:
    """Blocks as they come, written: block, size (words), ids, digests, n, words, hashes."""
    rows = rows.where(F.col("norm").isNotNull())
    words = F.array_distinct(F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)))
    rows = rows.select(F.col("rep").alias("id"), F.unhex(F.sha2("norm", 256)).alias("digest"), words.alias("words"))
    kind = rows.schema["id"].dataType.simpleString()
    return written(rows.mapInArrow(_gather(texts), f"block long, size long, ids array<{kind}>, digests array<binary>, n binary, words binary, hashes binary"))


def word_counts(left: DataFrame, right: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many texts have a word, by classes of words: of both sides, and 0 where it is a class of one side only. The order of words and costs depend on them, results do not."""
    def counted(side: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(CLASSES, np.int64)
            for batch in batches:
                for n, words, hashes in zip(*batch.columns, strict=True):
                    h = np.frombuffer(hashes.as_buffer(), np.int64)
                    size = int(np.frombuffer(n.as_buffer(), np.int32).sum())
                    np.add.at(total, _class(h), np.bincount(_unpacked(words.as_buffer(), size), minlength=len(h)))
            found = np.flatnonzero(total)
            for at in range(0, len(found), 100_000):
                part = found[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *[pa.array(total[part] * (side == k)) for k in (0, 1)]], ["word", "l", "r"])

        return count

    both = [x.select("n", "words", "hashes").mapInArrow(counted(i), "word int, l long, r long") for i, x in enumerate((left, right))]
    sums = both[0].unionByName(both[1]).groupBy("word").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).toArrow()
    at, l, r = (np.asarray(sums.column(c), np.int64) for c in ("word", "l", "r"))  # noqa: E741
    df, shared = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    df[at] = l + r
    shared[at] = (l + r) * ((l > 0) & (r > 0))
    return df, shared


def _ordered(threshold: float, matches: int, price: int, df: np.ndarray, shared: np.ndarray, dropping: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One block of the texts of some, those in kept alone if dropping: texts by rising numbers of words, words rarest first, and how many meetings each asks for."""

    def finish(blocks: pa.Table, kept: pa.Table) -> pa.Table:
        ids, sizes, lists, names = [], [], [], []
        at_block, at_place = np.asarray(kept.column("block")), np.asarray(kept.column("place"))
        for row in range(blocks.num_rows):
            of = lambda c: blocks.column(c)[row]  # noqa: B023, E731
            n = np.frombuffer(of("n").as_buffer(), np.int32)
            place = np.sort(at_place[at_block == of("block").as_py()]) if dropping else np.arange(len(n))
            words = _unpacked(of("words").as_buffer(), int(n.sum()))
            lists.append(words[_spans(_starts(n)[place], n[place])])
            ids.append(of("ids").values.take(pa.array(place)))
            sizes.append(n[place])
            names.append(np.frombuffer(of("hashes").as_buffer(), np.int64))
        hashes = np.unique(np.concatenate(names))
        order = np.lexsort((hashes, df[_class(hashes)]))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        words = np.concatenate([rank[np.searchsorted(hashes, h)][w] if len(w) else w for h, w in zip(names, lists, strict=True)])
        n, hashes = np.concatenate(sizes), hashes[order]
        by_size = np.argsort(n, kind="stable")
        words, n = words[_spans(_starts(n)[by_size], n[by_size])], n[by_size]
        words = _sorted_within(words, n, len(hashes))
        asks = _required(words, n, shared[_class(hashes)], threshold, matches, price)
        kind = blocks.schema.field("ids").type
        return pa.table({"ids": pa.array([pa.concat_arrays(ids).take(pa.array(by_size)).to_pylist()], kind), **{k: pa.array([v]) for k, v in (("n", n.tobytes()), ("asks", asks.tobytes()), ("words", _packed(words)), ("hashes", hashes.tobytes()))}})

    return finish


def _required(words: np.ndarray, n: np.ndarray, cost: np.ndarray, threshold: float, matches: int, price: int) -> np.ndarray:
    """How many meetings a text asks for, from 1 to matches: those of the least cost, by how often its words occur on both sides.

    Asking for m meetings joins the first n - least + m words, and leaves at
    most an m-th of what is joined to be compared, each at the price of price
    joined rows.
    """
    least = _least(n, threshold)
    joined = np.concatenate([[0], np.cumsum(cost[words])])
    start = _starts(n)
    best, asks = np.full(len(n), np.inf), np.ones(len(n), np.int32)
    for m in range(1, matches + 1):
        now = (joined[start + np.minimum(n, n - least + m)] - joined[start]) * (1 + price / m)
        better = (m <= least) & (now < best)
        best[better], asks[better] = now[better], m
    return asks


def _least(n: np.ndarray, threshold: float) -> np.ndarray:
    """Words that a text of n shares with any that reaches the threshold, at least."""
    return np.maximum(1, np.ceil(threshold * n - 1e-9)).astype(np.int64)


def word_blocks(left: DataFrame, right: DataFrame, threshold: float, distinct: bool, texts: int, matches: int, price: int) -> tuple[DataFrame, DataFrame]:
    """ids, n, asks, words, hashes: blocks of both sides (rep, norm), written. distinct: of equal texts that of the smallest rep alone."""
    raw = [_gathered(x, texts) for x in (left, right)]
    df, shared = word_counts(*raw)
    out = []
    for x in raw:
        group, made = [], [0, 0, 0]
        for r in x.select("block", "size", F.size("ids").alias("texts")).orderBy("block").collect():  # a row for each block
            if made[0] + r["size"] > WORDS or made[1] + r["texts"] > texts:
                made = [0, 0, made[2] + 1]
            made[0] += r["size"]
            made[1] += r["texts"]
            group.append((r["block"], made[2]))
        parts = [F.broadcast(x.sparkSession.createDataFrame(group, "block long, part int")) for _ in range(2)]
        kept = x.select("block", F.posexplode(F.arrays_zip("ids", "digests")).alias("place", "t")).groupBy("t.digests").agg(F.min(F.struct("t.ids", "block", "place")).alias("k")).select("k.block", "k.place")
        kept = kept if distinct else x.sparkSession.createDataFrame([], "block long, place int")
        kind = x.schema["ids"].dataType.simpleString()
        finish = _ordered(threshold, matches, price, df, shared, distinct)
        out.append(written(x.drop("size", "digests").join(parts[0], "block").groupBy("part").cogroup(kept.join(parts[1], "block").groupBy("part")).applyInArrow(finish, f"ids {kind}, {SETS}")))
    return out[0], out[1]


# --- comparing ---------------------------------------------------------------


class Sets:
    """A block as arrays; number: its words by their number in both blocks, -1 for those of one only."""

    def __init__(self, n: pa.Buffer, asks: pa.Buffer, words: pa.Buffer, hashes: pa.Buffer):
        self.n, self.asks = np.frombuffer(n, np.int32).astype(np.int64), np.frombuffer(asks, np.int32).astype(np.int64)
        self.words, self.hashes, self.start = _unpacked(words, int(self.n.sum())), np.frombuffer(hashes, np.int64), _starts(self.n)
        self.n32, self.number = np.frombuffer(n, np.int32), np.empty(0, np.int32)

    def named(self, places: np.ndarray) -> None:
        number = np.full(len(self.hashes), -1, np.int32)
        number[places] = np.arange(len(places), dtype=np.int32)
        self.number = number[self.words]

    def prefix(self, texts: slice, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, number and words that follow, of each word by which these texts are joined."""
        n, t = self.n[texts], np.arange(texts.start, texts.stop)
        size = np.minimum(n, n - _least(n, threshold) + self.asks[texts])
        at, text = _spans(self.start[texts], size), np.repeat(t, size)
        met = self.number[at] >= 0
        at, text = at[met], text[met]
        return text, self.number[at], (self.n[text] - (at - self.start[text]) - 1).astype(np.int32)


def alike(a: Sets, b: Sets, threshold: float, compare: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of texts in a and in b and their Jaccard, of those that reach the threshold; not compare: of those to be compared, with 0.

    Two sets of x and y words that reach the threshold share o = ceil(t / (1 +
    t) (x + y)) words, so at least m of them lie among the first x - o + m and
    y - o + m, for any m up to o.
    """
    _, pa_, pb = np.intersect1d(a.hashes, b.hashes, assume_unique=True, return_indices=True)
    a.named(pa_)
    b.named(pb)
    common = len(pa_)
    if not common:
        return
    both = np.arange(a.n.max(initial=0) + b.n.max(initial=0) + 1)
    needs = np.maximum(1, np.ceil(threshold / (1 + threshold) * both - 1e-9)).astype(np.int32)  # words to share, by the sum of both sizes
    theirs = b.prefix(slice(0, len(b.n)), threshold)
    at = 0
    while at < len(a.n):
        lo = int(np.searchsorted(b.n, math.ceil(threshold * a.n[at] - 1e-9)))
        to = min(len(a.n), at + 512)
        hi = int(np.searchsorted(b.n, math.floor(a.n[to - 1] / threshold + 1e-9), "right"))
        if lo < hi:
            yield from _chunk(a, b, slice(at, to), lo, hi, theirs, threshold, needs, common, compare)
        at = to


def _chunk(a: Sets, b: Sets, texts: slice, lo: int, hi: int, theirs: tuple[np.ndarray, ...], threshold: float, needs: np.ndarray, common: int, compare: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """alike() for some texts of a, against those from lo to hi of b."""
    text, number, after = a.prefix(texts, threshold)
    order = np.argsort(number, kind="stable")
    text, after, n = text[order], after[order], a.n32[text[order]]
    count = np.bincount(number, minlength=common).astype(np.int32)
    first = (np.cumsum(count) - count).astype(np.int32)
    b_text, b_number, b_after = theirs
    begin, end = np.searchsorted(b_text, [lo, hi])
    times = count[b_number[begin:end]]
    place = begin + np.flatnonzero(times)
    times, b_text, b_number, b_after = times[times > 0], b_text[place], b_number[place], b_after[place]
    ends = np.cumsum(times, dtype=np.int64)
    # meetings at places too late for any number of meetings that the two ask for need not be counted
    late = needs - np.minimum(needs, max(a.asks[texts].max(initial=1), b.asks.max(initial=1))).astype(np.int32)
    at, wide = 0, hi - lo
    met = []
    while at < len(place):
        # texts of b are whole in a step, but for one that alone is more than a step
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right"))
        if to < len(place):
            whole = int(np.searchsorted(b_text, b_text[to]))
            to = whole if whole > at else int(np.searchsorted(b_text, b_text[at], "right"))
        k = times[at:to]
        stop = np.cumsum(k, dtype=np.int32)
        mine = np.arange(stop[-1], dtype=np.int32)
        mine += np.repeat(first[b_number[at:to]] - (stop - k), k)
        least = late[n[mine] + np.repeat(b.n32[b_text[at:to]], k)]
        early = np.flatnonzero(np.minimum(after[mine], np.repeat(b_after[at:to], k)) >= least)
        l, r = text[mine[early]], np.repeat(b_text[at:to], k)[early]  # noqa: E741
        key = (l - texts.start) * wide + (r - lo)
        cells = (texts.stop - texts.start) * wide
        if cells < 10 * len(key):
            times_met = np.bincount(key, minlength=cells)
            key = np.flatnonzero(times_met)
            times_met = times_met[key]
        else:
            key, times_met = np.unique(key, return_counts=True)
        l, r = key // wide + texts.start, key % wide + lo  # noqa: E741
        asked = np.minimum(np.minimum(a.asks[l], b.asks[r]), needs[a.n[l] + b.n[r]])
        good = (times_met >= asked) & (np.minimum(a.n[l], b.n[r]) >= threshold * np.maximum(a.n[l], b.n[r]) - 1e-9)
        met.append((l[good], r[good]))
        at = to
    if not met:
        return
    l, r = (np.concatenate(x) for x in zip(*met, strict=True))  # noqa: E741
    order = np.argsort(l, kind="stable")
    l, r = l[order], r[order]  # noqa: E741
    if not compare:
        yield l, r, np.zeros(len(l))
        return
    same = _shared(a, b, l, r, common)
    score = same / (a.n[l] + b.n[r] - same)
    near = score >= threshold
    yield l[near], r[near], score[near]


def _shared(a: Sets, b: Sets, l: np.ndarray, r: np.ndarray, common: int) -> np.ndarray:  # noqa: E741
    """How many words the texts of each pair share; l is rising."""
    rows = max(1, 16 * STEP // (common + 1))
    has = np.zeros((min(rows, len(l)), common + 1), bool)  # the last column is the number -1
    out, at = np.zeros(len(l), np.int64), 0
    ends = np.cumsum(b.n[r])
    while at < len(l):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
        mine, row = np.unique(l[at:to], return_inverse=True)
        if len(mine) > rows:
            to = at + int(np.searchsorted(row, rows))
            mine, row = mine[:rows], row[: to - at]
        which, words = np.repeat(np.arange(len(mine)), a.n[mine]), a.number[_spans(a.start[mine], a.n[mine])]
        which, words = which[words >= 0], words[words >= 0]
        has[which, words] = True
        n = b.n[r[at:to]]
        hit = has[np.repeat(row, n), b.number[_spans(b.start[r[at:to]], n)]]
        out[at:to] = np.add.reduceat(hit, _starts(n), dtype=np.int64)
        has[which, words] = False
        at = to
    return out


def alike_pairs(left: DataFrame, right: DataFrame, threshold: float, compare: bool = True) -> DataFrame:
    """left_id, right_id, jaccard of all pairs of blocks; each task reads the blocks of its pairs where they were written."""
    columns = ["ids", "n", "asks", "words", "hashes"]
    sides = [x.select(*[F.col(c).alias(f"{s}_{c}") for c in columns]) for s, x in (("l", left), ("r", right))]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                of = lambda c: batch.column(c)[row]  # noqa: B023, E731
                a, b = (Sets(*[of(f"{s}_{c}").as_buffer() for c in columns[1:]]) for s in "lr")
                for l, r, score in alike(a, b, threshold, compare):  # noqa: E741
                    for at in range(0, len(l), 100_000):
                        part = slice(at, at + 100_000)
                        yield pa.RecordBatch.from_arrays([of("l_ids").values.take(pa.array(l[part])), of("r_ids").values.take(pa.array(r[part])), pa.array(score[part], pa.float64())], ["left_id", "right_id", "jaccard"])

    def element(df: DataFrame) -> DataType:
        kind = df.schema["ids"].dataType
        assert isinstance(kind, ArrayType)
        return kind.elementType

    pairs = sides[0].crossJoin(sides[1].hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(match, f"left_id {element(left).simpleString()}, right_id {element(right).simpleString()}, jaccard double")
