"""Runs of repeated words by Lyndon roots, from the first phase of Baier's suffix sorter.

A run is a stretch of words with smallest period q, at least max(least, 2 q)
long, that no neighbouring word extends. The first phase of the sorter takes
groups of suffixes from the highest down; each suffix hands its context to the
nearest suffix on its left in a lower group, and those that received the same
number of contexts from one group move together to a new group behind their
old one. What a suffix has gathered in the end is its longest Lyndon factor,
so the Lyndon array comes out directly, without a suffix array. Every run has
a root among these factors under the order of the words or under the reverse
order; each factor is extended to both sides by its longest common extensions
with its copy one period on.

Extensions compare names of windows of 2**k words: equal names, equal words.

Within a run of length L >= max(least, 2 q) each word lies in a window of
ceil(least / 2) words that occurs again in the text: windows from the run's
start recur q words later, those up to its end q words before. So only
stretches covered by such windows can hold runs, and runs never leave them;
other words are not sorted at all. The windows are found by hashes, where a
collision only adds words to a stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: Words whose windows are named together; a longer stretch is named alone.
TOGETHER = 1 << 20
#: Texts that are taken apart at once.
ROWS = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def words_of(text: str | None) -> list[bytes]:
    """Words divided by the six ASCII white space characters, which is what bytes are split by."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def lyndon_array(ids: list[int]) -> list[int]:
    """Length of the longest Lyndon factor from each place, for dense ids from 0 in the order of the alphabet."""
    n = len(ids)
    length, prev, done, group = [1] * n, [-1] * n, bytearray(n), list(ids)
    members: list[list[int]] = [[] for _ in range(max(ids, default=-1) + 1)]
    for i, g in enumerate(ids):
        members[g].append(i)
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]  # others have moved on
        members[g] = []
        if len(own) > 1:
            own.sort()
        given: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            done[i] = 1
            if j >= 0:
                given[j] = given.get(j, 0) + 1
        if given:
            moves: dict[tuple[int, int], list[int]] = {}
            size = length[own[0]]
            for j, times in given.items():
                length[j] += times * size
                moves.setdefault((times, group[j]), []).append(j)
            # the highest numbers first: those that come later push them up
            for times, old in sorted(moves, reverse=True) if len(moves) > 1 else moves:
                new = len(members)
                who = moves[times, old]
                members.append(who)
                for j in who:
                    group[j] = new
                over = above[old]
                below.append(old)
                above.append(over)
                above[old] = new
                if over >= 0:
                    below[over] = new
        g = below[g]
    return length


def _stretches(words: list[bytes], least: int) -> list[tuple[int, int]]:
    """Where runs can be: [start, end) of at least least words, each in a window that occurs twice or more."""
    n, width = len(words), (least + 1) // 2
    if n < least:
        return []
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    g = h[: n - width + 1].copy()
    for k in range(1, width):
        g *= _ODD
        g += h[k : n - width + 1 + k]
    s = np.sort(g)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return []
    place = np.searchsorted(twice, g)
    again = np.flatnonzero(twice[np.minimum(place, len(twice) - 1)] == g)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    inside = np.concatenate([[0], np.cumsum(edge[:n]) > 0, [0]]).astype(np.int8)
    turns = np.flatnonzero(np.diff(inside)).reshape(-1, 2)
    return [(int(a), int(b)) for a, b in turns if b - a >= least]


class _Names:
    """Names of all windows of 2**k words of a sequence, for k up to the first without a repeat."""

    def __init__(self, ids: np.ndarray):
        self.levels = [ids]
        while len(self.levels[-1]) > (half := 1 << (len(self.levels) - 1)):
            last = self.levels[-1]
            both = last[:-half].astype(np.int64) * (int(last.max()) + 1) + last[half:]
            distinct, names = np.unique(both, return_inverse=True)
            if len(distinct) == len(both):
                break
            self.levels.append(names.astype(np.int32))

    def common(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How far the sequences from i and j (back: those that end before i and j) agree."""
        i, j, got = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, step = self.levels[k], 1 << k
            a, b = (i - step, j - step) if back else (i, j)
            ok = (a >= 0) & (b < len(names))  # i is before j
            same = np.zeros(len(i), bool)
            same[ok] = names[a[ok]] == names[b[ok]]
            move = np.where(same, step, 0)
            got += move
            i, j = (i - move, j - move) if back else (i + move, j + move)
        return got


def _runs_of(parts: list[list[int]], least: int) -> list[list[Run]]:
    """Runs of each sequence of dense ids, by start, then period."""
    gap, at, pieces, starts, periods, owner = 0, 1, [], [], [], []
    base = sum(max(p) + 1 for p in parts)
    pieces.append(np.array([base]))
    for k, ids in enumerate(parts):
        a = np.asarray(ids, np.int64)
        high = int(a.max())
        for order in (ids, (high - a).tolist()):
            starts.append(np.arange(len(a)) + at)
            periods.append(np.asarray(lyndon_array(order), np.int64))
            owner.append(np.full(len(a), k))
        pieces += [a + gap, [base + 1 + k]]
        gap, at = gap + high + 1, at + len(a) + 1
    names = _Names(np.concatenate(pieces).astype(np.int32))
    i, p, k = np.concatenate(starts), np.concatenate(periods), np.concatenate(owner)
    right, left = names.common(i, i + p), names.common(i, i + p, back=True)
    length = left + p + right
    first = i - left
    keep = length >= np.maximum(least, 2 * p)
    found = np.unique(np.stack([k[keep], first[keep], p[keep], length[keep]], 1), axis=0)
    offset = np.cumsum([1, *[len(x) + 1 for x in parts]])
    out: list[list[Run]] = [[] for _ in parts]
    for part, start, period, size in found.tolist():
        out[part].append((start - int(offset[part]), size, period))
    return out


def text_runs(texts: list[list[bytes]], least: int = LEAST) -> list[list[Run]]:
    """(start, length, period) of each text's runs, by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    waiting: list[tuple[int, int, list[int]]] = []

    def settle() -> None:
        for (which, start, _), runs in zip(waiting, _runs_of([w[2] for w in waiting], least) if waiting else [], strict=True):
            out[which] += [(start + s, size, period) for s, size, period in runs]
        waiting.clear()

    size = 0
    for which, words in enumerate(texts):
        for a, b in _stretches(words, least):
            if size + b - a > TOGETHER:
                settle()
                size = 0
            known: dict[bytes, int] = {}
            waiting.append((which, a, [known.setdefault(w, len(known)) for w in words[a:b]]))
            size += b - a
    settle()
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Without the words that lie in a run after that run's first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        edge[start + period] += 1
        edge[start + size] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Per document: key, n_words, runs (array of start, length, period, by start, then period) and collapsed (its words outside repetitions, joined by single spaces).

    Null and empty texts have no words and no runs, and collapse to the empty
    text. Rows are taken one by one: repeated rows and null keys give a row
    each. Other columns are not read. A text is held whole by its task.
    """
    kind = documents.schema[key].dataType.simpleString()
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            found = text_runs(words, least)
            short = [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(words, found, strict=True)]
            listed = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
            columns = [batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(listed, run), pa.array(short, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "runs", "collapsed"])

    found = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(find, f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.withColumnRenamed("key", key)


def longest_run(runs: Column) -> Column:
    """Of an array of runs the longest, ties to the smaller start, then period; null without one."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def run_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """What periodic_runs() gives as key, n_runs, start, length, period and exponent_milli of the longest run, and digests of all runs and of the collapsed text."""
    best = longest_run(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    x = found.select(key, "runs", best.alias("best"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return x.select(
        key, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256",
    )
