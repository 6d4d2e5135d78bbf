"""Prefix trie of conversations, with a skeleton of the paths that split it.

A conversation's path is its turns in order, each a 16-byte digest of role and
text. Equal paths are one row with its members. Splitters are quantiles of a
bounded sample of paths; they cut the order of paths into shards. Only a node
whose members lie on both sides of a splitter has members in two shards, and
such a node is a prefix of that splitter. So the trie of the splitters' own
prefixes, the skeleton, is broadcast (at most SHARDS * DEPTH nodes), every
shard is sorted and walked once, and finishes all nodes outside the skeleton;
of skeleton nodes it gives partial sums, which are added up and then carried
from the skeleton's leaves to its root.

A walk keeps only the nodes that the path at hand shares with the one before
or after it, or with the skeleton. The nodes below those have one path each:
their figures are running sums from its end.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 64
#: Shards at most, turns of a splitter that count, paths sampled for each shard, rows to a batch.
SHARDS, DEPTH, SAMPLED, ROWS = 1024, 256, 20, 50_000
SIZE = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_WALKED = f"{NODE}, words long, skeleton int, parent_skeleton int"


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path (SIZE bytes a turn) and words (of each turn's text) of every conversation.

    Turns are ordered by turn (null first), then role, then text; null role
    or text: empty. Rows without conv_id belong to no conversation. Other
    columns are not read. Turns are put in order in blocks of turn numbers,
    and only their digests and counts are gathered: a path must fit in a row.
    """
    t = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("block"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    t = t.withColumn("i", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")))
    token = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    t = t.select("conv_id", "block", "i", token.alias("token"), F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("n"))
    rows = F.array_sort(F.collect_list(F.struct("i", "token", "n")))
    blocks = t.groupBy("conv_id", "block").agg(rows.alias("r")).select("conv_id", "block", F.array_join("r.token", "").alias("path"), F.col("r.n").alias("words"))
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "path", "words"))).alias("b"))
    return whole.select("conv_id", F.unhex(F.array_join("b.path", "")).alias("path"), F.flatten("b.words").alias("words"))


def headed(paths: DataFrame, heads: DataFrame, base: str, n: str) -> DataFrame:
    """paths with their first n turns replaced by those of the path (of heads) whose conv_id is base; columns by name. A path without a base loses its first n turns."""
    most = heads.select(F.col("conv_id").alias("head_id"), F.col("path").alias("head_path"), F.col("words").alias("head_words"))
    x = paths.join(most, F.col(base) == F.col("head_id"), "left")
    none, no_words = F.lit(b""), F.array().cast("array<int>")
    cut = (F.col(n) * SIZE).cast("int")
    path = F.concat(F.coalesce(F.substring("head_path", F.lit(1), cut), none), F.substring("path", cut + 1, F.length("path")))
    words = F.concat(F.coalesce(F.slice("head_words", F.lit(1), F.col(n)), no_words), F.slice("words", F.col(n) + 1, F.size("words") + 1))
    return x.select("conv_id", path.alias("path"), words.alias("words"))


def shared_turns(a: bytes, b: bytes) -> int:
    """How many leading turns two paths share."""
    n = min(len(a), len(b))
    if a[:SIZE] != b[:SIZE] or not n:
        return 0
    if a[:n] == b[:n]:
        return n // SIZE
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // SIZE


class _Node:
    __slots__ = ("depth", "conv", "n", "children", "leaves", "saved", "words", "ends", "skeleton", "rows")

    def __init__(self, depth: int, words: int, skeleton: int | None):
        self.depth, self.words, self.skeleton = depth, words, skeleton
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.rows = NO_ENDS, []

    def met(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n += n

    def has(self, leaves: int, saved: int) -> None:
        self.children += 1
        self.leaves += leaves
        self.saved += saved


class _Walk:
    """Takes the sorted paths of one shard; rows gathers what is finished."""

    def __init__(self, index: dict[bytes, int], low: bytes, high: bytes):
        self._index, self._low, self._high = index, low, high
        self._stack = [_Node(0, 0, index[b""])]
        self._before: tuple | None = None
        self._shared = 0
        self.rows: list[tuple] = []

    def take(self, row: tuple | None) -> None:
        """The next path (path, conv, n, words, ends); None ends the shard."""
        shared = shared_turns(self._before[0], row[0]) if row and self._before else 0
        if self._before:
            self._put(*self._before, shared)
        self._before, self._shared = row, shared
        if row is None:
            while self._stack:
                self._pop()

    def _put(self, path: bytes, conv: int, n: int, words: np.ndarray, ends: str, after: int) -> None:
        own, stack = len(path) // SIZE, self._stack
        while stack[-1].depth > self._shared:
            self._pop()
        known = max(shared_turns(path, self._low), shared_turns(path, self._high))
        kept = max(self._shared, after, known)
        for d in range(self._shared + 1, kept + 1):
            stack.append(_Node(d, int(words[d - 1]), self._index.get(path[: SIZE * d]) if d <= known else None))
        top = stack[-1]
        top.met(conv, n)
        if own == kept:
            top.ends = ends
            return
        saved = np.cumsum((n - 1) * words[kept:][::-1].astype(np.int64))[::-1].tolist()
        self._give(top, (conv, kept + 1, None, n, int(own > kept + 1), 1, saved[0], ends if own == kept + 1 else NO_ENDS))
        for d in range(kept + 2, own + 1):
            self.rows.append((conv, d, conv, n, int(d < own), 1, saved[d - kept - 1], ends if d == own else NO_ENDS, None, None, None))
        top.has(1, saved[0])

    def _give(self, parent: _Node, row: tuple) -> None:
        """A finished node waits for its parent's smallest member; where that is a skeleton node, for the whole table's."""
        if parent.skeleton is None:
            parent.rows.append(row)
        else:
            self.rows.append((*row, None, None, parent.skeleton))

    def _pop(self) -> None:
        x = self._stack.pop()
        self.rows += [(r[0], r[1], x.conv, *r[3:], None, None, None) for r in x.rows]
        if x.skeleton is not None:
            if x.n:
                self.rows.append((x.conv, x.depth, None, x.n, x.children, x.leaves, x.saved, x.ends, x.words, x.skeleton, None))
        else:
            x.saved += (x.n - 1) * x.words
            x.leaves = x.leaves or 1
            self._give(self._stack[-1], (x.conv, x.depth, None, x.n, x.children, x.leaves, x.saved, x.ends))
            self._stack[-1].has(x.leaves, x.saved)
        if self._stack and x.n:
            self._stack[-1].met(x.conv, x.n)


def splitters_of(distinct: DataFrame, shards: int) -> list[bytes]:
    """At most shards - 1 paths, of DEPTH turns at most, in order: quantiles of the SAMPLED * shards paths of the smallest hashes."""
    h = F.xxhash64("path")
    sample = sorted(bytes(r["s"]) for r in distinct.select(h.alias("h"), F.substring("path", 1, SIZE * DEPTH).alias("s")).orderBy("h").limit(SAMPLED * shards).collect())
    return sorted({sample[len(sample) * i // shards] for i in range(1, shards)} - {b""}) if sample else []


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """NODE: one row for each distinct prefix of the paths (conv_id, path, words, as conversation_paths() gives them).

    conv_id is the smallest member, parent_conv_id the parent's (null for the
    root, the empty prefix, of which every conversation is a member). n_leaves
    and saved_tokens count a node's whole subtree, itself included;
    ends_sha256 is the digest of the decimal identifiers, ascending and
    joined by commas, of the conversations that end there. No conversation:
    no row. Conversations with equal turns are members of the same nodes.
    """
    spark = paths.sparkSession
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    distinct = written(paths.groupBy("path").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n"), F.first("words").alias("words"), F.sha2(ids, 256).alias("ends")))
    cuts = splitters_of(distinct, min(SHARDS, shards or int(spark.conf.get("spark.sql.shuffle.partitions"))))
    prefixes = sorted({c[:at] for c in cuts for at in range(0, len(c) + 1, SIZE)} | {b""}, key=lambda p: (len(p), p))
    index = {p: i for i, p in enumerate(prefixes)}
    shared = spark.sparkContext.broadcast((cuts, index))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, _ = shared.value
        for batch in batches:
            shard = pa.array([bisect_right(cuts, p) for p in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, shard], [*batch.schema.names, "shard"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, index = shared.value
        now, state, done = None, None, []

        def full(least: int) -> Iterator[pa.RecordBatch]:
            if len(done) > least:
                kinds = [pa.int64()] * 7 + [pa.string(), pa.int64(), pa.int32(), pa.int32()]
                names = [c.split()[0] for c in _WALKED.split(", ")]
                for at in range(0, len(done), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done[at : at + ROWS], strict=True), kinds, strict=True)], names)
                done.clear()

        for batch in batches:
            words, offsets = np.asarray(batch.column(3).flatten()), np.asarray(batch.column(3).offsets)
            offsets = offsets - offsets[0]
            rows = zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)), strict=True)
            for k, (path, conv, n, ends, shard) in enumerate(rows):
                if shard != now:
                    if state:
                        state.take(None)
                        done += state.rows
                    now, state = shard, _Walk(index, cuts[shard - 1] if shard else b"", cuts[shard] if shard < len(cuts) else b"")
                state.take((path, conv, n, words[offsets[k] : offsets[k + 1]], ends))
                if len(state.rows) > ROWS:
                    done += state.rows
                    state.rows.clear()
                    yield from full(ROWS)
        if state:
            state.take(None)
            done += state.rows
        yield from full(0)

    dealt = distinct.select("path", "conv", "n", "words", "ends").mapInArrow(deal, "path binary, conv long, n long, words array<int>, ends string, shard int")
    walked = written(dealt.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", "path").mapInArrow(walk, _WALKED))
    top = _reduced(walked, prefixes, index)
    skeleton = spark.createDataFrame(top, f"skeleton int, {NODE}")  # at most SHARDS * DEPTH rows
    named = F.broadcast(skeleton.select(F.col("skeleton").alias("s"), F.col("conv_id").alias("above")))
    rest = walked.where("skeleton is null").join(named, F.col("parent_skeleton") == F.col("s"), "left")
    names = [c.split()[0] for c in NODE.split(", ")]
    rest = rest.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return rest.select(names).unionByName(skeleton.select(names))


def _reduced(walked: DataFrame, prefixes: list[bytes], index: dict[bytes, int]) -> list[tuple]:
    """The skeleton's nodes that have members, each with its identifier in front: partial sums of all shards, then sums over the skeleton from its leaves up."""
    sums = walked.where("skeleton is not null").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv"), F.sum("n_convs").alias("n"), F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"), F.max("words").alias("words"), F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256"))).alias("ends"),
    )
    found = {r["skeleton"]: r.asDict() for r in sums.collect()}
    out = []
    for i in sorted(found, reverse=True):  # deeper ones have larger numbers
        x, path = found[i], prefixes[i]
        x["leaves"] = x["leaves"] or 1
        x["saved"] += (x["n"] - 1) * x["words"]
        up = found[index[path[:-SIZE]]] if path else None
        if up:
            up["children"] += 1
            up["leaves"] += x["leaves"]
            up["saved"] += x["saved"]
        out.append((i, x["conv"], len(path) // SIZE, up and up["conv"], x["n"], x["children"], x["leaves"], x["saved"], x["ends"] or NO_ENDS))
    return out
