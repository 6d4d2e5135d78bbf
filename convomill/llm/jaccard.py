"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct k-word shingles, ordered rarest first.
Two documents whose Jaccard similarity reaches the threshold share at least l
shingles among their first n - a + l ones, for any l, where a is the overlap
that their two sizes ask for; n - ceil(t n) + l covers every size of partner,
and a shingle's place tells which of them it counts for. Each document
chooses its own l: a longer prefix costs more entries, but a pair is verified
only if it shares as many of the emitted shingles as the smaller of its two
choices, which spares documents of frequent shingles most of their candidates.
The estimate is taken from a sketch of all shingles' frequencies, of fixed
size whatever the corpus; it steers order and choice only, never the result.

Documents of equal sets are one representative from the start. Large groups
of near copies are joined in linear steps first: every shingle's holders are
met with one of them, the first in a random order of documents, and linked
ones form stars. What remains are pairs of two stars. Those that share only
shingles of up to HOT_HOLDERS documents are met and counted as rows, which are
thus bounded by the shingles' entries. Holders of a shingle of more documents
are compared in blocks of documents of like sizes, a pair of blocks a task, by
products of their incidence matrices; a task returns no pair but those that
join two stars, a forest of them. So copies are not expanded into all pairs,
and no link that could join two components is lost. Components are found over
stars, not documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import shingles, word_hashes
from .storage import written

SKETCH_BITS, SKETCH_BLOCKS = 22, 64
LEAST_MATCHES, MOST_MATCHES, VERIFY_COST = 3, 10, 20.0
SEND_TO_ALL = 2_000_000
LINEAR_ROUNDS, HOT_HOLDERS = 2, 64
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 20, 4096


def _sets(batch_texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for at in range(0, len(batch_texts), 256):
        for words in word_hashes(batch_texts[at : at + 256].to_pylist()):
            yield shingles(words, k)


def frequency_sketch(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """How many sets have a shingle of each of 2**SKETCH_BITS hash classes."""
    width = (1 << SKETCH_BITS) // SKETCH_BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for s in _sets(batch.column(0), k):
                np.add.at(total, (s & np.uint64(len(total) - 1)).astype(np.int64), 1)
        blocks = [zstandard.compress(x.astype("<u4").tobytes(), 1) for x in total.reshape(SKETCH_BLOCKS, width)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(blocks, pa.binary())], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(zstandard.decompress(x.as_py()), "<u4").astype("<u8") for x in table.column("counts")), np.zeros(width, "<u8"))
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([zstandard.compress(total.astype("<u8").tobytes(), 1)], pa.binary())})

    schema = "block int, counts binary"
    rows = docs.select(text).mapInArrow(count, schema).groupBy("block").applyInArrow(add, schema).collect()
    out = np.zeros((SKETCH_BLOCKS, width), np.float32)
    for r in rows:
        out[r["block"]] = np.frombuffer(zstandard.decompress(bytes(r["counts"])), "<u8")
    return out.ravel()


def choose_prefix(s: np.ndarray, f: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """The prefix of the set s, whose shingles have the estimated frequencies f, and the matches it asks for."""
    n = len(s)
    least = n + (-num * n // den) + 1  # n - ceil(t n) + 1
    order = np.lexsort((s, f))[: least + MOST_MATCHES - 1]
    load = np.cumsum(f[order])
    most = min(MOST_MATCHES, n - least + 1)
    choices = np.arange(min(LEAST_MATCHES, most), most + 1)
    load = load[least - 2 + choices]
    cost = (least - 1 + choices) + load + VERIFY_COST * load / choices**2
    matches = int(choices[cost.argmin()])
    return s[order[: least - 1 + matches]], matches


def prefixes(docs: DataFrame, sketch: np.ndarray, text: str, key: str, k: int, num: int, den: int) -> DataFrame:
    usual = float(np.median(sketch))
    rare = np.maximum(sketch - np.float32(1 + usual * 1.2), 0)
    shared = docs.sparkSession.sparkContext.broadcast(rare)  # 16 MB at any size of input

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        for batch in batches:
            n, sig, prefix, need = [], [], [], []
            for s in _sets(batch.column(1), k):
                p, m = choose_prefix(s, freq[(s & np.uint64(len(freq) - 1)).astype(np.int64)], num, den) if len(s) else (s, 0)
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                prefix.append(p.view(np.int64))
                need.append(m)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(need, pa.int32())], ["doc_id", "n", "sig", "prefix", "need"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(prepare, "doc_id long, n long, sig binary, prefix array<long>, need int")


def candidate_sets(docs: DataFrame, reps: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """rep and shingles of the documents in reps; few of them are sent to all tasks, so that not every text moves."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in _sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["rep", "sig", "shingles"])

    few = reps.count() <= SEND_TO_ALL
    texts = docs.select(F.col(key).cast("long").alias("rep"), text).join(F.broadcast(reps) if few else reps, "rep", "left_semi")
    return texts.mapInArrow(build, "rep long, sig binary, shingles binary").groupBy("rep", "sig").agg(F.first("shingles").alias("shingles")).select("rep", "shingles")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose similarity reaches num / den, by their whole sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                same = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                if den * same >= num * (len(x) + len(y) - same):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct()


def star_labels(links: DataFrame) -> DataFrame:
    """node and component: the first node, in a random order, within two links.

    Nodes of equal labels are connected; all of a star get the same one.
    """
    def place(c: str):
        return F.struct(F.xxhash64(c).alias("order"), F.col(c).alias("id"))

    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    near = both.groupBy("node").agg(F.least(F.min(place("other")), place("node")).alias("label"))
    around = both.join(near.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("label"))
    return around.select("node", F.col("label.id").alias("component"))


def counts_for(x: str, y: str, num: int, den: int) -> Column:
    """Whether a common shingle lies in both prefixes for this pair: in the first n - overlap + l of each, with the smaller l of the two."""
    n, l, pos = ((F.col(f"{x}.{c}"), F.col(f"{y}.{c}")) for c in ("n", "l", "pos"))
    overlap = F.ceil(F.lit(num) * (n[0] + n[1]) / F.lit(num + den))
    room = F.least(*l) - overlap
    return (F.least(*n) * den >= F.greatest(*n) * num) & (pos[0] < n[0] + room) & (pos[1] < n[1] + room)


def candidates(met: DataFrame, num: int, den: int) -> DataFrame:
    """a < b of the pairs (x, y; a row per common shingle) that share as many shingles as the smaller l asks for."""
    a, b = F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")
    shares = met.where(counts_for("x", "y", num, den)).groupBy(a, b).agg(F.count("*").alias("c"), F.min(F.least("x.l", "y.l")).alias("l"))
    return shares.where("c >= l").select("a", "b")


def links_in_block(table: pa.Table, num: int, den: int) -> list[tuple[int, int]]:
    """A forest of the links between documents of different components, one on the left, one on the right (of the same block: any two)."""
    left, right = np.asarray(table.column("left")), np.asarray(table.column("right"))
    names, component = np.asarray(table.column("rep")), np.asarray(table.column("component"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
    n = np.array([len(x) for x in sets])
    _, place, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[place]
    row = np.repeat(np.arange(len(sets)), n)[column >= 0]
    column = column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((left.sum(), right.sum()), np.float32)
    for at in range(0, int((held > 1).sum()), COLUMNS):
        some = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[row[some], column[some] - at] = 1
        overlap += x[left] @ x[right].T
    overlap = overlap.astype(np.int64)
    near = np.zeros((len(sets), len(sets)), bool)
    near[np.ix_(left, right)] = (den * overlap >= num * (n[left][:, None] + n[right][None] - overlap)) & (component[left][:, None] != component[right][None])
    near |= near.T
    seen, out = np.zeros(len(sets), bool), []
    for first in range(len(sets)):
        stack = [] if seen[first] else [first]
        seen[first] = True
        while stack:
            i = stack.pop()
            new = np.flatnonzero(near[i] & ~seen)
            seen[new] = True
            stack += new.tolist()
            out += [(int(names[i]), int(names[j])) for j in new]
    return out


def block_pairs(held: DataFrame, num: int, den: int) -> DataFrame:
    """rep, component, left, right and the pair of blocks (p, size, other, i, j) for holders (p, rep, n, component): all pairs of a p whose sizes allow a link meet in a pair of blocks; pairs of blocks of one component are left out.

    Sizes are put in classes, so that a link's two sizes lie in one class or
    in two that follow each other.
    """
    width = max(float(np.log(den / num)), 1e-3) * 1.0001
    rows = F.greatest(F.lit(16), F.least(F.lit(BLOCK_ROWS), (BLOCK_SHINGLES / F.exp((F.col("size") + 1) * width)).cast("int")))
    held = held.withColumn("size", F.floor(F.log("n") / width).cast("int"))
    sizes = written(held.groupBy("p", "size").agg(F.count("*").alias("c")).select("p", "size", (1 + F.floor((F.col("c") - 1) / rows)).cast("int").alias("blocks")))
    other = lambda by, name: sizes.select("p", (F.col("size") + by).alias("size"), F.col("blocks").alias(name))
    held = held.join(sizes, ["p", "size"]).join(other(-1, "above"), ["p", "size"], "left").join(other(1, "below"), ["p", "size"], "left")
    held = held.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def each(n: str, of) -> Column:
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), of)).otherwise(F.array().cast("array<struct<size:int,other:int,i:int,j:int,left:boolean,right:boolean>>"))

    def key(size: Column, other: Column, i: Column, j: Column, left: Column, right: Column) -> Column:
        return F.struct(size.alias("size"), other.alias("other"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))

    size, own, yes, no = F.col("size"), F.col("own"), F.lit(True), F.lit(False)
    places = F.concat(
        each("blocks", lambda x: key(size, size, F.least(own, x), F.greatest(own, x), own <= x, own >= x)),
        each("above", lambda x: key(size, size + 1, own, x, yes, no)),
        each("below", lambda x: key(size - 1, size, x, own, no, yes)),
    )
    placed = written(held.select("p", "rep", "component", F.explode(places).alias("at")).select("p", "rep", "component", "at.*"))
    by = ["p", "size", "other", "i", "j"]
    mixed = placed.groupBy(*by).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("left").alias("l"), F.max("right").alias("r")).where("lo != hi and l and r")
    return placed.join(mixed.select(*by), by)


def hot_links(hot: DataFrame, docs: DataFrame, num: int, den: int, text: str, key: str, k: int) -> DataFrame:
    """a and b of links that join the components of holders of frequent shingles (pivot.rep, rep, n, component)."""
    held = written(hot.select(F.col("pivot.rep").alias("p"), "rep", "n", "component").distinct())
    if not held.take(1):
        return held.select(F.col("p").alias("a"), F.col("rep").alias("b"))
    blocks = written(block_pairs(held, num, den))
    sets = written(candidate_sets(docs, blocks.select("rep").distinct(), text, key, k))

    def links(table: pa.Table) -> pa.Table:
        found = links_in_block(table, num, den)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return blocks.join(sets, "rep").groupBy("p", "size", "other", "i", "j").applyInArrow(links, "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Documents link when intersection / union >= num / den. A text of fewer
    than k words is one shingle; a null, empty or blank text has none and
    links to nothing. Rows that share a doc_id count as one document. A null
    doc_id never represents others. An empty table gives an empty result.
    Other columns are not read.
    """
    sketch = frequency_sketch(docs, text, k)
    prepared = written(prefixes(docs, sketch, text, key, k, num, den))
    distinct = prepared.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "prefix", "need")])
    entries = written(distinct.where("rep is not null").select("rep", "n", F.col("need").alias("l"), F.posexplode("prefix").alias("pos", "h"))).repartition("h")
    member = F.struct("rep", "n", "l", "pos")
    shared = entries.groupBy("h").agg(F.count("*").alias("c"), F.min_by(member, F.xxhash64("rep")).alias("pivot")).where("c > 1").drop("c")
    postings = written(entries.join(shared, "h"))
    spark = docs.sparkSession

    def linked(pairs: DataFrame) -> DataFrame:
        reps = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        return written(verified(pairs, written(candidate_sets(docs, reps, text, key, k)), num, den))

    links = spark.createDataFrame([], "a long, b long")
    live, done = postings, spark.createDataFrame([], "a long, b long")
    for step in range(LINEAR_ROUNDS):
        met = live.where("rep != pivot.rep").select(member.alias("x"), F.col("pivot").alias("y"))
        pairs = written(candidates(met, num, den).join(done, ["a", "b"], "left_anti"))
        links = written(links.unionByName(linked(pairs)))
        done = written(done.unionByName(pairs))
        parts = written(star_labels(links))
        held = postings.select("h", "rep", "n", "l", "pos").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        order = F.xxhash64("rep", F.lit(step + 1))
        mixed = held.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("holders"), F.min_by(member, order).alias("pivot")).where("lo != hi").drop("lo", "hi")
        live = written(held.join(mixed, "h"))
    one, two = (live.where(F.col("holders") <= HOT_HOLDERS).select("h", F.col("component").alias(f"component_{s}"), member.alias(s)) for s in "xy")
    met = one.join(two, (one["h"] == two["h"]) & (F.col("x.rep") < F.col("y.rep")) & (F.col("component_x") != F.col("component_y")) & counts_for("x", "y", num, den)).select("x", "y")
    pairs = written(candidates(met, num, den).join(done, ["a", "b"], "left_anti"))
    links = links.unionByName(linked(pairs)).unionByName(hot_links(live.where(F.col("holders") > HOT_HOLDERS), docs, num, den, text, key, k))
    parts = parts.select("node", F.col("component").alias("part"))
    for end in "ab":
        links = links.join(parts.withColumnRenamed("node", end), end, "left").withColumn(f"part_{end}", F.coalesce("part", end)).drop("part")
    whole = components(links.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")))
    reps = distinct.select("sig", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("part", "rep"))
    reps = written(reps.join(whole.withColumnRenamed("node", "part"), "part", "left").select("sig", "rep", F.coalesce("component", "part").alias("class")))
    names = reps.groupBy("class").agg(F.min("rep").alias("component"))
    reps = reps.join(names, "class", "left").select("sig", "component")
    return prepared.select("doc_id", "n", "sig").join(reps, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the near copies of a document of smaller identifier; rows of a null identifier stay."""
    found = jaccard_components(docs, k, num, den, text, key).where("component_id < doc_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(found, key, "left_anti")
