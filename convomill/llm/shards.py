"""Minimax contiguous partition of documents into shards [native].

Documents with equal texts form a group that is never divided. Groups are
ordered by a hash of their text, and consecutive ones are gathered in atoms:
all groups whose hash has the same leading bits. The smallest shard capacity
for which a greedy walk over the ordered atom sizes needs no more than the
given number of shards is found by binary search; the walk at that capacity
says where to cut. There are at most 2**ATOM_BITS atoms at any size of input,
so this table alone comes to the driver. A shard is a run of atoms, and a
document's slot is the atom's first slot plus the document's rank in its atom;
atoms of many documents are ranked in parts, so one hot text is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

ATOM_BITS = 16
PART_ROWS = 50_000


def shards_needed(sizes: list[int], capacity: int) -> int:
    """Runs that the greedy walk makes; each holds capacity at most."""
    runs, room = 0, 0
    for size in sizes:
        if runs == 0 or size > room:
            runs, room = runs + 1, capacity
        room -= size
    return runs


def smallest_capacity(sizes: list[int], n_shards: int) -> int:
    low, high = max(max(sizes, default=0), -(-sum(sizes) // n_shards)), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if shards_needed(sizes, mid) <= n_shards:
            high = mid
        else:
            low = mid + 1
    return low


def runs_from(sizes: list[int], capacity: int) -> list[int]:
    """For each index: the runs that the greedy walk makes of what lies from there on."""
    need, end, filled = [0] * (len(sizes) + 1), len(sizes), 0
    for i in range(len(sizes) - 1, -1, -1):
        filled += sizes[i]
        while filled > capacity:
            end -= 1
            filled -= sizes[end]
        need[i] = 1 + need[end]
    return need


def cut(sizes: list[int], n_shards: int) -> list[int]:
    """The shard of each atom. None exceeds the smallest capacity; each closes at its even share of what is left, if the rest still fits then."""
    capacity = smallest_capacity(sizes, n_shards)
    need, left, shard, filled, out = runs_from(sizes, capacity), sum(sizes), 0, 0, []
    for i, size in enumerate(sizes):
        after = n_shards - shard - 1
        even = (left + filled) / (after + 1)
        if after and filled and (filled + size > capacity or (filled + size / 2 > even and need[i] <= after)):
            shard, filled = shard + 1, 0
        filled, left = filled + size, left - size
        out.append(shard)
    return out


def minimax_shards(docs: DataFrame, n_shards: int = 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs' key with size, text_crc32, shard and slot.

    size is the text's UTF-8 bytes plus 1; a null text has no bytes and forms
    one group with the empty text. Repeated rows each take a slot. An empty
    table gives an empty result. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = written(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(body).cast("long") + 1).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("h"),
        ).withColumn("atom", F.shiftrightunsigned("h", 64 - ATOM_BITS).cast("int"))
    )
    atoms = slim.groupBy("atom").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("atom").collect()
    shard_of = cut([a["size"] for a in atoms], n_shards)
    plan, slot, last = [], 0, -1
    for a, shard in zip(atoms, shard_of, strict=True):
        slot = 0 if shard != last else slot
        plan.append((a["atom"], shard, slot, 1 + a["n"] // PART_ROWS))
        slot, last = slot + a["n"], shard
    spark = docs.sparkSession
    placed = F.broadcast(spark.createDataFrame(plan, "atom int, shard int, first long, parts int"))  # 2**ATOM_BITS rows at most
    rows = slim.join(placed, "atom").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    parts = rows.groupBy("atom", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("atom").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).drop("n")
    rank: Column = F.row_number().over(Window.partitionBy("atom", "part").orderBy("h", "doc_id")) - 1
    ranked = rows.withColumn("rank", rank)
    return ranked.join(parts, ["atom", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("before") + F.col("rank")).cast("long").alias("slot"))
