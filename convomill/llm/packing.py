"""Packing of documents into sequences by cutting-stock column generation.

Documents are tokenised and cut into full sequences and a remainder; a
remainder is cut once more into a multiple of GRAIN tokens and a tail of less,
so there are fewer than ``seq_len / GRAIN + GRAIN`` piece lengths whatever the
corpus. The histogram of lengths is the demand of a cutting-stock problem: a
pattern is a multiset of lengths that fits one sequence. The linear program
over the patterns found so far gives each length a dual price, a knapsack
dynamic program over the prices finds the best new pattern, until none
improves. Pattern counts are rounded down, what is left is packed longest
length first, and the pieces of each length, ranked, take the pattern slots of
their ranks by arithmetic alone. Only the histogram and the patterns pass the
driver; both are bounded by the sequence length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .tokens import byte_encoder

GRAIN = 16
PART_ROWS = 50_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def piece_lengths(n: int, seq_len: int, grain: int = GRAIN) -> list[int]:
    rest = n % seq_len
    tail = rest % grain if rest > grain else 0
    return [seq_len] * (n // seq_len) + [x for x in (rest - tail, tail) if x]


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, seq_len: int, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece of each document's ids followed by end_id: PIECES, and with_ids the ids themselves.

    A null text is an empty one: its only id is end_id. Repeated rows are cut
    each for itself. Other columns are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = byte_encoder(tokenizer), np.uint32(end_id).tobytes()
        for batch in batches:
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, start = encoder.encode(body or "") + end, 0
                total = len(ids) // 4
                for n in piece_lengths(total, seq_len):
                    part = ids[4 * start : 4 * (start + n)]
                    rows.append((doc, start, n, zlib.crc32(part), total, part))
                    start += n
            cols = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]]
            if with_ids:
                flat = np.frombuffer(b"".join(cols[5]), np.uint32).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(np.cumsum([0, *cols[2]]).astype(np.int32), flat))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def best_pattern(lengths: np.ndarray, prices: np.ndarray, room: int, most: np.ndarray | None = None) -> np.ndarray:
    """The multiset of lengths of the highest total price within room: knapsack dynamic programming over the lengths, each at most `most` times."""
    if most is None:
        value, take = np.zeros(room + 1), np.full(room + 1, -1)
        for r in range(1, room + 1):
            fits = lengths <= r
            if fits.any():
                gain = np.where(fits, value[np.maximum(r - lengths, 0)] + prices, -1.0)
                i = int(gain.argmax())
                value[r], take[r] = max((value[r - 1], -1), (gain[i], i))
            else:
                value[r] = value[r - 1]
        counts, r = np.zeros(len(lengths), np.int64), room
        while r > 0:
            if take[r] < 0:
                r -= 1
            else:
                counts[take[r]] += 1
                r -= lengths[take[r]]
        return counts
    counts = np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths):  # what is left over: longest first
        counts[i] = min(most[i], room // lengths[i])
        room -= counts[i] * lengths[i]
    return counts


def column_generation(lengths: np.ndarray, demand: np.ndarray, room: int, tolerance: float = 1e-4, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used in the linear program: min sum(x), patterns.T @ x = demand, x >= 0.

    Revised simplex: the basis starts with one homogeneous pattern for each
    length. Ends when no pattern's price exceeds 1 + tolerance, which bounds
    the result's distance from the optimum by that share.
    """
    n = len(lengths)
    basis = np.diag((room // lengths).astype(float))
    x = demand / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis, np.ones(n))  # rows are patterns: basis @ prices = 1
        new = best_pattern(lengths, prices, room)
        if new @ prices <= 1 + tolerance:
            break
        step = np.linalg.solve(basis.T, new.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        leave = int(ratio.argmin())
        move = max(ratio[leave], 0.0)
        x = np.maximum(x - move * step, 0)
        x[leave] = move
        basis[leave] = new
    return basis.astype(np.int64), x


def patterns_of(lengths: list[int], demand: list[int], room: int) -> list[tuple[np.ndarray, int]]:
    """Whole-numbered use of patterns that covers the demand exactly."""
    if not lengths:
        return []
    size, left = np.array(lengths), np.array(demand)
    patterns, x = column_generation(size, left.astype(float), room)
    used = []
    for pattern, count in zip(patterns, np.floor(x + 1e-9).astype(np.int64), strict=True):
        held = pattern > 0
        count = min(count, int((left[held] // pattern[held]).min())) if held.any() else 0
        if count > 0:
            used.append((pattern, int(count)))
            left = left - count * pattern
    while left.any():
        pattern = best_pattern(size, size, room, left)
        held = pattern > 0
        count = int((left[held] // pattern[held]).min())
        used.append((pattern, int(count)))
        left = left - count * pattern
    return used


def pack_pieces(pieces: DataFrame, seq_len: int) -> DataFrame:
    """pieces with sequence_id and offset, gapless from 0 in each sequence.

    Pieces of one length are ranked in parts of about PART_ROWS rows by their text's and
    document's hash, so a length or an identifier that many pieces share is no hot task. An
    empty table gives an empty result.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # seq_len rows at most
    lengths = sorted(counts)
    slots, first_id, done = [], 0, dict.fromkeys(lengths, 0)
    for pattern, count in patterns_of(lengths, [counts[x] for x in lengths], seq_len):
        offset = 0
        for length, each in zip(lengths, pattern.tolist(), strict=True):
            if each:
                slots.append((length, done[length], done[length] + count * each, each, offset, first_id))
                done[length] += count * each
                offset += each * length
        first_id += count
    table = spark.createDataFrame(slots, "len int, lo long, hi long, each int, base int, first_id long")  # bounded by the number of lengths, squared
    parts_of = F.broadcast(spark.createDataFrame([(x, 1 + n // PART_ROWS) for x, n in counts.items()], "length long, parts int"))
    rows = pieces.join(parts_of, "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("parts")))
    parts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("length", "part", before.alias("before"))
    in_part = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = rows.withColumn("in_part", in_part).join(parts, ["length", "part"]).withColumn("rank", F.col("in_part") + F.col("before"))
    return (
        ranked.join(F.broadcast(table), (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .withColumn("sequence_id", F.col("first_id") + F.floor((F.col("rank") - F.col("lo")) / F.col("each")))
        .withColumn("offset", F.col("base") + F.pmod(F.col("rank") - F.col("lo"), F.col("each")) * F.col("length"))
        .select(*pieces.columns, F.col("sequence_id").cast("long"), F.col("offset").cast("long"))
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, seq_len: int = 2048, with_ids: bool = False, **columns: str) -> DataFrame:
    """cut_documents(), kept in the shared folder, then pack_pieces()."""
    return pack_pieces(written(cut_documents(docs, tokenizer, end_id, seq_len, with_ids=with_ids, **columns)), seq_len)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences as training rows: sequence_id, input_ids, doc_ids. Needs pieces packed with_ids.

    A null document identifier stays null in doc_ids, repeated documents each
    have their pieces, an empty document has its end alone; of an empty table
    there is no sequence.
    """
    order = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(order.alias("p")).select("sequence_id", F.flatten("p.ids").alias("input_ids"), F.col("p.doc_id").alias("doc_ids"))
