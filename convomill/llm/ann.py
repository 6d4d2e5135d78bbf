"""Nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids and, for each of SUBSPACES parts of the vector, a codebook of
residuals are fitted on a bounded sample (SAMPLE vectors, those of the
smallest hashes). Every row is then indexed: its cell and one byte a part. A
query looks through its nearest cells; asymmetric distance tables (query
residual to each codebook entry) rank a cell's rows by their codes, and the
best RERANK of each block are measured exactly on the original vectors. How
many cells to probe is set on the sample: the fewest that reach AIM recall
against brute force there; a query further goes on until its cells hold
LEAST_ROWS rows.

Cells are divided into blocks of rows and of queries, so a cell that holds a
third of all rows, or of the queries, is spread over many tasks. Only
centroids, codebooks and cell sizes pass the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

SAMPLE, SUBSPACES, CODES, RERANK = 20_000, 16, 256, 200
AIM, LEAST_ROWS = 0.98, 400
BLOCK_ROWS, BLOCK_QUERIES, SLICE = 20_000, 5_000, 1 << 21


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, float]:
    """vec_id and v (doubles) of the rows that take part: not null, without null or non-finite components, not zero, of the commonest length. v is divided by a power of two, which comes second, where squares of the components would leave the range of doubles; else by 1."""
    v = F.col(column).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(~bad & F.exists("v", lambda x: x != 0))
    most = F.max(F.array_max(F.transform("v", F.abs)))
    size = ok.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("count"), most.alias("most")).orderBy(F.desc("count"), "n").first()
    ok = ok.where(F.size("v") == (size["n"] if size else 0))
    if not size or 1e-100 < size["most"] < 1e100:
        return ok, 1.0
    unit = 2.0 ** max(-1000, math.frexp(size["most"])[1] - 1)
    return ok.select("vec_id", F.transform("v", lambda x: x / unit).alias("v")), unit


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """In slices, so that the matrix of distances stays small."""
    step = max(1, SLICE // max(1, len(centres)))
    return np.concatenate([squared_distances(x[at : at + step], centres).argmin(1) for at in range(0, len(x), step)]) if len(x) else np.empty(0, int)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's iterations from distinct rows of x; an empty cluster keeps its centroid."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:k]].astype(float)
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Quantiser:
    centres: np.ndarray
    books: list[np.ndarray]
    cuts: np.ndarray
    probes: int = 1

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, k: int) -> Quantiser:
        cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
        centres = k_means(x, cells)
        residual = x - centres[nearest_centre(x, centres)]
        books = [k_means(residual[:, a:b], CODES, rounds=8) for a, b in zip(cuts, cuts[1:], strict=False)]
        out = cls(centres, books, cuts)
        out.probes = out._probes_for(x, k)
        return out

    def _probes_for(self, x: np.ndarray, k: int) -> int:
        """The fewest cells in which AIM of the sample's own nearest rows lie, for every hundredth row as a query."""
        queries = x[:: max(1, len(x) // 200)]
        near = np.argsort(squared_distances(queries, x), axis=1)[:, : k + 1]
        cell = nearest_centre(x, self.centres)
        rank = np.argsort(np.argsort(squared_distances(queries, self.centres), axis=1), axis=1)
        needed = np.sort(np.take_along_axis(rank, cell[near], 1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(AIM * len(needed))))]) + 1

    def cell_and_codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes, and the distance of each row from what its codes stand for."""
        cell = nearest_centre(x, self.centres)
        residual = x - self.centres[cell]
        codes, error = [], np.zeros(len(x))
        for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False):
            codes.append(nearest_centre(residual[:, a:b], book))
            error += ((residual[:, a:b] - book[codes[-1]]) ** 2).sum(1)
        return cell, np.stack(codes, 1).astype(np.uint8), np.sqrt(error)

    def tables(self, query: np.ndarray, cell: int) -> np.ndarray:
        """Asymmetric distances of one query to each part's codebook, within a cell."""
        residual = query - self.centres[cell]
        out = np.full((len(self.books), CODES), np.inf)
        for i, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books, strict=False)):
            out[i, : len(book)] = ((book - residual[a:b]) ** 2).sum(1)
        return out


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), float).reshape(len(col), -1)


def fit(rows: DataFrame, k: int) -> Quantiser | None:
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    if not sample.num_rows:
        return None
    x = _matrix(sample.column("v"))
    n = rows.count()
    cells = int(min(4096, max(1, round(np.sqrt(n) / 2)), max(1, len(x) // 8)))
    return Quantiser.fit(x, cells, k)


def indexed(rows: DataFrame, quantiser: Quantiser) -> DataFrame:
    """rows with their cell and codes."""
    shared = rows.sparkSession.sparkContext.broadcast(quantiser)  # bounded by the number of cells

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, codes, error = shared.value.cell_and_codes(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], ["vec_id", "v", "cell", "codes", "error"])

    return rows.select("vec_id", "v").mapInArrow(index, "vec_id long, v array<double>, cell int, codes binary, error double")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """For each row whose key is divisible by every: query_id, rank from 1, vec_id, score (Euclidean distance in double precision).

    Candidates are all rows but those of the query's own key. Nearest first,
    ties to the smaller key; fewer than k if there are fewer rows. Rows that
    usable() leaves out take no part. Rows that share a key are candidates
    each; as a query they are one, of the smallest of their vectors. An empty
    table gives an empty result. Other columns are not read.
    """
    spark, (rows, unit) = vectors.sparkSession, usable(vectors, key, column)
    quantiser = fit(rows, k)
    schema = "query_id long, vec_id long, score double"
    if quantiser is None:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    index = written(indexed(rows, quantiser))
    sizes = {r["cell"]: r["n"] for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast((quantiser, np.array([sizes.get(i, 0) for i in range(len(quantiser.centres))])))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, held = shared.value
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(squared_distances(_matrix(batch.column(1)), q.centres), axis=1)
                enough = (np.cumsum(held[order], axis=1) - held[order] >= LEAST_ROWS).sum(1)
                counts = np.maximum(q.probes, order.shape[1] - enough)
                cells = [o[:c].tolist() for o, c in zip(order, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], ["query_id", "q", "cells"])

    asking = index.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = asking.mapInArrow(probe, "query_id long, q array<double>, cells array<int>")
    probes = written(queries.select("query_id", "q", F.explode("cells").alias("cell")))
    asked = {r["cell"]: r["n"] for r in probes.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = F.broadcast(spark.createDataFrame([(c, 1 + n // BLOCK_ROWS, 1 + asked.get(c, 0) // BLOCK_QUERIES) for c, n in sizes.items()], "cell int, row_blocks int, query_blocks int"))  # a row per cell

    def spread(df: DataFrame, own: str, own_blocks: str, other_blocks: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(own), F.col(own_blocks)).cast("int")
        kind = "rb" if own_blocks == "row_blocks" else "qb"
        return df.join(blocks, "cell").withColumn(kind, mine).withColumn("qb" if kind == "rb" else "rb", F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1))).select(*df.columns, "rb", "qb")

    by_rows = spread(index.where(F.col("cell").isin(list(asked)) if len(asked) < len(sizes) else F.lit(True)), "vec_id", "row_blocks", "query_blocks")
    by_queries = spread(probes, "query_id", "query_blocks", "row_blocks")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            quantiser, _ = shared.value
            ids, v = np.asarray(right.column("vec_id")), _matrix(right.column("v"))
            codes, error = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1), np.asarray(right.column("error"))
            parts = np.arange(codes.shape[1])
            cell = left.column("cell")[0].as_py()
            for query, q in zip(left.column("query_id").to_pylist(), _matrix(left.column("q")), strict=True):
                estimate = quantiser.tables(q, cell)[parts, codes].sum(1)
                others = ids != query
                estimate[~others] = np.inf
                best = np.argpartition(estimate, RERANK)[:RERANK] if len(ids) > RERANK else np.arange(len(ids))
                best = best[others[best]]
                exact = np.sqrt(((v[best] - q) ** 2).sum(1))
                if len(best) >= k:  # a row is no nearer than its code less its error
                    slack = 1e-6 * (np.sqrt((q * q).sum()) + error)  # of rounding
                    left = others & (np.sqrt(np.maximum(estimate, 0)) - error - slack <= np.partition(exact, k - 1)[k - 1])
                    left[best] = False
                    more = np.flatnonzero(left)
                    best, exact = np.concatenate([best, more]), np.concatenate([exact, np.sqrt(((v[more] - q) ** 2).sum(1))])
                for i in np.lexsort((ids[best], exact))[:k]:
                    out.append((query, int(ids[best[i]]), float(exact[i])))
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    keys = ["cell", "rb", "qb"]
    found = by_queries.groupBy(*keys).cogroup(by_rows.groupBy(*keys)).applyInArrow(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", (F.col("score") * unit).alias("score"))
