"""Running sums and last values along long sequences, in blocks.

A window holds all rows of its key in one task. Here a sequence is cut into
blocks of its order's values; a block's rows are scanned by themselves, what
each block adds and leaves behind is scanned over the blocks (a row for each),
and both are put together. Sums and last values are associative, so the result
is that of one scan over all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scanned(df: DataFrame, keys: list[str], order: str, block: int, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, inclusive: bool = True) -> DataFrame:
    """df with sums (running sums up to each row, null counts as nothing) and lasts (the last value that is not null), by name.

    order: whole numbers, distinct within a key; rows of a null order come
    first. inclusive: whether a row counts for its own last value. Null keys
    are keys like any other. Names that df has are overwritten.
    """
    sums, lasts = sums or {}, lasts or {}
    own = {**{f"scan_s{i}": x for i, x in enumerate(sums.values())}, **{f"scan_l{i}": x for i, x in enumerate(lasts.values())}}
    x = df.withColumns({**own, "scan_b": F.coalesce(F.floor(F.col(order) / block), F.lit(-(1 << 62)))})
    upto = Window.partitionBy(*keys, "scan_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seen = upto if inclusive else upto.rowsBetween(Window.unboundedPreceding, -1)
    inner = {c: F.sum(c).over(upto) if c.startswith("scan_s") else F.last(c, ignorenulls=True).over(seen) for c in own}
    place = F.struct(F.col(order).isNotNull(), order)
    adds = x.groupBy(*keys, "scan_b").agg(*[F.sum(c).alias(c) if c.startswith("scan_s") else F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(c) for c in own])
    over = Window.partitionBy(*keys).orderBy("scan_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = adds.select(*[F.col(k).alias(f"scan_k{i}") for i, k in enumerate(keys)], F.col("scan_b").alias("scan_k"), *[(F.sum(c) if c.startswith("scan_s") else F.last(c, ignorenulls=True)).over(over).alias(f"{c}_before") for c in own])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"scan_k{i}")) for i, k in enumerate(keys)], F.col("scan_b") == F.col("scan_k"))
    y = x.withColumns({f"{c}_own": v for c, v in inner.items()}).join(carried, same)
    zero = F.lit(0)
    out = {n: F.coalesce(F.col(f"scan_s{i}_own"), zero) + F.coalesce(F.col(f"scan_s{i}_before"), zero) for i, n in enumerate(sums)}
    out |= {n: F.coalesce(f"scan_l{i}_own", f"scan_l{i}_before") for i, n in enumerate(lasts)}
    return y.select(*[c for c in df.columns if c not in out], *[v.alias(n) for n, v in out.items()])
