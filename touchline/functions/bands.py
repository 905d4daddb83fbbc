"""Band joins: two rows match when their intervals overlap or their frames lie close together.

Both sides are bucketed, so the join is an equi-join on (keys, bucket) with the exact test on top, never a
nested loop.  A pair can share several buckets; it is kept only in the first one they share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _bucket(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width)).cast("long")


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_range: tuple[str, str],
                 right_range: tuple[str, str], width: float, how: str = "inner") -> DataFrame:
    """Pairs whose closed ranges intersect.  Column names other than ``keys`` must differ between sides."""
    l0, l1 = left_range
    r0, r1 = right_range
    a = left.withColumn("_b", F.explode(F.sequence(_bucket(F.col(l0), width), _bucket(F.col(l1), width))))
    b = right.withColumn("_b", F.explode(F.sequence(_bucket(F.col(r0), width), _bucket(F.col(r1), width))))
    first = F.greatest(_bucket(F.col(l0), width), _bucket(F.col(r0), width))
    joined = a.join(b, [*keys, "_b"])
    return joined.filter((F.col(l0) <= F.col(r1)) & (F.col(r0) <= F.col(l1)) & (F.col("_b") == first)).drop("_b")


def near_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, reach: int,
              width: int | None = None) -> DataFrame:
    """Pairs with ``|left_at - right_at| <= reach``; the left side is copied to the neighbour buckets."""
    size = width or max(1, reach)
    a = left.withColumn("_b", F.explode(F.sequence(_bucket(F.col(left_at) - F.lit(reach), size),
                                                   _bucket(F.col(left_at) + F.lit(reach), size))))
    b = right.withColumn("_b", _bucket(F.col(right_at), size))
    return a.join(b, [*keys, "_b"]).filter(F.abs(F.col(left_at) - F.col(right_at)) <= F.lit(reach)).drop("_b")
