"""Connected components by alternating stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from touchline.session import cut_lineage


def _signature(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return ``node, component`` for every node that an edge names; ``component`` is the smallest node reachable.

    Large-star hangs the greater neighbours of a node on its smallest one, small-star the lesser ones; the two in turn
    reach the stars of the answer in a number of rounds that grows with the logarithm of the longest path. Minima are
    combined before the shuffle. A hub is a hot key only in the join with one row per node, which adaptive execution
    splits. Each round is written to the shared folder; two numbers and a count come to the driver.
    """
    now = cut_lineage(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct(), "edges")
    seen = None
    while (sign := _signature(now)) != seen:
        seen = sign
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        lesser = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lesser, "u").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b"))))
                                                         .otherwise(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
                                                                            F.struct(F.col("u").alias("a"), F.col("m").alias("b"))))).alias("e"))
        now = cut_lineage(small.select("e.a", "e.b").filter("a > b").distinct(), "edges")
    root = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return root.union(root.select(F.col("component"), F.col("component"))).distinct()


def local_forest(left, right, n: int):
    """Labels of ``n`` nodes joined by the pairs ``left[i], right[i]``: the smallest index of each group (numpy)."""
    import numpy as np

    label = np.arange(n)
    return unite(label, left, right)


def unite(label, left, right):
    """Merge the groups of ``left[i]`` and ``right[i]`` in ``label``, in place."""
    import numpy as np

    while len(left):
        x, y = label[left], label[right]
        open_ = x != y
        if not open_.any():
            break
        left, right, x, y = left[open_], right[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
    return label
