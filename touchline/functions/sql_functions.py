"""Functions for use in SQL text: ``register(spark)`` makes them known to ``spark.sql``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import PandasUDFType, pandas_udf
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from touchline.functions.hull import hull_of
from touchline.operators.evaluation import _best_of
from touchline.operators.formation import MAX_DISTANCE, PROTOTYPES


class ExplodeIntervals:
    """``explode_intervals(first, last [, step])``: a row for each whole number from ``first`` to ``last``; none where an end is null."""

    @staticmethod
    def analyze(first: AnalyzeArgument, last: AnalyzeArgument, step: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, argument in (("first", first), ("last", last), ("step", step)):
            if argument is not None and argument.dataType.typeName() not in ("integer", "long", "short", "byte"):
                raise ValueError(f"explode_intervals: {name} must be a whole number, not {argument.dataType.simpleString()}")
        return AnalyzeResult(StructType([StructField("at", LongType()), StructField("place", LongType())]))

    def eval(self, first: int | None, last: int | None, step: int = 1) -> Iterator[tuple[int, int]]:
        if first is None or last is None:
            return
        for place, at in enumerate(range(first, last + 1, step)):
            yield at, place


class AssignPairs:
    """``assign_pairs(TABLE(a, b, gain) PARTITION BY ...)``: the one-to-one pairs of each partition with the largest total gain.

    A partition is one frame or another small group; pairs with a null are left out.
    """

    def __init__(self) -> None:
        self.pairs: dict[tuple[int, int], float] = {}

    @staticmethod
    def analyze(pairs: AnalyzeArgument) -> AnalyzeResult:
        missing = {"a", "b", "gain"} - set(pairs.dataType.fieldNames())
        if missing:
            raise ValueError(f"assign_pairs needs the columns {sorted(missing)}")
        return AnalyzeResult(StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("gain", DoubleType())]))

    def eval(self, pair: Row) -> None:
        if pair["a"] is not None and pair["b"] is not None and pair["gain"] is not None:
            key = (pair["a"], pair["b"])
            self.pairs[key] = max(self.pairs.get(key, float("-inf")), float(pair["gain"]))

    def terminate(self) -> Iterator[tuple[int, int, float]]:
        edges = [(a, b, gain) for (a, b), gain in sorted(self.pairs.items())]
        yield from _best_of(edges, edges)


class Assigned:
    """``assigned(pairs)``: as ``assign_pairs``, over an array of structs ``a, b, gain``."""

    @staticmethod
    def analyze(pairs: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("gain", DoubleType())]))

    def eval(self, pairs: list | None) -> Iterator[tuple[int, int, float]]:
        one = AssignPairs()
        for pair in pairs or ():
            one.eval(pair)
        yield from one.terminate()


def _hull_area(x: pd.Series, y: pd.Series) -> float:
    """``hull_area(x, y)``: the area of the convex hull of a group's points; null under three points."""
    points = np.column_stack([x.to_numpy(float), y.to_numpy(float)])
    area = hull_of(points[~np.isnan(points).any(axis=1)])[0]
    return float("nan") if area is None else area


def line_distance(lines: list[int], prototype: tuple[int, ...]) -> float:
    """Edit distance of line sizes, plus 1.5 a man in the first line and 1 a missing line."""
    row = [float(sum(prototype[:j])) for j in range(len(prototype) + 1)]
    for seen in lines:
        below = [row[0] + seen]
        for j, want in enumerate(prototype, 1):
            below.append(min(row[j - 1] + abs(seen - want), row[j] + seen, below[-1] + want))
        row = below
    return row[-1] + 1.5 * abs(lines[0] - prototype[0]) + abs(len(lines) - len(prototype))


def _formation_distance(lines: pd.Series, name: pd.Series) -> pd.Series:
    """``formation_distance(lines, prototype)``: null for a null or an unknown prototype, the greatest distance for no lines."""
    known: dict[tuple, float] = {}
    out = []
    for sizes, wanted in zip(lines, name):
        key = (tuple(int(v) for v in sizes), wanted) if sizes is not None and wanted in PROTOTYPES else None
        if key is not None and key not in known:
            known[key] = line_distance(list(key[0]), PROTOTYPES[wanted]) if key[0] else MAX_DISTANCE
        out.append(known.get(key))
    return pd.Series(out, dtype=float)


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("explode_intervals", udtf(ExplodeIntervals))
    spark.udtf.register("assign_pairs", udtf(AssignPairs))
    spark.udtf.register("assigned", udtf(Assigned))
    spark.udf.register("hull_area", pandas_udf(_hull_area, "double", PandasUDFType.GROUPED_AGG))
    spark.udf.register("formation_distance", pandas_udf(_formation_distance, "double"))
