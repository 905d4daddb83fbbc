"""Approximate vector search: an inverted file of cells, kept as a bucketed table, with candidates scored exactly."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Vectors that the cells are fitted on, and rounds of the fit. Every vector is filed, whatever was sampled.
SAMPLE, ROUNDS = 20_000, 8
PROBES = 0.5
#: Vectors of a cell and queries that one task compares at a time; scores it holds at a time.
PART, ASKED, SCORES = 20_000, 2_000, 2_000_000


class VectorIndex(NamedTuple):
    """Name of the bucketed table (``cell, id, unit`` and payload columns) and the unit centres of the cells."""

    table: str
    centres: np.ndarray


def _fit(sample: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Spherical means of unit vectors; an empty cell keeps its centre."""
    centres = sample[np.random.default_rng(seed).choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1)[:, None]
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def _filed(centres: np.ndarray, most: int, names: list[str]):
    """Add the ``most`` nearest cells of column ``unit``, nearest first."""
    at = names.index("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :most].astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*names, "cells"])

    return run


def unit(vectors: DataFrame, vector: str) -> DataFrame:
    """Add ``unit``, in double precision; null, empty, zero and non-finite vectors go. All vectors must have one length."""
    v = F.transform(vector, lambda x: x.cast("double"))
    df = vectors.withColumn("_v", v).withColumn("_n", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x)))
    finite = F.col("_n").isNotNull() & ~F.isnan("_n") & (F.col("_n") > 0) & (F.col("_n") < float("inf"))
    return df.filter(finite).withColumn("unit", F.transform("_v", lambda x: x / F.col("_n"))).drop("_v", "_n")


def best_of(asked: np.ndarray, held: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place, places of the ``k`` best rows of ``held`` and their scores for each row of ``asked``, by score rounded to twelve places, then id; the product is made in slices."""
    rows = max(1, SCORES // max(1, len(held)))
    ids = np.where(np.isnan(ids), -np.inf, ids) if ids.dtype.kind == "f" else ids
    for start in range(0, len(asked), rows):
        for i, score in enumerate(np.round(asked[start:start + rows] @ held.T, 12), start):
            sure = np.where(np.isnan(score), -np.inf, score)
            fit = np.arange(len(ids)) if len(ids) <= k else np.flatnonzero(sure >= np.partition(sure, len(ids) - k)[len(ids) - k])
            order = fit[np.lexsort((ids[fit], -sure[fit]))][:k]
            yield i, order, score[order]


def build(vectors: DataFrame, name: str, path: str, id_col: str, vector: str, payload: list[str] = (), cells: int | None = None, buckets: int = 8, seed: int = 5) -> VectorIndex:
    """File every vector under its nearest cell, in a table bucketed by cell, so that a search reads and joins without moving it.

    Cells are fitted on at most ``SAMPLE`` vectors, the ones with the least hashes of their ids; there are twice the square
    root of that many.
    """
    units = unit(vectors, vector).select(F.col(id_col).alias("id"), "unit", *payload)
    sample = np.array([r.unit for r in units.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("unit").collect()])
    centres = _fit(sample, cells or max(1, int(2 * len(sample) ** 0.5)), seed) if len(sample) else np.zeros((1, 1))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields) + ", cells array<int>"
    filed = units.mapInArrow(_filed(centres, 1, units.columns), schema).withColumn("cell", F.get("cells", F.lit(0))).drop("cells")
    filed.write.mode("overwrite").format("parquet").bucketBy(buckets, "cell").sortBy("cell").option("path", path).saveAsTable(name)
    return VectorIndex(name, centres)


def search(index: VectorIndex, queries: DataFrame, id_col: str, vector: str, k: int, probes: float = PROBES, where: str | None = None) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` best of the cells nearest to each query, by exact cosine.

    ``probes`` is the share of cells read for a query, ``where`` a condition on the payload, applied before scoring.
    A task compares a part of one cell with a block of queries and returns its ``k`` best: no pair table is written.
    """
    spark: SparkSession = queries.sparkSession
    asked = unit(queries, vector).select(F.col(id_col).alias("query_id"), "unit")
    most = max(1, round(probes * len(index.centres)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields) + ", cells array<int>"
    aims = asked.mapInArrow(_filed(index.centres, most, asked.columns), schema).select("query_id", F.col("unit").alias("asked"), F.explode("cells").alias("cell"))
    held = spark.table(index.table)
    held = (held.filter(where) if where else held).select("cell", "id", "unit")
    sizes = F.broadcast(held.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")))
    blocks = max(1, -(-asked.count() // ASKED))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    keys = ["cell", "part", "block"]
    held = held.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts").withColumn("block", every(F.lit(blocks)))
    aims = aims.join(sizes, "cell").withColumn("part", every(F.col("parts"))).drop("parts").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))

    def local(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left["query_id"].iloc[:0], "id": right["id"].iloc[:0], "score": np.zeros(0)})
        names, ids = left["query_id"].to_numpy(), right["id"].to_numpy()
        at, order, scores = zip(*best_of(np.stack(left["asked"].to_numpy()), np.stack(right["unit"].to_numpy()), ids, k), strict=True)
        return pd.DataFrame({"query_id": np.repeat(names[list(at)], [len(o) for o in order]), "id": ids[np.concatenate(order)], "score": np.concatenate(scores)})

    kinds = [queries.schema[id_col].dataType.simpleString(), spark.table(index.table).schema["id"].dataType.simpleString()]
    scored = aims.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(local, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
