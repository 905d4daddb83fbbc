"""Helpers shared by the corpus operators: picking columns by name and walking Arrow batches in small slices."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, functions as F

SLICE_BYTES = 4 << 20


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``columns[new] = old`` whatever else the table holds.

    Columns are found by position, so names that differ only in case, repeated names and dots do no harm. An exact
    match goes before one in another case, the first of several before the others.
    """
    by_place = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return by_place.select(*[F.col(f"c{place(df.columns, old)}").alias(new) for new, old in columns.items()])


def place(names: list[str], wanted: str) -> int:
    """Position of a column: the first of that name, or else the first of that name in another case."""
    exact = [i for i, c in enumerate(names) if c == wanted]
    other = [i for i, c in enumerate(names) if c.lower() == wanted.lower()]
    if not other:
        raise ValueError(f"no column {wanted!r} among {names}")
    return (exact or other)[0]


def qualified(spark, path: str) -> str:
    """``path`` with the scheme that Spark itself would give it: its own, or that of the default file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most`` bytes in each; a longer single value comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        offsets = pa.compute.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(offsets):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        yield batch.slice(start)


def raw(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The UTF-8 bytes of a text column, without decoding."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def labelled_sample(labels: DataFrame, value: str, most: int, id_col: str = "doc_id", where=None) -> DataFrame:
    """``doc_id, label`` of at most ``most`` labelled documents, chosen by a hash of the id; the same on every run.

    Rows without id or label are left out. Of several labels of one id the greatest holds. The ids with the least hashes are
    taken: a share that holds them all but surely is cut out first, so that few rows meet, and ``most`` of those by rank.
    """
    known = pick(labels, doc_id=id_col, label=value).filter("doc_id is not null and label is not null")
    if where is not None:
        known = known.filter(where)
    once = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, (most + 10 * most ** 0.5 + 10) / max(1, once.count()))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    return once.filter(rank < int(share * (1 << 40))).orderBy(rank, "doc_id").limit(most)
