"""Sequential operators whose next state depends on their own last output.

A sequence is cut into chunks of frames and every chunk is one group, so no task ever holds a whole
sequence.  All chunks first run in parallel from the empty state; a chunk whose true starting state (the end
state of the chunk before it) differs from the one it was run with is run again, until every chunk started
where its predecessor ended.  That fixed point is the sequential result.  Trackers and state machines forget
quickly, so two or three rounds are usual; a sequence of one chunk needs none.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from touchline.session import cut_lineage

CHUNK = 4096
Step = Callable[[dict[str, Any], pd.DataFrame], tuple[pd.DataFrame, dict[str, Any]]]


def _load(text: Any) -> dict[str, Any]:
    return json.loads(text) if isinstance(text, str) and text else {}


def scan(rows: DataFrame, keys: Sequence[str], order: str | Sequence[str], step: Step, schema: str | T.StructType,
         chunk: int = CHUNK) -> DataFrame:
    """Apply ``step(state, rows_of_chunk)`` in frame order; ``state`` is a JSON-able dict, empty at the start.

    ``order[0]`` is the integer frame number the chunks are cut by.
    """
    order = [order] if isinstance(order, str) else list(order)
    keys = list(keys)
    group = [*keys, "_chunk"]
    parts = rows.withColumn("_chunk", F.floor(F.col(order[0]) / F.lit(chunk)).cast("long"))
    out_schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    starts = _starting_states(parts, keys, order, step)

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        result, _ = step(_load(pdf["_state"].iloc[0]), pdf)
        return result[[f.name for f in out_schema.fields]]

    if starts is None:
        ready = parts.withColumn("_state", F.lit(None).cast("string"))
    else:
        ready = parts.join(starts, group, "left")
    return ready.groupBy(*group).applyInPandas(emit, out_schema)


def _starting_states(parts: DataFrame, keys: list[str], order: list[str], step: Step) -> DataFrame | None:
    """State each chunk starts with, or None when every key fits in one chunk."""
    group = [*keys, "_chunk"]
    chunks = parts.select(*group).distinct()
    if chunks.groupBy(*keys).count().filter("count > 1").isEmpty():
        return None
    parts = cut_lineage(parts)
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*group).schema.fields)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        _, state = step(_load(pdf["_state"].iloc[0]), pdf)
        head = {k: pdf[k].iloc[0] for k in group}
        return pd.DataFrame([{**head, "_end": json.dumps(state, sort_keys=True)}])

    known = cut_lineage(chunks.withColumn("_state", F.lit("")).withColumn("_end", F.lit(None).cast("string")))
    due = known.select(*group, "_state")
    while True:
        ends = (parts.join(due, group).groupBy(*group)
                .applyInPandas(finish, f"{key_types}, _end string").withColumnRenamed("_end", "_new_end"))
        merged = (known.join(due.withColumnRenamed("_state", "_ran"), group, "left").join(ends, group, "left")
                  .select(*group, F.coalesce("_ran", "_state").alias("_state"), F.coalesce("_new_end", "_end").alias("_end")))
        before = F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk"))
        known = cut_lineage(merged.withColumn("_want", F.coalesce(before, F.lit(""))))
        due = known.filter("_want <> _state").select(*group, F.col("_want").alias("_state"))
        known = known.drop("_want")
        if due.isEmpty():
            return known.select(*group, "_state")
