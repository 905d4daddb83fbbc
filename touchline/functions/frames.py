"""Window helpers for long sequences.

A window over ``partitionBy(sequence)`` sends a whole sequence to one task.  The helpers below cut every
sequence into spans of frames first, so one very long sequence is spread over many tasks, and give the same
result as the plain window:

* ``halo``          -- windows that look a bounded number of frames back or ahead;
* ``last_known``    -- the last non-null value so far, however far back it lies;
* ``running_sum``   -- a cumulative sum from the start of the sequence.

The last two work in two levels: inside a span, and over one summary row per span.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SPAN = 4096
_SPAN_COL = "_span"


def span_of(order: str, span: int) -> Column:
    return F.floor(F.col(order) / F.lit(span)).cast("long")


def halo(df: DataFrame, keys: Sequence[str], order: str, apply: Callable[[DataFrame, list[str]], DataFrame],
         before: int = 0, after: int = 0, span: int = SPAN) -> DataFrame:
    """Run ``apply(rows, partition_keys)`` on spans that also hold their neighbours' edge rows.

    Each row is copied only into the spans whose window can reach it (``before``/``after`` frames), and the
    copies are dropped once the windows are evaluated.
    """
    first = F.floor((F.col(order) - F.lit(after)) / F.lit(span)).cast("long")
    last = F.floor((F.col(order) + F.lit(before)) / F.lit(span)).cast("long")
    spread = df.withColumn(_SPAN_COL, F.explode(F.sequence(first, last)))
    out = apply(spread, [*keys, _SPAN_COL])
    return out.filter(F.col(_SPAN_COL) == span_of(order, span)).drop(_SPAN_COL)


def _window(keys: Sequence[str], order: Sequence[Column | str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def last_known(df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str], span: int = SPAN,
               strict: bool = False) -> DataFrame:
    """Add ``columns[src]`` = last non-null ``src`` up to the current row (before it when ``strict``)."""
    marked = df.withColumn(_SPAN_COL, span_of(order, span))
    inner = [*keys, _SPAN_COL]
    end = -1 if strict else 0
    here = _window(inner, [order]).rowsBetween(Window.unboundedPreceding, end)
    for source, target in columns.items():
        marked = marked.withColumn(target, F.last(source, ignorenulls=True).over(here))
    ends = marked.groupBy(*inner).agg(
        *[F.max_by(F.col(s), F.when(F.col(s).isNotNull(), F.col(order))).alias(f"_end_{s}") for s in columns])
    prior = _window(keys, [_SPAN_COL]).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*inner, *[F.last(f"_end_{s}", ignorenulls=True).over(prior).alias(f"_in_{s}")
                                    for s in columns])
    joined = marked.join(carried, inner, "left")
    for source, target in columns.items():
        joined = joined.withColumn(target, F.coalesce(F.col(target), F.col(f"_in_{source}")))
    return joined.drop(_SPAN_COL, *[f"_in_{s}" for s in columns])


def running(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, tuple[str, Column]],
            span: int = SPAN) -> DataFrame:
    """Add running aggregates up to the current row: ``values[target] = (how, column)``, ``how`` sum, max or min."""
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}
    marked = df.withColumn(_SPAN_COL, span_of(order, span))
    for target, (_, column) in values.items():
        marked = marked.withColumn(f"_v_{target}", column)
    inner = [*keys, _SPAN_COL]
    here = _window(inner, [order]).rowsBetween(Window.unboundedPreceding, 0)
    totals = marked.groupBy(*inner).agg(*[fold[how](f"_v_{t}").alias(f"_t_{t}") for t, (how, _) in values.items()])
    prior = _window(keys, [_SPAN_COL]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*inner, *[fold[how](f"_t_{t}").over(prior).alias(f"_o_{t}") for t, (how, _) in values.items()])
    out = marked.select("*", *[fold[how](f"_v_{t}").over(here).alias(f"_h_{t}") for t, (how, _) in values.items()])
    out = out.join(offsets, inner, "left")
    for target, (how, _) in values.items():
        out = out.withColumn(target, join[how](F.col(f"_h_{target}"), F.col(f"_o_{target}")))
    return out.drop(_SPAN_COL, *[f"_{p}_{t}" for t in values for p in "vho"])


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: Column, target: str, span: int = SPAN) -> DataFrame:
    return running(df, keys, order, {target: ("sum", value)}, span)


def ordinal(df: DataFrame, keys: Sequence[str], order: str, target: str, span: int = SPAN) -> DataFrame:
    """Number the rows of each key 1, 2, 3 ... by ``order``."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), target, span)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], frame: str, target: str, span: int = SPAN) -> DataFrame:
    """Number the rows of each key by ``order``, which must agree with the integer ``frame``: spans of it are numbered
    apart and moved on by what the spans before them hold."""
    marked = df.withColumn(_SPAN_COL, F.coalesce(span_of(frame, span), F.lit(-1).cast("long")))
    inner = [*keys, _SPAN_COL]
    prior = _window(keys, [_SPAN_COL]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy(*inner).agg(F.count(F.lit(1)).alias("_rows_in_span"))
    before = sizes.select(*inner, F.coalesce(F.sum("_rows_in_span").over(prior), F.lit(0)).alias("_rows_before"))
    placed = marked.withColumn("_row_in_span", F.row_number().over(_window(inner, order)))
    return placed.join(before, inner).withColumn(target, (F.col("_row_in_span") + F.col("_rows_before")).cast("long")).drop(_SPAN_COL, "_row_in_span", "_rows_before")


def previous_row(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], prefix: str = "prev_",
                 span: int = SPAN) -> DataFrame:
    """Add ``prev_<c>`` = value of ``c`` on the previous row of the key, whatever the gap."""
    packed = df.withColumn("_row", F.struct(*columns))
    out = last_known(packed, keys, order, {"_row": "_prev"}, span=span, strict=True)
    return out.select(*[c for c in df.columns], *[F.col(f"_prev.{c}").alias(f"{prefix}{c}") for c in columns])


def islands(df: DataFrame, keys: Sequence[str], order: str, starts: Column, target: str = "island",
            span: int = SPAN) -> DataFrame:
    """Number the runs of rows in each key; ``starts`` is true on the first row of a run."""
    return running_sum(df, keys, order, F.when(starts, F.lit(1)).otherwise(F.lit(0)).cast("long"), target, span=span)
