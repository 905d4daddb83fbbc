"""Name matching, LIKE patterns and redaction."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf


def _fold(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else "".join(
        c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn").lower())


def fold_accents(name: Column) -> Column:
    """Lower-cased text without combining marks, over the whole of Unicode."""
    return pandas_udf(_fold, "string")(name)


def contains_name(column: Column, part: str) -> Column:
    """``LIKE '%part%'`` as the statistics store reads it: letter case ignored, ``_`` and ``%`` are wildcards."""
    return column.ilike(f"%{part}%")


def season_pattern(season: str) -> str:
    """``season_2024_summary`` and ``season_2024`` both name every competition of that season."""
    return season.replace("_summary", "") + "_%"


def redact_url(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")
