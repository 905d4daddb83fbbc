"""A few registered queries against their SQL at the smallest scale; ``check_oracle.py`` runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CASES = ["team_shape_summary", "convex_hull", "attack_direction", "block_hysteresis", "kalman_smoothing", "possession_machine", "season_totals", "header_chunks", "stream_kalman"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", CASES)
def test_query_equals_sql(spark, con, name):
    df = entry_module.queries()[name](spark, SF)
    cur = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(cur.fetchall(), names)


def test_every_sql_text_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
