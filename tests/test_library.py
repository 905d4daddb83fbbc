"""SQL functions, vector index, bucketed tables, assignment by parts, header generations, mixture of teams."""

import itertools
import random
import re
import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import sql_functions
from touchline.operators import evaluation, evidence, teams, vector_index
from touchline.plans import all_queries
from touchline.session import new_path
from touchline.sources import readers

SF = "/root/testdata/sf0.01"


def best_total(edges):
    """Largest total gain of a one-to-one choice, by trying all."""
    left = sorted({a for a, _, _ in edges})
    gain = {(a, b): g for a, b, g in edges}
    right = sorted({b for _, b, _ in edges}) + [None] * len(left)
    return max(sum(gain.get(p, 0) for p in zip(left, chosen)) for chosen in itertools.permutations(right, len(left)))


def test_parts_give_the_best_assignment():
    pick = random.Random(3)
    for _ in range(150):
        edges = list({(pick.randrange(4), pick.randrange(4)): pick.randrange(1, 9) for _ in range(pick.randrange(1, 7))}.items())
        edges = [(a, b, g) for (a, b), g in edges]
        chosen = evaluation._best_of(edges, edges)
        assert len({a for a, _, _ in chosen}) == len({b for _, b, _ in chosen}) == len(chosen) and sum(g for *_, g in chosen) == best_total(edges)


def test_tied_assignments_are_told_by_the_sum_of_the_frame():
    tie = [(0, 0, 0.5), (21, 0, 0.5)]
    assert [e[:2] for e in evaluation._best_of(tie, tie)] == [(0, 0)]
    between = [(1, 1, 0.2), (1, 2, 0.01), (2, 3, 0.1), (2, 4, 0.01)]
    assert 0.7 + 0.2 + 0.1 < 0.2 + 0.1 + 0.7 and 0.1 + 0.2 + 0.1 == 0.2 + 0.1 + 0.1
    for gain, told in ((0.7, 21), (0.1, 0)):
        edges = [(0, 0, gain), *between, (21, 0, gain)]
        assert {e[:2] for e in evaluation._best_of(edges, edges)} == {(told, 0), (1, 1), (2, 3)}
    same = [(a, b, 1.0) for a in range(14) for b in range(14)]  # too many ways to tell apart: any best one
    assert len(evaluation._best_of(same, same)) == 14


def test_overlap_parts(spark):
    rows = [("s", 1, 10, 1), ("s", 2, 10, 1), ("s", 2, 11, 1), ("s", 3, 11, 1), ("s", 7, 12, 1), ("t", 1, 10, 1)]
    got = evaluation.overlap_parts(spark.createDataFrame(rows, "sequence_id string, track_id long, pred_track_id long, n long"))
    assert sorted({(r.sequence_id, r.track_id, r.part) for r in got.collect()}) == [("s", 1, 1), ("s", 2, 1), ("s", 3, 1), ("s", 7, 7), ("t", 1, 1)]


def test_sql_functions(spark):
    sql_functions.register(spark)
    got = spark.sql("SELECT v.k, i.at, i.place FROM VALUES (1, 3L, 9L), (2, 5L, 4L), (3, NULL, 4L) AS v(k, a, b), LATERAL explode_intervals(v.a, v.b, 3) i").collect()
    assert sorted(map(tuple, got)) == [(1, 3, 0), (1, 6, 1), (1, 9, 2)]
    with pytest.raises(Exception, match="whole number"):
        spark.sql("SELECT * FROM explode_intervals('a', 4L)").collect()
    spark.createDataFrame([("x", 1, 1, 0.9), ("x", 1, 2, 0.8), ("x", 2, 1, 0.8), ("y", 5, 5, 0.1), ("y", None, 5, 0.1)], "g string, a long, b long, gain double").createOrReplaceTempView("pair_rows")
    got = spark.sql("SELECT a, b, gain FROM assign_pairs(TABLE(pair_rows) PARTITION BY g)").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 0.8), (2, 1, 0.8), (5, 5, 0.1)]
    assert spark.sql("SELECT hull_area(x, y) AS a FROM VALUES (0D, 0D), (2D, 0D), (2D, 1D), (0D, 1D), (1D, 0.5D) AS p(x, y)").first().a == 2.0
    row = spark.sql("SELECT formation_distance(array(4, 4, 2), '4-4-2') AS a, formation_distance(array(4, 4, 2), 'none') AS b, formation_distance(array(3, 5, 2), '4-4-2') AS c").first()
    assert (row.a, row.b) == (0.0, None) and row.c > 0


def test_vector_index_recall(spark):
    found = {}
    for r in all_queries()[0]["vector_top_k_index"](spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hits = [len(set(ids[np.argsort(-(x @ x[i]), kind="stable")[:10]]) & found[ids[i]]) / 10 for i in range(len(ids)) if ids[i] % 50 == 0]
    assert len(hits) == len(found) and np.mean(hits) >= 0.9


def test_vector_index_filters_and_odd_rows(spark):
    rows = [(i, [float(i % 5), 1.0, float(i % 3)], i % 2) for i in range(40)] + [(90, None, 0), (91, [0.0, 0.0, 0.0], 0), (92, [float("nan"), 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, label int")
    index = vector_index.build(df, f"t_{uuid.uuid4().hex}", new_path(spark, "cells"), "vec_id", "v", ["label"], cells=4)
    got = vector_index.search(index, df.filter("vec_id = 0"), "vec_id", "v", 3, probes=1.0, where="label = 1").collect()
    assert spark.table(index.table).count() == 41 and len(got) == 3 and all(r.id % 2 for r in got)


def test_vector_index_with_one_crowded_cell(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 7)
    monkeypatch.setattr(vector_index, "ASKED", 3)
    df = spark.createDataFrame([(i, [1.0, 0.001 * (i % 9), 0.0]) for i in range(60)], "vec_id long, v array<double>")
    index = vector_index.build(df, f"t_{uuid.uuid4().hex}", new_path(spark, "cells"), "vec_id", "v", cells=1)
    top = vector_index.search(index, df.filter("vec_id < 8"), "vec_id", "v", 6)
    got = {(r.query_id, r["rank"]): r.id for r in top.collect()}
    assert all([got[(q, k)] for k in range(1, 7)] == [q + 9 * j for j in range(6)] for q in range(6)) and len(got) == 48
    assert "SortMergeJoin" not in top._jdf.queryExecution().executedPlan().toString()


def test_bucketed_look_ups_read_one_bucket_and_join_without_exchange(spark):
    rows = spark.range(400).selectExpr("concat('s', id % 3) as sequence_id", "concat('e', id) as event_id", "id * 0.5D as a", "id * 0.5D + 1 as b")
    names = [f"t_{uuid.uuid4().hex}" for _ in range(4)]
    for name in names[:2]:
        evidence.store_by_id(rows, name, new_path(spark, "by_id"))
    for name, start, end in ((names[2], "a", "b"), (names[3], "c", "d")):
        evidence.store_by_slot(rows.selectExpr("sequence_id", f"event_id as {start}_id", f"a as {start}", f"b as {end}"), name, new_path(spark, "by_slot"), start, end)
    plan = lambda df: df._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # the plan then names the buckets, which are pruned either way
    one = evidence.by_id(spark, names[0], "e17", "s2")
    assert [r.event_id for r in one.collect()] == ["e17"] and "SelectedBucketsCount: 1 out of 8" in plan(one) and "PartitionFilters: []" not in plan(one)
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = evidence.join_by_id(spark.table(names[0]), spark.table(names[1]).selectExpr("event_id", "sequence_id", "a as a2"))
        assert both.count() == 400 and "Exchange" not in plan(both)
        near = evidence.overlapping(spark.table(names[2]), spark.table(names[3]), ("a", "b"), ("c", "d"))
        assert "Exchange" not in plan(near)
        table = rows.collect()
        want = sum(x.sequence_id == y.sequence_id and x.a <= y.b and y.a <= x.b for x in table for y in table)
        assert near.count() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_join_by_id_with_an_id_in_every_sequence(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("concat('s', id div 2) as sequence_id", "concat('e', id % 2) as event_id", "id as a")
    names = [f"t_{uuid.uuid4().hex}" for _ in range(2)]
    folders = [new_path(spark, "by_id") for _ in names]
    for name, folder in zip(names, folders):
        evidence.store_by_id(rows, name, folder)
    assert len([f for f in Path(folders[0]).rglob("*.parquet")]) <= 8 * evidence.SHARES
    plans = []
    keep = evidence.cut_lineage
    monkeypatch.setattr(evidence, "cut_lineage", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, label))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get(evidence.ALL_KEYS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = evidence.join_by_id(spark.table(names[0]), spark.table(names[1]).selectExpr("event_id", "sequence_id", "a as b"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
    assert both.count() == 4000 and both.filter("a <> b").isEmpty() and spark.conf.get(evidence.ALL_KEYS) == before[1]
    # no exchange, and no pair of two sequences is met: the sequence is a key of the join
    assert "Exchange" not in plans[0] and ">=" not in plans[0] and "SortMergeJoin [event_id" in plans[0]


def test_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Player,Min,Gls\n"Last, First",90,2\nB,x,\n')
    (tmp_path / "b.csv").write_text("KP,Player,npxG,xG,Squad,Player\n7,C,9,1.5,Team,no\n")
    (tmp_path / "c.csv").write_text("Player,Min,Gls\n")
    (tmp_path / "d.csv").write_text("")
    got = {r.player_name: (r.minutes_played, r.goals, r.expected_goals, r.key_passes, r.team_name) for r in readers.read_season_files(spark, str(tmp_path), "m").collect()}
    assert got == {"Last, First": (90, 2, 0.0, 0, "Inconnu"), "B": (0, 0, 0.0, 0, "Inconnu"), "C": (0, 0, 1.5, 7, "Team")}


def test_mixture_equals_plain_maximisation(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 1, (14, 3)), r.normal(2.2, 1, (9, 3))])
    side = np.r_[np.zeros(12), np.ones(11)]
    features = spark.createDataFrame([(1, i, 5, v.tolist()) for i, v in enumerate(x)] + [(2, 0, 5, [1.0, 1.0, 1.0])], "sequence_id long, track_id long, crops long, feature array<double>")
    start = spark.createDataFrame([(1, i, f"TEAM_{int(s)}") for i, s in enumerate(side)] + [(1, 99, "UNKNOWN"), (2, 0, "TEAM_0")], "sequence_id long, track_id long, team_label string")
    got = {(g.sequence_id, g.track_id): (g.team_label, g.share) for g in teams.mixture_teams(features, start).collect()}
    share = side.copy()
    for _ in range(teams.MOST_ROUNDS):
        m0, m1 = ((w[:, None] * x).sum(axis=0) / w.sum() for w in (1 - share, share))
        d0, d1 = ((x - m0) ** 2).sum(axis=1), ((x - m1) ** 2).sum(axis=1)
        s2, w1 = ((1 - share) * d0 + share * d1).sum() / x.size, share.mean()
        new = np.clip(1 / (1 + np.exp(-(np.log(w1) - np.log(1 - w1) + (d0 - d1) / (2 * s2)))), 1e-6, 1 - 1e-6)
        moved, share = np.abs(new - share).max(), new
        if moved <= teams.STILL:
            break
    assert all(abs(got[1, i][1] - share[i]) < 1e-6 and got[1, i][0] == f"TEAM_{int(share[i] >= 0.5)}" for i in range(len(x)))
    assert got[1, 99] == ("UNKNOWN", None) and got[2, 0] == ("TEAM_0", 0.0)


def test_rounds_of_the_split_broadcast_no_tracks(spark, tmp_path, monkeypatch):
    rows = [("s", t, 5, [float(t % 2), 0.1 * t, 1.0]) for t in range(12)]
    spark.createDataFrame(rows, "sequence_id string, track_id long, crops long, feature array<double>").write.parquet(str(tmp_path / "features"))
    features = spark.read.parquet(str(tmp_path / "features"))
    plans, cut = [], teams.cut_lineage

    def recorded(df, label="step"):
        if {"c0", "_old"} & set(df.columns):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, label)

    monkeypatch.setattr(teams, "cut_lineage", recorded)
    teams.mixture_teams(features, teams.split_teams(features)).collect()
    # the tracks are the left side of the last join of each round
    assert len(plans) > 2 and all(re.search("Build(Left|Right)", p)[1] == "Right" for p in plans)
