import math

import numpy as np
from pyspark.sql import functions as F

from touchline.functions import boxes as bx
from touchline.functions.hull import hull_of
from touchline.operators import geometry as geo


def players(spark, points, team="TEAM_0"):
    rows = [("S", 1, 0.0, i, team, "OUTFIELD_PLAYER", float(x), float(y), True, 1.0) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "sequence_id string, frame_index long, timestamp_s double, track_id long, team_label string, role string, "
                                       "x_m double, y_m double, position_valid boolean, team_confidence double")


RECTANGLE = [(-15, -10), (15, -10), (15, 10), (-15, 10)]


def test_rectangle_hull_and_shape(spark):
    row = geo.with_hull(geo.team_shape(players(spark, RECTANGLE))).first()
    assert (row.hull_area_m2, row.hull_perimeter_m, row.width_m, row.span_m) == (600.0, 100.0, 20.0, 30.0)
    assert math.isclose(row.stretch_m, math.hypot(15, 10))


def test_degenerate_hulls():
    assert hull_of(np.array([[0.0, 0.0], [1.0, 1.0]])) == (None, None, [])
    area, perimeter, _ = hull_of(np.array([[0.0, 0.0], [10.0, 0.0], [30.0, 0.0]]))
    assert (area, perimeter) == (0.0, 60.0)
    assert hull_of(np.array([[1.0, 1.0]] * 4)) == (0.0, 0.0, [])


def test_one_player_has_a_centroid_but_no_extent(spark):
    row = geo.with_pair_distances(geo.team_shape(players(spark, [(3, 4)]))).first()
    assert (row.centroid_x, row.width_m, row.stretch_m, row.mean_pairwise_m) == (3.0, None, None, None)


def test_gate_drops_weak_unknown_and_off_pitch_rows(spark):
    rows = [("0", 0.0, True, 0.4), ("RIGHT", 0.0, True, 0.39), ("referee", 0.0, True, 1.0), ("B", 60.0, True, 1.0), ("left", 0.0, False, 1.0), ("B", 1.0, True, 1.0)]
    df = spark.createDataFrame([(t, x, 0.0, ok, c) for t, x, ok, c in rows], "team_label string, x_m double, y_m double, position_valid boolean, team_confidence double")
    assert sorted(r.team_label for r in geo.gate(df).collect()) == ["TEAM_0", "TEAM_1"]


def test_lane_ties_take_the_first_lane(spark):
    df = spark.createDataFrame([(-20.4,), (-6.8,), (6.8,), (20.4,)], "y double").select(geo.lane(F.col("y")).alias("l"), geo.grid_cell(F.lit(0.0), F.lit(0.0)).alias("c"))
    assert [r.l for r in df.collect()] == ["left_wide", "left_half_space", "central", "right_half_space"]
    assert df.first().c == 7


def test_singular_matrix_has_no_inverse(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 2.0, 4.0, 6.0, 0.0, 0.0, 1.0],), ([2.0, 0.0, 1.0, 0.0, 4.0, 2.0, 0.0, 0.0, 1.0],)], "h array<double>")
    out = [r.i for r in df.select(bx.invert(F.col("h")).alias("i")).collect()]
    assert out[0] is None and out[1] == [0.5, 0.0, -0.5, 0.0, 0.25, -0.5, 0.0, 0.0, 1.0]
