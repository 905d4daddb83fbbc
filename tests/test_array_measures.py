"""Measures over arrays: right values, and each shared part of an expression worked out once."""

import re

import numpy as np
from pyspark.sql import functions as F

from touchline.operators import block, geometry, lines, pressure


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_medians_sort_once(spark):
    cases = [[3.0, 1.0, 2.0], [5.0, 1.0, 9.0, 2.0], [4.0], [], None, [1.0, None, 3.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, v array<double>").select(
        "i", geometry.median_of(F.col("v")).alias("m"), block.quantile(F.col("v"), 0.9).alias("q"))
    got = {r.i: (r.m, r.q) for r in df.collect()}
    assert [got[i][0] for i in range(6)] == [2.0, 3.5, 4.0, None, None, 3.0]
    assert np.allclose([got[i][1] for i in range(3)], [np.quantile(v, 0.9) for v in cases[:3]])
    assert len(re.findall(r"sort_array\(|array_sort\(", plan(df))) == 2


def test_cover_and_lines_repeat_nothing(spark):
    near = spark.createDataFrame([([(0.1,), (1.5,), (-2.0,)],)], "near array<struct<angle: double>>").select(pressure._cover(F.col("near")).alias("c"))
    c = near.first().c
    assert c.occupied == 3 and abs(c.gap - np.degrees(2 * np.pi - 3.5)) < 1e-9 and len(re.findall(r"sort_array\(|array_sort\(", plan(near))) == 1
    players = [(x, i, x, float(i), 1.0) for i, x in enumerate([-30.0, -29.0, -10.0, 5.0, 6.0, 7.0])]
    df = spark.createDataFrame([(players,)], "r array<struct<x_attack: double, track_id: bigint, x_m: double, y_m: double, team_confidence: double>>").select(lines._lines(F.col("r")).alias("l"))
    assert [(x.name, x.players, x.median_x_attack, list(x.track_ids)) for x in df.first().l] == [
        ("DEFENSIVE_LINE", 2, -29.5, [0, 1]), ("MIDFIELD_LINE", 1, -10.0, [2]), ("ATTACKING_LINE", 3, 6.0, [3, 4, 5])]
    assert plan(df).count("sequence(") == 1


def test_ambiguous_boxes_packs_a_frame_once(spark):
    from touchline.operators import tracking

    r = np.random.default_rng(7)
    boxes = [(s, f, i, x, y, x + 30.0, y + 90.0) for i, (s, f, x, y) in enumerate((s, f, *r.uniform(0, 160, 2).tolist()) for s in "ab" for f in (5, 6) for _ in range(8))]
    boxes += [("a", 5, 900, None, 0.0, 30.0, 90.0), ("b", 1, 901, 500.0, 0.0, 530.0, 90.0)]
    cols = "sequence_id string, frame_index long, det_id long, x1 double, y1 double, x2 double, y2 double"
    dets = spark.createDataFrame(boxes, cols)
    got = tracking.ambiguous(dets, dets.filter("det_id % 3 = 0"), dets.filter("det_id % 3 = 1"))
    assert plan(got).count("Join ") == 2 and got.columns == [*dets.columns, "reason"]

    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        shared = max(0.0, w) * max(0.0, h)
        return shared / (2 * 30.0 * 90.0 - shared)

    whole = [b for b in boxes if b[3] is not None]
    for row in (x for x in got.collect() if x.det_id < 900):
        a = boxes[row.det_id]
        same = [b for b in whole if b[:2] == a[:2]]
        touching = [t for t in same if t[2] % 3 == 0 and iou(a, t) >= tracking.COMPETITION_IOU]
        want = ("detection_overlap" if any(b[2] != a[2] and iou(a, b) >= tracking.OVERLAP_IOU for b in same) else
                "track_competition" if len(touching) > 1 or any(b[2] != a[2] and iou(t, b) >= tracking.COMPETITION_IOU for t in touching for b in same) else
                "lost_reacquisition" if any(t[2] % 3 == 1 and (iou(a, t) >= tracking.LOST_IOU or np.hypot((a[3] + a[5] - t[3] - t[5]) / 2, (a[4] + a[6] - t[4] - t[6]) / 2) <= tracking.LOST_PX) for t in same) else None)
        # the box with a missing edge may add an overlap of its own
        assert row.reason == want or (a[:2] == ("a", 5) and row.reason == "detection_overlap")
    assert {x.det_id: x.reason for x in got.filter("det_id = 901").collect()} == {901: "seed_initial"}
