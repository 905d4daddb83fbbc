import random

import numpy as np
from itertools import permutations
from pyspark.sql import Window, functions as F

from touchline.functions import frames
from touchline.functions.bands import near_join, overlap_join
from touchline.functions.scan import scan
from touchline.operators import block, smoothing
from touchline.operators.evaluation import assign


def series(spark, n=200, seed=3):
    rng = random.Random(seed)
    rows = [(k, f, rng.choice([None, 1.0, 2.0, 5.0])) for k in ("a", "b") for f in sorted(rng.sample(range(3 * n), n))]
    return spark.createDataFrame(rows, "k string, f long, v double").repartition(4)


def table(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_span_helpers_equal_plain_windows(spark):
    df = series(spark)
    w = Window.partitionBy("k").orderBy("f")
    plain = (df.withColumn("known", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("prev_v", F.lag("v").over(w)))
    known = frames.last_known(df, ["k"], "f", {"v": "known"}, span=16)
    assert table(known, "k", "f", "known") == table(plain, "k", "f", "known")
    total = frames.running_sum(df, ["k"], "f", F.col("v"), "total", span=16).withColumn("total", F.col("total"))
    assert table(total.fillna(0.0), "k", "f", "total") == table(plain.fillna(0.0), "k", "f", "total")
    assert table(frames.previous_row(df, ["k"], "f", ["v"], span=16), "k", "f", "prev_v") == table(plain, "k", "f", "prev_v")


def test_halo_equals_plain_range_window(spark):
    df = series(spark)
    w = lambda keys: Window.partitionBy(*keys).orderBy("f").rangeBetween(-7, 4)
    out = frames.halo(df, ["k"], "f", lambda rows, keys: rows.withColumn("m", F.max("v").over(w(keys))), before=7, after=4, span=10)
    assert table(out, "k", "f", "m") == table(df.withColumn("m", F.max("v").over(w(["k"]))), "k", "f", "m")


def test_band_joins_equal_nested_loops(spark):
    rng = random.Random(5)
    a = [("s", i, float(x), float(x + rng.randint(0, 30))) for i, x in enumerate(rng.sample(range(300), 40))]
    b = [("s", i, float(x), float(x + rng.randint(0, 30))) for i, x in enumerate(rng.sample(range(300), 40))]
    left, right = spark.createDataFrame(a, "s string, i long, a0 double, a1 double"), spark.createDataFrame(b, "s string, j long, b0 double, b1 double")
    got = sorted((r.i, r.j) for r in overlap_join(left, right, ["s"], ("a0", "a1"), ("b0", "b1"), 7.0).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[2] <= y[3] and y[2] <= x[3])
    got = sorted((r.i, r.j) for r in near_join(left, right, ["s"], "a0", "b0", 9).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if abs(x[2] - y[2]) <= 9)


def test_chunked_scan_equals_one_pass(spark):
    rng = random.Random(7)
    cats = ["UNKNOWN", "LOW_BLOCK", "MID_BLOCK"]
    current, rows = "LOW_BLOCK", []
    for f in range(600):
        current = rng.choice(cats) if rng.random() < 0.12 else current
        rows.append(("S", f, "TEAM_0", current))
    df = spark.createDataFrame(rows, "sequence_id string, frame_index long, team_label string, category string").repartition(3)
    whole = block.hysteresis(df, chunk=10000)
    for size in (7, 64):
        assert table(block.hysteresis(df, chunk=size), "frame_index", "confirmed", "changed") == table(whole, "frame_index", "confirmed", "changed")


def test_chunked_kalman_equals_one_pass(spark):
    rng = random.Random(2)
    rows = [("S", 1, f, f / 25.0, rng.random() > 0.1, rng.uniform(-50, 50), rng.uniform(-30, 30)) for f in range(300)]
    df = spark.createDataFrame(rows, "sequence_id string, track_id long, frame_index long, timestamp_s double, position_valid boolean, x_m double, y_m double")
    cols = ["frame_index", "smooth_x", "vx", "speed"]
    assert table(smoothing.kalman(df, chunk=20), *cols) == table(smoothing.kalman(df), *cols)


def test_counting_state_that_never_forgets(spark):
    import pandas as pd

    def step(state, pdf):
        n = state.get("n", 0)
        out = []
        for _ in range(len(pdf)):
            n += 1
            out.append(n)
        return pdf[["k", "f"]].assign(n=out), {"n": n}

    df = spark.range(50).select(F.lit("a").alias("k"), F.col("id").alias("f"))
    got = {r.f: r.n for r in scan(df, ["k"], "f", step, "k string, f long, n long", chunk=9).collect()}
    assert got == {i: i + 1 for i in range(50)}


def test_assignment_is_least_cost():
    rng = np.random.default_rng(1)
    for shape in ((3, 5), (5, 3), (4, 4), (1, 6)):
        cost = rng.random(shape)
        best = min(sum(cost[i, j] for i, j in zip(range(shape[0]), p)) for p in permutations(range(shape[1]), shape[0])) if shape[0] <= shape[1] else min(
            sum(cost[i, j] for j, i in zip(range(shape[1]), p)) for p in permutations(range(shape[0]), shape[1]))
        assert np.isclose(sum(cost[i, j] for i, j in assign(cost)), best)
