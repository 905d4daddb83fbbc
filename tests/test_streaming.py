"""Streams against their batch forms, whatever the order in which rows arrive."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.operators import fusion, transitions
from touchline.plans import all_queries
from touchline.plans.streaming_queries import pieces_of
from touchline.streaming import jobs
from touchline.session import new_path
from touchline.streaming.stateful import SHARES, expired, ordered_scan

SF = "/root/testdata/sf0.001"


def shown(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def folding(state, pdf):
    """Order matters: each value is mixed into what came before."""
    now, out = state.get("now", 0), []
    for v in pdf["value"]:
        now = (now * 31 + int(v)) % 1000003
        out.append(now)
    return pdf[["key", "frame_index"]].assign(folded=out), {"now": now}


@pytest.fixture(scope="module")
def rows(spark):
    pick = random.Random(4)
    table = [(k, f, pick.randrange(1000)) for k in ("a", "b", "c") for f in range(1, 200 if k == "a" else 90)]
    return spark.createDataFrame(table, "key string, frame_index long, value long").withColumn("ts", jobs.frame_time(F.col("frame_index")))


def close_with(state, key):
    return pd.DataFrame([{"key": key[0], "frame_index": -1, "folded": state["now"]}])


def test_ordered_scan_equals_the_serial_run(spark, rows):
    out = jobs.run_to_the_end(pieces_of(rows, disorder=45), lambda s: ordered_scan(s, ["key"], "frame_index", folding, "key string, frame_index long, folded long", 4000, finish=close_with))
    want = []
    for key, part in rows.toPandas().sort_values("frame_index").groupby("key"):
        done, state = folding({}, part)
        want += [(key, f, v, False) for f, v in zip(done["frame_index"], done["folded"])] + [(key, -1, state["now"], False)]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_rows_that_come_too_late_are_marked(spark, rows):
    late = rows.withColumn("arrives", F.col("frame_index") + F.when(F.col("frame_index") % 10 == 0, 130).otherwise(0))
    out = jobs.run_to_the_end(pieces_of(late, "arrives", 0), lambda s: ordered_scan(s, ["key"], "frame_index", folding, "key string, frame_index long, folded long", 400))
    got = out.groupBy("late").agg(F.count(F.lit(1)).alias("n"), F.count("folded").alias("known")).collect()
    count = {r.late: (r.n, r.known) for r in got}
    assert count[False][0] + count[True][0] == rows.count() and count[True][1] == 0 and count[True][0] > 5


def test_silent_keys_are_forgotten(spark):
    """State of a key that has been silent for long goes; its next row starts anew."""
    table = spark.createDataFrame([("a", f, 1) for f in (1, 2, 2000)] + [("b", f, 1) for f in range(1, 2001, 50)], "key string, frame_index long, value long").withColumn("ts", jobs.frame_time(F.col("frame_index")))
    stream = jobs.file_stream(spark, jobs.in_pieces(table, "frame_index", 500), table.schema, 1)
    out = jobs.run_to_the_end(stream, lambda s: ordered_scan(s, ["key"], "frame_index", folding, "key string, frame_index long, folded long", 400, 20000, "1 second"))
    assert sorted((r.frame_index, r.folded) for r in out.filter("key = 'a'").collect()) == [(1, 1), (2, 32), (2000, 1)]


def test_machines_of_many_keys_share_their_state(spark):
    """Groups of the stream are shares of the keys, and every key still runs by itself."""
    table = spark.range(3000).selectExpr("id % 1000 AS key", "id div 1000 + 1 AS frame_index", "id % 7 AS value").withColumn("ts", jobs.frame_time(F.col("frame_index")))
    stream = jobs.file_stream(spark, jobs.in_pieces(table, "frame_index", 2), table.schema, 1)
    out = jobs.run_to_the_end(stream, lambda s: ordered_scan(s, ["key"], "frame_index", folding, "key long, frame_index long, folded long", 40, shares=4))
    assert out.count() == 3000 and out.filter("late").isEmpty()
    want = {}
    for r in table.orderBy("frame_index").collect():
        want[r.key] = [*want.get(r.key, []), ((want.get(r.key) or [0])[-1] * 31 + r.value) % 1000003]
    assert all(r.folded == want[r.key][r.frame_index - 1] for r in out.collect())


def test_retention(spark):
    table = spark.createDataFrame([(i % 3, i) for i in range(1, 60)], "key long, id long").withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("id")))
    stream = jobs.file_stream(spark, jobs.in_pieces(table, "id", 20), table.schema, 1)
    assert sorted(r.id for r in jobs.run_available(expired(stream, "key", "id", 30000)).collect()) == list(range(1, 29))


def test_retention_has_one_timer_for_rows_that_fall_due_together(spark):
    """Timers follow moments, not keys."""
    table = spark.range(600).select(F.col("id").alias("key"), "id", F.timestamp_seconds(F.lit(1704067200) + F.when(F.col("id") == 599, 500).otherwise(0)).alias("ts"))
    stream = jobs.file_stream(spark, jobs.in_pieces(table.withColumn("n", F.lit(0)), "n", 1), table.schema, 1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    try:
        job = expired(stream, "key", "id", 30000).writeStream.format("memory").queryName("given_up").option("checkpointLocation", new_path(spark, "retention")).trigger(availableNow=True).start()
        job.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    timers = sum(p["stateOperators"][0]["customMetrics"].get("numRegisteredTimers", 0) for p in job.recentProgress if p["stateOperators"])
    assert 0 < timers <= 2 * SHARES and spark.table("given_up").count() == 599


def test_passes_equal_the_batch(spark):
    queries = all_queries()[0]
    stream, batch = queries["stream_pass_events"](spark, SF), queries["pass_events"](spark, SF)
    rounded = [F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in batch.dtypes]
    assert batch.count() > 0 and shown(stream.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in batch.dtypes])) == shown(batch.select(*rounded))


def test_transition_step_in_any_chunks():
    frames = [{"sequence_id": "s", "frame_index": f, "timestamp_s": f / 25, "visible": 20, "pressure_index": (f * 7 % 10) / 10, "d1": 2.0, "v1": None, "n_r3": 1, "n_r5": 2, "coverage": 0.1, "ball_x": f / 5,
               "TEAM_0": {"direction": 1, "line_height_m": 30.0 + f, "depth_m": 20.0, "width_m": 30.0, "centroid_to_ball_m": 9.0}, "TEAM_1": None,
               "loss_ts": 0.4, "losing_team": "TEAM_0" if f in (10, 20) else None, "gaining_team": "TEAM_1", "change_conf": 0.8} for f in range(1, 60)]
    whole, _ = transitions.transition_step({}, pd.DataFrame(frames))
    parts, state = [], {}
    for a in range(0, 59, 7):
        out, state = transitions.transition_step(state, pd.DataFrame(frames[a:a + 7]))
        parts.append(out)
    assert whole["loss_frame"].tolist() == [10, 20] and len(state["pending"]) == 0 and len(state["recent"]) == 25
    pd.testing.assert_frame_equal(whole, pd.concat(parts, ignore_index=True), check_dtype=False)


def test_episode_is_closed_at_the_end():
    base = {"sequence_id": "s", "defending_team": "TEAM_0", "target_team": "TEAM_1", "d1": 3.0, "max_closing": None, "players": 9, "possession_team": None}
    table = pd.DataFrame([{**base, "frame_index": f, "timestamp_s": f / 25, "pressure_index": 0.5 if 5 <= f < 12 else None} for f in range(1, 30)])
    out, state = fusion.episode_step({}, table)
    end = fusion.episode_finish(state, ("s", "TEAM_0"))
    assert out.empty and (end.start_frame[0], end.end_frame[0], end.closed[0]) == (5, 29, False) and fusion.episode_finish({}, ()) is None
