"""Streaming queries: each runs over the events files and is checked against the batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import fusion, passes, possession as poss, smoothing, tracking as trk, transitions
from touchline.plans import views
from touchline.plans.evaluation_queries import appearance
from touchline.plans.events_queries import boxed_players, control_v1, frame_list, full_possession, team_visible, turnovers, visible
from touchline.plans.motion_queries import KALMAN_SQL, frame_pressure
from touchline.plans.registry import ORACLE, query, rounded
from touchline.plans.stats_queries import tidy
from touchline.plans.tactics_queries import block_table, directions, players
from touchline.streaming import jobs
from touchline.streaming.stateful import expired, ordered_scan


def events_stream(spark, sf_dir):
    return jobs.file_stream(spark, f"{sf_dir}/events*.parquet", views.table(spark, sf_dir, "events").schema)


def tracking_stream(spark, sf_dir):
    """The tracking view over the streamed events, with an event time."""
    rows = views.tracking_of(events_stream(spark, sf_dir))
    return rows.withColumn("ts", jobs.frame_time(F.col("f")))


SECONDS = "(epoch_ms({}) // 1000)"


@query("stream_per_second", "R1 R2", """
SELECT sequence_id, team_label, CAST(f * 40 // 1000 AS BIGINT) AS second, count(*) AS players, round(avg(x_m), 6) AS mean_x, round(avg(y_m), 6) AS mean_y FROM tracking_v GROUP BY 1, 2, 3""")
def stream_per_second(spark, sf_dir):
    out = jobs.run_to_the_end(tracking_stream(spark, sf_dir), jobs.per_second_teams)
    return tidy(out.select("sequence_id", "team_label", (F.unix_seconds("start") - 1704067200).alias("second"), "players", "mean_x", "mean_y"))


@query("stream_sliding_votes", "R3", """
WITH t AS (SELECT sequence_id, CASE WHEN x_m > 0 THEN 'RIGHT' ELSE 'LEFT' END AS side, f * 40 AS ms FROM tracking_v),
w AS (SELECT sequence_id, side, (ms // 200 + 1 + i) * 200 AS until FROM t, range(10) r(i))
SELECT sequence_id, side, CAST(until AS BIGINT) AS until_ms, count(*) AS votes FROM w GROUP BY 1, 2, 3""")
def stream_sliding_votes(spark, sf_dir):
    labelled = tracking_stream(spark, sf_dir).withColumn("side", F.when(F.col("x_m") > 0, "RIGHT").otherwise("LEFT"))
    out = jobs.run_to_the_end(labelled, lambda rows: jobs.sliding_votes(rows, "side"))
    return out.select("sequence_id", "side", (F.unix_millis("until") - 1704067200000).alias("until_ms"), "votes")


@query("stream_sessions", "R4", """
WITH e AS (SELECT user_id, epoch_ms(ts) AS ms FROM events), l AS (SELECT *, lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS p FROM e), i AS (SELECT *, sum(CASE WHEN p IS NULL OR ms - p >= 60000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS s FROM l),
g AS (SELECT user_id, s, count(*) AS frames FROM i GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, sum(frames)::BIGINT AS frames FROM g GROUP BY 1""")
def stream_sessions(spark, sf_dir):
    stream = events_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.run_to_the_end(stream, lambda rows: jobs.gap_sessions(rows, "1 minute", ["user_id"]))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("frames").alias("frames"))


#: Frames of a piece of a stream, by how many some rows come too late, and for how long a machine waits for them.
PIECE, DISORDER, HOLD_MS = 60, 30, 4000


def pieces_of(table, frame="frame_index", disorder=DISORDER):
    """A table with ``ts`` as a stream of several files, its rows out of order."""
    folder = jobs.in_pieces(table, frame, PIECE, disorder)
    return jobs.file_stream(table.sparkSession, folder, table.schema, files_per_batch=1)


def in_time(df):
    return df.filter("NOT late").drop("late")


@query("stream_kalman", "R5 R7 R1", KALMAN_SQL)
def stream_kalman(spark, sf_dir):
    rows = views.tracking(spark, sf_dir).select("sequence_id", "track_id", "frame_index", "timestamp_s", "position_valid", "x_m", "y_m", jobs.frame_time(F.col("frame_index")).alias("ts"))
    out = in_time(jobs.run_to_the_end(pieces_of(rows), lambda s: ordered_scan(
        s, ["sequence_id", "track_id"], "frame_index", smoothing._kalman_step,
        "sequence_id string, track_id bigint, frame_index bigint, smooth_x double, smooth_y double, vx double, vy double, speed double", HOLD_MS)))
    clean = out.select("sequence_id", "track_id", "frame_index", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("smooth_x", "smooth_y", "vx", "vy", "speed")])
    return tidy(clean, 5)


def control_rows(spark, sf_dir):
    return control_v1(spark, sf_dir).select("sequence_id", "frame_index", "timestamp_s", "control_state", "player_id", "player_team", "score", jobs.frame_time(F.col("frame_index")).alias("ts"))


@query("stream_possession", "R5 R7 R1 E5")
def stream_possession(spark, sf_dir):
    """The possession machine over a stream of control states that come out of order."""
    out = in_time(jobs.run_to_the_end(pieces_of(control_rows(spark, sf_dir)), lambda s: ordered_scan(s, ["sequence_id"], "frame_index", poss._machine_step, poss.POSSESSION_SCHEMA, HOLD_MS)))
    return tidy(out.select("sequence_id", "frame_index", "control_state", "possession_team", "status", "possession_conf", "carrier_id", "from_team", "to_team"))


# the batch and the stream answer the same question
ORACLE["stream_possession"] = ORACLE["possession_machine"]


@query("stream_late_rows", "R1", f"""
WITH p AS (SELECT sequence_id, frame_index, CASE WHEN frame_index % 7 = 3 THEN (frame_index + 120) // {PIECE} ELSE frame_index // {PIECE} END AS piece FROM ball_v),
n AS (SELECT a.sequence_id, a.frame_index, a.piece, max(b.frame_index) AS before FROM p a LEFT JOIN p b ON b.sequence_id = a.sequence_id AND b.piece < a.piece GROUP BY 1, 2, 3),
t AS (SELECT n.sequence_id, n.frame_index, coalesce(n.frame_index <= (SELECT max(q.frame_index) FROM p q WHERE q.sequence_id = n.sequence_id AND q.piece < n.piece AND q.frame_index <= n.before - 25), false) AS late FROM n)
SELECT sequence_id, count(*) FILTER (late) AS late, count(*) FILTER (NOT late) AS in_time FROM t GROUP BY 1""")
def stream_late_rows(spark, sf_dir):
    """Rows two pieces late are not applied but counted; the machine holds rows back for one second here."""
    b = views.ball(spark, sf_dir)
    rows = b.select("sequence_id", "frame_index", jobs.frame_time(F.col("frame_index")).alias("ts"), (F.col("frame_index") + F.when(F.col("frame_index") % 7 == 3, 120).otherwise(0)).alias("arrives"))
    count = lambda state, pdf: (pdf[["sequence_id", "frame_index"]], {"n": state.get("n", 0) + len(pdf)})
    out = jobs.run_to_the_end(pieces_of(rows, "arrives", 0), lambda s: ordered_scan(s, ["sequence_id"], "frame_index", count, "sequence_id string, frame_index bigint", 1000))
    return out.groupBy("sequence_id").agg(F.count_if("late").alias("late"), F.count_if(~F.col("late")).alias("in_time"))


@query("stream_pass_events", "R5 E7")
def stream_pass_events(spark, sf_dir):
    """Passes over a stream of frames: the batch machine, numbered as its events come out."""
    rows = passes.pass_rows(full_possession(spark, sf_dir), boxed_players(spark, sf_dir), views.ball_pixels(views.ball(spark, sf_dir)))
    way = directions(players(spark, sf_dir)).groupBy("sequence_id", "frame_index").agg(
        *[F.max(F.when(F.col("team_label") == f"TEAM_{i}", F.col("direction"))).cast("double").alias(f"way_{i}") for i in (0, 1)])
    rows = rows.join(way, ["sequence_id", "frame_index"], "left").withColumn("ts", jobs.frame_time(F.col("frame_index")))
    schema = f"{passes.PASS_SCHEMA}, event_id string, forward_m double"
    return tidy(in_time(jobs.run_to_the_end(pieces_of(rows), lambda s: ordered_scan(s, ["sequence_id"], "frame_index", passes.numbered_step, schema, HOLD_MS))), 5)


@query("stream_transition_events", "R5 E12", """
SELECT sequence_id, loss_frame, losing_team, gaining_team, round(counterpress, 5) AS counterpress_score, round(recovery, 5) AS recovery_score, candidate_label, response FROM (SELECT *, cp AS counterpress, rec AS recovery FROM transitions_v)""")
def stream_transition_events(spark, sf_dir):
    """Turnovers followed in a stream until a frame one second later confirms them; what is pending at the end stays out."""
    signals = transitions.frame_signals(frame_pressure(spark, sf_dir), block_table(spark, sf_dir), views.ball(spark, sf_dir), visible(spark, sf_dir))
    changes = turnovers(spark, sf_dir)
    changes = changes.filter(transitions.opens(F.col("losing_team"), F.col("gaining_team"), F.col("change_conf"))).withColumn("frame_index", F.col("loss_frame"))
    # a turnover may fall on a frame without signals: its own row carries it
    rows = signals.join(changes.select("sequence_id", "frame_index", "loss_ts", "losing_team", "gaining_team", "change_conf"), ["sequence_id", "frame_index"], "full")
    rows = rows.withColumn("ts", jobs.frame_time(F.col("frame_index")))
    out = in_time(jobs.run_to_the_end(pieces_of(rows), lambda s: ordered_scan(s, ["sequence_id"], "frame_index", transitions.transition_step, transitions.WINDOW_SCHEMA, HOLD_MS)))
    clean = out.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in out.schema.fields])
    return tidy(transitions.judged(clean).select("sequence_id", "loss_frame", "losing_team", "gaining_team", "counterpress_score", "recovery_score", "candidate_label", "response"), 5)


@query("stream_pressure_episodes", "R4 E14 E16")
def stream_pressure_episodes(spark, sf_dir):
    """Episodes with two thresholds, closed by the rows or, at the end of a sequence, by a timer."""
    held = frame_pressure(spark, sf_dir).select("sequence_id", "frame_index", "defending_team", "pressure_index", "target_team", "d1", "max_closing")
    seen = team_visible(spark, sf_dir).withColumnRenamed("team_label", "defending_team")
    frames = frame_list(spark, sf_dir).select("sequence_id", "frame_index", "timestamp_s", F.explode(F.array(F.lit("TEAM_0"), F.lit("TEAM_1"))).alias("defending_team"))
    key = ["sequence_id", "frame_index", "defending_team"]
    rows = frames.join(held, key, "left").join(seen, key, "left").withColumn("possession_team", F.lit(None).cast("string")).withColumn("ts", jobs.frame_time(F.col("frame_index")))
    out = in_time(jobs.run_to_the_end(pieces_of(rows), lambda s: ordered_scan(
        s, ["sequence_id", "defending_team"], "frame_index", fusion.episode_step, fusion.EPISODE_SCHEMA, HOLD_MS, finish=fusion.episode_finish)))
    return tidy(fusion.pressure_evidence(out).select("sequence_id", "event_id", "start_frame", "end_frame", "start_ts", "end_ts", "subject_team", "opponent_team", "confidence", "quality"))


ORACLE["stream_pressure_episodes"] = ORACLE["pressure_episodes"]


@query("stream_pressure_marks", "R4 E14", """
SELECT sequence_id, frame_index, defending_team FROM press_marks_v WHERE member""")
def stream_pressure_marks(spark, sf_dir):
    """The frames that belong to an episode, marked as they come."""
    rows = frame_pressure(spark, sf_dir).filter("defending_team IN ('TEAM_0', 'TEAM_1')").select(
        "sequence_id", "defending_team", "frame_index", "timestamp_s", "pressure_index", "target_team", "d1", "max_closing", jobs.frame_time(F.col("frame_index")).alias("ts"))
    out = in_time(jobs.run_to_the_end(pieces_of(rows), lambda s: ordered_scan(
        s, ["sequence_id", "defending_team"], "frame_index", fusion._pressure_step, "sequence_id string, defending_team string, frame_index bigint, start_frame bigint, closes boolean", HOLD_MS)))
    return out.filter("start_frame IS NOT NULL").select("sequence_id", "frame_index", "defending_team")


@query("stream_admissions", "E25", """
WITH RECURSIVE rq AS (SELECT user_id AS key, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch_us(ts) / 1000000.0::DOUBLE AS tm FROM events),
wk AS (SELECT key, event_id, n, tm, [tm] AS recent, true AS ok FROM rq WHERE n = 1
  UNION ALL SELECT key, event_id, n, tm, CASE WHEN len(k) < 5 THEN list_append(k, tm) ELSE k END, len(k) < 5 FROM (SELECT r.key, r.event_id, r.n, r.tm, list_filter(w.recent, lambda t: t > r.tm - 600.0) AS k FROM wk w JOIN rq r ON r.key = w.key AND r.n = w.n + 1))
SELECT key, event_id, ok AS admitted FROM wk""")
def stream_admissions(spark, sf_dir):
    """At most five admitted requests of a user in 600 s; a user silent for that long leaves no state behind."""
    ts = F.col("ts").cast("timestamp")
    rows = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", (F.unix_micros(ts) / F.lit(1000000.0)).alias("at_s"), ts.alias("ts"), F.unix_seconds(ts).alias("second"))
    first, last = rows.agg(F.min("second"), F.max("second")).first()
    stream = jobs.file_stream(spark, jobs.in_pieces(rows.withColumn("second", F.col("second") - (first or 0)), "second", ((last or 0) - (first or 0)) // 4 + 1, 1), rows.schema, 1)
    out = in_time(jobs.run_to_the_end(stream, lambda s: ordered_scan(s, ["key"], ["at_s", "event_id"], trk.admission_step, "key bigint, event_id bigint, at_s double, admitted boolean", 2000, 601000)))
    return out.select("key", "event_id", "admitted")


@query("stream_prototypes", "E22")
def stream_prototypes(spark, sf_dir):
    """Appearance prototypes in a stream of observations, one frame a second; a timer drops the prototype of a track not seen for 30 frames."""
    rows = appearance(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("frame_index")))
    most = rows.agg(F.max("frame_index")).first()[0] or 0
    stream = jobs.file_stream(spark, jobs.in_pieces(rows, "frame_index", most // 4 + 1, 5), rows.schema, 1)
    out = in_time(jobs.run_to_the_end(stream, lambda s: ordered_scan(
        s, ["sequence_id", "track_id"], "frame_index", trk.prototype_step, "sequence_id bigint, track_id bigint, frame_index bigint, hits bigint, prototype array<double>", 10000, 42000, "12 seconds")))
    return out.select("sequence_id", "track_id", "frame_index", "hits", rounded(F.get("prototype", F.lit(0))).alias("first"))


ORACLE["stream_prototypes"] = ORACLE["appearance_prototypes"]


@query("stream_retention", "R9", """
SELECT o_custkey AS key, o_orderkey AS request_id FROM orders WHERE epoch_ms(o_orderdate::TIMESTAMP) + 365 * 86400000::BIGINT <= (SELECT max(epoch_ms(o_orderdate::TIMESTAMP)) - 86400000 FROM orders)""")
def stream_retention(spark, sf_dir):
    """Requests purged after 365 days of event time, as timers give them up; younger ones stay in state."""
    rows = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
                                                       F.year("o_orderdate").cast("long").alias("year"))
    stream = jobs.file_stream(spark, jobs.in_pieces(rows, "year", 2), rows.schema, 1).drop("year")
    return jobs.run_available(expired(stream, "key", "request_id", 365 * 86400000, "1 day"))


@query("stream_interval_join", "R6 J9", """
WITH b AS (SELECT sequence_id, f, f * 40 AS ms FROM ball_v), e AS (SELECT sequence_id, f AS event_f, ms AS ems FROM b WHERE f % 50 = 0)
SELECT e.sequence_id, event_f, count(*) AS frames FROM e JOIN b ON b.sequence_id = e.sequence_id AND ms BETWEEN ems - 1000 AND ems + 1000 GROUP BY 1, 2""")
def stream_interval_join(spark, sf_dir):
    carrier = F.expr("track_id = ((f div 12) * 7) % 22")
    frames = tracking_stream(spark, sf_dir).filter(carrier).select("sequence_id", "f", "ts")
    events = (tracking_stream(spark, sf_dir).filter(carrier & (F.col("f") % 50 == 0))
              .select("sequence_id", F.col("f").alias("event_f"), F.col("ts").alias("event_ts")))
    out = jobs.run_available(jobs.around_events(events, frames))
    return out.groupBy("sequence_id", "event_f").agg(F.count(F.lit(1)).alias("frames"))


@query("stream_dedupe", "R8", "SELECT event_id, user_id FROM events")
def stream_dedupe(spark, sf_dir):
    rows = events_stream(spark, sf_dir).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return jobs.run_available(jobs.deduplicated(twice, ["event_id"])).select("event_id", "user_id")
