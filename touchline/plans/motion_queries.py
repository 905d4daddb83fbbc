"""Smoothing, movement and pressure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import calibration, geometry as geo, pressure, smoothing
from touchline.plans import views
from touchline.plans.registry import query, rounded
from touchline.plans.stats_queries import tidy
from touchline.plans.tactics_queries import block_table, players


def moving(spark, sf_dir):
    return smoothing.velocity(views.tracking(spark, sf_dir))


men = players


def possession(spark, sf_dir):
    return views.shared("held", spark, sf_dir, lambda s, d: pressure.quick_possession(players(s, d), views.ball(s, d)))


def targets(spark, sf_dir):
    return views.shared("targets", spark, sf_dir, _targets)


def _targets(spark, sf_dir):
    ball = views.ball(spark, sf_dir)
    return pressure.targets(ball, men(spark, sf_dir), ball, possession(spark, sf_dir))


def frame_pressure(spark, sf_dir):
    return views.shared("pressure", spark, sf_dir, _frame_pressure)


def _frame_pressure(spark, sf_dir):
    target = targets(spark, sf_dir)
    squeeze = pressure.compression(block_table(spark, sf_dir), target)
    return pressure.frame_pressure(target, pressure.defenders(target, men(spark, sf_dir)), squeeze)


@query("track_velocity", "W1 W2", """
SELECT event_id, round(vx, 6) AS vx, round(vy, 6) AS vy, round(speed, 6) AS speed, coalesce(speed <= 12.5, true) AS plausible FROM moving_v""")
def track_velocity(spark, sf_dir):
    return tidy(moving(spark, sf_dir).select("event_id", "vx", "vy", "speed", smoothing.plausible(F.col("speed")).alias("plausible")))


@query("polynomial_smoothing", "W3", """
WITH w AS (SELECT a.event_id, any_value(a.position_valid) AS ok, any_value(a.x_m) AS rx, any_value(a.y_m) AS ry, count(b.event_id) AS n, sum((b.frame_index - a.frame_index)::DOUBLE) AS s1, sum(pow(b.frame_index - a.frame_index, 2)) AS s2,
   sum(pow(b.frame_index - a.frame_index, 3)) AS s3, sum(pow(b.frame_index - a.frame_index, 4)) AS s4, sum(b.x_m) AS x0, sum((b.frame_index - a.frame_index) * b.x_m) AS x1, sum(pow(b.frame_index - a.frame_index, 2) * b.x_m) AS x2,
   sum(b.y_m) AS y0, sum((b.frame_index - a.frame_index) * b.y_m) AS y1, sum(pow(b.frame_index - a.frame_index, 2) * b.y_m) AS y2
  FROM tracking_v a LEFT JOIN tracking_v b ON a.sequence_id = b.sequence_id AND a.track_id = b.track_id AND b.position_valid AND b.frame_index BETWEEN a.frame_index - 2 AND a.frame_index + 2 GROUP BY 1)
SELECT event_id, round(CASE WHEN NOT ok THEN NULL WHEN n >= 4 THEN (x0 * (s2 * s4 - s3 * s3) - s1 * (x1 * s4 - x2 * s3) + s2 * (x1 * s3 - x2 * s2)) / (n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))
     WHEN n = 3 THEN (s2 * x0 - s1 * x1) / (n * s2 - s1 * s1) ELSE rx END, 5) AS smooth_x,
  round(CASE WHEN NOT ok THEN NULL WHEN n >= 4 THEN (y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - y2 * s3) + s2 * (y1 * s3 - y2 * s2)) / (n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))
     WHEN n = 3 THEN (s2 * y0 - s1 * y1) / (n * s2 - s1 * s1) ELSE ry END, 5) AS smooth_y FROM w""")
def polynomial_smoothing(spark, sf_dir):
    return tidy(smoothing.polynomial_smoothing(views.tracking(spark, sf_dir)).select("event_id", "smooth_x", "smooth_y"), 5)


KALMAN_SQL = """
WITH RECURSIVE o AS (SELECT sequence_id AS sq, track_id AS tr, frame_index AS fr, timestamp_s AS ts, position_valid AS ok, x_m AS zx, y_m AS zy FROM tracking_v),
st AS (SELECT sq, tr, CAST(0 AS BIGINT) AS fr, NULL::DOUBLE AS lt, 0.04::DOUBLE AS kdt, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, 0.16::DOUBLE AS p, 0.0::DOUBLE AS c, 0.16::DOUBLE AS v, false AS ok FROM (SELECT DISTINCT sq, tr FROM o)
 UNION ALL
 SELECT sq, tr, fr, CASE WHEN ok THEN ts ELSE lt END, CASE WHEN NOT ok THEN kdt WHEN fresh THEN 0.04 ELSE dt END,
   CASE WHEN NOT ok THEN x WHEN fresh THEN zx ELSE nx + pp / (pp + rr) * (zx - nx) END, CASE WHEN NOT ok THEN y WHEN fresh THEN zy ELSE ny + pp / (pp + rr) * (zy - ny) END,
   CASE WHEN NOT ok THEN vx WHEN fresh THEN 0.0 ELSE vx + cc / (pp + rr) * (zx - nx) END, CASE WHEN NOT ok THEN vy WHEN fresh THEN 0.0 ELSE vy + cc / (pp + rr) * (zy - ny) END,
   CASE WHEN NOT ok THEN p WHEN fresh THEN rr ELSE (1.0 - pp / (pp + rr)) * pp END, CASE WHEN NOT ok THEN c WHEN fresh THEN 0.0 ELSE (1.0 - pp / (pp + rr)) * cc END,
   CASE WHEN NOT ok THEN v WHEN fresh THEN rr ELSE vv - cc / (pp + rr) * cc END, ok
 FROM (SELECT *, p + dt * c + dt * (c + dt * v) + 2.25::DOUBLE * pow(0.04::DOUBLE, 4) / 4.0 AS pp, c + dt * v + 2.25::DOUBLE * pow(0.04::DOUBLE, 3) / 2.0 AS cc, v + 2.25::DOUBLE * pow(0.04::DOUBLE, 2) AS vv,
         x + dt * vx AS nx, y + dt * vy AS ny, 0.4::DOUBLE * 0.4::DOUBLE AS rr
   FROM (SELECT st.sq, st.tr, o.fr, o.ts, o.ok, zx, zy, lt, kdt, x, y, vx, vy, p, c, v, lt IS NULL OR o.ts - lt > 0.17 AS fresh, CASE WHEN abs(greatest(0.001, o.ts - lt) - kdt) > 1e-4 THEN greatest(0.001, o.ts - lt) ELSE kdt END AS dt
         FROM st JOIN o ON o.sq = st.sq AND o.tr = st.tr AND o.fr = st.fr + 1)))
SELECT sq AS sequence_id, tr AS track_id, fr AS frame_index, CASE WHEN ok THEN round(x, 5) END AS smooth_x, CASE WHEN ok THEN round(y, 5) END AS smooth_y, CASE WHEN ok THEN round(vx, 5) END AS vx,
  CASE WHEN ok THEN round(vy, 5) END AS vy, CASE WHEN ok THEN round(sqrt(vx * vx + vy * vy), 5) END AS speed FROM st WHERE fr > 0"""


@query("kalman_smoothing", "E1", KALMAN_SQL)
def kalman_smoothing(spark, sf_dir):
    return tidy(smoothing.kalman(views.tracking(spark, sf_dir)), 5)


@query("shape_moving_average", "E2", """
WITH RECURSIVE tm AS (SELECT sequence_id, frame_index, team_label, avg(x_m) AS cx, CASE WHEN count(*) >= 2 THEN max(y_m) - min(y_m) END AS w FROM outfield_v GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, team_label ORDER BY frame_index) AS i FROM tm),
st AS (SELECT sequence_id, team_label, frame_index, i, cx AS e1, coalesce(w, 0.0) AS e2, w IS NULL AS wn FROM r WHERE i = 1
 UNION ALL SELECT r.sequence_id, r.team_label, r.frame_index, r.i, 0.25 * cx + 0.75 * e1, CASE WHEN w IS NULL THEN e2 ELSE 0.25 * w + 0.75 * e2 END, w IS NULL FROM st JOIN r ON r.sequence_id = st.sequence_id AND r.team_label = st.team_label AND r.i = st.i + 1)
SELECT sequence_id, team_label, frame_index, round(e1, 6) AS ema_centroid_x, CASE WHEN NOT wn THEN round(e2, 6) END AS ema_width_m FROM st""")
def shape_moving_average(spark, sf_dir):
    shapes = geo.team_shape(geo.outfield(players(spark, sf_dir)))
    return tidy(smoothing.moving_average(shapes, ["sequence_id", "team_label"], ["centroid_x", "width_m"]))


@query("movement_summary", "W4", """
WITH l AS (SELECT *, lag(x_m) OVER w AS lx, lag(y_m) OVER w AS ly, lag(vx) OVER w AS lvx, lag(vy) OVER w AS lvy, lag(timestamp_s) OVER w AS lt FROM moving_v WHERE position_valid WINDOW w AS (PARTITION BY sequence_id, track_id ORDER BY frame_index)),
a AS (SELECT *, CASE WHEN timestamp_s - lt > 1e-3 THEN sqrt(pow((vx - lvx) / (timestamp_s - lt), 2) + pow((vy - lvy) / (timestamp_s - lt), 2)) END AS acc FROM l)
SELECT sequence_id, round(avg(speed), 6) AS mean_speed, round(avg(acc), 6) AS mean_acceleration, round(quantile_cont(acc, 0.95), 6) AS p95_acceleration,
 round(sqrt(pow(stddev_pop(x_m - lx) FILTER (speed < 1.0), 2) + pow(stddev_pop(y_m - ly) FILTER (speed < 1.0), 2)), 6) AS jitter_m,
 round(sum(sqrt(pow(x_m - lx, 2) + pow(y_m - ly, 2))), 4) AS distance_m, round(count(*) FILTER (speed <= 12.5) / count(speed), 6) AS plausible_share FROM a GROUP BY 1""")
def movement_summary(spark, sf_dir):
    out = smoothing.movement_summary(moving(spark, sf_dir))
    return tidy(out.withColumn("distance_m", F.round("distance_m", 4)))


@query("steps_by_calibration_age", "W5", """
WITH cal AS (SELECT sequence_id AS cs, frame_index AS cf, f % 23 <> 0 AS cal_valid, max(CASE WHEN f % 10 = 0 AND f % 23 <> 0 THEN frame_index END) OVER (PARTITION BY sequence_id ORDER BY frame_index) AS k FROM ball_v),
s AS (SELECT *, lag(position_valid) OVER w AS pv, sqrt(pow(x_m - lag(x_m) OVER w, 2) + pow(y_m - lag(y_m) OVER w, 2)) AS step FROM tracking_v WINDOW w AS (PARTITION BY sequence_id, track_id ORDER BY frame_index))
SELECT CASE WHEN frame_index - k = 0 THEN 'age_0' WHEN frame_index - k <= 2 THEN 'age_1_2' WHEN frame_index - k <= 5 THEN 'age_3_5' WHEN frame_index - k <= 10 THEN 'age_6_10' END AS bucket,
 round(avg(step), 6) AS mean_step_m, round(quantile_cont(step, 0.5), 6) AS median_step_m, round(quantile_cont(step, 0.95), 6) AS p95_step_m, count(*) AS samples
FROM s JOIN cal ON cs = sequence_id AND cf = frame_index WHERE position_valid AND pv AND cal_valid AND frame_index - k <= 10 GROUP BY 1""")
def steps_by_calibration_age(spark, sf_dir):
    ages = calibration.staleness(views.calibrations(spark, sf_dir))
    return tidy(smoothing.steps_by_calibration_age(views.tracking(spark, sf_dir), ages))


@query("ball_speed", "W7", """
WITH b AS (SELECT *, (ball_x + 52.5) / 105.0 * 1920.0 AS u, (ball_y + 34.0) / 68.0 * 1080.0 AS v FROM ball_v WHERE ball_valid),
l AS (SELECT *, lag(ball_x) OVER w AS lx, lag(ball_y) OVER w AS ly, lag(u) OVER w AS lu, lag(v) OVER w AS lv, greatest(1e-3, timestamp_s - lag(timestamp_s) OVER w) AS dt, lag(frame_index) OVER w AS lf FROM b WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_index)),
s AS (SELECT *, CASE WHEN lf IS NULL THEN 0.0 ELSE sqrt(pow(ball_x - lx, 2) + pow(ball_y - ly, 2)) / dt END AS ms, CASE WHEN lf IS NULL THEN 0.0 ELSE sqrt(pow(u - lu, 2) + pow(v - lv, 2)) / dt END AS px FROM l)
SELECT sequence_id, frame_index, round(ms, 6) AS speed_ms, round(px, 6) AS speed_px, ms > 25.0 OR (px > 350.0 AND ms > 20.0) AS aerial FROM s""")
def ball_speed(spark, sf_dir):
    return tidy(smoothing.ball_speed(views.ball_pixels(views.ball(spark, sf_dir))).select(*geo.FRAME, "speed_ms", "speed_px", "aerial"))


@query("sampled_frames", "S1 P6", """
SELECT sequence_id, frame_index, count(*) AS players FROM tracking_v WHERE frame_index % 5 = 0 GROUP BY 1, 2""")
def sampled_frames(spark, sf_dir):
    return smoothing.sample_frames(views.tracking(spark, sf_dir), 5).groupBy(*geo.FRAME).agg(F.count(F.lit(1)).alias("players"))


@query("quick_possession", "P6 J4", """
SELECT sequence_id, frame_index, possession_team, carrier_id, possession_conf FROM held_v""")
def quick_possession(spark, sf_dir):
    return possession(spark, sf_dir)


@query("pressure_targets", "E11", """
SELECT sequence_id, frame_index, target_type, target_id, target_team, round(target_conf, 6) AS target_conf, round(CASE WHEN target_type <> 'UNKNOWN' THEN tx END, 6) AS tx, round(CASE WHEN target_type <> 'UNKNOWN' THEN ty END, 6) AS ty, defending_team FROM target_v""")
def pressure_targets(spark, sf_dir):
    return tidy(targets(spark, sf_dir).select(*geo.FRAME, "target_type", "target_id", "target_team", "target_conf", "tx", "ty", "defending_team"))


@query("defender_pressure", "P31", """
SELECT sequence_id, frame_index, track_id AS defender_id, round(d, 6) AS distance_m, round(closing, 6) AS closing_mps,
 round(CASE WHEN speed > 0.2 AND d > 1e-3 THEN degrees(acos(greatest(-1.0, least(1.0, ((tx - x_m) * vx + (ty - y_m) * vy) / (d * speed))))) ELSE 90.0 END, 4) AS approach_deg,
 round(CASE WHEN closing > 0.2 AND d > 0.1 THEN d / closing END, 5) AS contact_s FROM defenders_v""")
def defender_pressure(spark, sf_dir):
    out = pressure.defenders(targets(spark, sf_dir), men(spark, sf_dir))
    return out.select(*geo.FRAME, "defender_id", rounded(F.col("distance_m")).alias("distance_m"), rounded(F.col("closing_mps")).alias("closing_mps"),
                      rounded(F.col("approach_deg"), 4).alias("approach_deg"), rounded(F.col("contact_s"), 5).alias("contact_s"))


@query("pressure_density", "A10 A11", """
SELECT sequence_id, frame_index, round(d1, 6) AS d1, round(v1, 6) AS v1, nearest_id, round(d2, 6) AS d2, round(d3, 6) AS d3, r2 AS n_r2, r3 AS n_r3, r5 AS n_r5, r8 AS n_r8, round(mean_close, 6) AS mean_closing,
 round(max_close, 6) AS max_closing, pos AS closing_positive, fast AS closing_fast, sectors, round(free_gap, 4) AS free_gap_deg, round(coalesce(d1, 15.0), 6) AS free_space_m FROM pressure_v""")
def pressure_density(spark, sf_dir):
    out = frame_pressure(spark, sf_dir).withColumn("sectors", F.col("sectors").cast("long")).withColumn("free_gap_deg", F.round("free_gap_deg", 4))
    return tidy(out.select(*geo.FRAME, "d1", "v1", "nearest_id", "d2", "d3", "n_r2", "n_r3", "n_r5", "n_r8", "mean_closing", "max_closing",
                           "closing_positive", "closing_fast", "sectors", "free_gap_deg", "free_space_m"))


@query("block_compression", "W11", """
SELECT sequence_id, frame_index, defending_team, round(line_rate, 5) AS line_rate, round(depth_rate, 5) AS depth_rate, round(width_rate, 5) AS width_rate, round(centroid_rate, 5) AS centroid_rate, compressing FROM compression_v""")
def block_compression(spark, sf_dir):
    return tidy(pressure.compression(block_table(spark, sf_dir), targets(spark, sf_dir)), 5)


@query("pressure_index", "P32 P33", """
SELECT sequence_id, frame_index, round(p, 6) AS pressure_index, CASE WHEN target_type = 'UNKNOWN' THEN 'NOT_VISIBLE' WHEN d1 IS NULL THEN 'NO_PRESSURE' WHEN target_type = 'CARRIER' AND target_conf < 0.45 THEN 'AMBIGUOUS'
  WHEN p >= 0.60 THEN 'STRONG_PRESSURE' WHEN p >= 0.25 THEN 'LIGHT_PRESSURE' ELSE 'NO_PRESSURE' END AS pressure_class,
 round(CASE WHEN target_type = 'UNKNOWN' OR d1 IS NULL THEN 1.0 WHEN target_type = 'CARRIER' AND target_conf < 0.45 THEN 0.5 WHEN p >= 0.60 THEN least(1.0, p) WHEN p >= 0.25 THEN 0.75 ELSE least(1.0, 0.60 + (0.25 - p) * 1.6) END, 6) AS pressure_conf FROM pressure_v""")
def pressure_index(spark, sf_dir):
    return tidy(frame_pressure(spark, sf_dir).select(*geo.FRAME, "pressure_index", "pressure_class", "pressure_conf"))
