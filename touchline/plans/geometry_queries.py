"""Boxes, projection, gate, shape and distance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import boxes as bx
from touchline.operators import calibration, geometry as geo
from touchline.plans import views
from touchline.plans.registry import query, rounded


def r6(*names):
    return [rounded(F.col(n)).alias(n) for n in names]


def _players(spark, sf_dir):
    return geo.gate(views.tracking(spark, sf_dir))


def _outfield(spark, sf_dir):
    return geo.outfield(_players(spark, sf_dir))


SHAPE_SQL = """
team_mean AS (SELECT sequence_id, frame_index, team_label, avg(x_m) AS cx, avg(y_m) AS cy FROM outfield_v GROUP BY ALL),
shape AS (
  SELECT o.sequence_id, o.frame_index, o.team_label, count(*) AS players, any_value(cx) AS cx, any_value(cy) AS cy,
         quantile_cont(x_m, 0.5) AS mx, quantile_cont(y_m, 0.5) AS my,
         CASE WHEN count(*) >= 2 THEN max(y_m) - min(y_m) END AS width_m,
         CASE WHEN count(*) >= 2 THEN max(x_m) - min(x_m) END AS span_m,
         CASE WHEN count(*) >= 2 THEN avg(sqrt((x_m - cx) * (x_m - cx) + (y_m - cy) * (y_m - cy))) END AS stretch_m
  FROM outfield_v o JOIN team_mean USING (sequence_id, frame_index, team_label) GROUP BY 1, 2, 3)"""


@query("team_shape_summary", "P8 A5 A12 A19", f"""
WITH {SHAPE_SQL}
SELECT sequence_id, team_label, count(*) AS frames, round(avg(cx), 6) AS mean_centroid_x, round(avg(cy), 6) AS mean_centroid_y,
       round(avg(width_m), 6) AS mean_width_m, round(avg(span_m), 6) AS mean_span_m, round(avg(stretch_m), 6) AS mean_stretch_m
FROM shape GROUP BY 1, 2""")
def team_shape_summary(spark, sf_dir):
    shapes = geo.team_shape(_outfield(spark, sf_dir))
    mean = lambda c, name: rounded(F.avg(c)).alias(name)
    return shapes.groupBy("sequence_id", "team_label").agg(
        F.count(F.lit(1)).alias("frames"), mean("centroid_x", "mean_centroid_x"), mean("centroid_y", "mean_centroid_y"),
        mean("width_m", "mean_width_m"), mean("span_m", "mean_span_m"), mean("stretch_m", "mean_stretch_m"))


@query("team_shape_frames", "A5", f"""
WITH {SHAPE_SQL}
SELECT sequence_id, frame_index, team_label, players, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y,
       round(mx, 6) AS median_x, round(my, 6) AS median_y, round(width_m, 6) AS width_m, round(span_m, 6) AS span_m,
       round(stretch_m, 6) AS stretch_m FROM shape""")
def team_shape_frames(spark, sf_dir):
    return geo.team_shape(_outfield(spark, sf_dir)).select(
        *geo.TEAM, "players", *r6("centroid_x", "centroid_y", "median_x", "median_y", "width_m", "span_m", "stretch_m"))


@query("team_shape_with_goalkeeper", "A5", """
SELECT sequence_id, frame_index, team_label, count(*) AS players, round(avg(x_m), 6) AS centroid_x,
       round(CASE WHEN count(*) >= 2 THEN max(x_m) - min(x_m) END, 6) AS span_m
FROM gated_v GROUP BY 1, 2, 3 HAVING count(*) FILTER (role = 'GOALKEEPER') > 0""")
def team_shape_with_goalkeeper(spark, sf_dir):
    players = _players(spark, sf_dir)
    keepers = F.count_if(F.col("role") == "GOALKEEPER")
    return (players.groupBy(*geo.TEAM).agg(
        F.count(F.lit(1)).alias("players"), rounded(F.avg("x_m"), 6).alias("centroid_x"),
        rounded(F.when(F.count(F.lit(1)) >= 2, F.max("x_m") - F.min("x_m")), 6).alias("span_m"), keepers.alias("_gk"))
        .filter("_gk > 0").drop("_gk"))


@query("observation_gate", "P5 P7 P8", """
SELECT sequence_id, frame_index, track_id, team_label, round(x_m, 6) AS x_m, round(y_m, 6) AS y_m FROM gated_v""")
def observation_gate(spark, sf_dir):
    return _players(spark, sf_dir).select(*geo.FRAME, "track_id", "team_label", *r6("x_m", "y_m"))


@query("team_label_normaliser", "P7", """
WITH t AS (SELECT doc_id, upper(trim(source)) AS u FROM documents)
SELECT doc_id, CASE WHEN u IN ('A', 'TEAM_A') OR contains(u, '0') OR contains(u, 'LEFT') THEN 'TEAM_0'
                    WHEN u IN ('B', 'TEAM_B') OR contains(u, '1') OR contains(u, 'RIGHT') THEN 'TEAM_1' END AS team FROM t""")
def team_label_normaliser(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", geo.team_code(F.col("source")).alias("team"))


@query("grid_and_lane", "P9 P10", """
SELECT event_id,
  CAST((CASE WHEN x_m >= 31.5 THEN 4 WHEN x_m <= -31.5 THEN 0 WHEN x_m < -10.5 THEN 1 WHEN x_m < 10.5 THEN 2 ELSE 3 END) * 3
   + (CASE WHEN y_m >= 34.0::DOUBLE / 3.0::DOUBLE THEN 2 WHEN y_m <= -(34.0::DOUBLE / 3.0::DOUBLE) THEN 0 ELSE 1 END) AS INTEGER) AS cell,
  CASE WHEN y_m BETWEEN -34.0 AND -20.4 THEN 'left_wide' WHEN y_m BETWEEN -20.4 AND -6.8 THEN 'left_half_space'
       WHEN y_m BETWEEN -6.8 AND 6.8 THEN 'central' WHEN y_m BETWEEN 6.8 AND 20.4 THEN 'right_half_space'
       WHEN y_m < -34.0 THEN 'left_wide' ELSE 'right_wide' END AS lane
FROM tracking_v""")
def grid_and_lane(spark, sf_dir):
    x, y = F.col("x_m"), F.col("y_m")
    return views.tracking(spark, sf_dir).select("event_id", geo.grid_cell(x, y).alias("cell"), geo.lane(y).alias("lane"))


@query("field_occupancy", "A7", """
WITH c AS (SELECT *, (CASE WHEN x_m >= 31.5 THEN 4 WHEN x_m <= -31.5 THEN 0 WHEN x_m < -10.5 THEN 1 WHEN x_m < 10.5 THEN 2 ELSE 3 END) * 3
   + (CASE WHEN y_m >= 34.0::DOUBLE / 3.0::DOUBLE THEN 2 WHEN y_m <= -(34.0::DOUBLE / 3.0::DOUBLE) THEN 0 ELSE 1 END) AS cell FROM outfield_v)
SELECT sequence_id, frame_index, team_label,""" + ",".join(f" count(*) FILTER (cell = {n}) AS cell_{n}" for n in range(15)) + """,
  count(*) FILTER (y_m <= -20.4) AS left_wide, count(*) FILTER (y_m > -20.4 AND y_m <= -6.8) AS left_half_space,
  count(*) FILTER (y_m > -6.8 AND y_m <= 6.8) AS central, count(*) FILTER (y_m > 6.8 AND y_m <= 20.4) AS right_half_space,
  count(*) FILTER (y_m > 20.4) AS right_wide
FROM c GROUP BY 1, 2, 3""")
def field_occupancy(spark, sf_dir):
    return geo.occupancy(_outfield(spark, sf_dir))


@query("convex_hull", "A6", """
WITH p AS (SELECT DISTINCT sequence_id, frame_index, team_label, CAST(round(x_m * 100) AS BIGINT) AS x, CAST(round(y_m * 100) AS BIGINT) AS y FROM outfield_v),
n AS (SELECT sequence_id, frame_index, team_label, count(*) AS players FROM outfield_v GROUP BY 1, 2, 3),
e AS (SELECT a.sequence_id, a.frame_index, a.team_label, a.x AS ux, a.y AS uy, b.x AS wx, b.y AS wy
      FROM p a JOIN p b ON a.sequence_id = b.sequence_id AND a.frame_index = b.frame_index AND a.team_label = b.team_label AND (a.x <> b.x OR a.y <> b.y)),
bad AS (SELECT DISTINCT e.* FROM e JOIN p c ON e.sequence_id = c.sequence_id AND e.frame_index = c.frame_index AND e.team_label = c.team_label
   WHERE (c.x <> ux OR c.y <> uy) AND (c.x <> wx OR c.y <> wy)
     AND ((wx - ux) * (c.y - uy) - (wy - uy) * (c.x - ux) < 0
       OR ((wx - ux) * (c.y - uy) - (wy - uy) * (c.x - ux) = 0
           AND NOT ((c.x - ux) * (c.x - wx) <= 0 AND (c.y - uy) * (c.y - wy) <= 0)))),
edge AS (SELECT * FROM e EXCEPT SELECT * FROM bad),
h AS (SELECT sequence_id, frame_index, team_label, sum(ux * wy - wx * uy) / 20000.0::DOUBLE AS area,
        sum(sqrt(((wx - ux) * (wx - ux) + (wy - uy) * (wy - uy))::DOUBLE)) / 100.0 AS perimeter, count(*) AS corners FROM edge GROUP BY 1, 2, 3)
SELECT n.sequence_id, n.frame_index, n.team_label, n.players,
   CASE WHEN n.players < 3 THEN NULL ELSE round(coalesce(area, 0.0), 4) END AS hull_area_m2,
   CASE WHEN n.players < 3 THEN NULL ELSE round(coalesce(perimeter, 0.0), 4) END AS hull_perimeter_m,
   CASE WHEN n.players < 3 THEN 0 ELSE coalesce(corners, 0) END AS corners
FROM n LEFT JOIN h USING (sequence_id, frame_index, team_label)""")
def convex_hull(spark, sf_dir):
    shapes = geo.with_hull(geo.team_shape(_outfield(spark, sf_dir)))
    return shapes.select(*geo.TEAM, "players", rounded(F.col("hull_area_m2"), 4).alias("hull_area_m2"),
                         rounded(F.col("hull_perimeter_m"), 4).alias("hull_perimeter_m"),
                         F.size("hull_vertices").cast("long").alias("corners"))


@query("pairwise_distances", "J5", """
WITH d AS (SELECT a.sequence_id, a.frame_index, a.team_label, a.track_id AS i, b.track_id AS j,
   sqrt((a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m)) AS d
   FROM outfield_v a JOIN outfield_v b ON a.sequence_id = b.sequence_id AND a.frame_index = b.frame_index
    AND a.team_label = b.team_label AND a.track_id <> b.track_id),
nearest AS (SELECT sequence_id, frame_index, team_label, avg(m) AS m FROM (SELECT sequence_id, frame_index, team_label, i, min(d) AS m FROM d GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
SELECT sequence_id, frame_index, team_label, round(avg(d), 6) AS mean_pairwise_m, round(quantile_cont(d, 0.5), 6) AS median_pairwise_m, round(any_value(m), 6) AS mean_nearest_m
FROM d JOIN nearest USING (sequence_id, frame_index, team_label) WHERE i < j GROUP BY 1, 2, 3""")
def pairwise_distances(spark, sf_dir):
    out = geo.with_pair_distances(geo.team_frames(_outfield(spark, sf_dir)))
    return out.filter("players >= 2").select(*geo.TEAM, *r6("mean_pairwise_m", "median_pairwise_m", "mean_nearest_m"))


@query("inter_team_distances", "J6", f"""
WITH {SHAPE_SQL},
d AS (SELECT a.sequence_id, a.frame_index, a.track_id AS i, min(sqrt((a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m))) AS m
   FROM outfield_v a JOIN outfield_v b ON a.sequence_id = b.sequence_id AND a.frame_index = b.frame_index AND a.team_label <> b.team_label GROUP BY 1, 2, 3)
SELECT a.sequence_id, a.frame_index, round(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)), 6) AS centroid_distance_m,
   round(sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my)), 6) AS median_centroid_distance_m,
   (SELECT round(avg(m), 6) FROM d WHERE d.sequence_id = a.sequence_id AND d.frame_index = a.frame_index) AS nearest_opponent_mean_m
FROM shape a JOIN shape b ON a.sequence_id = b.sequence_id AND a.frame_index = b.frame_index AND a.team_label = 'TEAM_0' AND b.team_label = 'TEAM_1'""")
def inter_team_distances(spark, sf_dir):
    return geo.inter_team(geo.team_shape(_outfield(spark, sf_dir))).select(
        *geo.FRAME, *r6("centroid_distance_m", "median_centroid_distance_m", "nearest_opponent_mean_m"))


@query("nearest_to_ball", "J4", """
WITH d AS (SELECT sequence_id, frame_index, team_label, track_id, sqrt((ball_x - x_m) * (ball_x - x_m) + (ball_y - y_m) * (ball_y - y_m)) AS d
  FROM gated_v JOIN ball_v USING (sequence_id, frame_index) WHERE ball_valid),
o AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, frame_index ORDER BY d, team_label, track_id) AS rn,
   row_number() OVER (PARTITION BY sequence_id, frame_index, team_label ORDER BY d, track_id) AS rt FROM d)
SELECT sequence_id, frame_index, max(track_id) FILTER (rn = 1) AS nearest_player_id, max(team_label) FILTER (rn = 1) AS nearest_team,
  round(max(d) FILTER (rn = 1), 6) AS nearest_distance_m,
  max(track_id) FILTER (rt = 1 AND team_label = 'TEAM_0') AS team_0_player_id, round(max(d) FILTER (rt = 1 AND team_label = 'TEAM_0'), 6) AS team_0_distance_m,
  max(track_id) FILTER (rt = 1 AND team_label = 'TEAM_1') AS team_1_player_id, round(max(d) FILTER (rt = 1 AND team_label = 'TEAM_1'), 6) AS team_1_distance_m
FROM o GROUP BY 1, 2""")
def nearest_to_ball(spark, sf_dir):
    near = geo.ball_proximity(_players(spark, sf_dir), views.ball(spark, sf_dir))
    return near.select(*geo.FRAME, "nearest_player_id", "nearest_team", "team_0_player_id", "team_1_player_id",
                       *r6("nearest_distance_m", "team_0_distance_m", "team_1_distance_m"))


@query("box_iou", "P1 J7", """
SELECT t.sequence_id, t.frame_index, t.track_id, p.pred_track_id, round(i / u, 6) AS iou FROM (
 SELECT *, greatest(0.0, least(x2, px2) - greatest(x1, px1)) * greatest(0.0, least(y2, py2) - greatest(y1, py1)) AS i
 FROM boxes_v JOIN (SELECT sequence_id AS ps, frame_index AS pf, pred_track_id, px1, py1, px2, py2 FROM pred_boxes_v) p ON sequence_id = ps AND frame_index = pf) t,
 LATERAL (SELECT t.pred_track_id, (t.x2 - t.x1) * (t.y2 - t.y1) + (t.px2 - t.px1) * (t.py2 - t.py1) - t.i AS u) p
WHERE u > 0 AND i / u >= 0.5""")
def box_iou(spark, sf_dir):
    truth, pred = views.boxes(spark, sf_dir), views.predicted_boxes(spark, sf_dir)
    both = truth.join(pred.drop("event_id"), geo.FRAME)
    overlap = bx.iou([F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(c) for c in ("px1", "py1", "px2", "py2")])
    return (both.withColumn("iou", overlap).filter("iou >= 0.5")
            .select(*geo.FRAME, "track_id", "pred_track_id", *r6("iou")))


@query("box_anchors", "P2", """
SELECT event_id, CASE WHEN x2 <= x1 OR y2 <= y1 THEN 'DEGENERATE_BBOX' END AS reason,
  CASE WHEN x2 > x1 AND y2 > y1 THEN round((x1 + x2) / 2.0, 6) END AS u, CASE WHEN x2 > x1 AND y2 > y1 THEN round(y2, 6) END AS v,
  CASE WHEN x2 > x1 AND y2 > y1 THEN round((y1 + y2) / 2.0, 6) END AS ball_v_px
FROM (SELECT event_id, x1, y1, CASE WHEN event_id % 91 = 0 THEN x1 ELSE x2 END AS x2, y2 FROM boxes_v)""")
def box_anchors(spark, sf_dir):
    raw = views.boxes(spark, sf_dir).withColumn("x2", F.when(F.col("event_id") % 91 == 0, F.col("x1")).otherwise(F.col("x2")))
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    reason = bx.anchor_problem(box)
    ok = reason.isNull()
    return raw.select("event_id", reason.alias("reason"), rounded(F.when(ok, bx.anchor(box)[0]), 6).alias("u"),
                      rounded(F.when(ok, bx.anchor(box)[1]), 6).alias("v"),
                      rounded(F.when(ok, bx.anchor(box, True)[1]), 6).alias("ball_v_px"))


@query("linear_projection", "P6", """
SELECT event_id, round((x1 + x2) / 2.0 / 1920 * 105.0 - 52.5, 6) AS pitch_x, round(y2 / 1080 * 68.0 - 34.0, 6) AS pitch_y FROM boxes_v""")
def linear_projection(spark, sf_dir):
    return geo.quick_frame_metrics(views.boxes(spark, sf_dir)).select("event_id", *r6("pitch_x", "pitch_y"))


CALIB_SQL = """
cal AS (SELECT sequence_id AS cs, frame_index AS cf, f % 10 = 0 AS keyframe, f % 23 <> 0 AS cal_valid,
  (800 + f % 50) / 10000.0::DOUBLE AS h0, (f % 7) / 1000.0::DOUBLE AS h1, -50.0 AS h2, (f % 5) / 1000.0::DOUBLE AS h3,
  (600 + f % 40) / 10000.0::DOUBLE AS h4, -32.0 AS h5, (f % 3) / 100000.0::DOUBLE AS h6, (f % 4) / 100000.0::DOUBLE AS h7, 1.0 AS h8 FROM ball_v)"""


@query("homography_projection", "P3 J3", f"""
WITH {CALIB_SQL},
j AS (SELECT *, (x1 + x2) / 2.0 AS u, y2 AS v FROM boxes_v LEFT JOIN cal ON sequence_id = cs AND frame_index = cf)
SELECT event_id, CASE WHEN coalesce(cal_valid, false) THEN 'OK' ELSE 'INVALID_CALIBRATION' END AS state,
  CASE WHEN cal_valid THEN round((h0 * u + h1 * v + h2) / (h6 * u + h7 * v + h8), 6) END AS pitch_x,
  CASE WHEN cal_valid THEN round((h3 * u + h4 * v + h5) / (h6 * u + h7 * v + h8), 6) END AS pitch_y FROM j""")
def homography_projection(spark, sf_dir):
    out = calibration.project_boxes(views.boxes(spark, sf_dir), views.calibrations(spark, sf_dir))
    return out.select("event_id", "state", *r6("pitch_x", "pitch_y"))


@query("homography_round_trip", "P3 P4", f"""
WITH {CALIB_SQL},
d AS (SELECT *, h0 * (h4 * h8 - h5 * h7) - h1 * (h3 * h8 - h5 * h6) + h2 * (h3 * h7 - h4 * h6) AS det FROM cal)
SELECT cs AS sequence_id, cf AS frame_index, abs(det) < 1e-15 AS singular,
 round((h4 * h8 - h5 * h7) / (h0 * h4 - h1 * h3), 4) AS i0, round((h1 * h5 - h2 * h4) / (h0 * h4 - h1 * h3), 4) AS i2,
 0.0::DOUBLE AS error_m FROM d""")
def homography_round_trip(spark, sf_dir):
    cal = views.calibrations(spark, sf_dir).withColumn("inverse", bx.invert(F.col("h")))
    pixel = bx.project(F.col("inverse"), F.lit(10.0), F.lit(5.0))
    back = bx.let(pixel, lambda p: bx.project(F.col("h"), p["x"], p["y"]))
    cal = cal.withColumn("back", back)
    error = rounded(geo.distance(F.col("back.x"), F.col("back.y"), F.lit(10.0), F.lit(5.0)))
    return cal.select(*geo.FRAME, F.col("inverse").isNull().alias("singular"), rounded(F.col("inverse")[0], 4).alias("i0"),
                      rounded(F.col("inverse")[2], 4).alias("i2"), error.alias("error_m"))


@query("calibration_staleness", "E26 A20", f"""
WITH {CALIB_SQL},
k AS (SELECT *, max(CASE WHEN keyframe AND cal_valid THEN cf END) OVER (PARTITION BY cs ORDER BY cf) AS last_key FROM cal)
SELECT cs AS sequence_id, cf AS frame_index, cf - last_key AS age,
  CASE WHEN last_key IS NULL THEN 'INVALID' WHEN cf = last_key THEN 'CALIBRATED' WHEN cf - last_key <= 10 THEN 'PROPAGATED' ELSE 'STALE' END AS state FROM k""")
def calibration_staleness(spark, sf_dir):
    return calibration.staleness(views.calibrations(spark, sf_dir)).select(*geo.FRAME, "age", "state")


@query("calibration_summary", "A20", f"""
WITH {CALIB_SQL},
k AS (SELECT *, max(CASE WHEN keyframe AND cal_valid THEN cf END) OVER (PARTITION BY cs ORDER BY cf) AS last_key FROM cal)
SELECT cs AS sequence_id, count(*) AS frames, round(avg(CASE WHEN cal_valid THEN 1.0 ELSE 0.0 END), 6) AS valid_rate,
  round(avg(CASE WHEN cf = last_key THEN 1.0 ELSE 0.0 END), 6) AS keyframe_rate,
  round(avg(CASE WHEN cf > last_key AND cf - last_key <= 10 THEN 1.0 ELSE 0.0 END), 6) AS propagated_rate, round(avg(cf - last_key), 6) AS mean_age FROM k GROUP BY 1""")
def calibration_summary(spark, sf_dir):
    return calibration.cadence_summary(calibration.staleness(views.calibrations(spark, sf_dir)))


@query("landmark_jitter", "W6", f"""
WITH {CALIB_SQL},
m AS (SELECT *, (h0 * 480.0 + h1 * 450.0 + h2) / (h6 * 480.0 + h7 * 450.0 + h8) AS gx, (h3 * 480.0 + h4 * 450.0 + h5) / (h6 * 480.0 + h7 * 450.0 + h8) AS gy,
  (h1 * h5 - h2 * h4) / (h0 * h4 - h1 * h3) AS cu, (h2 * h3 - h0 * h5) / (h0 * h4 - h1 * h3) AS cv FROM cal),
l AS (SELECT *, lag(cu) OVER w AS lu, lag(cv) OVER w AS lw, lag(gx) OVER w AS lx, lag(gy) OVER w AS ly, lag(cal_valid) OVER w AS lv, lag(cf) OVER w AS lf FROM m WINDOW w AS (PARTITION BY cs ORDER BY cf))
SELECT cs AS sequence_id, count(*) AS pairs, round(avg(sqrt((gx - lx) * (gx - lx) + (gy - ly) * (gy - ly))), 6) AS mean_jump_m,
  round(max(sqrt((gx - lx) * (gx - lx) + (gy - ly) * (gy - ly))), 6) AS max_jump_m,
  round(quantile_cont(sqrt((cu - lu) * (cu - lu) + (cv - lw) * (cv - lw)), 0.95), 4) AS p95_centre_jitter_px
FROM l WHERE cal_valid AND lv AND cf - lf = 1 GROUP BY 1""")
def landmark_jitter(spark, sf_dir):
    return calibration.ground_jump(views.calibrations(spark, sf_dir))


@query("crop_gate", "P27", """
WITH b AS (SELECT * FROM boxes_v),
o AS (SELECT a.event_id, max(i / greatest(1e-6, (a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) - i)) AS worst
 FROM b a JOIN b c ON a.sequence_id = c.sequence_id AND a.frame_index = c.frame_index AND NOT (a.x1 = c.x1 AND a.y1 = c.y1 AND a.x2 = c.x2 AND a.y2 = c.y2),
 LATERAL (SELECT greatest(0.0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0.0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) AS i) GROUP BY 1)
SELECT b.event_id, (y2 - y1 >= 35.0 AND x2 - x1 >= 15.0 AND (y2 - y1) / greatest(1.0, x2 - x1) BETWEEN 1.2 AND 4.5
  AND x1 >= 2.0 AND y1 >= 2.0 AND x2 <= 1918.0 AND y2 <= 1078.0 AND coalesce(worst, 0.0) < 0.20) AS usable
FROM b LEFT JOIN o USING (event_id)""")
def crop_gate(spark, sf_dir):
    return geo.crop_gate(views.boxes(spark, sf_dir)).select("event_id", "usable")
