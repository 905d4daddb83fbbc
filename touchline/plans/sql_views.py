"""SQL texts of the stand-in views, for the oracle engine.

``touchline.plans.views`` defines the same views as DataFrames.  Integer arithmetic is used up to the last
division so both engines agree bit for bit.
"""

VIEWS: dict[str, str] = {}

VIEWS["slots_v"] = """
SELECT event_id, event_id // 22 AS f, event_id % 22 AS slot, (event_id % 22) % 11 AS k,
       (event_id // 22) % 150 + 1 AS fi, CASE WHEN event_id % 22 < 11 THEN 1 ELSE -1 END AS sgn
FROM events"""

VIEWS["tracking_v"] = """
SELECT event_id, f, 'SEQ-' || CASE WHEN f // 150 < 1000 THEN lpad(CAST(f // 150 AS VARCHAR), 3, '0') ELSE CAST(f // 150 AS VARCHAR) END AS sequence_id, fi AS frame_index, (fi - 1) / 25.0::DOUBLE AS timestamp_s,
       slot AS track_id, CASE WHEN slot < 11 THEN 'TEAM_0' ELSE 'TEAM_1' END AS team_label,
       CASE WHEN k = 0 THEN 'GOALKEEPER' ELSE 'OUTFIELD_PLAYER' END AS role,
       (sgn * (CASE WHEN k = 0 THEN -4800 WHEN k <= 4 THEN -3000 WHEN k <= 8 THEN -1000 ELSE 1200 END)
         + (abs((fi * 20) % 2000 - 1000) - 500)
         + (abs((fi * (7 + slot)) % 800 - 400) - 200)) / 100.0::DOUBLE AS x_m,
       (sgn * (CASE WHEN k = 0 THEN 0 WHEN k <= 4 THEN (2 * k - 5) * 600 WHEN k <= 8 THEN (2 * k - 13) * 600 ELSE (2 * k - 19) * 800 END)
         + (abs((fi * (5 + slot) * 3) % 600 - 300) - 150)) / 100.0::DOUBLE AS y_m,
       event_id % 37 <> 0 AS position_valid,
       (30 + (event_id * 7) % 70) / 100.0::DOUBLE AS team_confidence
FROM slots_v"""

VIEWS["gated_v"] = """
SELECT sequence_id, frame_index, timestamp_s, track_id, team_label, role, x_m, y_m, team_confidence
FROM tracking_v
WHERE position_valid AND abs(x_m) <= 52.5 AND abs(y_m) <= 34.0 AND team_confidence >= 0.40"""

VIEWS["outfield_v"] = "SELECT * FROM gated_v WHERE role <> 'GOALKEEPER'"

VIEWS["ball_v"] = """
SELECT sequence_id, frame_index, timestamp_s, f,
       x_m + ((f % 12) - 6) * 30 / 100.0::DOUBLE AS ball_x, y_m AS ball_y,
       f % 41 <> 0 AS ball_valid, (50 + (f * 11) % 50) / 100.0::DOUBLE AS ball_conf
FROM tracking_v WHERE track_id = ((f // 12) * 7) % 22"""

VIEWS["boxes_v"] = """
SELECT event_id, sequence_id, frame_index, track_id, team_label, role, position_valid,
       (x_m + 52.5) / 105.0 * 1920.0 - 15.0 AS x1, (y_m + 34.0) / 68.0 * 1080.0 - 90.0 AS y1,
       (x_m + 52.5) / 105.0 * 1920.0 + 15.0 AS x2, (y_m + 34.0) / 68.0 * 1080.0 AS y2
FROM tracking_v"""

VIEWS["pred_boxes_v"] = """
SELECT event_id, sequence_id, frame_index,
       CASE WHEN event_id % 101 = 0 THEN (track_id + 1) % 22 ELSE track_id END AS pred_track_id,
       CASE WHEN event_id % 53 = 0 THEN CASE WHEN team_label = 'TEAM_0' THEN 'TEAM_1' ELSE 'TEAM_0' END ELSE team_label END AS pred_team,
       x1 + event_id % 7 AS px1, y1 AS py1, x2 + event_id % 7 AS px2, y2 AS py2,
       ((event_id * 37) % 1000) / 1000.0::DOUBLE AS conf
FROM boxes_v WHERE event_id % 29 <> 0"""

VIEWS["player_match_stats_v"] = """
SELECT 'season_' || CAST(year(o_orderdate) AS VARCHAR) || CASE WHEN o_orderpriority LIKE '1%' THEN '_cl' ELSE '_summary' END AS match_id,
       c_name AS player_name, n_name AS team_name,
       CASE WHEN o_orderpriority LIKE '1%' THEN 'Champions League' ELSE 'Domestic League' END AS competition,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS minutes_played,
       count(*) FILTER (l_returnflag = 'R') AS goals,
       CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS expected_goals,
       CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS expected_assists,
       count(*) FILTER (l_linestatus = 'O') AS key_passes,
       CAST(sum(l_linenumber) AS BIGINT) AS progressive_dribbles, count(*) AS defensive_pressures
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1, 2, 3, 4"""

VIEWS["player_profiles_v"] = """
SELECT c_custkey AS player_id, c_name AS player_name,
       CASE c_custkey % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END AS position,
       c_acctbal AS market_value, r_name AS league
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

VIEWS["player_ratings_v"] = """
SELECT c_custkey AS player_id, (60 + c_custkey % 40) / 10.0::DOUBLE AS rating FROM customer WHERE c_custkey % 5 <> 0"""

VIEWS["direction_v"] = """
SELECT o.sequence_id, o.frame_index, o.team_label, CASE WHEN o.frame_index < k.f0 OR k.f0 IS NULL THEN 0 WHEN o.team_label = 'TEAM_0' THEN 1 ELSE -1 END AS direction
FROM (SELECT DISTINCT sequence_id, frame_index, team_label FROM gated_v) o
LEFT JOIN (SELECT sequence_id, min(frame_index) AS f0 FROM gated_v WHERE role = 'GOALKEEPER' AND abs(x_m) > 30.5 GROUP BY 1) k USING (sequence_id)"""

VIEWS["oriented_v"] = """
SELECT o.*, direction, direction * x_m AS xa FROM outfield_v o JOIN direction_v USING (sequence_id, frame_index, team_label)"""

VIEWS["line_players_v"] = """
SELECT *, sum(CASE WHEN prev IS NULL OR xa - prev < 6.0 THEN 0 ELSE 1 END) OVER (PARTITION BY sequence_id, frame_index, team_label ORDER BY xa, track_id) AS line_id
FROM (SELECT *, lag(xa) OVER (PARTITION BY sequence_id, frame_index, team_label ORDER BY xa, track_id) AS prev,
        count(*) OVER (PARTITION BY sequence_id, frame_index, team_label) AS n FROM oriented_v WHERE direction <> 0)
WHERE n >= 4"""

VIEWS["lines_v"] = """
SELECT sequence_id, frame_index, team_label, CAST(line_id AS INTEGER) AS line_id, CAST(count(*) AS INTEGER) AS players, avg(xa) AS mean_x_attack, quantile_cont(xa, 0.5) AS median_x_attack,
  max(y_m) - min(y_m) AS width_m, avg(x_m) AS mean_x, avg(y_m) AS mean_y, avg(team_confidence) AS confidence,
  row_number() OVER (PARTITION BY sequence_id, frame_index, team_label ORDER BY line_id DESC) AS from_front,
  count(*) OVER (PARTITION BY sequence_id, frame_index, team_label) AS total
FROM line_players_v GROUP BY sequence_id, frame_index, team_label, line_id"""

VIEWS["teams_v"] = """
SELECT sequence_id, frame_index, team_label, any_value(timestamp_s) AS timestamp_s, any_value(direction) AS direction, count(*) AS n, CASE WHEN count(*) >= 8 THEN 'HIGH' WHEN count(*) >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS visibility,
  quantile_cont(xa, 0.5) AS mx, avg(xa) AS ax, max(xa) AS fx, min(xa) AS bx, max(y_m) - min(y_m) AS w, avg(x_m) AS px, avg(y_m) AS py,
  quantile_cont(xa, 0.9) - quantile_cont(xa, 0.1) AS sx, quantile_cont(y_m, 0.9) - quantile_cont(y_m, 0.1) AS sy, quantile_cont(y_m, 0.5) AS my
FROM oriented_v GROUP BY 1, 2, 3"""

VIEWS["block_v"] = """
SELECT *, CASE WHEN direction = 0 OR n < 5 THEN 'UNKNOWN' WHEN h < 35.0 THEN 'LOW_BLOCK' WHEN h < 52.5 THEN 'MID_BLOCK' WHEN h IS NOT NULL THEN 'HIGH_BLOCK'
     WHEN mx + 52.5 < 42.0 THEN 'LOW_BLOCK' WHEN mx + 52.5 < 58.0 THEN 'MID_BLOCK' ELSE 'HIGH_BLOCK' END AS category
FROM (SELECT t.*, l.median_x_attack + 52.5 AS h, l.mean_x_attack + 52.5 AS mh, l.players AS line_players, l.mean_x AS lx, l.mean_y AS ly, l.median_x_attack AS lm, l.total AS line_count,
        o.mean_x AS ox, o.mean_y AS oy, ball_x, ball_y
      FROM teams_v t LEFT JOIN lines_v l ON t.sequence_id = l.sequence_id AND t.frame_index = l.frame_index AND t.team_label = l.team_label AND l.line_id = 0
      LEFT JOIN lines_v o ON t.sequence_id = o.sequence_id AND t.frame_index = o.frame_index AND t.team_label <> o.team_label AND o.from_front = 1
      LEFT JOIN (SELECT sequence_id AS bs, frame_index AS bf, ball_x, ball_y FROM ball_v WHERE ball_valid) b ON bs = t.sequence_id AND bf = t.frame_index)"""

VIEWS["moving_v"] = """
SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM (
 SELECT *, CASE WHEN position_valid AND t1 - t0 > 1e-4 THEN (xb - xa) / (t1 - t0) END AS vx, CASE WHEN position_valid AND t1 - t0 > 1e-4 THEN (yb - ya) / (t1 - t0) END AS vy FROM (
  SELECT *, CASE WHEN pok THEN px ELSE x_m END AS xa, CASE WHEN pok THEN py ELSE y_m END AS ya, CASE WHEN pok THEN pt ELSE timestamp_s END AS t0,
            CASE WHEN nok THEN nx ELSE x_m END AS xb, CASE WHEN nok THEN ny ELSE y_m END AS yb, CASE WHEN nok THEN nt ELSE timestamp_s END AS t1 FROM (
   SELECT *, coalesce(lag(position_valid) OVER w AND frame_index - lag(frame_index) OVER w <= 3, false) AS pok, lag(x_m) OVER w AS px, lag(y_m) OVER w AS py, lag(timestamp_s) OVER w AS pt,
             coalesce(lead(position_valid) OVER w AND lead(frame_index) OVER w - frame_index <= 3, false) AS nok, lead(x_m) OVER w AS nx, lead(y_m) OVER w AS ny, lead(timestamp_s) OVER w AS nt
   FROM tracking_v WINDOW w AS (PARTITION BY sequence_id, track_id ORDER BY frame_index))))"""

VIEWS["held_v"] = """
SELECT sequence_id, frame_index, CASE WHEN d < 2.8 THEN tm ELSE 'CONTESTED' END AS possession_team, CASE WHEN d < 2.8 THEN tr END AS carrier_id, CASE WHEN d < 2.8 THEN 0.85::DOUBLE ELSE 0.35::DOUBLE END AS possession_conf
FROM (SELECT sequence_id, frame_index, team_label AS tm, track_id AS tr, sqrt((ball_x - x_m) * (ball_x - x_m) + (ball_y - y_m) * (ball_y - y_m)) AS d,
        row_number() OVER (PARTITION BY sequence_id, frame_index ORDER BY sqrt((ball_x - x_m) * (ball_x - x_m) + (ball_y - y_m) * (ball_y - y_m)), team_label, track_id) AS rn
      FROM gated_v JOIN (SELECT sequence_id, frame_index, ball_x, ball_y FROM ball_v WHERE ball_valid) USING (sequence_id, frame_index)) WHERE rn = 1"""

VIEWS["men_v"] = """
SELECT g.sequence_id, g.frame_index, g.timestamp_s, g.track_id, g.team_label, g.role, g.x_m, g.y_m, coalesce(m.vx, 0.0) AS vx, coalesce(m.vy, 0.0) AS vy, coalesce(m.speed, 0.0) AS speed
FROM gated_v g JOIN moving_v m ON g.sequence_id = m.sequence_id AND g.frame_index = m.frame_index AND g.track_id = m.track_id"""

VIEWS["target_v"] = """
SELECT b.sequence_id, b.frame_index, b.timestamp_s, CASE WHEN c.track_id IS NOT NULL THEN 'CARRIER' WHEN ball_valid THEN 'BALL' ELSE 'UNKNOWN' END AS target_type, c.track_id AS target_id,
  CASE WHEN h.possession_team IN ('TEAM_0', 'TEAM_1') AND (c.track_id IS NOT NULL OR ball_valid) THEN h.possession_team ELSE 'UNKNOWN' END AS target_team,
  CASE WHEN c.track_id IS NOT NULL THEN h.possession_conf WHEN ball_valid THEN ball_conf * 0.8::DOUBLE ELSE 0.0::DOUBLE END AS target_conf,
  coalesce(c.x_m, ball_x) AS tx, coalesce(c.y_m, ball_y) AS ty, coalesce(c.vx, 0.0) AS tvx, coalesce(c.vy, 0.0) AS tvy,
  CASE h.possession_team WHEN 'TEAM_0' THEN 'TEAM_1' WHEN 'TEAM_1' THEN 'TEAM_0' ELSE 'UNKNOWN' END AS defending_team
FROM ball_v b LEFT JOIN held_v h ON b.sequence_id = h.sequence_id AND b.frame_index = h.frame_index
LEFT JOIN men_v c ON c.sequence_id = b.sequence_id AND c.frame_index = b.frame_index AND c.track_id = h.carrier_id"""

VIEWS["defenders_v"] = """
SELECT *, CASE WHEN d > 1e-3 THEN ((tx - x_m) * (vx - tvx) + (ty - y_m) * (vy - tvy)) / d ELSE 0.0 END AS closing,
  atan2(y_m - ty, x_m - tx) AS angle
FROM (SELECT t.*, m.track_id, m.x_m, m.y_m, m.vx, m.vy, m.speed, sqrt((tx - x_m) * (tx - x_m) + (ty - y_m) * (ty - y_m)) AS d
      FROM target_v t JOIN men_v m ON m.sequence_id = t.sequence_id AND m.frame_index = t.frame_index AND m.team_label = t.defending_team WHERE target_type <> 'UNKNOWN')"""

VIEWS["compression_v"] = """
SELECT *, line_rate > 0.4 AND depth_rate < -0.4 AND centroid_rate < -0.4 AS compressing FROM (
 SELECT sequence_id, frame_index, defending_team, CASE WHEN n > n0 THEN coalesce((h - h0) / dt, 0.0) ELSE 0.0 END AS line_rate, CASE WHEN n > n0 THEN coalesce((dp - d0) / dt, 0.0) ELSE 0.0 END AS depth_rate,
   CASE WHEN n > n0 THEN coalesce((w - w0) / dt, 0.0) ELSE 0.0 END AS width_rate, CASE WHEN n > n0 THEN coalesce((c - c0) / dt, 0.0) ELSE 0.0 END AS centroid_rate
 FROM (SELECT *, greatest(1e-3, ts - t0) AS dt FROM (
   SELECT *, first_value(n) OVER r AS n0, first_value(ts) OVER r AS t0, first_value(h) OVER r AS h0, first_value(dp) OVER r AS d0, first_value(w) OVER r AS w0, first_value(c) OVER r AS c0
   FROM (SELECT t.sequence_id, t.frame_index, t.defending_team, b.timestamp_s AS ts, b.h, CASE WHEN b.direction <> 0 THEN b.fx - b.bx END AS dp, CASE WHEN b.direction <> 0 AND b.n >= 2 THEN b.w END AS w,
           CASE WHEN b.direction <> 0 THEN sqrt((b.px - b.ball_x) * (b.px - b.ball_x) + (b.py - b.ball_y) * (b.py - b.ball_y)) END AS c,
           row_number() OVER (PARTITION BY t.sequence_id ORDER BY t.frame_index) AS n
         FROM target_v t JOIN block_v b ON b.sequence_id = t.sequence_id AND b.frame_index = t.frame_index AND b.team_label = t.defending_team)
   WINDOW r AS (PARTITION BY sequence_id ORDER BY n ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))))"""

VIEWS["pressure_v"] = """
WITH q AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, frame_index ORDER BY d, track_id) AS rn FROM defenders_v),
a AS (SELECT *, lead(angle) OVER (PARTITION BY sequence_id, frame_index ORDER BY angle) AS nxt, min(angle) OVER (PARTITION BY sequence_id, frame_index) AS lo FROM defenders_v WHERE d <= 8.0),
g AS (SELECT sequence_id, frame_index, coalesce(nxt - angle, 2 * pi() - (angle - lo)) AS gap FROM a),
cov AS (SELECT sequence_id, frame_index, count(DISTINCT least(7, floor((angle + pi()) % (2 * pi()) / (2 * pi() / 8)))) AS sectors FROM a GROUP BY 1, 2),
gm AS (SELECT sequence_id, frame_index, degrees(max(gap)) AS free_gap FROM g GROUP BY 1, 2),
r AS (SELECT sequence_id, frame_index, max(d) FILTER (rn = 1) AS d1, max(closing) FILTER (rn = 1) AS v1, max(track_id) FILTER (rn = 1) AS nearest_id, max(d) FILTER (rn = 2) AS d2, max(d) FILTER (rn = 3) AS d3,
  count(*) FILTER (d <= 2.0) AS r2, count(*) FILTER (d <= 3.0) AS r3, count(*) FILTER (d <= 5.0) AS r5, count(*) FILTER (d <= 8.0) AS r8, avg(closing) FILTER (d <= 8.0) AS mean_close,
  max(closing) FILTER (d <= 8.0) AS max_close, count(*) FILTER (d <= 8.0 AND closing > 0) AS pos, count(*) FILTER (d <= 8.0 AND closing >= 1.5) AS fast FROM q GROUP BY 1, 2),
j AS (SELECT t.*, d1, v1, nearest_id, d2, d3, coalesce(r2, 0) AS r2, coalesce(r3, 0) AS r3, coalesce(r5, 0) AS r5, coalesce(r8, 0) AS r8, coalesce(mean_close, 0.0) AS mean_close, coalesce(max_close, 0.0) AS max_close,
   coalesce(pos, 0) AS pos, coalesce(fast, 0) AS fast, coalesce(sectors, 0) AS sectors, coalesce(free_gap, 360.0) AS free_gap, coalesce(c.compressing, false) AS compressing
  FROM target_v t LEFT JOIN r USING (sequence_id, frame_index) LEFT JOIN cov USING (sequence_id, frame_index) LEFT JOIN gm USING (sequence_id, frame_index)
  LEFT JOIN (SELECT sequence_id, frame_index, compressing FROM compression_v) c USING (sequence_id, frame_index))
SELECT *, CASE WHEN target_type = 'UNKNOWN' OR d1 IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0,
   (0.40 * exp(-d1 / 2.8) * (CASE WHEN v1 > 0 THEN 1.0 + least(0.8, v1 / 4.0) WHEN v1 < -1.0 THEN greatest(0.4, 1.0 + (v1 + 1.0) / 4.0) ELSE 1.0 END)
    + 0.075 * exp(-coalesce(d2, 15.0) / 4.5) + 0.25 * least(1.0, 0.40 * r2 + 0.25 * r3 + 0.15 * r5) + 0.15 * sectors / 8.0 + CASE WHEN compressing THEN 0.08 ELSE 0.0 END)
   * (1.0 + 0.15 * greatest(0, r2 - 1) + 0.10 * greatest(0, r3 - 2)))) END::DOUBLE AS p FROM j"""

VIEWS["turnovers_v"] = """
SELECT sequence_id, frame_index AS loss_frame, (frame_index - 1) / 25.0::DOUBLE AS loss_ts, prev AS losing_team, possession_team AS gaining_team, 0.82::DOUBLE AS change_conf
FROM (SELECT *, lag(possession_team) OVER (PARTITION BY sequence_id ORDER BY frame_index) AS prev FROM held_v WHERE possession_team IN ('TEAM_0', 'TEAM_1')) WHERE prev <> possession_team"""

VIEWS["visible_v"] = "SELECT sequence_id, frame_index, any_value(timestamp_s) AS timestamp_s, count(*) AS visible FROM gated_v GROUP BY 1, 2"

VIEWS["team_visible_v"] = "SELECT sequence_id, frame_index, team_label, count(*) AS players FROM gated_v GROUP BY 1, 2, 3"

VIEWS["ends_v"] = "SELECT sequence_id, max(frame_index) AS last_frame, max(timestamp_s) AS last_ts FROM ball_v GROUP BY 1"

VIEWS["transitions_v"] = """
WITH sides AS (SELECT sequence_id, frame_index, team_label, direction, h, CASE WHEN direction <> 0 THEN fx - bx END AS dp, CASE WHEN direction <> 0 AND n >= 2 THEN w END AS w,
    CASE WHEN direction <> 0 THEN sqrt((px - ball_x) * (px - ball_x) + (py - ball_y) * (py - ball_y)) END AS cb FROM block_v),
j AS (SELECT t.*, v.frame_index AS fr, v.timestamp_s AS ts, v.visible, p.p, p.d1, p.v1, p.r3, p.r5, p.sectors / 8.0 AS cov, s.h, s.dp, s.w, s.cb, g.direction AS gd, b.ball_x AS bxx, v.frame_index >= t.loss_frame AS post
  FROM turnovers_v t JOIN visible_v v ON v.sequence_id = t.sequence_id AND v.frame_index BETWEEN t.loss_frame - 25 AND t.loss_frame + 25
  LEFT JOIN pressure_v p ON p.sequence_id = t.sequence_id AND p.frame_index = v.frame_index
  LEFT JOIN sides s ON s.sequence_id = t.sequence_id AND s.frame_index = v.frame_index AND s.team_label = t.losing_team
  LEFT JOIN sides g ON g.sequence_id = t.sequence_id AND g.frame_index = v.frame_index AND g.team_label = t.gaining_team
  LEFT JOIN (SELECT sequence_id, frame_index, ball_x FROM ball_v WHERE ball_valid) b ON b.sequence_id = t.sequence_id AND b.frame_index = v.frame_index),
a AS (SELECT sequence_id, loss_frame, loss_ts, losing_team, gaining_team, change_conf, avg(visible) FILTER (post) AS mean_visible,
   coalesce(avg(p) FILTER (NOT post), 0.05) AS pp, coalesce(avg(p) FILTER (post), 0.05) AS pa, coalesce(avg(d1) FILTER (NOT post), 12.0) AS dpre, coalesce(avg(d1) FILTER (post), 12.0) AS dpost,
   avg(v1) FILTER (post) AS cs, coalesce(avg(r3) FILTER (post), 0.0) AS r3, coalesce(avg(r5) FILTER (post), 0.0) AS r5, coalesce(avg(cb) FILTER (post), 20.0) - coalesce(avg(cb) FILTER (NOT post), 20.0) AS cd,
   CASE WHEN count(h) FILTER (post) >= 2 THEN (arg_max(h, fr) FILTER (post AND h IS NOT NULL) - arg_min(h, fr) FILTER (post AND h IS NOT NULL)) / greatest(1e-3, max(ts) FILTER (post) - min(ts) FILTER (post)) ELSE 0.0 END AS lv,
   coalesce((arg_max_null(bxx, fr) FILTER (post) - arg_min_null(bxx, fr) FILTER (post)) * CASE WHEN arg_min_null(gd, fr) FILTER (post) = -1 THEN -1.0 ELSE 1.0 END, 0.0) AS prog
  FROM j GROUP BY 1, 2, 3, 4, 5, 6),
s AS (SELECT *, least(1.0, greatest(0.0, 0.35 * (0.5 * least(1.0, greatest(0.0, pa)) + 0.5 * least(1.0, greatest(0.0, (pa - pp + 0.2) / 0.5)))
     + 0.25 * CASE WHEN cs IS NOT NULL THEN 0.45 * least(1.0, greatest(0.0, (8.0 - dpost) / 8.0)) + 0.55 * least(1.0, greatest(0.0, (cs + 1.0) / 5.0)) ELSE least(1.0, greatest(0.0, (8.0 - dpost) / 8.0)) END
     + 0.20 * (0.5 * least(1.0, r3 / 2.0) + 0.5 * least(1.0, r5 / 3.0)) + 0.20 * (0.5 * least(1.0, greatest(0.0, (1.5 - cd) / 3.0)) + 0.5 * least(1.0, greatest(0.0, (lv + 1.0) / 2.5))))) AS cp,
   least(1.0, greatest(0.0, 0.30 * least(1.0, greatest(0.0, (0.25 - pa) / 0.25)) + 0.30 * (0.5 * least(1.0, greatest(0.0, (cd + 1.0) / 3.0)) + 0.5 * least(1.0, greatest(0.0, (1.0 - lv) / 2.5)))
     + 0.25 * CASE WHEN cs IS NOT NULL THEN 0.5 * least(1.0, greatest(0.0, (dpost - dpre + 1.0) / 4.0)) + 0.5 * least(1.0, greatest(0.0, (1.0 - cs) / 4.0)) ELSE least(1.0, greatest(0.0, (dpost - dpre + 1.0) / 4.0)) END
     + 0.15 * greatest(0.0, 1.0 - (r3 + r5) / 3.0))) AS rec FROM a)
SELECT s.sequence_id, loss_frame, loss_ts, losing_team, gaining_team, change_conf, mean_visible, pp, pa, dpre, dpost, cs, r3, r5, cd, lv, prog,
   CASE WHEN mean_visible < 6 THEN 0.0 ELSE cp END AS cp, CASE WHEN mean_visible < 6 THEN 0.0 ELSE rec END AS rec, CASE WHEN mean_visible < 6 THEN 'NOT_VISIBLE' WHEN change_conf < 0.45 THEN 'AMBIGUOUS' WHEN cp >= 0.52 AND cp > rec + 0.10 THEN 'COUNTERPRESS_CANDIDATE'
     WHEN rec >= 0.48 AND rec > cp + 0.08 THEN 'DEFENSIVE_RECOVERY_CANDIDATE' ELSE 'NEUTRAL_TRANSITION' END AS candidate_label,
   CASE WHEN mean_visible < 6 THEN 'AMBIGUOUS' WHEN prog >= 5.0 THEN 'FAST_ATTACK' WHEN prog <= 2.0 THEN 'SLOW_BUILDUP' ELSE 'AMBIGUOUS' END AS response, loss_frame + 25 AS confirm_frame
FROM s JOIN (SELECT sequence_id, max(frame_index) AS mf FROM visible_v GROUP BY 1) e ON e.sequence_id = s.sequence_id AND mf >= loss_frame + 25"""

VIEWS["press_marks_v"] = """
SELECT *, sum(CASE WHEN member AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY sequence_id, defending_team ORDER BY frame_index) AS island FROM (
 SELECT *, was OR p >= 0.45 AS member FROM (
  SELECT *, coalesce(last_value(flag IGNORE NULLS) OVER (PARTITION BY sequence_id, defending_team ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS was
  FROM (SELECT *, CASE WHEN p >= 0.45 THEN 1 WHEN p < 0.25 THEN 0 END AS flag FROM pressure_v WHERE defending_team IN ('TEAM_0', 'TEAM_1'))))"""

VIEWS["press_episodes_v"] = """
SELECT *, 'press_' || start_frame || '_' || end_frame || '_' || defending_team AS event_id, greatest(0.0, least(least(1.0, greatest(0.0, mean_p * CASE WHEN vis >= 8 THEN 1.0 WHEN vis >= 6 THEN 0.85 WHEN vis >= 4 THEN 0.65 ELSE 0.30 END)), 0.90::DOUBLE)) AS confidence,
  CASE WHEN vis < 4 THEN 'INVALID' WHEN vis < 6 THEN 'LOW' WHEN vis <= 7 THEN 'MEDIUM' ELSE 'HIGH' END AS quality
FROM (SELECT m.sequence_id, m.defending_team, min(m.frame_index) AS start_frame, min(m.timestamp_s) AS start_ts, CASE WHEN arg_max(m.p, m.frame_index) < 0.25 THEN max(m.frame_index) ELSE any_value(last_frame) END AS end_frame,
   CASE WHEN arg_max(m.p, m.frame_index) < 0.25 THEN max(m.timestamp_s) ELSE any_value(last_ts) END AS end_ts, arg_min(m.target_team, m.frame_index) AS opponent_team, avg(m.p) AS mean_p, max(m.p) AS peak_p,
   coalesce(min(d1), 0.0) AS nearest_m, CAST(floor(avg(coalesce(players, 1))) AS INTEGER) AS vis
  FROM press_marks_v m JOIN ends_v e ON e.sequence_id = m.sequence_id LEFT JOIN team_visible_v t ON t.sequence_id = m.sequence_id AND t.frame_index = m.frame_index AND t.team_label = m.defending_team
  WHERE member GROUP BY m.sequence_id, m.defending_team, island) WHERE end_frame - start_frame + 1 >= 8"""

VIEWS["evidence_v"] = """
SELECT sequence_id, 'poss_change_' || loss_frame || '_' || losing_team || '_to_' || gaining_team AS event_id, loss_frame AS start_frame, loss_frame AS end_frame, loss_ts AS start_ts, loss_ts AS end_ts, 'POSSESSION_CHANGE' AS family,
  'LEVEL_1_PHYSICAL_FACT' AS level, losing_team AS subject_team, gaining_team AS opponent_team, change_conf AS confidence, 'HIGH' AS quality FROM turnovers_v
UNION ALL SELECT sequence_id, 'trans_' || loss_frame || '_' || confirm_frame || '_' || losing_team || '_' || candidate_label, loss_frame, confirm_frame, loss_ts, confirm_frame / 25.0::DOUBLE,
  CASE WHEN candidate_label = 'DEFENSIVE_RECOVERY_CANDIDATE' THEN 'DEFENSIVE_RECOVERY' ELSE 'POST_LOSS_ENGAGEMENT' END, 'LEVEL_3_TACTICAL_CANDIDATE', losing_team, gaining_team,
  least(CASE candidate_label WHEN 'COUNTERPRESS_CANDIDATE' THEN cp WHEN 'DEFENSIVE_RECOVERY_CANDIDATE' THEN rec ELSE greatest(cp, rec, 0.40) END, change_conf, 0.85::DOUBLE), 'HIGH' FROM transitions_v
UNION ALL SELECT sequence_id, event_id, start_frame, end_frame, start_ts, end_ts, 'PRESSURE_EPISODE', 'LEVEL_1_PHYSICAL_FACT', defending_team, opponent_team, confidence, quality FROM press_episodes_v"""

VIEWS["links_v"] = """
SELECT DISTINCT a.sequence_id, a.event_id AS source_id, b.event_id AS target_id, CASE a.family WHEN 'POSSESSION_CHANGE' THEN 'CAUSES' ELSE 'SUPPORTS' END AS relation
FROM evidence_v a JOIN evidence_v b ON a.sequence_id = b.sequence_id AND b.family IN ('POST_LOSS_ENGAGEMENT', 'DEFENSIVE_RECOVERY')
WHERE (a.family = 'POSSESSION_CHANGE' AND abs(a.start_frame - b.start_frame) <= 25 AND (a.subject_team = b.subject_team OR a.opponent_team = b.opponent_team))
   OR (a.family = 'PRESSURE_EPISODE' AND a.start_frame <= b.end_frame AND a.end_frame >= b.start_frame AND a.subject_team = b.subject_team)"""

VIEWS["markdown_v"] = """
SELECT doc_id, source || '_' || doc_id || '.md' AS source, CASE WHEN doc_id % 3 = 0 THEN '# Doc ' || doc_id || chr(10) ELSE '' END
  || array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN length(l) % 17 = 5 THEN '## ' || l WHEN length(l) % 19 = 5 THEN '### ' || l ELSE l END), chr(10)) AS text FROM documents"""

VIEWS["search_v"] = "SELECT item_id AS query_id, text AS query FROM benchmark"

VIEWS["questions_v"] = """
SELECT conv_id * 1000 + turn AS query_id, CASE conv_id % 12 WHEN 0 THEN 'Pourquoi le bloc est bas entre 2.5s et 6 secondes' WHEN 1 THEN 'Que se passe-t-il a 12.4s avec team 0' WHEN 2 THEN 'bonjour' WHEN 3 THEN 'une pizza' WHEN 4 THEN 'le score final du match'
  WHEN 5 THEN 'comment fonctionne le pressing en 4-3-3' WHEN 6 THEN 'qui a le ballon frame 145' WHEN 7 THEN 'pressing PSG en premiere mi-temps' WHEN 8 THEN 'fin de match, transition a la 72e minute' WHEN 9 THEN 'plus compact, team 1'
  WHEN 10 THEN 'faire un exercice pour eviter la perte de balle 442' ELSE 'attaquer le bloc bas de inter en ligue 1 avec vitinha' END || ' ' || text AS query, conv_id % 12 AS slot FROM conversations WHERE role = 'user'"""

VIEWS["doc_tokens_v"] = """
SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s-]', ' ', 'g'), '[\\s\\p{Z}]+'), lambda w: length(w) > 1) AS toks FROM documents"""

VIEWS["query_tokens_v"] = """
SELECT query_id, list_filter(regexp_split_to_array(regexp_replace(lower(query), '[^\\p{L}\\p{N}_\\s-]', ' ', 'g'), '[\\s\\p{Z}]+'), lambda w: length(w) > 1) AS toks FROM search_v"""

VIEWS["bm25_v"] = """
WITH p AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS token FROM doc_tokens_v), tf AS (SELECT doc_id, dl, token, count(*) AS tf FROM p GROUP BY 1, 2, 3),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(toks)) AS ml FROM doc_tokens_v), q AS (SELECT query_id, unnest(toks) AS token FROM query_tokens_v)
SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / ml))) AS score FROM q JOIN tf USING (token) JOIN df USING (token), st GROUP BY 1, 2"""

VIEWS["tfidf_v"] = """
WITH p AS (SELECT doc_id, unnest(flatten(list_transform(toks, lambda w: CASE WHEN regexp_full_match(w, '\\d+(-\\d+)+') THEN [w, replace(w, '-', '')] WHEN regexp_full_match(w, '\\d{3,4}') THEN [w, array_to_string(string_split(w, ''), '-')] ELSE [w] END))) AS token FROM doc_tokens_v),
dl AS (SELECT doc_id, count(*) AS dl FROM p GROUP BY 1), tf AS (SELECT doc_id, token, count(*) AS tf FROM p GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM doc_tokens_v),
w AS (SELECT doc_id, token, tf / dl * (ln(1 + n / (1 + df)) + 1.0) AS w FROM tf JOIN dl USING (doc_id) JOIN df USING (token), n)
SELECT doc_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w"""

VIEWS["tfidf_scores_v"] = """
WITH q0 AS (SELECT query_id, unnest(flatten(list_transform(toks, lambda w: CASE WHEN regexp_full_match(w, '\\d+(-\\d+)+') THEN [w, replace(w, '-', '')] WHEN regexp_full_match(w, '\\d{3,4}') THEN [w, array_to_string(string_split(w, ''), '-')] ELSE [w] END))) AS token FROM query_tokens_v),
ql AS (SELECT query_id, count(*) AS ql FROM q0 GROUP BY 1), qt AS (SELECT query_id, token, count(*) AS qtf FROM q0 GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tfidf_v GROUP BY 1), n AS (SELECT count(*) AS n FROM doc_tokens_v),
w AS (SELECT query_id, token, qtf / ql * (ln(1 + n / (1 + df)) + 1.0) AS w FROM qt JOIN ql USING (query_id) JOIN df USING (token), n),
u AS (SELECT query_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS qw FROM w)
SELECT query_id, doc_id, sum(weight * qw) AS score FROM u JOIN tfidf_v USING (token) GROUP BY 1, 2"""

def _places(value: str, first: int, last: int) -> str:
    """A number rounded half away from zero, first to the places it is stored with, then to those it is shown with."""
    return f"CAST(round(CAST(round({value}, {first}) AS DECIMAL(18, {first})), {last}) AS DECIMAL(18, {last}))::VARCHAR"


VIEWS["summaries_v"] = f"""
SELECT sequence_id, 'poss_change_' || loss_frame || '_' || losing_team || '_to_' || gaining_team AS event_id,
  printf('%s lost possession to %s at %.2fs (frame %d). Possession confidence: %.2f [%s].', losing_team, gaining_team, loss_ts, loss_frame, change_conf, 'HIGH') AS summary_text FROM turnovers_v
UNION ALL SELECT sequence_id, 'trans_' || loss_frame || '_' || confirm_frame || '_' || losing_team || '_' || candidate_label,
  CASE WHEN candidate_label = 'DEFENSIVE_RECOVERY_CANDIDATE' THEN printf('%s initiated defensive recovery after possession loss (%.2f–%.2fs). Backline retreated at ', losing_team, loss_ts, confirm_frame / 25.0::DOUBLE)
     || {_places("lv", 2, 1)} || 'm/s; centroid-ball distance shifted by ' || CASE WHEN round(cd, 2) >= 0 THEN '+' ELSE '' END || {_places("cd", 2, 1)} || 'm. RecoveryScore: ' || {_places("rec", 3, 2)}
   ELSE printf('%s engaged in post-loss pressing against %s (%.2f–%.2fs, Δt=%.2fs). Nearest defender closed from ', losing_team, gaining_team, loss_ts, confirm_frame / 25.0::DOUBLE, confirm_frame / 25.0::DOUBLE - loss_ts)
     || {_places("dpre", 2, 1)} || 'm to ' || {_places("dpost", 2, 1)} || 'm; PressureIndex changed from ' || {_places("pp", 3, 2)} || ' to ' || {_places("pa", 3, 2)} || '. CounterpressScore: ' || {_places("cp", 3, 2)} END
   || printf(' [Confidence: %.2f].', least(CASE candidate_label WHEN 'COUNTERPRESS_CANDIDATE' THEN cp WHEN 'DEFENSIVE_RECOVERY_CANDIDATE' THEN rec ELSE greatest(cp, rec, 0.40) END, change_conf, 0.85::DOUBLE)) FROM transitions_v
UNION ALL SELECT sequence_id, event_id, printf('%s applied continuous defensive pressure on %s (%.2f–%.2fs, dur: %.2fs). Mean PressureIndex: ', defending_team, coalesce(opponent_team, 'UNKNOWN'), start_ts, end_ts, end_ts - start_ts)
   || {_places("mean_p", 3, 2)} || ' (peak: ' || {_places("peak_p", 3, 2)} || '), min defender proximity: ' || {_places("nearest_m", 2, 1)} || 'm.' FROM press_episodes_v"""

VIEWS["asked_v"] = """
SELECT query_id, slot, CASE WHEN (query_id // 1000) % n < 1000 THEN 'SEQ-' || lpad(CAST((query_id // 1000) % n AS VARCHAR), 3, '0') ELSE 'SEQ-' || (query_id // 1000) % n END AS sequence_id,
  CASE slot WHEN 0 THEN 'MATCH_EXPLANATION' WHEN 1 THEN 'MATCH_TIMELINE' WHEN 3 THEN 'UNSUPPORTED' WHEN 4 THEN 'UNSUPPORTED' WHEN 5 THEN 'GENERAL_FOOTBALL' WHEN 9 THEN 'MATCH_COMPARISON' ELSE 'MATCH_FACT' END AS scope
FROM questions_v, (SELECT max(CAST(substr(sequence_id, 5) AS BIGINT)) + 1 AS n FROM tracking_v)"""

VIEWS["qa_plan_v"] = """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY start_ts, end_ts, start_frame, event_id) AS place FROM evidence_v),
hit AS (SELECT query_id, slot, q.sequence_id, scope, event_id, place FROM asked_v q JOIN p ON p.sequence_id = q.sequence_id AND CASE slot WHEN 0 THEN start_ts <= 6.0 AND end_ts >= 2.5 WHEN 1 THEN start_ts <= 13.0 AND end_ts >= 11.8 WHEN 9 THEN subject_team = 'TEAM_1' ELSE place <= 8 END),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rn FROM hit) WHERE rn <= 8),
s AS (SELECT sequence_id, source_id AS a, target_id AS b FROM links_v UNION SELECT sequence_id, target_id, source_id FROM links_v),
r AS (SELECT query_id, sequence_id, scope, event_id AS root FROM f WHERE slot = 0 AND rn = 1),
h1 AS (SELECT r.*, b AS node FROM r JOIN s ON s.sequence_id = r.sequence_id AND a = root), h2 AS (SELECT h1.query_id, h1.sequence_id, h1.scope, root, s.b AS node FROM h1 JOIN s ON s.sequence_id = h1.sequence_id AND s.a = h1.node),
x AS (SELECT DISTINCT query_id, sequence_id, scope, node AS event_id FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) WHERE node <> root AND (query_id, node) NOT IN (SELECT (query_id, event_id) FROM f)),
u AS (SELECT query_id, sequence_id, scope, event_id, rn FROM f UNION ALL SELECT query_id, x.sequence_id, scope, x.event_id, place + 1000000 FROM x JOIN p ON p.sequence_id = x.sequence_id AND p.event_id = x.event_id)
SELECT query_id, sequence_id, scope, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rn) AS rank FROM u) WHERE rank <= 8"""

VIEWS["answers_v"] = """
WITH r AS (SELECT p.query_id, p.sequence_id, p.event_id, rank, confidence, level, start_ts, quality, family, CASE level WHEN 'LEVEL_1_PHYSICAL_FACT' THEN 'Fait mesuré : ' WHEN 'LEVEL_2_TACTICAL_TENDENCY' THEN 'Tendance observée : ' ELSE 'Signal compatible (candidat) : ' END || summary_text AS claim
  FROM qa_plan_v p JOIN evidence_v e ON e.sequence_id = p.sequence_id AND e.event_id = p.event_id JOIN summaries_v t ON t.sequence_id = p.sequence_id AND t.event_id = p.event_id),
g AS (SELECT query_id, count(*) AS n, avg(confidence) AS c, max(level) AS level, list(claim ORDER BY rank) AS claims, list(event_id ORDER BY rank) AS cited FROM r GROUP BY 1)
SELECT a.query_id, a.slot, a.sequence_id, a.scope, coalesce(n, 0) AS n_events, scope = 'UNSUPPORTED' OR (n IS NULL AND scope IN ('MATCH_FACT', 'MATCH_TIMELINE')) AS abstains, c, coalesce(level, 'LEVEL_1_PHYSICAL_FACT') AS level, coalesce(claims, []) AS claims, coalesce(cited, []) AS cited
FROM asked_v a LEFT JOIN g ON g.query_id = a.query_id"""

VIEWS["team_aggregates_v"] = """
WITH tf AS (SELECT b.sequence_id, b.team_label, b.h, CASE WHEN direction <> 0 THEN fx - bx END AS dp, CASE WHEN direction <> 0 AND n >= 2 THEN w END AS w, n, possession_conf AS pc FROM block_v b JOIN held_v p ON p.sequence_id = b.sequence_id AND p.frame_index = b.frame_index),
q AS (SELECT *, CASE WHEN n < 4 THEN 'INVALID' WHEN n < 6 THEN 'LOW' WHEN n <= 7 THEN 'MEDIUM' ELSE 'HIGH' END AS g, least(pc, 0.85 * CASE WHEN n >= 8 THEN 1.0 WHEN n >= 6 THEN 0.85 WHEN n >= 4 THEN 0.65 ELSE 0.3 END) AS cf FROM tf),
b AS (SELECT sequence_id, team_label, count(*) AS vf, avg(h) AS h, avg(dp) AS dp, avg(w) AS w, avg(cf) AS cm, quantile_cont(cf, 0.1) AS c10, count(*) FILTER (g = 'HIGH') AS gh, count(*) FILTER (g = 'MEDIUM') AS gm, count(*) FILTER (g = 'LOW') AS gl, count(*) FILTER (g = 'INVALID') AS gi FROM q GROUP BY 1, 2),
tot AS (SELECT sequence_id, count(*) AS tf FROM held_v GROUP BY 1), hf AS (SELECT sequence_id, possession_team AS team_label, count(*) AS hf FROM held_v WHERE possession_team LIKE 'TEAM%' GROUP BY 1, 2),
pr AS (SELECT sequence_id, defending_team AS team_label, avg(p) AS pm, max(p) AS pk FROM pressure_v WHERE defending_team LIKE 'TEAM%' GROUP BY 1, 2),
ev AS (SELECT sequence_id, subject_team AS team_label, count(*) FILTER (family = 'POSSESSION_CHANGE') AS pch, count(*) FILTER (family = 'PRESSURE_EPISODE' AND quality IN ('HIGH', 'MEDIUM')) AS pe FROM evidence_v GROUP BY 1, 2),
tr AS (SELECT sequence_id, losing_team AS team_label, avg(round(cp, 3)) AS cpm, avg(round(rec, 3)) AS rcm FROM transitions_v GROUP BY 1, 2)
SELECT b.sequence_id, b.team_label, round(coalesce(hf, 0) / 25.0, 2) AS possession_s, round(100.0 * coalesce(hf, 0) / tf, 1) AS possession_pct, coalesce(pch, 0) AS possession_changes, round(h + 1e-9, 2) AS line_height_m, round(dp + 1e-9, 2) AS depth_m, round(w + 1e-9, 2) AS width_m,
 round(coalesce(pm, 0.0) + 1e-9, 3) AS pressure_mean, round(coalesce(pk, 0.0) + 1e-9, 3) AS pressure_peak, coalesce(pe, 0) AS pressure_episodes, round(coalesce(cpm, 0.0) + 1e-9, 3) AS counterpress_mean, round(coalesce(rcm, 0.0) + 1e-9, 3) AS recovery_mean, 0.0::DOUBLE AS progression_m, 0::BIGINT AS completed_passes, round(100.0 * vf / tf, 1) AS coverage_pct, vf AS valid_frames, tf AS total_frames, round(cm + 1e-9, 3) AS conf_mean, round(c10 + 1e-9, 3) AS conf_p10,
 gh AS frames_high, gm AS frames_medium, gl AS frames_low, gi AS frames_invalid
FROM b LEFT JOIN tot USING (sequence_id) LEFT JOIN hf USING (sequence_id, team_label) LEFT JOIN pr USING (sequence_id, team_label) LEFT JOIN ev USING (sequence_id, team_label) LEFT JOIN tr USING (sequence_id, team_label)"""

VIEWS["report_v"] = f"""
WITH sp AS (SELECT sequence_id, min(start_ts) AS a, max(end_ts) AS b, count(*) AS n, count(*) FILTER (level LIKE 'LEVEL_1%') AS n1, count(*) FILTER (level LIKE 'LEVEL_2%') AS n2, count(*) FILTER (level LIKE 'LEVEL_3%') AS n3 FROM evidence_v GROUP BY 1),
m AS (SELECT e.*, summary_text, row_number() OVER (PARTITION BY e.sequence_id ORDER BY start_ts, end_ts, start_frame, e.event_id) AS place FROM evidence_v e JOIN summaries_v s ON s.sequence_id = e.sequence_id AND s.event_id = e.event_id),
w AS (SELECT *, CASE team_label WHEN 'TEAM_0' THEN 0 ELSE 1 END AS who FROM team_aggregates_v)
SELECT sequence_id, 1 AS section, 0::BIGINT AS position, printf('Séquence de %.2fs à %.2fs : %d événements (%d faits, %d tendances, %d candidats).', a, b, n, n1, n2, n3) AS sentence, '' AS citation FROM sp
UNION ALL SELECT sequence_id, 2, who, team_label || ' : possession ' || {_places("possession_pct", 1, 1)} || '% (' || {_places("possession_s", 2, 2)} || 's), ' || possession_changes || ' pertes.', '' FROM w
UNION ALL SELECT sequence_id, 3, who, team_label || ' : bloc ' || CASE WHEN line_height_m < 35.0 THEN 'bas' WHEN line_height_m < 55.0 THEN 'médian' ELSE 'haut' END || ', ligne à ' || {_places("line_height_m", 2, 1)} || 'm, pression moyenne ' || {_places("pressure_mean", 3, 3)} || '.', '' FROM w WHERE line_height_m IS NOT NULL
UNION ALL SELECT sequence_id, 4, place, summary_text, printf('[event:%s | t=%.2f–%.2fs | conf=%.2f | %s]', event_id, start_ts, end_ts, confidence, quality) FROM m WHERE place <= 15"""
