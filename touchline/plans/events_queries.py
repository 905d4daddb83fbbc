"""Possession, passes, transitions, formations and fused event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import formation, fusion, geometry as geo, lines, passes, possession as poss, smoothing, transitions
from touchline.plans import views
from touchline.plans.motion_queries import frame_pressure, possession as quick
from touchline.plans.registry import query, rounded
from touchline.plans.stats_queries import tidy
from touchline.plans.tactics_queries import block_table, directions, oriented, players


def ball_motion(spark, sf_dir):
    return smoothing.ball_speed(views.ball_pixels(views.ball(spark, sf_dir)))


def boxed_players(spark, sf_dir):
    """Gated players with their pixel boxes and speed."""
    u, v = (F.col("x_m") + 52.5) / 105.0 * 1920.0, (F.col("y_m") + 34.0) / 68.0 * 1080.0
    return (players(spark, sf_dir).withColumn("x1", u - 15.0).withColumn("y1", v - 90.0).withColumn("x2", u + 15.0).withColumn("y2", v))


def frame_list(spark, sf_dir):
    return views.ball(spark, sf_dir).select(*geo.FRAME, "timestamp_s", F.col("ball_valid").alias("ball_seen"))


def control_v1(spark, sf_dir):
    scored = poss.control_score_v1(boxed_players(spark, sf_dir), ball_motion(spark, sf_dir))
    return poss.decide(frame_list(spark, sf_dir), scored, 0.28, 0.15, 0.22)


def full_possession(spark, sf_dir):
    def build(s, d):
        return poss.possession_v2(frame_list(s, d), poss.control_features(boxed_players(s, d), ball_motion(s, d)))
    return views.shared("possession_v2", spark, sf_dir, build)


def turnovers(spark, sf_dir):
    return transitions.quick_turnovers(quick(spark, sf_dir))


def visible(spark, sf_dir):
    return players(spark, sf_dir).groupBy(*geo.FRAME).agg(F.first("timestamp_s").alias("timestamp_s"), F.count(F.lit(1)).alias("visible"))


def team_visible(spark, sf_dir):
    return players(spark, sf_dir).groupBy(*geo.TEAM).agg(F.count(F.lit(1)).alias("players"))


def transition_table(spark, sf_dir):
    def build(s, d):
        signals = transitions.frame_signals(frame_pressure(s, d), block_table(s, d), views.ball(s, d), visible(s, d))
        return transitions.transition_events(turnovers(s, d), signals)
    return views.shared("transitions", spark, sf_dir, build)


def ends(spark, sf_dir):
    return fusion.sequence_ends(views.ball(spark, sf_dir))


def press_episodes(spark, sf_dir):
    return fusion.pressure_episodes(frame_pressure(spark, sf_dir), team_visible(spark, sf_dir), ends(spark, sf_dir))


def evidence(spark, sf_dir):
    """Turnovers, transitions and pressure episodes as one event table."""
    def build(s, d):
        return fusion.timeline(fusion.possession_changes(turnovers(s, d)), fusion.transition_evidence(transition_table(s, d)), press_episodes(s, d))
    return views.shared("evidence", spark, sf_dir, build)


def full_evidence(spark, sf_dir):
    """Every event family over the full possession chain."""
    def build(s, d):
        held = full_possession(s, d)
        signals = transitions.frame_signals(frame_pressure(s, d), block_table(s, d), views.ball(s, d), visible(s, d))
        flights = passes.detect_passes(held, boxed_players(s, d), views.ball_pixels(views.ball(s, d)), directions(players(s, d)))
        blocks = fusion.block_episodes(block_table(s, d).withColumn("players", F.col("outfield_count")), ends(s, d))
        changes = poss.turnovers(held)
        return fusion.timeline(fusion.possession_changes(changes), fusion.transition_evidence(transitions.transition_events(changes, signals)),
                               fusion.pass_evidence(flights), blocks, press_episodes(s, d))
    return views.shared("full_evidence", spark, sf_dir, build)


SCORE_V1_SQL = """
bp AS (SELECT *, (ball_x + 52.5) / 105.0 * 1920.0 AS bu, (ball_y + 34.0) / 68.0 * 1080.0 AS bv FROM ball_v WHERE ball_valid),
bs AS (SELECT *, coalesce(sqrt(pow(ball_x - lag(ball_x) OVER w, 2) + pow(ball_y - lag(ball_y) OVER w, 2)) / greatest(1e-3, timestamp_s - lag(timestamp_s) OVER w), 0.0) AS ms FROM bp WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_index)),
pl AS (SELECT g.sequence_id, g.frame_index, track_id, team_label, team_confidence, x_m, y_m, (x_m + 52.5) / 105.0 * 1920.0 AS u, (y_m + 34.0) / 68.0 * 1080.0 AS v, bu, bv, ball_x, ball_y, ball_conf, ms FROM gated_v g JOIN bs b ON b.sequence_id = g.sequence_id AND b.frame_index = g.frame_index),
sc AS (SELECT *, greatest(0.0, 1.0 - sqrt(pow(bu - u, 2) + pow(bv - v, 2)) / (v - (v - 90.0)) / 0.55) AS sf,
   sqrt(pow(greatest(0.0, (u - 15.0) - bu, bu - (u + 15.0)), 2) + pow(greatest(0.0, (v - 90.0) - bv, bv - v), 2)) / (v - (v - 90.0)) AS off, greatest(0.0, 1.0 - sqrt(pow(ball_x - x_m, 2) + pow(ball_y - y_m, 2)) / 2.5) AS sm FROM pl),
s2 AS (SELECT *, CASE WHEN off = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - off / 0.5) END AS sb FROM sc),
score AS (SELECT *, (0.40 * sf + 0.30 * sb + 0.30 * CASE WHEN ms <= 25.0 THEN sm ELSE (sf + sb) / 2.0 END) * least(1.0, ball_conf * 1.5) * greatest(0.2, team_confidence) AS s FROM s2)"""

CONTROL_SQL = SCORE_V1_SQL + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, frame_index ORDER BY s DESC, track_id) AS rn FROM score),
ctl AS (SELECT b.sequence_id AS sq, b.frame_index AS fr, b.timestamp_s AS ts, CASE WHEN NOT b.ball_valid THEN 'UNKNOWN' WHEN a.s IS NULL OR a.s < 0.28 THEN 'FREE_BALL'
     WHEN c.s IS NOT NULL AND c.team_label <> a.team_label AND c.s >= 0.22 AND a.s - c.s < 0.15 THEN 'CONTESTED' ELSE 'CONTROLLED' END AS st, a.track_id AS pid, a.team_label AS pt, a.s AS s1, c.s AS s2v
   FROM ball_v b LEFT JOIN rk a ON a.sequence_id = b.sequence_id AND a.frame_index = b.frame_index AND a.rn = 1 LEFT JOIN rk c ON c.sequence_id = b.sequence_id AND c.frame_index = b.frame_index AND c.rn = 2)"""


@query("control_score", "P30", f"""
WITH {SCORE_V1_SQL} SELECT sequence_id, frame_index, track_id, round(s, 6) AS score FROM score""")
def control_score(spark, sf_dir):
    return tidy(poss.control_score_v1(boxed_players(spark, sf_dir), ball_motion(spark, sf_dir)).select(*geo.FRAME, "track_id", "score"))


@query("control_state", "P30 E6", f"""
WITH {CONTROL_SQL} SELECT sq AS sequence_id, fr AS frame_index, st AS control_state, pid AS player_id, pt AS player_team, round(s1, 6) AS score, round(s2v, 6) AS runner_up_score FROM ctl""")
def control_state(spark, sf_dir):
    return tidy(control_v1(spark, sf_dir).drop("timestamp_s", "player_team_conf"))


@query("control_features", "P29 P2", """
WITH bp AS (SELECT *, (ball_x + 52.5) / 105.0 * 1920.0 AS bu, (ball_y + 34.0) / 68.0 * 1080.0 AS bv FROM ball_v WHERE ball_valid),
bs AS (SELECT *, coalesce(sqrt(pow(ball_x - lag(ball_x) OVER w, 2) + pow(ball_y - lag(ball_y) OVER w, 2)) / greatest(1e-3, timestamp_s - lag(timestamp_s) OVER w), 0.0) AS ms,
  coalesce(sqrt(pow(bu - lag(bu) OVER w, 2) + pow(bv - lag(bv) OVER w, 2)) / greatest(1e-3, timestamp_s - lag(timestamp_s) OVER w), 0.0) AS px FROM bp WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_index)),
b2 AS (SELECT *, ms > 25.0 OR (px > 350.0 AND ms > 20.0) AS aerial FROM bs),
pl AS (SELECT m.sequence_id, m.frame_index, track_id, x_m, y_m, speed, (x_m + 52.5) / 105.0 * 1920.0 AS u, (y_m + 34.0) / 68.0 * 1080.0 AS v, bu, bv, ball_x, ball_y, ms, px, aerial FROM men_v m JOIN b2 b ON b.sequence_id = m.sequence_id AND b.frame_index = m.frame_index),
f AS (SELECT *, v - (v - 90.0) AS h, sqrt(pow(bu - u, 2) + pow(bv - v, 2)) AS foot, CASE WHEN NOT aerial THEN sqrt(pow(ball_x - x_m, 2) + pow(ball_y - y_m, 2)) END AS md FROM pl)
SELECT sequence_id, frame_index, track_id, round(least(3.0, sqrt(pow(bu - u, 2) + pow(bv - (v - 45.0), 2)) / h), 6) AS norm_centre, round(least(3.0, foot / h), 6) AS norm_foot,
  round(least(3.0, sqrt(pow(greatest(0.0, (u - 15.0) - bu, bu - (u + 15.0)), 2) + pow(greatest(0.0, (v - 90.0) + 0.70 * h - bv, bv - v), 2)) / h), 6) AS norm_lower,
  round(coalesce(least(15.0, md), 0.0), 6) AS metric_dist, CASE WHEN md IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS metric_valid, round(CASE WHEN md IS NOT NULL THEN least(20.0, abs(speed - ms)) ELSE 0.0 END, 5) AS rel_speed,
  round(least(2.0, px / 500.0), 5) AS ball_px, round(least(25.0, ms), 5) AS ball_ms, round(least(12.0, speed), 5) AS player_ms, round(least(speed, ms) / greatest(speed, ms, 1.0), 5) AS speed_match
FROM f WHERE foot / h <= 1.6 OR md <= 6.0""")
def control_features(spark, sf_dir):
    f = poss.in_reach(poss.control_features(boxed_players(spark, sf_dir), ball_motion(spark, sf_dir)))
    five = ("rel_speed", "ball_px", "ball_ms", "player_ms", "speed_match")
    return f.select(*geo.FRAME, "track_id", "metric_valid", *[rounded(F.col(c)).alias(c) for c in ("norm_centre", "norm_foot", "norm_lower", "metric_dist")],
                    *[rounded(F.col(c), 5).alias(c) for c in five])


_SURE = "CASE WHEN st = 'CONTROLLED' AND nrun >= 2 THEN {a} WHEN st = 'CONTESTED' THEN {b} WHEN st = 'FREE_BALL' THEN {c} WHEN st = 'UNKNOWN' AND nhid > 12 THEN {d} ELSE {e} END"


@query("possession_machine", "E5", f"""
WITH RECURSIVE {CONTROL_SQL},
m AS (SELECT sq, CAST(0 AS BIGINT) AS fr, 'UNKNOWN' AS team, 'UNKNOWN' AS status, 0.0::DOUBLE AS conf, NULL::BIGINT AS carrier, NULL::BIGINT AS pending, 0 AS run, 0 AS fre, 0 AS hid, NULL::VARCHAR AS lt, NULL::VARCHAR AS from_team, NULL::VARCHAR AS to_team, '' AS st FROM (SELECT DISTINCT sq FROM ctl)
 UNION ALL
 SELECT sq, fr, {_SURE.format(a='pt', b="'CONTESTED'", c="CASE WHEN nfre <= 15 AND lt IS NOT NULL THEN lt ELSE 'NEUTRAL' END", d="'UNKNOWN'", e='team')},
  {_SURE.format(a="'SECURE'", b="'CONTESTED'", c="CASE WHEN nfre <= 15 AND lt IS NOT NULL THEN 'PROVISIONAL_TRANSIT' ELSE 'NEUTRAL' END", d="'UNKNOWN'", e='status')},
  {_SURE.format(a='s1', b='0.65', c="CASE WHEN nfre <= 15 AND lt IS NOT NULL THEN greatest(0.35, 0.70 - nfre / 15.0 * 0.35) ELSE 0.5 END", d='conf', e='conf')},
  {_SURE.format(a='pid', b='NULL', c='NULL', d='NULL', e='carrier')}, CASE WHEN st = 'CONTROLLED' THEN pid ELSE pending END, nrun, CASE WHEN st = 'UNKNOWN' THEN fre ELSE nfre END, nhid,
  CASE WHEN st = 'CONTROLLED' AND nrun >= 2 THEN pt ELSE lt END, CASE WHEN st = 'CONTROLLED' AND nrun >= 2 AND team IN ('TEAM_0', 'TEAM_1') AND team <> pt THEN team END,
  CASE WHEN st = 'CONTROLLED' AND nrun >= 2 AND team IN ('TEAM_0', 'TEAM_1') AND team <> pt THEN pt END, st
 FROM (SELECT m.sq, c.fr, m.team, m.status, m.conf, m.carrier, m.pending, m.fre, m.lt, c.st, c.pid, c.pt, c.s1, CASE WHEN c.st = 'CONTROLLED' THEN CASE WHEN c.pid = m.pending THEN m.run + 1 ELSE 1 END ELSE m.run END AS nrun,
    CASE WHEN c.st = 'FREE_BALL' THEN m.fre + 1 WHEN c.st IN ('CONTROLLED', 'CONTESTED') THEN 0 ELSE m.fre END AS nfre, CASE WHEN c.st = 'UNKNOWN' THEN m.hid + 1 ELSE 0 END AS nhid FROM m JOIN ctl c ON c.sq = m.sq AND c.fr = m.fr + 1))
SELECT sq AS sequence_id, fr AS frame_index, st AS control_state, team AS possession_team, status, round(conf, 6) AS possession_conf, carrier AS carrier_id, from_team, to_team FROM m WHERE fr > 0""")
def possession_machine(spark, sf_dir):
    out = poss.possession_machine(control_v1(spark, sf_dir))
    return tidy(out.select(*geo.FRAME, "control_state", "possession_team", "status", "possession_conf", "carrier_id", "from_team", "to_team"))


@query("possession_machine_v1", "E6", f"""
WITH RECURSIVE {CONTROL_SQL},
c AS (SELECT ctl.*, coalesce(team_confidence, 0.0) >= 0.45 AND pt IN ('TEAM_0', 'TEAM_1') AS strong, CASE WHEN s2v IS NOT NULL THEN (s1 + s2v) / 2.0 ELSE s1 END AS both_ FROM ctl LEFT JOIN gated_v g ON g.sequence_id = sq AND g.frame_index = fr AND g.track_id = pid),
m AS (SELECT sq, CAST(0 AS BIGINT) AS fr, NULL::DOUBLE AS ts, '' AS st, 'UNKNOWN' AS team, 'UNKNOWN' AS status, 0.0::DOUBLE AS conf, '' AS show_team, '' AS show_status, 0.0::DOUBLE AS show_conf, NULL::BIGINT AS carrier, NULL::VARCHAR AS carrier_team,
   CAST(0 AS BIGINT) AS free, CAST(0 AS BIGINT) AS show_free, CAST(0 AS BIGINT) AS hid, NULL::BIGINT AS active, NULL::VARCHAR AS ateam, CAST(0 AS BIGINT) AS run, NULL::VARCHAR AS lt, NULL::BIGINT AS lp, NULL::VARCHAR AS rival, CAST(0 AS BIGINT) AS rrun,
   NULL::VARCHAR AS from_team, NULL::VARCHAR AS to_team, NULL::BIGINT AS from_player, NULL::BIGINT AS to_player, NULL::DOUBLE AS tconf FROM (SELECT DISTINCT sq FROM ctl)
 UNION ALL
 SELECT sq, fr, ts, st, CASE WHEN k = 'weak' THEN team ELSE nteam END, CASE WHEN k = 'weak' THEN status ELSE nstatus END, nconf, nteam, nstatus, nshow, ncar, nct, nfree, CASE WHEN k = 'CONTESTED' THEN 0 ELSE nfree END, nhid,
   CASE WHEN strong_ THEN pid ELSE active END, CASE WHEN strong_ THEN pt ELSE ateam END, nrun, CASE WHEN k IN ('first', 'turn') THEN pt ELSE lt END, CASE WHEN k IN ('first', 'turn', 'same') THEN pid ELSE lp END,
   CASE WHEN k = 'rival' THEN pt WHEN k IN ('weak', 'wait', 'UNKNOWN', 'first') THEN rival END, CASE WHEN k = 'rival' THEN nrr WHEN k IN ('weak', 'wait', 'UNKNOWN', 'first') THEN rrun ELSE 0 END,
   CASE WHEN k = 'turn' THEN lt END, CASE WHEN k = 'turn' THEN pt END, CASE WHEN k = 'turn' THEN lp END, CASE WHEN k = 'turn' THEN pid END, CASE WHEN k = 'turn' THEN s1 * 0.90 END
 FROM (SELECT *,
     CASE k WHEN 'weak' THEN 'UNKNOWN' WHEN 'UNKNOWN' THEN CASE WHEN held THEN lt ELSE 'UNKNOWN' END WHEN 'CONTESTED' THEN 'CONTESTED' WHEN 'FREE_BALL' THEN CASE WHEN held THEN lt ELSE 'NEUTRAL' END WHEN 'wait' THEN team WHEN 'rival' THEN lt ELSE pt END AS nteam,
     CASE k WHEN 'weak' THEN 'UNKNOWN' WHEN 'UNKNOWN' THEN CASE WHEN held THEN 'PROVISIONAL_TRANSIT' ELSE 'UNKNOWN' END WHEN 'CONTESTED' THEN 'CONTESTED' WHEN 'FREE_BALL' THEN CASE WHEN held THEN 'PROVISIONAL_TRANSIT' ELSE 'NEUTRAL' END WHEN 'wait' THEN status WHEN 'rival' THEN 'PROVISIONAL_TRANSIT' ELSE 'SECURE' END AS nstatus,
     CASE k WHEN 'weak' THEN conf WHEN 'UNKNOWN' THEN CASE WHEN held THEN conf ELSE 0.0 END WHEN 'CONTESTED' THEN both_ WHEN 'FREE_BALL' THEN CASE WHEN held THEN conf * greatest(0.3, 1.0 - nfree / 15.0 * 0.6) ELSE 0.0 END WHEN 'wait' THEN conf WHEN 'rival' THEN conf * 0.70 ELSE s1 END AS nconf,
     CASE k WHEN 'weak' THEN 0.30 WHEN 'UNKNOWN' THEN CASE WHEN held THEN conf * greatest(0.2, 1.0 - nhid / 12.0 * 0.7) ELSE 0.0 END WHEN 'CONTESTED' THEN both_ WHEN 'FREE_BALL' THEN CASE WHEN held THEN conf * greatest(0.3, 1.0 - nfree / 15.0 * 0.6) ELSE 0.0 END WHEN 'wait' THEN conf WHEN 'rival' THEN conf * 0.70 ELSE s1 END AS nshow,
     CASE WHEN k IN ('weak', 'CONTESTED') THEN pid WHEN strong_ AND nrun >= 3 THEN pid END AS ncar, CASE WHEN k = 'weak' THEN 'UNKNOWN' WHEN k = 'CONTESTED' THEN 'CONTESTED' WHEN k = 'UNKNOWN' AND held THEN lt WHEN strong_ AND nrun >= 3 THEN pt END AS nct
   FROM (SELECT *, CASE WHEN st <> 'CONTROLLED' THEN st WHEN NOT strong THEN 'weak' WHEN lt IS NULL THEN CASE WHEN nrun >= 3 THEN 'first' ELSE 'wait' END WHEN pt = lt THEN 'same' WHEN nrr >= 5 AND nrun >= 3 THEN 'turn' ELSE 'rival' END AS k,
       lt IS NOT NULL AND CASE WHEN st = 'UNKNOWN' THEN nhid <= 12 ELSE nfree <= 15 END AS held, st = 'CONTROLLED' AND strong AS strong_
     FROM (SELECT c.sq, c.fr, c.ts, c.st, c.pid, c.pt, c.s1, c.both_, c.strong, m.team, m.status, m.conf, m.active, m.ateam, m.lt, m.lp, m.rival, m.rrun,
         CASE WHEN c.st = 'UNKNOWN' THEN m.hid + 1 ELSE 0 END AS nhid, CASE c.st WHEN 'FREE_BALL' THEN m.free + 1 WHEN 'CONTROLLED' THEN 0 ELSE m.free END AS nfree, CASE WHEN m.rival = c.pt THEN m.rrun + 1 ELSE 1 END AS nrr,
         CASE WHEN c.st <> 'CONTROLLED' OR NOT c.strong THEN m.run WHEN c.pid = m.active THEN m.run + 1 WHEN c.pt = m.ateam THEN least(m.run + 1, 3) ELSE 1 END AS nrun
       FROM m JOIN c ON c.sq = m.sq AND c.fr = m.fr + 1))))
SELECT sq AS sequence_id, fr AS frame_index, ts AS timestamp_s, st AS control_state, show_team AS possession_team, show_status AS status, round(show_conf, 6) AS possession_conf, carrier AS carrier_id, carrier_team, show_free AS free_age, hid AS hidden_age, from_team, to_team, from_player, to_player, round(tconf, 6) AS turnover_conf FROM m WHERE fr > 0""")
def possession_machine_v1(spark, sf_dir):
    return tidy(poss.possession_machine_v1(control_v1(spark, sf_dir)))


@query("possession_v2", "E4 E5 P29")
def possession_v2(spark, sf_dir):
    return full_possession(spark, sf_dir)


@query("probable_defender", "E10", """
SELECT sequence_id, frame_index, CASE WHEN possession_conf >= 0.65 AND possession_team = 'TEAM_0' THEN 'TEAM_1' WHEN possession_conf >= 0.65 AND possession_team = 'TEAM_1' THEN 'TEAM_0' ELSE 'UNKNOWN' END AS defending_team FROM held_v""")
def probable_defender(spark, sf_dir):
    from touchline.operators.block import probable_defender as defender

    return defender(quick(spark, sf_dir)).select(*geo.FRAME, "defending_team")


@query("turnovers", "E5 P16", """
SELECT sequence_id, loss_frame, round(loss_ts, 6) AS loss_ts, losing_team, gaining_team, change_conf, 'HIGH' AS tier FROM turnovers_v""")
def turnover_list(spark, sf_dir):
    return tidy(turnovers(spark, sf_dir)).withColumn("tier", transitions.confidence_tier(F.col("change_conf")))


@query("pass_events", "E7 P35")
def pass_events(spark, sf_dir):
    return passes.detect_passes(full_possession(spark, sf_dir), boxed_players(spark, sf_dir), views.ball_pixels(views.ball(spark, sf_dir)), directions(players(spark, sf_dir)))


@query("pass_confidence", "P35", """
SELECT event_id, round(0.25 * (0.85 + CASE event_type WHEN 'click' THEN 0.85 WHEN 'view' THEN 0.75 ELSE 0.70 END + CASE WHEN event_id % 5 >= 3 THEN 0.85 ELSE 0.50 END * CASE WHEN event_id % 11 = 0 THEN 0.85 ELSE 1.0 END
  + CASE WHEN event_id % 13 = 0 THEN 0.40 ELSE 0.90 END), 6) AS event_conf FROM events""")
def pass_confidence(spark, sf_dir):
    e, kind = F.col("event_id"), F.col("event_type")
    reception = F.when(kind == "click", 0.85).when(kind == "view", 0.75).otherwise(0.70)
    conf = passes.confidence_column(F.lit(0.85), reception, e % 5, e % 11 == 0, e % 13 != 0)
    return views.table(spark, sf_dir, "events").select("event_id", rounded(conf).alias("event_conf"))


@query("flight_rollup", "E8", """
WITH tr AS (SELECT sequence_id AS sq, loss_frame AS transfer_id, loss_frame AS f0, least(loss_frame + 10, last_frame) AS f1 FROM turnovers_v JOIN ends_v USING (sequence_id)),
p AS (SELECT sq, transfer_id, frame_index, timestamp_s, ball_x, ball_y, (ball_x + 52.5) / 105.0 * 1920.0 AS u, (ball_y + 34.0) / 68.0 * 1080.0 AS v FROM tr JOIN ball_v ON sequence_id = sq AND frame_index BETWEEN f0 AND f1 WHERE ball_valid),
l AS (SELECT *, sqrt(pow(u - lag(u) OVER w, 2) + pow(v - lag(v) OVER w, 2)) AS dpx, sqrt(pow(ball_x - lag(ball_x) OVER w, 2) + pow(ball_y - lag(ball_y) OVER w, 2)) AS dm FROM p WINDOW w AS (PARTITION BY sq, transfer_id ORDER BY frame_index)),
a AS (SELECT sq, transfer_id, count(*) AS points, coalesce(sum(dpx), 0.0) AS path, sum(dm) AS gm, greatest(1e-3, max(timestamp_s) - min(timestamp_s)) AS dt, coalesce(max(dm) / 0.04 > 25.0, false) AS aerial,
  sqrt(pow(arg_max(ball_x, frame_index) - arg_min(ball_x, frame_index), 2) + pow(arg_max(ball_y, frame_index) - arg_min(ball_y, frame_index), 2)) AS net FROM l GROUP BY 1, 2)
SELECT sq AS sequence_id, transfer_id, points, round(path, 5) AS image_path_px, round(path / dt, 4) AS mean_px_s, CASE WHEN points >= 2 AND NOT aerial THEN round(gm, 5) END AS ground_path_m,
 CASE WHEN points >= 2 AND NOT aerial THEN round(net, 5) END AS net_m, CASE WHEN points >= 2 AND NOT aerial THEN round(gm / dt, 4) END AS mean_ms FROM a""")
def flight_rollup(spark, sf_dir):
    flights = (turnovers(spark, sf_dir).join(ends(spark, sf_dir), "sequence_id")
               .select("sequence_id", F.col("loss_frame").alias("transfer_id"), F.col("loss_frame").alias("start_frame"),
                       F.least(F.col("loss_frame") + 10, F.col("last_frame")).alias("end_frame")))
    out = passes.flight_rollup(flights, views.ball_pixels(views.ball(spark, sf_dir)))
    return out.select("sequence_id", "transfer_id", "points", *[rounded(F.col(c), p).alias(c) for c, p in (
        ("image_path_px", 5), ("mean_px_s", 4), ("ground_path_m", 5), ("net_m", 5), ("mean_ms", 4))])


@query("transition_events", "E12 P34 P17", """
SELECT sequence_id, loss_frame, losing_team, gaining_team, round(pp, 6) AS pressure_pre, round(pa, 6) AS pressure_post, round(dpre, 5) AS nearest_pre, round(dpost, 5) AS nearest_post, round(cs, 5) AS closing_post, round(r3, 6) AS r3_post, round(r5, 6) AS r5_post,
 round(cd, 5) AS centroid_delta, round(lv, 5) AS line_velocity, round(prog, 5) AS ball_progress, round(cp, 6) AS counterpress_score, round(rec, 6) AS recovery_score, candidate_label, response FROM transitions_v""".replace("transitions_v", "transitions_v"))
def transition_events(spark, sf_dir):
    t = transition_table(spark, sf_dir)
    five = ("nearest_pre", "nearest_post", "closing_post", "centroid_delta", "line_velocity", "ball_progress")
    six = ("pressure_pre", "pressure_post", "r3_post", "r5_post", "counterpress_score", "recovery_score")
    return t.select("sequence_id", "loss_frame", "losing_team", "gaining_team", "candidate_label", "response",
                    *[rounded(F.col(c), 5).alias(c) for c in five], *[rounded(F.col(c)).alias(c) for c in six])


@query("post_loss_phases", "E13", """
WITH s AS (SELECT sequence_id, loss_frame + i AS frame_index, losing_team, loss_frame FROM turnovers_v, range(25) t(i))
SELECT sequence_id, frame_index, CASE WHEN arg_max(losing_team, loss_frame) = 'TEAM_0' THEN 'ATTACK_TO_DEFENSE' ELSE 'DEFENSE_TO_ATTACK' END AS team_0_phase, CASE WHEN arg_max(losing_team, loss_frame) = 'TEAM_1' THEN 'ATTACK_TO_DEFENSE' ELSE 'DEFENSE_TO_ATTACK' END AS team_1_phase FROM s GROUP BY 1, 2""")
def post_loss_phases(spark, sf_dir):
    return transitions.post_loss_phases(turnovers(spark, sf_dir))


@query("pressure_episodes", "E14 E16 E18", """
SELECT sequence_id, event_id, start_frame, end_frame, round(start_ts, 6) AS start_ts, round(end_ts, 6) AS end_ts, defending_team AS subject_team, opponent_team, round(confidence, 6) AS confidence, quality FROM press_episodes_v""")
def pressure_episode_list(spark, sf_dir):
    return tidy(press_episodes(spark, sf_dir).select("sequence_id", "event_id", "start_frame", "end_frame", "start_ts", "end_ts", "subject_team", "opponent_team", "confidence", "quality"))


@query("contradiction_audit", "E18", """
WITH t AS (SELECT e.*, CASE WHEN h.possession_team = 'TEAM_0' THEN 'TEAM_0' WHEN h.possession_team = 'TEAM_1' THEN 'TEAM_1' ELSE 'UNKNOWN' END AS holder FROM evidence_v e LEFT JOIN held_v h ON h.sequence_id = e.sequence_id AND h.frame_index = e.end_frame),
c AS (SELECT *, coalesce(family IN ('POST_LOSS_ENGAGEMENT', 'PRESSURE_EPISODE') AND holder <> 'UNKNOWN' AND opponent_team <> 'UNKNOWN' AND holder <> opponent_team, false) AS conflict FROM t)
SELECT sequence_id, event_id, conflict, round(CASE WHEN conflict THEN confidence * 0.6 ELSE confidence END, 6) AS confidence, CASE WHEN conflict AND quality = 'HIGH' THEN 'MEDIUM' ELSE quality END AS quality FROM c""")
def contradiction_audit(spark, sf_dir):
    holder = quick(spark, sf_dir).select("sequence_id", F.col("frame_index").alias("end_frame"),
                                         F.when(F.col("possession_team").isin("TEAM_0", "TEAM_1"), F.col("possession_team")).otherwise("UNKNOWN").alias("holder"))
    joined = evidence(spark, sf_dir).join(holder, ["sequence_id", "end_frame"], "left").withColumn("holder", F.coalesce("holder", F.lit("UNKNOWN")))
    return tidy(fusion.audit(joined, "holder", "opponent_team").select("sequence_id", "event_id", "conflict", "confidence", "quality"))


@query("block_episodes", "E15 E16", """
WITH RECURSIVE r AS (SELECT sequence_id AS sq, team_label AS tm, frame_index AS fr, timestamp_s AS ts, category AS c, h, row_number() OVER (PARTITION BY sequence_id, team_label ORDER BY frame_index) AS i FROM block_v),
st AS (SELECT sq, tm, CAST(0 AS BIGINT) AS i, NULL::BIGINT AS s0, NULL::VARCHAR AS held, NULL::DOUBLE AS h, NULL::DOUBLE AS ts, CAST(0 AS BIGINT) AS fr, NULL::BIGINT AS shut FROM (SELECT DISTINCT sq, tm FROM r)
 UNION ALL SELECT sq, tm, i, CASE WHEN lost THEN NULL WHEN s0 IS NULL OR leaves THEN fr ELSE s0 END, CASE WHEN lost THEN NULL WHEN s0 IS NULL OR leaves THEN c ELSE held END, h, ts, fr, CASE WHEN s0 IS NOT NULL AND (lost OR leaves) THEN s0 END
 FROM (SELECT st.sq, st.tm, r.i, r.fr, r.ts, r.c, r.h, st.s0, st.held, (r.h IS NULL OR r.c = 'UNKNOWN') AS lost, coalesce(st.s0 IS NOT NULL AND st.held <> r.c AND ((st.held = 'LOW_BLOCK' AND r.h > 37.0) OR (st.held = 'MID_BLOCK' AND (r.h < 33.0 OR r.h > 54.5)) OR (st.held = 'HIGH_BLOCK' AND r.h < 50.5)), false) AS leaves
       FROM st JOIN r ON r.sq = st.sq AND r.tm = st.tm AND r.i = st.i + 1)),
ep AS (SELECT sq, tm, s0, any_value(held) AS held, avg(h) AS mh FROM st WHERE s0 IS NOT NULL GROUP BY 1, 2, 3),
cl AS (SELECT sq, tm, shut, max(fr) AS cf, max(ts) AS ct FROM st WHERE shut IS NOT NULL GROUP BY 1, 2, 3)
SELECT * FROM (SELECT ep.sq AS sequence_id, tm AS subject_team, s0 AS start_frame, coalesce(cf - 1, last_frame) AS end_frame, round(coalesce(ct, last_ts), 6) AS end_ts, held AS block_category, round(mh, 4) AS mean_height_m
FROM ep LEFT JOIN (SELECT sq AS csq, tm AS ctm, shut, cf, ct FROM cl) ON csq = ep.sq AND ctm = tm AND shut = s0 JOIN ends_v e ON e.sequence_id = ep.sq) WHERE end_frame - start_frame + 1 >= 12""")
def block_episode_list(spark, sf_dir):
    eps = fusion.block_episode_rows(block_table(spark, sf_dir).withColumn("players", F.col("outfield_count")), ends(spark, sf_dir))
    return tidy(eps.select("sequence_id", F.col("team_label").alias("subject_team"), "start_frame", "end_frame", "end_ts", F.col("held").alias("block_category"),
                           F.round("height", 4).alias("mean_height_m")))


@query("evidence_timeline", "E17 O6 O9", """
SELECT sequence_id, event_id, start_frame, end_frame, family, level, subject_team, opponent_team, round(confidence, 6) AS confidence, quality, row_number() OVER (PARTITION BY sequence_id ORDER BY start_frame, end_frame, level, event_id) AS position,
 row_number() OVER (PARTITION BY sequence_id ORDER BY start_ts, end_ts, start_frame, event_id) AS store_position FROM evidence_v""")
def evidence_timeline(spark, sf_dir):
    placed = fusion.positions(evidence(spark, sf_dir))
    both = fusion.positions(placed.withColumnRenamed("position", "p1"), by_time=True).withColumnRenamed("position", "store_position").withColumnRenamed("p1", "position")
    return tidy(both.select("sequence_id", "event_id", "start_frame", "end_frame", "family", "level", "subject_team", "opponent_team", "confidence", "quality", "position", "store_position"))


@query("full_event_table", "E17 E14 E15 E7 E12")
def full_event_table(spark, sf_dir):
    return fusion.summaries(full_evidence(spark, sf_dir)).select("sequence_id", "event_id", "start_frame", "end_frame", "family", "subject_team", "confidence", "quality", "summary_text")


@query("evidence_links", "J11 J12 G1", "SELECT sequence_id, source_id, target_id, relation, 1.0::DOUBLE AS weight FROM links_v")
def evidence_links(spark, sf_dir):
    return fusion.links(evidence(spark, sf_dir))


@query("event_summaries", "P18 P19", """
SELECT e.sequence_id, e.event_id, summary_text, printf('[event:%s | t=%.2f–%.2fs | conf=%.2f | %s]', e.event_id, start_ts, end_ts, confidence, quality) AS citation
FROM evidence_v e JOIN summaries_v s ON s.sequence_id = e.sequence_id AND s.event_id = e.event_id""")
def event_summaries(spark, sf_dir):
    return fusion.summaries(evidence(spark, sf_dir)).select("sequence_id", "event_id", "summary_text",
                                                            fusion.citation(*[F.col(c) for c in ("event_id", "start_ts", "end_ts", "confidence", "quality")]).alias("citation"))


@query("quality_and_confidence", "P14 P15", """
WITH e AS (SELECT event_id, (event_id * 7) % 12 AS vis, event_id % 5 <> 0 AS cal, event_id % 9 = 0 AS con, event_id % 6 <> 0 AS sta, (event_id % 100) / 100.0::DOUBLE AS car, (event_id * 3 % 100) / 100.0::DOUBLE AS base, (event_id * 11 % 100) / 100.0::DOUBLE AS up FROM events)
SELECT event_id, CASE WHEN NOT cal OR vis < 4 THEN 'INVALID' WHEN vis < 6 OR con OR car < 0.35 THEN 'LOW' WHEN vis IN (6, 7) OR NOT sta OR car < 0.60 THEN 'MEDIUM' ELSE 'HIGH' END AS quality,
 round(least(0.85, up, base * CASE WHEN cal THEN 1.0 ELSE 0.4 END * CASE WHEN vis >= 8 THEN 1.0 WHEN vis >= 6 THEN 0.85 WHEN vis >= 4 THEN 0.65 ELSE 0.3 END * CASE WHEN con THEN 0.6 ELSE 1.0 END * CASE WHEN sta THEN 1.0 ELSE 0.8 END), 6) AS confidence FROM e""")
def quality_and_confidence(spark, sf_dir):
    e = F.col("event_id")
    vis, cal, con, sta = e * 7 % 12, e % 5 != 0, e % 9 == 0, e % 6 != 0
    car, base, up = e % 100 / F.lit(100.0), e * 3 % 100 / F.lit(100.0), e * 11 % 100 / F.lit(100.0)
    return views.table(spark, sf_dir, "events").select(
        "event_id", fusion.quality(F.when(cal, "VALID").otherwise("INVALID"), vis, con, sta, car).alias("quality"),
        rounded(fusion.propagate(base, up, fusion.LEVEL_3, cal, vis, con, sta)).alias("confidence"))


STRUCT_SQL = """
st AS (SELECT t.sequence_id, t.frame_index, t.team_label, t.n, t.direction, t.fx - t.bx AS depth, t.w, l.s AS structure, l.k AS line_count FROM teams_v t LEFT JOIN (SELECT sequence_id AS sq, frame_index AS fr, team_label AS tm, list(players ORDER BY line_id) AS s, count(*) AS k FROM lines_v GROUP BY 1, 2, 3) l ON sq = sequence_id AND fr = frame_index AND tm = team_label),
pr AS (SELECT * FROM (VALUES (0, '4-4-2', [4, 4, 2]), (1, '4-3-3', [4, 3, 3]), (2, '4-2-3-1', [4, 2, 3, 1]), (3, '4-1-4-1', [4, 1, 4, 1]), (4, '3-5-2', [3, 5, 2]), (5, '3-4-3', [3, 4, 3]), (6, '5-3-2', [5, 3, 2]), (7, '5-4-1', [5, 4, 1])) AS p(rk, name, p)),
ds AS (SELECT DISTINCT structure FROM st WHERE structure IS NOT NULL),
dp AS (SELECT structure, name, rk, p, 0 AS i, 0 AS j, CAST(0 AS DOUBLE) AS c, [CAST(0 AS DOUBLE)] AS cells FROM ds, pr
 UNION ALL SELECT structure, name, rk, p, ni, nj, 0, list_append(cells, CASE WHEN ni = 0 THEN cells[nj] + p[nj] WHEN nj = 0 THEN cells[(ni - 1) * w + 1] + structure[ni]
    ELSE least(cells[(ni - 1) * w + nj] + abs(structure[ni] - p[nj]), cells[(ni - 1) * w + nj + 1] + structure[ni], cells[ni * w + nj] + p[nj]) END)
  FROM (SELECT *, len(p) + 1 AS w, CASE WHEN j = len(p) THEN i + 1 ELSE i END AS ni, CASE WHEN j = len(p) THEN 0 ELSE j + 1 END AS nj FROM dp) WHERE ni <= len(structure)),
dist AS (SELECT structure, name, rk, cells[len(cells)] + 1.5 * abs(structure[1] - p[1]) + abs(len(structure) - len(p)) AS d FROM dp WHERE i = len(structure) AND j = len(p)),
rkd AS (SELECT *, row_number() OVER (PARTITION BY structure ORDER BY d, rk) AS rn FROM dist),
best AS (SELECT structure, max(name) FILTER (rn = 1) AS n1, max(d) FILTER (rn = 1) AS d1, max(name) FILTER (rn = 2) AS n2, max(d) FILTER (rn = 2) AS d2 FROM rkd GROUP BY 1),
lab AS (SELECT st.*, n1, d1, CASE WHEN n >= 9 THEN 'FULL_EVIDENCE' WHEN n >= 7 THEN 'PARTIAL_EVIDENCE' ELSE 'LOW_EVIDENCE' END AS evidence,
   CASE WHEN direction = 0 OR n < 7 THEN 'UNKNOWN' WHEN depth < 18.0 AND w < 24.0 THEN 'SET_PIECE_DEFORMATION' WHEN st.structure IS NULL THEN 'UNKNOWN' WHEN n < 9 THEN 'PARTIAL'
    WHEN ((n1, n2) IN (('3-5-2', '5-3-2'), ('5-3-2', '3-5-2'), ('3-4-3', '5-4-1'), ('5-4-1', '3-4-3'))) AND d2 - d1 < 0.35 THEN 'AMBIGUOUS_3_5_STRUCTURE' WHEN d2 - d1 < 0.2 AND d1 > 1.0 THEN 'AMBIGUOUS' WHEN greatest(0.0, 1.0 - d1 / 12.0) >= 0.5 THEN n1 ELSE 'TRANSITIONING' END AS label
  FROM st LEFT JOIN best ON best.structure = st.structure)"""


def shifting_teams(spark, sf_dir):
    """All players, whatever their team confidence; one midfielder of each side joins the attack after frame 75."""
    moved = (F.col("track_id") % 11 == 5) & (F.col("frame_index") > 75)
    way = F.when(F.col("team_label") == "TEAM_0", 22.0).otherwise(-22.0)

    def build(s, d):
        rows = views.tracking(s, d).withColumn("x_m", F.when(moved, F.col("x_m") + way).otherwise(F.col("x_m")))
        gated = geo.gate(rows, min_confidence=0.0)
        return lines.oriented_teams(lines.oriented_players(geo.outfield(gated), directions(gated)))
    return views.shared("shifting", spark, sf_dir, build)


@query("formation_signatures", "P36", f"""
WITH RECURSIVE {STRUCT_SQL}
SELECT sequence_id, frame_index, team_label, evidence, label, CASE WHEN label NOT IN ('UNKNOWN', 'SET_PIECE_DEFORMATION') THEN n1 END AS prototype, CASE WHEN label NOT IN ('UNKNOWN', 'SET_PIECE_DEFORMATION') THEN round(d1, 6) END AS distance FROM lab""")
def formation_signatures(spark, sf_dir):
    return tidy(formation.signatures(oriented(spark, sf_dir)).select(*geo.TEAM, "evidence", "label", "prototype", "distance"))


@query("formation_vote", "W16", f"""
WITH RECURSIVE {STRUCT_SQL},
jd AS (SELECT *, CASE WHEN label NOT IN ('UNKNOWN', 'SET_PIECE_DEFORMATION') THEN n1 END AS proto, greatest(0.0, least(1.0, 1.0 - d1 / 12.0)) AS cf, row_number() OVER (PARTITION BY sequence_id, team_label ORDER BY frame_index) AS i FROM lab),
vt AS (SELECT a.sequence_id, a.team_label, a.frame_index, a.evidence, a.i, b.proto, count(*) AS c, min(b.i) AS fi, avg(b.cf) AS ac FROM jd a LEFT JOIN jd b ON b.sequence_id = a.sequence_id AND b.team_label = a.team_label AND b.i BETWEEN a.i - 49 AND a.i AND b.proto IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6),
rk2 AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, team_label, frame_index ORDER BY CASE WHEN proto IS NULL THEN 0 ELSE c END DESC, fi) AS rn, sum(CASE WHEN proto IS NULL THEN 0 ELSE c END) OVER (PARTITION BY sequence_id, team_label, frame_index) AS tot FROM vt),
w2 AS (SELECT sequence_id, team_label, frame_index, any_value(evidence) AS evidence, any_value(i) AS i, max(tot) AS tot, max(proto) FILTER (rn = 1) AS p1, max(c) FILTER (rn = 1) AS c1, max(ac) FILTER (rn = 1) AS a1, max(c) FILTER (rn = 2) AS c2 FROM rk2 GROUP BY 1, 2, 3),
sx AS (SELECT *, CASE WHEN tot < greatest(5, least(i, 50) // 3) THEN CASE WHEN evidence = 'LOW_EVIDENCE' THEN 'UNKNOWN' ELSE 'PARTIAL' END WHEN c1 / tot >= 0.65 AND a1 >= 0.45 THEN 'STABLE' WHEN c2 IS NOT NULL AND (c1 - c2) / tot < 0.20 THEN 'AMBIGUOUS' ELSE 'TRANSITIONING' END AS state FROM w2)
SELECT sequence_id, team_label, frame_index, state, CASE WHEN state = 'STABLE' THEN p1 ELSE state END AS stable_label, round(CASE WHEN state IN ('UNKNOWN', 'PARTIAL') THEN 0.0 ELSE a1 END, 6) AS state_conf FROM sx""")
def formation_vote(spark, sf_dir):
    return tidy(formation.stable_formation(formation.signatures(oriented(spark, sf_dir))).select(*geo.TEAM, "state", "stable_label", "state_conf"))


@query("formation_changes", "W17")
def formation_changes(spark, sf_dir):
    return formation.formation_changes(formation.stable_formation(formation.signatures(shifting_teams(spark, sf_dir))))


@query("top_line_structures", "A14", """
WITH s AS (SELECT sequence_id, team_label, frame_index, string_agg(players, '-' ORDER BY line_id) AS structure FROM lines_v GROUP BY 1, 2, 3),
c AS (SELECT sequence_id, team_label, structure, count(*) AS frequency, min(frame_index) AS f0 FROM s GROUP BY 1, 2, 3),
r AS (SELECT *, sum(frequency) OVER (PARTITION BY sequence_id, team_label) AS tot, row_number() OVER (PARTITION BY sequence_id, team_label ORDER BY frequency DESC, f0, structure) AS rank FROM c)
SELECT sequence_id, team_label, CAST(rank AS INTEGER) AS rank, structure, frequency, round(100.0 * frequency / tot, 1) AS pct FROM r WHERE rank <= 3""")
def top_line_structures(spark, sf_dir):
    return tidy(fusion.top_structures(formation.signatures(oriented(spark, sf_dir))))


@query("formation_consensus", "A15")
def formation_consensus(spark, sf_dir):
    return fusion.formation_consensus(formation.stable_formation(formation.signatures(shifting_teams(spark, sf_dir))))


@query("team_rollup", "A12", """
SELECT sequence_id, team_label, CAST(grouping(sequence_id, team_label) AS BIGINT) AS level, count(*) AS frames, count(DISTINCT sequence_id) AS sequences, round(avg(h) + 1e-9, 4) AS line_height_m, round(min(h), 6) AS lowest_m, round(max(h), 6) AS highest_m,
 count(*) FILTER (category = 'LOW_BLOCK') AS low_frames, count(*) FILTER (category = 'HIGH_BLOCK') AS high_frames FROM block_v GROUP BY ROLLUP (sequence_id, team_label)""")
def team_rollup(spark, sf_dir):
    """Block measures per sequence and team, per sequence and over all, in one pass."""
    rows = block_table(spark, sf_dir)
    return fusion.block_rollup(rows)


@query("team_aggregates", "A12 A13", "SELECT * FROM team_aggregates_v")
def team_aggregates(spark, sf_dir):
    held = quick(spark, sf_dir)
    rows = block_table(spark, sf_dir).withColumn("players", F.col("outfield_count")).join(held.select(*geo.FRAME), geo.FRAME, "left_semi")
    out = fusion.team_aggregates(rows, held, frame_pressure(spark, sf_dir), evidence(spark, sf_dir))
    return tidy(out)
