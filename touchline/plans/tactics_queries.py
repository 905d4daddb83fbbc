"""Direction, lines and defensive block queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import block, geometry as geo, lines, smoothing
from touchline.plans import views
from touchline.plans.registry import query, rounded
from touchline.plans.stats_queries import tidy


def players(spark, sf_dir):
    """Gated players with their velocity: the table every later step starts from."""
    return views.shared("players", spark, sf_dir, lambda s, d: geo.gate(smoothing.velocity(views.tracking(s, d))))


def directions(gated):
    return lines.attack_direction(gated)


def _oriented(spark, sf_dir):
    gated = players(spark, sf_dir)
    return lines.oriented_teams(lines.oriented_players(geo.outfield(gated), directions(gated)))


def oriented(spark, sf_dir):
    return views.shared("oriented", spark, sf_dir, _oriented)


def _block_table(spark, sf_dir):
    return block.categorise(block.block_metrics(oriented(spark, sf_dir), views.ball(spark, sf_dir)))


def block_table(spark, sf_dir):
    return views.shared("blocks", spark, sf_dir, _block_table)


EVIDENCE_SQL = """
flip AS (SELECT sequence_id, frame_index, team_label, role, track_id, CASE WHEN frame_index > 75 AND substr(sequence_id, 7, 1) IN ('1', '3', '5', '7', '9') THEN -x_m ELSE x_m END AS x FROM gated_v),
cent AS (SELECT sequence_id AS sq, frame_index AS fr, team_label AS tm, avg(x) AS cx, max(x) FILTER (role = 'GOALKEEPER') AS gk FROM flip GROUP BY 1, 2, 3),
hist AS (SELECT *, row_number() OVER w AS n, quantile_cont(cx, 0.5) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m FROM cent WINDOW w AS (PARTITION BY sq, tm ORDER BY fr)),
wide AS (SELECT sq, fr, max(n) FILTER (tm = 'TEAM_0') AS n0, max(m) FILTER (tm = 'TEAM_0') AS m0, max(gk) FILTER (tm = 'TEAM_0') AS g0,
   max(n) FILTER (tm = 'TEAM_1') AS n1, max(m) FILTER (tm = 'TEAM_1') AS m1, max(gk) FILTER (tm = 'TEAM_1') AS g1 FROM hist GROUP BY 1, 2),
carry AS (SELECT *, last_value(n0 IGNORE NULLS) OVER w AS h0, last_value(n1 IGNORE NULLS) OVER w AS h1, last_value(m0 IGNORE NULLS) OVER w - last_value(m1 IGNORE NULLS) OVER w AS gap
   FROM wide WINDOW w AS (PARTITION BY sq ORDER BY fr)),
ev AS (SELECT sq, fr,
   CASE WHEN g0 < -30.5 THEN 1 WHEN g0 > 30.5 THEN -1 WHEN n0 IS NOT NULL AND h0 >= 30 AND h1 >= 30 AND abs(gap) >= 4.0 THEN CASE WHEN gap < 0 THEN 1 ELSE -1 END END AS e0,
   CASE WHEN abs(g0) > 30.5 THEN 0.95::DOUBLE ELSE 0.70::DOUBLE END AS ec0, CASE WHEN abs(g0) > 30.5 THEN 'GOALKEEPER_ANCHOR' ELSE 'TEAM_SPATIAL_ORDERING' END AS es0,
   CASE WHEN g1 < -30.5 THEN 1 WHEN g1 > 30.5 THEN -1 WHEN n1 IS NOT NULL AND h0 >= 30 AND h1 >= 30 AND abs(gap) >= 4.0 THEN CASE WHEN gap > 0 THEN 1 ELSE -1 END END AS e1,
   CASE WHEN abs(g1) > 30.5 THEN 0.95::DOUBLE ELSE 0.70::DOUBLE END AS ec1, CASE WHEN abs(g1) > 30.5 THEN 'GOALKEEPER_ANCHOR' ELSE 'TEAM_SPATIAL_ORDERING' END AS es1
   FROM carry)"""


def _own(i: int) -> str:
    clash = f"(d{i} <> 0 AND e{i} <> d{i})"
    turn = f"({clash} AND k{i} + 1 >= 15)"
    return f"""CASE WHEN e{i} IS NULL THEN d{i} WHEN {turn} OR NOT {clash} THEN e{i} ELSE d{i} END AS d{i},
   CASE WHEN e{i} IS NULL THEN c{i} WHEN {turn} THEN ec{i} WHEN {clash} THEN c{i} ELSE greatest(c{i}, ec{i}) END AS c{i},
   CASE WHEN e{i} IS NULL THEN s{i} WHEN {turn} OR NOT {clash} THEN es{i} ELSE s{i} END AS s{i},
   CASE WHEN e{i} IS NULL THEN k{i} WHEN {turn} OR NOT {clash} THEN 0 ELSE k{i} + 1 END AS k{i},
   CASE WHEN {turn} THEN w{i} + 1 ELSE w{i} END AS w{i}"""


def _complement(i: int) -> str:
    j = 1 - i
    take = f"d{i} = 0 AND d{j} <> 0"
    return f"""CASE WHEN {take} THEN -d{j} ELSE d{i} END AS d{i}, CASE WHEN {take} THEN c{j} * 0.90::DOUBLE ELSE c{i} END AS c{i},
   CASE WHEN {take} THEN 'COMPLEMENTARY_INFERENCE' ELSE s{i} END AS s{i}, k{i}, w{i}"""


@query("attack_direction", "E3", f"""
WITH RECURSIVE {EVIDENCE_SQL},
st AS (SELECT sq, CAST(0 AS BIGINT) AS fr, 0 AS d0, 0.0::DOUBLE AS c0, 'UNKNOWN' AS s0, 0 AS k0, 0 AS w0, 0 AS d1, 0.0::DOUBLE AS c1, 'UNKNOWN' AS s1, 0 AS k1, 0 AS w1 FROM (SELECT DISTINCT sq FROM ev)
 UNION ALL
 SELECT sq, fr, {_complement(0)}, {_complement(1)} FROM (
   SELECT st.sq, ev.fr, {_own(0)}, {_own(1)} FROM st JOIN ev ON ev.sq = st.sq AND ev.fr = st.fr + 1))
SELECT sq AS sequence_id, fr AS frame_index, 'TEAM_0' AS team_label, d0 AS direction, round(c0, 6) AS direction_conf, s0 AS direction_source, CAST(w0 AS BIGINT) AS switches FROM st WHERE fr > 0
UNION ALL SELECT sq, fr, 'TEAM_1', d1, round(c1, 6), s1, CAST(w1 AS BIGINT) FROM st WHERE fr > 0""")
def attack_direction(spark, sf_dir):
    odd = F.substring("sequence_id", 7, 1).isin("1", "3", "5", "7", "9")
    flipped = players(spark, sf_dir).withColumn("x_m", F.when((F.col("frame_index") > 75) & odd, -F.col("x_m")).otherwise(F.col("x_m")))
    return tidy(directions(flipped))


@query("oriented_team_measures", "W10 P11", """
SELECT sequence_id, frame_index, team_label, CAST(direction AS INTEGER) AS direction, n AS outfield_count, visibility,
 CASE WHEN direction <> 0 THEN round(fx, 6) END AS front_x_attack, CASE WHEN direction <> 0 THEN round(bx, 6) END AS back_x_attack,
 CASE WHEN direction <> 0 THEN round(fx - bx, 6) END AS depth_m, CASE WHEN direction <> 0 THEN round(52.5 - fx, 6) END AS to_opponent_goal_m,
 CASE WHEN direction <> 0 THEN round(bx + 52.5, 6) END AS to_own_goal_m FROM teams_v""")
def oriented_team_measures(spark, sf_dir):
    return tidy(oriented(spark, sf_dir).select(*geo.TEAM, "direction", "outfield_count", "visibility", "front_x_attack", "back_x_attack",
                                               "depth_m", "to_opponent_goal_m", "to_own_goal_m"))


@query("tactical_lines", "W8", """
SELECT sequence_id, frame_index, team_label, line_id, CASE WHEN line_id = 0 THEN 'DEFENSIVE_LINE' WHEN from_front = 1 THEN 'ATTACKING_LINE'
   WHEN total = 4 AND line_id = 1 THEN 'MIDFIELD_DEFENSIVE' WHEN total = 4 AND line_id = 2 THEN 'MIDFIELD_OFFENSIVE' ELSE 'MIDFIELD_LINE' END AS name,
  players, round(mean_x_attack, 6) AS mean_x_attack, round(median_x_attack, 6) AS median_x_attack, round(width_m, 6) AS width_m, round(mean_x, 6) AS mean_x,
  round(mean_y, 6) AS mean_y, round(confidence, 6) AS confidence FROM lines_v""")
def tactical_lines(spark, sf_dir):
    return tidy(lines.team_lines(oriented(spark, sf_dir)).drop("track_ids"))


@query("inter_line_distances", "W9", """
WITH g AS (SELECT *, mean_x_attack - lag(mean_x_attack) OVER w AS gap, median_x_attack - lag(median_x_attack) OVER w AS mgap FROM lines_v WINDOW w AS (PARTITION BY sequence_id, frame_index, team_label ORDER BY line_id))
SELECT sequence_id, frame_index, team_label, round(avg(gap), 6) AS mean_gap_m, round(max(mgap), 6) AS max_median_gap_m, round(sum(gap), 6) AS total_span_m FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def inter_line_distances(spark, sf_dir):
    teams = oriented(spark, sf_dir).filter("line_count >= 2")
    means = lines.line_gaps(teams).withColumn("mean_gap_m", geo.mean_of(F.col("gaps"))).drop("gaps")
    both = lines.line_gaps(means.withColumnRenamed("total_span_m", "span"), "median_x_attack")
    return both.select(*geo.TEAM, rounded(F.col("mean_gap_m")).alias("mean_gap_m"), rounded(F.array_max("gaps")).alias("max_median_gap_m"),
                       rounded(F.col("span")).alias("total_span_m"))


@query("line_persistence", "E24")
def line_persistence(spark, sf_dir):
    return lines.line_persistence(oriented(spark, sf_dir))


@query("block_metrics", "A8 A9", """
WITH mad AS (SELECT sequence_id, frame_index, team_label, quantile_cont(abs(xa - mx), 0.5) AS madx, quantile_cont(abs(y_m - my), 0.5) AS mady FROM oriented_v JOIN teams_v USING (sequence_id, frame_index, team_label) GROUP BY 1, 2, 3),
gaps AS (SELECT sequence_id, frame_index, team_label, avg(g) AS mean_gap, max(g) AS max_gap, max(g) FILTER (line_id = 1) AS g0, max(g) FILTER (line_id = 2) AS g1
  FROM (SELECT *, median_x_attack - lag(median_x_attack) OVER (PARTITION BY sequence_id, frame_index, team_label ORDER BY line_id) AS g FROM lines_v) GROUP BY 1, 2, 3)
SELECT sequence_id, frame_index, team_label, round(mx + 52.5, 6) AS centroid_height_m, round(ax + 52.5, 6) AS mean_centroid_height_m,
  CASE WHEN n >= 2 THEN round(sx, 6) END AS longitudinal_spread_m, CASE WHEN n >= 2 THEN round(madx, 6) END AS longitudinal_mad_m, CASE WHEN n >= 2 THEN round(w, 6) END AS width_m,
  CASE WHEN n >= 2 THEN round(sy, 6) END AS lateral_spread_m, CASE WHEN n >= 2 THEN round(mady, 6) END AS lateral_mad_m,
  round(h, 6) AS line_height_m, round(mh, 6) AS mean_line_height_m, line_players, round(mean_gap, 6) AS mean_line_gap_m, round(max_gap, 6) AS max_line_gap_m,
  round(g0, 6) AS defence_midfield_m, round(g1, 6) AS midfield_attack_m, round(abs(lx - ox), 6) AS to_opponent_front_m,
  round(sqrt((lx - ox) * (lx - ox) + (ly - oy) * (ly - oy)), 6) AS to_opponent_front_euclid_m, round(sqrt((lx - ball_x) * (lx - ball_x) + (ly - ball_y) * (ly - ball_y)), 6) AS line_to_ball_m,
  round(abs(lm - direction * ball_x), 6) AS line_to_ball_long_m, round(sqrt((px - ball_x) * (px - ball_x) + (py - ball_y) * (py - ball_y)), 6) AS centroid_to_ball_m
FROM block_v LEFT JOIN mad USING (sequence_id, frame_index, team_label) LEFT JOIN gaps USING (sequence_id, frame_index, team_label) WHERE direction <> 0""")
def block_metrics(spark, sf_dir):
    table = block.block_metrics(oriented(spark, sf_dir), views.ball(spark, sf_dir)).filter("direction <> 0")
    return tidy(table.select(*geo.TEAM, "centroid_height_m", "mean_centroid_height_m", "longitudinal_spread_m", "longitudinal_mad_m", "width_m",
                             "lateral_spread_m", "lateral_mad_m", "line_height_m", "mean_line_height_m", "line_players", "mean_line_gap_m",
                             "max_line_gap_m", "defence_midfield_m", "midfield_attack_m", "to_opponent_front_m", "to_opponent_front_euclid_m",
                             "line_to_ball_m", "line_to_ball_long_m", "centroid_to_ball_m"))


@query("block_category", "P12", """
SELECT sequence_id, frame_index, team_label, category, CASE WHEN direction = 0 THEN 'UNKNOWN_ORIENTATION' WHEN n < 5 THEN 'LOW_VISIBILITY' WHEN h IS NOT NULL THEN 'OK' ELSE 'FALLBACK_CENTROID_HEIGHT' END AS reason,
  round(CASE WHEN category = 'UNKNOWN' THEN 0.0 WHEN h IS NULL THEN CASE visibility WHEN 'HIGH' THEN 0.55 ELSE 0.45 END ELSE
    (CASE category WHEN 'LOW_BLOCK' THEN least(0.95, greatest(0.60, 0.65 + 0.30 * (35.0 - h) / 35.0)) WHEN 'MID_BLOCK' THEN least(0.95, greatest(0.55, 0.60 + 0.35 * (1.0 - abs(h - 43.75) / 8.75)))
      ELSE least(0.95, greatest(0.60, 0.65 + 0.30 * (h - 52.5) / 52.5)) END) * CASE visibility WHEN 'MEDIUM' THEN 0.8 ELSE 1.0 END END, 6) AS category_conf FROM block_v""")
def block_category(spark, sf_dir):
    return tidy(block_table(spark, sf_dir).select(*geo.TEAM, "category", "reason", "category_conf"))


@query("block_hysteresis", "E9", """
WITH RECURSIVE r AS (SELECT sequence_id AS sq, team_label AS tm, frame_index AS fr, category AS c, row_number() OVER (PARTITION BY sequence_id, team_label ORDER BY frame_index) AS i FROM block_v),
st AS (SELECT sq, tm, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS fr, 'UNKNOWN' AS confirmed, 'UNKNOWN' AS before, '' AS c, 0 AS run FROM (SELECT DISTINCT sq, tm FROM r)
 UNION ALL
 SELECT sq, tm, i, fr, CASE WHEN nc = 'UNKNOWN' THEN 'UNKNOWN' WHEN confirmed = 'UNKNOWN' THEN CASE WHEN nrun >= 3 THEN nc ELSE 'UNKNOWN' END WHEN nrun >= 10 THEN nc ELSE confirmed END, confirmed, nc, nrun
 FROM (SELECT st.sq, st.tm, r.i, r.fr, st.confirmed, r.c AS nc, CASE WHEN r.c = st.c THEN st.run + 1 ELSE 1 END AS nrun FROM st JOIN r ON r.sq = st.sq AND r.tm = st.tm AND r.i = st.i + 1))
SELECT sq AS sequence_id, fr AS frame_index, tm AS team_label, c AS category, confirmed, confirmed <> before AS changed FROM st WHERE i > 0""")
def block_hysteresis(spark, sf_dir):
    return block.hysteresis(block_table(spark, sf_dir).select(*geo.TEAM, "category")).select(*geo.TEAM, "category", "confirmed", "changed")
