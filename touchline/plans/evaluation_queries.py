"""Evaluation, data-quality, tracking and team-split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import frames
from touchline.operators import evaluation as evl, formation, geometry as geo, quality as dq, teams as tm, tracking as trk
from touchline.plans import views
from touchline.plans.events_queries import full_possession, turnovers
from touchline.plans.motion_queries import frame_pressure
from touchline.plans.registry import query, rounded
from touchline.plans.stats_queries import tidy
from touchline.plans.tactics_queries import block_table, oriented, players
from touchline.session import cut_lineage

PAIRS_SQL = """
pr AS (SELECT t.sequence_id, t.frame_index, t.track_id, p.pred_track_id, p.pred_team, t.team_label, p.event_id AS pe, p.conf, i / u AS iou FROM boxes_v t JOIN pred_boxes_v p ON t.sequence_id = p.sequence_id AND t.frame_index = p.frame_index,
  LATERAL (SELECT greatest(0.0, least(x2, px2) - greatest(x1, px1)) * greatest(0.0, least(y2, py2) - greatest(y1, py1)) AS i) a, LATERAL (SELECT (x2 - x1) * (y2 - y1) + (px2 - px1) * (py2 - py1) - i AS u) b WHERE u > 0 AND i / u >= 0.5)"""

# one-to-one matches: pairs without a rival stand, the others of a frame are tried in all ways
MATCH_SQL = PAIRS_SQL + """,
gp AS (SELECT sequence_id, frame_index, track_id, pred_track_id, max(iou) AS iou, arg_max(pred_team, iou) AS pred_team, any_value(team_label) AS team_label FROM pr GROUP BY 1, 2, 3, 4),
rv AS (SELECT *, count(*) OVER (PARTITION BY sequence_id, frame_index, track_id) = 1 AND count(*) OVER (PARTITION BY sequence_id, frame_index, pred_track_id) = 1 AS alone FROM gp),
kn AS (SELECT *, dense_rank() OVER (PARTITION BY sequence_id, frame_index ORDER BY track_id) AS n FROM rv WHERE NOT alone),
op AS (SELECT sequence_id, frame_index, n, track_id, pred_track_id, iou FROM kn UNION ALL SELECT DISTINCT sequence_id, frame_index, n, NULL, NULL, NULL FROM kn),
wk AS (SELECT DISTINCT sequence_id, frame_index, CAST(0 AS BIGINT) AS n, []::BIGINT[] AS ts, []::BIGINT[] AS ps, CAST(0 AS DOUBLE) AS total FROM kn
  UNION ALL SELECT w.sequence_id, w.frame_index, w.n + 1, CASE WHEN o.track_id IS NULL THEN ts ELSE list_append(ts, o.track_id) END, CASE WHEN o.track_id IS NULL THEN ps ELSE list_append(ps, o.pred_track_id) END, total + coalesce(o.iou, 0.0)
  FROM wk w JOIN op o ON o.sequence_id = w.sequence_id AND o.frame_index = w.frame_index AND o.n = w.n + 1 WHERE o.track_id IS NULL OR NOT list_contains(ps, o.pred_track_id)),
bw AS (SELECT sequence_id, frame_index, arg_max(ts, total) AS ts, arg_max(ps, total) AS ps FROM wk GROUP BY 1, 2),
um AS (SELECT sequence_id, frame_index, unnest(ts) AS track_id, unnest(ps) AS pred_track_id FROM bw),
mt AS (SELECT * FROM rv WHERE alone UNION ALL SELECT rv.* FROM rv JOIN um ON um.sequence_id = rv.sequence_id AND um.frame_index = rv.frame_index AND um.track_id = rv.track_id AND um.pred_track_id = rv.pred_track_id)"""


def pairs(spark, sf_dir):
    return evl.overlaps(views.boxes(spark, sf_dir), views.predicted_boxes(spark, sf_dir).drop("event_id"))


def best_pairs(spark, sf_dir):
    """One-to-one matches of truth and predicted boxes, with both teams."""
    return views.shared("matches", spark, sf_dir, lambda s, d: evl.frame_matches(pairs(s, d), ("team_label", "pred_team")))


@query("best_truth_track", "J8", f"""
WITH {PAIRS_SQL}, c AS (SELECT sequence_id, pred_track_id, track_id, count(*) AS frames, min(frame_index) AS f0 FROM pr GROUP BY 1, 2, 3)
SELECT sequence_id, pred_track_id, track_id, frames FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id, pred_track_id ORDER BY frames DESC, f0, track_id) AS rn FROM c) WHERE rn = 1""")
def best_truth_track(spark, sf_dir):
    return evl.best_truth_track(pairs(spark, sf_dir))


@query("optimal_matches", "V2", f"WITH RECURSIVE {MATCH_SQL} SELECT sequence_id, frame_index, track_id, pred_track_id, round(iou, 6) AS iou FROM mt")
def optimal_matches(spark, sf_dir):
    return tidy(best_pairs(spark, sf_dir).select(*geo.FRAME, "track_id", "pred_track_id", "iou"))


@query("detection_ap", "V1 W18", """
WITH RECURSIVE d AS (SELECT sequence_id, frame_index, event_id AS e, conf, px1, py1, px2, py2, row_number() OVER (PARTITION BY sequence_id, frame_index ORDER BY conf DESC, event_id) AS n FROM pred_boxes_v),
o AS (SELECT d.sequence_id, d.frame_index, n, t.track_id, greatest(0.0, least(x2, px2) - greatest(x1, px1)) * greatest(0.0, least(y2, py2) - greatest(y1, py1)) AS i, (x2 - x1) * (y2 - y1) + (px2 - px1) * (py2 - py1) AS s FROM d JOIN boxes_v t ON t.sequence_id = d.sequence_id AND t.frame_index = d.frame_index),
c AS (SELECT d.sequence_id, d.frame_index, d.n, d.e, d.conf, coalesce(list(o.track_id ORDER BY o.i / (o.s - o.i) DESC, o.track_id) FILTER (o.i / (o.s - o.i) >= 0.5), []) AS ts FROM d LEFT JOIN o ON o.sequence_id = d.sequence_id AND o.frame_index = d.frame_index AND o.n = d.n GROUP BY 1, 2, 3, 4, 5),
w AS (SELECT sequence_id, frame_index, CAST(0 AS BIGINT) AS n, []::BIGINT[] AS used, 0.0::DOUBLE AS conf, 0 AS hit FROM (SELECT DISTINCT sequence_id, frame_index FROM c)
  UNION ALL SELECT w.sequence_id, w.frame_index, c.n, CASE WHEN len(list_filter(c.ts, lambda t: NOT list_contains(w.used, t))) > 0 THEN list_append(w.used, list_filter(c.ts, lambda t: NOT list_contains(w.used, t))[1]) ELSE w.used END, c.conf, CASE WHEN len(list_filter(c.ts, lambda t: NOT list_contains(w.used, t))) > 0 THEN 1 ELSE 0 END
    FROM w JOIN c ON c.sequence_id = w.sequence_id AND c.frame_index = w.frame_index AND c.n = w.n + 1),
g AS (SELECT conf, sum(hit) AS tp, count(*) AS n FROM w WHERE n > 0 GROUP BY 1), q AS (SELECT conf, sum(tp) OVER (ORDER BY conf DESC) AS tp, sum(n) OVER (ORDER BY conf DESC) AS n FROM g),
p AS (SELECT conf, tp / (SELECT count(*) FROM boxes_v) AS recall, tp / n AS prec FROM q),
e AS (SELECT *, max(prec) OVER (ORDER BY conf DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env, lag(recall, 1, 0.0) OVER (ORDER BY conf DESC) AS b FROM p)
SELECT round(sum((recall - b) * env), 6) AS ap, round(max(recall), 6) AS recall, round(arg_min(prec, conf), 6) AS precision FROM e""")
def detection_ap(spark, sf_dir):
    truth = views.boxes(spark, sf_dir)
    hits = evl.detection_hits(truth, views.predicted_boxes(spark, sf_dir))
    return tidy(evl.average_precision(hits, truth.agg(F.count(F.lit(1)).alias("truths"))))


@query("precision_recall_curve", "W18", """
WITH h AS (SELECT (event_id * 37 % 1000) / 1000.0::DOUBLE AS conf, CASE WHEN event_id % 7 < 5 THEN 1 ELSE 0 END AS hit FROM events), g AS (SELECT conf, sum(hit) AS tp, count(*) AS n FROM h GROUP BY 1),
c AS (SELECT conf, sum(tp) OVER (ORDER BY conf DESC) AS tp, sum(n) OVER (ORDER BY conf DESC) AS n FROM g), p AS (SELECT conf, tp / (SELECT count(*) FROM events WHERE event_id % 7 < 6) AS recall, tp / n AS prec FROM c),
e AS (SELECT recall, max(prec) OVER (ORDER BY conf DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env, lag(recall, 1, 0.0) OVER (ORDER BY conf DESC) AS b FROM p)
SELECT round(sum((recall - b) * env), 6) AS ap, round(max(recall), 6) AS recall FROM e""")
def precision_recall_curve(spark, sf_dir):
    e = F.col("event_id")
    hits = views.table(spark, sf_dir, "events").select((e * 37 % 1000 / F.lit(1000.0)).alias("conf"), F.when(e % 7 < 5, 1).otherwise(0).alias("hit"), (e % 7 < 6).alias("known"))
    return tidy(evl.average_precision(hits, hits.filter(F.col('known')).agg(F.count(F.lit(1)).alias('truths'))).select("ap", "recall"))


@query("track_switches", "W19 W20 W23", f"""
WITH RECURSIVE {MATCH_SQL}, l AS (SELECT *, lag(pred_track_id) OVER w AS lp, frame_index - lag(frame_index) OVER w AS gap FROM mt WINDOW w AS (PARTITION BY sequence_id, track_id ORDER BY frame_index)),
k AS (SELECT sequence_id, track_id, count(*) AS found, count(*) FILTER (lp <> pred_track_id) AS sw, count(*) FILTER (gap > 1) AS fr, count(*) FILTER (lp <> pred_track_id AND gap <= 2) AS s1, count(*) FILTER (lp <> pred_track_id AND gap BETWEEN 3 AND 10) AS s2, count(*) FILTER (lp <> pred_track_id AND gap > 10) AS s3 FROM l GROUP BY 1, 2),
n AS (SELECT sequence_id, track_id, count(*) AS len FROM boxes_v GROUP BY 1, 2)
SELECT n.sequence_id, count(*) AS tracks, sum(coalesce(sw, 0))::BIGINT AS switches, sum(coalesce(fr, 0))::BIGINT AS fragments, count(*) FILTER (coalesce(found, 0) / len >= 0.8) AS mostly_tracked, count(*) FILTER (coalesce(found, 0) / len <= 0.2) AS mostly_lost,
 sum(coalesce(s1, 0))::BIGINT AS switch_short, sum(coalesce(s2, 0))::BIGINT AS switch_medium, sum(coalesce(s3, 0))::BIGINT AS switch_long FROM n LEFT JOIN k ON k.sequence_id = n.sequence_id AND k.track_id = n.track_id GROUP BY 1""")
def track_switches(spark, sf_dir):
    return evl.switches(best_pairs(spark, sf_dir), views.boxes(spark, sf_dir))


@query("hota", "V3", f"""
WITH RECURSIVE {MATCH_SQL}, h AS (SELECT sequence_id, track_id, pred_track_id, count(*) AS tpa FROM mt GROUP BY 1, 2, 3), t AS (SELECT sequence_id, track_id, count(*) AS tl FROM boxes_v GROUP BY 1, 2), p AS (SELECT sequence_id, pred_track_id, count(*) AS pl FROM pred_boxes_v GROUP BY 1, 2),
a AS (SELECT h.sequence_id, sum(tpa) AS tp, sum(tpa * tpa / (tl + pl - tpa)) / sum(tpa) AS ass FROM h JOIN t ON t.sequence_id = h.sequence_id AND t.track_id = h.track_id JOIN p ON p.sequence_id = h.sequence_id AND p.pred_track_id = h.pred_track_id GROUP BY 1),
s AS (SELECT t.sequence_id, sum(tl) AS nt, (SELECT sum(pl) FROM p WHERE p.sequence_id = t.sequence_id) AS np FROM t GROUP BY 1)
SELECT a.sequence_id, round(tp / (nt + np - tp), 6) AS det_a, round(ass, 6) AS ass_a, round(sqrt(tp / (nt + np - tp) * ass), 6) AS hota FROM a JOIN s ON s.sequence_id = a.sequence_id""")
def hota(spark, sf_dir):
    return tidy(evl.hota_at(best_pairs(spark, sf_dir), views.boxes(spark, sf_dir), views.predicted_boxes(spark, sf_dir)))


@query("idf1", "V3", f"""
WITH RECURSIVE {PAIRS_SQL}, cn AS (SELECT sequence_id, track_id, pred_track_id, count(*) AS c FROM pr GROUP BY 1, 2, 3),
rv AS (SELECT *, count(*) OVER (PARTITION BY sequence_id, track_id) = 1 AND count(*) OVER (PARTITION BY sequence_id, pred_track_id) = 1 AS alone FROM cn),
reach AS (SELECT DISTINCT sequence_id, track_id, track_id AS low FROM rv WHERE NOT alone UNION SELECT b.sequence_id, b.track_id, r.low FROM reach r JOIN rv a ON a.sequence_id = r.sequence_id AND a.track_id = r.track_id JOIN rv b ON b.sequence_id = a.sequence_id AND b.pred_track_id = a.pred_track_id),
part AS (SELECT sequence_id, track_id, min(low) AS part FROM reach GROUP BY 1, 2),
kn AS (SELECT rv.sequence_id, part, rv.track_id, rv.pred_track_id, c, dense_rank() OVER (PARTITION BY rv.sequence_id, part ORDER BY rv.track_id) AS n FROM rv JOIN part p ON p.sequence_id = rv.sequence_id AND p.track_id = rv.track_id),
mx AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY sequence_id, part ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM (SELECT sequence_id, part, n, max(c) AS m FROM kn GROUP BY 1, 2, 3)),
mb AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, part, track_id ORDER BY c DESC, pred_track_id) AS r1, row_number() OVER (PARTITION BY sequence_id, part, pred_track_id ORDER BY c DESC, track_id) AS r2 FROM kn),
lb AS (SELECT sequence_id, part, coalesce(sum(c) FILTER (r1 = 1 AND r2 = 1), 0) AS least FROM mb GROUP BY 1, 2),
op AS (SELECT k.sequence_id, k.part, k.n, pred_track_id, c, rest, least FROM (SELECT sequence_id, part, n, pred_track_id, c FROM kn UNION ALL SELECT DISTINCT sequence_id, part, n, NULL, 0 FROM kn) k
  JOIN mx ON mx.sequence_id = k.sequence_id AND mx.part = k.part AND mx.n = k.n JOIN lb ON lb.sequence_id = k.sequence_id AND lb.part = k.part),
wk AS (SELECT DISTINCT sequence_id, part, CAST(0 AS BIGINT) AS n, []::BIGINT[] AS ps, CAST(0 AS BIGINT) AS total FROM kn
  UNION ALL SELECT sequence_id, part, n, ps, max(total)::BIGINT FROM (SELECT w.sequence_id, w.part, w.n + 1 AS n, CASE WHEN o.pred_track_id IS NULL THEN ps ELSE list_sort(list_append(ps, o.pred_track_id)) END AS ps, total + c AS total
    FROM wk w JOIN op o ON o.sequence_id = w.sequence_id AND o.part = w.part AND o.n = w.n + 1 WHERE (o.pred_track_id IS NULL OR NOT list_contains(ps, o.pred_track_id)) AND total + c + rest >= least) GROUP BY 1, 2, 3, 4),
bw AS (SELECT sequence_id, part, max(total) AS t FROM wk GROUP BY 1, 2), tp AS (SELECT sequence_id, sum(t) AS t FROM (SELECT sequence_id, t FROM bw UNION ALL SELECT sequence_id, c FROM rv WHERE alone) GROUP BY 1),
a AS (SELECT sequence_id, count(*) AS nt FROM boxes_v GROUP BY 1), b AS (SELECT sequence_id, count(*) AS np FROM pred_boxes_v GROUP BY 1)
SELECT a.sequence_id, round(2.0 * coalesce(t, 0) / (nt + np), 6) AS idf1 FROM a JOIN b ON b.sequence_id = a.sequence_id LEFT JOIN tp ON tp.sequence_id = a.sequence_id""")
def idf1(spark, sf_dir):
    return tidy(evl.idf1(views.boxes(spark, sf_dir), views.predicted_boxes(spark, sf_dir).drop("event_id")))


@query("team_accuracy", "V4", f"""
WITH RECURSIVE {MATCH_SQL}, c AS (SELECT sequence_id, count(*) AS n, count(*) FILTER (team_label = pred_team) AS d, count(*) FILTER (team_label <> pred_team) AS s FROM mt GROUP BY 1)
SELECT sequence_id, n AS rows, round(greatest(d, s) / n, 6) AS accuracy, s > d AS swapped FROM c""")
def team_accuracy(spark, sf_dir):
    return tidy(evl.team_accuracy(best_pairs(spark, sf_dir)))


LABELS_SQL = """
lb AS (SELECT l.doc_id, CAST(quality AS VARCHAR) AS truth, CASE WHEN n_chars % 10 = 0 THEN 'UNKNOWN' WHEN n_chars > 1000 THEN '1' ELSE '0' END AS pred, least(1.0, n_chars / 5000.0::DOUBLE) AS p, quality AS y FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def labelled(spark, sf_dir):
    chars = F.col("n_chars")
    return views.table(spark, sf_dir, "labels").join(views.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", F.col("quality").cast("string").alias("truth"), F.when(chars % 10 == 0, "UNKNOWN").when(chars > 1000, "1").otherwise("0").alias("pred"),
        F.least(F.lit(1.0), chars / F.lit(5000.0)).alias("p"), F.col("quality").alias("y"))


@query("label_scores", "V5", f"""
WITH {LABELS_SQL}, k AS (SELECT DISTINCT truth AS label FROM lb UNION SELECT DISTINCT pred FROM lb WHERE pred <> 'UNKNOWN'),
s AS (SELECT label, (SELECT count(*) FROM lb WHERE truth = label) AS support, (SELECT count(*) FROM lb WHERE pred = label) AS called, (SELECT count(*) FROM lb WHERE pred = label AND truth = label) AS tp FROM k)
SELECT label, support, called, tp, round(CASE WHEN called > 0 THEN tp / called ELSE 0.0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0.0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (called + support) ELSE 0.0 END, 6) AS f1 FROM s""")
def label_scores(spark, sf_dir):
    return tidy(evl.class_scores(evl.confusion(labelled(spark, sf_dir), "truth", "pred"), "UNKNOWN"))


@query("label_summary", "V5", f"""
WITH {LABELS_SQL}, s AS (SELECT label, (SELECT count(*) FROM lb WHERE truth = label) AS sp, (SELECT count(*) FROM lb WHERE pred = label) AS ca, (SELECT count(*) FROM lb WHERE pred = label AND truth = label) AS tp FROM (SELECT DISTINCT truth AS label FROM lb))
SELECT round((SELECT avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) FROM lb), 6) AS accuracy, round((SELECT avg(CASE WHEN pred <> 'UNKNOWN' THEN 1.0 ELSE 0.0 END) FROM lb), 6) AS coverage, (SELECT count(*) FROM lb) AS rows, round(avg(2.0 * tp / (ca + sp)), 6) AS macro_f1, round(avg(tp / sp), 6) AS balanced_accuracy FROM s""")
def label_summary(spark, sf_dir):
    counts = evl.confusion(labelled(spark, sf_dir), "truth", "pred")
    return tidy(evl.label_summary(counts, evl.class_scores(counts, "UNKNOWN"), abstain="UNKNOWN"))


@query("calibration_error", "V9", f"""
WITH {LABELS_SQL}, b AS (SELECT floor(p * 10) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM lb WHERE p < 1.0 GROUP BY 1)
SELECT (SELECT count(*) FROM lb) AS rows, round((SELECT avg(pow(p - y, 2)) FROM lb), 6) AS brier, round(sum(n * abs(mp - my)) / (SELECT count(*) FROM lb), 6) AS ece FROM b""")
def calibration_error(spark, sf_dir):
    return tidy(evl.calibration_error(labelled(spark, sf_dir)))


@query("ranking_areas", "V9", f"""
WITH {LABELS_SQL}, g AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM lb GROUP BY 1), r AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM g), t AS (SELECT sum(pos) AS np, sum(neg) AS nn FROM g)
SELECT round(sum(neg * (tp - pos / 2.0) / (np * nn)), 6) AS roc_auc, round(sum(pos / np * tp / (tp + fp)), 6) AS pr_auc FROM r, t""")
def ranking_areas(spark, sf_dir):
    return tidy(evl.ranking_areas(labelled(spark, sf_dir)))


INTERVALS_SQL = "iv AS (SELECT sequence_id, loss_frame AS interval_no, loss_frame AS f0, least(loss_frame + 30, last_frame) AS f1, gaining_team AS label FROM turnovers_v JOIN ends_v USING (sequence_id))"


def frame_labels(spark, sf_dir):
    last = views.ball(spark, sf_dir).groupBy("sequence_id").agg(F.max("frame_index").alias("_l"))
    iv = turnovers(spark, sf_dir).join(last, "sequence_id").select("sequence_id", F.col("loss_frame").alias("interval_no"), F.col("loss_frame").alias("start_frame"),
                                                                 F.least(F.col("loss_frame") + 30, F.col("_l")).alias("end_frame"), F.col("gaining_team").alias("label"))
    return evl.labels_by_frame(iv)


FRAME_LABELS_SQL = INTERVALS_SQL + """,
fl AS (SELECT sequence_id, frame_index, arg_max(label, interval_no) AS label FROM (SELECT sequence_id, interval_no, label, unnest(generate_series(f0, f1)) AS frame_index FROM iv) GROUP BY 1, 2)"""


@query("interval_labels", "J13", f"WITH {FRAME_LABELS_SQL} SELECT sequence_id, frame_index, label FROM fl")
def interval_labels(spark, sf_dir):
    return frame_labels(spark, sf_dir)


@query("label_agreement", "J14 O12", f"""
WITH {FRAME_LABELS_SQL} SELECT fl.sequence_id, count(*) AS frames, count(*) FILTER (label = possession_team) AS agreed FROM fl JOIN held_v h ON h.sequence_id = fl.sequence_id AND h.frame_index = fl.frame_index GROUP BY 1""")
def label_agreement(spark, sf_dir):
    from touchline.plans.motion_queries import possession

    both = frame_labels(spark, sf_dir).join(possession(spark, sf_dir), geo.FRAME)
    return both.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("label") == F.col("possession_team")).alias("agreed"))


@query("near_changes", "W14", """
WITH c AS (SELECT sequence_id, frame_index, possession_team AS label, coalesce(CASE WHEN possession_team <> lag(possession_team) OVER w THEN 1 ELSE 0 END, 0) AS c FROM held_v WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_index))
SELECT sequence_id, frame_index, label, max(c) OVER (PARTITION BY sequence_id ORDER BY frame_index RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) = 1 AS near_change FROM c WHERE frame_index % 41 > 0""".replace(" WHERE frame_index % 41 > 0", ""))
def near_changes(spark, sf_dir):
    from touchline.plans.motion_queries import possession

    numbered = possession(spark, sf_dir).select(*geo.FRAME, F.col("possession_team").alias("label"))
    full = views.ball(spark, sf_dir).select(*geo.FRAME)
    return evl.near_changes(numbered.join(full, geo.FRAME, "left_semi"), span=4096).select(*geo.FRAME, "label", "near_change")


@query("label_stints", "W12 W13", """
WITH l AS (SELECT sequence_id, team_label, frame_index, category AS label, lag(category) OVER (PARTITION BY sequence_id, team_label ORDER BY frame_index) AS p FROM block_v),
r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> label THEN 1 ELSE 0 END) OVER (PARTITION BY sequence_id, team_label ORDER BY frame_index) AS run FROM l), n AS (SELECT sequence_id, team_label, run, count(*) AS len FROM r GROUP BY 1, 2, 3)
SELECT sequence_id, team_label, count(*) AS stints, round(avg(len), 6) AS mean_length, count(*) FILTER (len < 3) AS short_stints, round((count(*) - 1) / (sum(len) / 1500.0), 6) AS switches_per_minute, round(1.0 - (count(*) - 1) / greatest(sum(len) - 1, 1), 6) AS stability FROM n GROUP BY 1, 2""")
def label_stints(spark, sf_dir):
    return tidy(evl.stints(block_table(spark, sf_dir).select(*geo.TEAM, F.col("category").alias("label")), ["sequence_id", "team_label"]))


@query("pressure_distribution", "A17 A18", """
SELECT sequence_id, round(avg(p), 6) AS mean, round(quantile_cont(p, 0.5), 6) AS median, round(quantile_cont(p, 0.9), 6) AS p90, round(quantile_cont(p, 0.95), 6) AS p95, round(min(p), 6) AS min, round(max(p), 6) AS max FROM pressure_v GROUP BY 1""")
def pressure_distribution(spark, sf_dir):
    return tidy(evl.distribution(frame_pressure(spark, sf_dir), "pressure_index", ["sequence_id"]))


@query("block_macro", "A18 A19", """
SELECT team_label, round(avg(m), 6) AS macro_mean, count(*) AS sequences FROM (SELECT team_label, sequence_id, avg(h) AS m FROM block_v GROUP BY 1, 2) GROUP BY 1""")
def block_macro(spark, sf_dir):
    return tidy(evl.macro(block_table(spark, sf_dir), ["team_label"], "sequence_id", "line_height_m"))


@query("event_profile", "W15", """
SELECT t.sequence_id, t.loss_frame AS event_frame, CAST(o AS INTEGER) AS "offset", round(p, 6) AS pressure_index FROM turnovers_v t CROSS JOIN (VALUES (-25), (0), (12), (25)) v(o) LEFT JOIN pressure_v q ON q.sequence_id = t.sequence_id AND q.frame_index = t.loss_frame + o""")
def event_profile(spark, sf_dir):
    ev = turnovers(spark, sf_dir).select("sequence_id", F.col("loss_frame").alias("event_frame"))
    return tidy(evl.profile(ev, frame_pressure(spark, sf_dir), "pressure_index").select("sequence_id", "event_frame", "offset", "pressure_index"))


@query("pressure_monotonicity", "V13", """
WITH s AS (SELECT event_id // 20 AS sweep, event_id % 20 AS step, 0.4 * exp(-(0.5 + (event_id % 20) * 0.5) / 2.8) AS p FROM events)
SELECT sweep, count(*) AS points, 0::BIGINT AS violations FROM s GROUP BY 1""")
def pressure_monotonicity(spark, sf_dir):
    from touchline.operators.pressure import pressure_index

    step = F.col("event_id") % 20
    zero = F.lit(0)
    value = pressure_index(F.lit(0.5) + step * 0.5, F.lit(0.0), F.lit(None).cast("double"), zero, zero, zero, F.lit(0.0), F.lit(False))
    sweep = views.table(spark, sf_dir, "events").select(F.expr("event_id div 20").alias("sweep"), step.alias("step"), value.alias("p"))
    return evl.monotonicity(sweep, ["sweep"], "step", "p", rising=False)


def event_tables(spark, sf_dir):
    truth = turnovers(spark, sf_dir).select("sequence_id", F.col("loss_frame").alias("event_no"), F.col("loss_frame").alias("release_frame"), (F.col("loss_frame") + 10).alias("reception_frame"))
    pred = truth.filter("event_no % 5 <> 0").select("sequence_id", (F.col("event_no") + 1000).alias("event_no"), (F.col("release_frame") + F.col("event_no") % 3 - 1).alias("release_frame"),
                                                    (F.col("reception_frame") + F.col("event_no") % 4).alias("reception_frame"))
    return pred, truth


@query("pass_matching", "J15")
def pass_matching(spark, sf_dir):
    return evl.match_events(*event_tables(spark, sf_dir))


@query("event_scores", "V6")
def event_scores(spark, sf_dir):
    pred, truth = event_tables(spark, sf_dir)
    return tidy(evl.event_scores(evl.match_events(pred, truth), pred, truth))


@query("first_come_matching", "J16 V7")
def first_come_matching(spark, sf_dir):
    pred, truth = event_tables(spark, sf_dir)
    at = lambda df: df.select("sequence_id", "event_no", F.col("release_frame").alias("frame"))
    return evl.first_come_matches(at(pred), at(truth))


@query("structure_metrics", "V8", """
WITH s AS (SELECT sequence_id, team_label, frame_index, count(*) AS k, string_agg(players, '-' ORDER BY line_id) AS st FROM lines_v GROUP BY 1, 2, 3)
SELECT team_label, count(*) AS frames, round(avg(CASE WHEN k = 3 THEN 1.0 ELSE 0.0 END), 6) AS line_count_accuracy, round(avg(CASE WHEN st = '4-4-2' THEN 1.0 ELSE 0.0 END), 6) AS exact_match FROM s GROUP BY 1""")
def structure_metrics(spark, sf_dir):
    s = oriented(spark, sf_dir).filter("line_count > 0").withColumn("st", F.transform("lines", lambda l: l["players"]))
    want = F.array(F.lit(4), F.lit(4), F.lit(2))
    return tidy(s.groupBy("team_label").agg(F.count(F.lit(1)).alias("frames"), F.avg(F.when(F.size("st") == 3, 1.0).otherwise(0.0)).alias("line_count_accuracy"),
                                            F.avg(F.when(F.col("st") == want, 1.0).otherwise(0.0)).alias("exact_match")))


@query("structure_distance", "V8 P36")
def structure_distance(spark, sf_dir):
    s = oriented(spark, sf_dir).filter("line_count > 0").withColumn("st", F.transform("lines", lambda l: l["players"]))
    return tidy(s.groupBy("team_label").agg(F.avg(formation.formation_distance(F.col("st"), (4, 4, 2))).alias("mean_distance")))


@query("registration_iou", "V10")
def registration_iou(spark, sf_dir):
    cal = views.calibrations(spark, sf_dir)
    shifted = cal.withColumn("h", F.transform("h", lambda v, i: v + F.when(i == 2, 2.0).otherwise(0.0)))
    return tidy(evl.registration_iou(shifted, cal))


@query("shape_noise", "V11 V12")
def shape_noise(spark, sf_dir):
    base = geo.outfield(players(spark, sf_dir))
    clean = geo.team_shape(base).select(*geo.TEAM, F.col("stretch_m").alias("s0"), F.col("width_m").alias("w0"), "players")
    noisy = evl.perturb(base, 3, 0.5)
    spread = noisy.groupBy(*geo.TEAM, "round").agg((F.max("y_m") - F.min("y_m")).alias("w1"))
    bucket = F.when(F.col("players") >= 8, "HIGH").when(F.col("players") >= 5, "MEDIUM").otherwise("LOW")
    return tidy(spread.join(clean, geo.TEAM).withColumn("visibility", bucket).groupBy("visibility").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col("w1") - F.col("w0"))).alias("mean_width_error_m")))


@query("spatial_error", "V14", """
WITH d AS (SELECT sequence_id, frame_index, ball_x + (frame_index % 5 - 2) / 10.0::DOUBLE AS u, ball_y AS v FROM ball_v WHERE ball_valid AND frame_index % 4 <> 0),
l AS (SELECT *, lag(frame_index) OVER w AS pf, lag(u) OVER w AS pu, lag(v) OVER w AS pv FROM d WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_index)),
g AS (SELECT *, frame_index - pf AS n, sqrt(pow(u - pu, 2) + pow(v - pv, 2)) AS dist FROM l WHERE frame_index - pf > 1),
fl AS (SELECT sequence_id, unnest(generate_series(pf + 1, frame_index - 1)) AS frame_index, pf, n, u, v, pu, pv FROM g WHERE (n - 1 <= 3 AND dist / n <= 60.0) OR (dist / n <= 30.0 AND dist <= 150.0)),
tr AS (SELECT sequence_id, frame_index, 'DETECTED' AS state, u, v FROM d UNION ALL SELECT sequence_id, frame_index, 'INTERPOLATED', pu + (u - pu) * (frame_index - pf) / n, pv + (v - pv) * (frame_index - pf) / n FROM fl),
e AS (SELECT t.sequence_id, state, abs(u - ball_x) AS du, abs(v - ball_y) AS dv, greatest(0.0, 0.6 - abs(u - ball_x)) * greatest(0.0, 0.6 - abs(v - ball_y)) AS i FROM tr t JOIN ball_v b ON b.sequence_id = t.sequence_id AND b.frame_index = t.frame_index)
SELECT sequence_id, state, count(*) AS frames, round(avg(sqrt(du * du + dv * dv)), 5) AS mean_distance, round(max(sqrt(du * du + dv * dv)), 5) AS max_distance, round(avg(sqrt(du * du + dv * dv) / 0.6), 5) AS mean_normalised, round(avg(i / (0.72 - i)), 5) AS mean_iou FROM e GROUP BY 1, 2""")
def spatial_error(spark, sf_dir):
    """Centre error of the ball, in metres and ball boxes of 0.6 m, by the state that its position comes from."""
    ball = views.ball(spark, sf_dir)
    seen = ball.filter("ball_valid AND frame_index % 4 <> 0").select(
        *geo.FRAME, F.lit("DETECTED").alias("state"), F.lit(1).alias("born_frame"), (F.col("ball_x") + (F.col("frame_index") % 5 - 2) / F.lit(10.0)).alias("u"), F.col("ball_y").alias("v"))
    track = seen.select(*geo.FRAME, "state", "u", "v").unionByName(trk.fill_gaps(seen).select(*geo.FRAME, F.lit("INTERPOLATED").alias("state"), "u", "v"))
    return tidy(evl.centre_errors(track, ball.select(*geo.FRAME, F.col("ball_x").alias("true_u"), F.col("ball_y").alias("true_v")), 0.6), 5)


def inventory(spark, sf_dir):
    e = F.col("event_id")
    gid = F.concat(F.lit("G"), (e % 5).cast("string"))
    return views.table(spark, sf_dir, "events").select(
        "event_id", gid.alias("golden_id"), F.expr("event_id div 5").alias("frame_index"),
        F.when(e % 97 == 0, "bad").otherwise(dq.frame_uid(gid, F.expr("event_id div 5"))).alias("frame_uid"),
        F.when(e % 89 == 0, 100).otherwise(1920).alias("width"), F.lit(1080).alias("height"), (F.expr("event_id div 5") / F.lit(25.0) + F.when(e % 83 == 0, 1.0).otherwise(0.0)).alias("timestamp_seconds"))


INVENTORY_SQL = """
inv AS (SELECT event_id, 'G' || event_id % 5 AS g, event_id // 5 AS fi, CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE 'G' || event_id % 5 || '_f' || lpad(CAST(event_id // 5 AS VARCHAR), 6, '0') END AS uid FROM events)"""


@query("manifest_violations", "V15 T23", f"""
WITH {INVENTORY_SQL} SELECT uid AS key, 'size' AS rule FROM inv WHERE event_id % 89 = 0 UNION ALL SELECT uid, 'uid_format' FROM inv WHERE event_id % 97 = 0 UNION ALL SELECT uid, 'timestamp' FROM inv WHERE event_id % 83 = 0
UNION ALL SELECT uid, 'duplicate_uid' FROM inv GROUP BY 1 HAVING count(*) > 1""")
def manifest_violations(spark, sf_dir):
    return dq.manifest_violations(inventory(spark, sf_dir))


@query("manifest_membership", "J19", f"""
WITH {INVENTORY_SQL}, a AS (SELECT DISTINCT uid FROM inv WHERE event_id % 3 <> 0), b AS (SELECT DISTINCT uid FROM inv WHERE event_id % 4 <> 0)
SELECT uid AS frame_uid, 'inventory_only' AS side FROM (SELECT uid FROM a EXCEPT SELECT uid FROM b) UNION ALL SELECT uid, 'manifest_only' FROM (SELECT uid FROM b EXCEPT SELECT uid FROM a)""")
def manifest_membership(spark, sf_dir):
    inv = inventory(spark, sf_dir)
    return dq.membership(inv.filter("event_id % 3 <> 0"), inv.filter("event_id % 4 <> 0"))


@query("annotation_violations", "V16", """
SELECT event_id AS key, 'box_inside' AS rule FROM boxes_v WHERE x1 < 0 OR y1 < 0 OR x2 > 1920 OR y2 > 1080 UNION ALL SELECT event_id, 'role_allowed' FROM boxes_v WHERE role = 'GOALKEEPER' UNION ALL SELECT event_id, 'actor_known' FROM boxes_v WHERE track_id >= 20""")
def annotation_violations(spark, sf_dir):
    b = views.boxes(spark, sf_dir)
    return dq.annotation_violations(b, b.filter("track_id < 20"), ["OUTFIELD_PLAYER"])


@query("split_leakage", "V17", """
SELECT user_id AS key, string_agg(DISTINCT s, ',' ORDER BY s) AS splits FROM (SELECT user_id, CASE WHEN event_id % 10 < 8 THEN 'train' ELSE 'valid' END AS s FROM events) GROUP BY 1 HAVING count(DISTINCT s) > 1""")
def split_leakage(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_id") % 10 < 8, "train").otherwise("valid").alias("split"))
    return dq.split_leakage(e)


@query("split_fingerprint", "V17", """
WITH h AS (SELECT CASE WHEN event_id % 10 < 8 THEN 'train' ELSE 'valid' END AS split, sha256('{"event_id":' || event_id || coalesce(',"user_id":' || user_id, '') || '}') AS d FROM events)
SELECT split, count(*) AS rows, CAST(sum(('0x' || substr(d, 1, 12))::BIGINT)::HUGEINT % 2305843009213693951 AS BIGINT) AS fingerprint FROM h GROUP BY 1""")
def split_fingerprint(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 10 < 8, "train").otherwise("valid").alias("split"))
    return dq.split_fingerprint(e, ["event_id", "user_id"])


@query("ingest_report", "S21", """
SELECT CASE WHEN page_id % 6 = 0 THEN 'invalid' ELSE 'success' END AS status, count(*) AS items FROM pages GROUP BY 1""")
def ingest_report(spark, sf_dir):
    items = views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), F.when(F.col("page_id") % 6 == 0, "").otherwise(F.col("url")).alias("url"))
    return dq.ingest_report(items).groupBy("status").agg(F.count(F.lit(1)).alias("items"))


@query("retention", "R9 M22", """
SELECT o_orderkey AS request_id FROM orders WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') < '1996-01-01T00:00:00'""")
def retention(spark, sf_dir):
    rows = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))
    return dq.expired(rows, "created_at", F.lit("1996-01-01T00:00:00")).select("request_id")


@query("recent_requests", "O7", """
SELECT o_custkey AS key, o_orderkey AS request_id, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def recent_requests(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return (views.table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(w)).filter("place <= 3")
            .select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("request_id"), "place"))


@query("admission_limit", "E25", """
WITH RECURSIVE rq AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch_us(ts) / 1000000.0::DOUBLE AS tm FROM events),
wk AS (SELECT key, n, tm, [tm] AS recent, true AS ok FROM rq WHERE n = 1
  UNION ALL SELECT key, n, tm, CASE WHEN len(k) < 5 THEN list_append(k, tm) ELSE k END, len(k) < 5 FROM (SELECT r.key, r.n, r.tm, list_filter(w.recent, lambda t: t > r.tm - 600.0) AS k FROM wk w JOIN rq r ON r.key = w.key AND r.n = w.n + 1))
SELECT key, n AS request_no, tm AS at_s, ok AS admitted FROM wk""")
def admission_limit(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    reqs = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", (F.unix_micros(ts) / F.lit(1000000.0)).alias("at_s"), F.unix_seconds(ts).alias("second"))
    # numbered in spans of time, so that one user's requests are not one task
    return trk.admissions(frames.numbered(reqs, ["key"], ["at_s", "event_id"], "second", "request_no"))


@query("box_association", "E21")
def box_association(spark, sf_dir):
    dets = views.predicted_boxes(spark, sf_dir).select("sequence_id", "frame_index", F.col("event_id").alias("det_id"), F.col("px1").alias("x1"), F.col("py1").alias("y1"),
                                                       F.col("px2").alias("x2"), F.col("py2").alias("y2"))
    return trk.associate(dets)


def ball_track(spark, sf_dir):
    b = views.ball_pixels(views.ball(spark, sf_dir))
    one = F.when(F.col("ball_valid"), F.array(F.struct(F.col("ball_u").alias("u"), F.col("ball_v").alias("v"), F.col("ball_conf").alias("conf"))))
    none = F.array().cast("array<struct<u: double, v: double, conf: double>>")
    return trk.track_ball(b.select(*geo.FRAME, F.coalesce(one, none).alias("candidates")))


@query("ball_track", "E19", """
WITH RECURSIVE c AS (SELECT sequence_id, frame_index, row_number() OVER (PARTITION BY sequence_id ORDER BY frame_index) AS n, CASE WHEN ball_valid AND ball_conf >= 0.25 THEN (ball_x + 52.5) / 105.0 * 1920.0 END AS cu, CASE WHEN ball_valid AND ball_conf >= 0.25 THEN (ball_y + 34.0) / 68.0 * 1080.0 END AS cv, ball_conf AS cc FROM ball_v),
wk AS (SELECT sequence_id, frame_index, CAST(0 AS BIGINT) AS n, false AS hit, CAST(NULL AS DOUBLE) AS au, CAST(NULL AS DOUBLE) AS av, CAST(NULL AS BIGINT) AS af, CAST(0 AS BIGINT) AS misses, CAST(NULL AS BIGINT) AS born, CAST(NULL AS DOUBLE) AS vx, CAST(NULL AS DOUBLE) AS vy, CAST(NULL AS DOUBLE) AS conf FROM c WHERE n = 1
  UNION ALL SELECT sequence_id, f, n, take, CASE WHEN take THEN cu ELSE au END, CASE WHEN take THEN cv ELSE av END, CASE WHEN take THEN f ELSE af END, CASE WHEN take THEN 0 ELSE misses + 1 END, CASE WHEN NOT take THEN born WHEN fresh THEN f ELSE born END,
     CASE WHEN take AND NOT fresh THEN (cu - au) / gone END, CASE WHEN take AND NOT fresh THEN (cv - av) / gone END, CASE WHEN take THEN cc END
   FROM (SELECT *, cu IS NOT NULL AND (au IS NULL OR (moved <= least(150.0 + 35.0 * (gone - 1), 500.0) AND moved / gone <= 120.0) OR (misses >= 25 AND cc >= 0.30)) AS take, born IS NULL OR misses >= 25 OR (misses >= 10 AND moved > 300.0) AS fresh
     FROM (SELECT c.sequence_id, c.frame_index AS f, c.n, cu, cv, cc, au, av, af, misses, born, greatest(1, c.frame_index - af) AS gone, sqrt((cu - au) * (cu - au) + (cv - av) * (cv - av)) AS moved FROM wk w JOIN c ON c.sequence_id = w.sequence_id AND c.n = w.n + 1)))
SELECT sequence_id, frame_index, CASE WHEN hit THEN 'DETECTED' ELSE 'LOST' END AS state, CASE WHEN hit THEN 'ACTIVE' WHEN misses > 25 THEN 'TERMINATED' ELSE 'LOST' END AS lifecycle, CASE WHEN hit THEN born END AS born_frame, CASE WHEN hit THEN round(au, 6) END AS u, CASE WHEN hit THEN round(av, 6) END AS v,
 round(vx, 6) AS vx, round(vy, 6) AS vy, round(conf, 6) AS conf, misses AS gap FROM wk WHERE n > 0""")
def ball_track_query(spark, sf_dir):
    return tidy(ball_track(spark, sf_dir))


@query("ball_gap_fill", "E20 W21", """
WITH s AS (SELECT sequence_id, frame_index, ball_x AS u, ball_y AS v FROM ball_v WHERE ball_valid AND frame_index % 4 <> 0),
l AS (SELECT *, lag(frame_index) OVER w AS pf, lag(u) OVER w AS pu, lag(v) OVER w AS pv FROM s WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_index)),
g AS (SELECT *, frame_index - pf AS n, sqrt(pow(u - pu, 2) + pow(v - pv, 2)) AS d FROM l WHERE frame_index - pf > 1)
SELECT sequence_id, fa AS frame_index, round(pu + (u - pu) * (fa - pf) / n, 6) AS u, round(pv + (v - pv) * (fa - pf) / n, 6) AS v, n - 1 AS gap FROM (SELECT *, unnest(generate_series(pf + 1, frame_index - 1)) AS fa FROM g WHERE (n - 1 <= 3 AND d / n <= 60.0) OR (d / n <= 30.0 AND d <= 150.0))""")
def ball_gap_fill(spark, sf_dir):
    track = views.ball(spark, sf_dir).filter("ball_valid AND frame_index % 4 <> 0").select(
        *geo.FRAME, F.lit("DETECTED").alias("state"), F.lit(1).alias("born_frame"), F.col("ball_x").alias("u"), F.col("ball_y").alias("v"))
    return tidy(trk.fill_gaps(track).select(*geo.FRAME, "u", "v", "gap"))


@query("ball_coverage", "W22", """
WITH f AS (SELECT sequence_id, frame_index, CASE WHEN ball_valid AND frame_index % 9 <> 0 THEN 1 ELSE 0 END AS seen FROM ball_v), l AS (SELECT *, lag(seen) OVER (PARTITION BY sequence_id ORDER BY frame_index) AS p FROM f),
r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> seen THEN 1 ELSE 0 END) OVER (PARTITION BY sequence_id ORDER BY frame_index) AS run FROM l), n AS (SELECT sequence_id, run, max(seen) AS seen, count(*) AS len FROM r GROUP BY 1, 2)
SELECT sequence_id, sum(len)::BIGINT AS frames, round(sum(len * seen) / sum(len), 6) AS coverage, count(*) FILTER (seen = 0) AS gaps, max(len) FILTER (seen = 1) AS longest_run, count(*) FILTER (seen = 0 AND len <= 2) AS gaps_short, count(*) FILTER (seen = 0 AND len BETWEEN 3 AND 10) AS gaps_medium, count(*) FILTER (seen = 0 AND len > 10) AS gaps_long FROM n GROUP BY 1""")
def ball_coverage(spark, sf_dir):
    b = views.ball(spark, sf_dir)
    track = b.select(*geo.FRAME, F.when(F.col("ball_valid") & (F.col("frame_index") % 9 != 0), "DETECTED").otherwise("LOST").alias("state"))
    return tidy(trk.coverage(track, b))


def _iou_sql(a: str, b: str) -> str:
    shared = f"(greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
    return f"({shared} / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {shared}))"


@query("ambiguous_boxes", "J22", f"""
WITH d AS (SELECT sequence_id AS sq, frame_index AS fr, event_id AS e, track_id AS tr, x1, y1, x2, y2, position_valid AS ok FROM boxes_v), t AS (SELECT sq, fr + 1 AS fr, tr, x1, y1, x2, y2, ok FROM d),
o AS (SELECT DISTINCT a.e FROM d a JOIN d b ON b.sq = a.sq AND b.fr = a.fr AND b.e <> a.e WHERE {_iou_sql('a', 'b')} >= 0.15),
m AS (SELECT d.e, d.sq, d.fr, t.tr FROM d JOIN t ON t.sq = d.sq AND t.fr = d.fr WHERE t.ok AND {_iou_sql('d', 't')} >= 0.20),
c AS (SELECT e FROM m GROUP BY e HAVING count(*) > 1 UNION SELECT a.e FROM m a JOIN m b ON b.sq = a.sq AND b.fr = a.fr AND b.tr = a.tr AND b.e <> a.e),
l AS (SELECT DISTINCT d.e FROM d JOIN t ON t.sq = d.sq AND t.fr = d.fr WHERE NOT t.ok AND ({_iou_sql('d', 't')} >= 0.10 OR sqrt(pow((d.x1 + d.x2 - t.x1 - t.x2) / 2.0, 2) + pow((d.y1 + d.y2 - t.y1 - t.y2) / 2.0, 2)) <= 150.0))
SELECT e AS det_id, CASE WHEN fr <= 3 THEN 'seed_initial' WHEN e IN (SELECT e FROM o) THEN 'detection_overlap' WHEN e IN (SELECT e FROM c) THEN 'track_competition' WHEN e IN (SELECT e FROM l) THEN 'lost_reacquisition' END AS reason FROM d""")
def ambiguous_boxes(spark, sf_dir):
    b = views.boxes(spark, sf_dir)
    dets = b.select(*geo.FRAME, F.col("event_id").alias("det_id"), "x1", "y1", "x2", "y2")
    before = b.select("sequence_id", (F.col("frame_index") + 1).alias("frame_index"), "x1", "y1", "x2", "y2", "position_valid")
    return trk.ambiguous(dets, before.filter("position_valid"), before.filter("NOT position_valid")).select("det_id", "reason")


def appearance(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("sequence_id"), F.expr("vec_id div 50").alias("track_id"), F.col("vec_id").alias("obs_no"), F.col("vec_id").alias("frame_index"),
                    F.transform("embedding", lambda v: v.cast("double")).alias("feature"))


@query("appearance_prototypes", "E22", """
WITH RECURSIVE o AS (SELECT label::BIGINT AS s, vec_id // 50 AS t, vec_id AS f, row_number() OVER (PARTITION BY label, vec_id // 50 ORDER BY vec_id) AS n, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
un AS (SELECT s, t, f, n, list_transform(e, lambda v: v / sqrt(list_dot_product(e, e))) AS e FROM o),
wk AS (SELECT s, t, f, n, e, CAST(1 AS BIGINT) AS hits FROM un WHERE n = 1
  UNION ALL SELECT s, t, f, n, list_transform(m, lambda v: v / sqrt(list_dot_product(m, m))), hits FROM (SELECT u.s, u.t, u.f, u.n, CASE WHEN u.f - w.f <= 30 THEN list_transform(list_zip(w.e, u.e), lambda z: 0.9 * z[1] + (1.0 - 0.9) * z[2]) ELSE u.e END AS m, CASE WHEN u.f - w.f <= 30 THEN w.hits + 1 ELSE 1 END AS hits
    FROM wk w JOIN un u ON u.s = w.s AND u.t = w.t AND u.n = w.n + 1))
SELECT s AS sequence_id, t AS track_id, f AS frame_index, hits, round(e[1], 6) AS first FROM wk""")
def appearance_prototypes(spark, sf_dir):
    p = trk.prototypes(appearance(spark, sf_dir))
    return p.select("sequence_id", "track_id", "frame_index", "hits", rounded(F.get("prototype", F.lit(0))).alias("first"))


@query("track_features", "A16", """
WITH o AS (SELECT label::BIGINT AS s, vec_id // 50 AS t, vec_id, embedding FROM embeddings),
l AS (SELECT s, t, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM o), m AS (SELECT s, t, d, quantile_cont(v, 0.5) AS m, count(*) AS crops FROM l GROUP BY 1, 2, 3)
SELECT s AS sequence_id, t AS track_id, max(crops) AS crops, round(max(m) FILTER (d = 1) / sqrt(sum(m * m)), 6) AS first, round(max(m) FILTER (d = 2) / sqrt(sum(m * m)), 6) AS second FROM m GROUP BY 1, 2""")
def track_features(spark, sf_dir):
    f = tm.track_features(appearance(spark, sf_dir))
    return f.select("sequence_id", "track_id", "crops", rounded(F.get("feature", F.lit(0))).alias("first"), rounded(F.get("feature", F.lit(1))).alias("second"))


@query("team_split", "E23")
def team_split(spark, sf_dir):
    return tidy(tm.split_teams(tm.track_features(appearance(spark, sf_dir))))


@query("team_mixture", "E23")
def team_mixture(spark, sf_dir):
    """Split of the tracks by a two-component mixture, from the two-means split."""
    features = cut_lineage(tm.track_features(appearance(spark, sf_dir)), "features")
    return tidy(tm.mixture_teams(features, cut_lineage(tm.split_teams(features), "split")), 4)


@query("team_roles", "E23", """
WITH t AS (SELECT sequence_id, track_id, CASE WHEN (track_id + len(sequence_id)) % 7 = 6 THEN 'UNKNOWN' ELSE any_value(team_label) END AS team, track_id % 4 = 0 AS outlier, avg((x1 + x2) / 2.0) AS u FROM boxes_v GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN team = 'UNKNOWN' THEN 'UNKNOWN' WHEN outlier AND (u <= 384.0 OR u >= 1536.0) THEN 'GOALKEEPER' WHEN outlier THEN 'REFEREE' ELSE 'OUTFIELD_PLAYER' END AS role FROM t)
SELECT sequence_id, track_id, CASE WHEN role = 'REFEREE' THEN 'UNKNOWN' ELSE team END AS team_label, role FROM r""")
def team_roles(spark, sf_dir):
    """Roles of the tracks of every sequence from their place in the image; some tracks stand out, some have no team."""
    boxes = views.boxes(spark, sf_dir)
    tracks = boxes.groupBy("sequence_id", "track_id").agg(F.first("team_label").alias("team"), F.avg((F.col("x1") + F.col("x2")) / 2.0).alias("mean_u"))
    teams = tracks.select("sequence_id", "track_id", F.when((F.col("track_id") + F.length("sequence_id")) % 7 == 6, "UNKNOWN").otherwise(F.col("team")).alias("team_label"), (F.col("track_id") % 4 == 0).alias("outlier"))
    return tm.roles(teams, tracks.select("sequence_id", "track_id", "mean_u")).select("sequence_id", "track_id", "team_label", "role")
