"""Transitions after a turnover: windows before and after, scores, label, phase frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions.bands import near_join
from touchline.operators.geometry import FRAME

WINDOW = 25
MIN_CHANGE_CONF, MEDIUM_CONF, HIGH_CONF = 0.40, 0.45, 0.70
MIN_VISIBLE = 6
COUNTERPRESS, RECOVERY = 0.52, 0.48
FAST_M, SLOW_M = 5.0, 2.0
KEYS = ["sequence_id", "loss_frame", "loss_ts", "losing_team", "gaining_team", "change_conf"]


def confidence_tier(conf: Column) -> Column:
    return F.when(conf >= HIGH_CONF, "HIGH").when(conf >= MEDIUM_CONF, "MEDIUM").otherwise("LOW")


def attacking_response(progress: Column) -> Column:
    return F.when(progress >= FAST_M, "FAST_ATTACK").when(progress <= SLOW_M, "SLOW_BUILDUP").otherwise("AMBIGUOUS")


def scores(f: DataFrame) -> DataFrame:
    """Counter-press and recovery score of the feature columns, and the candidate label."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    c = F.col
    closing = c("closing_post")
    press = 0.50 * unit(c("pressure_post")) + 0.50 * unit((c("pressure_delta") + 0.20) / 0.50)
    near = unit((F.lit(8.0) - c("nearest_post")) / 8.0)
    close = F.when(closing.isNotNull(), 0.45 * near + 0.55 * unit((closing + 1.0) / 5.0)).otherwise(near)
    dense = 0.50 * F.least(F.lit(1.0), c("r3_post") / 2.0) + 0.50 * F.least(F.lit(1.0), c("r5_post") / 3.0)
    converge = 0.50 * unit((-c("centroid_delta") + 1.5) / 3.0) + 0.50 * unit((c("line_velocity") + 1.0) / 2.5)
    counterpress = unit(0.35 * press + 0.25 * close + 0.20 * dense + 0.20 * converge)
    apart = unit((c("nearest_delta") + 1.0) / 4.0)
    separate = F.when(closing.isNotNull(), 0.50 * apart + 0.50 * unit((-closing + 1.0) / 4.0)).otherwise(apart)
    retreat = 0.50 * unit((c("centroid_delta") + 1.0) / 3.0) + 0.50 * unit((-c("line_velocity") + 1.0) / 2.5)
    thin = F.greatest(F.lit(0.0), F.lit(1.0) - (c("r3_post") + c("r5_post")) / 3.0)
    recovery = unit(0.30 * unit((F.lit(0.25) - c("pressure_post")) / 0.25) + 0.30 * retreat + 0.25 * separate + 0.15 * thin)
    df = f.withColumn("counterpress_score", counterpress).withColumn("recovery_score", recovery)
    cp, rec = F.col("counterpress_score"), F.col("recovery_score")
    label = (F.when(c("change_conf") < MEDIUM_CONF, "AMBIGUOUS").when((cp >= COUNTERPRESS) & (cp > rec + 0.10), "COUNTERPRESS_CANDIDATE")
             .when((rec >= RECOVERY) & (rec > cp + 0.08), "DEFENSIVE_RECOVERY_CANDIDATE").otherwise("NEUTRAL_TRANSITION"))
    return df.withColumn("candidate_label", label)


def frame_signals(pressure: DataFrame, blocks: DataFrame, ball: DataFrame, visible: DataFrame) -> DataFrame:
    """One row per frame with everything the windows read; block columns of both teams side by side."""
    sides = blocks.groupBy(*FRAME).agg(*[
        F.max(F.when(F.col("team_label") == t, F.struct("direction", "line_height_m", "depth_m", "width_m", "centroid_to_ball_m"))).alias(t)
        for t in ("TEAM_0", "TEAM_1")])
    return (visible.join(pressure.select(*FRAME, "pressure_index", "d1", "v1", "n_r3", "n_r5", "coverage"), FRAME, "left")
            .join(sides, FRAME, "left").join(ball.filter("ball_valid").select(*FRAME, "ball_x"), FRAME, "left"))


def opens(losing: Column, gaining: Column, conf: Column) -> Column:
    """Whether a change of possession is sure enough to be followed."""
    return (conf >= MIN_CHANGE_CONF) & losing.isin("TEAM_0", "TEAM_1") & gaining.isin("TEAM_0", "TEAM_1") & (losing != gaining)


def transition_events(turnovers: DataFrame, signals: DataFrame) -> DataFrame:
    """Confirmed transitions: each turnover of confidence 0.40 or more with the frames from 25 before to 25 after.

    A turnover with no frame 25 or more after it stays pending and is left out.
    """
    events = turnovers.filter(opens(F.col("losing_team"), F.col("gaining_team"), F.col("change_conf")))
    near = near_join(events, signals, ["sequence_id"], "loss_frame", "frame_index", WINDOW)
    mine = F.when(F.col("losing_team") == "TEAM_0", F.col("TEAM_0")).otherwise(F.col("TEAM_1"))
    theirs = F.when(F.col("gaining_team") == "TEAM_0", F.col("TEAM_0")).otherwise(F.col("TEAM_1"))
    near = near.withColumn("_own", mine).withColumn("_dir", theirs["direction"])
    post = F.col("frame_index") >= F.col("loss_frame")
    after = lambda c: F.when(post, F.col(c))
    before = lambda c: F.when(~post, F.col(c))
    edge = lambda how, c: how(F.col(c), F.when(post & F.col(c).isNotNull(), F.col("frame_index")))
    at = lambda how, c: how(F.col(c), F.when(post, F.col("frame_index")))
    rolled = near.groupBy(*KEYS).agg(
        F.avg(after("visible")).alias("mean_visible"), F.avg(before("pressure_index")).alias("_pp"), F.avg(after("pressure_index")).alias("_pa"),
        F.avg(before("d1")).alias("_dp"), F.avg(after("d1")).alias("_da"), F.avg(after("v1")).alias("closing_post"), F.max(after("v1")).alias("max_closing_post"),
        F.avg(after("n_r3")).alias("_r3"), F.avg(after("n_r5")).alias("_r5"), F.avg(after("coverage")).alias("_cov"),
        F.avg(before("_own.centroid_to_ball_m")).alias("_cp"), F.avg(after("_own.centroid_to_ball_m")).alias("_ca"),
        *[edge(h, f"_own.{c}").alias(f"_{n}_{c}") for c in ("line_height_m", "depth_m", "width_m") for n, h in (("first", F.min_by), ("last", F.max_by))],
        F.count(after("_own.line_height_m")).alias("_lines"), F.count(after("_own.depth_m")).alias("_depths"), F.count(after("_own.width_m")).alias("_widths"),
        (F.max(after("timestamp_s")) - F.min(after("timestamp_s"))).alias("_dt"),
        at(F.min_by, "ball_x").alias("_b0"), at(F.max_by, "ball_x").alias("_b1"), at(F.min_by, "_dir").alias("_way"), F.count(after("visible")).alias("_n"))
    later = (signals.groupBy("sequence_id").agg(F.max("frame_index").alias("_end")))
    return judged(rolled.join(later, "sequence_id").filter(F.col("_end") >= F.col("loss_frame") + WINDOW).drop("_end"))


def judged(rolled: DataFrame) -> DataFrame:
    """Features, scores and labels from the sums of the windows of each turnover."""
    d = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    dt = F.greatest(F.lit(1e-3), F.col("_dt"))
    moving = F.col("_lines") >= 2
    change = lambda c, n: F.when(moving & (F.col(n) >= 2), F.col(f"_last_{c}") - F.col(f"_first_{c}")).otherwise(0.0)
    way = F.when(d("_way", 0) == -1, -1.0).otherwise(1.0)
    feats = rolled.select(
        *KEYS, "mean_visible", d("_pp", 0.05).alias("pressure_pre"), d("_pa", 0.05).alias("pressure_post"), (d("_pa", 0.05) - d("_pp", 0.05)).alias("pressure_delta"),
        d("_dp", 12.0).alias("nearest_pre"), d("_da", 12.0).alias("nearest_post"), (d("_da", 12.0) - d("_dp", 12.0)).alias("nearest_delta"),
        "closing_post", "max_closing_post", d("_r3", 0.0).alias("r3_post"), d("_r5", 0.0).alias("r5_post"), d("_cov", 0.0).alias("coverage_post"),
        (d("_ca", 20.0) - d("_cp", 20.0)).alias("centroid_delta"),
        F.when(moving, (F.col("_last_line_height_m") - F.col("_first_line_height_m")) / dt).otherwise(0.0).alias("line_velocity"),
        change("depth_m", "_depths").alias("depth_delta"), change("width_m", "_widths").alias("width_delta"),
        F.coalesce(F.when(F.col("_n") >= 2, (F.col("_b1") - F.col("_b0")) * way), F.lit(0.0)).alias("ball_progress"))
    seen = F.col("mean_visible") >= MIN_VISIBLE
    out = scores(feats)
    return (out.withColumn("candidate_label", F.when(seen, F.col("candidate_label")).otherwise("NOT_VISIBLE"))
            .withColumn("counterpress_score", F.when(seen, F.col("counterpress_score")).otherwise(0.0))
            .withColumn("recovery_score", F.when(seen, F.col("recovery_score")).otherwise(0.0))
            .withColumn("response", F.when(seen, attacking_response(F.col("ball_progress"))).otherwise("AMBIGUOUS"))
            .withColumn("tier", confidence_tier(F.col("change_conf"))).withColumn("confirm_frame", F.col("loss_frame") + WINDOW))


def post_loss_phases(turnovers: DataFrame) -> DataFrame:
    """Phase of both teams for the 25 frames from each turnover; a later turnover takes over."""
    spread = (turnovers.select("sequence_id", "loss_frame", "losing_team")
              .withColumn("frame_index", F.explode(F.sequence("loss_frame", F.col("loss_frame") + WINDOW - 1))))
    last = spread.groupBy(*FRAME).agg(F.max_by("losing_team", "loss_frame").alias("losing_team"))
    phase = lambda t: F.when(F.col("losing_team") == t, "ATTACK_TO_DEFENSE").otherwise("DEFENSE_TO_ATTACK")
    return last.select(*FRAME, phase("TEAM_0").alias("team_0_phase"), phase("TEAM_1").alias("team_1_phase"))


def quick_turnovers(possession: DataFrame, conf: float = 0.82) -> DataFrame:
    """Turnovers of the quick possession: the holding team differs from the last team that held the ball."""
    from touchline.functions.frames import previous_row

    held = possession.filter(F.col("possession_team").isin("TEAM_0", "TEAM_1"))
    pairs = previous_row(held, ["sequence_id"], "frame_index", ["possession_team"])
    return pairs.filter("prev_possession_team <> possession_team").select(
        "sequence_id", F.col("frame_index").alias("loss_frame"), ((F.col("frame_index") - 1) / F.lit(25.0)).alias("loss_ts"),
        F.col("prev_possession_team").alias("losing_team"), F.col("possession_team").alias("gaining_team"), F.lit(conf).alias("change_conf"))


# ---- one frame after the other ------------------------------------------------------------------------------

_AFTER = {"visible": "mean_visible", "pressure_index": "_pa", "d1": "_da", "v1": "closing_post", "n_r3": "_r3", "n_r5": "_r5", "coverage": "_cov"}
_SHAPE = {"line_height_m": "_lines", "depth_m": "_depths", "width_m": "_widths"}
WINDOW_SCHEMA = ("sequence_id string, loss_frame bigint, loss_ts double, losing_team string, gaining_team string, change_conf double, "
                 + ", ".join(f"{c} double" for c in [*_AFTER.values(), "max_closing_post", "_pp", "_dp", "_cp", "_ca", *[f"_{e}_{c}" for c in _SHAPE for e in ("first", "last")], "_dt", "_b0", "_b1"])
                 + ", " + ", ".join(f"{c} bigint" for c in [*_SHAPE.values(), "_way", "_n"]))


def _known(values) -> list:
    return [v for v in values if v is not None and v == v]


def _mean(values) -> float | None:
    known = _known(values)
    return sum(known) / len(known) if known else None


def window_row(event: dict, rows: list[dict]) -> dict:
    """What the windows before and after one turnover add up to; ``rows`` are its frames in order."""
    before, after = [r for r in rows if r["frame_index"] < event["loss_frame"]], [r for r in rows if r["frame_index"] >= event["loss_frame"]]
    own = [r.get(event["losing_team"]) or {} for r in after]
    way = [(r.get(event["gaining_team"]) or {}).get("direction") for r in after]
    far = lambda part: _mean((r.get(event["losing_team"]) or {}).get("centroid_to_ball_m") for r in part)
    out = {**event, **{name: _mean(r[c] for r in after) for c, name in _AFTER.items()}}
    closing, ball = _known(r["v1"] for r in after), _known(r["ball_x"] for r in after)
    out.update(max_closing_post=max(closing, default=None), _pp=_mean(r["pressure_index"] for r in before), _dp=_mean(r["d1"] for r in before), _cp=far(before), _ca=far(after))
    for c, count in _SHAPE.items():
        known = _known(o.get(c) for o in own)
        out.update({count: len(known), f"_first_{c}": known[0] if known else None, f"_last_{c}": known[-1] if known else None})
    times = _known(r["timestamp_s"] for r in after)
    first, last = (after[0], after[-1]) if after else ({}, {})
    seen = lambda v: v if v is not None and v == v else None
    out.update(_dt=max(times) - min(times) if times else None, _b0=seen(first.get("ball_x")), _b1=seen(last.get("ball_x")), _way=seen(way[0]) if way else None,
               _n=len(_known(r["visible"] for r in after)))
    return out


def transition_step(state: dict, pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    """Follow each turnover until a frame 25 or more after it confirms it. State: the last 25 frames and what is pending."""
    recent, pending, out = list(state.get("recent", [])), list(state.get("pending", [])), []
    for r in pdf.to_dict("records"):
        frame = int(r["frame_index"])
        for p in pending:
            if frame <= p["event"]["loss_frame"] + WINDOW:
                p["rows"].append(r)
        out += [window_row(p["event"], p["rows"]) for p in pending if frame >= p["event"]["loss_frame"] + WINDOW]
        pending = [p for p in pending if frame < p["event"]["loss_frame"] + WINDOW]
        if isinstance(r["losing_team"], str):
            event = {"sequence_id": r["sequence_id"], "loss_frame": frame, **{k: r[k] for k in ("loss_ts", "losing_team", "gaining_team", "change_conf")}}
            pending.append({"event": event, "rows": [*recent, r]})
        recent = [x for x in [*recent, r] if x["frame_index"] > frame - WINDOW]
    names = [c.split()[0] for c in WINDOW_SCHEMA.split(", ")]
    table = pd.DataFrame(out, columns=names)
    for c in (*_SHAPE.values(), "_way", "_n", "loss_frame"):
        table[c] = table[c].astype("Int64")
    return table, {"recent": recent, "pending": pending}
