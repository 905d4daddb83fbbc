"""Ball control and possession: candidate features, scores and the two state machines."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions.scan import CHUNK, scan
from touchline.operators.geometry import FRAME, distance

MAX_NORM_DISTANCE, MAX_METRIC_M = 1.60, 6.0
CONTROL_P, CONTEST_MARGIN, CONTEST_P = 0.42, 0.10, 0.32
CONFIRM_FRAMES, GRACE_FRAMES, OCCLUSION_FRAMES = 2, 15, 12
TEAMS = ("TEAM_0", "TEAM_1")

# Weights of the fallback control score, one per feature, and its bias.
CONTROL_WEIGHTS = {
    "norm_centre": -1.2, "norm_foot": -2.5, "norm_lower": -1.5, "in_box": 1.2, "in_lower": 1.8, "height_ratio": 0.2,
    "ball_conf": 0.5, "metric_dist": -0.8, "metric_valid": 0.4, "rel_speed": -0.2, "closing": 0.2, "persistence": 0.6,
    "was_carrier": 1.5, "since_control": -0.5, "streak": 0.8, "ball_px": -0.4, "ball_ms": -0.2, "player_ms": 0.1,
    "speed_match": 0.5, "track_conf": 0.3, "ball_state": 0.2, "team_conf": 0.4, "calibrated": 0.1, "aerial": -1.0,
}
CONTROL_BIAS = 0.5
HISTORY = ("closing", "persistence", "was_carrier", "since_control", "streak")
STATELESS = [f for f in CONTROL_WEIGHTS if f not in HISTORY]


def control_features(players: DataFrame, ball: DataFrame) -> DataFrame:
    """The stateless features of every player against the seen ball of the frame, clipped as the model expects.

    ``players`` has boxes, pitch position and ``speed``; ``ball`` comes from ``smoothing.ball_speed``.
    """
    b = ball.select(*FRAME, "ball_u", "ball_v", "ball_x", "ball_y", "ball_conf", F.col("speed_ms").alias("b_ms"), F.col("speed_px").alias("b_px"), "aerial")
    df = players.filter(F.col("role") != "REFEREE").join(b, FRAME)
    x1, y1, x2, y2, u, v = [F.col(c) for c in ("x1", "y1", "x2", "y2", "ball_u", "ball_v")]
    height = F.greatest(F.lit(1.0), y2 - y1)
    cx, cy, low = (x1 + x2) / 2.0, (y1 + y2) / 2.0, y1 + 0.70 * height
    outside = lambda value, lo, hi: F.greatest(F.lit(0.0), lo - value, value - hi)
    lower = F.sqrt(F.pow(outside(u, x1, x2), 2) + F.pow(outside(v, low, y2), 2))
    flag = lambda test: F.when(test, 1.0).otherwise(0.0)
    in_x = (u >= x1) & (u <= x2)
    metric = F.when(~F.col("aerial") & F.col("x_m").isNotNull(), distance(F.col("ball_x"), F.col("ball_y"), F.col("x_m"), F.col("y_m")))
    speed = F.coalesce("speed", F.lit(0.0))
    df = df.withColumn("foot_px", distance(u, v, cx, y2)).withColumn("metric_m", metric)
    cap = lambda c, top: F.least(F.lit(top), c)
    return df.select(
        *FRAME, "timestamp_s", "track_id", "team_label", "team_confidence", "foot_px", "metric_m",
        (F.col("foot_px") / height).alias("raw_norm_foot"),
        cap(distance(u, v, cx, cy) / height, 3.0).alias("norm_centre"), cap(F.col("foot_px") / height, 3.0).alias("norm_foot"),
        cap(lower / height, 3.0).alias("norm_lower"), flag(in_x & (v >= y1) & (v <= y2)).alias("in_box"), flag(in_x & (v >= low) & (v <= y2)).alias("in_lower"),
        cap(height / 1080.0, 1.0).alias("height_ratio"), "ball_conf", F.coalesce(cap(F.col("metric_m"), 15.0), F.lit(0.0)).alias("metric_dist"),
        flag(F.col("metric_m").isNotNull()).alias("metric_valid"),
        F.when(F.col("metric_m").isNotNull(), cap(F.abs(speed - F.col("b_ms")), 20.0)).otherwise(0.0).alias("rel_speed"),
        cap(F.col("b_px") / 500.0, 2.0).alias("ball_px"), cap(F.col("b_ms"), 25.0).alias("ball_ms"), cap(speed, 12.0).alias("player_ms"),
        (F.least(speed, F.col("b_ms")) / F.greatest(speed, F.col("b_ms"), F.lit(1.0))).alias("speed_match"),
        F.lit(0.9).alias("track_conf"), F.lit(1.0).alias("ball_state"), F.col("team_confidence").alias("team_conf"), F.lit(1.0).alias("calibrated"),
        flag(F.col("aerial")).alias("aerial"))


def in_reach(features: DataFrame) -> DataFrame:
    return features.filter((F.col("raw_norm_foot") <= MAX_NORM_DISTANCE) | F.coalesce(F.col("metric_m") <= MAX_METRIC_M, F.lit(False)))


def control_score_v1(players: DataFrame, ball: DataFrame) -> DataFrame:
    """First control score: 0.4 foot, 0.3 box and 0.3 pitch nearness, gated by ball and team confidence."""
    b = ball.filter(F.col("ball_conf") >= 0.15).select(*FRAME, "ball_u", "ball_v", "ball_x", "ball_y", "ball_conf", F.col("speed_ms"))
    df = players.filter(~F.upper("role").contains("REFEREE")).join(b, FRAME)
    x1, y1, x2, y2, u, v = [F.col(c) for c in ("x1", "y1", "x2", "y2", "ball_u", "ball_v")]
    height = F.greatest(F.lit(10.0), y2 - y1)
    foot = distance(u, v, (x1 + x2) / 2.0, y2) / height
    off = F.sqrt(F.pow(F.greatest(F.lit(0.0), x1 - u, u - x2), 2) + F.pow(F.greatest(F.lit(0.0), y1 - v, v - y2), 2)) / height
    floor = lambda c: F.greatest(F.lit(0.0), c)
    df = df.withColumn("s_foot", floor(F.lit(1.0) - foot / 0.55)).withColumn("s_box", F.when(off == 0, 1.0).otherwise(floor(F.lit(1.0) - off / 0.50)))
    grounded = (F.col("speed_ms") <= 25.0) & F.col("x_m").isNotNull()
    metric = floor(F.lit(1.0) - distance(F.col("ball_x"), F.col("ball_y"), F.col("x_m"), F.col("y_m")) / 2.50)
    df = df.withColumn("s_metric", F.when(grounded, metric).otherwise((F.col("s_foot") + F.col("s_box")) / 2.0))
    raw = 0.40 * F.col("s_foot") + 0.30 * F.col("s_box") + 0.30 * F.col("s_metric")
    score = raw * F.least(F.lit(1.0), F.col("ball_conf") * 1.5) * F.greatest(F.lit(0.2), F.col("team_confidence"))
    return df.select(*FRAME, "timestamp_s", "track_id", "team_label", "team_confidence", score.alias("score"))


def decide(frames_df: DataFrame, scored: DataFrame, threshold: float, margin: float, runner_up: float) -> DataFrame:
    """Control state per frame from scored candidates; ``frames_df`` has ``ball_seen``.

    UNKNOWN without a ball, FREE_BALL below the threshold, CONTESTED when a rival is close, else CONTROLLED.
    """
    top = scored.groupBy(*FRAME).agg(F.slice(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("s"), "track_id", "team_label", "team_confidence"))), 1, 2).alias("_top"))
    df = frames_df.select(*FRAME, "timestamp_s", "ball_seen").join(top, FRAME, "left")
    first, second = F.get("_top", F.lit(0)), F.get("_top", F.lit(1))
    p1, p2 = -first["s"], -second["s"]
    rival = second.isNotNull() & (second["team_label"] != first["team_label"]) & (p2 >= runner_up) & (p1 - p2 < margin)
    state = (F.when(~F.col("ball_seen"), "UNKNOWN").when(first.isNull() | (p1 < threshold), "FREE_BALL").when(rival, "CONTESTED").otherwise("CONTROLLED"))
    return df.select(*FRAME, "timestamp_s", state.alias("control_state"), first["track_id"].alias("player_id"), first["team_label"].alias("player_team"),
                     first["team_confidence"].alias("player_team_conf"), p1.alias("score"), p2.alias("runner_up_score"))


def heuristic_probability(columns: dict[str, Column]) -> Column:
    logit = F.lit(CONTROL_BIAS)
    for name, weight in CONTROL_WEIGHTS.items():
        logit = logit + F.coalesce(columns[name], F.lit(0.0)) * weight
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-8.0), F.least(F.lit(8.0), logit))))


def advance(state: dict, frame: int, control: str, player: int | None, team: str | None, score: float) -> tuple[dict, dict | None]:
    """One frame of the possession machine.  Returns the new state and a turnover, if one is confirmed."""
    s = {"team": "UNKNOWN", "status": "UNKNOWN", "conf": 0.0, "carrier": None, "carrier_team": None, "pending": None, "run": 0,
         "free": 0, "hidden": 0, "last_team": None, **state}
    if control == "UNKNOWN":
        s["hidden"] += 1
        if s["hidden"] > OCCLUSION_FRAMES:
            s.update(team="UNKNOWN", status="UNKNOWN", carrier=None)
        return s, None
    s["hidden"] = 0
    turnover = None
    if control == "CONTROLLED":
        s["free"] = 0
        s["run"] = s["run"] + 1 if player == s["pending"] else 1
        s["pending"] = player
        if s["run"] >= CONFIRM_FRAMES:
            before = s["carrier"]
            s.update(carrier=player, carrier_team=team)
            if team in TEAMS:
                if s["team"] in TEAMS and s["team"] != team:
                    turnover = {"from_team": s["team"], "to_team": team, "from_player": before, "to_player": player, "delay": s["run"], "conf": score}
                s.update(team=team, status="SECURE", conf=score, last_team=team)
    elif control == "CONTESTED":
        s.update(free=0, status="CONTESTED", team="CONTESTED", carrier=None, conf=0.65)
    else:
        s["free"] += 1
        s["carrier"] = None
        if s["free"] <= GRACE_FRAMES and s["last_team"] in TEAMS:
            s.update(team=s["last_team"], status="PROVISIONAL_TRANSIT", conf=max(0.35, 0.70 - s["free"] / GRACE_FRAMES * 0.35))
        else:
            s.update(team="NEUTRAL", status="NEUTRAL", conf=0.50)
    return s, turnover


POSSESSION_SCHEMA = ("sequence_id string, frame_index bigint, timestamp_s double, control_state string, possession_team string, status string, "
                     "possession_conf double, carrier_id bigint, carrier_team string, free_age bigint, hidden_age bigint, from_team string, to_team string, "
                     "from_player bigint, to_player bigint, turnover_conf double")
_NAMES = [c.split()[0] for c in POSSESSION_SCHEMA.split(", ")]


def _row(seq, frame, ts, control, s, t) -> tuple:
    t = t or {}
    return (seq, frame, ts, control, s["team"], s["status"], s["conf"], s["carrier"], s["carrier_team"], s["free"], s["hidden"],
            t.get("from_team"), t.get("to_team"), t.get("from_player"), t.get("to_player"), t.get("conf"))


def _table(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for c in ("carrier_id", "from_player", "to_player", "player_id"):
        if c in out:
            out[c] = out[c].astype("Int64")
    return out


def _none(value):
    return None if value is None or (isinstance(value, float) and math.isnan(value)) or value is pd.NA else value


def _machine_step(state: dict, pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    rows, s = [], state
    for r in pdf.itertuples(index=False):
        player = _none(r.player_id)
        s, turnover = advance(s, r.frame_index, r.control_state, None if player is None else int(player), _none(r.player_team), _none(r.score) or 0.0)
        rows.append(_row(r.sequence_id, r.frame_index, r.timestamp_s, r.control_state, s, turnover))
    return _table(rows, _NAMES), s


def possession_machine(control: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Possession per frame from control states (second machine), with the turnover of the frame if there is one."""
    rows = control.select(*FRAME, "timestamp_s", "control_state", "player_id", "player_team", "score")
    return scan(rows, ["sequence_id"], "frame_index", _machine_step, POSSESSION_SCHEMA, chunk)


def _advance_v1(state: dict, control: str, player: int | None, team: str | None, team_conf: float, score: float, contest_conf: float) -> tuple[dict, dict, dict | None]:
    """One frame of the first machine: (state, what the frame shows, turnover)."""
    s = {"conf": 0.0, "active": None, "active_team": None, "run": 0, "last_team": None, "last_player": None, "free": 0, "hidden": 0, "rival": None, "rival_run": 0, **state}
    show = lambda t, st, c, who=None, who_team=None: {"team": t, "status": st, "conf": c, "carrier": who, "carrier_team": who_team, "free": s["free"], "hidden": s["hidden"]}
    if control == "UNKNOWN":
        s["hidden"] += 1
        if s["hidden"] <= OCCLUSION_FRAMES and s["last_team"] is not None:
            return s, show(s["last_team"], "PROVISIONAL_TRANSIT", s["conf"] * max(0.2, 1.0 - s["hidden"] / OCCLUSION_FRAMES * 0.7), None, s["last_team"]), None
        s["conf"] = 0.0
        return s, show("UNKNOWN", "UNKNOWN", 0.0), None
    s["hidden"] = 0
    if control == "CONTESTED":
        s.update(conf=contest_conf, rival=None, rival_run=0)
        return s, {**show("CONTESTED", "CONTESTED", contest_conf, player, "CONTESTED"), "free": 0}, None
    if control == "FREE_BALL":
        s.update(free=s["free"] + 1, rival=None, rival_run=0)
        if s["free"] <= GRACE_FRAMES and s["last_team"] is not None:
            s["conf"] *= max(0.3, 1.0 - s["free"] / GRACE_FRAMES * 0.6)
            return s, show(s["last_team"], "PROVISIONAL_TRANSIT", s["conf"]), None
        s["conf"] = 0.0
        return s, show("NEUTRAL", "NEUTRAL", 0.0), None
    s["free"] = 0
    if team_conf < 0.45 or team not in TEAMS:
        return s, show("UNKNOWN", "UNKNOWN", 0.30, player, "UNKNOWN"), None
    if player == s["active"]:
        s["run"] += 1
    elif team == s["active_team"]:
        s.update(active=player, run=min(s["run"] + 1, 3))
    else:
        s.update(active=player, active_team=team, run=1)
    sure, turnover = s["run"] >= 3, None
    now = (s.get("team", "UNKNOWN"), s.get("status", "UNKNOWN"))
    if s["last_team"] is None:
        if sure:
            now = (team, "SECURE")
            s.update(conf=score, last_team=team, last_player=player)
    elif team == s["last_team"]:
        now = (team, "SECURE")
        s.update(conf=score, last_player=player, rival=None, rival_run=0)
    else:
        s["rival_run"] = s["rival_run"] + 1 if s["rival"] == team else 1
        s["rival"] = team
        if s["rival_run"] >= 5 and sure:
            turnover = {"from_team": s["last_team"], "to_team": team, "from_player": s["last_player"], "to_player": player, "conf": score * 0.90}
            now = (team, "SECURE")
            s.update(conf=score, last_team=team, last_player=player, rival=None, rival_run=0)
        else:
            now = (s["last_team"], "PROVISIONAL_TRANSIT")
            s["conf"] *= 0.70
    return s, show(*now, s["conf"], player if sure else None, team if sure else None), turnover


def _machine_v1_step(state: dict, pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    rows, s = [], state
    for r in pdf.itertuples(index=False):
        player, score, runner = _none(r.player_id), _none(r.score) or 0.0, _none(r.runner_up_score)
        contest = (score + runner) / 2.0 if runner is not None else score
        s, seen, turnover = _advance_v1(s, r.control_state, None if player is None else int(player), _none(r.player_team),
                                        _none(r.player_team_conf) or 0.0, score, contest)
        s.update(team=seen["team"], status=seen["status"]) if r.control_state != "CONTROLLED" or seen["carrier_team"] != "UNKNOWN" else None
        rows.append(_row(r.sequence_id, r.frame_index, r.timestamp_s, r.control_state, seen, turnover))
    return _table(rows, _NAMES), s


def possession_machine_v1(control: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """First machine: three frames confirm a carrier, five frames of a rival a turnover; confidence decays in transit."""
    rows = control.select(*FRAME, "timestamp_s", "control_state", "player_id", "player_team", "player_team_conf", "score", "runner_up_score")
    return scan(rows, ["sequence_id"], "frame_index", _machine_v1_step, POSSESSION_SCHEMA, chunk)


PERSIST_FRAMES, LAST_FRAMES = 25, 50


def _control_step(state: dict, pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    """History features, fallback score, control decision and possession, frame by frame.

    The history depends on the decision of the frame before, so it cannot be a window.
    """
    mem = {"persist": {}, "last": {}, "streak": {}, "carrier": None, "dist": {}, **state.get("memory", {})}
    machine, rows = state.get("machine", {}), []
    fixed = [(STATELESS.index(f), CONTROL_WEIGHTS[f]) for f in STATELESS]
    for r in pdf.itertuples(index=False):
        control, player, team, score = "UNKNOWN", None, None, 0.0
        if r.ball_seen:
            ranked, active = [], set()
            for c in (r.men if r.men is not None else []):
                tid = str(c["track_id"])
                active.add(tid)
                closing = 0.0
                metric = _none(c["metric_m"])
                if metric is not None:
                    if tid in mem["dist"]:
                        closing = (mem["dist"][tid] - metric) / 0.04
                    mem["dist"][tid] = float(metric)
                if int(r.frame_index) >= c["until"]:
                    mem["dist"].pop(tid, None)  # the track does not come again, so nothing can ask for it
                if c["raw_norm_foot"] > MAX_NORM_DISTANCE and (metric is None or metric > MAX_METRIC_M):
                    continue
                mem["persist"][tid] = min(PERSIST_FRAMES, mem["persist"].get(tid, 0) + 1)
                history = {"closing": max(-15.0, min(15.0, closing)), "persistence": mem["persist"][tid] / PERSIST_FRAMES,
                           "was_carrier": 1.0 if tid == mem["carrier"] else 0.0,
                           "since_control": min(1.0, (int(r.frame_index) - mem["last"].get(tid, -999)) / LAST_FRAMES),
                           "streak": mem["streak"].get(tid, 0) / PERSIST_FRAMES}
                logit = CONTROL_BIAS + sum(w * c["features"][i] for i, w in fixed) + sum(CONTROL_WEIGHTS[k] * v for k, v in history.items())
                ranked.append((1.0 / (1.0 + math.exp(-max(-8.0, min(8.0, logit)))), int(c["track_id"]), c["team_label"]))
            for tid in [t for t in mem["persist"] if t not in active]:
                del mem["persist"][tid]
                mem["dist"].pop(tid, None)
            ranked.sort(key=lambda x: -x[0])
            control = "FREE_BALL"
            if ranked:
                score, player, team = ranked[0]
                second = ranked[1] if len(ranked) > 1 else None
                carrier = None
                if score >= CONTROL_P:
                    rival = second is not None and second[2] != team and second[0] >= CONTEST_P and score - second[0] < CONTEST_MARGIN
                    control = "CONTESTED" if rival else "CONTROLLED"
                    carrier = None if rival else str(player)
                mem["carrier"] = carrier
                if carrier is None:
                    mem["streak"] = {}
                else:
                    # no feature sees beyond these spans, so the state forgets there and chunks agree soon
                    mem["last"] = {t: f for t, f in mem["last"].items() if r.frame_index - f < LAST_FRAMES} | {carrier: int(r.frame_index)}
                    mem["streak"] = {carrier: min(PERSIST_FRAMES, mem["streak"].get(carrier, 0) + 1)}
        machine, turnover = advance(machine, r.frame_index, control, player, team, score)
        rows.append(_row(r.sequence_id, r.frame_index, r.timestamp_s, control, machine, turnover))
    return _table(rows, _NAMES), {"memory": mem, "machine": machine}


def possession_v2(frames_df: DataFrame, features: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Full control estimator and possession machine; ``frames_df`` has one row per frame with ``ball_seen``."""
    # a track's last frame goes with it, so that the state can forget it there and chunks agree soon
    until = features.groupBy("sequence_id", "track_id").agg(F.max("frame_index").alias("until"))
    men = features.join(until, ["sequence_id", "track_id"]).groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct(
        "track_id", "team_label", "metric_m", "raw_norm_foot", F.array(*[F.col(f).cast("double") for f in STATELESS]).alias("features"), "until"))).alias("men"))
    rows = frames_df.select(*FRAME, "timestamp_s", "ball_seen").join(men, FRAME, "left")
    return scan(rows, ["sequence_id"], "frame_index", _control_step, POSSESSION_SCHEMA, chunk)


def turnovers(possession: DataFrame) -> DataFrame:
    return (possession.filter("from_team IS NOT NULL")
            .select("sequence_id", F.col("frame_index").alias("loss_frame"), F.col("timestamp_s").alias("loss_ts"),
                    F.col("from_team").alias("losing_team"), F.col("to_team").alias("gaining_team"), F.col("turnover_conf").alias("change_conf")))
