"""Pass detection: release, flight and reception, one transfer at a time."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.functions import frames
from touchline.functions.scan import CHUNK, scan
from touchline.operators.geometry import FRAME
from touchline.operators.possession import _none

MIN_TRANSIT, MAX_TRANSIT, MAX_LOST, CARRIER_MEMORY = 2, 35, 12, 8
RELEASE_PX, RELEASE_SPEED_PX, RECEIVE_PX, RECEIVE_SPEED_PX = 38.0, 5.0, 28.0, 200.0
SELF_TOUCH_M, MIN_EVENT_CONF, AERIAL_MS = 4.0, 0.35, 25.0
CLEAR_MS, CLEAR_M, CLEAR_PX_S, CLEAR_PX = 16.0, 22.0, 350.0, 200.0

PASS_SCHEMA = ("sequence_id string, event_type string, sender_id bigint, sender_team string, release_frame bigint, release_ts double, "
               "receiver_id bigint, receiver_team string, reception_frame bigint, reception_ts double, flight_frames bigint, image_path_px double, "
               "ground_path_m double, net_m double, mean_ms double, displacement_m double, delta_x double, delta_y double, aerial boolean, event_conf double, end_frame bigint")
_COLUMNS = [c.split()[0] for c in PASS_SCHEMA.split(", ")]


def _length(points: list) -> float:
    return sum(math.dist(a, b) for a, b in zip(points, points[1:]))


def event_confidence(release: float, reception: float, points: int, aerial: bool, sender: str | None, receiver: str | None) -> float:
    """Mean of release, reception, flight and team confidence; a suspected aerial flight weighs 0.85."""
    flight = (0.85 if points >= 3 else 0.50) * (0.85 if aerial else 1.0)
    team = 0.90 if sender not in ("UNKNOWN", None) and receiver not in ("UNKNOWN", None) else 0.40
    return min(1.0, max(0.0, 0.25 * (release + reception + flight + team)))


def confidence_column(release: Column, reception: Column, points: Column, aerial: Column, teams_known: Column) -> Column:
    """``event_confidence`` over columns."""
    flight = F.when(points >= 3, 0.85).otherwise(0.50) * F.when(aerial, 0.85).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.25 * (release + reception + flight + F.when(teams_known, 0.90).otherwise(0.40))))


def _flight(c: dict, now: float) -> dict:
    seconds = max(1e-3, now - c["ts"])
    path = _length(c["px"])
    out = {"image_path_px": path, "px_s": path / seconds, "ground_path_m": None, "net_m": None, "mean_ms": None}
    if c["ground"] and len(c["m"]) >= 2:
        ground = _length(c["m"])
        out.update(ground_path_m=ground, net_m=math.dist(c["m"][0], c["m"][-1]), mean_ms=ground / seconds)
    return out


def _pass_step(state: dict, pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    s = {"ball_px": None, "ball_m": None, "carrier": None, "flying": None, "done_at": None, **state}
    events = []
    for r in pdf.itertuples(index=False):
        frame, now = int(r.frame_index), float(r.timestamp_s)
        u, v, x, y = (_none(z) for z in (r.ball_u, r.ball_v, r.ball_x, r.ball_y))
        ball_px, ball_m = ([u, v] if u is not None else None), ([x, y] if x is not None else None)
        speed_px, aerial = 0.0, False
        if ball_px:
            if s["ball_px"]:
                speed_px = math.dist(ball_px, s["ball_px"][0]) / max(1e-3, now - s["ball_px"][1])
            s["ball_px"] = [ball_px, now]
        if ball_m:
            if s["ball_m"]:
                aerial = math.dist(ball_m, s["ball_m"][0]) / max(1e-3, now - s["ball_m"][1]) > AERIAL_MS
            s["ball_m"] = [ball_m, now]
        men = {int(m["track_id"]): m for m in (r.men if r.men is not None else [])}
        foot = lambda m: [float(m["foot_u"]), float(m["foot_v"])]
        spot = lambda m: None if _none(m["x_m"]) is None else [float(m["x_m"]), float(m["y_m"])]
        carrier = None if _none(r.carrier_id) is None else int(r.carrier_id)
        carrier_team = _none(r.carrier_team) or _none(r.possession_team)
        status, finished, c = r.status, False, s["flying"]
        if c:
            c["age"] += 1
            if ball_px:
                c["px"].append(ball_px)
                c["lost"] = 0
                if ball_m and not aerial:
                    c["m"].append(ball_m)
                elif aerial:
                    c.update(aerial=True, ground=False)
            else:
                c["lost"] += 1
            got = None
            if c["age"] >= MIN_TRANSIT:
                if carrier is not None and carrier_team not in (None, "UNKNOWN"):
                    m = men.get(carrier)
                    got = (carrier, carrier_team, foot(m) if m else None, spot(m) if m else None, 0.85)
                elif ball_px and men:
                    near, who = min((math.dist(ball_px, foot(m)), k) for k, m in men.items())
                    early_self = who == c["sender"] and c["age"] < 5
                    if near < RECEIVE_PX and not early_self:
                        if status != "PROVISIONAL_TRANSIT":
                            got = (who, men[who]["team_label"], foot(men[who]), spot(men[who]), 0.75)
                        elif speed_px < RECEIVE_SPEED_PX or c["age"] >= MAX_TRANSIT - 2:
                            got = (who, men[who]["team_label"], foot(men[who]), spot(men[who]), 0.70)
            if got:
                who, team, at_px, at_m, conf = got
                moved = math.dist(c["from_m"], at_m) if c["from_m"] and at_m else None
                s["flying"] = None
                if who == c["sender"] and (moved is None or moved <= SELF_TOUCH_M):
                    # a dribble touch is no event, but its number is used up
                    events.append((r.sequence_id, "SELF_TOUCH", who, team, c["frame"], c["ts"], *[None] * 12, False, None, frame))
                else:
                    finished = True
                    total = event_confidence(0.85, conf, len(c["px"]), c["aerial"], c["team"], team)
                    kind = "PASS_COMPLETED" if team == c["team"] else "PASS_INTERCEPTED"
                    f = _flight(c, now)
                    events.append((r.sequence_id, kind if total >= MIN_EVENT_CONF else "BALL_RELEASE_UNRESOLVED", c["sender"], c["team"], c["frame"], c["ts"],
                                   who, team, frame, now, c["age"], f["image_path_px"], f["ground_path_m"], f["net_m"], f["mean_ms"], moved,
                                   at_m[0] - c["from_m"][0] if moved is not None else None, at_m[1] - c["from_m"][1] if moved is not None else None, c["aerial"], total, frame))
                    s["carrier"] = {"id": who, "team": team, "frame": frame, "px": at_px, "m": at_m}
                    s["done_at"] = frame
            elif c["age"] >= MAX_TRANSIT or c["lost"] >= MAX_LOST:
                f = _flight(c, now)
                if f["mean_ms"] is not None:
                    clear = f["mean_ms"] >= CLEAR_MS or f["net_m"] >= CLEAR_M
                else:
                    clear = bool(c["from_m"] and c["m"]) and math.dist(c["m"][-1], c["from_m"]) >= CLEAR_M
                clear = clear or f["px_s"] >= CLEAR_PX_S or f["image_path_px"] >= CLEAR_PX
                events.append((r.sequence_id, "CLEARANCE_CANDIDATE" if clear else "BALL_RELEASE_UNRESOLVED", c["sender"], c["team"], c["frame"], c["ts"],
                               None, None, None, None, c["age"], f["image_path_px"], f["ground_path_m"], f["net_m"], f["mean_ms"], None, None, None, c["aerial"], 0.50, frame))
                s.update(flying=None, carrier=None, done_at=frame)
                finished = True
        held = s["carrier"]
        if s["flying"] is None and not finished and held and held["team"] not in (None, "UNKNOWN"):
            rested = s["done_at"] is None or frame - s["done_at"] >= MIN_TRANSIT
            free = carrier != held["id"] or status in ("PROVISIONAL_TRANSIT", "NEUTRAL")
            from_px = held["px"] or (foot(men[held["id"]]) if held["id"] in men else None)
            stuck = bool(from_px and ball_px) and math.dist(ball_px, from_px) < RELEASE_PX and speed_px < RELEASE_SPEED_PX
            if rested and frame - held["frame"] <= CARRIER_MEMORY and free and not stuck:
                at_px, at_m = held["px"] or ball_px or [0.0, 0.0], held["m"] or ball_m
                s["flying"] = {"sender": held["id"], "team": held["team"], "frame": frame, "ts": now, "from_m": at_m, "px": [ball_px or at_px],
                               "m": [p for p in (ball_m or at_m,) if p], "ground": bool(ball_m or at_m), "aerial": False, "age": 1, "lost": 0}
        if carrier is not None and status == "SECURE":
            m = men.get(carrier)
            old = s["carrier"] or {"px": None, "m": None}
            s["carrier"] = {"id": carrier, "team": carrier_team, "frame": frame, "px": foot(m) if m else old["px"], "m": (spot(m) if m else None) or old["m"]}
    out = pd.DataFrame(events, columns=_COLUMNS)
    for c in ("sender_id", "receiver_id", "reception_frame", "release_frame", "flight_frames", "end_frame"):
        out[c] = out[c].astype("Int64")
    for c in ("ground_path_m", "net_m", "mean_ms", "displacement_m", "delta_x", "delta_y", "reception_ts", "event_conf", "image_path_px", "release_ts"):
        out[c] = out[c].astype(float)
    return out, s


def pass_rows(possession: DataFrame, players: DataFrame, ball: DataFrame) -> DataFrame:
    """One row per frame with all that the pass machine reads; ``players`` has boxes and pitch positions, ``ball`` pixel and pitch positions."""
    men = players.filter(~F.upper("role").contains("REFEREE")).groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct(
        "track_id", "team_label", ((F.col("x1") + F.col("x2")) / 2.0).alias("foot_u"), F.col("y2").alias("foot_v"), "x_m", "y_m"))).alias("men"))
    return (possession.select(*FRAME, "timestamp_s", "possession_team", "status", "carrier_id", "carrier_team")
            .join(men, FRAME, "left").join(ball.filter("ball_valid").select(*FRAME, "ball_u", "ball_v", "ball_x", "ball_y"), FRAME, "left"))


def numbered_step(state: dict, pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    """The pass machine with running numbers and the direction of play: its rows also carry ``way_0`` and ``way_1``."""
    out, after = _pass_step(state.get("machine", {}), pdf)
    first = state.get("number", 0)
    out["event_id"] = [f"PEVT_{s}_{first + 1 + i:04d}" for i, s in enumerate(out["sequence_id"])]
    ways = {int(f): (a, b) for f, a, b in zip(pdf["frame_index"], pdf["way_0"], pdf["way_1"])}
    way = [ways[int(f)][0 if t == "TEAM_0" else 1] if t in ("TEAM_0", "TEAM_1") else None for f, t in zip(out["end_frame"], out["sender_team"])]
    out["forward_m"] = [w * d if w and w == w and d is not None and d == d else None for w, d in zip(way, out["delta_x"])]
    out["forward_m"] = out["forward_m"].astype(float)
    return out[out["event_type"] != "SELF_TOUCH"], {"machine": after, "number": first + len(out)}


def detect_passes(possession: DataFrame, players: DataFrame, ball: DataFrame, directions: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Pass events per sequence; ``players`` has boxes and pitch positions, ``ball`` pixel and pitch positions."""
    rows = pass_rows(possession, players, ball)
    events = scan(rows, ["sequence_id"], "frame_index", _pass_step, PASS_SCHEMA, chunk)
    events = (frames.numbered(events, ["sequence_id"], ["end_frame"], "end_frame", "_number")
              .withColumn("event_id", F.format_string("PEVT_%s_%04d", "sequence_id", "_number")).drop("_number").filter("event_type <> 'SELF_TOUCH'"))
    if directions is None:
        return events.withColumn("forward_m", F.lit(None).cast("double"))
    way = directions.select("sequence_id", F.col("team_label").alias("sender_team"), F.col("frame_index").alias("end_frame"), "direction")
    return (events.join(way, ["sequence_id", "sender_team", "end_frame"], "left")
            .withColumn("forward_m", F.when(F.coalesce("direction", F.lit(0)) != 0, F.col("direction") * F.col("delta_x"))).drop("direction"))


def flight_rollup(transfers: DataFrame, ball: DataFrame) -> DataFrame:
    """Path, net displacement and mean speeds of the ball between ``start_frame`` and ``end_frame`` of each transfer."""
    points = ball.filter("ball_valid").select(*FRAME, "timestamp_s", "ball_u", "ball_v", "ball_x", "ball_y")
    inside = (transfers.withColumn("frame_index", F.explode(F.sequence("start_frame", "end_frame"))).join(points, FRAME))
    w = Window.partitionBy("sequence_id", "transfer_id").orderBy("frame_index")
    step = lambda a, b: F.sqrt(F.pow(F.col(a) - F.lag(a).over(w), 2) + F.pow(F.col(b) - F.lag(b).over(w), 2))
    moved = inside.select("*", step("ball_u", "ball_v").alias("_px"), step("ball_x", "ball_y").alias("_m"))
    first, last = lambda c: F.min_by(c, "frame_index"), lambda c: F.max_by(c, "frame_index")
    net = F.sqrt(F.pow(last("ball_x") - first("ball_x"), 2) + F.pow(last("ball_y") - first("ball_y"), 2))
    rolled = moved.groupBy("sequence_id", "transfer_id").agg(
        F.count(F.lit(1)).alias("points"), F.coalesce(F.sum("_px"), F.lit(0.0)).alias("image_path_px"), F.sum("_m").alias("_path"), net.alias("_net"),
        F.greatest(F.lit(1e-3), F.max("timestamp_s") - F.min("timestamp_s")).alias("_dt"),
        F.max(F.col("_m") / 0.04 > AERIAL_MS).alias("_aerial"))
    ground = (F.col("points") >= 2) & ~F.coalesce("_aerial", F.lit(False))
    return rolled.select("sequence_id", "transfer_id", "points", "image_path_px", (F.col("image_path_px") / F.col("_dt")).alias("mean_px_s"),
                         F.when(ground, F.col("_path")).alias("ground_path_m"), F.when(ground, F.col("_net")).alias("net_m"),
                         F.when(ground, F.col("_path") / F.col("_dt")).alias("mean_ms"))
