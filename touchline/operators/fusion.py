"""Fusion: confidence, quality, episodes, event ingest, links, timeline, team aggregates and summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.functions import frames
from touchline.functions.bands import near_join, overlap_join
from touchline.functions.scan import CHUNK, scan
from touchline.operators.geometry import FRAME

FPS = 25.0
ENTER, EXIT, MIN_PRESSURE_FRAMES = 0.45, 0.25, 8
MIN_BLOCK_FRAMES = 12
LEVEL_1, LEVEL_2, LEVEL_3 = "LEVEL_1_PHYSICAL_FACT", "LEVEL_2_STRUCTURAL_INFERENCE", "LEVEL_3_TACTICAL_CANDIDATE"
LEVEL_3_CEILING = 0.85
EVENT_COLUMNS = ["sequence_id", "event_id", "start_frame", "end_frame", "start_ts", "end_ts", "family", "level", "subject_team", "opponent_team",
                 "confidence", "quality", "calibration", "visibility", "metrics", "limitations", "conflict"]


def propagate(base: Column, upstream: Column | None, level: str, calibrated: Column, visible: Column,
              conflict: Column | None = None, stable: Column | None = None) -> Column:
    """Base score times the quality penalties, never above the weakest source, nor above 0.85 for a candidate."""
    penalty = F.when(calibrated, 1.0).otherwise(0.40) * F.when(visible >= 8, 1.0).when(visible >= 6, 0.85).when(visible >= 4, 0.65).otherwise(0.30)
    if conflict is not None:
        penalty = penalty * F.when(conflict, 0.60).otherwise(1.0)
    if stable is not None:
        penalty = penalty * F.when(stable, 1.0).otherwise(0.80)
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    limits = [unit(base * penalty)] + ([upstream] if upstream is not None else []) + ([F.lit(LEVEL_3_CEILING)] if level == LEVEL_3 else [])
    return unit(F.least(*limits)) if len(limits) > 1 else limits[0]


def quality(calibration: Column, visible: Column, conflict: Column | None = None, stable: Column | None = None, carrier: Column | None = None) -> Column:
    conflict = F.lit(False) if conflict is None else conflict
    stable = F.lit(True) if stable is None else stable
    carrier = F.lit(1.0) if carrier is None else carrier
    state = F.upper(calibration)
    return (F.when(state.isin("INVALID", "UNAVAILABLE") | (visible < 4), "INVALID")
            .when((state != "VALID") | (visible < 6) | conflict | (carrier < 0.35), "LOW")
            .when(visible.isin(6, 7) | ~stable | (carrier < 0.60), "MEDIUM").otherwise("HIGH"))


def visibility(visible: Column) -> Column:
    return F.when(visible >= 8, "HIGH").when(visible >= 6, "MEDIUM").otherwise("LOW")


def tier_confidence(text: Column) -> Column:
    return F.when(F.upper(text) == "HIGH", 0.85).when(F.upper(text) == "MEDIUM", 0.65).when(F.upper(text) == "LOW", 0.40).otherwise(0.50)


def rounded_product(c: Column, places: int) -> Column:
    """Half away from zero on the binary product with 10^places, as the SQL rounds; ``F.round`` takes the shortest decimal text, which lifts -4.645 to -4.65."""
    scale = F.lit(10.0 ** places)
    return F.round(c * scale) / scale


def _num(c: Column, places: int) -> Column:
    return rounded_product(c, places).cast("string")


# ---- episodes -----------------------------------------------------------------------------------------------

def _pressure_step(state: dict, pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    start, starts, closes = state.get("start"), [], []
    for frame, p in zip(pdf["frame_index"], pdf["pressure_index"]):
        if start is None and p >= ENTER:
            start = int(frame)
            starts.append(start)
            closes.append(False)
        elif start is not None:
            starts.append(start)
            closes.append(bool(p < EXIT))
            if p < EXIT:
                start = None
        else:
            starts.append(None)
            closes.append(False)
    return pdf.assign(start_frame=pd.array(starts, dtype="Int64"), closes=closes), {"start": start}


def sequence_ends(frames_df: DataFrame) -> DataFrame:
    return frames_df.groupBy("sequence_id").agg(F.max("frame_index").alias("last_frame"), F.max("timestamp_s").alias("last_ts"))


def pressure_episodes(pressure: DataFrame, visible: DataFrame, ends: DataFrame, possession: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Episodes of a defending team: from 0.45 up, until under 0.25, that frame included; at least 8 frames long.

    Frames in which the team does not defend are skipped; the end of the sequence closes what is open.
    """
    keys = ["sequence_id", "defending_team"]
    rows = pressure.filter(F.col("defending_team").isin("TEAM_0", "TEAM_1")).select(
        *keys, "frame_index", "timestamp_s", "pressure_index", "target_team", "d1", "max_closing")
    marked = scan(rows, keys, "frame_index", _pressure_step,
                  "sequence_id string, defending_team string, frame_index bigint, timestamp_s double, pressure_index double, target_team string, "
                  "d1 double, max_closing double, start_frame bigint, closes boolean", chunk).filter("start_frame IS NOT NULL")
    vis = visible.select(*FRAME, F.col("team_label").alias("defending_team"), F.col("players").alias("_vis"))
    joined = marked.join(vis, [*FRAME, "defending_team"], "left")
    if possession is not None:
        joined = joined.join(possession.select(*FRAME, "possession_team"), FRAME, "left")
    else:
        joined = joined.withColumn("possession_team", F.lit(None).cast("string"))
    d1, closing = [F.when(~F.isnan(c), F.col(c)) for c in ("d1", "max_closing")]
    rolled = joined.groupBy(*keys, "start_frame").agg(
        F.min("timestamp_s").alias("start_ts"), F.max(F.struct("frame_index", "timestamp_s", "closes", "target_team", "possession_team")).alias("_last"),
        F.min_by("target_team", "frame_index").alias("opponent_team"), F.avg("pressure_index").alias("mean_pressure"), F.max("pressure_index").alias("peak_pressure"),
        F.coalesce(F.min(d1), F.lit(0.0)).alias("nearest_m"), F.coalesce(F.max(closing), F.lit(0.0)).alias("closing_mps"),
        F.floor(F.avg(F.coalesce("_vis", F.lit(1)))).cast("int").alias("visible"))
    df = rolled.join(ends, "sequence_id")
    closed = F.col("_last.closes")
    df = (df.withColumn("end_frame", F.when(closed, F.col("_last.frame_index")).otherwise(F.col("last_frame")))
          .withColumn("end_ts", F.when(closed, F.col("_last.timestamp_s")).otherwise(F.col("last_ts"))))
    return pressure_evidence(df.select("*", closed.alias("closed"), F.col("_last.possession_team").alias("holder"), F.col("_last.target_team").alias("target")))


def pressure_evidence(df: DataFrame) -> DataFrame:
    """Evidence events of rolled-up pressure episodes that last long enough."""
    df = df.withColumn("duration", F.col("end_frame") - F.col("start_frame") + 1).filter(F.col("duration") >= MIN_PRESSURE_FRAMES)
    yes = F.lit(True)
    closed, holder, target = F.col("closed"), F.col("holder"), F.col("target")
    clash = F.coalesce(closed & (holder != "UNKNOWN") & (target != "UNKNOWN") & holder.isin("TEAM_0", "TEAM_1") & (holder != target), F.lit(False))
    df = (df.withColumn("conflict", clash).withColumn("confidence", propagate(F.col("mean_pressure"), F.lit(0.90), LEVEL_1, yes, F.col("visible")))
          .withColumn("quality", quality(F.lit("VALID"), F.col("visible"))))
    return df.select(
        "sequence_id", F.format_string("press_%d_%d_%s", "start_frame", "end_frame", "defending_team").alias("event_id"), "start_frame", "end_frame", "start_ts", "end_ts",
        F.lit("PRESSURE_EPISODE").alias("family"), F.lit(LEVEL_1).alias("level"), F.col("defending_team").alias("subject_team"), "opponent_team",
        F.when(F.col("conflict"), F.col("confidence") * 0.60).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("conflict") & (F.col("quality") == "HIGH"), "MEDIUM").otherwise(F.col("quality")).alias("quality"), F.lit("VALID").alias("calibration"),
        visibility(F.col("visible")).alias("visibility"),
        F.create_map(F.lit("mean_pressure_index"), _num(F.col("mean_pressure"), 3), F.lit("peak_pressure_index"), _num(F.col("peak_pressure"), 3),
                     F.lit("duration_frames"), F.col("duration").cast("string"), F.lit("nearest_defender_min_m"), _num(F.col("nearest_m"), 2),
                     F.lit("max_closing_speed_mps"), _num(F.col("closing_mps"), 2)).alias("metrics"),
        F.when(F.col("conflict"), F.array(F.concat(F.lit("CONFLICT: possession is with "), holder, F.lit(", the pressure target with "), target)))
        .otherwise(F.array().cast("array<string>")).alias("limitations"), "conflict")


EPISODE_SCHEMA = ("sequence_id string, defending_team string, start_frame bigint, end_frame bigint, start_ts double, end_ts double, closed boolean, holder string, target string, "
                  "opponent_team string, mean_pressure double, peak_pressure double, nearest_m double, closing_mps double, visible int")


def _episode(e: dict, frame: int, ts: float, closed: bool) -> dict:
    known = lambda v: v is not None and v == v
    near, closing = [v for v in e["d1"] if known(v)], [v for v in e["closing"] if known(v)]
    return {"sequence_id": e["sequence_id"], "defending_team": e["defending_team"], "start_frame": e["start"], "end_frame": frame, "start_ts": e["start_ts"], "end_ts": ts, "closed": closed,
            "holder": e["holder"], "target": e["target"], "opponent_team": e["opponent"], "mean_pressure": e["sum"] / e["n"], "peak_pressure": e["peak"],
            "nearest_m": min(near, default=0.0), "closing_mps": max(closing, default=0.0), "visible": int(e["seen"] // e["n"])}


def episode_step(state: dict, pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    """Pressure episodes as they close. Rows are all frames of a sequence for a team; pressure is null where it does not defend."""
    e, last, out = state.get("open"), state.get("last"), []
    text = lambda v: v if isinstance(v, str) else None
    for r in pdf.itertuples(index=False):
        frame, ts, p = int(r.frame_index), float(r.timestamp_s), r.pressure_index
        last = [frame, ts]
        if p is None or p != p or (e is None and p < ENTER):
            continue
        if e is None:
            e = {"sequence_id": r.sequence_id, "defending_team": r.defending_team, "start": frame, "start_ts": ts, "opponent": text(r.target_team), "sum": 0.0, "n": 0, "peak": 0.0, "seen": 0,
                 "d1": [], "closing": []}
            fresh = True
        else:
            fresh = False
        seen = 1 if r.players is None or r.players != r.players else int(r.players)
        low = [v for v in [*e["d1"], r.d1] if v is not None and v == v]
        high = [v for v in [*e["closing"], r.max_closing] if v is not None and v == v]
        e.update(sum=e["sum"] + p, n=e["n"] + 1, peak=max(e["peak"], p) if e["n"] else p, seen=e["seen"] + seen, d1=[min(low)] if low else [], closing=[max(high)] if high else [],
                 holder=text(r.possession_team), target=text(r.target_team))
        if not fresh and p < EXIT:
            out.append(_episode(e, frame, ts, True))
            e = None
    return pd.DataFrame(out, columns=[c.split()[0] for c in EPISODE_SCHEMA.split(", ")]), {"open": e, "last": last}


def episode_finish(state: dict, key: tuple) -> pd.DataFrame | None:
    """The end of the sequence closes what is open."""
    return pd.DataFrame([_episode(state["open"], *state["last"], False)]) if state.get("open") else None


def audit(events: DataFrame, possession_team: str, target_team: str) -> DataFrame:
    """Flag events whose possession and pressure target disagree: confidence x 0.6, HIGH becomes MEDIUM."""
    a, b = F.col(possession_team), F.col(target_team)
    clash = F.coalesce(F.col("family").isin("POST_LOSS_ENGAGEMENT", "PRESSURE_EPISODE") & (a != "UNKNOWN") & (b != "UNKNOWN") & (a != b), F.lit(False))
    note = F.concat(F.lit("CONFLICT: possession is with "), a, F.lit(", the pressure target with "), b)
    return (events.withColumn("conflict", F.col("conflict") | clash)
            .withColumn("confidence", F.when(clash, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") * 0.60))).otherwise(F.col("confidence")))
            .withColumn("quality", F.when(clash & (F.col("quality") == "HIGH"), "MEDIUM").otherwise(F.col("quality")))
            .withColumn("limitations", F.when(clash, F.array_append("limitations", note)).otherwise(F.col("limitations"))))


def _leaves(held: str, height: float) -> bool:
    if held == "LOW_BLOCK":
        return height > 37.0
    if held == "MID_BLOCK":
        return height < 33.0 or height > 54.5
    return held == "HIGH_BLOCK" and height < 50.5


def _block_step(state: dict, pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    start, held, rows = state.get("start"), state.get("held"), []
    for r in pdf.itertuples(index=False):
        lost = r.line_height_m is None or pd.isna(r.line_height_m) or r.category in ("UNKNOWN", "AMBIGUOUS")
        if start is not None and (lost or (r.category != held and _leaves(held, r.line_height_m))):
            rows.append((r, start, held, True))
            start = None
        if not lost:
            if start is None:
                start, held = int(r.frame_index), r.category
            rows.append((r, start, held, False))
    out = pd.DataFrame([(r.sequence_id, r.team_label, r.frame_index, r.timestamp_s, r.line_height_m, r.centroid_height_m, r.depth_m, r.width_m, r.players, s, h, c)
                        for r, s, h, c in rows],
                       columns=["sequence_id", "team_label", "frame_index", "timestamp_s", "line_height_m", "centroid_height_m", "depth_m", "width_m", "players",
                                "start_frame", "held", "closing"])
    return out, {"start": start, "held": held}


def block_episode_rows(blocks: DataFrame, ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Episodes of one block height, 12 frames or longer; a change must pass its limit by 2 m."""
    keys = ["sequence_id", "team_label"]
    marked = scan(blocks.select(*keys, "frame_index", "timestamp_s", "category", "line_height_m", "centroid_height_m", "depth_m", "width_m", "players"),
                  keys, "frame_index", _block_step,
                  "sequence_id string, team_label string, frame_index bigint, timestamp_s double, line_height_m double, centroid_height_m double, depth_m double, "
                  "width_m double, players bigint, start_frame bigint, held string, closing boolean", chunk)
    inside = lambda c: F.when(~F.col("closing"), F.when(~F.isnan(c), F.col(c)))
    shut = lambda c: F.max(F.when(F.col("closing"), F.col(c)))
    rolled = marked.groupBy(*keys, "start_frame", "held").agg(
        F.min("timestamp_s").alias("start_ts"), shut("frame_index").alias("_shut"), shut("timestamp_s").alias("_shut_ts"),
        F.avg(inside("line_height_m")).alias("height"), F.avg(inside("centroid_height_m")).alias("_centroid"), F.avg(inside("depth_m")).alias("_depth"),
        F.avg(inside("width_m")).alias("_width"), F.floor(F.avg(F.when(~F.col("closing"), F.col("players")))).cast("int").alias("visible"))
    df = rolled.join(ends, "sequence_id")
    df = (df.withColumn("end_frame", F.coalesce(F.col("_shut") - 1, F.col("last_frame"))).withColumn("end_ts", F.coalesce("_shut_ts", "last_ts"))
          .withColumn("duration", F.col("end_frame") - F.col("start_frame") + 1).filter(F.col("duration") >= MIN_BLOCK_FRAMES))
    return df


def block_episodes(blocks: DataFrame, ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Block episodes as evidence events."""
    df = block_episode_rows(blocks, ends, chunk)
    zero = F.lit(0.0)
    return df.select(
        "sequence_id", F.format_string("block_%d_%d_%s", "start_frame", "end_frame", "held").alias("event_id"), "start_frame", "end_frame", "start_ts", "end_ts",
        F.lit("BLOCK_STATE").alias("family"), F.lit(LEVEL_2).alias("level"), F.col("team_label").alias("subject_team"), F.lit(None).cast("string").alias("opponent_team"),
        propagate(F.lit(0.88), F.lit(0.90), LEVEL_2, F.lit(True), F.col("visible")).alias("confidence"), quality(F.lit("VALID"), F.col("visible")).alias("quality"),
        F.lit("VALID").alias("calibration"), visibility(F.col("visible")).alias("visibility"),
        F.create_map(F.lit("block_category"), F.col("held"), F.lit("mean_defensive_line_height_m"), _num(F.col("height"), 2),
                     F.lit("mean_centroid_height_m"), _num(F.coalesce("_centroid", "height"), 2), F.lit("mean_depth_m"), _num(F.coalesce("_depth", zero), 2),
                     F.lit("mean_width_m"), _num(F.coalesce("_width", zero), 2), F.lit("duration_frames"), F.col("duration").cast("string")).alias("metrics"),
        F.array().cast("array<string>").alias("limitations"), F.lit(False).alias("conflict"))


# ---- ingest -------------------------------------------------------------------------------------------------

def possession_changes(turnovers: DataFrame, visible: Column | None = None) -> DataFrame:
    v = F.lit(10) if visible is None else visible
    conf = F.col("change_conf")
    return turnovers.select(
        "sequence_id", F.format_string("poss_change_%d_%s_to_%s", "loss_frame", "losing_team", "gaining_team").alias("event_id"),
        F.col("loss_frame").alias("start_frame"), F.col("loss_frame").alias("end_frame"), F.col("loss_ts").alias("start_ts"), F.col("loss_ts").alias("end_ts"),
        F.lit("POSSESSION_CHANGE").alias("family"), F.lit(LEVEL_1).alias("level"), F.col("losing_team").alias("subject_team"), F.col("gaining_team").alias("opponent_team"),
        propagate(conf, conf, LEVEL_1, F.lit(True), v).alias("confidence"), quality(F.lit("VALID"), v).alias("quality"), F.lit("VALID").alias("calibration"),
        visibility(v).alias("visibility"), F.create_map(F.lit("losing_team"), F.col("losing_team"), F.lit("gaining_team"), F.col("gaining_team")).alias("metrics"),
        F.array().cast("array<string>").alias("limitations"), F.lit(False).alias("conflict"))


def transition_evidence(transitions: DataFrame, visible: Column | None = None) -> DataFrame:
    v = F.lit(10) if visible is None else visible
    cp, rec, label = F.col("counterpress_score"), F.col("recovery_score"), F.col("candidate_label")
    retreat = label == "DEFENSIVE_RECOVERY_CANDIDATE"
    base = F.when(label == "COUNTERPRESS_CANDIDATE", cp).when(retreat, rec).otherwise(F.greatest(cp, rec, F.lit(0.40)))
    metric = lambda name, col, places: [F.lit(name), _num(F.col(col), places)]
    return transitions.select(
        "sequence_id", F.format_string("trans_%d_%d_%s_%s", "loss_frame", "confirm_frame", "losing_team", "candidate_label").alias("event_id"),
        F.col("loss_frame").alias("start_frame"), F.col("confirm_frame").alias("end_frame"), F.col("loss_ts").alias("start_ts"), (F.col("confirm_frame") / FPS).alias("end_ts"),
        F.when(retreat, "DEFENSIVE_RECOVERY").otherwise("POST_LOSS_ENGAGEMENT").alias("family"), F.lit(LEVEL_3).alias("level"),
        F.col("losing_team").alias("subject_team"), F.col("gaining_team").alias("opponent_team"),
        propagate(base, F.col("change_conf"), LEVEL_3, F.lit(True), v).alias("confidence"), quality(F.lit("VALID"), v).alias("quality"), F.lit("VALID").alias("calibration"),
        visibility(v).alias("visibility"),
        F.create_map(F.lit("candidate_label"), label, *metric("counterpress_score", "counterpress_score", 3), *metric("recovery_score", "recovery_score", 3),
                     *metric("pressure_pre_mean", "pressure_pre", 3), *metric("pressure_post_mean", "pressure_post", 3),
                     *metric("nearest_defender_pre", "nearest_pre", 2), *metric("nearest_defender_post", "nearest_post", 2),
                     *metric("centroid_ball_distance_delta", "centroid_delta", 2), *metric("defensive_line_velocity", "line_velocity", 2),
                     *metric("ball_delta_x_attack", "ball_progress", 2)).alias("metrics"),
        F.array(F.lit("candidate meaning, scored from physical signals")).alias("limitations"), F.lit(False).alias("conflict"))


def pass_evidence(passes: DataFrame, min_conf: float = 0.30) -> DataFrame:
    """Passes fit for the timeline: confident, on the ground."""
    kept = passes.filter((F.col("event_conf") >= min_conf) & ~F.col("aerial"))
    end = F.coalesce("reception_frame", F.col("release_frame") + 15)
    conf = F.col("event_conf")
    sender = F.col("sender_team")
    return kept.select(
        "sequence_id", F.format_string("pass_%d_%d_%s_%s", F.col("release_frame"), end, sender, F.col("event_type")).alias("event_id"),
        F.col("release_frame").alias("start_frame"), end.alias("end_frame"), F.col("release_ts").alias("start_ts"), F.coalesce("reception_ts", end / FPS).alias("end_ts"),
        F.lit("BALL_TRANSFER").alias("family"), F.lit(LEVEL_1).alias("level"), sender.alias("subject_team"),
        F.when(sender == "TEAM_0", "TEAM_1").otherwise("TEAM_0").alias("opponent_team"),
        propagate(conf, conf, LEVEL_1, F.lit(True), F.lit(10)).alias("confidence"), F.when(conf < 0.60, "MEDIUM").otherwise("HIGH").alias("quality"),
        F.lit("VALID").alias("calibration"), F.lit("HIGH").alias("visibility"),
        F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("pass_distance_m"), _num(F.coalesce("displacement_m", F.lit(0.0)), 2),
                     F.lit("forward_displacement_m"), _num(F.coalesce("forward_m", F.lit(0.0)), 2)).alias("metrics"),
        F.array(F.lit("pass detector baseline")).alias("limitations"), F.lit(False).alias("conflict"))


def timeline(*parts: DataFrame) -> DataFrame:
    """All event streams as one table; order it with ``ordered``."""
    out = parts[0].select(*EVENT_COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*EVENT_COLUMNS))
    return out


def ordered(events: DataFrame) -> DataFrame:
    return events.orderBy("sequence_id", "start_frame", "end_frame", "level", "event_id")


def positions(events: DataFrame, by_time: bool = False) -> DataFrame:
    """Place of each event in its sequence: by frames and level, or by times as the evidence store sorts."""
    order = ["start_ts", "end_ts", "start_frame", "event_id"] if by_time else ["start_frame", "end_frame", "level", "event_id"]
    return frames.numbered(events, ["sequence_id"], order, "start_frame", "position")


def links(events: DataFrame, reach: int = 25) -> DataFrame:
    """Edges: a turnover CAUSES a reaction that starts within 25 frames, overlapping pressure SUPPORTS one."""
    side = lambda p: events.select("sequence_id", *[F.col(c).alias(f"{p}_{c}") for c in ("event_id", "start_frame", "end_frame", "family", "subject_team", "opponent_team")])
    reactions = side("b").filter(F.col("b_family").isin("POST_LOSS_ENGAGEMENT", "DEFENSIVE_RECOVERY"))
    turn = side("a").filter("a_family = 'POSSESSION_CHANGE'")
    press = side("a").filter("a_family = 'PRESSURE_EPISODE'")
    causes = near_join(turn, reactions, ["sequence_id"], "a_start_frame", "b_start_frame", reach).filter(
        "a_subject_team = b_subject_team OR a_opponent_team = b_opponent_team").withColumn("relation", F.lit("CAUSES"))
    supports = overlap_join(press, reactions, ["sequence_id"], ("a_start_frame", "a_end_frame"), ("b_start_frame", "b_end_frame"), 100).filter(
        "a_subject_team = b_subject_team").withColumn("relation", F.lit("SUPPORTS"))
    edge = lambda df: df.select("sequence_id", F.col("a_event_id").alias("source_id"), F.col("b_event_id").alias("target_id"), "relation", F.lit(1.0).alias("weight"))
    return edge(causes).unionByName(edge(supports)).dropDuplicates(["sequence_id", "source_id", "target_id", "relation"])


# ---- texts --------------------------------------------------------------------------------------------------

def summaries(events: DataFrame) -> DataFrame:
    """One fixed sentence per event family."""
    subject, opponent = F.coalesce("subject_team", F.lit("UNKNOWN")), F.coalesce("opponent_team", F.lit("UNKNOWN"))
    start, end, conf, lasts = F.col("start_ts"), F.col("end_ts"), F.col("confidence"), F.col("end_ts") - F.col("start_ts")
    m = lambda name: F.coalesce(F.col("metrics")[name].cast("double"), F.lit(0.0))
    word = lambda name: F.coalesce(F.col("metrics")[name], F.lit("UNKNOWN"))
    # a value that rounds to zero has no minus sign; a plus stands before values that are not below zero
    tenth = lambda name: F.format_string("%.1f", F.round(m(name), 1) + F.lit(0.0))
    signed = lambda name: F.concat(F.when(m(name) >= 0, "+").otherwise(""), tenth(name))
    f = F.col("family")
    text = (
        F.when(f == "POSSESSION_CHANGE", F.format_string("%s lost possession to %s at %.2fs (frame %d). Possession confidence: %.2f [%s].",
                                                         subject, opponent, start, F.col("start_frame"), conf, F.col("quality")))
        .when(f == "POST_LOSS_ENGAGEMENT", F.format_string(
            "%s engaged in post-loss pressing against %s (%.2f–%.2fs, Δt=%.2fs). Nearest defender closed from %.1fm to %.1fm; "
            "PressureIndex changed from %.2f to %.2f. CounterpressScore: %.2f [Confidence: %.2f].", subject, opponent, start, end, lasts,
            m("nearest_defender_pre"), m("nearest_defender_post"), m("pressure_pre_mean"), m("pressure_post_mean"), m("counterpress_score"), conf))
        .when(f == "DEFENSIVE_RECOVERY", F.format_string(
            "%s initiated defensive recovery after possession loss (%.2f–%.2fs). Backline retreated at %sm/s; centroid-ball distance shifted by %sm. "
            "RecoveryScore: %.2f [Confidence: %.2f].", subject, start, end, tenth("defensive_line_velocity"), signed("centroid_ball_distance_delta"), m("recovery_score"), conf))
        .when(f == "PRESSURE_EPISODE", F.format_string(
            "%s applied continuous defensive pressure on %s (%.2f–%.2fs, dur: %.2fs). Mean PressureIndex: %.2f (peak: %.2f), min defender proximity: %.1fm.",
            subject, opponent, start, end, lasts, m("mean_pressure_index"), m("peak_pressure_index"), m("nearest_defender_min_m")))
        .when(f == "BLOCK_STATE", F.format_string(
            "%s structured in a %s block (%.2f–%.2fs, dur: %.2fs). Mean defensive line height: %.1fm from own goal, depth: %.1fm, width: %.1fm.",
            subject, word("block_category"), start, end, lasts, m("mean_defensive_line_height_m"), m("mean_depth_m"), m("mean_width_m")))
        .when(f == "BLOCK_HEIGHT_CHANGE", F.format_string("%s shifted defensive block height from %s to %s at %.2fs (line displacement: %sm, confidence: %.2f).",
                                                          subject, word("from_category"), word("to_category"), start, signed("height_delta_m"), conf))
        .when(f == "BALL_TRANSFER", F.format_string("%s ball transfer completed (%.2f–%.2fs). Distance: %.1fm, forward displacement: %sm [Confidence: %.2f].",
                                                    subject, start, end, m("pass_distance_m"), signed("forward_displacement_m"), conf))
        .when(f == "ATTACKING_PROGRESSION", F.format_string("%s achieved forward ball progression of %.1fm over %.2fs (%.2f–%.2fs, confidence: %.2f).",
                                                            subject, m("forward_progression_m"), lasts, start, end, conf))
        .when(f == "TEAM_COMPRESSION", F.format_string("%s executed spatial block compression (%.2f–%.2fs). Depth rate: %sm/s, line push rate: %sm/s.",
                                                       subject, start, end, tenth("delta_depth_mps"), tenth("delta_line_height_mps")))
        .otherwise(F.format_string("Event %s for %s at %.2fs [Confidence: %.2f].", f, subject, start, conf)))
    return events.withColumn("summary_text", text)


def citation(event_id: Column, start: Column, end: Column, conf: Column, grade: Column) -> Column:
    return F.format_string("[event:%s | t=%.2f–%.2fs | conf=%.2f | %s]", event_id, start, end, conf, grade)


# ---- team aggregates ----------------------------------------------------------------------------------------

def team_aggregates(frame_teams: DataFrame, possession: DataFrame, pressure: DataFrame, events: DataFrame) -> DataFrame:
    """One row per sequence and team: possession, block means, pressure, event counts and the reliability band.

    ``frame_teams`` has one row per seen team and frame with block columns and ``players``;
    the share of possession is over all frames of the sequence.
    """
    teams = ["sequence_id", "team_label"]
    total = possession.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("total_frames"))
    held = (possession.filter(F.col("possession_team").isin("TEAM_0", "TEAM_1")).groupBy("sequence_id", F.col("possession_team").alias("team_label"))
            .agg(F.count(F.lit(1)).alias("held_frames")))
    graded = (frame_teams.join(possession.select(*FRAME, "possession_conf"), FRAME, "left")
              .withColumn("grade", quality(F.lit("VALID"), F.col("players")))
              .withColumn("conf", propagate(F.lit(0.85), F.coalesce("possession_conf", F.lit(0.0)), LEVEL_2, F.lit(True), F.col("players"))))
    base = graded.groupBy(*teams).agg(
        F.count(F.lit(1)).alias("valid_frames"), F.avg("line_height_m").alias("line_height_m"), F.avg("depth_m").alias("depth_m"), F.avg("width_m").alias("width_m"),
        F.avg("conf").alias("conf_mean"), F.percentile("conf", 0.1).alias("conf_p10"),
        *[F.count_if(F.col("grade") == g).alias(f"frames_{g.lower()}") for g in ("HIGH", "MEDIUM", "LOW", "INVALID")])
    press = (pressure.filter(F.col("defending_team").isin("TEAM_0", "TEAM_1")).groupBy("sequence_id", F.col("defending_team").alias("team_label"))
             .agg(F.avg("pressure_index").alias("pressure_mean"), F.max("pressure_index").alias("pressure_peak")))
    fam, score = F.col("family"), lambda k: F.col("metrics")[k].cast("double")
    trans = fam.isin("POST_LOSS_ENGAGEMENT", "DEFENSIVE_RECOVERY")
    counts = events.groupBy("sequence_id", F.col("subject_team").alias("team_label")).agg(
        F.count_if(fam == "POSSESSION_CHANGE").alias("possession_changes"),
        F.count_if((fam == "PRESSURE_EPISODE") & F.col("quality").isin("HIGH", "MEDIUM")).alias("pressure_episodes"),
        F.avg(F.when(trans, score("counterpress_score"))).alias("counterpress_mean"), F.avg(F.when(trans, score("recovery_score"))).alias("recovery_mean"),
        F.count_if((fam == "BALL_TRANSFER") & F.col("metrics")["event_type"].contains("COMPLETED")).alias("completed_passes"),
        F.sum(F.when(fam == "BALL_TRANSFER", F.greatest(F.lit(0.0), score("forward_displacement_m")))).alias("progression_m"))
    df = base.join(total, "sequence_id", "left").join(held, teams, "left").join(press, teams, "left").join(counts, teams, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    # means of values with few places often lie on a tie: it goes up whatever the order of summing
    even = lambda c, p: F.round(F.col(c) + 1e-9, p)
    r = lambda c, p: F.round(F.coalesce(F.col(c), F.lit(0.0)) + 1e-9, p)
    return df.select(
        *teams, F.round(n("held_frames") / FPS, 2).alias("possession_s"), F.round(F.lit(100.0) * n("held_frames") / F.col("total_frames"), 1).alias("possession_pct"),
        n("possession_changes").alias("possession_changes"), even("line_height_m", 2).alias("line_height_m"), even("depth_m", 2).alias("depth_m"),
        even("width_m", 2).alias("width_m"), r("pressure_mean", 3).alias("pressure_mean"), r("pressure_peak", 3).alias("pressure_peak"),
        n("pressure_episodes").alias("pressure_episodes"), r("counterpress_mean", 3).alias("counterpress_mean"), r("recovery_mean", 3).alias("recovery_mean"),
        r("progression_m", 2).alias("progression_m"), n("completed_passes").alias("completed_passes"),
        F.round(F.lit(100.0) * F.col("valid_frames") / F.col("total_frames"), 1).alias("coverage_pct"), "valid_frames", "total_frames",
        even("conf_mean", 3).alias("conf_mean"), even("conf_p10", 3).alias("conf_p10"), "frames_high", "frames_medium", "frames_low", "frames_invalid")


def block_rollup(frame_teams: DataFrame) -> DataFrame:
    """Frames and line heights of every team of a sequence, of every sequence (``level`` 1) and of all (``level`` 3), by one rollup."""
    is_ = lambda c: F.count_if(F.col("category") == c)
    return frame_teams.rollup("sequence_id", "team_label").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("frames"), F.count_distinct("sequence_id").alias("sequences"),
        (F.round(F.avg("line_height_m") + 1e-9, 4) + 0.0).alias("line_height_m"), F.round(F.min("line_height_m"), 6).alias("lowest_m"), F.round(F.max("line_height_m"), 6).alias("highest_m"),
        is_("LOW_BLOCK").alias("low_frames"), is_("HIGH_BLOCK").alias("high_frames"))


def top_structures(signs: DataFrame, limit: int = 3) -> DataFrame:
    """Most frequent line structures of each team; of equal ones, the one seen first."""
    keys = ["sequence_id", "team_label"]
    counted = signs.filter(F.size("structure") > 0).groupBy(*keys, F.array_join(F.transform("structure", lambda v: v.cast("string")), "-").alias("structure")).agg(
        F.count(F.lit(1)).alias("frequency"), F.min("frame_index").alias("_first"))
    w = Window.partitionBy(*keys)
    ranked = counted.select("*", F.sum("frequency").over(w).alias("_all"), F.row_number().over(w.orderBy(F.desc("frequency"), "_first", "structure")).alias("rank"))
    return ranked.filter(F.col("rank") <= limit).select(*keys, "rank", "structure", "frequency", F.round(F.lit(100.0) * F.col("frequency") / F.col("_all"), 1).alias("pct"))


def formation_consensus(stable: DataFrame, min_frames: int = 25) -> DataFrame:
    """Most common formation label over the full-evidence frames, given at least 25 of them."""
    keys = ["sequence_id", "team_label"]
    votes = (stable.filter((F.col("evidence") == "FULL_EVIDENCE") & ~F.col("stable_label").isin("UNKNOWN", "PARTIAL"))
             .groupBy(*keys, "stable_label").agg(F.count(F.lit(1)).alias("frames"), F.min("frame_index").alias("_first")))
    best = votes.groupBy(*keys).agg(F.max(F.struct("frames", (-F.col("_first")).alias("early"), "stable_label")).alias("b"))
    return best.filter(F.col("b.frames") >= min_frames).select(*keys, F.col("b.stable_label").alias("formation"), F.col("b.frames").alias("frames"))
