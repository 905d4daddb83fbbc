"""Box tracks: association, the ball's lifecycle, gap filling, ambiguous boxes, appearance prototypes."""

from __future__ import annotations

import math
from functools import partial, reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions import frames
from touchline.functions.boxes import iou, let
from touchline.functions.scan import CHUNK, scan
from touchline.operators.geometry import FRAME

MATCH_IOU, MAX_MISSES = 0.3, 6
GATE_PX, GATE_GROWTH_PX, GATE_MAX_PX, MAX_STEP_PX = 150.0, 35.0, 500.0, 120.0
MIN_BALL_CONF, RESTART_CONF, LOST_AFTER, JUMP_AFTER, JUMP_PX = 0.25, 0.30, 25, 10, 300.0
FILL_FRAMES, FILL_SPEED, LONG_FILL_SPEED, LONG_FILL_PX = 3, 60.0, 30.0, 150.0
OVERLAP_IOU, COMPETITION_IOU, LOST_IOU, LOST_PX, SEED_FRAMES = 0.15, 0.20, 0.10, 150.0, 3
PROTOTYPE_KEEP = 0.90


def _iou(a: list[float], b: list[float]) -> float:
    shared = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / union if union > 0 else 0.0


def _associate_step(state: dict, pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    """Each box takes the free track it overlaps most; a track not found in more than six frames ends.

    A track is named by the frame and place in which it began, so nothing but live tracks is remembered.
    """
    tracks, out = state.get("tracks", {}), []
    for frame, rows in pdf.groupby("frame_index", sort=True):
        free, kept = dict(tracks), {}
        for place, r in enumerate(rows.itertuples(index=False)):
            box = [float(v) for v in (r.x1, r.y1, r.x2, r.y2)]
            best = max(((_iou(box, t[0]), name) for name, t in free.items()), default=(0.0, ""))
            name = best[1] if best[0] >= MATCH_IOU else f"{int(frame)}-{place}"
            free.pop(name, None)
            kept[name] = [box, 0]
            out.append((r.sequence_id, int(frame), r.det_id, name))
        tracks = kept | {n: [t[0], t[1] + 1] for n, t in free.items() if t[1] + 1 <= MAX_MISSES}
    return pd.DataFrame(out, columns=["sequence_id", "frame_index", "det_id", "track"]), {"tracks": tracks}


def associate(detections: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Track of every person box: (sequence_id, frame_index, det_id, x1, y1, x2, y2) in, with ``track`` out."""
    return scan(detections, ["sequence_id"], ["frame_index", "det_id"], _associate_step,
                "sequence_id string, frame_index bigint, det_id bigint, track string", chunk)


def _expected(s: dict, frame: int) -> tuple[float, float]:
    if s["prev"] is None:
        return s["at"][0], s["at"][1]
    steps = max(1, s["frame"] - s["prev"][2])
    vx, vy = (s["at"][0] - s["prev"][0]) / steps, (s["at"][1] - s["prev"][1]) / steps
    size = math.hypot(vx, vy)
    if size > MAX_STEP_PX:
        vx, vy = vx * MAX_STEP_PX / size, vy * MAX_STEP_PX / size
    gone = frame - s["frame"]
    fade = 0.5 ** (gone - 1) if gone > 1 else 1.0
    return s["at"][0] + vx * gone * fade, s["at"][1] + vy * gone * fade


def _ball_step(state: dict, pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    s = {"at": None, "frame": None, "prev": None, "misses": 0, "born": None, **state}
    out = []
    for r in pdf.itertuples(index=False):
        frame = int(r.frame_index)
        seen = [(float(c["u"]), float(c["v"]), float(c["conf"])) for c in (r.candidates if r.candidates is not None else []) if c["conf"] >= MIN_BALL_CONF]
        chosen = None
        if seen and s["at"] is None:
            chosen = max(seen, key=lambda c: c[2])
        elif seen:
            gone = max(1, frame - s["frame"])
            gate = min(GATE_PX + GATE_GROWTH_PX * (gone - 1), GATE_MAX_PX)
            ex, ey = _expected(s, frame)
            scored = []
            for c in seen:
                moved = math.dist(c[:2], s["at"])
                if moved <= gate and moved / gone <= MAX_STEP_PX:
                    scored.append((0.6 * max(0.0, 1.0 - math.dist(c[:2], (ex, ey)) / gate) + 0.4 * c[2], c))
            if scored:
                chosen = max(scored, key=lambda x: x[0])[1]
            elif s["misses"] >= LOST_AFTER:
                chosen = max((c for c in seen if c[2] >= RESTART_CONF), key=lambda c: c[2], default=None)
        if chosen:
            fresh = s["born"] is None or s["misses"] >= LOST_AFTER or (s["misses"] >= JUMP_AFTER and math.dist(chosen[:2], s["at"]) > JUMP_PX)
            vx = vy = None
            if not fresh:
                gone = max(1, frame - s["frame"])
                vx, vy = (chosen[0] - s["at"][0]) / gone, (chosen[1] - s["at"][1]) / gone
            prev = None if fresh or s["at"] is None else [*s["at"], s["frame"]]
            s = {"at": [chosen[0], chosen[1]], "frame": frame, "prev": prev, "misses": 0, "born": frame if fresh else s["born"]}
            out.append((r.sequence_id, frame, "DETECTED", "ACTIVE", s["born"], chosen[0], chosen[1], vx, vy, chosen[2], 0))
        else:
            s["misses"] += 1
            life = "TERMINATED" if s["misses"] > LOST_AFTER else "LOST"
            out.append((r.sequence_id, frame, "LOST", life, None, None, None, None, None, None, s["misses"]))
    table = pd.DataFrame(out, columns=["sequence_id", "frame_index", "state", "lifecycle", "born_frame", "u", "v", "vx", "vy", "conf", "gap"])
    table["born_frame"] = table["born_frame"].astype("Int64")
    for c in ("u", "v", "vx", "vy", "conf"):
        table[c] = table[c].astype(float)
    return table, s


def track_ball(candidates: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Ball track per frame from arrays of candidates (u, v, conf); a track is named by the frame it began in.

    Long gaps are not predicted; ``fill_gaps`` interpolates the short ones afterwards.
    """
    out = scan(candidates.select(*FRAME, "candidates"), ["sequence_id"], "frame_index", _ball_step,
               "sequence_id string, frame_index bigint, state string, lifecycle string, born_frame bigint, u double, v double, vx double, vy double, conf double, gap bigint", chunk)
    return out.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in ("u", "v", "vx", "vy", "conf") else F.col(c) for c in out.columns])


def fill_gaps(track: DataFrame, max_frames: int = FILL_FRAMES, span: int = frames.SPAN) -> DataFrame:
    """Linear points between two detections of the same track: up to 3 frames at 60 px a frame or slower,
    longer only below 30 px a frame and 150 px in all."""
    seen = track.filter("state = 'DETECTED'")
    pairs = frames.previous_row(seen, ["sequence_id"], "frame_index", ["frame_index", "u", "v", "born_frame"], span=span)
    steps = F.col("frame_index") - F.col("prev_frame_index")
    far = F.sqrt(F.pow(F.col("u") - F.col("prev_u"), 2) + F.pow(F.col("v") - F.col("prev_v"), 2))
    short = (steps - 1 <= max_frames) & (far / steps <= FILL_SPEED)
    slow = (far / steps <= LONG_FILL_SPEED) & (far <= LONG_FILL_PX)
    gaps = pairs.filter((steps > 1) & (F.col("born_frame") == F.col("prev_born_frame")) & (short | slow))
    at = F.explode(F.sequence(F.col("prev_frame_index") + 1, F.col("frame_index") - 1))
    part = (F.col("at") - F.col("prev_frame_index")) / steps
    return gaps.withColumn("at", at).select(
        "sequence_id", F.col("at").alias("frame_index"), F.lit("INTERPOLATED").alias("state"), "born_frame",
        (F.col("prev_u") + (F.col("u") - F.col("prev_u")) * part).alias("u"), (F.col("prev_v") + (F.col("v") - F.col("prev_v")) * part).alias("v"),
        (steps - 1).alias("gap"))


def ambiguous(detections: DataFrame, active: DataFrame, lost: DataFrame) -> DataFrame:
    """First reason each box needs an appearance check, if any: seed frame, overlap, competing tracks, a lost track near.

    ``active`` and ``lost`` hold the boxes of the tracks of each frame.
    """
    box = ["x1", "y1", "x2", "y2"]
    finite = reduce(and_, [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in box]).alias("finite")
    pack = lambda df, name: df.groupBy(*FRAME).agg(F.collect_list(F.struct(*box, finite)).alias(name))
    rest = [c for c in detections.columns if c not in FRAME]
    own = detections.dropna(subset=FRAME).groupBy(*FRAME).agg(F.collect_list(F.struct(*rest, finite)).alias("_dets"))
    framed = own.join(pack(active, "_active"), FRAME, "left").join(pack(lost, "_lost"), FRAME, "left")
    df = framed.select(*FRAME, F.explode("_dets").alias("_own"), "_dets", "_active", "_lost").select(*FRAME, "_own.*", "_dets", "_active", "_lost")
    none = F.array().cast("array<struct<x1: double, y1: double, x2: double, y2: double, finite: boolean>>")
    mine = {c: F.col(c) for c in [*box, "finite"]}
    of = lambda b: [b[c] for c in box]
    # boxes that lie apart have nothing in common: most pairs end here, without their areas
    apart = lambda a, b: a["finite"] & b["finite"] & ((a["x2"] <= b["x1"]) | (b["x2"] <= a["x1"]) | (a["y2"] <= b["y1"]) | (b["y2"] <= a["y1"]))
    meets = lambda a, b, least: ~apart(a, b) & (iou(of(a), of(b)) >= least)
    active_, lost_ = F.coalesce("_active", none), F.coalesce("_lost", none)
    overlap = F.exists("_dets", lambda d: (d["det_id"] != F.col("det_id")) & meets(mine, d, OVERLAP_IOU))
    shared = lambda touching: F.exists(touching, lambda t: F.exists("_dets", lambda d: (d["det_id"] != F.col("det_id")) & meets(t, d, COMPETITION_IOU)))
    rivals = let(F.filter(active_, lambda t: meets(mine, t, COMPETITION_IOU)), lambda touching: (F.size(touching) > 1) | shared(touching))
    near = F.exists(lost_, lambda t: meets(mine, t, LOST_IOU) | (F.sqrt(
        F.pow((mine["x1"] + mine["x2"] - t["x1"] - t["x2"]) / 2.0, 2) + F.pow((mine["y1"] + mine["y2"] - t["y1"] - t["y2"]) / 2.0, 2)) <= LOST_PX))
    reason = (F.when(F.col("frame_index") <= SEED_FRAMES, "seed_initial").when(overlap, "detection_overlap")
              .when(rivals, "track_competition").when(near, "lost_reacquisition"))
    return df.select(*detections.columns, reason.alias("reason"))


def prototype_step(state: dict, pdf: pd.DataFrame, keep: float = PROTOTYPE_KEEP, max_age: int = 30) -> tuple[pd.DataFrame, dict]:
    s, out = dict(state), []
    for r in pdf.itertuples(index=False):
        v = np.asarray(r.feature, dtype=float)
        v = v / (np.linalg.norm(v) or 1.0)
        if s and r.frame_index - s["frame"] <= max_age:
            v = keep * np.asarray(s["v"]) + (1.0 - keep) * v
            v = v / (np.linalg.norm(v) or 1.0)
            hits = s["hits"] + 1
        else:
            hits = 1
        s = {"v": v.tolist(), "frame": int(r.frame_index), "hits": hits}
        out.append((r.sequence_id, r.track_id, int(r.frame_index), hits, v.tolist()))
    return pd.DataFrame(out, columns=["sequence_id", "track_id", "frame_index", "hits", "prototype"]), s


def prototypes(features: DataFrame, keep: float = PROTOTYPE_KEEP, max_age: int = 30, chunk: int = CHUNK) -> DataFrame:
    """Running appearance prototype of each track, L2-normalised; one that was not seen for ``max_age`` frames starts anew."""
    return scan(features, ["sequence_id", "track_id"], "frame_index", partial(prototype_step, keep=keep, max_age=max_age),
                "sequence_id bigint, track_id bigint, frame_index bigint, hits bigint, prototype array<double>", chunk)


def coverage(track: DataFrame, expected: DataFrame, span: int = frames.SPAN) -> DataFrame:
    """Ball coverage per sequence: share of frames seen, number of gaps, longest seen run."""
    all_frames = expected.select(*FRAME).join(track.filter("state <> 'LOST'").select(*FRAME).withColumn("seen", F.lit(1)), FRAME, "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    changed = frames.previous_row(all_frames, ["sequence_id"], "frame_index", ["seen"], span=span)
    runs = frames.islands(changed, ["sequence_id"], "frame_index", F.coalesce(F.col("seen") != F.col("prev_seen"), F.lit(True)), "run", span)
    lengths = runs.groupBy("sequence_id", "run").agg(F.max("seen").alias("seen"), F.count(F.lit(1)).alias("length"), F.min("frame_index").alias("start_frame"))
    return lengths.groupBy("sequence_id").agg(
        F.sum("length").alias("frames"), (F.sum(F.col("length") * F.col("seen")) / F.sum("length")).alias("coverage"),
        F.count_if(F.col("seen") == 0).alias("gaps"), F.max(F.when(F.col("seen") == 1, F.col("length"))).alias("longest_run"),
        *[F.count_if((F.col("seen") == 0) & test).alias(name) for name, test in (
            ("gaps_short", F.col("length") <= 2), ("gaps_medium", F.col("length").between(3, 10)), ("gaps_long", F.col("length") > 10))])


def admission_step(state: dict, pdf: pd.DataFrame, limit: int = 5, window_s: float = 600.0) -> tuple[pd.DataFrame, dict]:
    """Adds ``admitted``; the state is the times of the requests admitted within the window."""
    recent, ok = state.get("recent", []), []
    for at in pdf["at_s"]:
        recent = [t for t in recent if t > at - window_s]
        ok.append(len(recent) < limit)
        if ok[-1]:
            recent.append(float(at))
    return pdf.assign(admitted=ok), {"recent": recent}


def admissions(requests: DataFrame, limit: int = 5, window_s: float = 600.0) -> DataFrame:
    """Sliding admission: at most five admitted requests of a key in 600 s; refused ones do not count.

    ``requests`` has key, request_no (its order within the key) and at_s.
    """
    return scan(requests.select("key", "request_no", "at_s"), ["key"], "request_no", partial(admission_step, limit=limit, window_s=window_s), "key bigint, request_no bigint, at_s double, admitted boolean")
