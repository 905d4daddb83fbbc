"""Trajectories: velocity, polynomial and Kalman smoothing, moving averages, movement summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.functions import frames
from touchline.functions.scan import CHUNK, scan

TRACK = ["sequence_id", "track_id"]
MAX_GAP_FRAMES = 3
MAX_PLAYER_SPEED, MAX_BALL_SPEED = 12.5, 55.0
KALMAN_RESET_S = 0.17
KALMAN_DT, KALMAN_Q, KALMAN_R = 0.04, 1.5, 0.4
EMA_ALPHA = 0.25
AERIAL_MS, AERIAL_PX, AERIAL_PX_MS = 25.0, 350.0, 20.0


def _at(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("frame_index")


def velocity(observations: DataFrame, max_gap: int = MAX_GAP_FRAMES, span: int = frames.SPAN) -> DataFrame:
    """Central difference when both neighbour rows are valid and near, else one-sided, else null."""
    def apply(rows: DataFrame, keys: list[str]) -> DataFrame:
        row = F.struct("frame_index", "timestamp_s", "position_valid", "x_m", "y_m")
        near = rows.select("*", F.lag(row).over(_at(keys)).alias("_p"), F.lead(row).over(_at(keys)).alias("_n"))
        prev_ok = F.coalesce(F.col("_p.position_valid") & (F.col("frame_index") - F.col("_p.frame_index") <= max_gap), F.lit(False))
        next_ok = F.coalesce(F.col("_n.position_valid") & (F.col("_n.frame_index") - F.col("frame_index") <= max_gap), F.lit(False))
        here = F.struct("frame_index", "timestamp_s", "position_valid", "x_m", "y_m")
        a, b = F.when(prev_ok, F.col("_p")).otherwise(here), F.when(next_ok, F.col("_n")).otherwise(here)
        return near.withColumn("_a", a).withColumn("_b", b)

    pairs = frames.halo(observations, TRACK, "frame_index", apply, before=max_gap, after=max_gap, span=span)
    dt = F.col("_b.timestamp_s") - F.col("_a.timestamp_s")
    usable = F.col("position_valid") & (dt > 1e-4)
    out = (pairs.withColumn("vx", F.when(usable, (F.col("_b.x_m") - F.col("_a.x_m")) / dt))
           .withColumn("vy", F.when(usable, (F.col("_b.y_m") - F.col("_a.y_m")) / dt))
           .drop("_p", "_n", "_a", "_b"))
    return out.withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))


def plausible(speed: Column, is_ball: bool = False) -> Column:
    return F.coalesce(speed <= (MAX_BALL_SPEED if is_ball else MAX_PLAYER_SPEED), F.lit(True))


def polynomial_smoothing(observations: DataFrame, span: int = frames.SPAN) -> DataFrame:
    """Least-squares fit of the valid rows within two frames, read at the current frame.

    Four or five points take a parabola, three a line, fewer keep the raw value.
    """
    def apply(rows: DataFrame, keys: list[str]) -> DataFrame:
        reach = _at(keys).rangeBetween(-2, 2)
        point = F.when(F.col("position_valid"), F.struct((F.col("frame_index")).alias("f"), F.col("x_m").alias("x"), F.col("y_m").alias("y")))
        return rows.withColumn("_w", F.collect_list(point).over(reach))

    near = frames.halo(observations, TRACK, "frame_index", apply, before=2, after=2, span=span)
    t = lambda p: (p["f"] - F.col("frame_index")).cast("double")
    total = lambda f: F.aggregate("_w", F.lit(0.0), lambda acc, p: acc + f(p))
    power = lambda k: (lambda p: F.pow(t(p), F.lit(k)))
    near = near.select("*", F.size("_w").alias("_n"), *[total(power(k)).alias(f"_s{k}") for k in (1, 2, 3, 4)],
                       *[total(lambda p, k=k, c=c: F.pow(t(p), F.lit(k)) * p[c]).alias(f"_{c}{k}") for c in "xy" for k in (0, 1, 2)])
    n, s1, s2, s3, s4 = [F.col(c) for c in ("_n", "_s1", "_s2", "_s3", "_s4")]

    def fitted(c: str) -> Column:
        b0, b1, b2 = [F.col(f"_{c}{k}") for k in (0, 1, 2)]
        det3 = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
        parabola = (b0 * (s2 * s4 - s3 * s3) - s1 * (b1 * s4 - b2 * s3) + s2 * (b1 * s3 - b2 * s2)) / det3
        line = (s2 * b0 - s1 * b1) / (n * s2 - s1 * s1)
        raw = F.col(f"{c}_m")
        return F.when(~F.col("position_valid"), None).when(n >= 4, parabola).when(n == 3, line).otherwise(raw)

    out = near.withColumn("smooth_x", fitted("x")).withColumn("smooth_y", fitted("y"))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def _kalman_step(state: dict, pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    """Constant velocity; both axes share one covariance (p: position, c: cross, v: velocity)."""
    q, r = KALMAN_Q ** 2, KALMAN_R ** 2
    noise_p, noise_c, noise_v = q * KALMAN_DT ** 4 / 4.0, q * KALMAN_DT ** 3 / 2.0, q * KALMAN_DT ** 2
    n = len(pdf)
    out = np.full((4, n), np.nan)
    times, valid = pdf["timestamp_s"].to_numpy(), pdf["position_valid"].to_numpy()
    xs, ys = pdf["x_m"].to_numpy(), pdf["y_m"].to_numpy()
    s = dict(state)
    for i in range(n):
        if not valid[i] or np.isnan(xs[i]) or np.isnan(ys[i]):
            continue
        if not s or times[i] - s["t"] > KALMAN_RESET_S:
            s = {"x": float(xs[i]), "y": float(ys[i]), "vx": 0.0, "vy": 0.0, "p": r, "c": 0.0, "v": r, "dt": KALMAN_DT}
        else:
            step = max(0.001, times[i] - s["t"])
            dt = float(step) if abs(step - s["dt"]) > 1e-4 else s["dt"]
            p = s["p"] + dt * s["c"] + dt * (s["c"] + dt * s["v"]) + noise_p
            c = s["c"] + dt * s["v"] + noise_c
            v = s["v"] + noise_v
            kp, kv = p / (p + r), c / (p + r)
            nx, ny = s["x"] + dt * s["vx"], s["y"] + dt * s["vy"]
            ex, ey = float(xs[i]) - nx, float(ys[i]) - ny
            s = {"x": nx + kp * ex, "y": ny + kp * ey, "vx": s["vx"] + kv * ex, "vy": s["vy"] + kv * ey,
                 "p": (1.0 - kp) * p, "c": (1.0 - kp) * c, "v": v - kv * c, "dt": dt}
        s["t"] = float(times[i])
        out[:, i] = s["x"], s["y"], s["vx"], s["vy"]
    speed = np.hypot(out[2], out[3])
    return pdf[["sequence_id", "track_id", "frame_index"]].assign(
        smooth_x=out[0], smooth_y=out[1], vx=out[2], vy=out[3], speed=speed), s


def kalman(observations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Constant-velocity filter per track, restarted after a gap over 0.17 s; invalid rows give null."""
    rows = observations.select("sequence_id", "track_id", "frame_index", "timestamp_s", "position_valid", "x_m", "y_m")
    out = scan(rows, TRACK, "frame_index", _kalman_step,
               "sequence_id string, track_id bigint, frame_index bigint, smooth_x double, smooth_y double, vx double, vy double, speed double", chunk)
    return out.select("sequence_id", "track_id", "frame_index",
                      *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("smooth_x", "smooth_y", "vx", "vy", "speed")])


def moving_average(rows: DataFrame, keys: list[str], measures: list[str], alpha: float = EMA_ALPHA, chunk: int = CHUNK) -> DataFrame:
    """Exponential average of each measure: the first row of a key passes through, a null leaves its state alone.

    A measure that was null when its key opened starts from zero.
    """
    def step(state: dict, pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
        s, out = dict(state), {m: [] for m in measures}
        for values in pdf[measures].itertuples(index=False):
            opening = not s
            for m, v in zip(measures, values):
                missing = v is None or np.isnan(v)
                if opening:
                    s[m] = 0.0 if missing else float(v)
                elif not missing:
                    s[m] = alpha * float(v) + (1.0 - alpha) * s[m]
                out[m].append(None if missing else s[m])
        return pdf[[*keys, "frame_index"]].assign(**{f"ema_{m}": pd.Series(v, dtype=float) for m, v in out.items()}), s

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, "frame_index"]) + "".join(f", ema_{m} double" for m in measures)
    return scan(rows.select(*keys, "frame_index", *measures), keys, "frame_index", step, schema, chunk)


def movement_summary(moving: DataFrame, span: int = frames.SPAN) -> DataFrame:
    """Per sequence: acceleration, jitter while nearly still, distance and the share of plausible speeds."""
    good = moving.filter("position_valid")
    pairs = frames.previous_row(good, TRACK, "frame_index", ["x_m", "y_m", "vx", "vy", "timestamp_s"], span=span)
    dt = F.col("timestamp_s") - F.col("prev_timestamp_s")
    acceleration = F.when(dt > 1e-3, F.sqrt(F.pow((F.col("vx") - F.col("prev_vx")) / dt, 2) + F.pow((F.col("vy") - F.col("prev_vy")) / dt, 2)))
    dx, dy = F.col("x_m") - F.col("prev_x_m"), F.col("y_m") - F.col("prev_y_m")
    still = F.col("speed") < 1.0
    return pairs.groupBy("sequence_id").agg(
        F.avg("speed").alias("mean_speed"), F.avg(acceleration).alias("mean_acceleration"), F.percentile(acceleration, 0.95).alias("p95_acceleration"),
        F.sqrt(F.pow(F.stddev_pop(F.when(still, dx)), 2) + F.pow(F.stddev_pop(F.when(still, dy)), 2)).alias("jitter_m"),
        F.sum(F.sqrt(dx * dx + dy * dy)).alias("distance_m"),
        (F.count_if(F.col("speed").isNotNull() & plausible(F.col("speed"))) / F.count("speed")).alias("plausible_share"))


def steps_by_calibration_age(observations: DataFrame, ages: DataFrame, span: int = frames.SPAN) -> DataFrame:
    """Step length between neighbouring rows of a track, by the age of the calibration of the later frame."""
    pairs = frames.previous_row(observations, TRACK, "frame_index", ["position_valid", "x_m", "y_m"], span=span).filter("position_valid AND prev_position_valid")
    age = F.col("age")
    bucket = (F.when(age == 0, "age_0").when(age <= 2, "age_1_2").when(age <= 5, "age_3_5").when(age <= 10, "age_6_10"))
    step = F.sqrt(F.pow(F.col("x_m") - F.col("prev_x_m"), 2) + F.pow(F.col("y_m") - F.col("prev_y_m"), 2))
    joined = pairs.join(ages.filter("cal_valid").select("sequence_id", "frame_index", "age"), ["sequence_id", "frame_index"])
    return (joined.withColumn("bucket", bucket).filter("bucket IS NOT NULL").groupBy("bucket")
            .agg(F.avg(step).alias("mean_step_m"), F.percentile(step, 0.5).alias("median_step_m"), F.percentile(step, 0.95).alias("p95_step_m"),
                 F.count(F.lit(1)).alias("samples")))


def ball_speed(ball: DataFrame, span: int = frames.SPAN) -> DataFrame:
    """Speed against the previous seen ball, on the pitch and in the image, and the aerial suspicion."""
    seen = ball.filter("ball_valid")
    pairs = frames.previous_row(seen, ["sequence_id"], "frame_index", ["ball_x", "ball_y", "ball_u", "ball_v", "timestamp_s"], span=span)
    dt = F.greatest(F.lit(1e-3), F.col("timestamp_s") - F.col("prev_timestamp_s"))
    rate = lambda a, b: F.sqrt(F.pow(F.col(a) - F.col(f"prev_{a}"), 2) + F.pow(F.col(b) - F.col(f"prev_{b}"), 2)) / dt
    out = (pairs.withColumn("speed_ms", F.coalesce(rate("ball_x", "ball_y"), F.lit(0.0)))
           .withColumn("speed_px", F.coalesce(rate("ball_u", "ball_v"), F.lit(0.0))))
    aerial = (F.col("speed_ms") > AERIAL_MS) | ((F.col("speed_px") > AERIAL_PX) & (F.col("speed_ms") > AERIAL_PX_MS))
    return out.withColumn("aerial", aerial).drop(*[c for c in out.columns if c.startswith("prev_")])


def sample_frames(rows: DataFrame, every: int) -> DataFrame:
    """Every n-th frame; a filter that reaches the scan."""
    return rows.filter(F.col("frame_index") % every == 0)
