"""Defensive block: height, compactness, category, hysteresis."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.functions.boxes import let
from touchline.functions.hull import hull
from touchline.functions.scan import CHUNK, scan
from touchline.operators.geometry import FRAME, TEAM, distance, median_of
from touchline.operators.lines import HALF_LENGTH, SEQ_TEAM, line_gaps

LOW_CEILING_M, HIGH_FLOOR_M = 35.0, 52.5
CENTROID_LOW_M, CENTROID_HIGH_M = 42.0, 58.0
MIN_PLAYERS = 5
CONFIRM_FIRST, CONFIRM_CHANGE = 3, 10
POSSESSION_TRUST = 0.65


def quantile(values: Column, q: float) -> Column:
    """Linear-interpolated quantile of a short array."""
    at = F.lit(q) * (F.size(values) - 1)
    low = F.floor(at).cast("int")
    high = F.least(low + 1, F.size(values) - 1)
    part = at - low
    return let(F.array_sort(values), lambda ordered: F.get(ordered, low) * (F.lit(1.0) - part) + F.get(ordered, high) * part)


def block_metrics(teams: DataFrame, ball: DataFrame | None = None) -> DataFrame:
    """Heights, spreads, line gaps and distances of every oriented team, from the arrays of ``oriented_teams``."""
    x, y = F.col("ranked.x_attack"), F.col("ranked.y_m")
    n = F.col("outfield_count")
    oriented = F.col("direction") != 0
    spread = lambda v: quantile(v, 0.9) - quantile(v, 0.1)
    mad = lambda v: let(median_of(v), lambda m: median_of(F.transform(v, lambda e: F.abs(e - m))))
    pair = oriented & (n >= 2)
    first, last = F.element_at("lines", 1), F.element_at("lines", -1)
    has_line = F.col("line_count") >= 1
    df = line_gaps(teams, "median_x_attack")
    df = df.select(
        "*",
        F.when(oriented, median_of(x) + HALF_LENGTH).alias("centroid_height_m"),
        F.when(oriented, F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n + HALF_LENGTH).alias("mean_centroid_height_m"),
        F.when(pair, spread(x)).alias("longitudinal_spread_m"), F.when(pair, mad(x)).alias("longitudinal_mad_m"),
        F.when(pair, F.array_max(y) - F.array_min(y)).alias("width_m"),
        F.when(pair, spread(y)).alias("lateral_spread_m"), F.when(pair, mad(y)).alias("lateral_mad_m"),
        F.when(has_line, first["median_x_attack"] + HALF_LENGTH).alias("line_height_m"),
        F.when(has_line, first["mean_x_attack"] + HALF_LENGTH).alias("mean_line_height_m"),
        F.when(has_line, first["players"]).alias("line_players"),
        F.when(has_line, first).alias("_first"), F.when(has_line, F.struct(last["mean_x"].alias("mean_x"), last["mean_y"].alias("mean_y"))).alias("_last"),
        F.aggregate("gaps", F.lit(0.0), lambda a, v: a + v, lambda a: a / F.size("gaps")).alias("mean_line_gap_m"),
        F.array_max("gaps").alias("max_line_gap_m"), F.get("gaps", F.lit(0)).alias("defence_midfield_m"),
        F.get("gaps", F.lit(1)).alias("midfield_attack_m"))
    frame = Window.partitionBy(*FRAME)
    front = {t: F.max(F.when(F.col("team_label") == t, F.col("_last"))).over(frame) for t in ("TEAM_0", "TEAM_1")}
    df = df.withColumn("_opp", F.when(F.col("team_label") == "TEAM_0", front["TEAM_1"]).otherwise(front["TEAM_0"]))
    if ball is not None:
        df = df.join(ball.filter("ball_valid").select(*FRAME, "ball_x", "ball_y"), FRAME, "left")
    else:
        df = df.withColumn("ball_x", F.lit(None).cast("double")).withColumn("ball_y", F.lit(None).cast("double"))
    mean = lambda field: F.aggregate(F.col(f"ranked.{field}"), F.lit(0.0), lambda a, v: a + v) / n
    return df.select(
        "*",
        F.abs(F.col("_first.mean_x") - F.col("_opp.mean_x")).alias("to_opponent_front_m"),
        distance(F.col("_first.mean_x"), F.col("_first.mean_y"), F.col("_opp.mean_x"), F.col("_opp.mean_y")).alias("to_opponent_front_euclid_m"),
        distance(F.col("_first.mean_x"), F.col("_first.mean_y"), F.col("ball_x"), F.col("ball_y")).alias("line_to_ball_m"),
        F.abs(F.col("_first.median_x_attack") - F.col("direction") * F.col("ball_x")).alias("line_to_ball_long_m"),
        F.when(oriented, distance(mean("x_m"), mean("y_m"), F.col("ball_x"), F.col("ball_y"))).alias("centroid_to_ball_m"),
    ).drop("_first", "_last", "_opp")


def with_hull_per_player(metrics: DataFrame) -> DataFrame:
    out = metrics.withColumn("_h", hull(F.col("ranked.x_m"), F.col("ranked.y_m")))
    return (out.withColumn("hull_area_m2", F.col("_h.area"))
            .withColumn("hull_per_player_m2", F.when((F.col("outfield_count") >= 3) & (F.col("_h.area") > 0), F.col("_h.area") / F.col("outfield_count")))
            .drop("_h"))


def categorise(metrics: DataFrame) -> DataFrame:
    """Block category of a single frame, its confidence and the reason."""
    h, c = F.col("line_height_m"), F.col("centroid_height_m")
    clip = lambda v, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), v))
    centre = (LOW_CEILING_M + HIGH_FLOOR_M) / 2.0
    line_conf = (F.when(h < LOW_CEILING_M, clip(F.lit(0.65) + 0.30 * ((F.lit(LOW_CEILING_M) - h) / LOW_CEILING_M), 0.60, 0.95))
                 .when(h < HIGH_FLOOR_M, clip(F.lit(0.60) + 0.35 * (F.lit(1.0) - F.abs(h - centre) / (HIGH_FLOOR_M - centre)), 0.55, 0.95))
                 .otherwise(clip(F.lit(0.65) + 0.30 * ((h - HIGH_FLOOR_M) / (105.0 - HIGH_FLOOR_M)), 0.60, 0.95)))
    line_conf = line_conf * F.when(F.col("visibility") == "MEDIUM", 0.80).otherwise(1.0)
    seen = F.col("outfield_count") >= MIN_PLAYERS
    oriented = F.col("direction") != 0
    by_line = F.when(h < LOW_CEILING_M, "LOW_BLOCK").when(h < HIGH_FLOOR_M, "MID_BLOCK").otherwise("HIGH_BLOCK")
    by_centroid = F.when(c < CENTROID_LOW_M, "LOW_BLOCK").when(c < CENTROID_HIGH_M, "MID_BLOCK").otherwise("HIGH_BLOCK")
    return (metrics
            .withColumn("category", F.when(~oriented | ~seen, "UNKNOWN").when(h.isNotNull(), by_line).when(c.isNotNull(), by_centroid).otherwise("UNKNOWN"))
            .withColumn("category_conf", F.when(~oriented | ~seen, 0.0).when(h.isNotNull(), line_conf)
                        .when(c.isNotNull(), F.when(F.col("visibility") == "HIGH", 0.55).otherwise(0.45)).otherwise(0.0))
            .withColumn("reason", F.when(~oriented, "UNKNOWN_ORIENTATION").when(~seen, "LOW_VISIBILITY").when(h.isNotNull(), "OK")
                        .when(c.isNotNull(), "FALLBACK_CENTROID_HEIGHT").otherwise("NO_HEIGHT_ESTIMATE")))


def _hysteresis_step(state: dict, pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    held, last, run = state.get("held", "UNKNOWN"), state.get("last", ""), state.get("run", 0)
    confirmed, changed = [], []
    for category in pdf["category"]:
        run = min(run + 1, CONFIRM_CHANGE) if category == last else 1
        last, before = category, held
        if category == "UNKNOWN" or run >= CONFIRM_CHANGE or (held == "UNKNOWN" and run >= CONFIRM_FIRST):
            held = category
        confirmed.append(held)
        changed.append(held != before)
    return pdf.assign(confirmed=confirmed, changed=changed), {"held": held, "last": last, "run": run}


def hysteresis(categories: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Confirmed category: the first needs 3 equal frames, a change needs 10, UNKNOWN drops it at once."""
    return scan(categories.select(*TEAM, "category"), SEQ_TEAM, "frame_index", _hysteresis_step,
                "sequence_id string, frame_index bigint, team_label string, category string, confirmed string, changed boolean", chunk)


def probable_defender(possession: DataFrame) -> DataFrame:
    trusted = F.col("possession_conf") >= POSSESSION_TRUST
    team = F.col("possession_team")
    return possession.withColumn("defending_team", F.when(trusted & (team == "TEAM_0"), "TEAM_1").when(trusted & (team == "TEAM_1"), "TEAM_0").otherwise("UNKNOWN"))
