"""Defensive pressure: target, defenders, cover around the target, compression, index and class."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.functions import frames
from touchline.functions.boxes import let
from touchline.operators.geometry import FRAME, distance

TWO_PI = 2.0 * math.pi
NEAR_M = 8.0
SECTORS = 8
COMPRESSION_ROWS = 7
LIGHT, STRONG, MIN_CARRIER = 0.25, 0.60, 0.45


def opponent_of(team: Column) -> Column:
    return F.when(team == "TEAM_0", "TEAM_1").when(team == "TEAM_1", "TEAM_0").otherwise("UNKNOWN")


def targets(frames_df: DataFrame, players: DataFrame, ball: DataFrame, possession: DataFrame) -> DataFrame:
    """Point under pressure in each frame: the carrier, else the ball at 0.8 of its confidence, else unknown."""
    carrier = players.select(*FRAME, F.col("track_id").alias("carrier_id"), F.col("x_m").alias("cx"), F.col("y_m").alias("cy"),
                             F.coalesce("vx", F.lit(0.0)).alias("cvx"), F.coalesce("vy", F.lit(0.0)).alias("cvy"))
    ball_cols = ball.filter("ball_valid").select(*FRAME, "ball_x", "ball_y", "ball_conf")
    df = (frames_df.select(*FRAME, "timestamp_s").join(possession.select(*FRAME, "possession_team", "carrier_id", "possession_conf"), FRAME, "left")
          .join(carrier, [*FRAME, "carrier_id"], "left").join(ball_cols, FRAME, "left"))
    team = F.col("possession_team")
    by_carrier = F.col("carrier_id").isNotNull() & F.col("cx").isNotNull() & team.isin("TEAM_0", "TEAM_1")
    by_ball = F.col("ball_x").isNotNull()
    kind = F.when(by_carrier, "CARRIER").when(by_ball, "BALL").otherwise("UNKNOWN")
    pick = lambda a, b: F.when(by_carrier, a).when(by_ball, b)
    return df.select(
        *FRAME, "timestamp_s", kind.alias("target_type"), F.when(by_carrier, F.col("carrier_id")).alias("target_id"),
        F.when((by_carrier | by_ball) & team.isin("TEAM_0", "TEAM_1"), team).otherwise("UNKNOWN").alias("target_team"),
        F.coalesce(pick(F.col("possession_conf"), F.col("ball_conf") * 0.80), F.lit(0.0)).alias("target_conf"),
        pick(F.col("cx"), F.col("ball_x")).alias("tx"), pick(F.col("cy"), F.col("ball_y")).alias("ty"),
        pick(F.col("cvx"), F.lit(0.0)).alias("tvx"), pick(F.col("cvy"), F.lit(0.0)).alias("tvy"),
    ).withColumn("defending_team", opponent_of(F.col("target_team")))


def defenders(target: DataFrame, players: DataFrame) -> DataFrame:
    """Child table: every defender against the target of its frame."""
    men = players.filter(F.col("role") != "REFEREE").select(
        *FRAME, F.col("track_id").alias("defender_id"), F.col("team_label").alias("defending_team"), F.col("x_m").alias("dx"), F.col("y_m").alias("dy"),
        F.coalesce("vx", F.lit(0.0)).alias("dvx"), F.coalesce("vy", F.lit(0.0)).alias("dvy"),
        F.coalesce("speed", F.lit(0.0)).alias("dspeed"))
    both = target.filter("target_type <> 'UNKNOWN'").join(men, [*FRAME, "defending_team"])
    df = both.withColumn("distance_m", distance(F.col("tx"), F.col("ty"), F.col("dx"), F.col("dy")))
    d = F.col("distance_m")
    to_x, to_y = F.col("tx") - F.col("dx"), F.col("ty") - F.col("dy")
    closing = F.when(d > 1e-3, (to_x * (F.col("dvx") - F.col("tvx")) + to_y * (F.col("dvy") - F.col("tvy"))) / d).otherwise(0.0)
    cosine = (to_x * F.col("dvx") + to_y * F.col("dvy")) / (d * F.col("dspeed"))
    angle = F.when((F.col("dspeed") > 0.2) & (d > 1e-3), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))).otherwise(90.0)
    df = df.withColumn("closing_mps", closing).withColumn("approach_deg", angle)
    return df.withColumn("contact_s", F.when((F.col("closing_mps") > 0.2) & (d > 0.1), d / F.col("closing_mps")))


def _cover(near: Column) -> Column:
    """Occupied sectors of eight, the widest free angle and its middle, of an array of (angle, ...) structs."""
    return let(F.array_sort(F.transform(near, lambda n: n["angle"])), _cover_of)


def _cover_of(angles: Column) -> Column:
    size = F.size(angles)
    sector = lambda a: F.least(F.lit(SECTORS - 1), F.floor(F.pmod(a + math.pi, F.lit(TWO_PI)) / (TWO_PI / SECTORS)).cast("int"))
    occupied = F.size(F.array_distinct(F.transform(angles, sector)))
    inner = F.zip_with(F.slice(angles, F.lit(2), size), F.slice(angles, F.lit(1), F.greatest(size - 1, F.lit(0))),
                       lambda b, a: F.struct((b - a).alias("gap"), ((a + b) / 2.0).alias("middle")))
    last, first = F.element_at(angles, -1), F.element_at(angles, 1)
    wrap = F.lit(TWO_PI) - (last - first)
    middle = F.pmod(last + wrap / 2.0 + math.pi, F.lit(TWO_PI)) - math.pi
    gaps = F.concat(inner, F.array(F.struct(wrap.alias("gap"), middle.alias("middle"))))
    # the first of equal gaps wins
    widest = lambda g_: F.aggregate(g_, F.element_at(g_, 1), lambda best, g: F.when(g["gap"] > best["gap"], g).otherwise(best))
    told = let(let(gaps, widest), lambda w: F.struct(occupied.alias("occupied"), F.degrees(w["gap"]).alias("gap"), F.degrees(w["middle"]).alias("escape")))
    return F.when(size > 0, told)


def frame_pressure(target: DataFrame, men: DataFrame, compression: DataFrame | None = None) -> DataFrame:
    """One row per frame: nearest three, densities, closing, cover, index and class."""
    d, v = F.col("distance_m"), F.col("closing_mps")
    near = d <= NEAR_M
    angle = F.atan2(F.col("dy") - F.col("ty"), F.col("dx") - F.col("tx"))
    rolled = men.groupBy(*FRAME).agg(
        F.sort_array(F.collect_list(F.struct("distance_m", "defender_id", "closing_mps"))).alias("_ranked"),
        *[F.count_if(d <= r).alias(f"n_r{int(r)}") for r in (2.0, 3.0, 5.0, 8.0)],
        F.avg(F.when(near, v)).alias("_mean_close"), F.max(F.when(near, v)).alias("_max_close"),
        F.count_if(near & (v > 0)).alias("closing_positive"), F.count_if(near & (v >= 1.5)).alias("closing_fast"),
        F.collect_list(F.when(near, F.struct(angle.alias("angle")))).alias("_near"))
    df = target.join(rolled, FRAME, "left")
    if compression is not None:
        df = df.join(compression.select(*FRAME, "compressing"), FRAME, "left")
    else:
        df = df.withColumn("compressing", F.lit(False))
    df = df.withColumn("_cover", _cover(F.col("_near")))
    df = df.select(
        *FRAME, "timestamp_s", "target_type", "target_id", "target_team", "target_conf", "defending_team",
        F.get("_ranked", F.lit(0))["distance_m"].alias("d1"), F.get("_ranked", F.lit(0))["closing_mps"].alias("v1"),
        F.get("_ranked", F.lit(0))["defender_id"].alias("nearest_id"),
        F.get("_ranked", F.lit(1))["distance_m"].alias("d2"), F.get("_ranked", F.lit(2))["distance_m"].alias("d3"),
        *[F.coalesce(f"n_r{r}", F.lit(0)).alias(f"n_r{r}") for r in (2, 3, 5, 8)],
        F.coalesce("_mean_close", F.lit(0.0)).alias("mean_closing"), F.coalesce("_max_close", F.lit(0.0)).alias("max_closing"),
        F.coalesce("closing_positive", F.lit(0)).alias("closing_positive"), F.coalesce("closing_fast", F.lit(0)).alias("closing_fast"),
        F.coalesce(F.col("_cover.occupied"), F.lit(0)).alias("sectors"), F.coalesce(F.col("_cover.gap"), F.lit(360.0)).alias("free_gap_deg"),
        F.coalesce(F.col("_cover.escape"), F.lit(0.0)).alias("escape_deg"),
        F.coalesce(F.get("_ranked", F.lit(0))["distance_m"], F.lit(15.0)).alias("free_space_m"), F.coalesce("compressing", F.lit(False)).alias("compressing"))
    return classify(df.withColumn("coverage", F.col("sectors") / F.lit(float(SECTORS))))


def pressure_index(d1: Column, v1: Column, d2: Column, r2: Column, r3: Column, r5: Column, coverage: Column, compressing: Column) -> Column:
    """Index in [0, 1]: nearness and closing of the first man, the second man, density, cover, compression."""
    closing = (F.when(v1 > 0, F.lit(1.0) + F.least(F.lit(0.80), v1 / 4.0))
               .when(v1 < -1.0, F.greatest(F.lit(0.40), F.lit(1.0) + (v1 + 1.0) / 4.0)).otherwise(1.0))
    density = F.least(F.lit(1.0), r2 * 0.40 + r3 * 0.25 + r5 * 0.15)
    raw = (0.40 * (F.exp(-d1 / 2.8) * closing) + 0.15 * (0.50 * F.exp(-F.coalesce(d2, F.lit(15.0)) / 4.5)) + 0.25 * density
           + 0.15 * coverage + F.when(compressing, 0.08).otherwise(0.0))
    trap = F.lit(1.0) + F.greatest(F.lit(0), r2 - 1) * 0.15 + F.greatest(F.lit(0), r3 - 2) * 0.10
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw * trap))


def classify(rows: DataFrame) -> DataFrame:
    live = (F.col("target_type") != "UNKNOWN") & F.col("d1").isNotNull()
    index = pressure_index(*[F.col(c) for c in ("d1", "v1", "d2", "n_r2", "n_r3", "n_r5", "coverage", "compressing")])
    df = rows.withColumn("pressure_index", F.when(live, index).otherwise(0.0))
    p = F.col("pressure_index")
    weak = (F.col("target_conf") < MIN_CARRIER) & (F.col("target_type") == "CARRIER")
    label = (F.when(F.col("target_type") == "UNKNOWN", "NOT_VISIBLE").when(~live, "NO_PRESSURE").when(weak, "AMBIGUOUS")
             .when(p >= STRONG, "STRONG_PRESSURE").when(p >= LIGHT, "LIGHT_PRESSURE").otherwise("NO_PRESSURE"))
    conf = (F.when(~live, 1.0).when(weak, 0.50).when(p >= STRONG, F.least(F.lit(1.0), F.lit(0.60) + (p - 0.60)))
            .when(p >= LIGHT, 0.75).otherwise(F.least(F.lit(1.0), F.lit(0.60) + (F.lit(0.25) - p) * 1.6)))
    return df.withColumn("pressure_class", label).withColumn("pressure_conf", conf)


def compression(blocks: DataFrame, target: DataFrame, span: int = frames.SPAN) -> DataFrame:
    """Trend of the defending block over its last seven kept samples, whichever team it was.

    ``blocks`` has one row per team and frame; the sample of a frame is the block of the team that defends in it.
    """
    kept = target.select(*FRAME, "defending_team").join(
        blocks.select(*FRAME, F.col("team_label").alias("defending_team"), "timestamp_s", "line_height_m", "depth_m", "width_m", "centroid_to_ball_m"),
        [*FRAME, "defending_team"])
    numbered = frames.ordinal(kept, ["sequence_id"], "frame_index", "_n", span)

    def apply(rows: DataFrame, keys: list[str]) -> DataFrame:
        recent = Window.partitionBy(*keys).orderBy("_n").rowsBetween(1 - COMPRESSION_ROWS, 0)
        sample = F.struct("_n", "timestamp_s", "line_height_m", "depth_m", "width_m", "centroid_to_ball_m")
        return rows.withColumn("_old", F.first(sample).over(recent))

    df = frames.halo(numbered, ["sequence_id"], "_n", apply, before=COMPRESSION_ROWS - 1, span=span)
    dt = F.greatest(F.lit(1e-3), F.col("timestamp_s") - F.col("_old.timestamp_s"))
    rate = lambda c: F.when(F.col("_n") > F.col("_old._n"), F.coalesce((F.col(c) - F.col(f"_old.{c}")) / dt, F.lit(0.0))).otherwise(0.0)
    out = df.select(*FRAME, "defending_team", rate("line_height_m").alias("line_rate"), rate("depth_m").alias("depth_rate"),
                    rate("width_m").alias("width_rate"), rate("centroid_to_ball_m").alias("centroid_rate"))
    return out.withColumn("compressing", (F.col("line_rate") > 0.4) & (F.col("depth_rate") < -0.4) & (F.col("centroid_rate") < -0.4))


def quick_possession(players: DataFrame, ball: DataFrame, reach: float = 2.8) -> DataFrame:
    """Nearest player within 2.8 m of the ball holds it; contested otherwise."""
    from touchline.operators.geometry import ball_proximity

    near = ball_proximity(players, ball)
    held = F.col("nearest_distance_m") < reach
    return near.select(*FRAME, F.when(held, F.col("nearest_team")).otherwise("CONTESTED").alias("possession_team"),
                       F.when(held, F.col("nearest_player_id")).alias("carrier_id"),
                       F.when(held, 0.85).otherwise(0.35).alias("possession_conf"))
