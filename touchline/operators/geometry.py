"""Team geometry per frame: gate, shape, hull, occupancy and distances.

Everything that needs the players of one team in one frame is computed from a single
``groupBy(sequence, frame, team)``; the group is one team, so the collected arrays stay short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions.boxes import is_inside, let
from touchline.functions.hull import hull

FRAME = ["sequence_id", "frame_index"]
TEAM = [*FRAME, "team_label"]
MIN_TEAM_CONFIDENCE = 0.40
LANES = ["left_wide", "left_half_space", "central", "right_half_space", "right_wide"]


def team_code(label: Column) -> Column:
    """Fixed team name for the many spellings of a side; null when neither side is named."""
    text = F.upper(F.trim(label))
    return (F.when(text.isin("A", "TEAM_A") | text.contains("0") | text.contains("LEFT"), "TEAM_0")
            .when(text.isin("B", "TEAM_B") | text.contains("1") | text.contains("RIGHT"), "TEAM_1"))


def gate(observations: DataFrame, margin: float = 0.0, min_confidence: float = MIN_TEAM_CONFIDENCE) -> DataFrame:
    """Rows fit for team geometry: valid, on the pitch and of a trusted team."""
    return (observations
            .withColumn("team_label", team_code(F.col("team_label")))
            .filter(F.col("position_valid") & F.col("x_m").isNotNull() & F.col("y_m").isNotNull()
                    & is_inside(F.col("x_m"), F.col("y_m"), margin)
                    & F.col("team_label").isNotNull() & (F.col("team_confidence") >= min_confidence)))


def outfield(players: DataFrame) -> DataFrame:
    return players.filter(~F.upper(F.col("role")).contains("GOALKEEPER"))


def grid_cell(x: Column, y: Column) -> Column:
    """Cell 0..14 of the 5 x 3 grid: three per length zone."""
    third = F.lit(34.0) / F.lit(3.0)
    zone = F.when(x >= 31.5, 4).when(x <= -31.5, 0).when(x < -10.5, 1).when(x < 10.5, 2).otherwise(3)
    channel = F.when(y >= third, 2).when(y <= -third, 0).otherwise(1)
    return (zone * 3 + channel).cast("int")


def lane(y: Column) -> Column:
    return (F.when(y <= -20.4, LANES[0]).when(y <= -6.8, LANES[1]).when(y <= 6.8, LANES[2])
            .when(y <= 20.4, LANES[3]).otherwise(LANES[4]))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values)


def median_of(values: Column) -> Column:
    """Median of a short array, averaging the middle pair."""
    def middle(ordered: Column) -> Column:
        # nulls would stand last: a middle beyond the values is null
        n = F.size(values)
        low = F.get(ordered, F.floor((n + 1) / 2).cast("int") - 1)
        high = F.get(ordered, F.floor((n + 2) / 2).cast("int") - 1)
        return F.when(n > 0, (low + high) / 2.0)

    return let(F.sort_array(F.array_compact(values)), middle)


def team_frames(players: DataFrame) -> DataFrame:
    """One row per team and frame: counts, extents and the point array the other measures read."""
    return players.groupBy(*TEAM).agg(
        F.first("timestamp_s").alias("timestamp_s"),
        F.count(F.lit(1)).alias("players"),
        F.avg("x_m").alias("centroid_x"), F.avg("y_m").alias("centroid_y"),
        F.percentile("x_m", 0.5).alias("median_x"), F.percentile("y_m", 0.5).alias("median_y"),
        (F.max("y_m") - F.min("y_m")).alias("_width"), (F.max("x_m") - F.min("x_m")).alias("_span"),
        F.sort_array(F.collect_list(F.struct("track_id", "x_m", "y_m"))).alias("points"))


def team_shape(players: DataFrame) -> DataFrame:
    """Centroids, extents and stretch; extents need two players."""
    pair = F.col("players") >= 2
    spread = F.transform("points", lambda p: distance(p["x_m"], p["y_m"], F.col("centroid_x"), F.col("centroid_y")))
    return (team_frames(players)
            .withColumn("width_m", F.when(pair, F.col("_width")))
            .withColumn("span_m", F.when(pair, F.col("_span")))
            .withColumn("stretch_m", F.when(pair, mean_of(spread)))
            .drop("_width", "_span"))


def with_hull(shapes: DataFrame) -> DataFrame:
    out = shapes.withColumn("_hull", hull(F.col("points.x_m"), F.col("points.y_m")))
    return (out.withColumn("hull_area_m2", F.col("_hull.area")).withColumn("hull_perimeter_m", F.col("_hull.perimeter"))
            .withColumn("hull_vertices", F.col("_hull.vertices")).drop("_hull"))


def with_pair_distances(shapes: DataFrame) -> DataFrame:
    """Mean and median distance between teammates, and the mean distance to the nearest one."""
    points = F.col("points")
    pairs = F.flatten(F.transform(points, lambda p: F.transform(
        F.filter(points, lambda q: q["track_id"] > p["track_id"]),
        lambda q: distance(p["x_m"], p["y_m"], q["x_m"], q["y_m"]))))
    nearest = F.transform(points, lambda p: F.array_min(F.transform(
        F.filter(points, lambda q: q["track_id"] != p["track_id"]),
        lambda q: distance(p["x_m"], p["y_m"], q["x_m"], q["y_m"]))))
    enough = F.col("players") >= 2
    return (shapes.withColumn("_pairs", pairs)
            .withColumn("mean_pairwise_m", F.when(enough, mean_of(F.col("_pairs"))))
            .withColumn("median_pairwise_m", F.when(enough, median_of(F.col("_pairs"))))
            .withColumn("mean_nearest_m", F.when(enough, mean_of(nearest)))
            .drop("_pairs"))


def both_teams(shapes: DataFrame) -> DataFrame:
    """One row per frame with the point arrays of both teams side by side."""
    def of(team: str, column: str) -> Column:
        return F.max(F.when(F.col("team_label") == team, F.col(column)))
    return shapes.groupBy(*FRAME).agg(*[of(t, c).alias(f"{c}_{n}") for n, t in enumerate(("TEAM_0", "TEAM_1"))
                                        for c in ("points", "centroid_x", "centroid_y", "median_x", "median_y")])


def inter_team(shapes: DataFrame) -> DataFrame:
    """Distances between the teams: centroids, median centroids and the mean nearest opponent."""
    def nearest(own: str, other: str) -> Column:
        return F.transform(own, lambda p: F.array_min(F.transform(
            other, lambda q: distance(p["x_m"], p["y_m"], q["x_m"], q["y_m"]))))
    wide = both_teams(shapes).filter(F.col("points_0").isNotNull() & F.col("points_1").isNotNull())
    return wide.select(
        *FRAME,
        distance(*[F.col(c) for c in ("centroid_x_0", "centroid_y_0", "centroid_x_1", "centroid_y_1")])
        .alias("centroid_distance_m"),
        distance(*[F.col(c) for c in ("median_x_0", "median_y_0", "median_x_1", "median_y_1")])
        .alias("median_centroid_distance_m"),
        mean_of(F.concat(nearest("points_0", "points_1"), nearest("points_1", "points_0")))
        .alias("nearest_opponent_mean_m"))


def occupancy(players: DataFrame) -> DataFrame:
    """Zero-filled counts of the 15 cells and the five lanes."""
    cell, strip = grid_cell(F.col("x_m"), F.col("y_m")), lane(F.col("y_m"))
    return players.groupBy(*TEAM).agg(
        *[F.count_if(cell == n).alias(f"cell_{n}") for n in range(15)],
        *[F.count_if(strip == name).alias(name) for name in LANES])


def ball_proximity(players: DataFrame, ball: DataFrame) -> DataFrame:
    """Nearest player to the ball, overall and per team; ties go to TEAM_0, then to the lower track id."""
    at = players.join(ball.filter("ball_valid").select(*FRAME, "ball_x", "ball_y"), FRAME)
    away = at.withColumn("d", distance(F.col("ball_x"), F.col("ball_y"), F.col("x_m"), F.col("y_m")))
    def first(team: str | None, field: str) -> Column:
        key = F.struct("d", "team_label", "track_id")
        return F.min(key if team is None else F.when(F.col("team_label") == team, key))[field]
    return away.groupBy(*FRAME).agg(
        first(None, "track_id").alias("nearest_player_id"), first(None, "team_label").alias("nearest_team"),
        first(None, "d").alias("nearest_distance_m"),
        first("TEAM_0", "track_id").alias("team_0_player_id"), first("TEAM_0", "d").alias("team_0_distance_m"),
        first("TEAM_1", "track_id").alias("team_1_player_id"), first("TEAM_1", "d").alias("team_1_distance_m"))


def quick_frame_metrics(boxes: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """Linear image-to-pitch scaling, for footage without a calibration."""
    return (boxes.withColumn("pitch_x", (F.col("x1") + F.col("x2")) / 2.0 / F.lit(width) * 105.0 - 52.5)
            .withColumn("pitch_y", F.col("y2") / F.lit(height) * 68.0 - 34.0))


def crop_gate(boxes: DataFrame, min_height: float = 35.0, min_width: float = 15.0, aspect: tuple[float, float] = (1.2, 4.5),
              border: float = 2.0, max_iou: float = 0.20, image: tuple[float, float] = (1920.0, 1080.0)) -> DataFrame:
    """Flag boxes fit for an appearance crop: large enough, upright, off the border and not overlapped."""
    from touchline.functions.boxes import iou

    mine = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    per_frame = boxes.groupBy(*FRAME).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_others"))
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    clash = F.exists("_others", lambda o: ~((o["x1"] == mine[0]) & (o["y1"] == mine[1]) & (o["x2"] == mine[2]) & (o["y2"] == mine[3]))
                     & (iou(mine, [o["x1"], o["y1"], o["x2"], o["y2"]]) >= max_iou))
    shape = (height >= min_height) & (width >= min_width) & (height / F.greatest(F.lit(1.0), width)).between(*aspect)
    inside = ((F.col("x1") >= border) & (F.col("y1") >= border) & (F.col("x2") <= image[0] - border) & (F.col("y2") <= image[1] - border))
    return boxes.join(per_frame, FRAME).withColumn("usable", shape & inside & ~clash).drop("_others")
