"""Camera calibration tables: projection of boxes, staleness of the last keyframe, jitter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.functions import boxes as bx, frames

FRAME = ["sequence_id", "frame_index"]
MAX_KEYFRAME_AGE = 10


def project_boxes(boxes: DataFrame, calibrations: DataFrame, is_ball: bool = False) -> DataFrame:
    """Pitch position of each box through the calibration of its frame, with the reason when there is none."""
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    joined = boxes.join(calibrations.select(*FRAME, "h", "cal_valid"), FRAME, "left")
    u, v = bx.anchor(box, is_ball)
    joined = joined.withColumn("_at", bx.project(F.col("h"), u, v))
    reason = (F.coalesce(bx.anchor_problem(box, is_ball), F.when(~F.coalesce(F.col("cal_valid"), F.lit(False)), "INVALID_CALIBRATION"),
                         F.when(F.col("_at").isNull(), "UNPROJECTABLE_HOMOGRAPHY")))
    return (joined.withColumn("state", F.coalesce(reason, F.lit("OK")))
            .withColumn("pitch_x", F.when(F.col("state") == "OK", F.col("_at.x")))
            .withColumn("pitch_y", F.when(F.col("state") == "OK", F.col("_at.y"))).drop("h", "_at"))


def staleness(calibrations: DataFrame, max_age: int = MAX_KEYFRAME_AGE, span: int = frames.SPAN) -> DataFrame:
    """Age of the last keyframe and the state it implies; ``recalibrate`` says why a new keyframe is due."""
    marked = calibrations.withColumn("_key", F.when(F.col("keyframe") & F.col("cal_valid"), F.col("frame_index")))
    known = frames.last_known(marked, ["sequence_id"], "frame_index", {"_key": "last_keyframe"}, span=span)
    age = F.col("frame_index") - F.col("last_keyframe")
    return (known.withColumn("age", age)
            .withColumn("state", F.when(age.isNull(), "INVALID").when(age == 0, "CALIBRATED")
                        .when(age <= max_age, "PROPAGATED").otherwise("STALE"))
            .withColumn("recalibrate", F.when(age.isNull(), "NO_INITIAL_CALIBRATION")
                        .when(age >= max_age, "MAX_AGE_EXCEEDED").otherwise("NONE"))
            .drop("_key"))


def cadence_summary(states: DataFrame) -> DataFrame:
    def rate(test: Column, name: str) -> Column:
        return F.round(F.avg(F.when(test, 1.0).otherwise(0.0)), 6).alias(name)
    state = F.col("state")
    return states.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("frames"), rate(F.col("cal_valid"), "valid_rate"),
        rate(state == "CALIBRATED", "keyframe_rate"), rate(state == "PROPAGATED", "propagated_rate"),
        F.round(F.avg("age"), 6).alias("mean_age"))


def ground_jump(calibrations: DataFrame, span: int = frames.SPAN) -> DataFrame:
    """Frame-to-frame movement of a fixed image point on the pitch, and of the centre mark in the image."""
    ground = bx.project(F.col("h"), F.lit(480.0), F.lit(450.0))
    centre = bx.project(bx.invert(F.col("h")), F.lit(0.0), F.lit(0.0))
    marked = calibrations.withColumn("p", F.struct(F.col("cal_valid").alias("ok"), F.col("frame_index").alias("at"),
                                                   ground.alias("g"), centre.alias("c")))

    def lagged(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.withColumn("q", F.lag("p").over(Window.partitionBy(*keys).orderBy("frame_index")))

    pairs = (frames.halo(marked, ["sequence_id"], "frame_index", lagged, before=1, span=span)
             .filter("p.ok AND q.ok AND p.at - q.at = 1"))
    jump = F.sqrt(F.pow(F.col("p.g.x") - F.col("q.g.x"), 2) + F.pow(F.col("p.g.y") - F.col("q.g.y"), 2))
    jitter = F.sqrt(F.pow(F.col("p.c.x") - F.col("q.c.x"), 2) + F.pow(F.col("p.c.y") - F.col("q.c.y"), 2))
    return pairs.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg(jump), 6).alias("mean_jump_m"), F.round(F.max(jump), 6).alias("max_jump_m"),
        F.round(F.percentile(jitter, 0.95), 4).alias("p95_centre_jitter_px"))
