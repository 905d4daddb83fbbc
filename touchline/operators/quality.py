"""Data-quality rules over manifests, annotations and splits; each gives a table of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def violations(rows: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) of every row that breaks a rule; one pass whatever the number of rules."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), name) for name, test in rules.items()]))
    return rows.select(key.alias("key"), F.explode(broken).alias("rule"))


def frame_uid(golden_id: Column, frame: Column) -> Column:
    return F.concat(golden_id, F.lit("_f"), F.lpad(frame.cast("string"), 6, "0"))


def manifest_violations(inventory: DataFrame, fps: float = 25.0, width: int = 1920, height: int = 1080) -> DataFrame:
    """Frame inventory checks: sizes, uid form, time stamp, and uids used twice."""
    ok = {"size": (F.col("width") == width) & (F.col("height") == height), "frame_range": F.col("frame_index") >= 0,
          "uid_format": F.col("frame_uid") == frame_uid(F.col("golden_id"), F.col("frame_index")),
          "timestamp": F.abs(F.col("timestamp_seconds") - F.col("frame_index") / fps) <= 1e-6}
    single = violations(inventory, F.col("frame_uid"), ok)
    twice = inventory.groupBy(F.col("frame_uid").alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.lit("duplicate_uid").alias("rule"))
    return single.unionByName(twice)


def membership(inventory: DataFrame, manifest: DataFrame, key: str = "frame_uid") -> DataFrame:
    """Keys found on one side only."""
    a, b = inventory.select(key).distinct(), manifest.select(key).distinct()
    return (a.join(b, key, "left_anti").withColumn("side", F.lit("inventory_only"))
            .unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("manifest_only"))))


def annotation_violations(boxes: DataFrame, actors: DataFrame, allowed: list[str], width: float = 1920.0, height: float = 1080.0) -> DataFrame:
    """Boxes off the image or empty, values outside the list, unknown actors."""
    known = actors.select("track_id").distinct().withColumn("_known", F.lit(True))
    rules = {"box_inside": (F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") <= width) & (F.col("y2") <= height),
             "box_area": (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), "role_allowed": F.col("role").isin(*allowed), "actor_known": F.coalesce("_known", F.lit(False))}
    return violations(boxes.join(known, "track_id", "left"), F.col("event_id"), rules)


def split_leakage(rows: DataFrame, key: str = "key", split: str = "split") -> DataFrame:
    """Keys that appear in more than one split."""
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(split)), ",").alias("splits"), F.count_distinct(split).alias("_n")).filter("_n > 1").drop("_n")


def split_fingerprint(rows: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """Rows and an order-free fingerprint of each split: the sum of the row digests, modulo 2^61 - 1."""
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    part = F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.pmod(F.sum(part), F.lit(2305843009213693951).cast("decimal(38,0)")).cast("bigint").alias("fingerprint"))


def ingest_report(items: DataFrame) -> DataFrame:
    """Outcome of each item of a batch; an item without url or id is invalid."""
    lacking = F.coalesce(F.col("url"), F.lit("")).eqNullSafe("") | F.col("item_id").isNull()
    return items.withColumn("status", F.when(lacking, "invalid").otherwise("success"))


def expired(rows: DataFrame, at: str, cutoff: Column) -> DataFrame:
    """Rows older than the cutoff, both as ISO text."""
    return rows.filter(F.col(at) < cutoff)
