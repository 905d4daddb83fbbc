"""Team split of the tracks of each sequence by two-means over track features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.session import cut_lineage

MIN_CROPS, MIN_TRACKS = 3, 4
OUTLIER_QUANTILE, WEAK = 0.88, 0.35
TRACK = ["sequence_id", "track_id"]


def track_features(observations: DataFrame, how: str = "median") -> DataFrame:
    """One unit vector per track: the coordinate-wise median (or mean) of all its observations."""
    kept = observations
    long = kept.select(*TRACK, F.posexplode("feature").alias("dim", "value"))
    middle = F.percentile("value", 0.5) if how == "median" else F.avg("value")
    by_dim = long.groupBy(*TRACK, "dim").agg(middle.alias("m"), F.count(F.lit(1)).alias("crops"))
    packed = by_dim.groupBy(*TRACK).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("_v"), F.max("crops").alias("crops"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, v: a + v * v))
    return packed.withColumn("_n", norm).select(*TRACK, "crops", F.when(F.col("_n") > 0, F.transform("_v", lambda v: v / F.col("_n"))).otherwise(F.col("_v")).alias("feature"))


def _gap(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v))


def _means(assigned: DataFrame) -> DataFrame:
    dims = assigned.select("sequence_id", "side", F.posexplode("feature").alias("dim", "value")).groupBy("sequence_id", "side", "dim").agg(F.avg("value").alias("m"))
    packed = dims.groupBy("sequence_id", "side").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("c"))
    return packed.groupBy("sequence_id").agg(F.max(F.when(F.col("side") == 0, F.col("c"))).alias("c0"), F.max(F.when(F.col("side") == 1, F.col("c"))).alias("c1"))


def _assign(features: DataFrame, centres: DataFrame) -> DataFrame:
    df = features.join(F.broadcast(centres), "sequence_id")  # one row per sequence travels, never the tracks
    df = df.withColumn("d0", _gap(F.col("feature"), F.col("c0"))).withColumn("d1", _gap(F.col("feature"), F.col("c1")))
    return df.withColumn("side", F.when(F.col("d0") <= F.col("d1"), 0).otherwise(1)).drop("c0", "c1")


def split_teams(features: DataFrame) -> DataFrame:
    """Two groups per sequence, all sequences advancing together until no centre moves; roles from outliers.

    The first centre is the track with the lowest id, the second the track farthest from it.  A sequence with
    fewer than four tracks of three crops stays UNKNOWN, and so does a track with fewer crops.
    """
    usable = features.filter(F.col("crops") >= MIN_CROPS)
    enough = usable.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= MIN_TRACKS).select("sequence_id")
    points = cut_lineage(usable.join(F.broadcast(enough), "sequence_id", "left_semi"))
    first = points.groupBy("sequence_id").agg(F.min_by("feature", "track_id").alias("c0"))
    away = points.join(F.broadcast(first), "sequence_id").withColumn("_d", _gap(F.col("feature"), F.col("c0")))
    centres = away.groupBy("sequence_id").agg(F.first("c0").alias("c0"), F.max_by("feature", F.struct("_d", (-F.col("track_id")).alias("t"))).alias("c1"))
    while True:  # each round lowers the sum of distances or changes nothing
        new = cut_lineage(_means(_assign(points, centres)))
        still = new.join(centres.withColumnsRenamed({"c0": "p0", "c1": "p1"}), "sequence_id").filter("c0 <> p0 OR c1 <> p1").isEmpty()
        centres = new
        if still:
            break
    df = _assign(points, centres).withColumn("conf", F.abs(F.col("d0") - F.col("d1")) / F.greatest(F.lit(1e-6), F.col("d0") + F.col("d1")))
    nearest = F.least("d0", "d1")
    limit = F.percentile(nearest, OUTLIER_QUANTILE).over(Window.partitionBy("sequence_id"))
    df = df.withColumn("outlier", (nearest >= limit) & (F.col("conf") < WEAK))
    named = df.select(*TRACK, F.when(F.col("side") == 0, "TEAM_0").otherwise("TEAM_1").alias("team_label"), "conf", "outlier")
    return features.select(*TRACK, "crops").join(named, TRACK, "left").select(
        *TRACK, "crops", F.coalesce("team_label", F.lit("UNKNOWN")).alias("team_label"), F.coalesce("conf", F.lit(0.0)).alias("team_conf"),
        F.coalesce("outlier", F.lit(False)).alias("outlier"))


def roles(teams: DataFrame, positions: DataFrame, image_width: float = 1920.0, margin: float = 0.20) -> DataFrame:
    """Role of each track: an outlier near the left or right edge is a goalkeeper, elsewhere a referee without a team."""
    side = (F.col("mean_u") <= image_width * margin) | (F.col("mean_u") >= image_width * (1 - margin))
    df = teams.join(positions, TRACK, "left")
    role = F.when(F.col("team_label") == "UNKNOWN", "UNKNOWN").when(F.col("outlier") & side, "GOALKEEPER").when(F.col("outlier"), "REFEREE").otherwise("OUTFIELD_PLAYER")
    return df.withColumn("role", role).withColumn("team_label", F.when(F.col("role") == "REFEREE", "UNKNOWN").otherwise(F.col("team_label")))


# ---- mixture ------------------------------------------------------------------------------------------------

MOST_ROUNDS, STILL, LEAST_VARIANCE = 25, 1e-4, 1e-9


def _moments(points: DataFrame) -> DataFrame:
    """Per sequence, from points with ``r`` (the share of side 1): both means, the share of side 1 and the common variance of a coordinate."""
    long = points.select("sequence_id", "r", F.posexplode("feature").alias("dim", "v"))
    sums = long.groupBy("sequence_id", "dim").agg((F.sum(F.col("v") * (1 - F.col("r"))) / F.sum(1 - F.col("r"))).alias("m0"), (F.sum(F.col("v") * F.col("r")) / F.sum("r")).alias("m1"))
    packed = sums.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("dim", "m0", "m1"))).alias("_d"))
    means = packed.select("sequence_id", F.transform("_d", lambda d: d["m0"]).alias("c0"), F.transform("_d", lambda d: d["m1"]).alias("c1"))
    df = points.join(F.broadcast(means), "sequence_id").withColumn("d0", _gap(F.col("feature"), F.col("c0"))).withColumn("d1", _gap(F.col("feature"), F.col("c1")))
    spread = df.groupBy("sequence_id").agg(F.avg("r").alias("w1"), (F.sum((1 - F.col("r")) * F.col("d0") * F.col("d0") + F.col("r") * F.col("d1") * F.col("d1")) / F.sum(F.size("feature"))).alias("_s"))
    return means.join(spread.select("sequence_id", "w1", F.greatest("_s", F.lit(LEAST_VARIANCE)).alias("s2")), "sequence_id")


def mixture_teams(features: DataFrame, start: DataFrame) -> DataFrame:
    """Split by two round components with one variance: ``sequence_id, track_id, team_label, share``.

    Expectation maximisation from the two-means split ``start``, all sequences advancing together until no share of a track
    changes by more than a ten-thousandth, or 25 rounds. ``share`` is the probability of TEAM_1. Tracks that ``start`` leaves
    UNKNOWN stay so; a sequence whose split has an empty side keeps it.
    """
    sides = start.filter("team_label <> 'UNKNOWN'").select(*TRACK, (F.col("team_label") == "TEAM_1").cast("double").alias("r"))
    both = sides.groupBy("sequence_id").agg(F.min("r").alias("_a"), F.max("r").alias("_b")).filter("_a < _b").select("sequence_id")
    points = cut_lineage(features.select(*TRACK, "feature").join(sides, TRACK).join(F.broadcast(both), "sequence_id", "left_semi"))
    for _ in range(MOST_ROUNDS):
        df = points.join(F.broadcast(_moments(points)), "sequence_id")
        d0, d1 = _gap(F.col("feature"), F.col("c0")), _gap(F.col("feature"), F.col("c1"))
        odds = F.ln(F.col("w1")) - F.ln(1 - F.col("w1")) + (d0 * d0 - d1 * d1) / (2 * F.col("s2"))
        # shares stay off the ends, so that neither side ever empties
        share = F.least(F.greatest(1 / (1 + F.exp(-odds)), F.lit(1e-6)), F.lit(1 - 1e-6))
        new = cut_lineage(df.select(*TRACK, "feature", F.col("r").alias("_old"), share.alias("r")))
        still = new.filter(F.abs(F.col("r") - F.col("_old")) > STILL).isEmpty()
        points = new.drop("_old")
        if still:
            break
    named = points.select(*TRACK, F.when(F.col("r") >= 0.5, "TEAM_1").otherwise("TEAM_0").alias("team_label"), F.col("r").alias("share"))
    kept = start.select(*TRACK, F.col("team_label").alias("_t"))
    return kept.join(named, TRACK, "left").select(*TRACK, F.coalesce("team_label", "_t").alias("team_label"), F.when(F.col("_t") != "UNKNOWN", F.coalesce("share", (F.col("_t") == "TEAM_1").cast("double"))).alias("share"))
