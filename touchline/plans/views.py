"""The driver's tables re-read as tracking, statistics and text tables (see FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a table is fewer files than cores; a large table is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per player and frame: 22 players, 150 frames per sequence, 25 frames a second."""
    return tracking_of(table(spark, sf_dir, "events"))


def tracking_of(events: DataFrame) -> DataFrame:
    """The tracking view over any frame of events, batch or stream."""
    f, slot, k, fi, sgn = F.col("f"), F.col("slot"), F.col("k"), F.col("fi"), F.col("sgn")
    base_x = F.when(k == 0, -4800).when(k <= 4, -3000).when(k <= 8, -1000).otherwise(1200)
    base_y = (F.when(k == 0, 0).when(k <= 4, (2 * k - 5) * 600).when(k <= 8, (2 * k - 13) * 600)
              .otherwise((2 * k - 19) * 800))
    sway = F.abs((fi * 20) % 2000 - 1000) - 500
    swing_x = F.abs((fi * (slot + 7)) % 800 - 400) - 200
    swing_y = F.abs((fi * (slot + 5) * 3) % 600 - 300) - 150
    number = F.expr("f div 150")
    label = F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))
    return (
        events
        .selectExpr("event_id", "event_id div 22 AS f", "event_id % 22 AS slot", "(event_id % 22) % 11 AS k",
                    "(event_id div 22) % 150 + 1 AS fi", "CASE WHEN event_id % 22 < 11 THEN 1 ELSE -1 END AS sgn")
        .select(
            "event_id", "f",
            F.concat(F.lit("SEQ-"), label).alias("sequence_id"),
            fi.alias("frame_index"), ((fi - 1) / F.lit(25.0)).alias("timestamp_s"),
            slot.alias("track_id"),
            F.when(slot < 11, "TEAM_0").otherwise("TEAM_1").alias("team_label"),
            F.when(k == 0, "GOALKEEPER").otherwise("OUTFIELD_PLAYER").alias("role"),
            ((sgn * base_x + sway + swing_x) / F.lit(100.0)).alias("x_m"),
            ((sgn * base_y + swing_y) / F.lit(100.0)).alias("y_m"),
            (F.col("event_id") % 37 != 0).alias("position_valid"),
            ((F.col("event_id") * 7 % 70 + 30) / F.lit(100.0)).alias("team_confidence"),
        )
    )


def ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ball position per frame, next to a carrier that changes every 12 frames."""
    f = F.col("f")
    return (
        tracking(spark, sf_dir)
        .filter(F.expr("track_id = ((f div 12) * 7) % 22"))
        .select("sequence_id", "frame_index", "timestamp_s", "f",
                (F.col("x_m") + (f % 12 - 6) * 30 / F.lit(100.0)).alias("ball_x"), F.col("y_m").alias("ball_y"),
                (f % 41 != 0).alias("ball_valid"), ((f * 11 % 50 + 50) / F.lit(100.0)).alias("ball_conf"))
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel boxes of the players, by linear scaling of the pitch to 1920 x 1080."""
    u = (F.col("x_m") + 52.5) / 105.0 * 1920.0
    v = (F.col("y_m") + 34.0) / 68.0 * 1080.0
    return tracking(spark, sf_dir).select(
        "event_id", "sequence_id", "frame_index", "track_id", "team_label", "role", "position_valid",
        (u - 15.0).alias("x1"), (v - 90.0).alias("y1"), (u + 15.0).alias("x2"), v.alias("y2"))


def predicted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``boxes`` shifted, thinned and with a few swapped ids: predictions to score against the truth."""
    e = F.col("event_id")
    other = F.when(F.col("team_label") == "TEAM_0", "TEAM_1").otherwise("TEAM_0")
    return boxes(spark, sf_dir).filter(e % 29 != 0).select(
        "event_id", "sequence_id", "frame_index",
        F.when(e % 101 == 0, (F.col("track_id") + 1) % 22).otherwise(F.col("track_id")).alias("pred_track_id"),
        F.when(e % 53 == 0, other).otherwise(F.col("team_label")).alias("pred_team"),
        (F.col("x1") + e % 7).alias("px1"), F.col("y1").alias("py1"),
        (F.col("x2") + e % 7).alias("px2"), F.col("y2").alias("py2"),
        (e * 37 % 1000 / F.lit(1000.0)).alias("conf"))


def player_match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season totals per player and competition from the order tables."""
    first = F.col("o_orderpriority").startswith("1")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"),
        F.concat(F.lit("season_"), F.year("o_orderdate").cast("string"),
                 F.when(first, "_cl").otherwise("_summary")).alias("match_id"),
        F.when(first, "Champions League").otherwise("Domestic League").alias("competition"))
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    keys = ["match_id", "c_custkey", "competition"]
    totals = lines.join(orders, "l_orderkey").groupBy(*keys).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("minutes_played"),
        F.count_if(F.col("l_returnflag") == "R").alias("goals"),
        (F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.lit(100.0)).alias("expected_goals"),
        (F.sum(F.round(F.col("l_tax") * 100).cast("long")) / F.lit(100.0)).alias("expected_assists"),
        F.count_if(F.col("l_linestatus") == "O").alias("key_passes"),
        F.sum("l_linenumber").cast("long").alias("progressive_dribbles"),
        F.count(F.lit(1)).alias("defensive_pressures"))
    return (totals.join(people.join(nations, "c_nationkey"), "c_custkey")
            .select("match_id", F.col("c_name").alias("player_name"), F.col("n_name").alias("team_name"),
                    "competition", "minutes_played", "goals", "expected_goals", "expected_assists", "key_passes",
                    "progressive_dribbles", "defensive_pressures"))


def player_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    nations = (table(spark, sf_dir, "nation").join(regions, "n_regionkey")
               .select(F.col("n_nationkey").alias("c_nationkey"), "r_name"))
    slot = F.col("c_custkey") % 4
    return (table(spark, sf_dir, "customer").join(nations, "c_nationkey")
            .select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("player_name"),
                    F.when(slot == 0, "GK").when(slot == 1, "DEF").when(slot == 2, "MID").otherwise("FWD")
                    .alias("position"),
                    F.col("c_acctbal").alias("market_value"), F.col("r_name").alias("league")))


def player_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0")
            .select(F.col("c_custkey").alias("player_id"),
                    ((F.col("c_custkey") % 40 + 60) / F.lit(10.0)).alias("rating")))


def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 3 x 3 image-to-pitch matrix per frame, with keyframes every ten frames and some invalid ones."""
    f = F.col("f")
    h = [(f % 50 + 800) / F.lit(10000.0), (f % 7) / F.lit(1000.0), F.lit(-50.0), (f % 5) / F.lit(1000.0),
         (f % 40 + 600) / F.lit(10000.0), F.lit(-32.0), (f % 3) / F.lit(100000.0), (f % 4) / F.lit(100000.0), F.lit(1.0)]
    return ball(spark, sf_dir).select("sequence_id", "frame_index", (f % 10 == 0).alias("keyframe"),
                                      (f % 23 != 0).alias("cal_valid"), F.array(*h).alias("h"))


def ball_pixels(ball_rows: DataFrame) -> DataFrame:
    return (ball_rows.withColumn("ball_u", (F.col("ball_x") + 52.5) / 105.0 * 1920.0)
            .withColumn("ball_v", (F.col("ball_y") + 34.0) / 68.0 * 1080.0))


_SHARED: dict[tuple, DataFrame] = {}


def _version(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of what lies in a folder of tables."""
    every = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/*")
    found = every.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(every)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found or ()))


def shared(name: str, spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """A frame table several queries read, computed once per session and version of the tables, and kept as files in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _version(spark, sf_dir))
    if key not in _SHARED:
        _SHARED[key] = cut_lineage(build(spark, sf_dir))
    return _SHARED[key]


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a title line, and with some of their lines turned into headers."""
    mark = lambda line: (F.when(F.length(line) % 17 == 5, F.concat(F.lit("## "), line)).when(F.length(line) % 19 == 5, F.concat(F.lit("### "), line)).otherwise(line))
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"),
        F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise(""),
                 F.array_join(F.transform(F.split("text", "\n"), mark), "\n")).alias("text"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text, whole."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


PHRASES = ["Pourquoi le bloc est bas entre 2.5s et 6 secondes", "Que se passe-t-il a 12.4s avec team 0", "bonjour", "une pizza", "le score final du match",
           "comment fonctionne le pressing en 4-3-3", "qui a le ballon frame 145", "pressing PSG en premiere mi-temps", "fin de match, transition a la 72e minute",
           "plus compact, team 1", "faire un exercice pour eviter la perte de balle 442", "attaquer le bloc bas de inter en ligue 1 avec vitinha"]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with one of a dozen football phrases put in front."""
    slot = (F.col("conv_id") % len(PHRASES)).cast("int")
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), slot)
    return (table(spark, sf_dir, "conversations").filter("role = 'user'")
            .select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(phrase, F.lit(" "), "text").alias("query")))


def match_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One match report text per order."""
    k = F.col("o_orderkey")
    line = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    team = lambda salt: line("Team", ((k * salt) % 20).cast("string"))
    n = lambda expr: expr.cast("string")
    text = F.concat_ws("\n", line("Match: ", team(7), " vs ", line("Side", n(k * 3 % 20))), line("Score: ", n(k % 5), "-", n(k % 3)),
                       F.when(k % 4 != 0, line("Date: ", F.date_format("o_orderdate", "yyyy-MM-dd"))), F.when(k % 5 == 0, line("Competition: Coupe")),
                       line(team(7), ": Possession ", n(k % 100), "%, Passes ", n(k % 700), ", Tirs ", n(k % 20), ", xG ", n(k % 4), ".", n(k % 10), ", Bloc style low-block"),
                       line("- ", n(k % 95 + 1), "e minute: (Home) But de la tete"), F.when(k % 2 == 0, line("- ", n(k % 60 + 1), "e minute: (Away) Transition rapide")))
    return spread(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("report_id"), text.alias("text"))
