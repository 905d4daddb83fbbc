"""Player statistics: season tables, look-ups, similarity, profiles, upserts and the guarded SQL entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from touchline.functions.text_match import contains_name, fold_accents, season_pattern

TOTALS = {"minutes": "minutes_played", "goals": "goals", "xg": "expected_goals", "xa": "expected_assists",
          "key_passes": "key_passes", "dribbles_prog": "progressive_dribbles", "pressions_def": "defensive_pressures"}
PER_90 = ["goals", "xg", "xa", "key_passes", "dribbles_prog", "pressions_def"]
MIN_MINUTES = 400
TOP_PLAYERS = 15
NEAREST = 5


def _season(stats: DataFrame, season: str) -> DataFrame:
    return stats.filter(F.col("match_id").ilike(season_pattern(season)))


def _sums(places: int | None = 1) -> list[Column]:
    out = []
    for name, source in TOTALS.items():
        total = F.sum(source)
        out.append((F.round(F.round(total, 6), places) if places is not None and name in ("xg", "xa") else total).alias(name))
    return out


def season_totals(stats: DataFrame, season: str, name_part: str = "") -> DataFrame:
    """Totals per player over one season, for the players whose name holds ``name_part``."""
    chosen = _season(stats, season).filter(contains_name(F.col("player_name"), name_part))
    return chosen.groupBy("player_name").agg(F.max("team_name").alias("team_name"), *_sums())


def champions_rows(stats: DataFrame, season: str, name_part: str = "") -> DataFrame:
    """The Champions League rows of one season, as stored."""
    chosen = _season(stats, season).filter((F.col("competition") == "Champions League")
                                           & contains_name(F.col("player_name"), name_part))
    return chosen.select("player_name", "team_name", *[F.col(s).alias(n) for n, s in TOTALS.items()])


def look_up(rows: DataFrame, limit: int = 5) -> DataFrame:
    """First rows by name; the name and team make the cut repeatable."""
    return rows.orderBy("player_name", "team_name").limit(limit)


def top_players(rows: DataFrame, limit: int = TOP_PLAYERS) -> DataFrame:
    return rows.orderBy((F.col("goals") + F.col("key_passes")).desc(), "player_name", "team_name").limit(limit)


def season_rollup(stats: DataFrame, name_parts: list[str] | None = None) -> DataFrame:
    """Totals over everything stored, for the players that match any of the names, accents ignored."""
    chosen = stats
    if name_parts:
        test = F.lit(False)
        for part in name_parts:
            test = test | F.col("_plain").contains(part.lower())
        names = stats.select("player_name").distinct().withColumn("_plain", fold_accents(F.col("player_name"))).filter(test)
        chosen = stats.join(names.drop("_plain"), "player_name", "left_semi")
    return chosen.groupBy("player_name").agg(F.count(F.lit(1)).alias("matches"), *_sums(None))


def match_counts(stats: DataFrame, pattern: str = "season_%") -> DataFrame:
    return (stats.filter(F.col("match_id").ilike(pattern)).groupBy("match_id")
            .agg(F.count(F.lit(1)).alias("players"), F.sum("goals").alias("goals")))


def profiles_with_ratings(profiles: DataFrame, ratings: DataFrame) -> DataFrame:
    return profiles.join(ratings.select("player_id", "rating"), "player_id", "left")


def season_profiles(stats: DataFrame, profiles: DataFrame, season: str) -> DataFrame:
    """Season totals with the player's profile; here the season is used as given, as a plain prefix."""
    keys = ["player_name", "team_name", "position", "market_value", "rating"]
    totals = (stats.filter(F.col("match_id").ilike(f"{season}%"))
              .groupBy("player_name", "team_name").agg(*_sums(None)))
    joined = totals.join(profiles.select("player_name", "position", "market_value", "rating"), "player_name", "left")
    return joined.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in TOTALS])


def per_90(totals: DataFrame) -> DataFrame:
    values = [F.coalesce(F.col(n), F.lit(0)) / F.col("minutes") * F.lit(90.0) for n in PER_90]
    return totals.filter("minutes > 0").withColumn("vec_90", F.array(*[v.cast("double") for v in values]))


def similarity(a: Column, b: Column) -> Column:
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)
    return F.lit(100.0) / (F.lit(1.0) + F.sqrt(gap))


def nearest_players(totals: DataFrame, target: str, limit: int = NEAREST, min_minutes: int = MIN_MINUTES) -> DataFrame:
    """Players most like ``target`` per 90 minutes.  One vector is compared with all rows; no pair join."""
    vectors = per_90(totals)
    first = (vectors.filter(F.col("player_name") == target).orderBy("team_name").limit(1)
             .select(F.col("vec_90").alias("_target")))
    scored = (vectors.filter((F.col("player_name") != target) & (F.col("minutes") >= min_minutes))
              .crossJoin(F.broadcast(first)).withColumn("similarity", similarity(F.col("vec_90"), F.col("_target"))))
    return scored.drop("_target").orderBy(F.desc("similarity"), "player_name", "team_name").limit(limit)


def resolve_player(names: DataFrame, words: list[str]) -> DataFrame:
    """One name: the first that holds every word, else the first that holds the longest word with a hit."""
    distinct = names.select("player_name").distinct()
    every = F.lit(True)
    for word in words:
        every = every & contains_name(F.col("player_name"), word)
    rank = F.when(every, 0)
    for place, word in enumerate(sorted(words, key=len, reverse=True), start=1):
        rank = rank.when(contains_name(F.col("player_name"), word), place)
    return (distinct.withColumn("rank", rank).filter("rank IS NOT NULL")
            .orderBy("rank", "player_name").limit(1).select("player_name"))


def keep_latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last row per key by ``order``; ``max_by`` keeps the combine on the map side, so a hot key is cheap."""
    packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return packed.select("_row.*")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert, or replace the row of the same key; among incoming rows the highest ``_position`` wins."""
    both = (current.withColumn("_position", F.lit(-1).cast("long"))
            .unionByName(incoming.withColumn("_position", F.col("_position").cast("long"))))
    return keep_latest(both, keys, [F.col("_position")]).drop("_position")


def upsert_profiles(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert profiles; a row that meets a stored id or a stored name updates that row instead.

    The stored id and name stay, the other fields take the incoming values.  ``incoming`` carries ``_position``.
    """
    fields = ["position", "market_value", "rating", "league"]
    clean = incoming.filter("player_name IS NOT NULL").withColumn("player_name", F.trim("player_name"))
    new = (clean.join(current.select("player_id"), "player_id", "left_anti")
           .join(current.select("player_name"), "player_name", "left_anti"))
    first_by_id = new.groupBy("player_id").agg(F.min_by(F.struct(*clean.columns), "_position").alias("r")).select("r.*")
    inserted = first_by_id.groupBy("player_name").agg(F.min_by(F.struct(*clean.columns), "_position").alias("r")).select("r.*")
    stored = current.withColumn("_position", F.lit(-1).cast("long")).unionByName(inserted.select(*current.columns, "_position"))
    patch = F.struct("_position", *fields)
    hits = (clean.select("player_id", patch.alias("p1")).groupBy("player_id").agg(F.max("p1").alias("p1")))
    names = (clean.select("player_name", patch.alias("p2")).groupBy("player_name").agg(F.max("p2").alias("p2")))
    joined = stored.join(hits, "player_id", "left").join(names, "player_name", "left")
    best = F.greatest("p1", "p2")
    newer = best.isNotNull() & (best["_position"] > F.col("_position"))
    return joined.select("player_id", "player_name", *[F.when(newer, best[f]).otherwise(F.col(f)).alias(f) for f in fields])


def insert_absent(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return current.unionByName(incoming.join(current.select(*keys), keys, "left_anti"))


def purge(rows: DataFrame, pattern: str = "season_%_summary") -> DataFrame:
    return rows.filter(~F.col("match_id").ilike(pattern))


FORBIDDEN = ["DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "CREATE", "ATTACH", "DETACH", "PRAGMA", "VACUUM", "TRUNCATE"]
_FORBIDDEN_RE = r"\b(" + "|".join(FORBIDDEN) + r")\b|--|/\*|;"


def unsafe_sql(text: Column) -> Column:
    """Why a user's SQL is refused, or null: only one SELECT, no writing keyword, no comment."""
    clean = F.trim(F.regexp_replace(F.trim(text), r";+$", ""))
    return (F.when(~clean.rlike(r"(?i)^SELECT\s"), "NOT_A_SELECT")
            .when(F.upper(clean).rlike(_FORBIDDEN_RE), "FORBIDDEN_SYNTAX"))


def run_user_sql(spark: SparkSession, text: str) -> DataFrame:
    refusal = spark.range(1).select(unsafe_sql(F.lit(text)).alias("why")).first()["why"]
    if refusal:
        raise ValueError(refusal)
    return normalise_columns(spark.sql(text.strip().rstrip(";")))


# For each canonical column, the parts that name it and the exact names, tested in this order.
RESULT_NAMES: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = [
    ("player_name", ("player_name",), ("player", "nom", "joueur")),
    ("minutes", ("min",), ()),
    ("xg", ("xg", "expected_goals"), ()),
    ("xa", ("xa", "expected_assists"), ()),
    ("dribbles_prog", ("dribble", "carry", "dribb"), ()),
    ("pressions_def", ("press",), ()),
    ("goals", ("goal",), ("gls", "but", "buts")),
    ("key_passes", ("key", "kp", "pass"), ()),
    ("competition", ("competition",), ()),
    ("team_name", ("team_name", "equipe"), ("team", "squad", "club")),
    ("market_value", ("value", "valeur", "price", "tarif"), ()),
    ("rating", ("rating", "note"), ()),
    ("position", ("position", "poste"), ("pos",)),
]
RESULT_DEFAULTS = {"player_name": "Unknown", "minutes": 0, "goals": 0, "xg": 0.0, "xa": 0.0, "key_passes": 0,
                   "dribbles_prog": 0, "pressions_def": 0}


def canonical_name(column: str) -> str:
    low = column.lower()
    for name, parts, exact in RESULT_NAMES:
        if low in exact or any(p in low for p in parts):
            return name
    return column


def normalise_columns(rows: DataFrame) -> DataFrame:
    """Rename result columns to the canonical names (the last of two equal ones wins) and add the defaults."""
    chosen: dict[str, str] = {}
    for column in rows.columns:
        chosen[canonical_name(column)] = column
    out = [F.col(f"`{source}`").alias(name) for name, source in chosen.items()]
    out += [F.lit(value).alias(name) for name, value in RESULT_DEFAULTS.items() if name not in chosen]
    return rows.select(*out)
