"""Season tables, look-ups, similarity, joins and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions.text_match import fold_accents, redact_url
from touchline.operators import stats
from touchline.plans import views
from touchline.plans.registry import query, rounded

TOTAL_SQL = """max(team_name) AS team_name, CAST(sum(minutes_played) AS BIGINT) AS minutes, CAST(sum(goals) AS BIGINT) AS goals,
  round(round(sum(expected_goals), 6), 1) AS xg, round(round(sum(expected_assists), 6), 1) AS xa, CAST(sum(key_passes) AS BIGINT) AS key_passes,
  CAST(sum(progressive_dribbles) AS BIGINT) AS dribbles_prog, CAST(sum(defensive_pressures) AS BIGINT) AS pressions_def"""
ROW_SQL = """minutes_played AS minutes, goals, round(expected_goals, 6) AS xg, round(expected_assists, 6) AS xa, key_passes, progressive_dribbles AS dribbles_prog, defensive_pressures AS pressions_def"""


def tidy(df, places=6):
    return df.select(*[rounded(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _stats(spark, sf_dir):
    return views.player_match_stats(spark, sf_dir)


@query("season_totals", "A1 P21", f"""
SELECT player_name, {TOTAL_SQL} FROM player_match_stats_v
WHERE player_name ILIKE '%omer#%' AND match_id ILIKE 'season_1997_%' GROUP BY 1""")
def season_totals(spark, sf_dir):
    return tidy(stats.season_totals(_stats(spark, sf_dir), "season_1997_summary", "OMER#"))


@query("season_lookup", "A1 P21", f"""
SELECT player_name, {TOTAL_SQL} FROM player_match_stats_v
WHERE player_name ILIKE '%#00000007%' AND match_id ILIKE 'season_1998_%' GROUP BY 1 ORDER BY 1 LIMIT 5""")
def season_lookup(spark, sf_dir):
    return tidy(stats.look_up(stats.season_totals(_stats(spark, sf_dir), "season_1998", "#00000007")))


@query("champions_rows", "A2", f"""
SELECT player_name, team_name, {ROW_SQL} FROM player_match_stats_v
WHERE competition = 'Champions League' AND match_id ILIKE 'season_1997_%' AND player_name ILIKE '%customer%'""")
def champions_rows(spark, sf_dir):
    return tidy(stats.champions_rows(_stats(spark, sf_dir), "season_1997_summary", "customer"))


@query("season_rollup", "A3 P22", """
SELECT player_name, count(*) AS matches, CAST(sum(minutes_played) AS BIGINT) AS minutes, CAST(sum(goals) AS BIGINT) AS goals,
 round(sum(expected_goals), 6) AS xg, round(sum(expected_assists), 6) AS xa, CAST(sum(key_passes) AS BIGINT) AS key_passes,
 CAST(sum(progressive_dribbles) AS BIGINT) AS dribbles_prog, CAST(sum(defensive_pressures) AS BIGINT) AS pressions_def
FROM player_match_stats_v WHERE contains(lower(player_name), 'omer#00000001') OR contains(lower(player_name), '#00000002') GROUP BY 1""")
def season_rollup(spark, sf_dir):
    return tidy(stats.season_rollup(_stats(spark, sf_dir), ["Omer#00000001", "#00000002"]))


@query("accent_fold", "P22", """
SELECT doc_id, length(strip_accents(lower(text))) AS n, md5(strip_accents(lower(text))) AS folded FROM documents""")
def accent_fold(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", fold_accents(F.col("text")).alias("t"))
    return docs.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("folded"))


@query("match_counts", "A4", """
SELECT match_id, count(*) AS players, CAST(sum(goals) AS BIGINT) AS goals FROM player_match_stats_v WHERE match_id ILIKE 'season_%' GROUP BY 1""")
def match_counts(spark, sf_dir):
    return stats.match_counts(_stats(spark, sf_dir))


@query("top_players", "O1", f"""
SELECT player_name, {TOTAL_SQL} FROM player_match_stats_v WHERE match_id ILIKE 'season_1997_%' GROUP BY 1
ORDER BY sum(goals) + sum(key_passes) DESC, player_name LIMIT 15""")
def top_players(spark, sf_dir):
    return tidy(stats.top_players(stats.season_totals(_stats(spark, sf_dir), "season_1997_summary")))


@query("top_champions", "O2", f"""
SELECT player_name, team_name, {ROW_SQL} FROM player_match_stats_v WHERE match_id ILIKE 'season_1997_%' AND competition = 'Champions League'
ORDER BY goals + key_passes DESC, player_name, team_name LIMIT 15""")
def top_champions(spark, sf_dir):
    return tidy(stats.top_players(stats.champions_rows(_stats(spark, sf_dir), "season_1997_summary")))


@query("profiles_with_ratings", "J1", """
SELECT player_id, player_name, position, market_value, league, rating FROM player_profiles_v LEFT JOIN player_ratings_v USING (player_id)""")
def profiles_with_ratings(spark, sf_dir):
    return stats.profiles_with_ratings(views.player_profiles(spark, sf_dir), views.player_ratings(spark, sf_dir))


SEASON_SQL = """
prof AS (SELECT player_name, position, market_value, rating FROM player_profiles_v LEFT JOIN player_ratings_v USING (player_id)),
tot AS (SELECT s.player_name, team_name, position, market_value, rating, sum(minutes_played)::BIGINT AS minutes, sum(goals)::BIGINT AS goals,
  sum(expected_goals) AS xg, sum(expected_assists) AS xa, sum(key_passes)::BIGINT AS key_passes, sum(progressive_dribbles)::BIGINT AS dribbles_prog,
  sum(defensive_pressures)::BIGINT AS pressions_def
  FROM player_match_stats_v s LEFT JOIN prof USING (player_name) WHERE match_id ILIKE 'season_1997%' GROUP BY 1, 2, 3, 4, 5)"""


def _season_profiles(spark, sf_dir):
    profiles = stats.profiles_with_ratings(views.player_profiles(spark, sf_dir), views.player_ratings(spark, sf_dir))
    return stats.season_profiles(_stats(spark, sf_dir), profiles, "season_1997")


@query("season_profiles", "J2", f"""
WITH {SEASON_SQL} SELECT player_name, team_name, position, market_value, rating, minutes, goals, round(xg, 6) AS xg, round(xa, 6) AS xa, key_passes, dribbles_prog, pressions_def FROM tot""")
def season_profiles(spark, sf_dir):
    return tidy(_season_profiles(spark, sf_dir))


@query("per_90_vectors", "P24", f"""
WITH {SEASON_SQL} SELECT player_name, team_name, round(goals / minutes * 90.0, 6) AS goals_90, round(xg / minutes * 90.0, 6) AS xg_90,
 round(xa / minutes * 90.0, 6) AS xa_90, round(key_passes / minutes * 90.0, 6) AS key_passes_90, round(dribbles_prog / minutes * 90.0, 6) AS dribbles_prog_90,
 round(pressions_def / minutes * 90.0, 6) AS pressions_def_90 FROM tot WHERE minutes > 0""")
def per_90_vectors(spark, sf_dir):
    v = stats.per_90(_season_profiles(spark, sf_dir))
    return v.select("player_name", "team_name", *[rounded(F.col("vec_90")[i]).alias(f"{n}_90") for i, n in enumerate(stats.PER_90)])


@query("nearest_players", "O3", f"""
WITH {SEASON_SQL}, v AS (SELECT *, goals / minutes * 90.0 AS a, xg / minutes * 90.0 AS b, xa / minutes * 90.0 AS c, key_passes / minutes * 90.0 AS d, dribbles_prog / minutes * 90.0 AS e, pressions_def / minutes * 90.0 AS f FROM tot WHERE minutes > 0),
t AS (SELECT * FROM v WHERE player_name = 'Customer#000000001')
SELECT v.player_name, v.team_name, v.minutes, round(100.0 / (1.0 + sqrt((v.a - t.a) * (v.a - t.a) + (v.b - t.b) * (v.b - t.b) + (v.c - t.c) * (v.c - t.c) + (v.d - t.d) * (v.d - t.d) + (v.e - t.e) * (v.e - t.e) + (v.f - t.f) * (v.f - t.f))), 6) AS similarity
FROM v, t WHERE v.player_name <> t.player_name AND v.minutes >= 400 ORDER BY 4 DESC, 1, 2 LIMIT 5""")
def nearest_players(spark, sf_dir):
    near = stats.nearest_players(_season_profiles(spark, sf_dir), "Customer#000000001")
    return near.select("player_name", "team_name", "minutes", rounded(F.col("similarity")).alias("similarity"))


@query("resolve_player", "P21", """
SELECT min(c_name) AS player_name FROM customer WHERE c_name ILIKE '%customer%' AND c_name ILIKE '%0042%' AND c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)""")
def resolve_player(spark, sf_dir):
    return stats.resolve_player(_stats(spark, sf_dir), ["customer", "0042"])


def _reimport(spark, sf_dir):
    table = _stats(spark, sf_dir).select("match_id", "player_name", "goals", "minutes_played")
    again = (table.filter("goals % 3 = 0").select(
        F.when(F.col("goals") % 2 == 0, F.col("match_id")).otherwise(F.concat("match_id", F.lit("_new"))).alias("match_id"),
        "player_name", (F.col("goals") + 100).alias("goals"), "minutes_played"))
    return table, again


REIMPORT_SQL = """
cur AS (SELECT match_id, player_name, goals, minutes_played FROM player_match_stats_v),
inc AS (SELECT CASE WHEN goals % 2 = 0 THEN match_id ELSE match_id || '_new' END AS match_id, player_name, goals + 100 AS goals, minutes_played FROM cur WHERE goals % 3 = 0)"""


@query("stats_upsert", "S16 O14", f"""
WITH {REIMPORT_SQL} SELECT * FROM inc UNION ALL SELECT cur.* FROM cur WHERE NOT EXISTS (SELECT 1 FROM inc WHERE inc.match_id = cur.match_id AND inc.player_name = cur.player_name)""")
def stats_upsert(spark, sf_dir):
    current, incoming = _reimport(spark, sf_dir)
    return stats.upsert(current, incoming.withColumn("_position", F.col("goals")), ["match_id", "player_name"])


@query("stats_insert_absent", "S18", f"""
WITH {REIMPORT_SQL} SELECT * FROM cur UNION ALL SELECT inc.* FROM inc WHERE NOT EXISTS (SELECT 1 FROM cur WHERE inc.match_id = cur.match_id AND inc.player_name = cur.player_name)""")
def stats_insert_absent(spark, sf_dir):
    current, incoming = _reimport(spark, sf_dir)
    return stats.insert_absent(current, incoming, ["match_id", "player_name"])


@query("stats_purge", "S19", """
SELECT match_id, count(*) AS rows_kept FROM player_match_stats_v WHERE NOT (match_id ILIKE 'season_%_summary') GROUP BY 1""")
def stats_purge(spark, sf_dir):
    return stats.purge(_stats(spark, sf_dir)).groupBy("match_id").agg(F.count(F.lit(1)).alias("rows_kept"))


@query("profile_upsert", "S17", """
WITH cur AS (SELECT c_custkey AS player_id, c_name AS player_name, c_mktsegment AS league, c_acctbal AS market_value FROM customer WHERE c_custkey % 2 = 0),
inc AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 7 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS player_id, c_name AS player_name, 'new' AS league, c_acctbal + 1 AS market_value FROM customer WHERE c_custkey % 3 = 0)
SELECT cur.player_id, cur.player_name, coalesce(inc.league, cur.league) AS league, round(coalesce(inc.market_value, cur.market_value), 2) AS market_value
FROM cur LEFT JOIN inc ON inc.player_name = cur.player_name
UNION ALL SELECT player_id, player_name, league, round(market_value, 2) FROM inc WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.player_name = inc.player_name)""")
def profile_upsert(spark, sf_dir):
    people = views.table(spark, sf_dir, "customer")
    shape = lambda id_col, league, value: [id_col.alias("player_id"), F.col("c_name").alias("player_name"), F.lit("MID").alias("position"),
                                           value.alias("market_value"), F.lit(1.0).alias("rating"), league.alias("league")]
    key = F.col("c_custkey")
    current = people.filter("c_custkey % 2 = 0").select(*shape(key, F.col("c_mktsegment"), F.col("c_acctbal")))
    incoming = people.filter("c_custkey % 3 = 0").select(
        *shape(F.when(key % 7 == 0, key + 1000000).otherwise(key), F.lit("new"), F.col("c_acctbal") + 1), key.alias("_position"))
    return stats.upsert_profiles(current, incoming).select("player_id", "player_name", "league", rounded(F.col("market_value"), 2).alias("market_value"))


@query("sql_gate", "P28", """
WITH q AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'SELECT ' || text WHEN 1 THEN text WHEN 2 THEN 'select a; ' || text ELSE 'SELECT x FROM t -- ' || text END AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN NOT regexp_matches(c, '^SELECT\\s', 'i') THEN 'NOT_A_SELECT'
  WHEN regexp_matches(upper(c), '\\b(DROP|DELETE|UPDATE|INSERT|ALTER|CREATE|ATTACH|DETACH|PRAGMA|VACUUM|TRUNCATE)\\b|--|/\\*|;') THEN 'FORBIDDEN_SYNTAX' END AS refusal
FROM (SELECT conv_id, turn, trim(regexp_replace(trim(t), ';+$', '')) AS c FROM q)""")
def sql_gate(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations")
    slot = F.col("turn") % 4
    text = (F.when(slot == 0, F.concat(F.lit("SELECT "), "text")).when(slot == 1, F.col("text"))
            .when(slot == 2, F.concat(F.lit("select a; "), "text")).otherwise(F.concat(F.lit("SELECT x FROM t -- "), "text")))
    return turns.select("conv_id", "turn", stats.unsafe_sql(text).alias("refusal"))


@query("result_columns", "P26", """
SELECT c_name AS player_name, c_acctbal AS market_value, c_custkey AS minutes, 0 AS goals, 0.0::DOUBLE AS xg, 0.0::DOUBLE AS xa, 0 AS key_passes, 0 AS dribbles_prog, 0 AS pressions_def, c_mktsegment FROM customer""")
def result_columns(spark, sf_dir):
    raw = views.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("Joueur"), F.col("c_acctbal").alias("prix_valeur"), F.col("c_custkey").alias("Min_total"), "c_mktsegment")
    return stats.normalise_columns(raw)


@query("url_redaction", "P25", """
SELECT page_id, CASE WHEN strpos(u, '?') > 0 THEN substr(u, 1, strpos(u, '?') - 1) ELSE u END AS url
FROM (SELECT page_id, split_part(url, '#', 1) AS u FROM pages)""")
def url_redaction(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", redact_url(F.col("url")).alias("url"))
