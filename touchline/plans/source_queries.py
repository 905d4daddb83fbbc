"""Parsing rules of the readers, over lines that Spark derives from the tables; sinks; the control model."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import schemas
from touchline.operators import evaluation, models, possession as poss
from touchline.plans import views
from touchline.plans.events_queries import ball_motion, boxed_players
from touchline.plans.registry import query, rounded
from touchline.plans.stats_queries import tidy
from touchline.session import new_path
from touchline.sources import readers, sinks


@query("mot_lines", "S1", """
SELECT event_id % 7 AS lane, count(*) AS boxes, sum(event_id // 22)::BIGINT AS frames, min(greatest(0.0, event_id % 50 - 10))::DOUBLE AS least_x, max(event_id % 50 - 10 + 30.5)::DOUBLE AS most_x
FROM events WHERE event_id % 9 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 GROUP BY 1""")
def mot_lines(spark, sf_dir):
    e = F.col("event_id")
    n = lambda c: c.cast("string")
    sep = F.when(e % 2 == 0, ";").otherwise(",")
    line = F.concat_ws("", n(F.expr("event_id div 22")), sep, n(e % 7), sep, n(e % 50 - 10), sep, n(e % 40), F.lit(",30.5,60"),
                       F.when(e % 11 == 0, F.lit(",0,-1,-1,-1")).when(e % 3 == 0, F.lit("")).otherwise(F.lit(",1,-1,-1,-1")))
    text = F.when(e % 9 == 0, F.concat(F.lit("# "), line)).when(e % 13 == 0, "1,2,3").otherwise(line)
    boxes = readers.parse_mot(views.table(spark, sf_dir, "events").select(F.lit("S").alias("sequence_id"), text.alias("value")))
    return boxes.groupBy(F.col("track_id").alias("lane")).agg(F.count(F.lit(1)).alias("boxes"), F.sum("frame_index").alias("frames"), F.min("x1").alias("least_x"), F.max("x2").alias("most_x"))


@query("yolo_labels", "S2", """
WITH r AS (SELECT event_id, dense_rank() OVER (ORDER BY lpad(CAST(event_id // 22 AS VARCHAR), 8, '0')) AS frame_index, event_id % 3 AS c, (event_id % 10) / 10.0::DOUBLE AS cx FROM events)
SELECT frame_index, CASE c WHEN 0 THEN 'person' ELSE 'ball' END AS class, count(*) AS boxes, round(sum(greatest(0.0, (cx - 0.05) * 1920)), 4) AS sum_x1 FROM r WHERE c <> 2 GROUP BY 1, 2""")
def yolo_labels(spark, sf_dir):
    e = F.col("event_id")
    rows = views.table(spark, sf_dir, "events").select(F.concat(F.lit("f_"), F.lpad(F.expr("event_id div 22").cast("string"), 8, "0"), F.lit(".txt")).alias("path"),
                                                       F.concat_ws(" ", (e % 3).cast("string"), (e % 10 / F.lit(10.0)).cast("string"), F.lit("0.5 0.1 0.2")).alias("value"))
    boxes = readers.parse_yolo(rows, ["person", "ball", "ignored"], 1920, 1080)
    return tidy(boxes.groupBy("frame_index", "class").agg(F.count(F.lit(1)).alias("boxes"), F.round(F.sum("x1"), 4).alias("sum_x1")), 4)


@query("track_roles", "S3", """
SELECT event_id AS track_id, CASE event_id % 4 WHEN 0 THEN 'OUTFIELD_PLAYER' WHEN 1 THEN 'GOALKEEPER' WHEN 2 THEN 'REFEREE' ELSE 'BALL' END AS role, CASE event_id % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS team, CAST(event_id % 30 AS VARCHAR) AS jersey FROM events WHERE event_id % 10 <> 0""")
def track_roles(spark, sf_dir):
    e = F.col("event_id")
    kind = F.when(e % 4 == 0, "player team left").when(e % 4 == 1, "goalkeepers team right").when(e % 4 == 2, "referee").otherwise("ball")
    line = F.when(e % 10 == 0, "[Sequence]").otherwise(F.concat(F.lit("trackletID_"), e.cast("string"), F.lit("= "), kind, F.lit(";"), (e % 30).cast("string")))
    return readers.parse_track_roles(views.table(spark, sf_dir, "events").select(F.lit("S").alias("sequence_id"), line.alias("value"))).drop("sequence_id")


@query("season_csv", "S7", """
SELECT c_name AS player_name, CAST(c_custkey % 3000 AS INTEGER) AS minutes_played, CAST(c_custkey % 20 AS INTEGER) AS goals, round((c_custkey % 90) / 10.0, 6)::DOUBLE AS expected_goals, round((c_custkey % 70) / 10.0, 6)::DOUBLE AS expected_assists,
 CAST(c_custkey % 50 AS INTEGER) AS key_passes, CAST((c_custkey % 20) * 4 + (c_custkey % 50) * 2 AS INTEGER) AS defensive_pressures FROM customer""")
def season_csv(spark, sf_dir):
    k = F.col("c_custkey")
    raw = views.table(spark, sf_dir, "customer").select(F.col("c_name").alias("Player"), (k % 3000).cast("string").alias("Min"), (k % 20).cast("string").alias("Gls"),
                                                        F.lit("9").alias("npxG"), (k % 90 / F.lit(10.0)).cast("string").alias("xG"), (k % 70 / F.lit(10.0)).cast("string").alias("xAG"), (k % 50).cast("string").alias("KP"))
    return tidy(readers.season_rows(raw, "season_2025_2026_summary").select("player_name", "minutes_played", "goals", "expected_goals", "expected_assists", "key_passes", "defensive_pressures"))


@query("two_level_stats", "S8", """
SELECT CASE c_custkey % 3 WHEN 0 THEN 'season_2024_2025_cl' ELSE 'season_2025_2026_cl' END AS match_id, c_name AS player_name, CAST(c_custkey % 900 AS INTEGER) AS minutes_played, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE CAST(c_custkey % 7 AS INTEGER) END AS goals FROM customer WHERE c_custkey % 3 < 2""")
def two_level_stats(spark, sf_dir):
    k = F.col("c_custkey")
    raw = views.table(spark, sf_dir, "customer").select(F.when(k % 3 == 0, "2425").when(k % 3 == 1, "2526").otherwise("2324").alias("x_season"), F.col("c_name").alias("x_player"),
                                                        (k % 900).cast("string").alias("Playing Time_Min"), F.when(k % 4 != 0, (k % 7).cast("string")).alias("Performance_Gls"))
    return readers.two_level_rows(raw).select("match_id", "player_name", "minutes_played", "goals")


@query("api_fixtures", "S11", """
SELECT '2025_03_0' || o_orderkey % 9 + 1 || '_team_' || o_orderkey % 20 || '_club_' || o_orderkey % 11 || '_01' AS match_id, CAST(o_orderkey % 4 AS INTEGER) AS score_home, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE (o_orderkey % 100)::DOUBLE END AS home_possession, 0.0::DOUBLE AS away_possession,
 CAST(o_orderkey % 90 + o_orderkey % 3 AS INTEGER) AS minute FROM orders WHERE o_orderkey % 6 <> 0""")
def api_fixtures(spark, sf_dir):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    body = F.concat(
        F.lit('{"fixture": {"id": '), s(k), F.lit(', "date": "2025-03-0'), s(k % 9 + 1), F.lit('T20:00:00", "status": {"short": "'), F.when(k % 6 == 0, "NS").otherwise("FT"),
        F.lit('"}}, "teams": {"home": {"name": "Team '), s(k % 20), F.lit('"}, "away": {"name": "Club '), s(k % 11), F.lit('"}}, "goals": {"home": '), s(k % 4),
        F.lit(', "away": null}, "statistics": [{"team": {"name": "Team '), s(k % 20), F.lit('"}, "statistics": [{"type": "Ball Possession", "value": '),
        F.when(k % 5 == 0, "null").otherwise(F.concat(F.lit('"'), s(k % 100), F.lit('%"'))), F.lit('}]}], "events": [{"time": {"elapsed": '), s(k % 90), F.lit(', "extra": '),
        F.when(k % 3 == 0, "null").otherwise(s(k % 3)), F.lit('}, "team": {"name": "x"}, "type": "Goal", "detail": "d"}]}'))
    rows = views.table(spark, sf_dir, "orders").select(F.from_json(body, schemas.FIXTURE).alias("f")).select("f.*")
    m = readers.fixtures_to_matches(rows)
    return m.select("match_id", "score_home", F.col("team_stats")[F.col("home_team")]["possession_pct"].alias("home_possession"),
                    F.col("team_stats")[F.col("away_team")]["possession_pct"].alias("away_possession"), F.get("events", F.lit(0))["minute"].alias("minute"))


@query("frame_records", "S13 S14", """
WITH p AS (SELECT sequence_id, frame_index, count(*) AS players FROM tracking_v GROUP BY 1, 2) SELECT p.sequence_id, p.frame_index, players, coalesce(ball_valid, false) AS ball FROM p LEFT JOIN ball_v b ON b.sequence_id = p.sequence_id AND b.frame_index = p.frame_index""")
def frame_records(spark, sf_dir):
    records = sinks.frame_records(views.tracking(spark, sf_dir), views.ball(spark, sf_dir))
    path = new_path(spark, "frames")
    sinks.write_frames_jsonl(records, path)
    back = spark.read.schema(records.schema).json(path)
    return back.select("sequence_id", "frame_index", F.size("players").cast("long").alias("players"), F.coalesce("ball.ball_valid", F.lit(False)).alias("ball"))


@query("session_tables", "S15", """
SELECT 'events' AS name, sequence_id, count(*) AS rows FROM evidence_v GROUP BY 2 UNION ALL SELECT 'edges', sequence_id, count(*) FROM links_v GROUP BY 2""")
def session_tables(spark, sf_dir):
    from touchline.plans.evidence_queries import evidence, links

    root = new_path(spark, "session")
    e, g = evidence(spark, sf_dir), links(spark, sf_dir)
    sinks.write_session(e, g, e.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("events")), root)
    count = lambda name: spark.read.parquet(f"{root}/{name}").groupBy("sequence_id").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "sequence_id", "rows")
    return count("events").unionByName(count("edges"))


@query("control_model", "V18")
def control_model(spark, sf_dir):
    """Fit the control model to the nearest-player truth on two thirds of the ten-frame blocks and score the candidates of the others.

    The distance that decides the truth is no input.
    """
    feats = poss.in_reach(poss.control_features(boxed_players(spark, sf_dir), ball_motion(spark, sf_dir)))
    best = feats.groupBy("sequence_id", "frame_index").agg(F.min_by("track_id", "metric_dist").alias("nearest"))
    names = [c for c in poss.STATELESS if c not in ("track_conf", "ball_state", "calibrated", "metric_dist")]
    rows = feats.join(best, ["sequence_id", "frame_index"]).withColumn("y", (F.col("track_id") == F.col("nearest")).cast("double"))
    kept_back = F.crc32(F.concat_ws("/", "sequence_id", F.floor(F.col("frame_index") / 10))) % 3 == 0
    scored = models.control_probability(models.fit_control(rows.filter(~kept_back), names), rows.filter(kept_back))
    return tidy(evaluation.calibration_error(scored), 2)


# ---- files written and read again ---------------------------------------------------------------------------

_BOX_LINES = "SELECT event_id, 'SEQ' || lpad(CAST(event_id // 3300 AS VARCHAR), 4, '0') AS sequence_id, event_id // 22 AS frame_index, event_id % 22 AS track_id FROM events"


@query("mot_files", "S1", f"""
WITH b AS ({_BOX_LINES}) SELECT sequence_id, frame_index, track_id, (event_id % 700)::DOUBLE AS x1, (event_id % 700 + 30.5)::DOUBLE AS x2 FROM b WHERE event_id % 11 <> 0""")
def mot_files(spark, sf_dir):
    """``<sequence>/gt/gt.txt`` files."""
    e = F.col("event_id")
    name = F.concat(F.lit("SEQ"), F.lpad(F.expr("event_id div 3300").cast("string"), 4, "0"), F.lit("/gt/gt.txt"))
    line = F.concat_ws(",", F.expr("event_id div 22").cast("string"), (e % 22).cast("string"), (e % 700).cast("string"), F.lit("10"), F.lit("30.5"), F.lit("60"), F.when(e % 11 == 0, "0").otherwise("1"))
    folder = new_path(spark, "mot")
    sinks.write_lines(views.table(spark, sf_dir, "events").select(name.alias("name"), e.alias("line_no"), line.alias("value")), folder)
    return readers.read_mot(spark, f"{folder}/*/gt/*.txt").select("sequence_id", "frame_index", "track_id", "x1", "x2")


@query("yolo_files", "S2", """
WITH b AS (SELECT event_id // 2200 + 1 AS frame_index, event_id % 3 AS c, (event_id % 10) / 10.0::DOUBLE AS cx FROM events)
SELECT frame_index, CASE c WHEN 0 THEN 'person' ELSE 'ball' END AS class, count(*) AS boxes, round(sum(greatest(0.0, (cx - 0.05) * 1920)), 4) AS sum_x1 FROM b WHERE c <> 2 GROUP BY 1, 2""")
def yolo_files(spark, sf_dir):
    e = F.col("event_id")
    name = F.concat(F.lit("f_"), F.lpad(F.expr("event_id div 2200").cast("string"), 8, "0"), F.lit(".txt"))
    line = F.concat_ws(" ", (e % 3).cast("string"), (e % 10 / F.lit(10.0)).cast("string"), F.lit("0.5 0.1 0.2"))
    folder = new_path(spark, "yolo")
    sinks.write_lines(views.table(spark, sf_dir, "events").select(name.alias("name"), e.alias("line_no"), line.alias("value")), folder)
    boxes = readers.read_yolo(spark, folder, ["person", "ball", "ignored"], 1920, 1080)
    return tidy(boxes.groupBy("frame_index", "class").agg(F.count(F.lit(1)).alias("boxes"), F.round(F.sum("x1"), 4).alias("sum_x1")), 4)


@query("track_role_files", "S3", """
SELECT 'SEQ' || event_id // 2000 AS sequence_id, event_id AS track_id, CASE event_id % 3 WHEN 0 THEN 'OUTFIELD_PLAYER' WHEN 1 THEN 'GOALKEEPER' ELSE 'REFEREE' END AS role, CASE event_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS team FROM events WHERE event_id % 10 <> 0""")
def track_role_files(spark, sf_dir):
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "player team left").when(e % 3 == 1, "goalkeepers team right").otherwise("referee")
    line = F.when(e % 10 == 0, "[Sequence]").otherwise(F.concat(F.lit("trackletID_"), e.cast("string"), F.lit("= "), kind, F.lit(";7")))
    folder = new_path(spark, "roles")
    sinks.write_lines(views.table(spark, sf_dir, "events").select(F.concat(F.lit("SEQ"), F.expr("event_id div 2000").cast("string"), F.lit("/gameinfo.ini")).alias("name"), e.alias("line_no"), line.alias("value")), folder)
    return readers.read_track_roles(spark, f"{folder}/*/gameinfo.ini").select("sequence_id", "track_id", "role", "team")


@query("chunk_files", "S4", "SELECT CAST(doc_id AS VARCHAR) AS id, source, md5(text) AS digest, 2 AS teams FROM documents")
def chunk_files(spark, sf_dir):
    """Chunks as JSON lines, a blank line among them."""
    d = views.table(spark, sf_dir, "documents")
    meta = F.struct(F.col("doc_id").cast("string").alias("id"), "source", F.array(F.lit("PSG"), F.lit("Ajax")).alias("equipes"), F.array().cast("array<string>").alias("tags_tactiques"),
                    F.lit("match").alias("type_chunk"), F.lit(None).cast("string").alias("periode"), F.lit(None).cast("string").alias("intervalle_temps"))
    lines = d.select(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("\n"), F.to_json(F.struct("text", meta.alias("metadata"))))).otherwise(F.to_json(F.struct("text", meta.alias("metadata")))).alias("value"))
    folder = new_path(spark, "chunks")
    lines.write.text(folder)
    back = readers.read_chunks(spark, folder)
    return back.select("metadata.id", "metadata.source", F.md5("text").alias("digest"), F.size("metadata.equipes").alias("teams"))


@query("document_files", "S5", "SELECT 'd' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' ELSE '.html' END AS source, md5(text) AS digest FROM documents WHERE doc_id % 4 <> 3")
def document_files(spark, sf_dir):
    """Flat folders of about 10,000 files; files of other kinds are passed over."""
    k = F.col("doc_id")
    kind = F.when(k % 4 == 3, ".bin").when(k % 3 == 0, ".md").when(k % 3 == 1, ".txt").otherwise(".html")
    folder = new_path(spark, "documents")
    docs = views.table(spark, sf_dir, "documents")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(docs.count() // 10_000 + 1)).cast("string")
    sinks.write_texts(docs.select(F.concat(share, F.lit("/d"), k.cast("string"), kind).alias("name"), "text"), folder)
    return readers.read_documents(spark, folder, recursive=True, keep_front_matter=True).select("source", F.md5("text").alias("digest"))


@query("corpus_files", "S6", "SELECT 'd' || doc_id || '.md' AS source, md5(CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END || text) AS digest FROM documents")
def corpus_files(spark, sf_dir):
    """Folders within folders; the front matter of a file is cut."""
    k = F.col("doc_id")
    head = F.when(k % 2 == 0, F.concat(F.lit("---\ntitle: d"), k.cast("string"), F.lit("\n---\n"))).otherwise("")
    folder = new_path(spark, "corpus")
    sinks.write_texts(views.table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), "source", F.lit("/d"), k.cast("string"), F.lit(".md")).alias("name"), F.concat(head, "text").alias("text")), folder)
    return readers.read_documents(spark, folder, "*.md", recursive=True).select("source", F.md5("text").alias("digest"))


@query("season_csv_files", "S7", """
SELECT 'season_2025_2026_summary' AS match_id, c_name AS player_name, CAST(c_custkey % 3000 AS INTEGER) AS minutes_played, CAST(c_custkey % 20 AS INTEGER) AS goals, round((c_custkey % 90) / 10.0, 6)::DOUBLE AS expected_goals, CAST(c_custkey % 50 AS INTEGER) AS key_passes FROM customer""")
def season_csv_files(spark, sf_dir):
    k = F.col("c_custkey")
    folder = new_path(spark, "season")
    views.table(spark, sf_dir, "customer").select(F.col("c_name").alias("Player"), (k % 3000).alias("Min"), (k % 20).alias("Gls"), F.lit("9").alias("npxG"), (k % 90 / F.lit(10.0)).alias("xG"), (k % 50).alias("KP")).write.option("header", "true").csv(folder)
    return tidy(readers.read_season_csv(spark, folder, "season_2025_2026_summary").select("match_id", "player_name", "minutes_played", "goals", "expected_goals", "key_passes"))


@query("season_csv_generations", "S7 S8", """
SELECT c_name AS player_name, CAST(c_custkey % 3000 AS INTEGER) AS minutes_played, CAST(c_custkey % 20 AS INTEGER) AS goals, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE round((c_custkey % 90) / 10.0, 6) END::DOUBLE AS expected_goals,
 CASE WHEN c_custkey % 3 = 2 THEN round((c_custkey % 70) / 10.0, 6) ELSE 0.0 END::DOUBLE AS expected_assists, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE CAST(c_custkey % 50 AS INTEGER) END AS key_passes, CASE WHEN c_custkey % 3 = 2 THEN CAST(c_custkey % 11 AS INTEGER) ELSE 0 END AS progressive_dribbles,
 CASE WHEN c_custkey % 3 = 1 THEN 'Inconnu' ELSE 'Squad, ' || c_nationkey END AS team_name FROM customer""")
def season_csv_generations(spark, sf_dir):
    """Three generations of season files in one folder: more columns, other names and another order each time."""
    k, folder = F.col("c_custkey"), new_path(spark, "generations")
    rows = views.table(spark, sf_dir, "customer")
    base = [F.col("c_name").alias("Player"), (k % 3000).alias("Min"), (k % 20).alias("Gls")]
    squad = F.concat(F.lit("Squad, "), F.col("c_nationkey").cast("string")).alias("Squad")
    files = {0: [*base, squad], 1: [(k % 50).alias("key_passes"), *base, F.lit("9").alias("npxG"), (k % 90 / F.lit(10.0)).alias("xG")],
             2: [squad, *base, (k % 90 / F.lit(10.0)).alias("xG"), (k % 70 / F.lit(10.0)).alias("xAG"), (k % 50).alias("KP"), (k % 11).alias("PrgC")]}
    for kind, columns in files.items():
        rows.filter(k % 3 == kind).select(*columns).write.mode("append").option("header", "true").csv(folder)
    return tidy(readers.read_season_files(spark, folder, "season_2025_2026_summary").select(
        "player_name", "minutes_played", "goals", "expected_goals", "expected_assists", "key_passes", "progressive_dribbles", "team_name"))


@query("match_files", "S10", """
SELECT 'm' || s_suppkey AS match_id, 'Team ' || s_suppkey % 20 AS home_team, CAST(s_suppkey % 5 AS INTEGER) AS score_home, CAST(s_suppkey % 100 AS INTEGER) AS possession_pct, CAST(s_suppkey % 90 AS INTEGER) AS minute FROM supplier""")
def match_files(spark, sf_dir):
    """One JSON file per match."""
    k = F.col("s_suppkey")
    team = F.concat(F.lit("Team "), (k % 20).cast("string"))
    body = F.to_json(F.struct(F.concat(F.lit("m"), k.cast("string")).alias("match_id"), F.struct(team.alias("home_team"), (k % 5).alias("score_home")).alias("meta"),
                              F.create_map(team, F.struct((k % 100).alias("possession_pct"))).alias("team_stats"), F.array(F.struct((k % 90).alias("minute"), F.lit("goal").alias("type"))).alias("key_events")), {"pretty": "true"})
    folder = new_path(spark, "matches")
    sinks.write_texts(views.table(spark, sf_dir, "supplier").select(F.concat(F.lit("m"), k.cast("string"), F.lit(".json")).alias("name"), body.alias("text")), folder)
    m = readers.read_matches(spark, folder)
    return m.select("match_id", "meta.home_team", "meta.score_home", F.col("team_stats")[F.col("meta.home_team")]["possession_pct"].alias("possession_pct"), F.get("key_events", F.lit(0))["minute"].alias("minute"))


@query("state_tables", "S14", "SELECT sequence_id, frame_index, possession_team FROM held_v")
def state_tables(spark, sf_dir):
    """Possession states written by sequence and read again."""
    from touchline.plans.events_queries import quick

    folder = new_path(spark, "states")
    sinks.write_states(quick(spark, sf_dir).select("sequence_id", "frame_index", "possession_team"), folder)
    return spark.read.parquet(folder).select("sequence_id", "frame_index", "possession_team")
