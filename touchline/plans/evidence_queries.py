"""Evidence look-up, graph, answer and report queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from touchline.operators import evidence as ev, fusion, text as txt
from touchline.plans import views
from touchline.plans.events_queries import evidence, frame_pressure
from touchline.plans.registry import ORACLE, query
from touchline.plans.stats_queries import tidy
from touchline.session import new_path


def links(spark, sf_dir):
    return views.shared("links", spark, sf_dir, lambda s, d: fusion.links(evidence(s, d)))


def sequence_windows(spark, sf_dir):
    base = evidence(spark, sf_dir).groupBy("sequence_id").agg(F.floor(F.max("end_ts") / 2.0).alias("_last"))
    return (base.withColumn("window_id", F.explode(F.sequence(F.lit(0), F.col("_last").cast("int")))).drop("_last").withColumn("from_s", F.col("window_id") * 2.0 - 0.5).withColumn("to_s", F.col("window_id") * 2.0 + 0.5))


@query("events_in_range", "J9", """
SELECT e.sequence_id, w AS window_id, event_id FROM evidence_v e JOIN (SELECT sequence_id, unnest(generate_series(0, CAST(floor(max(end_ts) / 2.0) AS INTEGER))) AS w FROM evidence_v GROUP BY 1) t ON t.sequence_id = e.sequence_id WHERE start_ts <= w * 2.0 + 0.5 AND end_ts >= w * 2.0 - 0.5""")
def events_in_range(spark, sf_dir):
    return ev.in_range(evidence(spark, sf_dir), sequence_windows(spark, sf_dir)).select("sequence_id", "window_id", "event_id")


@query("events_at_time", "G4", """
SELECT e.sequence_id, w AS window_id, event_id FROM evidence_v e JOIN (SELECT sequence_id, unnest(generate_series(0, CAST(floor(max(end_ts) / 2.0) AS INTEGER))) AS w FROM evidence_v GROUP BY 1) t ON t.sequence_id = e.sequence_id WHERE start_ts <= w * 2.0 + 0.6 AND end_ts >= w * 2.0 - 0.6""")
def events_at_time(spark, sf_dir):
    points = sequence_windows(spark, sf_dir).select("sequence_id", "window_id", (F.col("window_id") * 2.0).alias("at_s"))
    return ev.at_time(evidence(spark, sf_dir), points).select("sequence_id", "window_id", "event_id")


@query("events_relative", "J10", """
SELECT 'after' AS direction, r.sequence_id, r.event_id AS root_id, e.event_id FROM evidence_v r JOIN evidence_v e ON e.sequence_id = r.sequence_id AND e.event_id <> r.event_id AND e.start_ts BETWEEN r.end_ts AND r.end_ts + 2.0
UNION ALL SELECT 'before', r.sequence_id, r.event_id, e.event_id FROM evidence_v r JOIN evidence_v e ON e.sequence_id = r.sequence_id AND e.event_id <> r.event_id AND e.end_ts BETWEEN greatest(0.0, r.start_ts - 2.0) AND r.start_ts""")
def events_relative(spark, sf_dir):
    e = evidence(spark, sf_dir)
    both = [ev.relative_to(e, d).select(F.lit(d).alias("direction"), "sequence_id", "root_id", "event_id") for d in ("after", "before")]
    return both[0].unionByName(both[1])


@query("event_lookup", "G3 G5", """
SELECT sequence_id, event_id, family FROM evidence_v WHERE sequence_id = 'SEQ-001' AND level = 'LEVEL_1_PHYSICAL_FACT' AND subject_team = 'TEAM_0'""")
def event_lookup(spark, sf_dir):
    return ev.look_up(evidence(spark, sf_dir), sequence="SEQ-001", level=fusion.LEVEL_1, team="TEAM_0").select("sequence_id", "event_id", "family")


@query("evidence_load_check", "S12", """
SELECT sequence_id, event_id, 'bad quality' AS problem FROM evidence_v WHERE start_frame % 7 = 0""")
def evidence_load_check(spark, sf_dir):
    spoiled = evidence(spark, sf_dir).withColumn("quality", F.when(F.col("start_frame") % 7 == 0, "UNHEARD").otherwise(F.col("quality")))
    return ev.quarantine(spoiled).select("sequence_id", "event_id", "problem")


def table_name(prefix):
    return f"{prefix}_{uuid.uuid4().hex}"


def evidence_tables(spark, sf_dir):
    """Names of the evidence and of the citations (every event at an even frame), both kept by id."""
    names = table_name("evidence"), table_name("cited")
    ev.store_by_id(evidence(spark, sf_dir), names[0], new_path(spark, "evidence_by_id"))
    ev.store_by_id(evidence(spark, sf_dir).filter("start_frame % 2 = 0").select("sequence_id", "event_id", (F.col("confidence") / 2).alias("weight")), names[1], new_path(spark, "cited_by_id"))
    return names


@query("cited_events_by_bucket", "G3 J18", """
SELECT sequence_id, event_id, family, round(confidence / 2, 6) AS weight FROM evidence_v WHERE start_frame % 2 = 0""")
def cited_events_by_bucket(spark, sf_dir):
    events, cited = evidence_tables(spark, sf_dir)
    return tidy(ev.join_by_id(spark.table(events), spark.table(cited)).select("sequence_id", "event_id", "family", "weight"))


@query("events_in_range_by_slot", "J9 G4", "SELECT * FROM (" + ORACLE["events_in_range"] + ")")
def events_in_range_by_slot(spark, sf_dir):
    events, windows = table_name("events_by_slot"), table_name("windows_by_slot")
    ev.store_by_slot(evidence(spark, sf_dir).select("sequence_id", "event_id", "start_ts", "end_ts"), events, new_path(spark, "events_by_slot"), "start_ts", "end_ts")
    ev.store_by_slot(sequence_windows(spark, sf_dir), windows, new_path(spark, "windows_by_slot"), "from_s", "to_s")
    return ev.overlapping(spark.table(events), spark.table(windows), ("start_ts", "end_ts"), ("from_s", "to_s")).select("sequence_id", "window_id", "event_id")


@query("related_events", "G1", """
WITH b AS (SELECT sequence_id, source_id AS event_id, target_id AS o FROM links_v UNION SELECT sequence_id, target_id, source_id FROM links_v)
SELECT sequence_id, event_id, string_agg(DISTINCT o, ',' ORDER BY o) AS related FROM b GROUP BY 1, 2""")
def related_events(spark, sf_dir):
    return ev.related_ids(links(spark, sf_dir)).withColumn("related", F.array_join("related", ","))


@query("edge_validity", "J20", """
SELECT sequence_id, source_id, target_id, relation FROM links_v WHERE (sequence_id, source_id) IN (SELECT (sequence_id, event_id) FROM evidence_v WHERE start_frame % 2 = 0)
 AND (sequence_id, target_id) IN (SELECT (sequence_id, event_id) FROM evidence_v WHERE start_frame % 2 = 0)""")
def edge_validity(spark, sf_dir):
    return ev.valid_edges(links(spark, sf_dir), evidence(spark, sf_dir).filter("start_frame % 2 = 0")).select("sequence_id", "source_id", "target_id", "relation")


@query("graph_neighbourhood", "G2", """
WITH s AS (SELECT sequence_id, source_id AS a, target_id AS b FROM links_v UNION SELECT sequence_id, target_id, source_id FROM links_v), r AS (SELECT sequence_id, event_id AS root_id FROM evidence_v WHERE family = 'POSSESSION_CHANGE'),
h1 AS (SELECT DISTINCT r.sequence_id, root_id, b AS node FROM r JOIN s ON s.sequence_id = r.sequence_id AND a = root_id),
h2 AS (SELECT DISTINCT h1.sequence_id, root_id, b AS node FROM h1 JOIN s ON s.sequence_id = h1.sequence_id AND a = node WHERE b <> root_id AND (h1.sequence_id, root_id, b) NOT IN (SELECT (sequence_id, root_id, node) FROM h1))
SELECT sequence_id, root_id, root_id AS node, 0 AS hops FROM r UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2""")
def graph_neighbourhood(spark, sf_dir):
    roots = evidence(spark, sf_dir).filter("family = 'POSSESSION_CHANGE'").select("sequence_id", F.col("event_id").alias("root_id"))
    return ev.neighbourhood(links(spark, sf_dir), roots)


@query("graph_neighbourhood_edges", "G2", """
WITH s AS (SELECT sequence_id, source_id AS a, target_id AS b FROM links_v UNION SELECT sequence_id, target_id, source_id FROM links_v), r AS (SELECT sequence_id, event_id AS root_id FROM evidence_v WHERE family = 'POSSESSION_CHANGE'),
o AS (SELECT sequence_id, root_id, root_id AS node FROM r UNION SELECT r.sequence_id, root_id, b FROM r JOIN s ON s.sequence_id = r.sequence_id AND a = root_id)
SELECT sequence_id, root_id, source_id, target_id, relation, count(*) AS met FROM (SELECT o.sequence_id, root_id, source_id, target_id, relation FROM o JOIN links_v l ON l.sequence_id = o.sequence_id AND source_id = node UNION ALL SELECT o.sequence_id, root_id, source_id, target_id, relation FROM o JOIN links_v l ON l.sequence_id = o.sequence_id AND target_id = node) GROUP BY 1, 2, 3, 4, 5""")
def graph_neighbourhood_edges(spark, sf_dir):
    return ev.neighbourhood_edges(links(spark, sf_dir), graph_neighbourhood(spark, sf_dir))


def asked(spark, sf_dir):
    """Every question, put to one of the sequences; classified once for all the steps that read it."""
    return views.shared("asked", spark, sf_dir, _asked)


def _asked(spark, sf_dir):
    q = txt.classify(views.questions(spark, sf_dir), in_video=True)
    seqs = views.tracking(spark, sf_dir).select("sequence_id").distinct()
    number = F.substring("sequence_id", 5, 20).cast("long")
    total = seqs.agg((F.max(number) + 1).alias("_n"))
    placed = q.crossJoin(F.broadcast(total)).withColumn("_s", F.expr("query_id div 1000") % F.col("_n"))
    label = F.concat(F.lit("SEQ-"), F.when(F.col("_s") < 1000, F.lpad(F.col("_s").cast("string"), 3, "0")).otherwise(F.col("_s").cast("string")))
    return placed.select("query_id", label.alias("sequence_id"), "scope", "at_s", "from_s", "to_s", "team")


def plan(spark, sf_dir):
    return views.shared("qa_plan", spark, sf_dir, lambda s, d: ev.plan_retrieval(asked(s, d), evidence(s, d), links(s, d)))


def grounded(spark, sf_dir):
    return ev.answers(asked(spark, sf_dir), plan(spark, sf_dir), fusion.summaries(evidence(spark, sf_dir)))


@query("qa_retrieval_plan", "G6 O8", "SELECT query_id, sequence_id, scope, event_id, rank FROM qa_plan_v")
def qa_retrieval_plan(spark, sf_dir):
    return plan(spark, sf_dir)


@query("qa_time_plan", "G6", "SELECT query_id, sequence_id, event_id, rank FROM qa_plan_v JOIN questions_v USING (query_id) WHERE slot IN (0, 1)")
def qa_time_plan(spark, sf_dir):
    timed = asked(spark, sf_dir).filter("from_s IS NOT NULL OR at_s IS NOT NULL").select("query_id")
    return plan(spark, sf_dir).join(timed, "query_id", "left_semi").select("query_id", "sequence_id", "event_id", "rank")


@query("qa_answers", "G7 P38", """
SELECT query_id, sequence_id, scope, n_events, abstains, CASE WHEN abstains THEN 0.0 ELSE round(coalesce(c, 0.0), 3) END AS confidence, level, CASE WHEN abstains THEN 0 ELSE len(cited) END::INTEGER AS citations,
  md5(CASE WHEN abstains THEN 'Les données ne permettent pas d''établir d''événement vérifié.' ELSE array_to_string(claims, chr(10)) END) AS answer FROM answers_v""")
def qa_answers(spark, sf_dir):
    a = grounded(spark, sf_dir)
    return a.select("query_id", "sequence_id", "scope", "n_events", "abstains", "confidence", "level", F.size("citations").alias("citations"), F.md5("answer").alias("answer"))


@query("citation_check", "J18", """
SELECT query_id, sequence_id, event_id, (sequence_id, event_id) IN (SELECT (sequence_id, event_id) FROM evidence_v WHERE start_frame % 3 <> 0) AS valid
FROM (SELECT query_id, sequence_id, unnest(cited) AS event_id FROM answers_v WHERE NOT abstains)""")
def citation_check(spark, sf_dir):
    """Against a store that has lost a third of its events, so that some citations do not hold."""
    return ev.citation_check(grounded(spark, sf_dir), evidence(spark, sf_dir).filter("start_frame % 3 <> 0")).select("query_id", "sequence_id", "event_id", "valid")


@query("grounding_counters", "A21", """
WITH v AS (SELECT query_id, count(*) AS nc FROM (SELECT query_id, unnest(cited) AS e FROM answers_v WHERE NOT abstains) GROUP BY 1), a AS (SELECT *, slot IN (3, 4) AS due FROM answers_v LEFT JOIN v USING (query_id))
SELECT scope, count(*) AS questions, sum(coalesce(nc, 0))::BIGINT AS citations, sum(coalesce(nc, 0))::BIGINT AS valid_citations, sum(CASE WHEN abstains THEN 0 ELSE len(claims) END)::BIGINT AS claims, count(*) FILTER (abstains) AS abstentions, 1.0::DOUBLE AS citation_precision, 0.0::DOUBLE AS violation_rate,
 CASE WHEN count(*) FILTER (due) > 0 THEN round(count(*) FILTER (due AND abstains) / count(*) FILTER (due), 6) ELSE 1.0 END AS abstention_accuracy, count(*) FILTER (due = abstains) AS passed FROM a GROUP BY 1""")
def grounding_counters(spark, sf_dir):
    expected = views.questions(spark, sf_dir).select("query_id", (F.expr("query_id div 1000") % 12).isin(3, 4).alias("should_abstain"))
    return tidy(ev.grounding_counters(grounded(spark, sf_dir), evidence(spark, sf_dir), expected))


@query("latency_rollup", "A24", """
WITH t AS (SELECT event_type AS stage, epoch_us(ts) AS us, user_id, event_id FROM events), l AS (SELECT stage, (us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id)) / 1000.0::DOUBLE AS latency FROM t)
SELECT stage, count(latency) AS questions, round(avg(latency), 3) AS mean_ms, round(max(latency), 3) AS max_ms, round(min(latency), 3) AS min_ms FROM l WHERE latency IS NOT NULL GROUP BY 1""")
def latency_rollup(spark, sf_dir):
    """Latency of each stage: only the questions that ran the stage count in its mean."""
    e = views.table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("stage"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    rows = e.withColumn("latency", ((F.col("us") - F.lag("us").over(w)) / F.lit(1000.0))).filter("latency IS NOT NULL")
    return tidy(ev.latency_rollup(rows), 3)


@query("match_report", "G8 A22", "SELECT sequence_id, section, position, sentence, citation FROM report_v")
def match_report(spark, sf_dir):
    from touchline.plans.events_queries import geo, quick, block_table

    held = quick(spark, sf_dir)
    rows = block_table(spark, sf_dir).withColumn("players", F.col("outfield_count")).join(held.select(*geo.FRAME), geo.FRAME, "left_semi")
    return ev.report_rows(fusion.summaries(evidence(spark, sf_dir)), fusion.team_aggregates(rows, held, frame_pressure(spark, sf_dir), evidence(spark, sf_dir)))


@query("report_grounding", "A22", "SELECT sequence_id, count(*) AS sentences, count(*) AS grounded, 1.0::DOUBLE AS grounded_ratio FROM report_v GROUP BY 1")
def report_grounding(spark, sf_dir):
    return tidy(ev.report_grounding(match_report(spark, sf_dir), evidence(spark, sf_dir)))


@query("session_isolation", "G5", "SELECT query_id, 2::BIGINT AS sessions FROM questions_v WHERE query_id % 3 = 0")
def session_isolation(spark, sf_dir):
    q = views.questions(spark, sf_dir).select("query_id", F.lit("SEQ-000").alias("sequence_id"))
    leak = q.filter("query_id % 3 = 0").withColumn("sequence_id", F.lit("SEQ-001"))
    return ev.isolation_violations(q.unionByName(leak))
