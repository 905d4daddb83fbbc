"""Queries written as SQL text over the library's registered functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from touchline.functions import sql_functions
from touchline.operators import geometry as geo
from touchline.plans.evaluation_queries import MATCH_SQL, pairs
from touchline.plans.events_queries import STRUCT_SQL, ends, evidence
from touchline.plans.registry import ORACLE, query
from touchline.plans.stats_queries import tidy
from touchline.plans.tactics_queries import oriented, players


def ask(spark, sql, **tables):
    """Run SQL text in which ``{name}`` stands for a table."""
    sql_functions.register(spark)
    named = {name: f"{name}_{uuid.uuid4().hex}" for name in tables}
    for name, table in tables.items():
        table.createOrReplaceTempView(named[name])
    return spark.sql(sql.format(**named))


@query("sql_event_frames", "P18 J9", """
SELECT e.sequence_id, event_id, f AS frame_index, CAST((f - start_frame) // 5 AS BIGINT) AS place FROM (SELECT *, unnest(generate_series(start_frame, least(end_frame, last_frame), 5)) AS f FROM evidence_v JOIN ends_v USING (sequence_id)) e""")
def sql_event_frames(spark, sf_dir):
    """Every fifth frame of each event, by the table function."""
    return ask(spark, """
        SELECT e.sequence_id, e.event_id, f.at AS frame_index, f.place
        FROM {events} e JOIN {ends} l ON l.sequence_id = e.sequence_id, LATERAL explode_intervals(e.start_frame, least(e.end_frame, l.last_frame), 5) f""",
               events=evidence(spark, sf_dir), ends=ends(spark, sf_dir))


@query("sql_hull_areas", "A6", "SELECT sequence_id, frame_index, team_label, hull_area_m2 FROM (" + ORACLE["convex_hull"] + ")")
def sql_hull_areas(spark, sf_dir):
    """Hull area of each team and frame, by the grouped aggregate."""
    return tidy(ask(spark, """
        SELECT sequence_id, frame_index, team_label, nanvl(hull_area(x_m, y_m), NULL) AS hull_area_m2 FROM {players} GROUP BY sequence_id, frame_index, team_label""",
                    players=geo.outfield(players(spark, sf_dir))), 4)


@query("sql_formation_distances", "P36", f"""
WITH RECURSIVE {STRUCT_SQL}
SELECT st.sequence_id, st.frame_index, st.team_label, name AS prototype, round(d, 6) AS distance FROM st JOIN dist ON dist.structure = st.structure""")
def sql_formation_distances(spark, sf_dir):
    """Distance of every observed structure to every prototype, by the scalar function."""
    teams = oriented(spark, sf_dir).withColumn("structure", F.transform("lines", lambda l: l["players"].cast("int"))).select(*geo.TEAM, "structure")
    return tidy(ask(spark, """
        SELECT sequence_id, frame_index, team_label, prototype, formation_distance(structure, prototype) AS distance
        FROM {teams} LATERAL VIEW explode(array('4-4-2', '4-3-3', '4-2-3-1', '4-1-4-1', '3-5-2', '3-4-3', '5-3-2', '5-4-1')) AS prototype WHERE size(structure) > 0""", teams=teams))


@query("sql_assigned_pairs", "V2", f"WITH RECURSIVE {MATCH_SQL} SELECT sequence_id, frame_index, track_id, pred_track_id, round(iou, 6) AS iou FROM mt")
def sql_assigned_pairs(spark, sf_dir):
    """One-to-one matches of every frame, by the table function over partitions."""
    return tidy(ask(spark, """
        SELECT p.sequence_id, p.frame_index, m.a AS track_id, m.b AS pred_track_id, m.gain AS iou
        FROM (SELECT sequence_id, frame_index, collect_list(named_struct('a', track_id, 'b', pred_track_id, 'gain', iou)) AS pairs FROM {pairs} GROUP BY sequence_id, frame_index) p,
        LATERAL assigned(p.pairs) m""", pairs=pairs(spark, sf_dir)))
