"""Attack direction, tactical lines and oriented team measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions.boxes import let
from touchline.functions.scan import CHUNK, scan
from touchline.operators.geometry import FRAME, TEAM, median_of, mean_of

HALF_LENGTH = 52.5
KEEPER_X = 30.5
ORDERING_MIN_FRAMES = 30
ORDERING_MIN_GAP_M = 4.0
SWITCH_AFTER = 15
LINE_GAP_M = 6.0
MIN_PLAYERS = 4
LINE_DRIFT_M = 4.5
SEQ_TEAM = ["sequence_id", "team_label"]


def visibility(outfield_count: Column) -> Column:
    return F.when(outfield_count >= 8, "HIGH").when(outfield_count >= 5, "MEDIUM").otherwise("LOW")


DIRECTION_SCHEMA = ("sequence_id string, frame_index bigint, team_label string, direction int, direction_conf double, "
                    "direction_source string, switches bigint")


def direction_inputs(players: DataFrame) -> DataFrame:
    """One row per frame: mean x and goalkeeper x of each team."""
    keeper = F.upper(F.col("role")).contains("GOALKEEPER")
    columns = []
    for n, team in enumerate(("TEAM_0", "TEAM_1")):
        mine = F.col("team_label") == team
        columns += [F.avg(F.when(mine, F.col("x_m"))).alias(f"cx{n}"),
                    F.min_by("x_m", F.when(mine & keeper, F.col("track_id"))).alias(f"gk{n}")]
    return players.groupBy(*FRAME).agg(*columns)


def _evidence(keeper_x: float | None, seen: bool, gap: float | None, sign: int) -> tuple[int, float, str] | None:
    """Direction a team's own signs point to: a goalkeeper near a goal first, then the order of the teams."""
    if keeper_x is not None and abs(keeper_x) > KEEPER_X:
        return (1 if keeper_x < 0 else -1), 0.95, "GOALKEEPER_ANCHOR"
    if seen and gap is not None and abs(gap) >= ORDERING_MIN_GAP_M:
        return (1 if gap * sign < 0 else -1), 0.70, "TEAM_SPATIAL_ORDERING"
    return None


def _direction_step(state: dict, pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    history = state.get("history", [[], []])
    teams = state.get("teams", [{"dir": 0, "conf": 0.0, "source": "UNKNOWN", "against": 0, "switches": 0} for _ in range(2)])
    out = []
    for row in pdf.itertuples(index=False):
        centres = [None if pd.isna(v) else v for v in (row.cx0, row.cx1)]
        keepers = [None if pd.isna(v) else v for v in (row.gk0, row.gk1)]
        for n in range(2):
            if centres[n] is not None:
                history[n] = [*history[n], float(centres[n])][-2 * ORDERING_MIN_FRAMES:]
        full = all(len(h) >= ORDERING_MIN_FRAMES for h in history)
        gap = float(np.median(history[0]) - np.median(history[1])) if full else None
        for n, held in enumerate(teams):
            found = _evidence(keepers[n], centres[n] is not None, gap, 1 - 2 * n)
            if found is None:
                continue
            way, conf, source = found
            if held["dir"] in (0, way):
                held.update(dir=way, conf=max(held["conf"], conf), source=source, against=0)
            else:
                held["against"] += 1
                if held["against"] >= SWITCH_AFTER:
                    held.update(dir=way, conf=conf, source=source, against=0, switches=held["switches"] + 1)
        for mine, other in (teams, teams[::-1]):
            if mine["dir"] == 0 and other["dir"] != 0:
                mine.update(dir=-other["dir"], conf=other["conf"] * 0.90, source="COMPLEMENTARY_INFERENCE")
        out += [(row.sequence_id, row.frame_index, f"TEAM_{n}", t["dir"], t["conf"], t["source"], t["switches"]) for n, t in enumerate(teams)]
    names = ["sequence_id", "frame_index", "team_label", "direction", "direction_conf", "direction_source", "switches"]
    return pd.DataFrame(out, columns=names), {"history": history, "teams": teams}


def attack_direction(players: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Held attack direction (+1, -1, 0 unknown) per team and frame; it turns after 15 contradictions in a row.

    A team without evidence of its own takes the opposite of the other at 0.9 of its confidence.
    """
    return scan(direction_inputs(players), ["sequence_id"], "frame_index", _direction_step, DIRECTION_SCHEMA, chunk)


def oriented_players(outfield: DataFrame, directions: DataFrame) -> DataFrame:
    return (outfield.join(directions.select(*TEAM, "direction"), TEAM, "left")
            .withColumn("x_attack", F.col("direction") * F.col("x_m")))


def oriented_teams(oriented: DataFrame) -> DataFrame:
    """Front, back, depth, goal distances and the lines of each team and frame, from one grouping."""
    known = F.col("direction") != 0
    grouped = oriented.groupBy(*TEAM).agg(
        F.first("timestamp_s").alias("timestamp_s"),
        F.first("direction").alias("direction"), F.count(F.lit(1)).alias("outfield_count"),
        F.max("x_attack").alias("_front"), F.min("x_attack").alias("_back"),
        F.sort_array(F.collect_list(F.struct("x_attack", "track_id", "x_m", "y_m", "team_confidence"))).alias("ranked"))
    out = (grouped.withColumn("visibility", visibility(F.col("outfield_count")))
           .withColumn("front_x_attack", F.when(known, F.col("_front"))).withColumn("back_x_attack", F.when(known, F.col("_back")))
           .withColumn("depth_m", F.col("front_x_attack") - F.col("back_x_attack"))
           .withColumn("to_opponent_goal_m", F.lit(HALF_LENGTH) - F.col("front_x_attack"))
           .withColumn("to_own_goal_m", F.col("back_x_attack") + F.lit(HALF_LENGTH)).drop("_front", "_back"))
    lines = F.when(known & (F.col("outfield_count") >= MIN_PLAYERS), _lines(F.col("ranked")))
    return out.withColumn("lines", F.coalesce(lines, F.array().cast(LINE_TYPE))).withColumn("line_count", F.size("lines"))


LINE_TYPE = ("array<struct<line_id: int, name: string, players: int, mean_x_attack: double, median_x_attack: double, "
             "width_m: double, mean_x: double, mean_y: double, confidence: double, track_ids: array<bigint>>>")


def _lines(ranked: Column) -> Column:
    """Cut players sorted by ``x_attack`` wherever the next one is 6 m or more ahead."""
    size = F.size(ranked)
    cuts = F.filter(F.sequence(F.lit(1), size), lambda i: (i == 1) | (
        F.element_at(ranked, i)["x_attack"] - F.element_at(ranked, F.greatest(i - 1, F.lit(1)))["x_attack"] >= LINE_GAP_M))

    def split(at: Column) -> Column:
        return F.transform(at, lambda c, k: F.slice(ranked, c, F.coalesce(F.get(at, k + 1), size + 1) - c))

    def build(g: Column, k: Column, n: Column) -> Column:
        name = (F.when(k == 0, "DEFENSIVE_LINE").when(k == n - 1, "ATTACKING_LINE")
                .when((n == 4) & (k == 1), "MIDFIELD_DEFENSIVE").when((n == 4) & (k == 2), "MIDFIELD_OFFENSIVE")
                .otherwise("MIDFIELD_LINE"))
        return F.struct(k.alias("line_id"), name.alias("name"), F.size(g).alias("players"), mean_of(g["x_attack"]).alias("mean_x_attack"),
                        median_of(g["x_attack"]).alias("median_x_attack"),
                        (F.array_max(g["y_m"]) - F.array_min(g["y_m"])).alias("width_m"),
                        mean_of(g["x_m"]).alias("mean_x"), mean_of(g["y_m"]).alias("mean_y"),
                        mean_of(g["team_confidence"]).alias("confidence"), g["track_id"].alias("track_ids"))

    return let(let(cuts, split), lambda groups: let(F.size(groups), lambda n: F.transform(groups, lambda g, k: build(g, k, n))))


def team_lines(teams: DataFrame) -> DataFrame:
    """Child table: one row per line."""
    return teams.select(*TEAM, F.explode("lines").alias("l")).select(*TEAM, "l.*")


def line_gaps(teams: DataFrame, position: str = "mean_x_attack") -> DataFrame:
    """Distances between neighbouring lines: means for the line measures, medians for the block measures."""
    at = F.col(f"lines.{position}")
    return (teams.withColumn("gaps", F.when(F.size("lines") >= 2, F.zip_with(
        F.slice(at, F.lit(2), F.size(at)), F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: b - a)))
        .withColumn("total_span_m", F.when(F.size("lines") >= 2, F.element_at(at, -1) - F.element_at(at, 1))))


def _persistence_step(state: dict, pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
    previous, out = state.get("lines", []), []
    for row in pdf.itertuples(index=False):
        taken, current = set(), []
        for line_id, mean in zip(row.ids, row.means):
            free = [(abs(mean - m), i, age) for i, m, age in previous if i not in taken and abs(mean - m) <= LINE_DRIFT_M]
            age = 1
            if free:
                _, found, before = min(free, key=lambda f: f[0])
                taken.add(found)
                age = before + 1
            current.append([int(line_id), float(mean), age])
            out.append((row.sequence_id, row.frame_index, row.team_label, int(line_id), age))
        previous = current
    return pd.DataFrame(out, columns=["sequence_id", "frame_index", "team_label", "line_id", "persistence"]), {"lines": previous}


def line_persistence(teams: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """How many frames in a row each line was found again, matching the nearest free earlier line within 4.5 m."""
    flat = teams.select(*TEAM, F.col("lines.line_id").alias("ids"), F.col("lines.mean_x_attack").alias("means"))
    return scan(flat, SEQ_TEAM, "frame_index", _persistence_step,
                "sequence_id string, frame_index bigint, team_label string, line_id int, persistence bigint", chunk)
