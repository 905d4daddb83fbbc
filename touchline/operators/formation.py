"""Formations: distance of the seen lines to the prototypes, frame label, vote over two seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.functions import frames
from touchline.functions.boxes import let
from touchline.operators.geometry import TEAM
from touchline.operators.lines import SEQ_TEAM

# Players per line, from the own goal, of the eight known formations.
PROTOTYPES = {
    "4-4-2": (4, 4, 2), "4-3-3": (4, 3, 3), "4-2-3-1": (4, 2, 3, 1), "4-1-4-1": (4, 1, 4, 1),
    "3-5-2": (3, 5, 2), "3-4-3": (3, 4, 3), "5-3-2": (5, 3, 2), "5-4-1": (5, 4, 1),
}
# Pairs that differ only by the wing backs.
WING_BACK_PAIRS = [("3-5-2", "5-3-2"), ("3-4-3", "5-4-1")]
MAX_DISTANCE = 12.0
VOTE_ROWS = 50


def formation_distance(lines: Column, prototype: tuple[int, ...]) -> Column:
    """Edit distance of two lists of line sizes, plus 1.5 per man in the first line and 1 per missing line."""
    m = len(prototype)
    start = F.array(*[F.lit(float(sum(prototype[:j]))) for j in range(m + 1)])

    def cell(row: Column, seen: Column, j: int):
        want = float(prototype[j - 1])
        return lambda done: F.concat(done, F.array(F.least(row[j - 1] + F.abs(seen - want), row[j] + seen, done[j - 1] + want)))

    def next_row(row: Column, seen: Column) -> Column:
        cells = F.array(row[0] + seen)
        for j in range(1, m + 1):
            cells = let(cells, cell(row, seen, j))
        return cells

    cost = F.aggregate(F.transform(lines, lambda v: v.cast("double")), start, next_row, lambda row: row[m])
    total = cost + F.abs(F.element_at(lines, 1) - prototype[0]) * 1.5 + F.abs(F.size(lines) - m) * 1.0
    return F.when(F.size(lines) > 0, total).otherwise(MAX_DISTANCE)


def prototype_distances(df: DataFrame, lines: str) -> DataFrame:
    """Add ``ranked``: the (distance, rank, name) structs of all prototypes, nearest first."""
    entries = [F.struct(formation_distance(F.col(lines), p).alias("distance"), F.lit(i).alias("rank"), F.lit(name).alias("name"))
               for i, (name, p) in enumerate(PROTOTYPES.items())]
    return df.withColumn("ranked", F.array_sort(F.array(*entries)))


def signatures(teams: DataFrame, widths: Column | None = None) -> DataFrame:
    """Frame label of each oriented team."""
    df = teams.withColumn("structure", F.transform("lines", lambda l: l["players"]))
    df = df.withColumn("width_m", F.array_max("ranked.y_m") - F.array_min("ranked.y_m") if widths is None else widths)
    df = prototype_distances(df.drop("ranked"), "structure")
    n = F.col("outfield_count")
    evidence = F.when(n >= 9, "FULL_EVIDENCE").when(n >= 7, "PARTIAL_EVIDENCE").otherwise("LOW_EVIDENCE")
    best, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    gap = second["distance"] - best["distance"]
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - best["distance"] / MAX_DISTANCE))
    wing = F.lit(False)
    for a, b in WING_BACK_PAIRS:
        wing = wing | ((best["name"] == a) & (second["name"] == b)) | ((best["name"] == b) & (second["name"] == a))
    set_piece = (n >= 6) & (F.col("depth_m") < 18.0) & (F.col("width_m") < 24.0)
    label = (F.when(F.col("direction") == 0, "UNKNOWN").when(evidence == "LOW_EVIDENCE", "UNKNOWN").when(set_piece, "SET_PIECE_DEFORMATION")
             .when(F.col("line_count") == 0, "UNKNOWN").when(evidence == "PARTIAL_EVIDENCE", "PARTIAL").when(wing & (gap < 0.35), "AMBIGUOUS_3_5_STRUCTURE")
             .when((gap < 0.20) & (best["distance"] > 1.0), "AMBIGUOUS").when(conf >= 0.50, best["name"]).otherwise("TRANSITIONING"))
    df = df.withColumn("evidence", evidence).withColumn("label", label)
    judged = ~F.col("label").isin("UNKNOWN", "SET_PIECE_DEFORMATION")
    return df.select(*TEAM, "structure", "evidence", "label", F.when(judged, best["name"]).alias("prototype"),
                     F.when(judged, best["distance"]).alias("distance"), F.when(judged, conf).otherwise(F.when(F.col("label") == "UNKNOWN", 0.0).otherwise(0.20)).alias("conf"))


def stable_formation(signs: DataFrame, span: int = frames.SPAN) -> DataFrame:
    """Vote of the judged frames among the last 50; STABLE needs 65 % of them and a mean confidence of 0.45."""
    numbered = frames.ordinal(signs, SEQ_TEAM, "frame_index", "_n", span)
    names = list(PROTOTYPES)

    def vote(rows: DataFrame, keys: list[str]) -> DataFrame:
        recent = Window.partitionBy(*keys).orderBy("_n").rowsBetween(1 - VOTE_ROWS, 0)
        judged = F.col("prototype").isNotNull() & (F.col("evidence") != "LOW_EVIDENCE")
        out = rows.select("*", F.count(F.lit(1)).over(recent).alias("_rows"), F.count(F.when(judged, 1)).over(recent).alias("_judged"),
                          *[F.count(F.when(judged & (F.col("prototype") == p), 1)).over(recent).alias(f"_c{i}") for i, p in enumerate(names)],
                          *[F.min(F.when(judged & (F.col("prototype") == p), F.col("_n"))).over(recent).alias(f"_f{i}") for i, p in enumerate(names)],
                          *[F.avg(F.when(judged & (F.col("prototype") == p), F.col("conf"))).over(recent).alias(f"_a{i}") for i, p in enumerate(names)])
        return out

    df = frames.halo(numbered, SEQ_TEAM, "_n", vote, before=VOTE_ROWS - 1, span=span)
    # most votes first; of equal ones, the prototype seen first in the buffer
    tally = F.array_sort(F.array(*[F.struct((-F.col(f"_c{i}")).alias("votes"), F.coalesce(F.col(f"_f{i}"), F.lit(1 << 60)).alias("first"),
                                            F.lit(p).alias("name"), F.col(f"_a{i}").alias("conf")) for i, p in enumerate(names)]))
    df = df.withColumn("_t", tally)
    top, runner = F.get("_t", F.lit(0)), F.get("_t", F.lit(1))
    share = -top["votes"] / F.col("_judged")
    margin = F.when(runner["votes"] < 0, (runner["votes"] - top["votes"]) / F.col("_judged")).otherwise(1.0)
    trusted = F.col("_judged") >= F.greatest(F.lit(5), F.floor(F.col("_rows") / 3))
    state = (F.when(~trusted, F.when(F.col("evidence") == "LOW_EVIDENCE", "UNKNOWN").otherwise("PARTIAL"))
             .when((share >= 0.65) & (top["conf"] >= 0.45), "STABLE").when(margin < 0.20, "AMBIGUOUS").otherwise("TRANSITIONING"))
    df = df.withColumn("state", state)
    return df.select(*TEAM, "evidence", "label", "structure", "state", F.when(F.col("state") == "STABLE", top["name"]).otherwise(F.col("state")).alias("stable_label"),
                     F.when(trusted, top["conf"]).otherwise(0.0).alias("state_conf"), F.col("_rows").alias("history"))


def formation_changes(stable: DataFrame, span: int = frames.SPAN) -> DataFrame:
    """Frames whose stable formation differs from the last confirmed one."""
    marked = stable.withColumn("_c", F.when(F.col("state") == "STABLE", F.col("stable_label")))
    known = frames.last_known(marked, SEQ_TEAM, "frame_index", {"_c": "old_formation"}, span, strict=True)
    return (known.filter((F.col("state") == "STABLE") & F.col("old_formation").isNotNull() & (F.col("old_formation") != F.col("stable_label")))
            .select(*TEAM, "old_formation", F.col("stable_label").alias("new_formation"), F.col("state_conf").alias("conf"), F.col("history").alias("delay_frames")))
