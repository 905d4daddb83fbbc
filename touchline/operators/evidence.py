"""Evidence queries: look-ups in time, graph neighbourhoods, answers with citations, reports, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.functions import frames
from touchline.functions.bands import overlap_join
from touchline.operators.fusion import LEVEL_1, LEVEL_2, LEVEL_3, citation, rounded_product
from touchline.session import cut_lineage

REQUIRED = ["event_id", "sequence_id", "start_frame", "end_frame", "start_ts", "end_ts", "family", "level", "confidence", "quality"]
FAMILIES = ["POSSESSION_CHANGE", "POST_LOSS_ENGAGEMENT", "DEFENSIVE_RECOVERY", "PRESSURE_EPISODE", "BLOCK_STATE", "BLOCK_HEIGHT_CHANGE", "BALL_TRANSFER",
            "ATTACKING_PROGRESSION", "TEAM_COMPRESSION"]
LEVELS = [LEVEL_1, LEVEL_2, LEVEL_3]
QUALITIES = ["HIGH", "MEDIUM", "LOW", "INVALID"]
POINT_TOLERANCE_S, MAX_EVENTS, DEPTH = 0.6, 8, 2
BUCKET_S = 10.0


def load_checked(rows: DataFrame, sequence: str = "ALL") -> DataFrame:
    """Evidence of one sequence or all; a row that lacks a field or has an unknown code fails the load."""
    chosen = rows if sequence == "ALL" else rows.filter(F.col("sequence_id") == sequence)
    lacking = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED]
    codes = [F.when(~F.col(c).isin(*allowed), F.concat(F.lit(f"bad {c} "), F.col(c))) for c, allowed in (("family", FAMILIES), ("level", LEVELS), ("quality", QUALITIES))]
    problem = F.coalesce(*lacking, *codes)
    return chosen.withColumn("event_id", F.when(problem.isNull(), F.col("event_id")).otherwise(F.raise_error(F.concat(F.lit("bad evidence record: "), problem)).cast("string")))


def quarantine(rows: DataFrame) -> DataFrame:
    """The rows ``load_checked`` would fail on, with the reason."""
    tests = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED]
    tests += [F.when(~F.col(c).isin(*allowed), F.lit(f"bad {c}")) for c, allowed in (("family", FAMILIES), ("level", LEVELS), ("quality", QUALITIES))]
    return rows.withColumn("problem", F.coalesce(*tests)).filter("problem IS NOT NULL")


def look_up(events: DataFrame, sequence: str | None = None, event_id: str | None = None, family: str | None = None, level: str | None = None,
            team: str | None = None) -> DataFrame:
    for column, value in (("sequence_id", sequence), ("event_id", event_id), ("family", family), ("level", level), ("subject_team", team)):
        if value is not None:
            events = events.filter(F.col(column) == value)
    return events


def in_range(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events that overlap the windows (sequence_id, window_id, from_s, to_s), ends included."""
    return overlap_join(events, windows, ["sequence_id"], ("start_ts", "end_ts"), ("from_s", "to_s"), BUCKET_S)


def at_time(events: DataFrame, points: DataFrame, tolerance: float = POINT_TOLERANCE_S) -> DataFrame:
    """Events active within ``tolerance`` of the points (sequence_id, window_id, at_s)."""
    return in_range(events, points.withColumn("from_s", F.col("at_s") - tolerance).withColumn("to_s", F.col("at_s") + tolerance))


def relative_to(events: DataFrame, direction: str = "after", window_s: float = 2.0) -> DataFrame:
    """Pairs of events: after, starts within ``window_s`` of the end of the root; before, ends within it of its start."""
    root = events.select("sequence_id", F.col("event_id").alias("root_id"), F.col("start_ts").alias("root_start"), F.col("end_ts").alias("root_end"))
    if direction == "after":
        root = root.withColumn("from_s", F.col("root_end")).withColumn("to_s", F.col("root_end") + window_s)
        other = events.withColumn("_at", F.col("start_ts"))
    else:
        root = root.withColumn("from_s", F.greatest(F.lit(0.0), F.col("root_start") - window_s)).withColumn("to_s", F.col("root_start"))
        other = events.withColumn("_at", F.col("end_ts"))
    other = other.withColumn("_at_end", F.col("_at"))
    pairs = overlap_join(other, root, ["sequence_id"], ("_at", "_at_end"), ("from_s", "to_s"), BUCKET_S)
    return pairs.filter("event_id <> root_id").select("sequence_id", "root_id", "event_id")


def related_ids(edges: DataFrame) -> DataFrame:
    """For every event, the sorted ids it has an edge with, either way."""
    both = edges.select("sequence_id", F.col("source_id").alias("event_id"), F.col("target_id").alias("other")).unionByName(
        edges.select("sequence_id", F.col("target_id").alias("event_id"), F.col("source_id").alias("other")))
    return both.groupBy("sequence_id", "event_id").agg(F.sort_array(F.collect_set("other")).alias("related"))


def valid_edges(edges: DataFrame, events: DataFrame) -> DataFrame:
    ids = events.select("sequence_id", "event_id")
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.withColumnRenamed("event_id", end), ["sequence_id", end], "left_semi")
    return edges


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Nodes within ``depth`` hops of each root (sequence_id, root_id), both directions, with their distance."""
    steps = edges.select("sequence_id", F.col("source_id").alias("at"), F.col("target_id").alias("node")).unionByName(
        edges.select("sequence_id", F.col("target_id").alias("at"), F.col("source_id").alias("node"))).distinct()
    frontier = roots.select("sequence_id", "root_id", F.col("root_id").alias("node"))
    reached = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        onward = frontier.withColumnRenamed("node", "at").join(steps, ["sequence_id", "at"]).select("sequence_id", "root_id", "node").distinct()
        frontier = onward.join(reached.select("sequence_id", "root_id", "node"), ["sequence_id", "root_id", "node"], "left_anti")
        if hop % 3 == 0:
            frontier = cut_lineage(frontier)
        reached = reached.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return reached


def neighbourhood_edges(edges: DataFrame, reached: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Distinct edges met when every node nearer than ``depth`` is expanded, and how often each was met."""
    open_nodes = reached.filter(F.col("hops") < depth).select("sequence_id", "root_id", "node")
    out = open_nodes.join(edges.withColumnRenamed("source_id", "node"), ["sequence_id", "node"]).withColumnRenamed("node", "source_id")
    into = open_nodes.join(edges.withColumnRenamed("target_id", "node"), ["sequence_id", "node"]).withColumnRenamed("node", "target_id")
    return out.unionByName(into.select(*out.columns)).groupBy("sequence_id", "root_id", "source_id", "target_id", "relation").agg(F.count(F.lit(1)).alias("met"))


def plan_retrieval(questions: DataFrame, events: DataFrame, edges: DataFrame, cap: int = MAX_EVENTS) -> DataFrame:
    """Events each question reads: a range, else a time point, else a team, else the first of the timeline.

    An explanation also reads the neighbourhood of its first event; at most ``cap`` events are kept.
    ``questions`` has query_id, sequence_id, scope, at_s, from_s, to_s, team.
    """
    placed = frames.numbered(events, ["sequence_id"], ["start_ts", "end_ts", "start_frame", "event_id"], "start_frame", "_place")
    ranged = questions.filter("from_s IS NOT NULL")
    timed = questions.filter("from_s IS NULL AND at_s IS NOT NULL")
    teamed = questions.filter("from_s IS NULL AND at_s IS NULL AND team IS NOT NULL")
    rest = questions.filter("from_s IS NULL AND at_s IS NULL AND team IS NULL")
    keep = ["query_id", "sequence_id", "scope", "event_id", "_place"]
    by_range = in_range(placed, ranged.select("query_id", "sequence_id", "scope", "from_s", "to_s")).select(*keep)
    by_point = at_time(placed, timed.select("query_id", "sequence_id", "scope", "at_s")).select(*keep)
    by_team = teamed.select("query_id", "sequence_id", "scope", F.col("team").alias("subject_team")).join(placed, ["sequence_id", "subject_team"]).select(*keep)
    by_order = rest.select("query_id", "sequence_id", "scope").join(placed.filter(F.col("_place") <= cap), "sequence_id").select(*keep)
    hits = by_range.unionByName(by_point).unionByName(by_team).unionByName(by_order)
    order = Window.partitionBy("query_id", "sequence_id").orderBy("_place")
    first = hits.withColumn("_rank", F.row_number().over(order).cast("long"))
    first = cut_lineage(first.filter((F.col("_rank") <= cap)), "first_hits")
    why = first.filter("scope = 'MATCH_EXPLANATION'")
    roots = why.filter("_rank = 1").select("query_id", "sequence_id", "scope", F.col("event_id").alias("root_id"))
    around = neighbourhood(edges, roots.select("sequence_id", "root_id").distinct()).filter("hops > 0")
    extra = (roots.join(around, ["sequence_id", "root_id"]).join(placed.select("sequence_id", F.col("event_id").alias("node"), "_place"), ["sequence_id", "node"])
             .select("query_id", "sequence_id", "scope", F.col("node").alias("event_id"), "_place")
             .join(first.select("query_id", "sequence_id", "event_id"), ["query_id", "sequence_id", "event_id"], "left_anti").withColumn("_rank", (F.col("_place") + 1000000).cast("long")))
    ranked = first.unionByName(extra.select(*first.columns)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "sequence_id").orderBy("_rank")))
    return ranked.filter(F.col("rank") <= cap).select("query_id", "sequence_id", "scope", "event_id", "rank")


def answers(questions: DataFrame, plan: DataFrame, events: DataFrame) -> DataFrame:
    """One grounded answer per question: dominant level, mean confidence, citations, limitations, abstention."""
    read = plan.join(events, ["sequence_id", "event_id"])
    cite = F.format_string("[event:%s | t=%.2fs | conf=%.2f | %s]", "event_id", "start_ts", "confidence", "quality")
    clause = (F.when(F.col("level") == LEVEL_1, F.concat(F.lit("Fait mesuré : "), F.col("summary_text")))
              .when(F.col("level") == LEVEL_2, F.concat(F.lit("Tendance observée : "), F.col("summary_text")))
              .otherwise(F.concat(F.lit("Signal compatible (candidat) : "), F.col("summary_text"))))
    rolled = read.groupBy("query_id", "sequence_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.avg("confidence").alias("_conf"), F.max("level").alias("_level"), F.max("conflict").alias("has_conflict"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", cite.alias("t")))), lambda s: s["t"]).alias("citations"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", clause.alias("t")))), lambda s: s["t"]).alias("claims"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("limitations")))).alias("limitations"))
    df = questions.select("query_id", "sequence_id", "scope").join(rolled, ["query_id", "sequence_id"], "left")
    none = F.col("n_events").isNull()
    abstains = (F.col("scope") == "UNSUPPORTED") | (none & F.col("scope").isin("MATCH_FACT", "MATCH_TIMELINE"))
    empty = F.array().cast("array<string>")
    pick = lambda c: F.when(abstains, empty).otherwise(F.coalesce(c, empty))
    return df.select(
        "query_id", "sequence_id", "scope", F.coalesce("n_events", F.lit(0)).alias("n_events"), abstains.alias("abstains"),
        F.when(abstains, 0.0).otherwise(rounded_product(F.coalesce("_conf", F.lit(0.0)), 3)).alias("confidence"), F.coalesce("_level", F.lit(LEVEL_1)).alias("level"),
        F.coalesce("has_conflict", F.lit(False)).alias("has_conflict"), pick("citations").alias("citations"), pick("claims").alias("claims"),
        F.slice(pick("limitations"), 1, 3).alias("limitations"), F.when(abstains, "Les données ne permettent pas d'établir d'événement vérifié.")
        .otherwise(F.array_join(pick("claims"), "\n")).alias("answer"))


def cited(answer_rows: DataFrame) -> DataFrame:
    return (answer_rows.select("query_id", "sequence_id", F.explode("citations").alias("citation"))
            .withColumn("event_id", F.regexp_extract("citation", r"\[event:([^ |]+)", 1)))


def citation_check(answer_rows: DataFrame, events: DataFrame) -> DataFrame:
    """Each citation with whether its event exists in the same sequence."""
    known = events.select("sequence_id", "event_id").withColumn("valid", F.lit(True))
    return cited(answer_rows).join(known, ["sequence_id", "event_id"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def grounding_counters(answer_rows: DataFrame, events: DataFrame, expected: DataFrame, category: str = "scope") -> DataFrame:
    """Citations, claims and abstentions by category; rates are 1.0 (violations 0.0) when there is nothing to count.

    ``expected`` has query_id and should_abstain.
    """
    checks = citation_check(answer_rows, events).groupBy("query_id", "sequence_id").agg(F.count(F.lit(1)).alias("_c"), F.count_if("valid").alias("_v"))
    df = answer_rows.join(checks, ["query_id", "sequence_id"], "left").join(expected, "query_id")
    total, good = F.sum(F.coalesce("_c", F.lit(0))), F.sum(F.coalesce("_v", F.lit(0)))
    due = F.count_if("should_abstain")
    return df.groupBy(category).agg(
        F.count(F.lit(1)).alias("questions"), total.alias("citations"), good.alias("valid_citations"), F.sum(F.size("claims")).alias("claims"),
        F.count_if("abstains").alias("abstentions"),
        F.when(total > 0, good / F.nullif(total, F.lit(0))).otherwise(1.0).alias("citation_precision"), F.when(total > 0, (total - good) / F.nullif(total, F.lit(0))).otherwise(0.0).alias("violation_rate"),
        F.when(due > 0, F.count_if(F.col("should_abstain") & F.col("abstains")) / F.nullif(due, F.lit(0))).otherwise(1.0).alias("abstention_accuracy"),
        F.count_if(F.col("should_abstain") == F.col("abstains")).alias("passed"))


def latency_rollup(rows: DataFrame) -> DataFrame:
    """Mean, greatest and least latency of each stage over the questions that ran it (stage, latency)."""
    return rows.groupBy("stage").agg(F.count("latency").alias("questions"), F.avg("latency").alias("mean_ms"), F.max("latency").alias("max_ms"), F.min("latency").alias("min_ms"))


def height_word(height: Column) -> Column:
    return F.when(height < 35.0, "bas").when(height < 55.0, "médian").otherwise("haut")


def report_rows(events: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Match report as rows (sequence_id, section, position, sentence, citation): fixed sentences, every one grounded."""
    span = events.groupBy("sequence_id").agg(
        F.min("start_ts").alias("a"), F.max("end_ts").alias("b"), F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("level") == lv).alias(f"n{i}") for i, lv in enumerate(LEVELS, start=1)])
    overview = span.select("sequence_id", F.lit(1).alias("section"), F.lit(0).cast("long").alias("position"), F.format_string(
        "Séquence de %.2fs à %.2fs : %d événements (%d faits, %d tendances, %d candidats).", "a", "b", "n", "n1", "n2", "n3").alias("sentence"), F.lit("").alias("citation"))
    who = F.when(F.col("team_label") == "TEAM_0", 0).otherwise(1).cast("long")
    held = aggregates.select("sequence_id", F.lit(2).alias("section"), who.alias("position"), F.format_string(
        "%s : possession %.1f%% (%.2fs), %d pertes.", "team_label", "possession_pct", "possession_s", "possession_changes").alias("sentence"), F.lit("").alias("citation"))
    block = aggregates.filter("line_height_m IS NOT NULL").select("sequence_id", F.lit(3).alias("section"), who.alias("position"), F.format_string(
        "%s : bloc %s, ligne à %.1fm, pression moyenne %.3f.", F.col("team_label"), height_word(F.col("line_height_m")), F.col("line_height_m"), F.col("pressure_mean")).alias("sentence"),
        F.lit("").alias("citation"))
    w = Window.partitionBy("sequence_id").orderBy("start_ts", "end_ts", "start_frame", "event_id")
    moments = events.withColumn("position", F.row_number().over(w).cast("long")).filter("position <= 15").select(
        "sequence_id", F.lit(4).alias("section"), "position", F.col("summary_text").alias("sentence"),
        citation(*[F.col(c) for c in ("event_id", "start_ts", "end_ts", "confidence", "quality")]).alias("citation"))
    return overview.unionByName(held).unionByName(block).unionByName(moments)


def report_grounding(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Sentences per sequence and the share of them whose citation, if any, names a known event."""
    named = rows.withColumn("event_id", F.regexp_extract("citation", r"\[event:([^ |]+)", 1))
    known = events.select("sequence_id", "event_id").withColumn("_ok", F.lit(True))
    df = named.join(known, ["sequence_id", "event_id"], "left")
    good = F.count_if((F.col("event_id") == "") | F.coalesce("_ok", F.lit(False)))
    return df.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("sentences"), good.alias("grounded"), (good / F.count(F.lit(1))).alias("grounded_ratio"))


def isolation_violations(results: DataFrame) -> DataFrame:
    """Answers that carry more than one session."""
    return results.groupBy("query_id").agg(F.count_distinct("sequence_id").alias("sessions")).filter("sessions > 1")


# ---- bucketed tables ----------------------------------------------------------------------------------------

SLOT_S = 2.0
#: Folders of a table kept by id, and the column that names them.
SHARES, SHARE = 8, "sequence_share"
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def _share_of(sequence: Column) -> Column:
    return F.pmod(F.xxhash64(sequence), F.lit(SHARES)).cast("int")


def store_by_id(events: DataFrame, name: str, path: str, buckets: int = 8) -> None:
    """Keep events as a table in folders by share of the sequences and buckets by ``event_id``: a look-up by id reads one bucket, a join by id moves nothing.

    Rows are dealt by bucket first, so there is one file for each folder and bucket, however many sequences there are.
    """
    dealt = events.withColumn(SHARE, _share_of(F.col("sequence_id"))).repartition(buckets, "event_id")
    dealt.write.mode("overwrite").format("parquet").partitionBy(SHARE).bucketBy(buckets, "event_id").sortBy("event_id").option("path", path).saveAsTable(name)


def by_id(spark, name: str, event_id: str, sequence: str | None = None) -> DataFrame:
    found = spark.table(name).filter(F.col("event_id") == event_id)
    if sequence:
        found = found.filter((F.col("sequence_id") == sequence) & (F.col(SHARE) == _share_of(F.lit(sequence))))
    return found.drop(SHARE)


def join_by_id(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join two tables kept by ``store_by_id`` on sequence and ``event_id`` without an exchange.

    Both columns are keys of the join, since an id may stand in every sequence; the buckets are by id alone. The setting that lets
    buckets by one key serve a join by two holds for this join only, so the join is run here and its rows are kept as files.
    """
    both = left.drop(SHARE).join(right.drop(SHARE), ["event_id", "sequence_id"])
    conf = left.sparkSession.conf
    before = conf.get(ALL_KEYS)
    conf.set(ALL_KEYS, "false")
    try:
        return cut_lineage(both, "joined_by_id")
    finally:
        conf.set(ALL_KEYS, before)


def store_by_slot(rows: DataFrame, name: str, path: str, start: str, end: str, buckets: int = 8, slot_s: float = SLOT_S) -> None:
    """Keep intervals as a table bucketed by sequence and time slot; an interval stands in every slot that it touches."""
    slots = F.explode(F.sequence(F.floor(F.col(start) / slot_s), F.floor(F.col(end) / slot_s)))
    rows.withColumn("slot", slots).write.mode("overwrite").format("parquet").bucketBy(buckets, "sequence_id", "slot").sortBy("sequence_id", "slot").option("path", path).saveAsTable(name)


def overlapping(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], slot_s: float = SLOT_S) -> DataFrame:
    """Pairs of two tables kept by ``store_by_slot`` whose closed ranges intersect, each pair once, without an exchange."""
    (l0, l1), (r0, r1) = left_range, right_range
    first = F.greatest(F.floor(F.col(l0) / slot_s), F.floor(F.col(r0) / slot_s))
    return left.join(right, ["sequence_id", "slot"]).filter((F.col(l0) <= F.col(r1)) & (F.col(r0) <= F.col(l1)) & (F.col("slot") == first)).drop("slot")
