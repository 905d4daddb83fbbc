"""Scores: detection AP, assignment, track metrics, label and event metrics, calibration error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.functions import frames
from touchline.functions.bands import near_join
from touchline.functions.boxes import iou
from touchline.operators.geometry import FRAME
from touchline.session import cut_lineage


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of a small rectangular matrix: every row (or column, if there are fewer) gets a partner.

    Rows enter one by one. A new row reaches a column at its cost, and through a taken column the row that holds it, less
    the cost of that hold; relaxing these reaches until none falls gives the cheapest way to a free column, along which
    the holds are exchanged. No such exchange can then be improved, so there are no negative cycles to relax.
    """
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    holds, held_by = np.full(cost.shape[0], -1), np.full(cost.shape[1], -1)
    for new in range(cost.shape[0]):
        reach, through = cost[new].astype(float), np.full(cost.shape[1], new)
        while len(taken := np.flatnonzero(held_by >= 0)):
            rows = held_by[taken]
            ways = (reach[taken] - cost[rows, taken])[:, None] + cost[rows]
            best = ways.argmin(axis=0)
            shorter = np.flatnonzero(ways[best, np.arange(len(reach))] < reach - 1e-12)
            if not len(shorter):
                break
            reach[shorter], through[shorter] = ways[best[shorter], shorter], rows[best[shorter]]
        column = int(np.where(held_by < 0, reach, np.inf).argmin())
        while column >= 0:
            row = through[column]
            held_by[column] = row
            holds[row], column = column, holds[row]
    return [(i, int(j)) for i, j in enumerate(holds)]


def overlaps(truth: DataFrame, predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of one frame with IoU at or above ``least``."""
    pairs = truth.join(predicted, FRAME)
    return (pairs.withColumn("iou", iou([F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(c) for c in ("px1", "py1", "px2", "py2")]))
            .filter(F.col("iou") >= least))


def frame_matches(pairs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One-to-one matches of each frame with the largest total IoU.

    ``pairs`` are overlaps (``track_id, pred_track_id, iou``); of several boxes with one pair of ids the best one counts,
    and gives the ``extra`` columns. A pair without a rival on either side is settled where it is; only the contested pairs of
    a frame, packed into one row, go to Python.
    """
    one = pairs.groupBy(*FRAME, "track_id", "pred_track_id").agg(F.max("iou").alias("iou"), *[F.max_by(c, "iou").alias(c) for c in extra])
    packed = one.groupBy(*FRAME).agg(F.collect_list(F.struct("track_id", "pred_track_id", "iou", *extra)).alias("p"))
    rivals = lambda x: F.size(F.filter("p", lambda y: (y["track_id"] == x["track_id"]) | (y["pred_track_id"] == x["pred_track_id"])))
    told = packed.select(*FRAME, F.filter("p", lambda x: rivals(x) == 1).alias("alone"), F.array_sort(F.filter("p", lambda x: rivals(x) > 1)).alias("open"))
    schema = told.select(*FRAME, "open").schema

    def settle(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            table["open"] = [_best_of([(p["track_id"], p["pred_track_id"], p["iou"]) for p in rows], list(rows)) for rows in table["open"]]
            yield table

    contested = told.filter(F.size("open") > 0).select(*FRAME, "open").mapInPandas(settle, schema)
    each = told.select(*FRAME, F.explode("alone").alias("p")).unionByName(contested.select(*FRAME, F.explode("open").alias("p")))
    return each.select(*FRAME, *[f"p.{c}" for c in ("track_id", "pred_track_id", "iou", *extra)])


#: Totals closer than this are a tie, and how many ends of one part a tie may leave open to be told by the order of adding.
TIE, OPEN_ENDS = 1e-9, 10


def _best_of(edges: list[tuple], rows: list, tell: bool = True) -> list:
    """The rows whose edges (two ends and a gain) make up the best assignment, each connected part on its own.

    Of assignments with equal totals the one stands whose gains, added in the order of their left ends over all parts of two
    edges and more, give the larger sum; if that is the same too, the one whose first left ends take the first partners.
    A part in which a tie leaves more than ``OPEN_ENDS`` left ends open keeps any of its best assignments; so do all without ``tell``.
    """
    kept, certain, open_edges = [], [], []
    for part in _parts(edges):
        if len(part) == 1:
            kept += part
            continue
        held = _assigned(edges, part)
        if not tell:
            kept += held
            continue
        total = sum(edges[i][2] for i in held)
        shaky = {i for i in held if sum(edges[j][2] for j in _assigned(edges, [j for j in part if j != i])) >= total - TIE}
        fixed = [i for i in held if i not in shaky]
        lefts, rights = {edges[i][0] for i in fixed}, {edges[i][1] for i in fixed}
        free = [i for i in part if shaky and edges[i][0] not in lefts and edges[i][1] not in rights]
        if len({edges[i][0] for i in free}) > OPEN_ENDS:
            fixed, free = held, []
        certain, open_edges = certain + fixed, open_edges + free
    kept += _told(edges, certain, open_edges) if open_edges else certain
    return [rows[i] for i in sorted(kept)]


def _assigned(edges: list[tuple], part: list[int]) -> list[int]:
    """Numbers of the edges of ``part`` that make up one best assignment."""
    if not part:
        return []
    left, right = sorted({edges[i][0] for i in part}), sorted({edges[i][1] for i in part})
    at = np.full((len(left), len(right)), -1)
    row_of, column_of = {v: i for i, v in enumerate(left)}, {v: i for i, v in enumerate(right)}
    for i in part:
        at[row_of[edges[i][0]], column_of[edges[i][1]]] = i
    gain = np.where(at >= 0, np.array([e[2] for e in edges], float)[at], 0.0)
    return [int(at[i, j]) for i, j in assign(-gain) if at[i, j] >= 0]


def _told(edges: list[tuple], certain: list[int], open_edges: list[int]) -> list[int]:
    """``certain`` and those of ``open_edges`` that give the largest sum, added left end by left end.

    Ways that block the same later partners go on together: of equal sums the first, and none that lies below a tie with the best.
    """
    by_left: dict = {}
    for i in sorted([*certain, *open_edges], key=lambda i: edges[i][:2]):
        by_left.setdefault(edges[i][0], []).append(i)
    sure, last = set(certain), {}
    for left in by_left:
        last.update({edges[i][1]: left for i in by_left[left]})
    ways: dict[tuple, tuple] = {(frozenset(), 0.0): ()}
    for left, choices in by_left.items():
        grown: dict[tuple, tuple] = {}
        for (used, total), way in ways.items():
            for i in [*choices, *([] if choices[0] in sure else [None])]:
                if i is None or edges[i][1] not in used:
                    taken = used if i is None else used | {edges[i][1]}
                    grown.setdefault((frozenset(p for p in taken if last[p] > left), total + (0.0 if i is None else edges[i][2])), way if i is None else (*way, i))
        best: dict[frozenset, float] = {}
        for used, total in grown:
            best[used] = max(total, best.get(used, total))
        ways = {(used, total): way for (used, total), way in grown.items() if total >= best[used] - TIE}
    return list(ways[max(ways, key=lambda k: k[1])])


def _parts(edges: list[tuple]) -> list[list[int]]:
    """Edge numbers by connected part of a small two-sided graph."""
    root: dict[tuple, tuple] = {}

    def top(x: tuple) -> tuple:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b, _ in edges:
        root[top((0, a))] = top((1, b))
    out: dict[tuple, list[int]] = {}
    for i, (a, _, _) in enumerate(edges):
        out.setdefault(top((0, a)), []).append(i)
    return list(out.values())


def detection_hits(truth: DataFrame, predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """Predictions of each frame in order of confidence, each taking its best free truth box; many frames for each batch."""
    def take(rows) -> list[int]:
        used, hits = set(), {}
        for r in rows:  # by falling confidence, event and falling overlap
            hits.setdefault(r["event_id"], 0)
            if not hits[r["event_id"]] and r["low"] is not None and -r["low"] >= least and r["track_id"] not in used:
                hits[r["event_id"]] = 1
                used.add(r["track_id"])
        return list(hits.items())

    def settle(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            found = [x for rows in table["p"] for x in take(rows)]
            yield pd.DataFrame(found, columns=["event_id", "hit"])

    boxes = predicted.select(*FRAME, "event_id", "px1", "py1", "px2", "py2").withColumnRenamed("event_id", "_e")
    near = overlaps(truth, boxes, least).select(*FRAME, F.col("_e").alias("event_id"), "track_id", "iou").join(predicted.select("event_id", "conf"), "event_id")
    packed = near.groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct((-F.col("conf")).alias("order"), "event_id", (-F.col("iou")).alias("low"), "track_id"))).alias("p"))
    found = packed.select("p").mapInPandas(settle, "event_id bigint, hit int")
    return predicted.select("event_id", "conf").join(found, "event_id", "left").select("event_id", "conf", F.coalesce("hit", F.lit(0)).alias("hit"))


def _ranked(rows: DataFrame, score: str, *counts: Column) -> DataFrame:
    """Counts per exact score with ``part``: the scores in falling ranges, one task each, numbered in order.

    Equal scores are one row; everything cumulative is then a window inside a range plus one row per range.
    """
    per = rows.groupBy(F.col(score).alias("_s")).agg(*counts)
    dealt = per.repartitionByRange(F.desc("_s")).withColumn("part", F.spark_partition_id())
    return cut_lineage(dealt)


def _cumulative(ranked: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add ``columns[source]``: the sum of ``source`` over all scores down to this one, in two levels."""
    inside = Window.partitionBy("part").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = ranked.groupBy("part").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    before = totals.select("part", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in columns])
    return ranked.join(before, "part").select("*", *[(F.sum(c).over(inside) + F.col(f"_{c}")).alias(t) for c, t in columns.items()]).drop(*[f"_{c}" for c in columns])


def average_precision(hits: DataFrame, truths: DataFrame) -> DataFrame:
    """AP as the area under the envelope of the precision-recall curve; ``truths`` is one row with the truth count.

    Only predictions of equal confidence count as one step of the curve.
    """
    ranked = _ranked(hits, "conf", F.sum("hit").alias("hit"), F.count(F.lit(1)).alias("one"))
    curve = _cumulative(ranked, {"hit": "tp", "one": "n"}).crossJoin(F.broadcast(truths.select(F.col(truths.columns[0]).alias("truths"))))
    curve = cut_lineage(curve.select("part", "_s", (F.col("tp") / F.col("truths")).alias("recall"), ((F.col("tp") - F.col("hit")) / F.col("truths")).alias("before"), (F.col("tp") / F.col("n")).alias("precision")))
    onward = Window.partitionBy("part").orderBy(F.desc("_s")).rowsBetween(0, Window.unboundedFollowing)
    later = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    best = curve.groupBy("part").agg(F.max("precision").alias("_m"))
    ahead = best.select("part", F.max("_m").over(later).alias("_ahead"))
    env = curve.join(ahead, "part").withColumn("envelope", F.greatest(F.max("precision").over(onward), F.coalesce("_ahead", F.lit(0.0))))
    return env.agg(F.sum((F.col("recall") - F.col("before")) * F.col("envelope")).alias("ap"), F.max("recall").alias("recall"),
                   F.max_by("precision", -F.col("_s")).alias("precision"))


def hota_at(matches: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """DetA, AssA and HOTA at the matching threshold, per sequence, from frame matches and track sizes."""
    hits = matches.groupBy("sequence_id", "track_id", "pred_track_id").agg(F.count(F.lit(1)).alias("tpa"))
    t = truth.groupBy("sequence_id", "track_id").agg(F.count(F.lit(1)).alias("t_len"))
    p = predicted.groupBy("sequence_id", "pred_track_id").agg(F.count(F.lit(1)).alias("p_len"))
    pairs = hits.join(t, ["sequence_id", "track_id"]).join(p, ["sequence_id", "pred_track_id"])
    share = F.col("tpa") / (F.col("t_len") + F.col("p_len") - F.col("tpa"))
    ass = pairs.groupBy("sequence_id").agg(F.sum("tpa").alias("tp"), (F.sum(F.col("tpa") * share) / F.sum("tpa")).alias("ass_a"))
    sizes = (t.groupBy("sequence_id").agg(F.sum("t_len").alias("n_t")).join(p.groupBy("sequence_id").agg(F.sum("p_len").alias("n_p")), "sequence_id"))
    return sizes.join(ass, "sequence_id").select("sequence_id", (F.col("tp") / (F.col("n_t") + F.col("n_p") - F.col("tp"))).alias("det_a"), "ass_a").withColumn(
        "hota", F.sqrt(F.col("det_a") * F.col("ass_a")))


def overlap_parts(counts: DataFrame) -> DataFrame:
    """Connected parts of the track overlaps of each sequence: ``counts`` with ``part``, the least truth track of the part.

    A truth track passes its label to the predicted tracks it overlaps and takes the least label of those; rounds go on until
    nothing changes, as many as half the longest way inside a part.
    """
    keys = ["sequence_id", "track_id"]
    edges = cut_lineage(counts.withColumn("part", F.col("track_id")))
    while True:
        least = edges.groupBy("sequence_id", "pred_track_id").agg(F.min("part").alias("_p"))
        own = edges.drop("part").join(least, ["sequence_id", "pred_track_id"]).groupBy(*keys).agg(F.min("_p").alias("part"))
        new = cut_lineage(edges.withColumnRenamed("part", "_old").join(own, keys))
        still = new.filter("part <> _old").isEmpty()
        edges = new.drop("_old")
        if still:
            return edges


def idf1(truth: DataFrame, predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """IDF1 per sequence: the best assignment of tracks, one connected part of the overlaps at a time.

    Parts of one pair need no search; no group is larger than a part.
    """
    counts = overlaps(truth, predicted, least).groupBy("sequence_id", "track_id", "pred_track_id").agg(F.count(F.lit(1)).alias("n"))
    packed = overlap_parts(counts).groupBy("sequence_id", "part").agg(F.sort_array(F.collect_list(F.struct("track_id", "pred_track_id", "n"))).alias("p"))

    def best(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            hits = [sum(e[2] for e in _best_of(edges, edges, tell=False)) for edges in ([(p["track_id"], p["pred_track_id"], p["n"]) for p in rows] for rows in table["p"])]
            yield pd.DataFrame({"sequence_id": table["sequence_id"], "hits": pd.array(hits, dtype="int64")})

    single = packed.filter(F.size("p") == 1).select("sequence_id", F.get("p", F.lit(0))["n"].alias("hits"))
    found = single.unionByName(packed.filter(F.size("p") > 1).select("sequence_id", "p").mapInPandas(best, "sequence_id string, hits bigint"))
    idtp = found.groupBy("sequence_id").agg(F.sum("hits").alias("idtp"))
    sizes = (truth.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n_t")).join(predicted.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n_p")), "sequence_id"))
    return sizes.join(idtp, "sequence_id", "left").select("sequence_id", (F.lit(2.0) * F.coalesce("idtp", F.lit(0)) / (F.col("n_t") + F.col("n_p"))).alias("idf1"))


def best_truth_track(pairs: DataFrame) -> DataFrame:
    """Truth track each predicted track overlaps most; of equal ones, the one met first."""
    counted = pairs.groupBy("sequence_id", "pred_track_id", "track_id").agg(F.count(F.lit(1)).alias("frames"), F.min("frame_index").alias("_first"))
    return (counted.groupBy("sequence_id", "pred_track_id")
            .agg(F.max(F.struct("frames", (-F.col("_first")).alias("_early"), (-F.col("track_id")).alias("_low"))).alias("b"))
            .select("sequence_id", "pred_track_id", (-F.col("b._low")).alias("track_id"), F.col("b.frames").alias("frames")))


def switches(matches: DataFrame, truth: DataFrame, span: int = frames.SPAN) -> DataFrame:
    """Identity switches, fragmentations, mostly tracked and mostly lost truth tracks, per sequence."""
    keys = ["sequence_id", "track_id"]
    pairs = frames.previous_row(matches, keys, "frame_index", ["frame_index", "pred_track_id"], span=span)
    per_track = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("pred_track_id") != F.col("prev_pred_track_id")).alias("switches"),
        F.count_if(F.col("frame_index") - F.col("prev_frame_index") > 1).alias("fragments"),
        *[F.count_if((F.col("pred_track_id") != F.col("prev_pred_track_id")) & test).alias(name) for name, test in (
            ("switch_short", F.col("frame_index") - F.col("prev_frame_index") <= 2), ("switch_medium", (F.col("frame_index") - F.col("prev_frame_index")).between(3, 10)),
            ("switch_long", F.col("frame_index") - F.col("prev_frame_index") > 10))])
    sizes = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("length"))
    df = sizes.join(per_track, keys, "left").fillna(0)
    share = F.col("found") / F.col("length")
    return df.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("tracks"), F.sum("switches").alias("switches"), F.sum("fragments").alias("fragments"), F.count_if(share >= 0.8).alias("mostly_tracked"),
        F.count_if(share <= 0.2).alias("mostly_lost"), *[F.sum(c).alias(c) for c in ("switch_short", "switch_medium", "switch_long")])


def confusion(rows: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or []), F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(counts: DataFrame, abstain: str | None = None) -> DataFrame:
    """Precision, recall and F1 of each class from confusion counts; an abstention is never a class."""
    c = counts
    tp = c.filter("truth = predicted").groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("tp"))
    support = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"))
    called = (c if abstain is None else c.filter(F.col("predicted") != abstain)).groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    df = support.join(called, "label", "full_outer").join(tp, "label", "left").fillna(0)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.nullif(F.col(b), F.lit(0))).otherwise(0.0)
    df = df.withColumn("precision", ratio("tp", "called")).withColumn("recall", ratio("tp", "support"))
    both = F.col("precision") + F.col("recall")
    return df.withColumn("f1", F.when(both > 0, F.lit(2.0) * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0))).otherwise(0.0))


def label_summary(counts: DataFrame, scores: DataFrame, skip_unsupported: bool = True, abstain: str | None = None) -> DataFrame:
    """Accuracy, macro-F1, balanced accuracy and coverage; classes without truth rows are skipped or averaged in."""
    kept = scores.filter("support > 0") if skip_unsupported else scores
    macro = kept.agg(F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))
    called = F.col("predicted") != abstain if abstain else F.lit(True)
    total = counts.agg((F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"),
                       (F.sum(F.when(called, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"), F.sum("n").alias("rows"))
    return total.crossJoin(F.broadcast(macro))


def team_accuracy(rows: DataFrame) -> DataFrame:
    """Team accuracy per sequence under the better of the two namings of the teams."""
    same = F.col("team_label") == F.col("pred_team")
    known = F.col("pred_team").isin("TEAM_0", "TEAM_1")
    df = rows.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(same & known).alias("_direct"), F.count_if(~same & known).alias("_swapped"))
    return df.select("sequence_id", "rows", (F.greatest("_direct", "_swapped") / F.col("rows")).alias("accuracy"), (F.col("_swapped") > F.col("_direct")).alias("swapped"))


def labels_by_frame(intervals: DataFrame) -> DataFrame:
    """Frame labels of intervals with both ends; the later interval (by ``interval_no``) overwrites."""
    spread = intervals.withColumn("frame_index", F.explode(F.sequence("start_frame", "end_frame")))
    return spread.groupBy("sequence_id", "frame_index").agg(F.max_by("label", "interval_no").alias("label"))


def greedy_pairs(pairs: DataFrame, keys: list[str], cost: Column) -> DataFrame:
    """One-to-one matches of candidate pairs (pred_id, truth_id), cheapest first.

    Each round keeps the pairs that are the cheapest of both their ends and drops what they touch, which gives
    the result of the serial rule without a serial pass: the cheapest pair left always qualifies.
    """
    left = cut_lineage(pairs.withColumn("_cost", F.struct(cost.alias("c"), F.col("pred_id").alias("p"), F.col("truth_id").alias("t"))))
    chosen = None
    while True:
        p = F.min("_cost").over(Window.partitionBy(*keys, "pred_id"))
        t = F.min("_cost").over(Window.partitionBy(*keys, "truth_id"))
        marked = cut_lineage(left.withColumn("_best", (F.col("_cost") == p) & (F.col("_cost") == t)))
        won = marked.filter("_best").drop("_best")
        chosen = won if chosen is None else chosen.unionByName(won)
        rest = marked.filter("NOT _best").drop("_best")
        rest = rest.join(won.select(*keys, "pred_id"), [*keys, "pred_id"], "left_anti").join(won.select(*keys, "truth_id"), [*keys, "truth_id"], "left_anti")
        if rest.isEmpty():
            return chosen.drop("_cost")
        left = cut_lineage(rest)


def match_events(predicted: DataFrame, truth: DataFrame, release_reach: int = 5, reception_reach: int = 8) -> DataFrame:
    """Pass matches: release within 5 and reception within 8 frames, smallest total difference first."""
    near = near_join(predicted.select("sequence_id", F.col("event_no").alias("pred_id"), F.col("release_frame").alias("p_rel"), F.col("reception_frame").alias("p_rec")),
                     truth.select("sequence_id", F.col("event_no").alias("truth_id"), F.col("release_frame").alias("t_rel"), F.col("reception_frame").alias("t_rec")),
                     ["sequence_id"], "p_rel", "t_rel", release_reach)
    late = F.coalesce(F.abs(F.col("p_rec") - F.col("t_rec")), F.lit(0))
    return greedy_pairs(near.filter(late <= reception_reach), ["sequence_id"], F.abs(F.col("p_rel") - F.col("t_rel")) + late)


def first_come_matches(predicted: DataFrame, truth: DataFrame, reach: int = 20) -> DataFrame:
    """Matches in the order of the predictions, each with the nearest truth in reach that is still free.

    Only events that lie within reach of one another interact, so clusters of close events are split off first
    and each is settled on its own.
    """
    near = near_join(predicted.select("sequence_id", F.col("event_no").alias("pred_id"), F.col("frame").alias("p_at")),
                     truth.select("sequence_id", F.col("event_no").alias("truth_id"), F.col("frame").alias("t_at")), ["sequence_id"], "p_at", "t_at", reach)
    marks = near.select("sequence_id", "p_at").distinct()
    parted = frames.previous_row(marks, ["sequence_id"], "p_at", ["p_at"])
    parts = frames.islands(parted, ["sequence_id"], "p_at", F.coalesce(F.col("p_at") - F.col("prev_p_at") > 2 * reach, F.lit(True)), "cluster")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for (_, pred), rows in pdf.groupby(["p_at", "pred_id"], sort=True):
            free = rows[~rows["truth_id"].isin(used)]
            if len(free):
                pick = free.assign(gap=(free["t_at"] - free["p_at"]).abs()).sort_values(["gap", "truth_id"]).iloc[0]
                used.add(pick["truth_id"])
                out.append((pick["sequence_id"], int(pred), int(pick["truth_id"]), int(pick["p_at"] - pick["t_at"])))
        return pd.DataFrame(out, columns=["sequence_id", "pred_id", "truth_id", "onset_error"])

    return near.join(parts.select("sequence_id", "p_at", "cluster"), ["sequence_id", "p_at"]).groupBy("sequence_id", "cluster").applyInPandas(
        settle, "sequence_id string, pred_id bigint, truth_id bigint, onset_error bigint")


def event_scores(matched: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall, F1 and timing errors of matched events."""
    hits = matched.agg(F.count(F.lit(1)).alias("hits"), F.avg(F.abs(F.col("p_rel") - F.col("t_rel"))).alias("mean_error"),
                       F.percentile(F.abs(F.col("p_rel") - F.col("t_rel")), 0.5).alias("median_error"), F.percentile(F.abs(F.col("p_rel") - F.col("t_rel")), 0.9).alias("p90_error"))
    sizes = predicted.agg(F.count(F.lit(1)).alias("n_pred")).crossJoin(truth.agg(F.count(F.lit(1)).alias("n_truth")))
    df = hits.crossJoin(sizes)
    safe = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)
    return df.select("*", safe(F.col("hits"), F.col("n_pred")).alias("precision"), safe(F.col("hits"), F.col("n_truth")).alias("recall"),
                     safe(F.lit(2.0) * F.col("hits"), F.col("n_pred") + F.col("n_truth")).alias("f1"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over ten bins and the Brier score; a probability of exactly 1 is in no bin."""
    bucket = F.floor(F.col("p") * bins)
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    by_bin = rows.filter("p < 1.0").groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    parts = by_bin.agg(F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))).alias("_e"))
    return total.crossJoin(parts).select("rows", "brier", (F.col("_e") / F.col("rows")).alias("ece"))


def ranking_areas(rows: DataFrame) -> DataFrame:
    """ROC-AUC and PR-AUC over exact scores; equal scores are one step."""
    ranked = _ranked(rows, "p", F.sum("y").alias("pos"), (F.count(F.lit(1)) - F.sum("y")).alias("neg"))
    run = _cumulative(ranked, {"pos": "tp", "neg": "fp"})
    df = run.crossJoin(F.broadcast(ranked.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))))
    return df.agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0) / (F.col("_p") * F.col("_n"))).alias("roc_auc"),
                  F.sum(F.col("pos") / F.col("_p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("pr_auc"))


def near_changes(labels: DataFrame, reach: int = 10, span: int = frames.SPAN) -> DataFrame:
    """Flag the frames within ten frames of a change of the label."""
    def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("frame_index").rangeBetween(-reach, reach)
        return rows.withColumn("near_change", F.max("_c").over(w) == 1)

    pairs = frames.previous_row(labels, ["sequence_id"], "frame_index", ["label"], span=span)
    marked = pairs.withColumn("_c", F.coalesce(F.col("label") != F.col("prev_label"), F.lit(False)).cast("int")).drop("prev_label")
    return frames.halo(marked, ["sequence_id"], "frame_index", spread, before=reach, after=reach, span=span).drop("_c")


def stints(labels: DataFrame, keys: list[str], fps: float = 25.0, span: int = frames.SPAN) -> DataFrame:
    """Runs of one label: switches per minute, mean length, runs under three frames, per key."""
    pairs = frames.previous_row(labels, keys, "frame_index", ["label"], span=span)
    runs = frames.islands(pairs, keys, "frame_index", F.coalesce(F.col("label") != F.col("prev_label"), F.lit(True)), "run", span)
    lengths = runs.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("length"))
    frames_all = F.sum("length")
    return lengths.groupBy(*keys).agg(F.count(F.lit(1)).alias("stints"), F.avg("length").alias("mean_length"), F.count_if(F.col("length") < 3).alias("short_stints"),
                                      ((F.count(F.lit(1)) - 1) / (frames_all / F.lit(fps * 60.0))).alias("switches_per_minute"),
                                      (F.lit(1.0) - (F.count(F.lit(1)) - 1) / F.greatest(frames_all - 1, F.lit(1))).alias("stability"))


def distribution(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    q = F.percentile(column, [0.5, 0.9, 0.95])
    return rows.groupBy(*by).agg(F.avg(column).alias("mean"), q[0].alias("median"), q[1].alias("p90"), q[2].alias("p95"), F.min(column).alias("min"), F.max(column).alias("max"))


def centre_errors(track: DataFrame, truth: DataFrame, side: float) -> DataFrame:
    """Distance of a tracked centre (u, v) from the true one, plain and in box sides, and overlap of the boxes, by state."""
    both = track.join(truth, FRAME)
    du, dv = F.abs(F.col("u") - F.col("true_u")), F.abs(F.col("v") - F.col("true_v"))
    gap = F.sqrt(du * du + dv * dv)
    common = F.greatest(F.lit(0.0), side - du) * F.greatest(F.lit(0.0), side - dv)
    return both.groupBy("sequence_id", "state").agg(
        F.count(F.lit(1)).alias("frames"), F.avg(gap).alias("mean_distance"), F.max(gap).alias("max_distance"), F.avg(gap / side).alias("mean_normalised"),
        F.avg(common / (2 * side * side - common)).alias("mean_iou"))


def macro(rows: DataFrame, by: list[str], sequence: str, value: str) -> DataFrame:
    """Mean over sequences of the mean within each."""
    return rows.groupBy(*by, sequence).agg(F.avg(value).alias("_m")).groupBy(*by).agg(F.avg("_m").alias("macro_mean"), F.count(F.lit(1)).alias("sequences"))


def monotonicity(sweep: DataFrame, key: list[str], order: str, value: str, rising: bool = True) -> DataFrame:
    """Steps of a swept input at which the score moves the wrong way."""
    w = Window.partitionBy(*key).orderBy(order)
    step = F.col(value) - F.lag(value).over(w)
    wrong = step < -1e-9 if rising else step > 1e-9
    return sweep.withColumn("_w", F.coalesce(wrong, F.lit(False))).groupBy(*key).agg(F.count(F.lit(1)).alias("points"), F.count_if("_w").alias("violations"))


def profile(events: DataFrame, signal: DataFrame, value: str, offsets: tuple[int, ...] = (-25, 0, 12, 25)) -> DataFrame:
    """Signal at fixed frame offsets around each event."""
    at = events.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("frame_index", F.col("event_frame") + F.col("offset"))
    return at.join(signal.select("sequence_id", "frame_index", value), ["sequence_id", "frame_index"], "left")


def registration_iou(predicted: DataFrame, truth: DataFrame, columns: int = 48, rows: int = 27) -> DataFrame:
    """Overlap of the pitch as two matrices see it: share of a 48 x 27 image grid both place on the pitch.

    The grid has 1296 points; it is a fixed array inside each row, not a join.
    """
    from touchline.functions.boxes import is_inside, let, project

    both = predicted.select(*FRAME, F.col("h").alias("_p")).join(truth.select(*FRAME, F.col("h").alias("_t")), FRAME)
    grid = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(rows - 1)), lambda j: F.struct(((i + 0.5) / columns * 1920.0).alias("u"), ((j + 0.5) / rows * 1080.0).alias("v")))))
    on = lambda m, g: let(project(F.col(m), g["u"], g["v"]), lambda q: F.coalesce(is_inside(q["x"], q["y"]), F.lit(False)))
    seen = both.withColumn("_g", F.transform(grid, lambda g: F.struct(on("_p", g).alias("p"), on("_t", g).alias("t"))))
    count = lambda test: F.size(F.filter("_g", test))
    return seen.select(*FRAME, count(lambda g: g["p"] & g["t"]).alias("_i"), count(lambda g: g["p"] | g["t"]).alias("_u")).select(
        *FRAME, F.when(F.col("_u") > 0, F.col("_i") / F.nullif(F.col("_u"), F.lit(0))).otherwise(0.0).alias("iou"))


def perturb(players: DataFrame, rounds: int, noise_m: float) -> DataFrame:
    """Copies of the players with repeatable position noise, one per round."""
    unit = lambda salt: (F.pmod(F.xxhash64("sequence_id", "frame_index", "track_id", "round", F.lit(salt)), F.lit(2001)) - 1000) / 1000.0
    return (players.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
            .withColumn("x_m", F.col("x_m") + unit("x") * noise_m).withColumn("y_m", F.col("y_m") + unit("y") * noise_m))
