"""Merkle manifest of a table: a digest for every row, every source and the whole table, and a proof for every row.

Leaves stand in order inside their source; 16 consecutive nodes have one parent. Conditional aggregates spread the children
of a parent over 16 columns. All columns together are what the parent hashes; all but a child's own column are its siblings.
Trees are climbed level by level, all sources at once; the digests of sources are the leaves of one more tree of this kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from touchline.llm.rows import pick
from touchline.session import cut_lineage

FANOUT = 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIDES = "array<struct<l:string,r:string>>"
_SLOTS = [f"c{i}" for i in range(FANOUT)]


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Hash of the fields, each ``-`` or its byte count, ``:`` and itself."""
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def _joined(columns: list[Column]) -> Column:
    return F.concat(*[F.coalesce(c, F.lit("")) for c in columns])


def _sides(slot: int, digest: list[Column]) -> Column:
    """What stands left and right of a slot in the run of its parent."""
    left, right = digest[:slot], digest[slot + 1:]
    return F.struct((_joined(left) if left else F.lit("")).alias("l"), (_joined(right) if right else F.lit("")).alias("r"))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``tree`` (0, 1, ... by ``group``, null first), ``place`` (0, 1, ... by ``order`` inside it) and ``size`` of the tree.

    Rows are dealt by range of the whole sort key, so one task sorts a bounded share of them however large a group or however
    often a row repeats (repeats are told apart by a number). A row's number inside its task and the counts of the
    tasks before give its place: windows see one row for each task and group, never the rows themselves.
    """
    numbered = rows.withColumn("_again", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_again")]
    dealt = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_again").withColumn("_id", F.monotonically_increasing_id())
    dealt = cut_lineage(dealt.withColumn("_task", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"), "placed")
    parts = dealt.groupBy("_task", group).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    inside = Window.partitionBy(group)
    before = inside.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("*", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(inside).alias("size"), F.min("_task").over(inside).alias("_begins"))
    # a group is numbered in the task where it begins: by its rank there, after all that begin in earlier tasks
    begun = parts.filter("_task = _begins").select(F.col("_task").alias("_at"), F.col(group).alias("_group"), F.row_number().over(Window.partitionBy("_task").orderBy("_first")).alias("_rank"))
    counts = begun.groupBy("_at").count()
    earlier = counts.select("_at", F.coalesce(F.sum("count").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    trees = begun.join(earlier, "_at").select("_group", (F.col("_earlier") + F.col("_rank") - 1).alias("tree"))
    parts = parts.join(trees, F.col(group).eqNullSafe(F.col("_group"))).select(
        F.col("_task").alias("_t"), F.col(group).alias("_g"), (F.col("_before") - F.col("_first")).alias("_shift"), "size", "tree")
    parts = cut_lineage(parts, "tasks")
    found = dealt.join(parts, (F.col("_task") == F.col("_t")) & F.col(group).eqNullSafe(F.col("_g")))
    return found.withColumn("place", F.col("_row") + F.col("_shift")).drop("_task", "_row", "_t", "_g", "_shift")


def _pivot(nodes: DataFrame, value: str) -> DataFrame:
    """Children of each parent side by side: ``tree, place`` of the parent, ``size`` of the level below, a column per slot."""
    slot = F.pmod("place", F.lit(FANOUT))
    up = nodes.withColumn("_up", F.floor(F.col("place") / FANOUT)).withColumn("_slot", slot)
    return up.groupBy("tree", F.col("_up").alias("place")).agg(F.first("size").alias("size"), *[F.max(F.when(F.col("_slot") == i, F.col(value))).alias(c) for i, c in enumerate(_SLOTS)])


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Levels of all trees from ``tree, place, size, digest``: the pivots level by level, and ``tree, digest`` of the tops.

    The number of levels is the logarithm of the largest tree; one number comes to the driver.
    """
    levels: list[DataFrame] = []
    largest = nodes.agg(F.max("size")).first()[0] or 0
    tops = nodes.filter("size = 1").select("tree", "digest")
    while largest > 1:
        pivot = cut_lineage(_pivot(nodes.filter("size > 1"), "digest"), "level")
        levels.append(pivot)
        nodes = pivot.select("tree", "place", F.ceil(F.col("size") / FANOUT).alias("size"), F.sha2(_joined([F.col(c) for c in _SLOTS]), 256).alias("digest"))
        tops = tops.unionByName(nodes.filter("size = 1").select("tree", "digest"))
        largest = -(-largest // FANOUT)
    return levels, tops


def _descend(levels: list[DataFrame], roots: DataFrame) -> DataFrame | None:
    """Per parent of the lowest level ``tree, place, size, c0.., path``: the sides of all its ancestors, upwards.

    ``roots`` holds ``tree, above``: what lies beyond the top of each tree. Each level joins its parents, 16 times fewer.
    """
    below = None
    for level in reversed(levels):
        top = level.filter(f"size <= {FANOUT}").join(roots, "tree").withColumnRenamed("above", "path")
        if below is None:
            below = top
            continue
        own = F.element_at(F.array(*[_sides(i, [F.col(f"u.{c}") for c in _SLOTS]) for i in range(FANOUT)]), (F.pmod(F.col("d.place"), F.lit(FANOUT)) + 1).cast("int"))
        lower = level.filter(f"size > {FANOUT}").alias("d").join(below.alias("u"), (F.col("d.tree") == F.col("u.tree")) & (F.floor(F.col("d.place") / FANOUT) == F.col("u.place")))
        lower = lower.select("d.*", F.concat(F.array(own), F.col("u.path")).cast(SIDES).alias("path"))
        below = cut_lineage(top.unionByName(lower), "paths")
    return below


def _folded(digest: Column, sides: Column) -> Column:
    return F.aggregate(sides, digest, lambda so_far, s: F.sha2(F.concat(s["l"], so_far, s["r"]), 256))


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", text_col: str = "text",
             every: int = 5) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs``.

    A tampered copy of the rows whose id has a CRC-32 that ``every`` divides is checked against the proofs: its text is
    lower-cased (A-Z), and ``verified`` is false where that changed anything. Null fields hash as ``-``; a null id stands
    first in its source and is never tampered with; a null source is a source of its own and the first one. Repeated ids stand in the
    order of their leaves, so equal rows are interchangeable and each has its own place. An empty table gives an empty result.
    """
    rows = pick(docs, doc_id=id_col, source=source_col, lang=lang_col, n_chars=size_col, text=text_col)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    plain = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = rows.select("doc_id", "source", leaf_digest(*plain, F.col("text")).alias("leaf"), F.when(hit, leaf_digest(*plain, F.translate("text", UPPER, UPPER.lower()))).alias("tampered"))
    leaves = placed(cut_lineage(leaves, "leaves"), "source", ["doc_id", "leaf"])
    leaves = leaves.withColumn("digest", F.struct(F.col("leaf").alias("digest"), "doc_id", "tampered"))
    families = cut_lineage(_pivot(leaves, "digest"), "families")
    digest = [F.col(f"{c}.digest") for c in _SLOTS]
    parents = families.select("tree", "place", F.ceil(F.col("size") / FANOUT).alias("size"), F.when(F.col("size") > 1, F.sha2(_joined(digest), 256)).otherwise(digest[0]).alias("digest"))
    levels, subroots = _climb(parents)
    subroots = cut_lineage(subroots, "subroots")
    n_trees = subroots.count()
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(n_trees).cast("long").alias("size"), "digest")
    upper, root = _climb(tops)
    found = root.first()
    above = _above(upper, subroots)
    paths = _descend(levels, above)
    known = families.filter(f"size <= {FANOUT}").join(above, "tree").withColumnRenamed("above", "path")
    if paths is not None:
        own = F.element_at(F.array(*[_sides(i, [F.col(f"u.{c}") for c in _SLOTS]) for i in range(FANOUT)]), (F.pmod(F.col("d.place"), F.lit(FANOUT)) + 1).cast("int"))
        more = families.filter(f"size > {FANOUT}").alias("d").join(paths.alias("u"), (F.col("d.tree") == F.col("u.tree")) & (F.floor(F.col("d.place") / FANOUT) == F.col("u.place")))
        known = known.unionByName(more.select("d.*", F.concat(F.array(own), F.col("u.path")).cast(SIDES).alias("path")))
    known = known.join(subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    children = F.filter(F.array(*[F.struct(F.col(f"{c}.doc_id").alias("doc_id"), F.col(f"{c}.digest").alias("leaf"), F.col(f"{c}.tampered").alias("tampered"), _sides(i, digest).alias("own"))
                                  for i, c in enumerate(_SLOTS)]), lambda x: x["leaf"].isNotNull())
    each = known.select("subroot", "path", "size", F.explode(children).alias("x"))
    sides = F.when(F.col("size") > 1, F.concat(F.array("x.own"), F.col("path"))).otherwise(F.col("path"))
    each = each.select("x.doc_id", "x.leaf", "x.tampered", "subroot", F.lit(found.digest if found else None).cast("string").alias("root"), sides.alias("sides"))
    proof = F.sha2(F.array_join(F.transform("sides", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    folded = _folded(F.coalesce("tampered", "leaf"), F.col("sides"))
    out = each.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _above(upper: list[DataFrame], subroots: DataFrame) -> DataFrame:
    """``tree, above``: the sides of each source's digest in the tree of sources, none where there is one source."""
    spark: SparkSession = subroots.sparkSession
    nothing = F.array().cast(SIDES)
    if not upper:
        return subroots.select("tree", nothing.alias("above"))
    lowest = _descend(upper, spark.range(1).select(F.col("id").alias("tree"), nothing.alias("above")))
    digest = [F.col(c) for c in _SLOTS]
    children = F.array(*[F.struct((F.col("place") * FANOUT + i).alias("tree"), F.col(c).alias("digest"), _sides(i, digest).alias("own")) for i, c in enumerate(_SLOTS)])
    each = lowest.select("path", F.explode(F.filter(children, lambda x: x["digest"].isNotNull())).alias("x"))
    return cut_lineage(each.select("x.tree", F.concat(F.array("x.own"), F.col("path")).cast(SIDES).alias("above")), "above")
