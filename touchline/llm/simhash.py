"""SimHash near-duplicates: 64-bit fingerprints joined to themselves along a binary trie.

Fingerprints equal in all bits are one node. A pair within three bits agrees on one of four 16-bit quarters, so the trie is
cut into the sub-tries below each quarter value (four turned copies of the distinct fingerprints), and each sub-trie is
joined with itself: pairs of nodes go down together, add up the bits in which they differ and stop beyond the budget.
Sub-tries with very many fingerprints are cut once more, by the same argument, into 12-bit parts of the other 48 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from touchline.llm.components import connected_components, unite
from touchline.llm.rows import pick, place, raw, slices
from touchline.session import cut_lineage

BITS = 64
QUARTERS = 4
SEED = 42
#: Distinct fingerprints of a sub-trie beyond which it is cut once more.
LARGE_TRIE = 1 << 17
CHUNK = 1 << 17
FRONTIER = 1 << 20


def fingerprint(text: bytes | None, width: int = 3, seed: int = SEED) -> int:
    """SimHash of one text (UTF-8): bit set where over half of the shingle hashes have it; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    stops = (ends[width - 1:] - 1).tolist()
    starts = [0, *ends[:len(stops) - 1].tolist()]
    h = np.array([xxhash.xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, stops, strict=True)], dtype=">u8")
    total = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 8192):
        total += np.unpackbits(h[i:i + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``fp`` (the fingerprint as a signed long). Null texts have no words."""
    source = pick(docs, doc_id=id_col, text=text_col)
    kind = source.schema["doc_id"].dataType.simpleString()

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fp = np.array([fingerprint(t, width) for t in raw(part, "text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["doc_id", "fp"])

    return source.mapInArrow(hash_rows, f"doc_id {kind}, fp long")


def trie_pairs(keys: np.ndarray, starts: np.ndarray, budget: int = 3, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions whose keys differ in ``budget`` bits at most, within each group of sorted distinct keys.

    ``starts`` holds the first position of each group and the end. A node is a range of the sorted keys; a level splits
    each node of each pair at its bit. Pairs of single keys are settled at once. The frontier is walked depth first in
    pieces, so its size stays bounded.
    """
    low, high = starts[:-1], starts[1:]
    keep = high - low > 1
    low, high = low[keep].astype(np.int64), high[keep].astype(np.int64)
    ones: dict[int, np.ndarray] = {}

    def middle(depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((keys >> np.uint64(bits - 1 - depth)) & np.uint64(1), dtype=np.int64)])
        return hi - (ones[depth][hi] - ones[depth][lo])

    stack = [(0, low, high, low, high, np.zeros(len(low), np.int8))]
    while stack:
        depth, al, ah, bl, bh, err = stack.pop()
        if depth == bits or not len(al):
            continue
        if len(al) > FRONTIER:
            for i in range(0, len(al), FRONTIER // 2):
                stack.append((depth, *(x[i:i + FRONTIER // 2] for x in (al, ah, bl, bh, err))))
            continue
        am, bm, own = middle(depth, al, ah), middle(depth, bl, bh), al == bl
        sides = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1)]
        other = ~own
        sides.append(tuple(x[other] for x in (am, ah, bl, bm, err + 1)))
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*sides, strict=True))
        live = (ah > al) & (bh > bl) & (err <= budget) & ~((al == bl) & (ah - al < 2))
        al, ah, bl, bh, err = (x[live] for x in (al, ah, bl, bh, err))
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            i, j = al[single], bl[single]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            if near.any():
                yield i[near], j[near]
            al, ah, bl, bh, err = (x[~single] for x in (al, ah, bl, bh, err))
        stack.append((depth + 1, al, ah, bl, bh, err))


def _forest(budget: int):
    """Spanning edges of each sub-trie: rows come sorted by group and turned key, chunks end where a group ends."""

    def settle(fp: np.ndarray, key: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
        label = np.arange(len(key))
        for i, j in trie_pairs(key, starts, budget):
            unite(label, i, j)
        hung = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[hung]), pa.array(fp[label[hung]])], ["a", "b"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            fp, key, group = (batch.column(i).to_numpy() for i in range(3))
            held.append((fp, key.view(np.uint64) ^ np.uint64(1 << 63), group))
            size += len(fp)
            if size >= CHUNK:
                fp, key, group = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = np.searchsorted(group, group[-1])
                if cut:
                    yield settle(fp[:cut], key[:cut], group[:cut])
                held, size = [(fp[cut:], key[cut:], group[cut:])], len(fp) - cut
        if size:
            yield settle(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return walk


def near_edges(distinct: DataFrame, budget: int = 3, large: int = LARGE_TRIE) -> DataFrame:
    """Spanning edges ``a, b`` of the graph that links distinct fingerprints (column ``fp``) within ``budget`` bits.

    Needs ``budget`` of 3 or less: four quarters (and four parts of the other 48 bits) then always leave one untouched.
    """
    if not 0 <= budget < QUARTERS:
        raise ValueError("the quarters hold for budgets of 0 to 3")
    step = BITS // QUARTERS
    turn = lambda q: F.shiftleft("fp", q * step).bitwiseOR(F.shiftrightunsigned("fp", BITS - q * step)) if q else F.col("fp")
    turned = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), turn(q).alias("key")) for q in range(QUARTERS)])).alias("t"))
    turned = turned.select("fp", F.col("t.key").alias("key"), (F.shiftrightunsigned("t.key", BITS - step) + F.col("t.q") * (1 << step)).alias("trie"))
    # at most 4 x 65,536 sub-tries exist, so the list of large ones is bounded and may be broadcast
    sizes = turned.groupBy("trie").count().filter(F.col("count") > large).select("trie", F.lit(True).alias("large"))
    turned = turned.join(F.broadcast(sizes), "trie", "left")
    part = (BITS - step) // QUARTERS
    parts = F.array(*[F.lit((r + 1) << part) + F.shiftrightunsigned(F.col("key"), part * (QUARTERS - 1 - r)).bitwiseAND((1 << part) - 1) for r in range(QUARTERS)])
    cut = turned.select("fp", "key", "trie", F.explode(F.when(F.col("large"), parts).otherwise(F.array(F.lit(0).cast("long")))).alias("part"))
    # the sign bit is flipped, so that signed order is the order of the bits
    rows = cut.select("fp", F.col("key").bitwiseXOR(F.lit(-(1 << 63))).alias("key"), F.shiftleft("trie", 16).bitwiseOR(F.col("part")).alias("group"))
    dealt = rows.repartition("group").sortWithinPartitions("group", "key")
    return dealt.mapInArrow(_forest(budget), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp`` and ``component_id``, the smallest id reachable over links.

    Documents link when their fingerprints differ in ``budget`` bits at most. Null and blank texts have fingerprint 0 and
    link like any other. Repeated rows each come back. A null id is no smallest id, unless its whole component has none.
    An empty table gives an empty result.
    """
    fps = cut_lineage(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    parts = connected_components(near_edges(classes.select("fp"), budget))
    rooted = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut_lineage(rooted.join(smallest, "root").select("fp", "component_id"), "components")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id, all columns unchanged.

    Repeats of that row (same id and fingerprint) count as one document, of which any copy stays. Where no row of a
    component has an id, one of its rows stays.
    """
    found = near_duplicates(docs, id_col, text_col, width, budget)
    chosen = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.min("fp").alias("fp"))
    ids = cut_lineage(chosen, "kept")
    names = docs.columns
    held = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("id", F.col(f"c{place(names, id_col)}"))
    known = held.filter("id is not null")  # both joins below read one shuffle of it
    once = known.join(ids.filter("copies = 1 and doc_id is not null").select(F.col("doc_id").alias("id")), "id").drop("id")
    again = known.join(ids.filter("copies > 1 and doc_id is not null").select(F.col("doc_id").alias("id"), "fp"), "id")
    nameless = _with_fingerprint(held.filter("id is null"), f"c{place(names, text_col)}", width)
    nameless = nameless.join(ids.filter("doc_id is null").select("fp"), nameless.own_fp == F.col("fp"), "left_semi").withColumnRenamed("own_fp", "fp")
    same = _with_fingerprint(again, f"c{place(names, text_col)}", width).filter("fp = own_fp").drop("own_fp")
    firsts = same.unionByName(nameless).groupBy("fp", "id").agg(*[F.first(f"c{i}").alias(f"c{i}") for i in range(len(names))]).drop("fp", "id")
    return once.unionByName(firsts).toDF(*names)


def _with_fingerprint(df: DataFrame, text: str, width: int) -> DataFrame:
    """Add ``own_fp``, the fingerprint of column ``text``."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("own_fp", T.LongType())])

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            fp = np.array([fingerprint(t, width) for t in raw(part, text)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp)], [*part.schema.names, "own_fp"])

    return df.mapInArrow(hash_rows, schema)
