"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one class. In each pass every class gets a key of concatenated random hashes (after a random rotation, the
axis nearest to the vector, several times over); the classes are sorted by it, and each is compared with a bounded window of
neighbours. Runs of equal keys longer than the window are sorted again by further hashes. Tasks hold ranges of the order; the
ends of neighbouring ranges are compared apart. Verified pairs of all passes are united.

In each pass a class is tried with random partners at the threshold: whether their keys fall into its window tells how
likely its links were found. A class takes part in passes until that is likely enough, so classes in dense regions take part
in more, with wider windows. At last, links are counted inside each component by blocks: all links of a vector lie in its
component, so the counts are exact for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from touchline.llm.components import connected_components, unite
from touchline.llm.rows import pick
from touchline.session import cut_lineage

COSINE = 0.95
#: Neighbours in the order that a class is compared with, at least.
WINDOW = 256
#: Random partners at the threshold that a class must have met, on average, before it needs no further pass.
NEED = 4.5
HASHES = 8
#: Passes over the classes at a time; after each such round the window of those left is doubled.
ROUND = 6
#: Random partners of a class in each pass.
TRIALS = 2
SEED = 20_01
BLOCK = 1024
CHUNK = 8192
#: Rows of a range of the order that a task holds, and windows in it at least.
RANGE_ROWS = 1 << 16
RANGE_WINDOWS = 8


def _matrix(column: pa.Array, size: int, kind: str) -> np.ndarray:
    """Unit rows in double precision from the raw values of a binary column.

    Values are scaled by the largest one first, so that squares neither overflow nor vanish.
    """
    x = np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, initial=0.0)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _usable(kind: str):
    """``vec_id, size, vec``: the raw values of a vector, or null for vectors that link with nothing."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for v in batch.column(1).to_pylist():
                x = np.array(v, dtype=kind) if v is not None and len(v) > 0 and None not in v else None
                ok = x is not None and bool(np.isfinite(x).all()) and bool(x.any())
                out.append((x + np.array(0, kind)).tobytes() if ok else None)  # adding zero gives both zeros one sign
                sizes.append(len(x) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "size", "vec"])

    return walk


@lru_cache(maxsize=4)
def rotations(size: int, pass_: int, seed: int = SEED) -> np.ndarray:
    """Random rotation-like matrices of one pass, ``HASHES`` of them side by side."""
    return np.random.default_rng([seed, size, pass_]).standard_normal((size, HASHES * size)).astype(np.float32)


def keys(vectors: np.ndarray, pass_: int) -> np.ndarray:
    """Concatenated hashes of each row as one byte string: axis and sign of the largest rotated coordinate, two bytes each."""
    n, size = vectors.shape
    out = np.empty((n, HASHES), ">u2")
    for i in range(0, n, step := max(1, (4 << 20) // (HASHES * size))):
        turned = (vectors[i:i + step].astype(np.float32) @ rotations(size, pass_)).reshape(-1, HASHES, size)
        axis = np.abs(turned).argmax(axis=2)
        sign = np.take_along_axis(turned, axis[:, :, None], axis=2)[:, :, 0] < 0
        out[i:i + step] = axis * 2 + sign + 1  # never zero, so that byte strings keep their length
    return np.ascontiguousarray(out).view(f"S{2 * HASHES}").ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _normal(cls: np.ndarray, size: int, stream: int) -> np.ndarray:
    """Normal numbers, a row for each class: hashes of class, stream and place."""
    base = _mixed(cls.astype(np.int64).view(np.uint64) + np.uint64(stream * 0x9E3779B97F4A7C15 % 2**64))
    places = np.arange(2 * size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 % 2**64)
    u = ((_mixed(base[:, None] + places) >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52
    return np.sqrt(-2 * np.log(u[:, :size])) * np.cos(2 * math.pi * u[:, size:])


def partners(x: np.ndarray, cls: np.ndarray, stream: int, cosine: float) -> np.ndarray:
    """A random unit vector for each row of ``x``, at ``cosine`` to it."""
    y = _normal(cls, x.shape[1], stream)
    y -= (x * y).sum(axis=1)[:, None] * x
    norm = np.linalg.norm(y, axis=1)[:, None]
    return cosine * x + math.sqrt(1 - cosine * cosine) * y / np.where(norm > 0, norm, 1)


def order_of(key: np.ndarray, x: np.ndarray, pass_: int, window: int) -> np.ndarray:
    """The order of rows sorted by ``key``: runs of equal keys beyond the window are sorted again by further hashes."""
    order = np.arange(len(key))
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else order
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > window:
            order[a:b] = a + np.argsort(keys(x[a:b], pass_ + 1_000_000), kind="stable")
    return order


def neighbours(x: np.ndarray, window: int, cosine: float) -> np.ndarray:
    """Labels of rows in order: each is compared with the ``window`` rows behind it and more, by blocks."""
    label = np.arange(len(x))
    for i in range(0, len(x), window):
        left, right = np.nonzero(x[i:i + window] @ x[i:i + 2 * window].T >= cosine)
        later = right > left
        unite(label, i + left[later], i + right[later])
    return label


def met(key: np.ndarray, x: np.ndarray, cls: np.ndarray, pass_: int, window: int, cosine: float) -> np.ndarray:
    """Share of a class's random partners at the threshold whose keys would stand within the window of it."""
    found, at = np.zeros(len(key)), np.arange(len(key))
    for t in range(TRIALS):
        other = keys(partners(x, cls, TRIALS * pass_ + t, cosine), pass_)
        # a partner with the same key stands somewhere in that run, at a random place
        low, high = np.searchsorted(key, other, "left"), np.searchsorted(key, other, "right")
        near = (np.minimum(at + window, np.maximum(high, low + 1)) - np.maximum(at - window, low)).clip(0)
        found += near / np.maximum(high - low, 1)
    return found.clip(0, TRIALS) / TRIALS


_FOUND = "what int, pass int, seam long, side int, a long, b long, vec binary, met double"
_ARROW_FOUND = pa.schema([("what", pa.int32()), ("pass", pa.int32()), ("seam", pa.int64()), ("side", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("vec", pa.binary()), ("met", pa.float64())])
EDGE, SEAM, MET = 0, 1, 2


def _records(what: int, n: int, **columns) -> pa.RecordBatch:
    filled = {"what": pa.array(np.full(n, what, np.int32)), **{k: v if isinstance(v, pa.Array) else pa.array(np.broadcast_to(v, n)) for k, v in columns.items()}}
    return pa.RecordBatch.from_arrays([(filled[f.name] if f.name in filled else pa.nulls(n, f.type)).cast(f.type) for f in _ARROW_FOUND], schema=_ARROW_FOUND)


def _ranges(size: int, kind: str, window: int, cosine: float):
    """A range of the order: forest edges of the links in its windows, its first and last rows, and how the trials went."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]  # a range holds a bounded number of rows
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        passes, part = table.column("pass").to_numpy(), TaskContext.get().partitionId()
        cuts = np.flatnonzero(np.r_[True, passes[1:] != passes[:-1], True])
        for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            piece, p = table.slice(start, stop - start), int(passes[start])
            cls, vec = piece.column("cls").to_numpy(), piece.column("vec").combine_chunks()
            x = _matrix(vec, size, kind)
            key = np.array(piece.column("key").to_pylist(), f"S{2 * HASHES}")
            share = met(key, x, cls, p, window, cosine)
            order = order_of(key, x, p, window)
            label = neighbours(x[order], window, cosine)
            hung = np.flatnonzero(label != np.arange(len(cls)))
            yield _records(EDGE, len(hung), a=cls[order][hung], b=cls[order][label[hung]])
            yield _records(MET, len(cls), a=cls, met=share)
            for side, seam, rows in ((1, part - 1, np.arange(min(window, len(cls)))), (0, part, np.arange(max(0, len(cls) - window), len(cls)))):
                yield _records(SEAM, len(rows), **{"pass": np.int32(p), "seam": np.int64(seam), "side": np.int32(side), "a": cls[rows], "vec": vec.take(pa.array(rows))})

    return walk


def _seams(size: int, kind: str, cosine: float):
    """Forest edges between the last rows of one range and the first of the next."""

    def product(group: pa.Table) -> pa.Table:
        cls, side = group.column("a").to_numpy(), group.column("side").to_numpy()
        x = _matrix(group.column("vec").combine_chunks(), size, kind)
        before, after = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        left, right = np.nonzero(x[before] @ x[after].T >= cosine)
        label = unite(np.arange(len(cls)), before[left], after[right])
        hung = np.flatnonzero(label != np.arange(len(cls)))
        return pa.table({"a": cls[hung], "b": cls[label[hung]]})

    return product


def _round(classes: DataFrame, n: int, size: int, kind: str, passes: range, window: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Edges found by ``passes`` over ``classes`` (``cls, vec``), and ``cls, met``: the sum of what the trials met."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, CHUNK) for i in range(0, batch.num_rows, CHUNK)):
                x = _matrix(part.column(1), size, kind)
                found = np.stack([keys(x, p) for p in passes], axis=1)
                flat = pa.array(found.ravel().tolist(), pa.binary())
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(passes))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, flat)], ["cls", "vec", "keys"])

    held = cut_lineage(classes.select("cls", "vec").mapInArrow(keyed, "cls long, vec binary, keys array<binary>"), "keys")
    rows = held.select(F.posexplode("keys").alias("at", "key"), "cls", "vec").select((F.col("at") + passes.start).cast("int").alias("pass"), "key", F.xxhash64("cls", "at").alias("tie"), "cls", "vec")
    # equal keys are told apart by a hash, so that no run is too long for a range
    parts = max(1, n * len(passes) // max(RANGE_ROWS, RANGE_WINDOWS * window))
    order = ["pass", "key", "tie"]
    found = cut_lineage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_ranges(size, kind, window, cosine), _FOUND), "pass")
    between = found.filter(f"what = {SEAM}").groupBy("pass", "seam").applyInArrow(_seams(size, kind, cosine), "a long, b long")
    edges = cut_lineage(found.filter(f"what = {EDGE}").select("a", "b").unionByName(between), "edges")
    return edges, found.filter(f"what = {MET}").select(F.col("a").alias("cls"), "met").groupBy("cls").agg(F.sum("met").alias("met"))


def _edges(classes: DataFrame, n: int, size: int, kind: str, passes: int | None, window: int, cosine: float) -> DataFrame:
    """Edges of passes over ``classes`` until each has met ``NEED`` random partners at the threshold, or of ``passes``.

    A class that met its partners in ``t`` passes on average has missed a link of its own with a chance of about ``exp(-t)``.
    Rounds go on until no class is left; windows grow from round to round, so the last ones are compared with all that are left.
    """
    todo, left, edges, done = classes.select("cls", "vec"), n, None, 0
    so_far = None
    while left:
        now = min(ROUND, passes - done) if passes else ROUND
        found, seen = _round(todo, left, size, kind, range(done, done + now), window, cosine)
        edges = found if edges is None else edges.unionByName(found)
        done, window = done + now, 2 * window
        if passes and done >= passes:
            break
        so_far = seen if so_far is None else seen.unionByName(so_far).groupBy("cls").agg(F.sum("met").alias("met"))
        so_far = cut_lineage(so_far.filter(F.col("met") < NEED), "met")
        todo = cut_lineage(todo.join(so_far.select("cls"), "cls", "left_semi"), "left")
        left = todo.count()
    return edges


def _counts(members: DataFrame, size: int, kind: str, cosine: float) -> DataFrame:
    """``cls, n_links`` for classes in components of more than one: vectors of other classes with the cosine or more.

    A component is cut into blocks of about ``BLOCK`` classes by hash; each pair of blocks is one task's product. Only
    sums per class leave a task.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("long"))
    dealt = members.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
    sides = dealt.select("component", "cls", "vec", "copies", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    pairs = sides.select("component", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "cls", "vec", "copies")

    def product(group: pa.Table) -> pa.Table:
        low = group.column("low")[0].as_py()
        high = group.column("high")[0].as_py()
        cls, copies, part = group.column("cls").to_numpy(), group.column("copies").to_numpy(), group.column("part").to_numpy()
        x = _matrix(group.column("vec"), size, kind)
        a = np.flatnonzero(part == low)
        b = a if low == high else np.flatnonzero(part == high)
        links = np.zeros(len(cls), np.int64)
        for i in range(0, len(a), BLOCK):
            rows = a[i:i + BLOCK]
            for j in range(0, len(b), BLOCK):
                cols = b[j:j + BLOCK]
                near = x[rows] @ x[cols].T >= cosine
                if low == high:
                    near &= rows[:, None] != cols[None, :]
                links[rows] += near @ copies[cols]
                if low != high:
                    links[cols] += copies[rows] @ near
        return pa.table({"cls": cls, "n": links})

    return pairs.groupBy("component", "low", "high").applyInArrow(product, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n_links"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, window: int = WINDOW, passes: int | None = None) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors link when their cosine in double precision is ``cosine`` or more; equal ones always do. Null, empty and zero
    vectors, and those with null or non-finite values, link with nothing; vectors of different lengths neither. Repeated
    rows are vectors of their own. A null id is no smallest id unless its component has no other. An empty table gives an
    empty result.
    """
    source = pick(vectors, vec_id=id_col, embedding=vec_col)
    kind, array = ("<f4", "array<float>") if source.schema["embedding"].dataType.elementType.simpleString() == "float" else ("<f8", "array<double>")
    usable = source.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(array).alias("embedding")).mapInArrow(_usable(kind), "vec_id long, size int, vec binary")
    unit = cut_lineage(usable, "vectors")
    made = unit.filter("vec is not null").groupBy("size", "vec").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    # a class is numbered by the hash of its vector; vectors with one hash are told apart by their order
    made = made.withColumn("hash", F.xxhash64("size", "vec"))
    made = made.withColumn("cls", F.col("hash").bitwiseXOR(F.row_number().over(Window.partitionBy("hash").orderBy("vec")).cast("long") - 1))
    classes = cut_lineage(made.drop("hash"), "classes")
    shape = classes.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cls").alias("d")).collect()  # one row per vector length
    if any(r.n != r.d for r in shape):
        raise ArithmeticError("two vectors share a class number; repeat with another hash")
    named = unit.filter("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for r in sorted(shape, key=lambda r: r["size"]):
        own = classes.filter(F.col("size") == r["size"])
        edges = _edges(own, r.n, r["size"], kind, passes, window, cosine)
        parts = connected_components(edges).withColumnRenamed("node", "cls")
        members = cut_lineage(own.join(parts, "cls").select("cls", "vec", "first_id", "copies", "component"), "members")
        smallest = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
        linked = members.join(_counts(members, r["size"], kind, cosine), "cls").join(smallest, "component").select("cls", "n_links", "component_id")
        result = own.join(linked, "cls", "left").select("vec", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
        named = named.unionByName(unit.filter(F.col("size") == r["size"]).join(cut_lineage(result, "links"), "vec").select("vec_id", "n_links", "component_id"))
    return named.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
