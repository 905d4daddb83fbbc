"""Benchmark items in documents within an edit budget: pigeonhole pieces, then bit-parallel edit distance.

An item of ``m`` characters may differ in ``b = floor(rate * m)`` edits. It is split into ``b + 1`` pieces: any text within
the budget holds one of them unchanged. All pieces of a block of items are found in one pass over a document; where a piece
is hit, the text around the place that the item would have is searched with Myers' bit-parallel distance. Documents are read
once for each block of items, never shuffled; a block has a bounded size, so what is broadcast is bounded too.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from touchline.llm.rows import pick, place, slices

RATE = 0.05
#: Items shorter than this (normalised characters) must stand unchanged, as whole words: an edit would make other words of them.
SHORT_CHARS = 30
#: Characters of items in a block; pieces of a block are held in memory by each task.
BLOCK_CHARS = 1 << 20


def normalised(text: str) -> str:
    """Lower case, white space runs as one blank."""
    return " ".join(text.lower().split())


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distances(pattern: str, bits: dict[str, int], text: str, anchored: bool = False) -> Iterator[int]:
    """Edit distance of ``pattern`` to the best substring that ends at each place of ``text`` (Myers).

    ``anchored``: to the prefix that ends there.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, carry = full, 0, m, 1 if anchored else 0
    for c in text:
        eq = bits.get(c, 0)
        x = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(h | plus))
        down = plus & h
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | carry) & full
        down = (down << 1) & full
        plus = down | (full & ~(x | up))
        minus = up & x
        yield score


def _whole_words(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit goes on beyond either end of a place."""
    left = start and text[start - 1].isalnum() and text[start].isalnum()
    return not (left or (end < len(text) and text[end].isalnum() and text[end - 1].isalnum()))


class Items:
    """The pieces of one block of items, ready to be searched for."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items, self.forward, self.back = items, {}, {}
        self.budget = [int(rate * len(p)) if len(p) >= SHORT_CHARS else 0 for _, p in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (_, p) in enumerate(items):
            parts = self.budget[i] + 1
            cuts = [j * len(p) // parts for j in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(p[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def _best(self, i: int, text: str, low: int, high: int) -> tuple[int, int, int] | None:
        """``distance, start, end`` of the item's best place that ends in a stretch of text, the leftmost of equals."""
        pattern, budget = self.items[i][1], self.budget[i]
        at = text.find(pattern, low, high)
        while at >= 0:
            if len(pattern) >= SHORT_CHARS or _whole_words(text, at, at + len(pattern)):
                return 0, at, at + len(pattern)
            at = text.find(pattern, at + 1, high)
        if budget == 0:
            return None
        if i not in self.forward:
            self.forward[i] = masks(pattern)
        best, end = budget + 1, -1
        for j, d in enumerate(distances(pattern, self.forward[i], text[low:high])):
            if d < best:
                best, end = d, low + j + 1
        if best > budget:
            return None
        turned = pattern[::-1]
        if i not in self.back:
            self.back[i] = masks(turned)
        tail = text[max(0, end - len(pattern) - budget):end][::-1]
        start = next(end - j - 1 for j, d in enumerate(distances(turned, self.back[i], tail, anchored=True)) if d == best)
        return best, start, end

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """``item id, distance, start, end`` of the best place of each item that is within its budget."""
        if not len(self.automaton):
            return []
        hits: dict[int, list[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for i, offset in places:
                hits.setdefault(i, []).append(end + 1 - size - offset)
        out = []
        for i, places in hits.items():
            m, budget, best = len(self.items[i][1]), self.budget[i], None
            stretches: list[list[int]] = []
            for at in sorted(set(places)):
                low, high = max(0, at - budget), min(len(text), at + m + budget)
                if stretches and low <= stretches[-1][1] - m:
                    stretches[-1][1] = max(stretches[-1][1], high)
                else:
                    stretches.append([low, high])
            for low, high in stretches:
                found = self._best(i, text, low, high)
                if found and (best is None or found < best):
                    best = found
            if best:
                out.append((self.items[i][0], *best))
        return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """Normalised items by blocks of about ``block_chars`` characters, dealt by hash; equal rows once, blank items left out."""
    items = pick(benchmark, item_id=id_col, text=text_col).filter("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // block_chars)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(count, 1))))
    for b in range(count):
        rows = [(r.item_id, normalised(r.text)) for r in dealt.filter(F.col("block") == b).orderBy("item_id", "text").collect()]
        rows = [r for r in rows if r[1]]
        if rows:
            yield rows


_READY: dict[int, Items] = {}


def _ready(shared, rate: float) -> Items:
    """The automaton of a broadcast block, made once in each Python worker."""
    key = (id(shared.value), rate)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Items(shared.value, rate)
    return _READY[key]


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document row and item found in it: ``doc_id, item_id, distance, start, end``.

    Places count in the normalised text, ends exclusive; of several places of one item the nearest, then leftmost. Null and
    empty texts hold nothing, null and blank items are not searched for, short ones only as whole words, a null id stays null. Repeated document rows each
    come back; repeated item rows count once. Without documents or items the result is empty.
    """
    source = pick(docs, doc_id=id_col, text=text_col)
    doc_kind = source.schema["doc_id"].dataType.simpleString()
    item_kind = pick(benchmark, item_id=item_col).schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, distance long, start long, end long"
    arrow_item = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]
    spark, out = docs.sparkSession, None
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _ready(shared, rate)
            for part in slices(batches, "text"):
                ids, found = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    rows = items.find(normalised(text)) if text else []
                    ids += [i] * len(rows)
                    found += rows
                columns = list(zip(*found, strict=True)) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ids, pa.int64())), pa.array(columns[0], arrow_item), *(pa.array(c, pa.int64()) for c in columns[1:])],
                                                 ["doc_id", "item_id", "distance", "start", "end"])

        found = source.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item within its budget; all columns and other rows unchanged.

    Null and empty texts stay, repeated rows stay or go alike, an empty table or benchmark takes nothing away.
    """
    names = docs.columns
    text = place(names, text_col)
    out = docs.toDF(*[f"c{i}" for i in range(len(names))])
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _ready(shared, rate)
            for part in slices(batches, f"c{text}"):
                clean = [not (t and items.find(normalised(t))) for t in part.column(text).to_pylist()]
                yield part.filter(pa.array(clean))

        out = out.mapInArrow(keep, T.StructType(out.schema.fields))
    return out.toDF(*names)
