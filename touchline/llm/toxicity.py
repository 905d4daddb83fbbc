"""Toxic passages as maximum-scoring segments of word log-odds.

Each word, and each stem (its first letters), has the log-odds of standing in toxic rather than clean documents, smoothed by
a Dirichlet prior in proportion to how many documents of the whole corpus hold it, and drawn towards zero by its standard
error. A word scores as the most telling of itself and its stems, so unseen forms of a stem are known too; its k-th use in a text
scores a k-th of that. All others cost a little. One linear scan finds all maximal segments of a text. Best segments of
clean texts follow an extreme-value law in the text's length; its two parameters, fitted on the training sample, say how
many segments of a score chance would make, so the best one and the r best ones together each have a significance. A
logistic curve on the sample turns these into a probability.

Labels are learned from a bounded sample; corpus counts cover all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from touchline.llm.rows import labelled_sample, pick, slices
from touchline.session import cut_lineage

#: Most labelled documents learned from, and the least number of them that a word must stand in to get a score of its own.
SAMPLE = 20_000
LEAST_DOCS = 3
#: Passes that thin out near copies in the sample, and words of a shingle.
THINNINGS = 4
SHINGLE = 5
PRIOR = 500.0
#: Lower values find a little more (see the tests) but score so many words that the CPU time is several times as long.
ERRORS = 2.5
DRIFT = 0.1
SIGNIFICANT = 0.01
THRESHOLD = 0.7
#: Beyond this significance more of it means nothing to the curve.
CLEAR = 50.0
FLUSH_WORDS = 200_000
WORD = re.compile(r"\w+")
#: Letters of the stems of a longer word; a stem is written with this mark, which no word holds.
STEMS = (4, 5, 6)
STEM_MARK = "^"
STEM_TYPES = 3
#: Words whose scores a task remembers.
MEMO = 300_000


def lowered(text: str) -> str:
    """Lower case, place by place: a letter whose lower case is longer stays, so that places hold in the text itself."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(lowered(text)) if text else []


def forms(token: str) -> list[str]:
    """A word and its stems."""
    return [token, *(STEM_MARK + token[:n] for n in STEMS if len(token) > n)]


class Memo(dict):
    """Remembers what ``make`` gives for a key; starts anew when it holds very many keys."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > MEMO:
            self.clear()


def all_forms(text: str | None) -> set[str]:
    out: set[str] = set()
    for w in set(words(text)):
        out.update(forms(w))
    return out


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``start, stop, score``, in order (Ruzzo and Tompa, one pass)."""
    total, kept = 0.0, []  # kept: start, stop, total before, total after
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        here = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= here[2]:
                j -= 1
            if j < 0 or kept[j][3] >= here[3]:
                kept.append(here)
                break
            here = [kept[j][0], here[1], kept[j][2], here[3]]
            del kept[j:]
    return [(a, b, after - before) for a, b, before, after in kept]


def sparse_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """The same where every word not in ``hits`` (position, score) scores ``-drift``."""
    if not any(s > 0 for _, s in hits):
        return []
    scores, at, last = [], [], -1
    for i, s in hits:
        if i > last + 1:
            scores.append(-drift * (i - last - 1))
            at.append(last + 1)
        scores.append(s)
        at.append(i)
        last = i
    return [(at[a], at[b - 1] + 1, x) for a, b, x in segments(scores)]


@dataclass(frozen=True)
class Model:
    """Scores of words, the extreme-value parameters ``rate`` and ``size``, and the logistic curve."""

    weights: dict[str, float]
    drift: float
    rate: float
    size: float
    curve: tuple[float, float, float]
    known: Memo | None = field(default=None, repr=False, compare=False)

    def word_score(self, token: str) -> float | None:
        """The score that is farthest from nothing among a word and its stems; none where none has a score."""
        return max((x for x in map(self.weights.get, forms(token)) if x is not None), key=abs, default=None)

    def hits(self, tokens: list[str]) -> list[tuple[int, float]]:
        if self.known is None:
            object.__setattr__(self, "known", Memo(self.word_score))
        self.known.trim()
        uses: Counter = Counter()
        out = []
        for i, s in enumerate(map(self.known.__getitem__, tokens)):
            if s is not None:
                uses[tokens[i]] += 1
                out.append((i, s / uses[tokens[i]] if s > 0 else s))
        return out

    def bits(self, score: float, n: int) -> float:
        """Normalised score of a segment in a text of ``n`` words: minus the log of its expected number by chance."""
        return self.rate * score - max(math.log(self.size * max(n, 1)), 0.0)

    def chance(self, score: float, n: int) -> float:
        return -math.expm1(-math.exp(min(-self.bits(score, n), 50.0)))

    def read(self, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Probability of a text, and its significant passages ``first word, end word, score, chance``."""
        tokens = words(text)
        found = sparse_segments(self.hits(tokens), self.drift)
        marked = [(a, b, s, self.chance(s, len(tokens))) for a, b, s in found]
        marked = [m for m in marked if m[3] <= SIGNIFICANT]
        return self.probability([s for _, _, s in found], len(tokens)), marked

    def evidence(self, scores: list[float], n: int) -> tuple[float, float]:
        """Of all segments of a text: the normalised score of the best, and the significance of the most telling ``r`` best.

        Chance makes a Poisson number of segments as good as the r-th, with mean ``exp(-bits)``; the tail is bounded after
        Chernoff and pays for the choice of ``r``.
        """
        best, most = self.bits(max(scores, default=0.0), n), 0.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            b = self.bits(s, n)
            if math.log(r) > -b:
                most = max(most, r * (math.log(r) + b - 1 - math.log(2)) + math.exp(-b))
        return best, most

    def probability(self, scores: list[float], n: int) -> float:
        best, most = self.evidence(scores, n)
        z = self.curve[0] + self.curve[1] * min(best, CLEAR) + self.curve[2] * min(most, CLEAR)
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def log_odds(toxic: np.ndarray, clean: np.ndarray, corpus: np.ndarray, docs: tuple[int, int, int]) -> np.ndarray:
    """Word scores from document counts in toxic, clean and all documents; ``docs`` are the three numbers of documents.

    Log-odds with a Dirichlet prior of weight ``PRIOR`` documents, less ``ERRORS`` standard errors towards zero.
    """
    alpha = PRIOR * np.maximum(corpus, 1) / max(docs[2], 1)
    odds = lambda y, n: np.log((y + alpha) / np.maximum(n + PRIOR - y - alpha, 0.5))
    delta = odds(toxic, docs[0]) - odds(clean, docs[1])
    error = np.sqrt(1 / (toxic + alpha) + 1 / (clean + alpha))
    return np.sign(delta) * np.maximum(np.abs(delta) - ERRORS * error, 0.0)


def _count_words(pairs: DataFrame) -> DataFrame:
    """Documents that hold each word, by label: ``word, toxic, clean``; counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(all_ := held[0].keys() | held[1].keys()), pa.string()), pa.array([held[1][w] for w in all_], pa.int64()), pa.array([held[0][w] for w in all_], pa.int64())], ["word", "toxic", "clean"])
        for part in slices(batches, "text"):
            for label, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                held[int(label)].update(all_forms(text))
            if len(held[0]) + len(held[1]) > FLUSH_WORDS:
                yield out()
                held = (Counter(), Counter())
        yield out()

    return pairs.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _least_shingles(text: str | None) -> list[int]:
    """Least hash of the word shingles of a text under each of several orders."""
    tokens = words(text)
    h = np.array([xxhash.xxh64_intdigest(w) for w in tokens] or [0], np.uint64)
    width = min(SHINGLE, len(h))
    mixed = h[:len(h) - width + 1].copy()
    for j in range(1, width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - width + 1 + j]
    out = []
    for i in range(THINNINGS):
        x = (mixed ^ np.uint64(0xA24BAED4963EE407 * (i + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out.append(int((x ^ (x >> np.uint64(32))).min().view(np.int64)))
    return out


def _thinned(pairs: DataFrame) -> DataFrame:
    """``label, text`` with near copies thinned out: of texts of one label that agree in a least shingle one stays, in
    several passes, so that a copied document does not count as many."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = [_least_shingles(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(THINNINGS))], ["doc_id", "label", *(f"m{i}" for i in range(THINNINGS))])

    kind = pairs.schema["doc_id"].dataType.simpleString()
    left = pairs.mapInArrow(sketch, f"doc_id {kind}, label int, " + ", ".join(f"m{i} long" for i in range(THINNINGS)))
    for i in range(THINNINGS):
        left = left.groupBy(f"m{i}", "label").agg(F.min(F.struct("doc_id", *[f"m{j}" for j in range(i + 1, THINNINGS)])).alias("x")).select("label", "x.*")
    return cut_lineage(pairs.join(left.select("doc_id"), "doc_id", "left_semi").select("label", "text"), "sample")


def _corpus_counts(docs: DataFrame, vocabulary) -> np.ndarray:
    """In how many of all documents each word of the broadcast vocabulary stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(vocabulary.value)}
        places = Memo(lambda w: tuple(place[f] for f in forms(w) if f in place))
        total = np.zeros(len(place), np.int64)
        for part in slices(batches, "text"):
            places.trim()
            for text in part.column(0).to_pylist():
                found = {i for some in map(places.__getitem__, set(words(text))) if some for i in some}
                if found:
                    total[list(found)] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "n"])

    counts = docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary.value), np.int64)
    for r in counts.collect():  # at most one row for each word of the vocabulary
        out[r.place] = r.n
    return out


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic curve on two inputs (Newton steps, halved until the loss falls); slopes below zero are left out."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    a, penalty = np.column_stack([np.ones(len(x)), x / CLEAR]), np.array([1e-6, 0.05, 0.05])
    w, used = np.array([math.log(share / (1 - share)), 0.0, 0.0]), np.ones(3, bool)
    loss = lambda w: float(np.logaddexp(0, -(2 * y - 1) * (a @ w)).sum() + (penalty * w * w).sum() / 2)
    while 0 < y.sum() < len(y):
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
            hessian = (a.T * (p * (1 - p))) @ a + np.diag(penalty)
            step = np.zeros(3)
            step[used] = np.linalg.solve(hessian[np.ix_(used, used)], (a.T @ (y - p) - penalty * w)[used])
            size = 1.0
            while size > 1e-9 and loss(w + size * step) > loss(w):
                size /= 2
            w = w + size * step
            if size * np.abs(step).max() < 1e-7:
                break
        wrong = used & (np.arange(3) > 0) & (w < 0)
        if not wrong.any():
            break
        used, w = used & ~wrong, np.where(wrong, 0.0, w)
    return float(w[0]), float(w[1] / CLEAR), float(w[2] / CLEAR)


def extreme_value(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """``rate`` and ``size`` of the law ``P(best > x) = 1 - exp(-size * n * exp(-rate * x))``, by maximum likelihood."""
    if not len(best):
        return 1.0, 1.0
    sizes = lambda r: len(best) / float((n * np.exp(-r * best)).sum())
    rates = np.geomspace(0.25, 8.0, 400)
    likelihood = [math.log(r) + math.log(sizes(r)) - r * float(best.mean()) for r in rates]
    rate = float(rates[int(np.argmax(likelihood))])
    return rate, sizes(rate)


def train(docs: DataFrame, labels: DataFrame, where=None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from at most ``sample`` labelled documents (``where``: a condition on their ``doc_id``).

    The words and stems scored are those of at least ``LEAST_DOCS`` sampled documents, so their number is bounded by the sample's
    size; they and their counts come to the driver and are broadcast. A model without toxic or without clean documents
    scores no words.
    """
    source = pick(docs, doc_id=id_col, text=text_col)
    chosen = labelled_sample(labels, label_col, sample, where=where)
    pairs = source.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct((F.col("label") > 0).cast("int").alias("label"), "text")).alias("x")).select("doc_id", "x.*")
    pairs = _thinned(cut_lineage(pairs, "sample"))  # bounded by the sample
    n = {bool(r.label): r["count"] for r in pairs.groupBy("label").count().collect()}
    n_toxic, n_clean = n.get(True, 0), n.get(False, 0)
    rows = _count_words(pairs).filter(F.col("toxic") + F.col("clean") >= LEAST_DOCS)
    # forms that cannot be told from even are left out before the corpus is counted
    skew = F.col("toxic") / F.lit(max(n_toxic, 1)) - F.col("clean") / F.lit(max(n_clean, 1))
    noise = F.sqrt((F.col("toxic") + F.col("clean")) * (1.0 / max(n_toxic, 1)) * (1.0 / max(n_clean, 1)))
    rows = rows.filter(F.abs(skew) > (ERRORS - 1) * noise).orderBy("word").collect()
    vocabulary = [r.word for r in rows]
    toxic, clean = np.array([r.toxic for r in rows], float), np.array([r.clean for r in rows], float)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    corpus = _corpus_counts(source, shared)
    weights = log_odds(toxic, clean, corpus, (n_toxic, n_clean, source.count())) if n_toxic and n_clean else np.zeros(len(rows))
    scored = {w: float(x) - DRIFT for w, x in zip(vocabulary, weights.tolist(), strict=True) if x != 0}
    # a stem speaks for its forms only where several of them are toxic themselves
    types = Counter(f for w, x in scored.items() if x > 0 and w[0] != STEM_MARK for f in forms(w)[1:])
    scored = {w: x for w, x in scored.items() if w[0] != STEM_MARK or x < 0 or types[w] >= STEM_TYPES}
    draft = docs.sparkSession.sparkContext.broadcast(Model(scored, DRIFT, 1.0, 1.0, (0.0, 1.0, 0.0)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = draft.value
        for part in slices(batches, "text"):
            out = []
            for text in part.column(1).to_pylist():
                tokens = words(text)
                found = [s for _, _, s in sparse_segments(model.hits(tokens), model.drift)]
                out.append((len(tokens), sorted(found, reverse=True)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.float64()))], ["label", "n", "s"])

    seen = pairs.mapInArrow(best, "label int, n long, s array<double>").collect()  # one row for each sampled document
    seen.sort(key=lambda r: (r.label, r.n, r.s))
    clean_rows = [r for r in seen if not r.label]
    rate, size = extreme_value(np.array([max(r.s, default=0.0) for r in clean_rows]), np.array([max(r.n, 1) for r in clean_rows], float))
    model = Model(scored, DRIFT, rate, size, (0.0, 1.0, 0.0))
    x = np.array([(min(best, CLEAR), min(most, CLEAR)) for best, most in (model.evidence(r.s, r.n) for r in seen)]).reshape(-1, 2)
    return Model(scored, DRIFT, rate, size, _curve(x, np.array([r.label for r in seen], float)))


PASSAGES = "array<struct<start:long,end:long,score:double,chance:double>>"
_ARROW_PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, score, predicted, passages`` (code points, ends exclusive).

    Null and empty texts have no passages and the score of a text without any; repeated rows each come back; a null id
    stays null; an empty table gives an empty result.
    """
    source = pick(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, "text"):
            scores, passages = [], []
            for text in part.column(1).to_pylist():
                p, marked = model.read(text)
                places = [m.span() for m in WORD.finditer(lowered(text))] if marked else []
                scores.append(p)
                passages.append([{"start": places[a][0], "end": places[b - 1][1], "score": s, "chance": c} for a, b, s, c in marked])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array([int(p >= threshold) for p in scores], pa.int32()), pa.array(passages, _ARROW_PASSAGES)],
                                             ["doc_id", "score", "predicted", "passages"])

    return source.mapInArrow(read, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double, predicted int, passages {PASSAGES}")


def held_out(id_column: str = "doc_id"):
    """Whether a document's label is kept back from learning: the checksum of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(3)) == 1, F.lit(False))
