"""Document quality by hierarchical empirical Bayes.

A logistic classifier on the shape of a text gives each document a probability of being good. Documents of one path of a
host tend to be alike, so the probabilities are added up by path and by host, shrunk (path towards host, host towards the
whole corpus) with strengths fitted to the spread between groups, and the posterior of the document's place shifts its
own odds. A document's own evidence is taken out of its place first, so that it does not count twice.

Only the classifier is fitted on a bounded sample of labels; every count behind the places covers all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F, types as T

from touchline.llm.rows import labelled_sample, pick, place, raw, slices
from touchline.session import cut_lineage

#: Most labelled documents the classifier is fitted on.
SAMPLE = 20_000
RIDGE = 1.0
THRESHOLD = 0.5
FEATURES = ("bytes", "upper", "digit", "marks", "bangs", "signs", "pipes", "repeated_lines", "repeated_words", "word_length", "line_length", "other_script")
_UPPER, _DIGIT, _SIGNS = bytes(range(65, 91)), b"0123456789", b"#$%&*"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,")
_HIGH = bytes(range(128, 256))


def features(text: bytes | None) -> list[float]:
    """Shape of one text (UTF-8); a null one counts as empty."""
    text = text or b""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    count = max(1, len(words))
    less = lambda chars: (n - len(text.translate(None, chars))) / n
    return [float(np.log1p(n)), less(_UPPER), less(_DIGIT), less(_MARKS), text.count(b"!!") / count, less(_SIGNS), text.count(b" | ") / count,
            1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(words)) / count, float(np.log1p(n / count)), float(np.log1p(n / max(1, len(lines)))), less(_HIGH)]


@dataclass(frozen=True)
class Classifier:
    """Logistic weights on standardised features."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def probability(self, rows: list[list[float]]) -> np.ndarray:
        x = (np.array(rows, float).reshape(-1, len(FEATURES)) - self.mean) / self.scale
        z = np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -30, 30)
        return 1 / (1 + np.exp(-z))


def fit(rows: list[list[float]], labels: list[float], ridge: float = RIDGE) -> Classifier:
    """Ridge logistic regression by Newton steps; without rows or with one class only, the (smoothed) share of good ones."""
    x, y = np.array(rows, float).reshape(-1, len(FEATURES)), np.array(labels, float)
    mean = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES))
    scale = x.std(axis=0) if len(x) else np.ones(len(FEATURES))
    scale = np.where(scale > 1e-12, scale, 1.0)
    share = (y.sum() + 1) / (len(y) + 2)
    w = np.zeros(len(FEATURES) + 1)
    w[0] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
        penalty = np.full(a.shape[1], ridge)
        penalty[0] = 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
    return Classifier(tuple(mean), tuple(scale), tuple(w))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, where=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Classifier:
    """Fit the classifier on at most ``sample`` labelled documents (``where``: a condition on their ``doc_id``)."""
    chosen = labelled_sample(labels, label_col, sample, where=where)
    rows = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.float64()), pa.array([features(t) for t in raw(part, "text")], pa.list_(pa.float64()))], ["doc_id", "label", "f"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    shaped = rows.mapInArrow(shape, f"doc_id {kind}, label double, f array<double>")
    found = shaped.groupBy("doc_id").agg(F.min(F.struct("f", "label")).alias("x")).select("x.*").collect()  # one row per sampled id
    found.sort(key=lambda r: (r.f, r.label))
    return fit([r.f for r in found], [r.label for r in found])


def _scored(docs: DataFrame, model: Classifier, text: str) -> DataFrame:
    """``docs`` with ``p``, the classifier's probability for column ``text``."""
    schema = T.StructType([*docs.schema.fields, T.StructField("p", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            p = model.probability([features(t) for t in raw(part, text)])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*part.schema.names, "p"])

    return docs.mapInArrow(score, schema)


def _strength(groups: DataFrame, share: float) -> float:
    """Pseudo-count of the Beta prior whose spread equals that between groups, by moments.

    The variance of group means is that between groups plus ``share * (1 - share) / n`` within them; few or equal groups
    give a strong prior.
    """
    within = share * (1 - share)
    m = groups.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - share, 2)).alias("ss"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not m.n or m.g < 2 or m.n * m.n <= m.nn:
        return 1e6
    between = max((m.ss - (m.g - 1) * within) / (m.n - m.nn / m.n), 0.0)
    return min(max(within / between - 1, 1.0), 1e6) if between > 0 else 1e6


@dataclass(frozen=True)
class Places:
    """The hierarchical posterior: one row per path with sums of the path and of its host, and three numbers."""

    table: DataFrame
    share: float
    host_strength: float
    path_strength: float


def places(scored: DataFrame) -> Places:
    """Sums by path and host of ``scored`` (``host, path, p``), all documents; combined before the shuffle."""
    paths = cut_lineage(scored.groupBy("host", "path").agg(F.count("p").alias("n"), F.sum("p").alias("s")), "places")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total: Row = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    share = min(max((total.s or 0.0) / total.n, 1e-6), 1 - 1e-6) if total.n else 0.5
    both = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), "host")
    return Places(cut_lineage(both, "places"), share, _strength(hosts, share), _strength(paths, share))


def _host(column: str) -> tuple[F.Column, F.Column]:
    """Host and first part of the path of a source or address; null and empty ones are one place."""
    bare = F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.lower(F.substring_index(bare, "/", 1)), F.regexp_extract(bare, "^[^/]*/([^/?#]*)", 1)


def _judged(docs: DataFrame, model: Classifier, text: str, source: str, section: str | None, threshold: float) -> DataFrame:
    """``docs`` (plain column names) with ``p, host, path, host_rate, path_rate, score, keep``."""
    host, path = _host(source)
    path = F.concat_ws("/", path, F.coalesce(F.col(section).cast("string"), F.lit(""))) if section else path
    add = lambda df: _scored(df, model, text).withColumns({"host": host, "path": path})
    needed = {text, source, section} - {None}
    found = places(add(docs.select(*needed)))
    odds = lambda c: F.ln(c / (1 - c))
    bound = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-9)), F.lit(1e-9))
    place = found.table.select(F.col("host").alias("at_host"), F.col("path").alias("at_path"), F.col("n").alias("path_n"), F.col("s").alias("path_s"), "host_n", "host_s")
    out = add(docs)
    out = out.join(place, (out.host == place.at_host) & (out.path == place.at_path))  # every place is in the table
    p = F.col("p")
    host_rate = (F.col("host_s") - p + found.host_strength * found.share) / (F.col("host_n") - 1 + found.host_strength)
    out = out.withColumn("host_rate", bound(host_rate))
    path_rate = (F.col("path_s") - p + found.path_strength * F.col("host_rate")) / (F.col("path_n") - 1 + found.path_strength)
    out = out.withColumn("path_rate", bound(path_rate))
    z = odds(bound(p)) + odds(F.col("path_rate")) - odds(F.lit(found.share))
    return out.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("keep", F.col("score") >= threshold)


def judge(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", section_col: str | None = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, p, host, path, host_rate, path_rate, score, keep``.

    ``p`` is the classifier's probability, the rates are the posteriors of the place without the document, ``score``
    combines them. The host is the source up to its first slash, the path its first part and ``section_col``. A null or
    empty text has the features of an empty one; null sources and sections are places of their own; repeated rows each
    come back; an empty table gives an empty result.
    """
    columns = {"doc_id": id_col, "text": text_col, "source": source_col} | ({"section": section_col} if section_col else {})
    out = _judged(pick(docs, **columns), model, "text", "source", "section" if section_col else None, threshold)
    return out.select("doc_id", "p", "host", "path", "host_rate", "path_rate", "score", "keep")


def keep_good(docs: DataFrame, model: Classifier, text_col: str = "text", source_col: str = "source", section_col: str | None = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns unchanged; nulls and repeats are judged as by ``judge``."""
    names = docs.columns
    at = lambda c: f"c{place(names, c)}"
    out = _judged(docs.toDF(*[f"c{i}" for i in range(len(names))]), model, at(text_col), at(source_col), at(section_col) if section_col else None, threshold)
    return out.filter("keep").select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
