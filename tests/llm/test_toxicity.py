import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def brute_segments(s):
    """Recursion of the definition: the best segment, then those left and right of it."""
    if not s or max(s) <= 0:
        return []
    best = max(((sum(s[a:b]), -(b - a), -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)))
    a, b = -best[2], -best[2] - best[1]
    return brute_segments(s[:a]) + [(a, b, best[0])] + [(b + x, b + y, z) for x, y, z in brute_segments(s[b:])]


def test_segments_equal_definition():
    rnd = random.Random(2)
    for _ in range(300):
        s = [rnd.choice([-3, -2, -1, 1, 2, 3, 5]) + rnd.random() / 7 for _ in range(rnd.randint(0, 14))]
        got = X.segments(s)
        assert [g[:2] for g in got] == [w[:2] for w in brute_segments(s)]
        assert np.allclose([g[2] for g in got], [w[2] for w in brute_segments(s)])
    for _ in range(100):
        hits = sorted(rnd.sample(range(40), rnd.randint(0, 9)))
        hits = [(i, rnd.choice([-1.5, 0.7, 2.2]) + rnd.random() / 9) for i in hits]
        dense = [dict(hits).get(i, -0.1) for i in range(45)]
        assert [x[:2] for x in X.sparse_segments(hits, 0.1)] == [x[:2] for x in X.segments(dense)]


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return X.train(docs, labels, where=~X.held_out())


def test_held_out_accuracy(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = X.score(docs, model).join(labels, "doc_id").filter(X.held_out()).select("toxic", "predicted", "score").collect()
    hit = [r.predicted for r in rows if r.toxic]
    clean = [r.predicted for r in rows if not r.toxic]
    assert len(hit) > 80 and sum(hit) / len(hit) > 0.88 and sum(clean) / len(clean) < 0.01
    pairs = list(itertools.product([r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic][:400]))
    assert sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs) > 0.95


def test_odd_rows(spark, model):
    word = max((w for w in model.weights if w[0] != X.STEM_MARK), key=model.weights.get)
    rows = [(1, f"all good here, then {word} {word.upper()} {word}! and more"), (2, None), (3, ""), (None, word), (1, "twice"), (4, "plain " * 30000)]
    df = spark.createDataFrame([(t, i, 0.5) for i, t in rows], "text string, doc_id long, score double")
    got = X.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    one = next(r for r in got if r.passages and r.doc_id == 1)
    assert rows[0][1][one.passages[0].start:one.passages[0].end] == f"{word} {word.upper()} {word}"
    assert one.predicted == 1 and sum(r.predicted for r in got if r.doc_id in (2, 3, 4)) == 0
    assert X.score(df.limit(0), model).count() == 0


def test_stems_know_unseen_forms(model):
    stem = max((w for w in model.weights if w[0] == X.STEM_MARK), key=model.weights.get)
    assert model.word_score(stem[1:] + "zzzz") == model.weights[stem] > 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = X.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in X.score(docs, none).collect()] == [0, 0]
    one = X.train(docs, spark.createDataFrame([(1, 0), (2, 0), (None, 1)], "doc_id long, toxic int"))
    assert [r.predicted for r in X.score(docs, one).collect()] == [0, 0]


def test_held_out_is_the_checksum(spark):
    import zlib

    got = {r.doc_id: r.h for r in spark.range(100).select(F.col("id").alias("doc_id")).select("doc_id", X.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(100)}


def test_places_hold_where_lower_case_is_longer(spark, model):
    word = max((w for w in model.weights if w[0] != X.STEM_MARK), key=model.weights.get)
    text = "\u0130" * 5 + f" and {word} {word} {word} here"
    one = X.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert text[one.passages[0].start:one.passages[0].end] == f"{word} {word} {word}"


def cross_validated(spark, folds=3):
    """Recall and share of clean documents marked, over folds of the training rows alone."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string"))), F.lit(folds))
    known = labels.filter(~X.held_out()).select("doc_id", "toxic")
    rows = []
    for f in range(folds):
        part = known.filter(fold == f)
        fitted = X.train(docs, labels, where=~X.held_out() & (fold != f))
        rows += X.score(docs.join(part.select("doc_id"), "doc_id", "left_semi"), fitted).join(part, "doc_id").select("toxic", "predicted").collect()
    hit, clean = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    return sum(hit) / len(hit), sum(clean) / len(clean)


def test_setting_holds_inside_the_training_rows(spark):
    """``ERRORS`` of 2.5 finds 0.846 here, 2.0 finds 0.882, 1.5 finds 0.895 at several times the CPU time."""
    recall, wrong = cross_validated(spark)
    assert recall > 0.84 and wrong < 0.005
