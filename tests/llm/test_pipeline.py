import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_quality import brute as brute_quality
from tests.llm.test_simhash import brute_fp
from touchline.llm import decontaminate, piece_sampling, quality, secret_scan
from touchline.llm.queries import MODEL_FILE, QUERIES, ORACLE

SF = "/root/testdata/sf0.001"


def kept_by_brute_force(spark):
    docs = [tuple(r) for r in duckdb.sql(f"SELECT doc_id, text, source, lang FROM '{SF}/documents.parquet'").fetchall()]
    frame, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = dict(brute_quality(docs, quality.train(frame, labels)))
    docs = [d for d in docs if scores[d[0]] >= quality.THRESHOLD]
    fps = [brute_fp(t) for _, t, _, _ in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)), key=lambda k: docs[k][0])
                root[b] = a
    docs = [d for i, d in enumerate(docs) if top(i) == i]
    items = [decontaminate.normalised(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    leaked = set()
    for d, t, _, _ in docs:
        t = decontaminate.normalised(t)
        if any(min(decontaminate.distances(p, decontaminate.masks(p), t), default=len(p)) <= int(decontaminate.RATE * len(p)) for p in items):
            leaked.add(d)
    return {d: secret_scan.redacted(t.encode(), "[secret]") for d, t, _, _ in docs if d not in leaked}


@pytest.fixture(scope="module")
def want(spark):
    return kept_by_brute_force(spark)


def test_pipeline_equals_brute_force(spark, want):
    rows = piece_sampling.decode(corpus_pipeline.run(spark, SF), MODEL_FILE).collect()
    assert {r.doc_id for r in rows} == set(want)
    assert all(r.text == want[r.doc_id] for r in rows)
    assert all(len({tuple(x.pieces) for x in rows if x.doc_id == d}) == sum(x.doc_id == d for x in rows) for d in list(want)[:20])


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "pieces"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run and set(QUERIES) == set(names) and set(ORACLE) <= set(QUERIES)
