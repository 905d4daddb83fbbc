import pytest
from pyspark.sql import functions as F

from touchline.operators import evidence, fusion, quality, retrieval, stats, text
from touchline.sources import readers


def test_cleaning_order(spark):
    raw = "<p>Lire aussi : x</p>\nUn <b>gegenpress</b>  haut<script>a<b</script>\n\n\n\nfin"
    got = spark.createDataFrame([(raw,)], "t string").select(text.clean(F.col("t")).alias("t")).first().t
    assert got == "Un contre-pressing haut\n\nfin"


def test_chunks_split_at_headers_and_word_limit(spark):
    body = "# T\n" + "\n".join(["w " * 200] * 3) + "\n## S\nend"
    got = [(r.chunk_no, r.h1, r.h2) for r in text.chunk(spark.createDataFrame([(1, "a.md", body)], "doc_id long, source string, text string")).orderBy("chunk_no").collect()]
    assert got == [(0, "T", ""), (1, "T", ""), (2, "T", "S")]


def test_short_tail_joins_the_last_chunk(spark):
    body = "a " * 300 + "\n" + "b " * 10
    got = text.chunk_short(spark.createDataFrame([(1, "a.md", body)], "doc_id long, source string, text string")).collect()
    assert len(got) == 1 and got[0].words == 310


def test_bm25_fills_with_unscored_documents(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i == 3 else "gamma") for i in range(6)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "nothing")], "query_id long, query string")
    top = retrieval.top_per_query(retrieval.bm25_scores(docs, q), docs, q, 3)
    got = {k: [r.doc_id for r in top.filter(F.col("query_id") == k).orderBy("rank").collect()] for k in (1, 2)}
    assert got == {1: [3, 0, 1], 2: [0, 1, 2]}


TEXTS = ["alpha beta 4-3-3", "alpha", None, "gamma gamma beta", "", "alpha beta 4-3-3", "433 delta", "x", "beta epsilon"]


def corpus_and_questions(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame([(1, "alpha 4-3-3"), (2, "nothing"), (3, "beta gamma beta"), (4, ""), (5, "433")], "query_id long, query string")


def test_bm25_top_scores_in_tasks_without_a_join(spark, monkeypatch):
    docs, q = corpus_and_questions(spark)
    plain = retrieval.top_per_query(retrieval.bm25_scores(docs, q).withColumn("score", F.round("score", 9)), docs, q, 4)
    want = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in plain.collect())
    for block in (256, 2):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        top = retrieval.bm25_top(docs, q, 4)
        assert "Join" not in top._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in top.collect()) == want and len(want) == 20


@pytest.mark.parametrize("common", [100_000, 2, 0])
def test_tfidf_weights_and_top_with_rare_words_apart(spark, monkeypatch, common):
    import math

    monkeypatch.setattr(retrieval, "COMMON", common)
    docs, q = corpus_and_questions(spark)
    other = {"4-3-3": ["433"], "433": ["4-3-3"]}
    bag = lambda t: [w for v in (t or "").split() if len(v) > 1 for w in [v, *other.get(v, [])]]
    bags = [bag(t) for t in TEXTS]
    idf = {w: math.log(1 + len(bags) / (sum(w in b for b in bags) + 1)) + 1 for b in bags for w in b}

    def unit(words):
        raw = {w: words.count(w) / len(words) * idf[w] for w in words if w in idf}
        return {w: v / math.sqrt(sum(x * x for x in raw.values())) for w, v in raw.items()}

    rows = [unit(b) for b in bags]
    got = {(r.doc_id, r.token): round(r.weight, 9) for r in retrieval.tfidf_weights(docs).collect()}
    assert got == {(i, w): round(v, 9) for i, row in enumerate(rows) for w, v in row.items()}
    want = []
    for r in q.collect():
        asked = unit(bag(r.query))
        best = sorted((-round(sum(v * row.get(w, 0) for w, v in asked.items()), 9), i) for i, row in enumerate(rows))[:5]
        want += [(r.query_id, k, i, round(-s, 9) + 0.0) for k, (s, i) in enumerate(best, 1)]
    assert sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in retrieval.tfidf_top(docs, q, 5).collect()) == sorted(want)


def test_vector_products_are_made_in_slices():
    import tracemalloc

    import numpy as np

    from touchline.operators.vector_index import best_of

    rng = np.random.default_rng(1)
    asked, held = rng.standard_normal((2000, 4)), rng.standard_normal((20000, 4))
    tracemalloc.start()
    for i, order, scores in best_of(asked, held, np.arange(20000)[::-1], 3):
        if i % 500 == 0:
            assert np.allclose(scores, np.sort(held @ asked[i])[:-4:-1]) and len(order) == 3
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_vector_top_k_is_exact_across_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    data = rng.standard_normal((60, 8))
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(data)], "vec_id long, vector array<double>, payload int")
    asked = rows.filter("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r.rank): r.vec_id for r in retrieval.vector_top_k(asked, rows, 4, block=13, query_block=3).collect()}
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for q in range(7):
        assert [got[(q, k)] for k in range(1, 5)] == np.argsort(-(unit @ unit[q]))[:4].tolist()


def test_unsafe_sql(spark):
    texts = ["SELECT 1;", "drop table x", "select a from b -- c", "SELECT a; SELECT b", "select update_time from t"]
    got = [r.w for r in spark.createDataFrame([(t,) for t in texts], "t string").select(stats.unsafe_sql(F.col("t")).alias("w")).collect()]
    assert got == [None, "NOT_A_SELECT", "FORBIDDEN_SYNTAX", "FORBIDDEN_SYNTAX", None]
    with pytest.raises(ValueError):
        stats.run_user_sql(spark, "delete from t")


def test_profile_upsert_on_id_or_name(spark):
    schema = "player_id long, player_name string, position string, market_value double, rating double, league string"
    current = spark.createDataFrame([(1, "A", "GK", 1.0, 1.0, "x"), (2, "B", "GK", 1.0, 1.0, "x")], schema)
    new = spark.createDataFrame([(1, "Z", "MID", 9.0, 2.0, "y", 1), (7, " B ", "DEF", 8.0, 2.0, "y", 2), (8, "C", "FWD", 7.0, 2.0, "y", 3), (9, None, "FWD", 7.0, 2.0, "y", 4)], schema + ", _position long")
    got = sorted((r.player_id, r.player_name, r.position) for r in stats.upsert_profiles(current, new).collect())
    assert got == [(1, "A", "MID"), (2, "B", "DEF"), (8, "C", "FWD")]


def test_mot_rules(spark):
    lines = ["# note", "1;2;-3;4;10;20;1", "1,2,3", "2,5,1.005,2,3,4", "3,1,0,0,5,5,0"]
    rows = readers.parse_mot(spark.createDataFrame([("S", v) for v in lines], "sequence_id string, value string")).orderBy("frame_index").collect()
    assert [(r.frame_index, r.x1, r.x2, r.conf) for r in rows] == [(1, 0.0, 7.0, 1.0), (2, pytest.approx(1.0, abs=0.02), pytest.approx(4.0, abs=0.02), 1.0)]


def test_bad_evidence_fails_the_load(spark):
    row = ("e", "S", 1, 2, 0.0, 0.1, "BLOCK_STATE", "LEVEL_9", 0.5, "HIGH")
    df = spark.createDataFrame([row], "event_id string, sequence_id string, start_frame long, end_frame long, start_ts double, end_ts double, family string, level string, confidence double, quality string")
    assert evidence.quarantine(df).count() == 1
    with pytest.raises(Exception, match="bad level"):
        evidence.load_checked(df).collect()


def test_neighbourhood_depth(spark):
    edges = spark.createDataFrame([("S", a, b, "CAUSES") for a, b in ("ab", "bc", "cd")], "sequence_id string, source_id string, target_id string, relation string")
    roots = spark.createDataFrame([("S", "a")], "sequence_id string, root_id string")
    reached = evidence.neighbourhood(edges, roots)
    assert {r.node: r.hops for r in reached.collect()} == {"a": 0, "b": 1, "c": 2}
    met = {(r.source_id, r.target_id): r.met for r in evidence.neighbourhood_edges(edges, reached).collect()}
    assert met == {("a", "b"): 2, ("b", "c"): 1}


def test_rule_violations(spark):
    rows = spark.createDataFrame([("a", 1), ("b", -1), ("c", None)], "k string, v int")
    got = sorted(tuple(r) for r in quality.violations(rows, F.col("k"), {"positive": F.col("v") > 0}).collect())
    assert got == [("b", "positive"), ("c", "positive")]


def test_values_that_round_to_zero_have_no_minus_sign(spark):
    rows = [(line, ball, "DEFENSIVE_RECOVERY", "TEAM_0", "TEAM_1", 1.0, 2.0, 25, 0.5, "HIGH") for line, ball in (("-0.04", "-0.04"), ("0.0", "0.0"), ("-0.05", "1.25"))]
    events = spark.createDataFrame(rows, "a string, b string, family string, subject_team string, opponent_team string, start_ts double, end_ts double, start_frame long, confidence double, quality string")
    events = events.withColumn("metrics", F.create_map(F.lit("defensive_line_velocity"), "a", F.lit("centroid_ball_distance_delta"), "b"))
    texts = [r.summary_text for r in fusion.summaries(events).orderBy("b").collect()]
    assert ["0.0m/s" in t and "-0.0" not in t for t in texts] == [True, True, False]
    assert [t.split("shifted by ")[1].split("m")[0] for t in texts] == ["0.0", "+0.0", "+1.3"]


def transitions_of(spark, velocities):
    """Retreats that differ in the velocity of the line only."""
    rows = [("S", n, n / 25.0, "TEAM_0", "TEAM_1", 0.82, n + 25, "DEFENSIVE_RECOVERY_CANDIDATE", 0.1, 0.7, 0.0, 0.0, 9.0, 9.0, 4.0, v, 0.0) for n, v in enumerate(velocities)]
    return spark.createDataFrame(rows, "sequence_id string, loss_frame long, loss_ts double, losing_team string, gaining_team string, change_conf double, confirm_frame long, candidate_label string, "
                                 "counterpress_score double, recovery_score double, pressure_pre double, pressure_post double, nearest_pre double, nearest_post double, centroid_delta double, line_velocity double, ball_progress double")


TIES = [-4.645, -4.105000000000004, 2.675, 1.005, 2.7349999999999994, -7.375, -0.005, -0.004, 0.285]


def test_metrics_round_as_the_sql_does(spark):
    import duckdb

    got = fusion.transition_evidence(transitions_of(spark, TIES)).select("start_frame", F.col("metrics")["defensive_line_velocity"].cast("double").alias("v"))
    wanted = [duckdb.execute("SELECT round(?::DOUBLE, 2) + 0.0::DOUBLE", [v]).fetchone()[0] for v in TIES]
    assert [r.v for r in got.orderBy("start_frame").collect()] == wanted and wanted[0] == -4.64


def test_report_sentence_of_a_velocity_on_a_tie(spark):
    moments = evidence.report_rows(fusion.summaries(fusion.transition_evidence(transitions_of(spark, TIES[:1]))), spark.createDataFrame(
        [], "sequence_id string, team_label string, possession_pct double, possession_s double, possession_changes long, line_height_m double, pressure_mean double"))
    assert "Backline retreated at -4.6m/s" in moments.filter("section = 4").first().sentence


def test_answers_round_as_the_sql_does(spark):
    import duckdb

    means = [0.5005, 0.5115, 0.7675, 0.2855]
    events = fusion.summaries(fusion.transition_evidence(transitions_of(spark, [-4.645] * len(means))))
    events = events.withColumn("confidence", F.element_at(F.array(*[F.lit(m) for m in means]), F.col("start_frame").cast("int") + 1))
    asked = spark.range(len(means)).select(F.col("id").alias("query_id"), F.lit("S").alias("sequence_id"), F.lit("MATCH_FACT").alias("scope"))
    plan = events.select(F.col("start_frame").alias("query_id"), "sequence_id", F.lit("MATCH_FACT").alias("scope"), "event_id", F.lit(1).alias("rank"))
    got = evidence.answers(asked, plan, events).orderBy("query_id").collect()
    assert [r.confidence for r in got] == [duckdb.execute("SELECT round(?::DOUBLE, 3)", [m]).fetchone()[0] for m in means] and got[0].confidence == 0.5
    assert all("Backline retreated at -4.6m/s" in r.answer for r in got)


def test_questions_are_classified_once(spark):
    from touchline.plans import evidence_queries

    first, again = [evidence_queries.asked(spark, "/root/testdata/sf0.001").inputFiles() for _ in range(2)]
    assert set(first) == set(again) and not any("conversations" in f for f in first)


def test_documents_are_listed_and_read_in_tasks(spark, tmp_path):
    for name, value in {"a.md": "---\nt: 1\n---\nA", "sub/deep/b.md": "É\r\n", "sub/c.html": "", "sub/d.bin": "no", "sub/.hidden.md": "no", "_draft/e.md": "no", "sub/f g%.txt": "F"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(value.encode())
    rows = lambda *a, **k: sorted(tuple(r) for r in readers.read_documents(spark, str(tmp_path), *a, **k).collect())
    assert rows() == [("a.md", "---\nt: 1\n---\nA")]
    assert rows("*.md", recursive=True) == [("a.md", "\nA"), ("b.md", "É\r\n")]
    assert [n for n, _ in rows(recursive=True, keep_front_matter=True)] == ["a.md", "b.md", "c.html", "f g%.txt"]
    files = readers.list_files(spark, str(tmp_path), "*.md", recursive=True)
    assert sorted((r.path.rsplit("/", 1)[1], r.size) for r in files.collect()) == [("a.md", 14), ("b.md", 4)]
    # no list of the files on the driver
    assert not any("/a.md" in f for f in readers.read_documents(spark, str(tmp_path)).inputFiles())
