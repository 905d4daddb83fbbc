import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import quality as Q

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = Q.train(docs, labels, where=~held)
    rows = Q.judge(docs.join(labels.filter(held), "doc_id").select(docs["*"]), model).join(labels, "doc_id").select("quality", "keep").collect()
    bad = [r.keep for r in rows if r.quality == 0]
    good = [r.keep for r in rows if r.quality == 1]
    assert len(bad) > 50 and sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1


def brute(rows, model, share_of=None):
    """The same sums in plain Python."""
    p = [float(model.probability([Q.features(None if t is None else t.encode())])[0]) for _, t, _, _ in rows]
    split = lambda s: ((s or "").split("/")[0].lower(), (s or "").split("/")[1] if "/" in (s or "") else "")
    at = [(split(s)[0], f"{split(s)[1]}/{lang or ''}") for _, _, s, lang in rows]
    share = sum(p) / len(p)

    def strength(keys):
        groups = {}
        for k, x in zip(keys, p, strict=True):
            groups.setdefault(k, []).append(x)
        n, within = len(p), share * (1 - share)
        nn = sum(len(g) ** 2 for g in groups.values())
        if len(groups) < 2:
            return 1e6
        between = max((sum(len(g) * (sum(g) / len(g) - share) ** 2 for g in groups.values()) - (len(groups) - 1) * within) / (n - nn / n), 0)
        return min(max(within / between - 1, 1.0), 1e6) if between else 1e6

    kh, kp = strength([h for h, _ in at]), strength(at)
    out = []
    for i, (h, path) in enumerate(at):
        hs = [x for x, a in zip(p, at, strict=True) if a[0] == h]
        ps = [x for x, a in zip(p, at, strict=True) if a == (h, path)]
        hr = (sum(hs) - p[i] + kh * share) / (len(hs) - 1 + kh)
        pr = (sum(ps) - p[i] + kp * hr) / (len(ps) - 1 + kp)
        z = math.log(p[i] / (1 - p[i])) + math.log(pr / (1 - pr)) - math.log(share / (1 - share))
        out.append((rows[i][0], 1 / (1 + math.exp(-z))))
    return out


def test_equals_plain_sums(spark):
    rng = np.random.default_rng(0)
    shapes = [Q.features(b"clean words go here. ok " * int(n)) for n in rng.integers(1, 50, 60)] + [Q.features(b"BUY!! NOW!! ###$$$ | x | " * int(n)) for n in rng.integers(1, 50, 60)]
    model = Q.fit(shapes, [1] * 60 + [0] * 60, ridge=50.0)
    rows = [(i, t, s, lang) for i, (t, s, lang) in enumerate([
        ("clean words go here", "A.com/x/1", "en"), ("BUY!! NOW!!", "a.com/x/2", "en"), ("clean words", "a.com", "en"), (None, None, None), ("", "", ""), ("#### $$$", "b.com/y", "fr"),
        ("one two three", "b.com/y?q", "fr"), ("one two three", "b.com/y?q", "fr"), ("long " * 30000, "c.com/z", "de")])] + [(None, "no id", "c.com/z", "de")]
    df = spark.createDataFrame([(s, t, i, lang, 0.0) for i, t, s, lang in rows], "source string, text string, doc_id long, lang string, P double")
    got = {r.doc_id: r.score for r in Q.judge(df, model).collect()}
    want = {i: s for i, s in brute([(i, t, (s or "").replace("?q", ""), lang) for i, t, s, lang in rows], model)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)
    kept = Q.keep_good(df, model)
    assert kept.columns == df.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(k) for k, s in want.items() if s >= 0.5)
    assert Q.judge(df.limit(0), model).count() == 0


def test_training_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = Q.train(docs, labels)
    assert [round(r.score, 6) for r in Q.judge(docs, model).collect()] == [0.5]


def test_sample_is_bounded(spark):
    from touchline.llm.rows import labelled_sample

    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    ids = [r.doc_id for r in labelled_sample(labels, "quality", 500).collect()]
    assert len(ids) == 500 and len(set(ids)) == len(ids) and max(ids) > 4000


def test_sample_does_not_depend_on_partitions(spark):
    from touchline.llm.rows import labelled_sample

    labels = spark.range(1_000_000, 1_060_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for partitions in (2, 3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found.append({r.doc_id for r in labelled_sample(labels.repartition(partitions), "quality", 5000).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found[0]) == 5000 and found[0] == found[1] == found[2]


def test_clashing_column_names(spark):
    rng = np.random.default_rng(0)
    shapes = [Q.features(b"clean words go here. ok " * int(n)) for n in rng.integers(1, 50, 60)] + [Q.features(b"BUY!! NOW!! ###$$$ | x | " * int(n)) for n in rng.integers(1, 50, 60)]
    model = Q.fit(shapes, [1] * 60 + [0] * 60, ridge=50.0)
    rows = [("BUY!! NOW!! ###$$$ | x |" if i % 2 else "clean words go here. ok", f"{i}.org", "en", i) for i in range(6)]
    df = spark.createDataFrame([("#", "same.com", *r) for r in rows], "TEXT string, Source string, text string, source string, lang string, doc_id long")
    kept = Q.keep_good(df, model)
    want = Q.keep_good(spark.createDataFrame(rows, "text string, source string, lang string, doc_id long"), model)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in want.collect())


def test_hosts_and_paths_of_addresses(spark):
    """Sites of real addresses: good ones keep their weak pages, bad ones lose theirs."""
    rng = np.random.default_rng(0)
    shapes = [Q.features(b"clean words go here. ok " * int(n)) for n in rng.integers(1, 50, 60)] + [Q.features(b"BUY!! NOW!! ###$$$ | x | " * int(n)) for n in rng.integers(1, 50, 60)]
    model = Q.fit(shapes, [1] * 60 + [0] * 60, ridge=50.0)
    pages = [r.url for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").collect()]
    rows = [(i, "BUY!! NOW!! ###$$$ | x |" if "casino" in u or "pills" in u else "clean words go here. ok", u.split("://")[1], None) for i, u in enumerate(pages)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    got = {r.doc_id: r.score for r in Q.judge(df, model).collect()}
    want = dict(brute(rows, model))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)
