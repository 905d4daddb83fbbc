import numpy as np
import pytest

from touchline.llm import embedding_dups as E


def brute(ids, vecs, cosine=0.95):
    n = len(ids)
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for v in vecs]
    unit = [np.array(v, float) / np.abs(v).max() if o else None for v, o in zip(vecs, ok)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    link = [[i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine for j in range(n)] for i in range(n)]
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if link[i][j]:
                root[top(i)] = top(j)
    low = {}
    for i in range(n):
        if ids[i] is not None:
            low[top(i)] = min(low.get(top(i), ids[i]), ids[i])
    return sorted(((ids[i], sum(link[i]), low.get(top(i)), ids[i] == low.get(top(i))) for i in range(n)), key=repr)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    rows = []
    for size in (16, 3):
        for _ in range(25):
            base = rng.standard_normal(size)
            for _ in range(rng.integers(1, 6)):
                rows.append((base + rng.standard_normal(size) * 0.08).tolist())
    rows += [rows[0], rows[0], [0.0] * 16, [1.0] * 16, [2.0] * 16, [1e300] * 16, None, [], [1.0, None, 2.0], [float("nan")] * 3, [float("inf"), 0.0, 1.0], [-0.0, 1.0, 0.0], [0.0, 1.0, 0.0], [5.0]]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [*ids, 7, None, None], [*rows, rows[3], rows[5], None]


@pytest.mark.parametrize("block,chunk", [(1024, 8192), (3, 7)])
def test_equals_brute_force(spark, data, block, chunk, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "CHUNK", chunk)
    ids, vecs = data
    df = spark.createDataFrame([(v, "x", i) for i, v in zip(ids, vecs)], "embedding array<double>, size string, vec_id long").repartition(5)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()), key=repr)
    assert got == brute(ids, vecs)


def test_recall_with_many_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other = rng.standard_normal((1500, 64))
    other -= (other * base).sum(axis=1)[:, None] * base
    other /= np.linalg.norm(other, axis=1)[:, None]
    near = 0.951 * base + np.sqrt(1 - 0.951**2) * other  # pairs just above the threshold, the hardest ones
    x = np.concatenate([base, near, rng.standard_normal((3000, 64))]).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: r.component_id for r in E.near_duplicates(df).collect()}
    assert sum(got[i + 1500] == i for i in range(1500)) / 1500 > 0.95
    assert all(got[i] == i for i in range(3000, 6000))


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_partners_lie_at_the_threshold_and_depend_on_the_class_only():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((50, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    cls = rng.integers(-(1 << 62), 1 << 62, 50)
    y = E.partners(x, cls, 7, 0.95)
    assert np.allclose((x * y).sum(axis=1), 0.95) and np.allclose(np.linalg.norm(y, axis=1), 1)
    assert np.allclose(E.partners(x[10:12], cls[10:12], 7, 0.95), y[10:12]) and not np.allclose(E.partners(x, cls, 8, 0.95), y)


def test_long_runs_are_sorted_again():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 16))
    key = np.array([b"a"] * 3 + [b"b"] * 30 + [b"c"] * 7)
    order = E.order_of(key, x, 0, 8)
    assert sorted(order.tolist()) == list(range(40)) and order[:3].tolist() == [0, 1, 2] and order[3:33].tolist() != list(range(3, 33))
    assert E.order_of(key, x, 0, 30).tolist() == list(range(40)) and len(E.order_of(key[:0], x[:0], 0, 8)) == 0


def test_windows_reach_over_ranges(spark, monkeypatch):
    """Ranges of a few rows: what lies across their borders is found all the same."""
    monkeypatch.setattr(E, "RANGE_ROWS", 40)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((150, 32))
    x = np.concatenate([base, base + rng.standard_normal(base.shape) * 0.05])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, window=5).collect()), key=repr)
    assert got == brute(list(range(300)), [v.tolist() for v in x])


def test_given_table_by_windows(spark):
    """The whole given table of sf0.1, by windows far smaller than it."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()), key=repr)
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = E.unite(np.arange(len(x)), *np.nonzero(near))
    ids = np.array([r.vec_id for r in rows])
    low = {g: int(ids[label == g].min()) for g in set(label.tolist())}
    assert got == sorted(((int(i), int(k), low[g], int(i) == low[g]) for i, k, g in zip(ids, near.sum(axis=1), label.tolist())), key=repr)


def test_recall_in_a_dense_region(spark):
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    topic = unit(rng.standard_normal(64))
    across = lambda n: unit((d := rng.standard_normal((n, 64))) - (d @ topic)[:, None] * topic)
    c, pairs = 0.9, 300  # a third of the rows lie in one topic, about 0.9 from each other
    side = across(2000 - pairs)
    turn = rng.standard_normal((pairs, 64))
    turn -= (turn @ topic)[:, None] * topic + (turn * side[:pairs]).sum(axis=1)[:, None] * side[:pairs]
    s = (0.955 - c) / (1 - c)
    twin = s * side[:pairs] + np.sqrt(1 - s * s) * unit(turn)  # cosine 0.955 to the first rows of the topic
    hot = np.sqrt(c) * topic + np.sqrt(1 - c) * np.concatenate([side, twin])
    x = np.concatenate([hot, rng.standard_normal((4000, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    links = x[:2000] @ x[:2000].T >= 0.95
    np.fill_diagonal(links, False)
    got = {r.vec_id: r.component_id for r in E.near_duplicates(df).collect()}
    assert links[np.arange(pairs), np.arange(pairs) + 2000 - pairs].all()
    met = sum(got[i] == got[i + 2000 - pairs] for i in range(pairs))
    assert met / pairs > 0.95, met
