import itertools
import random

import numpy as np
import pytest
import xxhash

from touchline.llm import simhash
from touchline.llm.components import connected_components


def brute_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            root[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[top(i)] = min(ids.get(top(i), d), d)
    return sorted(((d, fps[i], ids.get(top(i))) for i, (d, _) in enumerate(rows)), key=repr)


def near_rows(seed=5):
    rnd = random.Random(seed)
    words = [f"w{i}É" for i in range(300)]
    rows = []
    for base in range(12):
        text = [rnd.choice(words) for _ in range(400)]
        for copy in range(rnd.randint(1, 6)):
            new = list(text)
            for _ in range(copy):
                new[rnd.randrange(400)] = rnd.choice(words)
            rows.append((base * 10 + copy, rnd.choice([" ", "\n", " \t"]).join(new)))
    rows += [(900, ""), (901, None), (902, " \x0b "), (903, "One"), (904, "oNE"), (905, "a b"), (None, "a b"), (906, "x\x00y \xa0 z"), (3, rows[0][1])]
    rows += [(1000, "long " * 30000), (1001, "long " * 30000)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return near_rows()


def test_near_duplicates_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(t, 1, d, "e") for d, t in rows], "text string, fp int, doc_id long, TEXT2 string")
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == brute_components(rows)


@pytest.mark.parametrize("large", [3, 1 << 17])
def test_trie_finds_every_pair(spark, large):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(40)]
    keys = {0, 2**64 - 1, *base}
    for b in base:
        for _ in range(6):
            x = b
            for _ in range(rnd.randint(1, 4)):
                x ^= 1 << rnd.randrange(64)
            keys.add(x)
    keys = sorted(keys)
    want = {(a, b) for a, b in itertools.combinations(keys, 2) if (a ^ b).bit_count() <= 3}
    arr = np.array(keys, dtype=np.uint64)
    got = [(keys[min(i, j)], keys[max(i, j)]) for x, y in simhash.trie_pairs(arr, np.array([0, len(arr)])) for i, j in zip(x, y)]
    assert len(got) == len(set(got)) and set(got) == want
    signed = [(int(np.uint64(k).view(np.int64)),) for k in keys]
    edges = simhash.near_edges(spark.createDataFrame(signed, "fp long"), large=large)
    parts = {r.node: r.component for r in connected_components(edges).collect()}
    for a, b in want:
        a, b = (int(np.uint64(x).view(np.int64)) for x in (a, b))
        assert parts[a] == parts[b]
    linked = {int(np.uint64(x).view(np.int64)) for p in want for x in p}
    assert set(parts) == linked


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark, rows):
    extra = [(t, d, "A") for d, t in rows] + [(rows[0][1], 0, "B")]
    df = spark.createDataFrame(extra, "text string, doc_id long, Component_ID string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted({c for _, _, c in brute_components(rows)})


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_column_names_keep_rows(spark):
    df = spark.createDataFrame([(9, "a b c d", 1, "x"), (9, "a b c d", 2, "y"), (9, "other words stand here now", 3, "z")], "Doc_ID long, text string, doc_id long, TEXT string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns and sorted(r[2] for r in got.collect()) == [1, 3]
