import random
import re

import pytest

from touchline.llm import decontaminate as D


def edit_search(p, t):
    """Best distance of p to any substring of t, by the full table."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rnd, text, n):
    s = list(text)
    for _ in range(n):
        at = rnd.randrange(len(s))
        kind = rnd.random()
        if kind < 0.4:
            s[at] = rnd.choice("abcdefé")
        elif kind < 0.7:
            del s[at]
        else:
            s.insert(at, rnd.choice("xyz "))
    return "".join(s)


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghié") for _ in range(rnd.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rnd.randint(12, 40)).capitalize()) for i in range(14)] + [(90, None), (91, ""), (92, "short"), (5, None)]
    items.append(items[3])
    docs = []
    for d in range(80):
        t = text(rnd.randint(0, 60))
        if d % 2:
            p = items[rnd.randrange(14)][1]
            t = text(5) + rnd.choice([" ", "\n\n"]) + edited(rnd, p.upper() if d % 3 == 0 else p, rnd.randint(0, 10)).replace(" ", rnd.choice([" ", "  "])) + " " + text(rnd.randint(0, 30))
        docs.append((d, t))
    docs += [(200, None), (201, ""), (None, items[2][1]), (1, docs[1][1]), (202, (items[0][1] + " ") * 300 + text(20000))]
    return docs, items


def test_equals_brute_force(spark, data):
    docs, items = data
    d = spark.createDataFrame([(t, i, 1.0) for i, t in docs], "text string, doc_id long, item_id double").repartition(3)
    b = spark.createDataFrame([(t, i) for i, t in items], "text string, item_id long")
    for block in (D.BLOCK_CHARS, 600):
        got = sorted(((r.doc_id, r.item_id, r.distance) for r in D.find_items(d, b, block_chars=block).collect()), key=repr)
        want = []
        for i, t in docs:
            t = D.normalised(t or "")
            for k, p in {(k, D.normalised(p or "")) for k, p in items}:
                if len(p) < D.SHORT_CHARS:
                    if p and len(t) < 20000 and re.search(rf"(?<!\w){re.escape(p)}(?!\w)", t):
                        want.append((i, k, 0))
                elif len(t) < 20000 and (e := edit_search(p, t)) <= int(D.RATE * len(p)):
                    want.append((i, k, e))
        want.append((202, 0, 0))
        assert got == sorted(want, key=repr)
    bad = {w[0] for w in want}
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in docs if i not in bad), key=repr)


def test_places_lie_where_the_distance_says(data):
    docs, items = data
    block = D.Items([(k, D.normalised(p)) for k, p in items[:14]], D.RATE)
    for _, t in docs[:80]:
        t = D.normalised(t or "")
        for k, d, a, b in block.find(t):
            p = D.normalised(dict(items[:14])[k])
            assert list(D.distances(p, D.masks(p), t[a:b], anchored=True))[-1] == d


def test_empty_inputs(spark):
    d = spark.createDataFrame([(1, "x" * 50)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "x" * 50)], "item_id long, text string")
    assert D.find_items(d.limit(0), b).count() == 0
    assert D.find_items(d, b.limit(0)).count() == 0
    assert D.drop_contaminated(d, b.limit(0)).count() == 1 and D.drop_contaminated(d, b).count() == 0


def test_short_items_are_found_as_whole_words(spark):
    b = spark.createDataFrame([(1, "Two Words"), (2, "x"), (3, "   "), (4, "+1")], "item_id long, text string")
    rows = [(1, "here are two  words."), (2, "atwo words"), (3, "two wordsmiths, then two words"), (4, "x"), (5, "ax"), (6, "a+1 b"), (7, "tow words")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance, r.start) for r in D.find_items(d, b).collect())
    assert got == [(1, 1, 0, 9), (3, 1, 0, 21), (4, 2, 0, 0), (6, 4, 0, 1)]
    assert sorted(r.doc_id for r in D.drop_contaminated(d, b).collect()) == [2, 5, 7]


def test_clashing_column_names(spark):
    d = spark.createDataFrame([("two words", "clean", 1)], "TEXT string, text string, doc_id long")
    b = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    assert D.drop_contaminated(d, b).count() == 1 and D.drop_contaminated(d.toDF("TEXT", "Text", "doc_id"), b).count() == 0
