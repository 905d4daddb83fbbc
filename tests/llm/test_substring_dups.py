import hashlib
import random
import re

import numpy as np
import pytest

from touchline.llm import substring_dups as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k=13):
    low = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - k + 1):
            g = tuple(w[i:i + k])
            low[g] = min(low.get(g, S.NO_ID), S.NO_ID if d is None else d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if low[tuple(w[i:i + k])] < (S.NO_ID if d is None else d):
                gone[i:i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def fixture():
    rnd = random.Random(3)
    vocab = [f"é{i}x" if i % 3 else f"w{i}," for i in range(500)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    shared = [text(n) for n in (13, 14, 12, 40, 70)]
    rows = []
    for d in range(60):
        w = text(rnd.randint(0, 120))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(w))
            w[at:at] = rnd.choice(shared)
        rows.append((d * 3 % 61, rnd.choice([" ", "\n", "  \t", "\x0b"]).join(w)))
    rows += [(1000, rows[5][1]), (1001, rows[5][1].replace(" ", "\n")), (3, rows[5][1]), (3, rows[6][1]), (None, rows[5][1]), (None, rows[5][1]), (2000, None), (2001, ""), (2002, " \t ")]
    rows += [(3000, "same " * 2000), (3001, "same " * 2000 + "other"), (3002, " ".join(text(40000))), (3003, "a\xa0b\x1fc " * 20), (3004, "a\xa0b\x1fc " * 20)]
    rows.append((3005, " ".join(rows[-4][1].split()[20000:39990])))
    return rows


@pytest.mark.parametrize("segment,flush", [(S.SEGMENT_BYTES, S.FLUSH_BYTES), (700, 3000)])
def test_equals_brute_force(spark, segment, flush, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(S, "FLUSH_BYTES", flush)
    rows = fixture()
    df = spark.createDataFrame([(t, "k", d, 1) for d, t in rows], "text string, key string, doc_id long, ord int").repartition(3)
    got = S.remove_repeats(df)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=repr) == brute(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got.collect())
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_segments_cover_all_windows():
    words = [b"w%d" % i for i in range(1000)]
    parts = list(S._segments(b" ".join(words), 13, 200))
    seen = [tuple(w) for at, p in parts for w in [words[at + i:at + i + 13] for i in range(len(p.split()) - 12)]]
    assert len(parts) > 5 and sorted(seen) == sorted(tuple(words[i:i + 13]) for i in range(988))


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(S, "word_hashes", lambda data, s, e: np.zeros(len(s), np.uint64))
    strings = [b" ".join(b"%d" % (i + j) for i in range(14)) for j in (0, 0, 1, 7)]
    string, word = S.repeated_windows(strings, np.array([5, 9, 9, 1]), 13)
    assert list(zip(string.tolist(), word.tolist())) == [(1, 0), (1, 1), (2, 0)]


def test_hot_minimisers_are_spread(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_WINDOWS", 200)
    rnd = random.Random(4)
    text = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    phrase = text(S.RUN + 1)
    rows = [(d, " ".join(text(15) + phrase + text(15))) for d in range(400)]
    rows += [(1000 + d, t) for d, t in rows[:50]] + fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.remove_repeats(df).collect()), key=repr) == brute(rows)
    hot = S.hot_minimisers(df, 13, sum(len((t or "").encode()) for _, t in rows))
    joined = "\n".join(t for _, t in rows[:400]).encode()
    words, _, _, doc = S._places(joined)
    windows = lambda found: np.concatenate([np.repeat(np.uint64(m), b - a - 11) for a, b, m in zip(*found)])
    before, after = windows(S.super_runs(words, doc)), windows(S.super_runs(words, doc, hot=hot))
    assert len(before) == len(after) and np.unique(before, return_counts=True)[1].max() > 200
    assert np.unique(after, return_counts=True)[1].max() < 200
