import hashlib
import random
import zlib

import pytest

from touchline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """Top of a tree and, for each leaf, what stands left and right of it and of its ancestors."""
    sides, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(places):
            run, slot = nodes[place // 16 * 16:place // 16 * 16 + 16], place % 16
            sides[i].append(("".join(run[:slot]), "".join(run[slot + 1:])))
            places[i] = place // 16
        nodes = [digest("".join(nodes[k:k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], sides


def serial(rows):
    leaf = lambda r, text: digest("".join(map(field, (*r[:4], text))))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, leaf(r, r[4])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    tops, inner = zip(*[tree([lf for _, lf in groups[n]]) for n in names]) if names else ((), ())
    root, outer = tree(list(tops)) if names else (None, ())
    out = []
    for name, top, own, above in zip(names, tops, inner, outer):
        for (r, lf), below in zip(groups[name], own):
            now = lf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                now = leaf(r, None if r[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))
            for left, right in below + above:
                now = digest(left + now + right)
            out.append((r[0], lf, top, root, digest("".join(a + b for a, b in below + above)), now, now == root))
    return out


def shown(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("n, sources", [(1, 1), (2, 2), (16, 1), (17, 1), (273, 1), (40, 40), (600, 3), (700, 280)])
def test_equal_to_serial_trees(spark, n, sources):
    pick = random.Random(n * 31 + sources)
    rows = [(i * 7 - 50, f"s{pick.randrange(sources) if pick.random() > 0.3 else 0}", pick.choice(["en", None]), pick.randrange(99), pick.choice(["Abc", "xyz", "É Ü", ""]) * pick.randrange(4)) for i in range(n)]
    pick.shuffle(rows)
    assert shown(merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3))) == sorted(serial(rows), key=repr)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, None, None), (None, "a", "en", 1, "X"), (5, None, None, None, None), (7, "", "en", 2, ""), (7, "", "en", 2, "other"), (4, "ß", "de", -3, "Ä" * 200000), *[(9, "a", "en", 1, "Same")] * 40,
            (2**63 - 1, "a", "en", 1, "Z"), (-2**63, "a", "en", 1, "z")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("'no' as TEXT", "*", "1 as tree", "2 as place", "3 as size", "'x' as digest", "0 as Doc_ID")
    assert shown(merkle.manifest(docs)) == sorted(serial(rows), key=repr)


def test_empty_table(spark):
    assert shown(merkle.manifest(spark.createDataFrame([], SCHEMA))) == []


def test_tampering_is_seen_and_only_there(spark):
    rows = [(i, "s", "en", 4, "Text" if i % 2 else "text") for i in range(120)]
    got = {r.doc_id: r.verified for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 5 == 0) for i in range(120)}
