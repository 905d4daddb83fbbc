import gc
import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from touchline.llm import piece_sampling as P

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = ["hello world", " two  blanks ", "a\nb\tc", "é ▁ 你好\U0001f600 \x00", "", None, " ", "x" * 300, "word " * 20000]


@pytest.fixture(scope="module")
def vocab():
    return P.vocabulary(MODEL)


def segmentations(text, vocab, model):
    """Every segmentation and its share, by recursion over the pieces of the model."""
    weight = {int(i): float(w) for i, w in zip(vocab.ids, vocab.weights)}
    piece = {model.id_to_piece(i): i for i in weight}

    def split(s):
        if not s:
            return [((), 0.0)]
        out = []
        for n in range(1, len(s) + 1):
            if s[:n] in piece:
                out += [((piece[s[:n]], *rest), weight[piece[s[:n]]] + w) for rest, w in split(s[n:])]
        if s[0] not in piece:
            raw = s[0].encode()
            out += [((*[int(vocab.byte[b]) for b in raw], *rest), vocab.byte_weight * len(raw) + w) for rest, w in split(s[1:])]
        return out

    words = [split(P.BLANK + w) for w in text.split(" ")]
    rows = [(sum((p for p, _ in c), ()), sum(w for _, w in c)) for c in itertools.product(*words)]
    total = math.log(sum(math.exp(w) for _, w in rows))
    return {p: w - total for p, w in rows}


@pytest.mark.parametrize("text", ["the", "abc d", "né\n", "zx你"])
def test_all_segmentations_come_once(text, vocab):
    want = segmentations(text, vocab, sentencepiece.SentencePieceProcessor(model_file=MODEL))
    found = P.sample_slice([text], np.array([9], np.uint64), P.WordStore(vocab), len(want) + 5)[0]
    got = {tuple(s[3].tolist()): s[0] for s in found}
    assert len(found) == len(got) == len(want) and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want) and abs(sum(map(math.exp, got.values())) - 1) < 1e-9
    values = [s[1] for s in found]
    assert values == sorted(values, reverse=True) and all(s[2] == 1.0 for s in found)


def test_frequencies_and_inclusion(vocab):
    text, n = "there on", 6000
    want = segmentations(text, vocab, sentencepiece.SentencePieceProcessor(model_file=MODEL))
    found = P.sample_slice([text] * n, np.arange(n, dtype=np.uint64), P.WordStore(vocab), 2)
    first = {}
    for s in found:
        first[tuple(s[0][3].tolist())] = first.get(tuple(s[0][3].tolist()), 0) + 1
    for p, w in want.items():
        share = math.exp(w)
        assert abs(first.get(p, 0) / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-3
    # weighting each sample by its share over its inclusion probability gives one on average
    mean = np.mean([sum(math.exp(x[0]) / x[2] for x in s) for s in found])
    assert abs(mean - 1) < 0.03
    # and the second sample, given the first, follows the shares of the others
    top = max(want, key=want.get)
    others = [tuple(s[1][3].tolist()) for s in found if tuple(s[0][3].tolist()) == top]
    for p, w in want.items():
        share = math.exp(w) / (1 - math.exp(want[top])) if p != top else 0.0
        assert abs(others.count(p) / len(others) - share) < 5 * math.sqrt(share * (1 - share) / len(others)) + 1e-3


def test_rows_decode_to_their_text(spark):
    rows = [(t, i, "p") for i, t in enumerate(TEXTS)] + [("hello world", None, "p"), ("hello world", 0, "p")]
    df = spark.createDataFrame(rows, "text string, doc_id long, pieces string").repartition(3)
    got = P.sample(df, MODEL, k=4)
    out = P.decode(got, MODEL).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {*range(len(TEXTS)), None}
    for i, t in enumerate(TEXTS):
        assert {r.text for r in by[i]} == {t or ""}
        assert len({tuple(r.pieces) for r in by[i]}) == len(by[i]) // (2 if i == 0 else 1)
    assert sorted(r.rank for r in by[7]) == [1, 2, 3, 4] and [r.rank for r in by[4]] == [1]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert model.decode(by[0][0].pieces) == "hello world"
    again = {(r.doc_id, r.rank): r.pieces for r in P.sample(df.repartition(1), MODEL, k=4).collect()}
    assert all(again[r.doc_id, r.rank] == r.pieces for r in out)
    assert P.sample(df.limit(0), MODEL).count() == 0


def test_kept_words_change_no_sample(vocab):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["of", "the", "singing", "Straßenbahn", "▁odd", "日本語", "x" * 60], 40)) for _ in range(12)]
    keys = np.arange(12, dtype=np.uint64)
    whole = P.sample_slice(texts, keys, P.WordStore(vocab), 3)
    kept = P.WordStore(vocab)
    parts = [s for i in range(0, 12, 3) for s in P.sample_slice(texts[i:i + 3], keys[i:i + 3], kept, 3)]
    for a, b in zip(whole, parts, strict=True):
        assert [x[3].tolist() for x in a] == [x[3].tolist() for x in b] and np.allclose([x[:3] for x in a], [x[:3] for x in b], rtol=1e-9)


def test_decoded_where_they_are_made(spark):
    texts = ["two words", "", None, " lead", "日本 ▁ x", "tab\tand\nline"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.text == (texts[r.doc_id] or "") for r in P.sample(df, MODEL, decoded=True).collect())


def test_a_task_leaves_no_lattices_behind():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([7, 8]), pa.array(["pressing haut", None])], ["doc_id", "key", "text"])
    out = pa.Table.from_batches(P.sampled(iter([batch]), MODEL, 3))
    gc.collect()
    assert out["doc_id"].to_pylist() == [1, 1, 1, 2] and not any(isinstance(x, P.WordStore) for x in gc.get_objects())
