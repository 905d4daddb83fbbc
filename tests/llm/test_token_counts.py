import numpy as np
import pytest

from touchline.llm import token_counts as T

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_flat_files_of_any_shape(spark, tmp_path, block):
    rng = np.random.default_rng(4)
    shapes = {"a": [5, 0, 0, 7, 1], "b": [], "c": [0], "d": [300, 2], "e": [4, 4], "f": [9]}
    want, rows = [], []
    for name, sizes in shapes.items():
        parts, at = [], 0
        for i, n in enumerate(sizes):
            parts += [rng.integers(0, END, n), [END]]
            want.append((name, i, at, n))
            at += n + 1
        if name in "ef":
            parts.append(rng.integers(0, END, 3))
            want.append((name, len(sizes), at, 3))
        data = np.concatenate(parts).astype("<u2") if parts else np.zeros(0, "<u2")
        path = tmp_path / f"{name}.bin"
        path.write_bytes(data.tobytes())
        rows.append((f"file://{path}" if name < "d" else str(path), len(data) * 2))
    df = spark.createDataFrame([*rows, rows[0], (None, 4)], "file string, bytes long")
    got = sorted((r.file.rsplit("/", 1)[1][0], r.ordinal, r.start, r.n_tokens) for r in T.count_tokens(spark, df, END, block_bytes=block).collect())
    assert got == sorted(want)


def test_documents_round_trip(spark):
    encode = T.encoder(RANKS).encode_ordinary
    rows = [(i, "word " * (i % 7) + "é\n" * (i % 3)) for i in range(50)] + [(None, "x"), (60, None), (61, ""), (3, "again"), (62, "<|endoftext|>"), (63, "long text " * 40000)]
    df = spark.createDataFrame([(t, "f", i) for i, t in rows], "text string, file string, doc_id long").repartition(3)
    got = sorted(((r.doc_id, r.n_tokens) for r in T.document_tokens(df, RANKS, END, file_bytes=500, block_bytes=128).collect()), key=repr)
    assert got == sorted(((i, len(encode(t or ""))) for i, t in rows), key=repr)
    assert T.document_tokens(df.limit(0), RANKS, END).count() == 0
