"""Exact repeated windows of words, found by super-k-mers.

A window is ``k`` consecutive words. Consecutive windows with the same minimiser (the least hash among their short word
runs) travel as one packed string to the bucket of that minimiser, so all copies of a window meet in one bucket. There
they are sorted by hash, equal neighbours are compared byte by byte, and every window with a copy in a document of smaller
id is marked. Minimisers of very many windows are counted first; their windows travel one by one, by a hash of their own, so
that no minimiser makes a large task. Before the shuffle a task keeps each packed string once, for its smallest document: larger documents in the
same task are marked at once. So a passage that a third of all documents share sends one string per flush of a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from touchline.llm.rows import pick, raw, slices

WINDOW = 13
RUN = 3
#: Bytes of packed strings that a task holds before it sends them, and that a bucket is sized for.
FLUSH_BYTES = 12 << 20
BUCKET_BYTES = 32 << 20
#: Bytes of text whose minimisers a task counts before it tells them.
COUNT_BYTES = 64 << 20
MIN_BUCKETS = 256
BUCKETS_OF_TASK = 4
#: Windows from which a minimiser is hot: a small part of what a bucket is sized for.
HOT_WINDOWS = 1 << 18
LEVEL = 6
SEGMENT_BYTES = 1 << 20
NO_ID = (1 << 63) - 1

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of a well-known integer hash)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``; words are in order from place 0 on, one separator between them."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    width = int((ends - starts).max()) + 2
    power = np.full(width, _STEP, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    value = (data.astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, width - 1)]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    value[np.cumsum(inside[:-1]) == 0] = 0
    return _mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64) * _ODD)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def _window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive word hashes."""
    out = words[:len(words) - k + 1].copy()
    for j in range(1, k):
        out = out * _ODD + words[j:len(out) + j]
    return out


def super_runs(words: np.ndarray, doc: np.ndarray, k: int = WINDOW, run: int | None = None, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``first, last, minimiser`` of each super-k-mer: the word positions of its ends and its least run hash.

    Windows whose minimiser is among ``hot`` (sorted) come one by one, each with the hash of its words instead.
    """
    n = len(words)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    run = min(run or RUN, k)
    least = _least(_mix(_window_hashes(words, run)), k - run + 1)
    whole = doc[:n - k + 1] == doc[k - 1:]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:n - k + 1] != doc[:n - k]) | ~whole[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(least)) - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    if hot is not None and len(hot):
        alone = hot[np.minimum(np.searchsorted(hot, least[first]), len(hot) - 1)] == least[first]
        # of a run of windows of one document only the first ones are whole
        stop = np.minimum(last, np.searchsorted(doc, doc[first], "right") - k)
        size = np.where(alone, stop - first + 1, 1)
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        single = np.repeat(alone, size)
        first = np.repeat(first, size) + offset
        last = np.where(single, first, np.repeat(last, size))
        least[first[single]] = _mix(_window_hashes(words, k)[first[single]])
    # a run of windows of one document can end in windows that reach into the next; they are not whole
    ends = np.minimum(last + k - 1, np.searchsorted(doc, doc[first], "right") - 1)
    return first, ends, least[first]


def _segments(text: bytes, k: int, most: int) -> Iterator[tuple[int, bytes]]:
    """The words of a text, one space between them, in parts of about ``most`` bytes that share ``k - 1`` words."""
    if len(text) <= most:
        yield 0, b" ".join(text.split())
        return
    words, at = text.split(), 0
    while at < len(words):
        size, end = 0, at
        while end < len(words) and (size < most or end - at < 2 * k):
            size += len(words[end]) + 1
            end += 1
        yield at, b" ".join(words[at:end])
        if end == len(words):
            return
        at = end - k + 1


def _packed(bytes_: bytes) -> tuple[bytes, int]:
    return pa.Codec("zstd", compression_level=LEVEL).compress(bytes_, asbytes=True), len(bytes_)


def _unpacked(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)


_SENT = pa.schema([("bucket", pa.int64()), ("text", pa.binary()), ("text_size", pa.int64()), ("place", pa.binary()), ("place_size", pa.int64())])
_SENT_SQL = "bucket long, text binary, text_size long, place binary, place_size long"


class _Sender:
    """Collects packed strings, each for its smallest document, and marks the copies in larger ones."""

    def __init__(self, buckets: int):
        self.buckets, self.size = buckets, 0
        self.strings: dict[bytes, list] = {}
        self.marked: list[tuple[int, int, int, int]] = []

    def add(self, string: bytes, minimiser: int, doc: tuple[int, int], first: int, last: int) -> None:
        entry = self.strings.get(string)
        if entry is None:
            self.strings[string] = [minimiser, doc[0], [(doc, first, last)]]
            self.size += len(string) + 1
        elif doc[0] > entry[1]:
            self.marked.append((*doc, first, last + 1))
        elif doc[0] == entry[1]:
            entry[2].append((doc, first, last))
        else:
            self.marked += [(*d, a, b + 1) for d, a, b in entry[2]]
            entry[1:] = [doc[0], [(doc, first, last)]]

    def flush(self) -> Iterator[pa.RecordBatch]:
        """One row for each bucket: its strings, and id, key and word place of each; marks go as rows of their own."""
        groups: dict[int, tuple[list, list]] = {}
        for string, (minimiser, _, places) in self.strings.items():
            texts, at = groups.setdefault(minimiser % self.buckets, ([], []))
            for doc, first, _ in places:
                texts.append(string)
                at.append((*doc, first))
        rows = [(b, *_packed(b"\n".join(texts)), *_packed(np.array(at, np.int64).tobytes())) for b, (texts, at) in groups.items()]
        if self.marked:
            marks = np.array(self.marked, np.int64)
            rows += [((int(marks[i, 0]) * 7 + i) % self.buckets, None, 0, *_packed(marks[i:i + 4096].tobytes())) for i in range(0, len(marks), 4096)]
        self.strings, self.marked, self.size = {}, [], 0
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i:i + 64], strict=True), _SENT, strict=True)], schema=_SENT)


def _send(k: int, buckets: int, known=None):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(buckets)
        hot = known.value if known is not None else None
        for part in slices(batches, "text", SEGMENT_BYTES):
            ids, keys = part.column(0).to_pylist(), part.column(1).to_pylist()
            parts, held = [], 0
            for i, text in enumerate(raw(part, "text")):
                for at, words in _segments(text or b"", k, SEGMENT_BYTES):
                    if words:
                        parts.append((i, at, words))
                        held += len(words)
                    if held > SEGMENT_BYTES:
                        _gather(sender, parts, ids, keys, k, hot)
                        parts, held = [], 0
                    if sender.size > FLUSH_BYTES:
                        yield from sender.flush()
            _gather(sender, parts, ids, keys, k, hot)
        yield from sender.flush()

    return walk


def _places(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and line of each word of ``joined``."""
    data = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero((data == 32) | (data == 10))
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(data))
    return word_hashes(data, starts, ends), starts, ends, np.concatenate([[0], np.cumsum(data[gaps] == 10)])


def _gather(sender: _Sender, parts: list, ids: list, keys: list, k: int, hot: np.ndarray | None = None) -> None:
    if not parts:
        return
    joined = b"\n".join(p[2] for p in parts)
    words, starts, ends, doc = _places(joined)
    head = np.searchsorted(doc, np.arange(len(parts)))
    first, last, least = super_runs(words, doc, k, hot=hot)
    for a, b, start, stop, d, m in zip(first.tolist(), last.tolist(), starts[first].tolist(), ends[last].tolist(), doc[first].tolist(), least.tolist(), strict=True):
        i, at, _ = parts[d]
        base = at - int(head[d])
        sender.add(joined[start:stop], m, (ids[i], keys[i]), a + base, b + base)


def _count(k: int, total: int, hot: int):
    """``minimiser, n``: windows of each minimiser in about ``COUNT_BYTES`` of text, without the rare ones.

    What is left out is in proportion to the bytes counted, half of ``hot`` for each minimiser over the whole table at most.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, parts, length = [], 0, [], 0

        def add() -> None:
            words, _, _, doc = _places(b"\n".join(parts))
            first, last, least = super_runs(words, doc, k)
            held.append((least, last - first - k + 2))

        def told() -> pa.RecordBatch:
            least, at = np.unique(np.concatenate([m for m, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in held]), len(least)).astype(np.int64)
            often = n > hot * size / (2 * total)
            return pa.RecordBatch.from_arrays([pa.array(least[often].view(np.int64)), pa.array(n[often])], ["minimiser", "n"])

        for part in slices(batches, "text", SEGMENT_BYTES):
            for text in raw(part, "text"):
                size += len(text or b"")
                for _, words in _segments(text or b"", k, SEGMENT_BYTES):
                    if words:
                        parts.append(words)
                        length += len(words)
                    if length > SEGMENT_BYTES:
                        add()
                        parts, length = [], 0
                if size > COUNT_BYTES and held:
                    if parts:
                        add()
                    yield told()
                    held, size, parts, length = [], 0, [], 0
        if parts:
            add()
        if held:
            yield told()

    return walk


def hot_minimisers(source: DataFrame, k: int, total: int) -> np.ndarray:
    """Sorted minimisers: all that have ``HOT_WINDOWS`` windows in ``source``, none that has less than half as many."""
    counted = source.select("text").mapInArrow(_count(k, total, HOT_WINDOWS), "minimiser long, n long")
    often = counted.groupBy("minimiser").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_WINDOWS / 2).select("minimiser")
    return np.sort(np.array([r[0] for r in often.collect()], np.int64).view(np.uint64))


def repeated_windows(strings: list[bytes], doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``string, word`` of each window (its first word) that also stands in a string of a smaller ``doc``."""
    hashes, starts, ends, owner = [], [], [], []
    base = done = 0
    while done < len(strings):
        size, stop = 0, done
        while stop < len(strings) and (size < SEGMENT_BYTES or stop == done):
            size += len(strings[stop]) + 1
            stop += 1
        data = np.frombuffer(b"\n".join(strings[done:stop]), np.uint8)
        gaps = np.flatnonzero((data == 32) | (data == 10))
        s, e = np.append(0, gaps + 1), np.append(gaps, len(data))
        own = np.concatenate([[0], np.cumsum(data[gaps] == 10)])
        h = word_hashes(data, s, e)
        n = len(h) - k + 1
        if n > 0:
            w = _window_hashes(h, k)
            whole = own[:n] == own[k - 1:]
            at = np.flatnonzero(whole)
            hashes.append(w[at])
            starts.append(s[at] + base)
            ends.append(e[at + k - 1] + base)
            owner.append(np.stack([own[at] + done, at - np.searchsorted(own, own[at])]))
        base += len(data) + 1
        done = stop
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, starts, ends, owner = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends), np.concatenate(owner, axis=1)
    ids = doc[owner[0]]
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    same = h[1:] == h[:-1]
    group = np.concatenate([[0], np.cumsum(~same)])
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    later = ids > ids[heads[group]]
    joined = b"\n".join(strings)
    wrong = set()
    for i in np.flatnonzero(same).tolist():  # equal hashes: are the words equal, too?
        x, y = order[i], order[i + 1]
        if joined[starts[x]:ends[x]] != joined[starts[y]:ends[y]]:
            wrong.add(int(group[i]))
    for g in wrong:
        at = np.flatnonzero(group == g)
        low: dict[bytes, int] = {}
        for i in at.tolist():
            low.setdefault(joined[starts[order[i]]:ends[order[i]]], int(ids[i]))
        later[at] = [ids[i] > low[joined[starts[order[i]]:ends[order[i]]]] for i in at.tolist()]
    found = np.sort(order[later])
    return owner[0][found], owner[1][found]


_MARKS = pa.schema([("ord", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _sort_bucket(k: int):
    def marks(group: pa.Table) -> pa.Table:
        out, strings, places = [], [], []
        for text, size, place, place_size in zip(*(group.column(i).to_pylist() for i in range(1, 5)), strict=True):
            at = np.frombuffer(_unpacked(place, place_size), np.int64)
            if text is None:
                out.append(at.reshape(-1, 4))
            else:
                strings += _unpacked(text, size).split(b"\n")
                places.append(at.reshape(-1, 3))
        if places:
            place = np.concatenate(places)
            string, word = repeated_windows(strings, place[:, 0], k)
            if len(string):
                cut = np.concatenate([[True], (string[1:] != string[:-1]) | (word[1:] != word[:-1] + 1)])
                a = np.flatnonzero(cut)
                b = np.append(a[1:], len(string)) - 1
                rows = place[string[a]]
                out.append(np.stack([rows[:, 0], rows[:, 1], rows[:, 2] + word[a], rows[:, 2] + word[b] + k], axis=1))
        found = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        return pa.Table.from_arrays([pa.array(found[:, i]) for i in range(4)], schema=_MARKS)

    return marks


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW) -> DataFrame:
    """Word ranges ``start`` to ``stop`` (exclusive) of windows that also start in a document with a smaller id.

    ``ord`` is the id (a null id counts as the greatest), ``key`` the hash of the text that tells rows of one id apart.
    """
    source = pick(docs, doc_id=id_col, text=text_col)
    source = source.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("ord"), F.xxhash64("text").alias("key"), "text")
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(MIN_BUCKETS, 3 * total // BUCKET_BYTES)
    # fewer bytes than two for each window hold no hot minimiser
    hot = hot_minimisers(source, k, total) if total >= 2 * HOT_WINDOWS else np.zeros(0, np.uint64)
    known = source.sparkSession.sparkContext.broadcast(hot) if len(hot) else None
    sent = source.mapInArrow(_send(k, buckets, known), _SENT_SQL)
    # a task takes few buckets whatever the session's number of partitions, so its share does not grow with the corpus
    dealt = sent.repartition(max(MIN_BUCKETS, buckets) // BUCKETS_OF_TASK, "bucket")
    return dealt.groupBy("bucket").applyInArrow(_sort_bucket(k), "ord long, key long, start long, stop long")


def _cut(text: bytes | None, spans: list | None) -> tuple[int, int, list[bytes]]:
    words = (text or b"").split()
    if not spans:
        return len(words), 0, words
    edge = np.zeros(len(words) + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return len(words), int(gone.sum()), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256`` and, if asked for, ``kept`` (the text left).

    Words are runs of bytes other than blank and 9 to 13, unchanged. Every word under a window whose words also start in a
    document of smaller id goes; windows are judged on the input. Null and blank texts have no words. Repeated rows of one
    id do not remove each other; a null id counts as the greatest one; an empty table gives an empty result.
    """
    source = pick(docs, doc_id=id_col, text=text_col)
    spans = repeated_spans(source, k=k).groupBy("ord", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    keyed = source.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("ord"), F.xxhash64("text").alias("key"))
    joined = keyed.join(spans, ["ord", "key"], "left").select("doc_id", "text", "spans")
    kind = source.schema["doc_id"].dataType.simpleString()

    def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            spans_of = [None if s is None else [(x["start"], x["stop"]) for x in s] for s in part.column(2).to_pylist()]
            rows = [_cut(t, s) for t, s in zip(raw(part, "text"), spans_of, strict=True)]
            kept = [b" ".join(r[2]) for r in rows]
            columns = [part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in kept])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(cut_rows, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
