"""Sampled segmentations of a text into SentencePiece pieces: the Gumbel top-k without replacement over its lattice.

A text is cut at blanks into words (a blank mark before each); no piece crosses a word, so the lattice of a text is the chain
of its words' lattices. Each distinct word that a task meets gets its lattice once, with the exact log-mass of everything behind each
place. With exact masses the perturbed A* search is a walk from the top: the best perturbed path is an exact sample, the
siblings left aside at each step wait in the queue with a truncated Gumbel value for their best path, and the greatest one is
opened next. So ``k`` pops give the ``k`` best of all perturbed paths: distinct samples without replacement. The next value in
the queue is the threshold from which inclusion probabilities follow.

Scores of pieces come from the ranks of the vocabulary (a rank's probability falls as one over the rank). Random numbers are
hashes of the row's key, the sample and the place, so a row gives the same samples wherever it runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from touchline.llm.rows import pick, slices

SAMPLES = 3
SEED = 7
#: Text bytes whose lattices are held at once.
SLICE_BYTES = 1 << 19
#: Characters of the words whose lattices a task keeps from slice to slice (about 100 bytes each).
MOST_PLACES = 1 << 20
BLANK = "▁"
RANK_SHIFT = 10.0
NONE = -np.inf
#: Log-mass below which siblings are looked at only if need be, and the most that a drawn value can lie above it.
FAR, GAIN = -100.0, 37.0
#: A character that no piece holds.
OTHER = "\U000f0000"

_M1, _M2, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def uniforms(key: np.ndarray, stream: int, place: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 (neither included), each a hash of key, stream and place."""
    x = _mix(key + np.uint64(stream * int(_ODD) % 2**64))
    x = _mix(x + place.astype(np.uint64) * _ODD + np.uint64(1))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


class Vocabulary:
    """Pieces of a model file by hash of their characters, with log-probabilities by rank."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte = np.zeros(256, np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte[int(model.id_to_piece(i)[3:5], 16)] = i
        # a word has one blank mark, at its start
        kept = [(i, model.id_to_piece(i)) for i in plain]
        kept = [(i, p) for i, p in kept if BLANK not in p[1:]]
        order = sorted(kept, key=lambda x: (-model.get_score(x[0]), x[0]))
        weight = -np.log(np.arange(len(order) + 1) + RANK_SHIFT)
        weight -= np.log(np.exp(weight).sum())
        self.byte_weight = float(weight[-1])
        hashes = np.array([self._hash(p) for _, p in order], np.uint64)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")
        place = np.argsort(hashes)
        self.hashes, self.ids, self.weights = hashes[place], np.array([i for i, _ in order])[place], weight[:-1][place]
        self.longest = max(len(p) for _, p in order)
        self.whole, self.begun = (np.zeros(1 << _TABLE_BITS, bool) for _ in range(2))
        self.whole[self._slot(hashes)] = True
        self.begun[self._slot(np.array(list({self._hash(p[:j]) for _, p in order for j in range(1, len(p))}), np.uint64))] = True
        spelled = [p.replace(BLANK, " ").encode() for p in (model.id_to_piece(i) for i in range(n))]
        for b, i in enumerate(self.byte):
            spelled[i] = bytes([b])
        self.bytes_of = np.array(spelled, dtype=object)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * 0x100000001B3 + ord(c) + 1) % 2**64
        return h

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (_mix(h) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def decode(self, ids) -> bytes:
        """The text of piece numbers: bytes joined, marks as blanks, without the blank before the first word."""
        return b"".join(self.bytes_of[np.asarray(ids, np.int64)].tolist())[1:]


@lru_cache(maxsize=1)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


class Lattices:
    """Lattices of distinct words, end to end: edges by start place, log-mass behind each place."""

    def __init__(self, words: list[str], vocab: Vocabulary):
        # a word's own blank marks are not the mark before it: they are spelled in bytes
        plain = [w.replace(BLANK, OTHER) for w in words] if any(BLANK in w for w in words) else words
        joined = BLANK + ("\0" + BLANK).join(plain) + "\0"
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(w) + 2 for w in words], np.int64)
        self.stop = np.cumsum(size) - 1
        self.start = self.stop - size + 1
        n = len(chars)
        rest = np.repeat(self.stop, size) - np.arange(n)  # characters of the word from a place on
        place = np.flatnonzero(rest > 0)
        h = np.zeros(len(place), np.uint64)
        at, length, number = [], [], []
        single = np.zeros(n, bool)
        for width in range(1, vocab.longest + 1):
            h = h * np.uint64(0x100000001B3) + chars[place + width - 1] + np.uint64(1)
            slot = vocab._slot(h)
            maybe = np.flatnonzero(vocab.whole[slot])
            found = np.minimum(np.searchsorted(vocab.hashes, h[maybe]), len(vocab.hashes) - 1)
            good = vocab.hashes[found] == h[maybe]
            at.append(place[maybe[good]].astype(np.int32))
            length.append(np.full(good.sum(), width, np.int8))
            number.append(found[good].astype(np.int32))
            if width == 1:
                single[at[0]] = True
            go = vocab.begun[slot] & (rest[place] > width)
            place, h = place[go], h[go]
        spelled = np.flatnonzero(~single & (rest > 0))
        at.append(spelled.astype(np.int32))
        length.append(np.ones(len(spelled), np.int8))
        number.append(np.full(len(spelled), -1, np.int32))
        del place, h, chars, single
        # the longest first: they are the likeliest, and choose() tries them in order
        at, length, number = (np.concatenate(x[::-1]) for x in (at, length, number))
        order = np.argsort(at, kind="stable")
        self.at, self.length, number = at[order], length[order], number[order]
        del at, length, order
        weight = np.where(number >= 0, vocab.weights[number], 0.0)
        self.piece = np.where(number >= 0, vocab.ids[number], -1).astype(np.int32)
        self._spell(np.flatnonzero(number < 0), words, size, weight, vocab)
        del number
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.at, minlength=n))])  # edges of a place
        mass = np.full(n, NONE)
        mass[self.stop] = 0.0
        levels = rest[self.at].astype(np.uint16 if len(rest) < 1 << 16 or rest.max() < 1 << 16 else np.int64)  # few values: a radix sort
        by_rest = np.argsort(levels, kind="stable")
        levels = levels[by_rest]
        cuts = np.append(np.flatnonzero(np.r_[True, levels[1:] != levels[:-1]]), len(levels)) if len(levels) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            e = by_rest[a:b]
            value = weight[e] + mass[self.at[e] + self.length[e]]
            head = np.flatnonzero(np.r_[True, self.at[e][1:] != self.at[e][:-1]])
            top = np.maximum.reduceat(value, head)
            run = np.diff(np.append(head, len(e)))
            mass[self.at[e][head]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, run)), head))
        self.log_share = weight + mass[self.at + self.length] - mass[self.at]
        del weight, mass, by_rest, levels
        share = np.exp(self.log_share)
        total = np.cumsum(share)
        total -= (total - share)[self.first[self.at]]
        self.through = total  # shares of a place up to and with an edge

    def _spell(self, edges: np.ndarray, words: list[str], size: np.ndarray, weight: np.ndarray, vocab: Vocabulary) -> None:
        """Edges over characters without a piece: their bytes, one after the other in ``spelled``."""
        owner = np.searchsorted(self.stop, self.at[edges])
        known: dict[str, list[int]] = {}
        flat: list[int] = []
        self.spell_first, self.spell_count = np.zeros(len(self.piece), np.int32), np.ones(len(self.piece), np.int8)
        for e, p, w in zip(edges.tolist(), (self.at[edges] - self.start[owner] - 1).tolist(), owner.tolist(), strict=True):
            char = words[w][p] if p >= 0 else BLANK
            ids = known.get(char)
            if ids is None:
                ids = known[char] = vocab.byte[list(char.encode("utf-8", "surrogatepass"))].tolist()
            self.spell_first[e], self.spell_count[e] = len(flat), len(ids)
            flat += ids
            weight[e] = vocab.byte_weight * len(ids)
        self.spelled = np.array(flat, np.int32)


class WordStore:
    """Lattices of words, end to end: those met first stay from slice to slice, up to ``MOST_PLACES`` characters; later ones are laid out for one slice.

    What a word's lattice is does not depend on it.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.index: dict[str, int] = {}
        self.passing: list[str] = []  # words of the last slice that do not stay
        self.size = self.stay = (0, 0, 0, 0)  # words, places, edges, spelled bytes: in all, and of what stays
        self._held: dict[str, np.ndarray] = {}

    def numbers_of(self, words: list[str]) -> np.ndarray:
        """The number of each word, good until the next call; new ones are laid out."""
        for w in self.passing:
            del self.index[w]
        self.size, self.passing = self.stay, []
        found = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        lacking = np.flatnonzero(found < 0).tolist()
        if lacking:
            unknown = [words[i] for i in lacking]
            new = list(dict.fromkeys(unknown))
            self._append(new)
            if self.size[1] <= MOST_PLACES:
                self.stay = self.size
            else:
                self.passing = new
            found[lacking] = list(map(self.index.__getitem__, unknown))
        return found

    def _put(self, name: str, at: int, data: np.ndarray) -> None:
        held = self._held.get(name)
        if held is None or at + len(data) > len(held):
            grown = np.empty((at + len(data)) * 5 // 4, data.dtype)
            if held is not None:
                grown[:at] = held[:at]
            self._held[name] = held = grown
        held[at:at + len(data)] = data
        setattr(self, name, held[:at + len(data)])

    def _append(self, new: list[str]) -> None:
        part, (words, places, edges, spells) = Lattices(new, self.vocab), self.size
        self.index.update(zip(new, range(words, words + len(new)), strict=True))
        self._put("start", words, part.start + places)
        self._put("stop", words, part.stop + places)
        self._put("at", edges, (part.at + places).astype(np.int32))
        self._put("first", places, part.first + edges)
        self._put("last", places, part.first[1:] + (edges - 1))
        self._put("spell_first", edges, part.spell_first + np.int32(spells))
        for name in ("length", "piece", "spell_count", "log_share", "through"):
            self._put(name, edges, getattr(part, name))
        self._put("spelled", spells, part.spelled)
        self.size = (words + len(new), places + len(part.first) - 1, edges + len(part.at), spells + len(part.spelled))

    def left_beside(self, edges: np.ndarray) -> np.ndarray:
        """Log-share of all other edges of each edge's place, exactly nothing where there are none."""
        place = self.at[edges]
        some = self.last[place] > self.first[place]
        with np.errstate(divide="ignore"):
            return np.log(np.where(some, np.maximum(-np.expm1(self.log_share[edges]), 0.0), 0.0))

    def numbers(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of a row of edges, and how many each edge has."""
        ids, counts = self.piece[edges], self.spell_count[edges].astype(np.int64)
        if not (ids < 0).any():
            return ids, counts
        out = np.repeat(ids, counts)
        within = np.arange(len(out)) - np.repeat(np.cumsum(counts) - counts, counts)
        odd = out < 0
        out[odd] = self.spelled[(np.repeat(self.spell_first[edges], counts) + within)[odd]]
        return out, counts

    def choose(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each place, by its share."""
        e, last = self.first[place], self.last[place]
        more = np.flatnonzero((self.through[e] < u) & (e < last))
        while len(more):
            e[more] += 1
            now = e[more]
            more = more[(self.through[now] < u[more]) & (now < last[more])]
        return e


class _Path:
    """Sampled steps of all texts of a slice for one rank, by text: from the step where a path leaves its parent."""

    def __init__(self, n: int):
        self.head = np.zeros(n + 1, np.int64)
        self.edge = self.place = self.occ = np.zeros(0, np.int64)
        self.before = self.value = np.zeros(0)
        self.parent = np.full(n, -1)
        self.step = np.zeros(n, np.int64)


def _sure(path: _Path, texts: np.ndarray, k: int) -> bool:
    """Whether the ``k`` greatest values of each text are beyond all that steps below ``FAR`` could have."""
    for d in texts.tolist():
        value = path.value[path.head[d]:path.head[d + 1]]
        if len(value) < k or np.partition(value, -k)[-k] <= FAR + GAIN:
            return False
    return True


def _greatest(path: _Path, best: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest value in the queue of each text that the path goes through, and the first step that has it."""
    filled = np.flatnonzero(path.head[1:] > path.head[:-1])
    if not len(filled):
        return best, where
    heads = path.head[filled]
    tops = np.maximum.reduceat(path.value, heads)
    having = np.flatnonzero(path.value == np.repeat(tops, path.head[filled + 1] - heads))
    best, where = best.copy(), where.copy()
    best[filled], where[filled] = tops, having[np.searchsorted(having, heads)]
    return best, where


def _sibling(lat: WordStore, place: np.ndarray, barred: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge of each place by its share, barred ones left out, and the log-share of all others that are not barred."""
    lo, count = lat.first[place], lat.last[place] - lat.first[place] + 1
    beyond = np.arange(int(count.max()))
    edges = np.minimum(lo[:, None] + beyond, len(lat.at) - 1)
    share = np.where(beyond < count[:, None], np.exp(lat.log_share[edges]), 0.0)
    shut = (edges[:, :, None] == barred[:, None, :]).any(axis=2)
    share[shut] = 0.0
    sums = np.cumsum(share, axis=1)
    e = np.minimum((sums <= (u * sums[:, -1])[:, None]).sum(axis=1), count - 1)
    row = np.arange(len(e))
    while (wrong := shut[row, e] & (e > 0)).any():
        e[wrong] -= 1
    share[row, e] = 0.0
    rest = np.where(count > (barred >= 0).sum(axis=1) + 1, share.sum(axis=1), 0.0)
    with np.errstate(divide="ignore"):
        return lo + e, np.log(rest)


def _walk(lat: WordStore, occ: np.ndarray, node: np.ndarray, word: np.ndarray, offset: np.ndarray, key: np.ndarray, rank: int, given: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sample from given places to the ends of their words: ``occurrence, place, edge`` in reading order.

    ``given``: occurrences and edges that come before the sampled ones of these occurrences.
    """
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if given is not None:
        parts.append((given[0], lat.at[given[1]].astype(np.int64), given[1]))
    live = node < lat.stop[word[occ]]
    occ, node = occ[live], node[live]
    while len(occ):
        u = uniforms(key[occ], 2 * rank, offset[occ] + node - lat.start[word[occ]])
        e = lat.choose(node, u)
        parts.append((occ, node, e))
        node = node + lat.length[e]
        live = node < lat.stop[word[occ]]
        occ, node = occ[live], node[live]
    count = np.zeros(len(word), np.int64)
    for o, _, _ in parts:
        count[o] += 1
    first = np.cumsum(count) - count
    total = int(count.sum())
    out = tuple(np.empty(total, np.int64) for _ in range(3))
    done = np.zeros(len(word), np.int64)
    for o, p, e in parts:
        at = first[o] + done[o]
        for column, values in zip(out, (o, p, e), strict=True):
            column[at] = values
        done[o] += 1
    return out


def sample_slice(texts: list[str], keys: np.ndarray, lat: WordStore, k: int) -> list[list[tuple[float, float, float, np.ndarray]]]:
    """For each text its samples ``log-probability, perturbed value, inclusion probability, piece numbers``, best first.

    A text with fewer than ``k`` segmentations gives them all, with inclusion probability 1.
    """
    n = len(texts)
    words: list[str] = []
    counts = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        if t:
            before = len(words)
            words += t.split(" ")
            counts[i] = len(words) - before
    if not words:
        return [[(0.0, 0.0, 1.0, np.zeros(0, np.int64))] for _ in texts]
    word = lat.numbers_of(words)
    doc = np.repeat(np.arange(n), counts)
    doc_first = np.concatenate([[0], np.cumsum(counts)])
    width = (lat.stop - lat.start)[word]
    offset = np.cumsum(width) - width
    offset -= np.repeat(offset[np.minimum(doc_first[:-1], len(offset) - 1)], counts)
    key = keys[doc]
    top = -np.log(-np.log(uniforms(keys, 1, np.zeros(n, np.int64))))
    paths: list[_Path] = []
    bound, start_before = top.copy(), np.zeros(n)
    best = np.full((k, n), NONE)
    where = np.zeros((k, n), np.int64)
    value = np.full((k, n), NONE)
    value[0] = np.where(counts > 0, top, NONE)
    going = np.zeros(0, np.int64)  # texts whose next path starts with a sibling, and the log-mass left beside it
    beside = np.zeros(0)
    log_prob = np.zeros((k, n))
    gone = np.full((k, n, k), -1, np.int64)  # edges that the first step of a path could not take
    threshold = np.full(n, NONE)
    for rank in range(k + 1):
        if rank:
            source = best[:rank].argmax(axis=0)
            high = best[source, np.arange(n)]
            if rank == k:
                threshold = high
                break
            path = _Path(n)
            going = np.flatnonzero(high > NONE)
            if not len(going):
                break
            from_, step = source[going], where[source[going], going]
            place, occ, edge, before, barred = (np.zeros(len(going), np.int64 if j != 3 else float) if j < 4 else np.full((len(going), k), -1, np.int64) for j in range(5))
            for i in range(rank):
                mine = np.flatnonzero(from_ == i)
                if not len(mine):
                    continue
                q, at, d = paths[i], step[mine], going[mine]
                place[mine], occ[mine], edge[mine], before[mine] = q.place[at], q.occ[at], q.edge[at], q.before[at]
                barred[mine] = np.where(((at == q.head[d]) & (q.parent[d] >= 0))[:, None], gone[i, d], -1)
                q.value[at] = NONE  # the opened step leaves the queue of its path
                best[i], where[i] = _greatest(q, best[i], where[i])
            barred[:, rank - 1] = edge
            u = uniforms(keys[going], 2 * rank, offset[occ] + place - lat.start[word[occ]])
            e, beside = _sibling(lat, place, barred, u)
            gone[rank, going] = barred
            path.parent[going], path.step[going] = from_, step
            value[rank, going], bound[going], start_before[going] = high[going], high[going], before
            stay = doc_first[going + 1] - occ
            first = np.cumsum(stay) - stay
            occs = np.arange(int(stay.sum())) + np.repeat(occ - first, stay)
            nodes = lat.start[word[occs]]
            nodes[first] = place + lat.length[e]
            o, p, e = _walk(lat, occs, nodes, word, offset, key, rank, (occ, e))
        else:
            path = _Path(n)
            o, p, e = _walk(lat, np.arange(len(word)), lat.start[word], word, offset, key, 0)
        path.occ, path.place, path.edge = o, p, e
        owner = doc[o]
        path.head = np.searchsorted(owner, np.arange(n + 1))
        share = lat.log_share[e]
        run = np.cumsum(share)
        base = np.concatenate([[0.0], run])[path.head[:-1]]
        path.before = run - share - base[owner] + start_before[owner]
        # siblings far down have next to no mass: their values need not be drawn where greater ones are there
        for cut in (FAR, NONE):
            some = np.flatnonzero(path.before >= cut)
            path.value = np.full(len(e), NONE)
            left = lat.left_beside(e[some])
            if rank:
                at = np.searchsorted(some, path.head[going])
                there = at < len(some)
                there[there] = some[at[there]] == path.head[going][there]
                left[at[there]] = beside[there]
            mass = path.before[some] + left
            spread = -np.log(uniforms(key[o[some]], 2 * rank + 1, offset[o[some]] + p[some] - lat.start[word[o[some]]]))
            with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                path.value[some] = np.where(mass > NONE, mass - np.log(np.exp(np.minimum(mass - bound[owner[some]], 700)) + spread), NONE)
            if len(some) == len(e):
                break
            if _sure(path, np.unique(owner[path.before < cut]), k):
                break
        filled = np.flatnonzero(path.head[1:] > path.head[:-1])
        best[rank], where[rank] = _greatest(path, best[rank], where[rank])
        log_prob[rank, filled] = run[path.head[filled + 1] - 1] - base[filled] + start_before[filled]
        paths.append(path)
    return _collect(lat, paths, value, log_prob, threshold, counts)


def _collect(lat: WordStore, paths: list[_Path], value: np.ndarray, log_prob: np.ndarray, threshold: np.ndarray, counts: np.ndarray) -> list:
    """The samples of each text: a path's own steps behind those that it shares with its parents."""
    out: list[list] = [[] if c else [(0.0, 0.0, 1.0, np.zeros(0, np.int32))] for c in counts.tolist()]
    ids_of: list[tuple[np.ndarray, np.ndarray]] = []
    for path in paths:
        ids, many = lat.numbers(path.edge)
        ids_of.append((ids, np.concatenate([[0], np.cumsum(many)])))
    with np.errstate(over="ignore"):
        chance = -np.expm1(-np.exp(np.minimum(log_prob - threshold, 700)))
    for rank in range(len(paths)):
        for d in np.flatnonzero(value[rank] > NONE).tolist():
            parts, path, i, stop = [], paths[rank], rank, int(paths[rank].head[d + 1])
            while True:
                ids, cut = ids_of[i]
                parts.append(ids[cut[path.head[d]]:cut[stop]])
                if path.parent[d] < 0:
                    break
                i, stop = int(path.parent[d]), int(path.step[d])
                path = paths[i]
            sure = threshold[d] == NONE
            out[d].append((float(log_prob[rank, d]), float(value[rank, d]), 1.0 if sure else float(chance[rank, d]), np.concatenate(parts[::-1]) if len(parts) > 1 else parts[0]))
    return out


def sampled(batches: Iterator[pa.RecordBatch], model_file: str, k: int, decoded: bool = False) -> Iterator[pa.RecordBatch]:
    """The samples of batches of ``doc_id, key, text``. The lattices are one task's: a worker that waits for its next task holds none."""
    lat = WordStore(vocabulary(model_file))
    for part in slices(batches, "text", SLICE_BYTES):
        keys = part.column(1).to_numpy().view(np.uint64)
        found = sample_slice([t or "" for t in part.column(2).to_pylist()], keys, lat, k)
        flat = [(i, r + 1, *s) for i, samples in enumerate(found) for r, s in enumerate(samples)]
        ids = part.column(0).take(pa.array([f[0] for f in flat], pa.int64()))
        cuts = np.concatenate([[0], np.cumsum([len(f[5]) for f in flat])])
        pieces = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([f[5] for f in flat]).astype(np.int32)))
        texts = [pa.array([lat.vocab.decode(f[5]) for f in flat], pa.binary()).cast(pa.string())] if decoded else []
        yield pa.RecordBatch.from_arrays([ids, pa.array([f[1] for f in flat], pa.int32()), *(pa.array([f[j] for f in flat], pa.float64()) for j in (2, 3, 4)), pieces, *texts],
                                         ["doc_id", "rank", "log_prob", "perturbed", "inclusion", "pieces", *["text"][:len(texts)]])


def sample(docs: DataFrame, model_file: str, k: int = SAMPLES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Up to ``k`` rows per row of ``docs``: ``doc_id, rank, log_prob, perturbed, inclusion, pieces``.

    ``decoded``: also ``text``, the pieces decoded where they are made, which spares them a second way to Python.

    Ranks count from 1 in falling order of the perturbed values. Null and empty texts have one segmentation, without
    pieces. A row's samples depend on its id, ``seed`` and its text only; repeated rows repeat them; a null id is a key like
    any other. An empty table gives an empty result.
    """
    source = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("key"), "text")

    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, rank int, log_prob double, perturbed double, inclusion double, pieces array<int>"
    return source.mapInArrow(lambda batches: sampled(batches, model_file, k, decoded), schema + (", text string" if decoded else ""))


def decode(pieces: DataFrame, model_file: str, column: str = "pieces", into: str = "text") -> DataFrame:
    """``pieces`` with the text of a column of piece numbers; nulls give null. Other columns stay (a column ``into`` is replaced)."""
    from pyspark.sql import types as T

    keep = [c for c in pieces.columns if c.lower() != into.lower()]
    source = pieces.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(column)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_file)
        for batch in batches:
            column_ = batch.column(at)
            cuts, flat, there = column_.offsets.to_numpy(), column_.values.to_numpy(), column_.is_valid().to_pylist()
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [vocab.decode(flat[cuts[j]:cuts[j + 1]]) if there[j] else None for j in range(i, i + part.num_rows)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*part.schema.names, into])

    return source.mapInArrow(rows, T.StructType([*source.schema.fields, T.StructField(into, T.StringType())]))
