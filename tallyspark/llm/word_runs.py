"""Periodic runs of words, found on a grammar of each text.

A run is a stretch of consecutive words with smallest period q, at least max(LEAST, 3 * q) words long, that no neighbour
extends. Where no run can be, nothing is built: in a run every eight words stand once more in the text, so only stretches of
such places go on. Each stretch then is compressed by Re-Pair over its word numbers, in rounds: every pair of neighbours that stands
twice or more may become a nonterminal, pairs that overlap give way to the more frequent (by powers of two, then by a hash), and rounds end
when no pair stands twice; what is left is paired up to one root. Each replacement is a place in the derivation where the nonterminal stands.

Every run has a lowest nonterminal that contains it, and crosses the boundary between its two halves. So runs are computed once for each
nonterminal, not for each of its places: a period is a distance at which the four words before or after the boundary stand again, and common
extensions to both sides (ranks of all strings of 1, 2, 4, ... words, by doubling) say how far it holds. The runs found are carried to all places
of the nonterminal; of intervals of one period the maximal ones are the text's runs.

Null and empty texts have no words and no runs. Repeated rows get equal results; a null doc_id's text isn't made periodic by ``planted``. All
work of a text stays in one task, its memory some hundred bytes a word of a stretch. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import common

LEAST, TIMES = 24, 3
#: Words that stand again at every place of a run but its last ones, and the words looked for beside a boundary. They follow from LEAST and TIMES.
AGAIN, BESIDE = 8, 4
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def stretches_of(words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) in the words of all texts in turn, where runs may be. words: equal numbers for equal words; ends: where each text ends."""
    n = len(words)
    if n < LEAST:
        return []
    text = np.searchsorted(ends, np.arange(n), side="right")
    h, step = _mixed(words.astype(_U) + _mixed(text.astype(_U) + _U(1))), 1
    while step < AGAIN:
        h, step = _mixed(h[:-step] * _U(3) + h[step:]), step * 2
    again = pd.Series(h).duplicated(keep=False).to_numpy()  # a hash that two places share by chance only costs time
    again &= text[: len(h)] == text[AGAIN - 1 :]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], again.view(np.int8), [0]])))
    fits = edge[1::2] - edge[::2] >= LEAST - AGAIN + 1
    out = []
    for a, b in zip(edge[::2][fits].tolist(), edge[1::2][fits].tolist()):
        # marked places of two texts may touch
        cuts = [a, *ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, b, "left")].tolist(), b]
        out += [(x, y + AGAIN - 1) for x, y in zip(cuts, cuts[1:]) if y - x >= LEAST - AGAIN + 1]
    return out


class _Grammar:
    """Nonterminals of several sequences that share no symbol: halves' sizes, and the places where each stands."""

    def __init__(self, symbols: np.ndarray, owner: np.ndarray):
        self.left, self.size, self.node, self.place = [], [], [], []
        n = self.nodes = 0
        at, size, first = np.arange(len(symbols)), np.ones(len(symbols), np.int64), int(symbols.max()) + 1 if len(symbols) else 0
        self.first = first
        while len(symbols) > 1:
            found, pair, often = np.unique(symbols[:-1] * (first + self.nodes) + symbols[1:], return_inverse=True, return_counts=True)
            weight = (np.frexp(often)[1].astype(_U) << _U(56)) | (_mixed(found.astype(_U)) >> _U(8))
            weight[often < 2] = 0
            take = self._peaks(weight[pair])
            if not take.any():
                break
            symbols, at, size, owner = self._replaced(symbols, at, size, owner, take, pair)
        while len(symbols) > 1:  # no pair stands twice: up to one root each
            fresh = np.append(True, owner[1:] != owner[:-1])
            nth = np.arange(len(owner)) - np.maximum.accumulate(np.where(fresh, np.arange(len(owner)), 0))
            take = (nth[:-1] % 2 == 0) & (owner[1:] == owner[:-1])
            if not take.any():
                break
            symbols, at, size, owner = self._replaced(symbols, at, size, owner, take, np.arange(len(take)))
        self.left, self.size, self.node, self.place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.left, self.size, self.node, self.place))

    @staticmethod
    def _peaks(weight: np.ndarray) -> np.ndarray:
        """Pairs heavier than both that they overlap; of equal ones in a row (a word repeated) every second."""
        fresh = np.append(True, weight[1:] != weight[:-1])
        start = np.flatnonzero(fresh)
        value = weight[start]
        padded = np.concatenate([[0], value, [0]])
        peak = (value > padded[:-2]) & (value > padded[2:])
        run = np.cumsum(fresh) - 1
        return peak[run] & ((np.arange(len(weight)) - start[run]) % 2 == 0)

    def _replaced(self, symbols, at, size, owner, take, pair):
        spot = np.flatnonzero(take)
        kinds, one, new = np.unique(pair[spot], return_index=True, return_inverse=True)
        self.left.append(size[spot[one]])
        self.size.append(size[spot[one]] + size[spot[one] + 1])
        self.node.append(new + self.nodes)
        self.place.append(at[spot])
        symbols, size = symbols.copy(), size.copy()
        symbols[spot] = new + self.nodes + self.first
        size[spot] += size[spot + 1]
        self.nodes += len(kinds)
        stay = np.ones(len(symbols), bool)
        stay[spot + 1] = False
        return symbols[stay], at[stay], size[stay], owner[stay]


class _Extensions:
    """How far two places agree, forward and backward, by ranks of the strings of 1, 2, 4, ... words."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.ranks = [symbols.astype(np.int64)]
        while (1 << len(self.ranks)) <= longest:
            half, last = 1 << (len(self.ranks) - 1), self.ranks[-1]
            if len(last) <= half:
                break
            found, rank = np.unique(last[:-half] * (len(symbols) + 1) + last[half:], return_inverse=True)
            self.ranks.append(rank)
            if len(found) == len(rank):  # no longer string stands twice
                break

    def forward(self, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
        far = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            r, fits = self.ranks[k], np.flatnonzero(j + far + (1 << k) <= end)
            far[fits[r[i[fits] + far[fits]] == r[j[fits] + far[fits]]]] += 1 << k
        return far

    def backward(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        far = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            r, fits = self.ranks[k], np.flatnonzero(i - far - (1 << k) >= begin)
            back = far[fits] + (1 << k)
            far[fits[r[i[fits] - back] == r[j[fits] - back]]] += 1 << k
        return far


def _expanded(low: np.ndarray, high: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, value) for all values from low to high of each, some ``most`` at a time."""
    many = np.maximum(high - low, 0)
    total, at = np.cumsum(many), 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        some = many[at:to]
        which = np.repeat(np.arange(at, to), some)
        yield which, np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + low[which]
        at = to


def _boundary_runs(symbols: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """node, start, end, period of the runs that cross the middle of [begin, end), clipped to it; start and end within the node."""
    if not len(begin):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    ext = _Extensions(symbols, int((end - begin).max()))
    if len(ext.ranks) < 3:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    n, beside, most = len(symbols), ext.ranks[2], (end - begin) // TIMES
    order = np.argsort(beside, kind="stable")
    keys = beside[order] * n + order
    found = []
    # the four words after the boundary stand again behind them, or the four before it stand before them
    for spot, low, high in ((middle, middle + 1, np.minimum(middle + most, end - BESIDE)), (middle - BESIDE, np.maximum(middle - BESIDE - most, begin), middle - BESIDE - 1)):
        fits = np.flatnonzero((spot >= begin) & (spot + BESIDE <= end) & (low <= high))
        base = beside[np.minimum(spot[fits], len(beside) - 1)] * n
        for which, k in _expanded(np.searchsorted(keys, base + low[fits]), np.searchsorted(keys, base + high[fits], side="right")):
            node = fits[which]
            other, b = order[k], middle[node]
            q = np.abs(other - spot[node])
            i = np.where(other > spot[node], b, b - q)
            ahead, behind = ext.forward(i, i + q, end[node]), ext.backward(i, i + q, begin[node])
            start, stop = i - behind, i + q + ahead
            good = stop - start >= np.maximum(LEAST, TIMES * q)
            found.append(np.stack([node[good], (start - begin[node])[good], (stop - begin[node])[good], q[good]]))
    node, start, stop, q = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    # a stretch with several periods is a run of the smallest
    order = np.lexsort((q, stop, start, node))
    node, start, stop, q = node[order], start[order], stop[order], q[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    return node[new], start[new], stop[new], q[new]


def runs_of(texts: list[list[str]]) -> list[np.ndarray]:
    """For each text (its words) its runs: rows of start, length, period, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    numbers = np.fromiter((hash(w) for t in texts for w in t), np.int64, total).view(_U)
    spans = stretches_of(numbers, ends)
    out: list[np.ndarray] = [np.zeros((0, 3), np.int64) for _ in texts]
    if not spans:
        return out
    # the stretches one after the other, symbols numbered by stretch and word
    known: dict[tuple[int, str], int] = {}
    text = np.searchsorted(ends, [a for a, _ in spans], side="right")
    base = np.array([a for a, _ in spans]) - (ends - sizes)[text]
    symbols = np.fromiter((known.setdefault((s, w), len(known)) for s, ((a, b), t, at) in enumerate(zip(spans, text.tolist(), base.tolist())) for w in texts[t][at : at + b - a]), np.int64)
    del known
    long = np.array([b - a for a, b in spans])
    owner = np.repeat(np.arange(len(spans)), long)
    g = _Grammar(symbols, owner)
    firsts = np.full(g.nodes, -1, np.int64)
    firsts[g.node[::-1]] = g.place[::-1]
    large = np.flatnonzero(g.size >= LEAST)
    node, start, stop, q = _boundary_runs(symbols, firsts[large], firsts[large] + g.left[large], firsts[large] + g.size[large])
    node = large[node]
    # to all places of each nonterminal
    order = np.argsort(g.node, kind="stable")
    low, high = np.searchsorted(g.node[order], node), np.searchsorted(g.node[order], node, side="right")
    parts = [np.zeros((4, 0), np.int64)]
    for which, k in _expanded(low, high):
        place = g.place[order[k]]
        parts.append(np.stack([owner[place], q[which], place + start[which], place + stop[which]]))
    own, q, start, stop = np.concatenate(parts, axis=1)
    begins = np.cumsum(long) - long
    start, stop = start - begins[own] + base[own], stop - begins[own] + base[own]
    # intervals of one period: only those that no other contains
    order = np.lexsort((-stop, start, q, own))
    own, q, start, stop = own[order], q[order], start[order], stop[order]
    group = np.cumsum(np.append(True, (own[1:] != own[:-1]) | (q[1:] != q[:-1]))) if len(own) else own
    far = stop + group * (int(stop.max(initial=0)) + 1)
    new = np.ones(len(own), bool)
    new[1:] = far[1:] > np.maximum.accumulate(far)[:-1]
    rows = np.stack([text[own[new]], start[new], (stop - start)[new], q[new]], axis=1)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    for t in np.unique(rows[:, 0]).tolist():
        out[t] = rows[cuts[t] : cuts[t + 1], 1:]
    return out


def best_of(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest length to period, exactly; ties: smallest start, then period."""
    best = None
    for start, length, q in runs.tolist():
        if best is None or length * best[2] > best[1] * q:
            best = (start, length, q)
    return best


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """Every tenth text, by crc32 of doc_id, made periodic from some word on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def kept_words(words: list[str], runs: np.ndarray) -> list[str]:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
_RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _each(batch: pa.RecordBatch, plant: bool) -> Iterator[tuple[int | None, np.ndarray, str]]:
    """doc_id, runs, text without what repeats, for each row."""
    ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
    for i, j in common.slices(texts):
        words = [_WORD.findall(t) for t in texts[i:j]]
        if plant:
            words = [planted(w, d) for w, d in zip(words, ids[i:j])]
        for d, w, runs in zip(ids[i:j], words, runs_of(words)):
            yield d, runs, " ".join(kept_words(w, runs))


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs, collapsed: the words outside all runs' repetitions, joined by one space."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"doc_id": d, "runs": [{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()], "collapsed": c} for d, runs, c in _each(b, False)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))), ("collapsed", pa.string())]))

    return common.texts_of(docs).mapInArrow(find, _RUNS)


def digest_runs(docs: DataFrame, plant: bool = True) -> DataFrame:
    """doc_id, n_runs, the strongest run, and hashes of all runs and of the collapsed text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, runs, collapsed in _each(b, plant):
                best = best_of(runs)
                told = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
                row = (d, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest())
                rows.append(dict(zip(_OUT.names, row)))
            yield pa.RecordBatch.from_pylist(rows, schema=_OUT)

    return common.texts_of(docs).mapInArrow(digest, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _OUT))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_runs(common.table(spark, sf_dir, "documents"))
