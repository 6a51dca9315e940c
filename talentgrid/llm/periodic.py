"""Periodic runs of words, found by internal pattern matching.

The words of a text are numbered, and its suffixes are sorted by prefix doubling: after round
k the classes of the suffix array are the texts' equal stretches of 2^k words. For every
dyadic block (2^k words at a multiple of 2^k) the occurrences in the neighbouring window are
asked for: a wavelet tree over the suffix array answers range-successor queries (the first
occurrence at or after a place) inside the block's suffix range. A run of period q in
[2^k, 2^(k+1)) that holds three periods holds such a block together with its repetition q
words later, and the occurrences that begin within 2^k places form an arithmetic
progression:

* one occurrence: its distance is the candidate period;
* several: block and occurrences lie in stretches of the progression's own (smaller) period;
  the run's period is then the distance between the ends of those two stretches, or between
  their starts;
* periods below 8 belong to the blocks of 8 words, where the next occurrence is the only
  candidate.

Candidates of equal period that touch are merged and extended to both sides; what reaches
three periods is a run. A stretch that has a smaller period is known by it alone.

Texts never meet: classes are kept apart by document, so a slab of many short texts costs a
few array operations, and positions whose words occur once drop out after the first rounds.
Work per text of n words is O(n log n); memory is a constant number of numbers per word.
There is no shuffle.

Defined results: a null text has no words, so no runs and an empty collapsed text; texts of
any length are taken whole (one text is the largest unit); repeated rows and ids, null ids
and ties give one result per row; an empty table gives an empty result; columns other than
the id and the text are not looked at.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of one slab of short texts.
SLAB_WORDS = 200_000
#: Elements of one two-dimensional comparison.
GRID = 1 << 21
#: Log2 of the smallest block.
FIRST = 3
MIN_LENGTH = 24
OUT_ROWS = 256

RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Wavelet:
    """Wavelet tree (as a matrix of bit planes) over a permutation of 0..m-1."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        v, self.planes = values.astype("int64"), []
        for b in reversed(range(max(1, (self.size - 1).bit_length()))):
            one = (v >> b) & 1 == 1
            zeros = np.zeros(self.size + 1, "int64")
            np.cumsum(~one, out=zeros[1:])
            self.planes.append((b, zeros, int(zeros[-1])))
            v = np.concatenate([v[~one], v[one]])

    def below(self, lo, hi, x):
        """How many of values[lo:hi] are smaller than x (arrays)."""
        every = x >= self.size
        out = np.zeros(len(lo), "int64")
        l, r = lo, hi
        for b, zeros, n in self.planes:
            zl, zr = zeros[l], zeros[r]
            one = (x >> b) & 1 == 1
            out += np.where(one, zr - zl, 0)
            l, r = np.where(one, n + l - zl, zl), np.where(one, n + r - zr, zr)
        return np.where(every, hi - lo, out)

    def nth(self, lo, hi, k):
        """The value with k smaller ones in values[lo:hi]."""
        out = np.zeros(len(lo), "int64")
        l, r = lo, hi
        for b, zeros, n in self.planes:
            zl, zr = zeros[l], zeros[r]
            one = k >= zr - zl
            out |= one.astype("int64") << b
            k = np.where(one, k - (zr - zl), k)
            l, r = np.where(one, n + l - zl, zl), np.where(one, n + r - zr, zr)
        return out


def _agree(code: np.ndarray, i: np.ndarray, p: np.ndarray, step: int, cap: int | None = None) -> np.ndarray:
    """For how many t = 0, 1, .. code[i + step t] equals code[i + step t + p]; ``cap`` ends
    the count. ``code`` begins and ends with numbers that occur nowhere else."""
    n, last = np.zeros(len(i), "int64"), len(code) - 1
    open_, width = np.arange(len(i)), 16
    while len(open_):
        w = max(1, min(width, GRID // len(open_)))
        for part in np.array_split(open_, -(-len(open_) * w // GRID)):
            at = np.clip((i[part] + step * n[part])[:, None] + step * np.arange(w), 0, last)
            differ = code[at] != code[np.minimum(at + p[part][:, None], last)]
            n[part] += np.where(differ.any(1), differ.argmax(1), w)
            n[part] = np.where(differ.any(1), -n[part] - 1, n[part])  # done: marked by the sign
        done = n[open_] < 0
        n[open_[done]] = -n[open_[done]] - 1
        open_ = open_[~done]
        if cap is not None:
            open_ = open_[n[open_] < cap]
        width *= 2
    return n if cap is None else np.minimum(n, cap)


def _classes(code: np.ndarray, longest: np.ndarray):
    """Suffix array of the slab by prefix doubling, kept for places whose first 8 words
    occur again in their text, and per level (k, places, first slot, end slot) of the
    dyadic blocks that occur again. ``longest`` is the number of words of each place's text."""
    n = len(code)
    order = np.argsort(code, kind="stable")
    sorted_ = code[order]
    edge = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    size = np.diff(np.append(edge, n))
    rank = np.empty(n, "int64")
    rank[order] = np.repeat(edge, size)
    sa = order.copy()
    live, k, levels, kept = order[np.repeat(size > 1, size)], 0, [], None
    while len(live):
        # rank holds classes of 2^k words: pairs of them are those of twice as many
        live = live[longest[live] >= 3 << k] if k >= FIRST else live
        if k >= FIRST:
            if kept is None:
                kept = np.sort(rank[live]) if len(live) else live
                kept = kept + _running(kept) if len(kept) else kept
            here = live[live % (1 << k) == 0]
            levels.append((k, here, rank[here], rank[here] + _sizes(rank, live)[here]))
        if not len(live):
            break
        key = rank[live] * n + rank[live + (1 << k)]
        o = np.argsort(key, kind="stable")
        live, key = live[o], key[o]
        old = rank[live]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        first = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        start = np.repeat(first, np.diff(np.append(first, len(live))))
        sa[old + np.arange(len(live)) - start] = live
        size = np.diff(np.append(new, len(live)))
        rank[live] = np.repeat(old[new] + new - start[new], size)
        live = live[np.repeat(size > 1, size)]
        k += 1
    return sa, kept if kept is not None else np.zeros(0, "int64"), levels


def _running(sorted_: np.ndarray) -> np.ndarray:
    """0, 1, 2, .. within every run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return np.arange(len(sorted_)) - np.repeat(first, np.diff(np.append(first, len(sorted_))))


def _sizes(rank: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Class size at every live place (an array over all places)."""
    out = np.zeros(len(rank), "int64")
    _, inverse, count = np.unique(rank[live], return_inverse=True, return_counts=True)
    out[live] = count[inverse]
    return out


def find(code: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Runs (start, end, period) of a slab, by start, then period. Texts in ``code`` stand
    between numbers that occur once, and share no number."""
    sa, slots, levels = _classes(code, longest)
    empty = np.zeros((0, 3), "int64")
    if not len(slots):
        return empty
    places = np.sort(sa[slots])
    tree = Wavelet(np.searchsorted(places, sa[slots]))
    found = [empty]
    for k, block, lo, hi in levels:
        if not len(block):
            continue
        width = 1 << k
        a = np.searchsorted(slots, lo)
        b = a + hi - lo
        at = lambda x: np.searchsorted(places, x)
        if k == FIRST:
            c = tree.below(a, b, at(block + 1))
            some = c < b - a
            nxt = places[tree.nth(a[some], b[some], c[some])] - block[some]
            near = nxt < width
            found.append(np.stack([block[some][near], np.full(near.sum(), width), nxt[near]], 1))
        c = tree.below(a, b, at(block + width))
        many = tree.below(a, b, at(block + 2 * width)) - c
        some = many > 0
        block, a, b, c, many = block[some], a[some], b[some], c[some], many[some]
        if not len(block):
            continue
        first = places[tree.nth(a, b, c)]
        one = many == 1
        found.append(np.stack([block[one], np.full(one.sum(), width), (first - block)[one]], 1))
        block, first, a, b, c = block[~one], first[~one], a[~one], b[~one], c[~one]
        if not len(block):
            continue
        p = places[tree.nth(a, b, c + 1)] - first
        # the stretches of period p around the block and around its occurrences
        cap = 4 * width
        right, right2 = _agree(code, block, p, 1, cap), _agree(code, first, p, 1, cap)
        left, left2 = _agree(code, block - 1, p, -1, cap), _agree(code, first - 1, p, -1, cap)
        for q, ok in ((first + right2 - block - right, (right < cap) & (right2 < cap)),
                      (first - left2 - block + left, (right < cap) & (left < cap) & (left2 < cap))):
            ok &= (q >= width) & (q < 2 * width)
            x, y = block[ok], q[ok]
            ok = _agree(code, x, y, 1, width) >= width
            found.append(np.stack([x[ok], np.full(ok.sum(), width), y[ok]], 1))
    start, width, q = np.concatenate(found).T
    if not len(start):
        return empty
    o = np.lexsort((start, q))
    start, end, q = start[o], (start + width)[o], q[o]
    # candidates of one period that touch are one stretch (they have one width, so ends rise)
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (start[1:] > end[:-1])])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(q) - 1)
    start, end, q = start[new], end[last], q[new]
    start, end = start - _agree(code, start - 1, q, -1), end + _agree(code, end, q, 1) + q
    long = end - start >= np.maximum(MIN_LENGTH, 3 * q)
    runs = np.unique(np.stack([start[long], end[long], q[long]], 1), axis=0)
    # a stretch that has a smaller period is a run of that one only
    runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(1)])] if len(runs) else empty
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _slab(texts: list[list[bytes]]):
    """Per text: runs (start, length, period) and the kept words."""
    sizes = np.array([len(t) for t in texts], "int64")
    base = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])  # a separator before, between and after
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for t in texts for w in t]
    n, words = len(texts), len(number)
    place = np.arange(len(ids)) + np.repeat(np.arange(n) + 1, sizes)
    code = np.full(len(ids) + n + 1, -1, "int64")
    code[place] = np.array(ids, "int64") + np.repeat(np.arange(n) * words, sizes)
    border = np.flatnonzero(code < 0)
    code[border] = n * words + np.arange(len(border))
    longest = np.zeros(len(code), "int64")
    longest[place] = np.repeat(sizes, sizes)
    runs = find(code, longest)
    if not len(runs):
        return [((), t) for t in texts]
    cover = np.zeros(len(code) + 1, "int64")
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 1], -1)
    keep = np.cumsum(cover) == 0
    owner = np.searchsorted(base, runs[:, 0], side="right") - 1
    out = [((), t) for t in texts]
    edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    for d, part in zip(owner[edge], np.split(runs, edge[1:])):
        at, text = base[d], texts[d]
        flags = keep[at:at + len(text)].tolist()
        out[d] = ([(int(s - at), int(e - s), int(q)) for s, e, q in part], [w for w, k in zip(text, flags) if k])
    return out


def _best(runs):
    """The run of greatest exponent; ties to the smaller start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def _rows(ids, texts):
    got = _slab(texts)
    plain = lambda r: None if r is None else {"start": r[0], "length": r[1], "period": r[2]}
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays(ids), pa.array([len(t) for t in texts], pa.int64()),
         pa.array([[plain(r) for r in runs] for runs, _ in got], pa.list_(run)),
         pa.array([plain(_best(runs)) for runs, _ in got], run),
         pa.array([b" ".join(kept).decode("utf-8", "replace") for _, kept in got], pa.string())],
        ["id", "n_words", "runs", "best", "collapsed"])


def _run(it):
    for batch in it:
        ids, texts, total = [], [], 0
        for at in range(batch.num_rows):
            words = (batch.column(1)[at].as_py() or b"").split()  # ASCII white space, as WORD has it
            ids.append(batch.column(0).slice(at, 1))
            texts.append(words)
            total += len(words) + 1
            if total >= SLAB_WORDS:
                yield from _cut(_rows(ids, texts))
                ids, texts, total = [], [], 0
        if texts:
            yield from _cut(_rows(ids, texts))


def _cut(batch):
    for at in range(0, batch.num_rows, OUT_ROWS):
        yield batch.slice(at, OUT_ROWS)


def runs(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_words, runs, best, collapsed): per row its runs (first word, number of words,
    smallest period) of at least three periods and 24 words, by start, then period; the run
    of greatest length / period; and the text without every word that some run holds beyond
    its first period."""
    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = x.schema["id"].dataType.simpleString()
    return x.mapInArrow(_run, f"id {kind}, n_words long, runs array<{RUN}>, best {RUN}, collapsed string")
