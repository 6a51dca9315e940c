"""Removal of repeated byte strings by a distributed, sampled suffix array.

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes.
Sorting the suffixes at every byte would move each text hundreds of times, so only the
suffixes at content-chosen places are sorted: of the places at which a window of ``length``
bytes can hold half of itself, the window's anchor is the one whose next bytes have the
smallest hash. Equal windows have their anchors at the same offset, so they are found among
the suffixes that share their leading ``lead`` bytes, each carrying the bytes that its
windows need.

1. Chunks of documents send the hashes of their anchors' leading bytes, packed, and learn
   which are met twice or more; other anchors have no equal window and go no further.
2. Splitters, quantiles of the leading bytes of a bounded sample of documents
   (``SAMPLE_DOCS``), range-partition the suffixes into buckets; a leading string that is
   several splitters at once is spread over all their buckets. The sample only balances.
3. A bucket sorts its suffixes by multikey quicksort and compares the windows of each run
   of equal leading bytes. Runs of a leading string that fills several buckets go on beyond
   the boundaries, and so their windows are compared across them: one digest per distinct
   window and bucket.
4. The repeated windows come back to their documents as byte ranges.

Runs are bounded by their bucket, buckets by the splitters, and what crosses boundaries is
at most one row per distinct window and bucket, so a passage found in a third of all
documents is spread like any other.

Defined results: a null text is empty; matches never cross documents; rows with equal id
and text are separate documents (each repeats the other); strings are judged on the input;
an empty table gives an empty result. Only the id and text columns are looked at.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import key_of
from talentgrid.llm.counting import PACKED, frequencies, often, pack, range_bits

LENGTH = 200
CHUNK_DOCS = 1024
SAMPLE_DOCS = 2000
BUCKET_SUFFIXES = 8192
#: Splitters at most; beyond, each range is dealt on by the hash of the leading bytes.
MAX_SPLITTERS = 4096
#: Bytes worked on together.
SLAB = 1 << 20
SORTED_BYTES = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(buffer: bytes) -> np.ndarray:
    """The 8 bytes from each place, as one number in byte order."""
    n = max(0, len(buffer) - 7)
    return np.ndarray((n,), ">u8", buffer, strides=(1,)).astype("uint64")


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class Anchors:
    """Anchors of the texts laid end to end in ``buffer``: ``at`` their places, ``first``
    and ``last`` the starts of the windows they stand for, ``doc`` the text's number,
    ``key`` a hash of their leading bytes."""

    def __init__(self, texts: list[bytes], length: int):
        self.buffer = b"".join(texts)
        sizes = np.array([len(t) for t in texts], "int64")
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        lead = length // 2
        width = length - lead + 1
        words = _words(self.buffer)
        n = len(self.buffer) - length + 1
        if n <= 0:
            self.at = self.first = self.last = self.doc = np.zeros(0, "int64")
            self.key = np.zeros(0, "uint64")
            return
        # cut alike in every slab: of equal hashes the first place wins, wherever the window stands
        low = np.uint64(32)
        place = (_mix(words) >> low << low) | np.arange(len(words), dtype="uint64")
        best = _sliding_min(place[:n + width - 1], width)[:n] & ((np.uint64(1) << low) - np.uint64(1))
        doc = np.repeat(np.arange(len(texts)), sizes)[:n]
        whole = np.arange(n) + length <= ends[doc]
        start = np.flatnonzero(whole)
        best, doc = best[start].astype("int64"), doc[start]
        new = np.ones(len(start), bool)
        new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        self.at, self.doc, self.first = best[head], doc[head], start[head]
        self.last = start[np.concatenate([head[1:], [len(start)]]) - 1] if len(head) else start[:0]
        key = np.full(len(self.at), lead, "uint64")
        for j in [*range(0, lead - 7, 8), lead - 8]:
            key = _mix(key * _ODD + words[self.at + j])
        self.key = key


def _slabs(texts: list[bytes]):
    """Runs of texts of about SLAB bytes: (number of the first, texts)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLAB:
            yield at, texts[at:i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def _texts(table) -> list[bytes]:
    return [t or b"" for t in table.column("text").to_pylist()]


def _packed(length: int, bits: int):
    def run(key, table):
        keys = [Anchors(ts, length).key for _, ts in _slabs(_texts(table))]
        return pack(key[0].as_py(), np.concatenate([*keys, np.zeros(0, "uint64")]), bits)
    return run


def sample_leads(docs: DataFrame, length: int, n_docs: int) -> tuple[list[bytes], float]:
    """Leading bytes of the anchors of about ``SAMPLE_DOCS`` documents, sorted, and the
    anchors of all documents as that sample has it. Rows are drawn where they are read, so
    no text is shuffled and copies of one text are drawn no more often than others."""
    def run(it):
        for batch in it:
            texts = [t or b"" for t in batch.column(0).to_pylist()]
            for _, ts in _slabs(texts):
                a = Anchors(ts, length)
                yield pa.RecordBatch.from_arrays([pa.array([a.buffer[p:p + SORTED_BYTES] for p in a.at.tolist()], pa.binary())], ["lead"])

    share = min(1.0, SAMPLE_DOCS / max(1, n_docs))
    drawn = docs.filter(F.rand(1) < share) if share < 1 else docs
    leads = sorted(bytes(r.lead) for r in drawn.select("text").mapInArrow(run, "lead binary").collect())
    return leads, len(leads) / share


def splitters(leads: list[bytes], buckets: int) -> list[bytes]:
    return [leads[len(leads) * i // buckets] for i in range(1, buckets)] if leads else []


_SUFFIX = "bucket long, chunk long, loc long, base long, at int, last int, open boolean, part binary"


def _suffixes(length: int, bits: int, shared, deals: int):
    """Chunk to the suffixes whose leading bytes are met twice or more. ``part`` holds the
    bytes from the first window's start to the last one's end, ``at`` the anchor's and
    ``last`` the last window's place in it, ``base`` the part's place in the text; ``open`` suffixes may have equals in other
    buckets."""
    def run(docs, answer):
        cuts = shared.value
        out = {c: [] for c in ("bucket", "loc", "base", "at", "last", "open", "part")}
        locs = docs.column("loc").to_pylist()
        for number, texts in _slabs(_texts(docs)):
            a = Anchors(texts, length)
            keep = np.flatnonzero(frequencies(answer, a.key, bits) >= 2)
            first, last, at, doc = (x[keep] for x in (a.first, a.last, a.at, a.doc))
            leads = np.array([a.buffer[p:p + SORTED_BYTES] for p in at.tolist()], f"S{SORTED_BYTES}")
            lo, hi = np.searchsorted(cuts, leads, "left"), np.searchsorted(cuts, leads, "right")
            # a leading string that is two or more splitters is spread over their buckets
            wide = hi - lo > 1
            spread = _mix((first + a.starts[doc]).astype("uint64") * _ODD + np.array([locs[number + d] for d in doc.tolist()], "int64").view("uint64"))
            lo = np.where(wide, lo + (spread % (hi - lo + 1).astype("uint64")).astype("int64"), hi)
            out["open"].append(wide.astype("int64"))
            out["bucket"].append(lo * deals + (a.key[keep] % np.uint64(deals)).astype("int64"))
            out["loc"] += [locs[number + d] for d in doc.tolist()]
            out["base"].append(first - a.starts[doc])
            out["at"].append(at - first)
            out["last"].append(last - first)
            out["part"] += [a.buffer[x:y] for x, y in zip(first.tolist(), (last + length).tolist())]
        cat = lambda c, t: pa.array(np.concatenate([*out[c], np.zeros(0, "int64")]).astype(t))
        n = len(out["part"])
        chunk = docs.column("chunk")[0].as_py() if docs.num_rows else 0
        return pa.table({"bucket": cat("bucket", "int64"), "chunk": pa.array([chunk] * n, pa.int64()),
                         "loc": pa.array(out["loc"], pa.int64()), "base": cat("base", "int64"),
                         "at": cat("at", "int32"), "last": cat("last", "int32"), "open": cat("open", bool), "part": pa.array(out["part"], pa.binary())})
    return run


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of numbers by multikey quicksort: three parts by the
    pivot in one column, the middle one going on with the next column."""
    out, todo = np.empty(len(words), "int64"), [(np.arange(len(words)), 0, 0)]
    while todo:
        rows, at, col = todo.pop()
        if len(rows) <= 64 or col == words.shape[1]:
            if col < words.shape[1]:
                rows = rows[np.lexsort(words[rows, col:].T[::-1])]
            out[at:at + len(rows)] = rows
            continue
        x = words[rows, col]
        few = np.sort(x[::max(1, len(x) // 31)])
        pivot = few[len(few) // 2]
        below, same = rows[x < pivot], rows[x == pivot]
        todo.append((below, at, col))
        todo.append((same, at + len(below), col + 1))
        todo.append((rows[x > pivot], at + len(below) + len(same), col))
    return out


_FOUND = "chunk long, loc long, start long, stop long, digest binary, n long"


def _resolved(length: int):
    """Bucket to byte ranges (chunk, loc, start, stop) that are repeated within it, and for
    its open suffixes one row per distinct window with its ``digest`` and count ``n``, and
    with a range where the bucket alone does not decide it."""
    lead = length // 2

    def run(table):
        chunk, loc, base = (np.asarray(table.column(c)) for c in ("chunk", "loc", "base"))
        parts = table.column("part").to_pylist()
        size = np.array([len(p) for p in parts], "int64")
        buffer = b"".join(parts) + bytes(8)
        begin = np.cumsum(size) - size
        at = np.asarray(table.column("at")).astype("int64")
        last = np.asarray(table.column("last")).astype("int64")
        words = _words(buffer)
        cols = [*range(0, lead - 7, 8), lead - 8]
        keys = np.stack([words[begin + at + j] for j in cols], 1)
        order = multikey_sort(keys)
        keys = keys[order]
        new = np.ones(len(order), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(1)
        run_no = np.empty(len(order), "int64")
        run_no[order] = np.cumsum(new) - 1
        outer = np.array(table.column("open").to_pylist(), bool)
        in_run = np.bincount(run_no)[run_no]
        live = np.flatnonzero(outer | (in_run > 1))
        if not len(live):
            return _found([], [], [], [], [], [])
        # digest of every window: two rolling sums over the bytes, at its own scale
        raw = np.frombuffer(buffer, "uint8").astype("uint64")
        count = last[live] + 1
        row = np.repeat(live, count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        place = begin[row] + step
        digests = []
        for seed in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95):
            factor = np.uint64(seed)
            power = _powers(factor, len(raw))
            sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum(_mix(raw + factor) * power[:-1], dtype="uint64")])
            back = _powers(np.uint64(pow(seed, -1, 1 << 64)), len(raw))
            digests.append((sums[place + length] - sums[place]) * back[place])
        # equal windows have their anchor, and so its leading bytes, at one offset
        mark = _mix(digests[0] * _ODD + _mix(digests[1] + (at[row] - step).astype("uint64")))
        _, which, n = np.unique(mark, return_inverse=True, return_counts=True)
        twice = n[which] > 1
        stretch = np.flatnonzero(twice)
        chunks, locs, starts, stops = _ranges(row[stretch], step[stretch], chunk, loc, base, length)
        out = [chunks, locs, starts, stops, [None] * len(chunks), [0] * len(chunks)]
        # what other buckets may repeat
        open_ = np.flatnonzero(outer[row])
        _, pick = np.unique(which[open_], return_index=True)
        pick = open_[pick]
        alone = ~twice[pick]
        d = [mark_.tobytes() for mark_ in np.stack([digests[0][pick], digests[1][pick]], 1)]
        put = lambda x: [int(v) if a else None for v, a in zip(x, alone)]
        begin_at = base[row[pick]] + step[pick]
        for o, x in zip(out, (put(chunk[row[pick]]), put(loc[row[pick]]), put(begin_at), put(begin_at + length), d, n[which[pick]].tolist())):
            o += x
        return _found(*out)
    return run


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    """1, factor, factor ** 2, ... modulo 2 ** 64."""
    out = np.full(n + 1, factor, "uint64")
    out[0] = 1
    return np.cumprod(out, dtype="uint64")


def _ranges(row, step, chunk, loc, base, length):
    """Runs of neighbouring windows of one suffix as byte ranges."""
    if not len(row):
        return [], [], [], []
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(row)]]) - 1
    r = row[head]
    return chunk[r].tolist(), loc[r].tolist(), (base[r] + step[head]).tolist(), (base[r] + step[tail] + length).tolist()


def _found(chunk, loc, start, stop, digest, n):
    long = pa.int64()
    return pa.table({"chunk": pa.array(chunk, long), "loc": pa.array(loc, long), "start": pa.array(start, long),
                     "stop": pa.array(stop, long), "digest": pa.array(digest, pa.binary()), "n": pa.array(n, long)})


_RANGES = "chunk long, loc long, start long, stop long"


def _routed(key, table):
    """Ranges of a chunk, and the windows of equal digest that came from other buckets:
    those met twice or more are ranges too. Overlapping ranges become one."""
    chunk, loc, start, stop, n = (table.column(c).to_numpy() for c in ("chunk", "loc", "start", "stop", "n"))
    digest = table.column("digest")
    far = np.asarray(digest.is_valid())
    keep = ~far
    if far.any():
        which = np.flatnonzero(far)
        _, same = np.unique(np.array(digest.filter(digest.is_valid()).to_pylist(), "S16"), return_inverse=True)
        often = np.bincount(same, n[which])[same] > 1
        keep[which[often & ~np.isnan(loc[which].astype("float64"))]] = True
    rows = pa.Table.from_arrays([table.column(c) for c in ("chunk", "loc", "start", "stop")], ["chunk", "loc", "start", "stop"]) \
        .filter(pa.array(keep))
    chunk, loc, start, stop = (rows.column(c).to_numpy().astype("int64") for c in rows.column_names)
    o = np.lexsort((start, loc, chunk))
    chunk, loc, start, stop = chunk[o], loc[o], start[o], stop[o]
    if len(o):
        doc = np.concatenate([[0], np.cumsum((chunk[1:] != chunk[:-1]) | (loc[1:] != loc[:-1]))]) << 40
        reach = np.maximum.accumulate(stop + doc)
        head = np.flatnonzero(np.concatenate([[True], (start + doc)[1:] > reach[:-1]]))
        tail = np.concatenate([head[1:], [len(o)]]) - 1
        chunk, loc, start, stop = chunk[head], loc[head], start[head], (reach - doc)[tail]
    return pa.table({"chunk": chunk, "loc": loc, "start": start, "stop": stop})


def _cut(texts: bool):
    """Documents and their ranges to what is left of them."""
    def run(docs, ranges):
        loc, start, stop = (np.asarray(ranges.column(c)) for c in ("loc", "start", "stop"))
        o = np.lexsort((start, loc))
        loc, start, stop = loc[o], start[o], stop[o]
        out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for where, text in zip(docs.column("loc").to_pylist(), _texts(docs)):
            a, b = np.searchsorted(loc, where, "left"), np.searchsorted(loc, where, "right")
            left, at, spans = [], 0, 0
            if b > a:
                s, e = start[a:b], np.maximum.accumulate(stop[a:b])
                head = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                tail = np.concatenate([head[1:], [b - a]]) - 1
                spans = len(head)
                for x, y in zip(s[head].tolist(), e[tail].tolist()):
                    left.append(text[at:x])
                    at = y
            left.append(text[at:])
            kept = b"".join(left)
            for c, v in zip(out, (len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if texts else None)):
                out[c].append(v)
        return pa.table({"id": docs.column("id"), **{c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")},
                         "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept": pa.array(out["kept"], pa.binary())})
    return run


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", length: int = LENGTH, texts: bool = True,
                   bucket_suffixes: int = BUCKET_SUFFIXES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept): the bytes left of every
    document (``kept`` only with ``texts``)."""
    if length < 32:
        raise ValueError("strings of under 32 bytes have no room for an anchor")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), key_of(F.col(id_col)).alias("idk"), body.alias("text"))
    n_docs = d.count()
    chunks, bits = max(1, math.ceil(n_docs / CHUNK_DOCS)), range_bits(n_docs)
    # two independent hashes: the chunk, and the place in it
    d = d.select("id", F.pmod(F.xxhash64("idk", "text"), F.lit(chunks)).alias("chunk"),
                 F.xxhash64("text", "idk", F.lit(1)).alias("loc"), F.col("text").cast("binary").alias("text"))
    leads, anchors = sample_leads(d.select("text"), length, n_docs)
    buckets = max(1, math.ceil(anchors / bucket_suffixes))
    deals = math.ceil(buckets / MAX_SPLITTERS)
    cuts = np.array(splitters(leads, math.ceil(buckets / deals)), f"S{SORTED_BYTES}")
    shared = d.sparkSession.sparkContext.broadcast(cuts)  # MAX_SPLITTERS at most
    grouped = d.groupBy("chunk")
    answer = often(grouped.applyInArrow(_packed(length, bits), PACKED))
    suffixes = grouped.cogroup(answer.groupBy("chunk")).applyInArrow(_suffixes(length, bits, shared, deals), _SUFFIX)
    found = suffixes.groupBy("bucket").applyInArrow(_resolved(length), _FOUND)
    # a range goes to its chunk, an open window to where all of its digest meet
    route = F.when(F.col("digest").isNull(), F.col("chunk")).otherwise(F.pmod(F.xxhash64("digest"), F.lit(chunks)))
    ranges = found.withColumn("route", route).groupBy("route").applyInArrow(_routed, _RANGES)
    return grouped.cogroup(ranges.groupBy("chunk")).applyInArrow(
        _cut(texts), f"id {d.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
