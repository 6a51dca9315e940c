"""Ranked lexical search by per-term geometric blocking.

Each document becomes the sparse vector of what the queries' terms add to its score. Documents
are dealt into shards as they are read; a shard has one posting list per term, and every list is
clustered by the similarity of its documents' vectors (nearest of evenly taken centres, in a
sketch of the vectors) into blocks. A block stores the coordinatewise maximum of its vectors.

Terms are ordered from the heaviest to the lightest. A document answers a query in the list of
the heaviest query term it holds, so a list's vectors need only the coordinates from its own
term on, and the product of a query with a block's summary bounds the scores of the documents
that answer there. A block is skipped only where that bound is below the query's k-th best score
so far; once the largest products of the remaining terms together are below it, the remaining
lists are skipped too. Documents of the other blocks are scored exactly, in integers. The k-th
best scores rise from shard to shard within a task; every task returns at most k rows a query,
and a window over these picks the result.

Documents are read once: their vectors are written to the shared folder, and document
frequencies, lengths and ranking come from there. Nothing but the frequencies and the last k
rows a task and query is shuffled. Queries are taken in chunks of about ``CHUNK_BYTES`` of text
(a longer query is a chunk of its own); a chunk's terms are what is broadcast.

Defined results: null or empty documents have no terms and are never found; a query without
terms, or whose terms occur nowhere, has no rows; documents of equal score go by id, those
without an id last; rows are kept apart even if ids repeat, in both tables; empty tables give an
empty result; texts are read whole; columns other than ids and texts are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talentgrid.llm.common import stored

#: Documents of a block, of a shard, and about how many vector entries a shard holds.
BLOCK = 64
SHARD = 4096
SHARD_ENTRIES = 1 << 20
#: Numbers of a sketch.
SKETCH = 16
#: Cells of the table in which summaries are made.
CELLS = 1 << 20
#: Blocks whose documents are scored together.
TOGETHER = 16
CHUNK_BYTES = 1 << 20
OUT_ROWS = 1024
_LAST = int(np.iinfo("int64").max)

#: Letters, digits and all characters beyond ASCII make terms; only A-Z are lower-cased.
TERM_BYTES = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _vectors(number):
    def run(it):
        known = number.value
        for batch in it:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                n, ends, tids, tfs = [], [0], [], []
                for text in part.column(1):
                    terms = terms_of(text.as_py() or b"")
                    n.append(len(terms))
                    for t, k in Counter(terms).items():
                        if t in known:
                            tids.append(known[t])
                            tfs.append(k)
                    ends.append(len(tids))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(tids, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["id", "n", "tids", "tfs"])
    return run


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of every span, one after the other."""
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    return np.arange(sizes.sum()) + np.repeat(starts - first, sizes)


class Shard:
    """Blocked posting lists of some documents. ``rows`` lists (document, term, value) by
    document, then term; terms are numbered from the heaviest on, values are above 0."""

    def __init__(self, n_docs: int, n_terms: int, doc: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.term, self.value = term, value
        self.start = np.searchsorted(doc, np.arange(n_docs + 1))
        self.most = np.zeros(n_terms, "int64")
        np.maximum.at(self.most, term, value)
        # postings by list; those of a list by cluster
        posting = np.lexsort((doc, term))
        lists = np.searchsorted(term[posting], np.arange(n_terms + 1))
        block = self._blocked(doc, posting, lists)
        new = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, int)
        self.members = doc[posting]
        self.first = np.append(new, len(block))
        self.lists = np.searchsorted(new, lists)  # a list's blocks
        self._summarise(posting, doc)

    def _blocked(self, doc, posting, lists):
        """Orders the postings of long lists by cluster; a number per posting that changes
        from block to block."""
        sign = np.random.default_rng(0).choice([-1.0, 1.0], (len(lists) - 1, SKETCH))
        sketch = np.zeros((len(self.start) - 1, SKETCH))
        some = np.flatnonzero(np.diff(self.start))
        if len(some):
            sketch[some] = np.add.reduceat(sign[self.term] * self.value[:, None], self.start[some], axis=0)
        sketch /= np.maximum(np.sqrt((sketch ** 2).sum(1)), 1e-12)[:, None]
        block, used = np.zeros(len(posting), "int64"), 0
        sizes = np.diff(lists)
        short = np.repeat(sizes <= BLOCK, sizes)
        block[short] = np.repeat(np.arange(len(sizes)), sizes)[short]
        used = len(sizes)
        for t in np.flatnonzero(sizes > BLOCK):
            a, b = lists[t], lists[t + 1]
            z = sketch[doc[posting[a:b]]]
            centres = z[np.linspace(0, b - a - 1, -(-(b - a) // BLOCK)).astype(int)]
            near = (z @ centres.T).argmax(1)
            o = np.argsort(near, kind="stable")
            posting[a:b], near = posting[a:b][o], near[o]
            first = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
            inner = np.arange(b - a) - np.repeat(first, np.diff(np.append(first, b - a)))
            cut = np.concatenate([[True], (near[1:] != near[:-1]) | (inner[1:] % BLOCK == 0)])
            block[a:b] = used + np.cumsum(cut)
            used += b - a + 1
        return block

    def _summarise(self, posting, doc):
        """Per block the largest value of every term from the list's own on: terms and values,
        one block after the other."""
        n_terms, n_blocks = len(self.most), len(self.first) - 1
        after = self.start[doc[posting] + 1] - posting  # entries of the document from this one on
        group = max(1, CELLS // max(1, n_terms))
        terms, values, sizes = [], [], []
        for g in range(0, n_blocks, group):
            edge = self.first[g:min(g + group, n_blocks) + 1]
            n = len(edge) - 1
            table = np.zeros(n * n_terms, "int64")
            p = slice(edge[0], edge[-1])
            owner = np.repeat(np.arange(n), np.diff(edge))
            for part in np.array_split(np.arange(p.start, p.stop), max(1, int(after[p].sum()) // CELLS)):
                at = _spans(posting[part], after[part])
                np.maximum.at(table, np.repeat(owner[part - p.start] * n_terms, after[part]) + self.term[at], self.value[at])
            cell = np.flatnonzero(table)
            terms.append(cell % n_terms)
            values.append(table[cell])
            sizes.append(np.bincount(cell // n_terms, minlength=n))
        none = np.zeros(0, "int64")
        self.summary_term = np.concatenate([none, *terms])
        self.summary_value = np.concatenate([none, *values])
        self.summary_first = np.concatenate([[0], np.cumsum(np.concatenate([none, *sizes]))])

    def bounds(self, t: int, query: np.ndarray) -> np.ndarray:
        """What documents that answer the query in list t can score, by block."""
        a, b = self.lists[t], self.lists[t + 1]
        s = slice(self.summary_first[a], self.summary_first[b])
        return np.add.reduceat(query[self.summary_term[s]] * self.summary_value[s], self.summary_first[a:b] - s.start)

    def scores(self, docs: np.ndarray, query: np.ndarray) -> np.ndarray:
        at = _spans(self.start[docs], self.start[docs + 1] - self.start[docs])
        size = self.start[docs + 1] - self.start[docs]  # above 0, as the documents come from lists
        return np.add.reduceat(query[self.term[at]] * self.value[at], np.concatenate([[0], np.cumsum(size)[:-1]]))


class Best:
    """The k best documents of a query so far."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.id, self.uid = (np.zeros(0, "int64") for _ in range(3))

    def add(self, score, id_, uid):
        keep = score >= self.least
        if not keep.any():
            return
        score, id_, uid = (np.concatenate([x, y[keep]]) for x, y in ((self.score, score), (self.id, id_), (self.uid, uid)))
        o = np.lexsort((uid, id_, -score))[:self.k]
        self.score, self.id, self.uid = score[o], id_[o], uid[o]
        if len(o) == self.k:
            self.least = max(self.least, int(self.score[-1]))


def visit(shard: Shard, terms: np.ndarray, times: np.ndarray, best: Best, ids: np.ndarray, uids: np.ndarray) -> tuple[int, int]:
    """Adds the shard's documents to the query's best; (blocks looked at, blocks skipped).
    ``terms`` rise."""
    query = np.zeros(len(shard.most), "int64")
    query[terms] = times
    rest = np.cumsum((shard.most[terms] * times)[::-1])[::-1]
    seen = np.zeros(len(shard.start) - 1, bool)
    looked = skipped = 0
    for t, left in zip(terms.tolist(), rest.tolist()):
        if left < best.least:
            skipped += int(shard.lists[-1] - shard.lists[t]) if looked else 0
            break
        if shard.lists[t] == shard.lists[t + 1]:
            continue
        bound = shard.bounds(t, query)
        order = np.argsort(-bound, kind="stable")
        for at in range(0, len(order), TOGETHER):
            some = order[at:at + TOGETHER]
            some = some[bound[some] >= best.least]
            if not len(some):
                skipped += len(order) - at
                break
            looked += len(some)
            b = shard.lists[t] + some
            docs = shard.members[_spans(shard.first[b], shard.first[b + 1] - shard.first[b])]
            docs = docs[~seen[docs]]
            if len(docs):
                seen[docs] = True
                best.add(shard.scores(docs, query), ids[docs], uids[docs])
    return looked, skipped


def _ranked(shared, k: int):
    def run(it):
        order, weights, queries, n_docs, total = shared.value
        best = [Best(k) for _ in queries]
        for batch in it:
            for ids, uids, n, doc, term, tf in _shards(batch):
                m = 100 - 25 + (25 * n * n_docs) // total
                value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                term = order[term]
                some = value > 0
                doc, term, value = doc[some], term[some], value[some]
                o = np.lexsort((term, doc))
                shard = Shard(len(ids), len(order), doc[o], term[o], value[o])
                for (_, terms, times), b in zip(queries, best):
                    visit(shard, terms, times, b, ids, uids)
        for q, b in enumerate(best):
            if len(b.score):
                size = len(b.score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, queries[q][0])), pa.array(b.id, mask=b.id == _LAST), pa.array(b.uid), pa.array(b.score)],
                    ["quid", "id", "uid", "score"])
    return run


def _shards(batch):
    """The batch in parts of bounded size: ids, row numbers, lengths and flat entries."""
    tids, tfs = batch.column("tids"), batch.column("tfs")
    sizes = np.diff(np.asarray(tids.offsets))
    ids = np.asarray(batch.column("id").fill_null(_LAST)).astype("int64")
    uids, n = np.asarray(batch.column("uid")), np.asarray(batch.column("n"))
    flat_t, flat_f = np.asarray(tids.flatten()), np.asarray(tfs.flatten())
    ends, at, a = np.cumsum(sizes), 0, 0
    while a < len(sizes):
        b = max(a + 1, min(a + SHARD, int(np.searchsorted(ends, at + SHARD_ENTRIES, side="right"))))
        to = int(ends[b - 1])
        yield ids[a:b], uids[a:b], n[a:b], np.repeat(np.arange(b - a), sizes[a:b]), flat_t[at:to], flat_f[at:to].astype("int64")
        a, at = b, to


def _chunk(docs: DataFrame, items, k: int) -> DataFrame:
    """Ranking for (quid, text) rows: (quid, id, score, rank)."""
    spark = docs.sparkSession
    counts = [(q, Counter(terms_of(bytes(t or b"")))) for q, t in items]
    number = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in counts))))}
    known = spark.sparkContext.broadcast(number)
    x = docs.mapInArrow(_vectors(known), "id long, n long, tids array<int>, tfs array<long>")
    x = stored(x.withColumn("uid", F.monotonically_increasing_id()), "lexical-vectors")
    n_docs, total = x.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = np.zeros(len(number), "int64")
    for t, c in x.select(F.explode("tids").alias("t")).groupBy("t").count().collect():  # terms of the chunk at most
        df[t] = c
    weights = np.array([weight(n_docs, d) for d in df.tolist()], "int64")
    # the heaviest terms first
    order = np.empty(len(number), "int64")
    order[np.lexsort((np.arange(len(number)), df))] = np.arange(len(number))
    queries = []
    for q, c in counts:
        terms = np.array([order[number[t]] for t in c], "int64")
        times = np.array(list(c.values()), "int64")
        o = np.argsort(terms)
        queries.append((q, terms[o], times[o]))
    shared = spark.sparkContext.broadcast((order, weights, queries, n_docs, max(1, total or 0)))
    hits = x.select("id", "uid", "n", "tids", "tfs").mapInArrow(_ranked(shared, k), "quid long, id long, uid long, score long")
    by = W.partitionBy("quid").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "uid")
    return hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("quid", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col="doc_id", text_col="text", item_col="item_id",
           item_text_col="text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(item, rank, id, score): for every row of ``items`` the k rows of ``docs`` of highest
    score above 0, ties to the smaller id."""
    body = lambda c: F.col(c).cast("string").cast("binary")
    d = docs.select(F.col(id_col).cast("long").alias("id"), body(text_col).alias("text"))
    q = items.select(F.col(item_col).alias("item"), body(item_text_col).alias("text"), F.monotonically_increasing_id().alias("quid"))
    q = stored(q, "lexical-queries")
    # a chunk is bounded in bytes: by running sums over groups of few rows
    sized = q.select("quid", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    chunks = max(1, math.ceil((sized.agg(F.sum("bytes")).first()[0] or 0) / chunk_bytes))
    out = None
    for c in range(chunks):
        part = q.filter(F.pmod(F.xxhash64("quid"), F.lit(chunks)) == c).select("quid", "text")
        got = stored(_chunk(d, [tuple(r) for r in part.collect()], k), "lexical-ranked")
        out = got if out is None else out.unionByName(got)
    return out.join(q.select("quid", "item"), "quid").select("item", "rank", "id", "score")
