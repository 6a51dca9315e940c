"""N-gram Jaccard join by several global token orders.

A document is the set of its word shingles. If two sets reach the similarity, then under
*any* order of all tokens they share a token among the first ``n - ceil(t * n) + 1`` of
each. The join uses ``ORDERS`` orders, all with rare tokens first and each with its own
order among equally frequent ones; a pair is a candidate only if it shares a prefix token
under every one of them, and candidates are verified by their exact overlap.

1. Documents are dealt into chunks by hash. Every chunk sends the distinct tokens of its
   sets, packed by token range; a range counts them and sends back, per chunk, those met
   twice or more. A set with too few such tokens to reach the similarity, or with none in
   one of its prefixes, has no partner and goes no further; that leaves near-copies.
2. Sets that share prefix tokens form families (connected components over the token
   buckets). A family is worked off in blocks of bounded size: inside a unit the prefix
   filters of all orders are intersected, and the pairs left are verified unless already
   connected. The blocks of a large family meet two by two in a second pass, between the
   classes that the first has found. Units return spanning edges, never all pairs.
3. The components of those edges are the classes. Equal sets are one node throughout, so a
   group of exact copies, however large, costs one set per chunk.

Token and set identities are hashes of 64 and 128 bits.

Defined results: a text without words, or null, is an empty set linked with nothing; with
fewer words than a shingle the whole sequence is the one shingle; rows with equal sets are
linked; a null id never names a class unless the class has no other; repeated rows share
their class; an empty table gives an empty result. Only id and text are looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import key_of, stored
from talentgrid.llm.components import Forest, components
from talentgrid.llm.counting import PACKED, frequencies, often, pack, range_bits

ORDERS = 3
CHUNK_DOCS = 1024
BLOCK = 512
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes (uint64); words are split at ASCII white space and
    lower-cased in A-Z only."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "uint64")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
    k = min(size, len(h))
    g = np.full(len(h) - k + 1, k, "uint64")
    for j in range(k):
        g = _mix(g * np.uint64(_SEEDS[0]) + h[j:len(h) - k + 1 + j])
    return np.unique(g)


def least_overlap(n, num: int, den: int):
    """Tokens that a set of ``n`` must share with any partner."""
    return -(-num * n // den)


def _sets(texts, size):
    """The sets of a chunk: signature per row, and {signature: set} of the distinct ones."""
    rows, sets = [], {}
    for t in texts:
        s = shingles(t, size)
        if not len(s):
            rows.append((0, None))
            continue
        sig = xxhash.xxh3_128_hexdigest(s.tobytes())
        sets.setdefault(sig, s)
        rows.append((len(s), sig))
    return rows, sets


def _packed(size: int, bits: int):
    """Chunk to the packed distinct tokens of its distinct sets."""
    def run(key, table):
        _, sets = _sets(table.column("text").to_pylist(), size)
        return pack(key[0].as_py(), np.concatenate([*sets.values(), np.zeros(0, "uint64")]), bits)
    return run


_NODES = "id {id}, th long, n long, sig string, pre0 array<long>, pre array<binary>, shared binary"


def _prefixed(size: int, bits: int, num: int, den: int):
    """Chunk and its frequent tokens to rows of ``_NODES``; a set that may have partners
    comes with its prefixes and its frequent tokens, once a chunk."""
    def run(docs, freq):
        rows, sets = _sets(docs.column("text").to_pylist(), size)
        every = frequencies(freq, np.concatenate([*sets.values(), np.zeros(0, "uint64")]), bits)
        live, at = {}, 0
        for sig, s in sets.items():
            f, at = every[at:at + len(s)], at + len(s)
            need = int(least_overlap(len(s), num, den))
            if (f >= 2).sum() < need:
                continue
            cut, pre = len(s) - need + 1, []
            for seed in _SEEDS[:ORDERS]:
                first = np.lexsort((_mix(s ^ np.uint64(seed)), f))[:cut]
                pre.append(np.sort(s[first[f[first] >= 2]]))
            if all(len(p) for p in pre):
                live[sig] = (pre, s[f >= 2])
        got = [live.pop(sig, None) for _, sig in rows]
        return pa.table({
            "id": docs.column("id"), "th": docs.column("th"),
            "n": pa.array([n for n, _ in rows], pa.int64()), "sig": pa.array([s for _, s in rows], pa.string()),
            "pre0": pa.array([g and g[0][0].view("int64") for g in got], pa.list_(pa.int64())),
            "pre": pa.array([g and [p.tobytes() for p in g[0][1:]] for g in got], pa.list_(pa.binary())),
            "shared": pa.array([g and g[1].tobytes() for g in got], pa.binary())})
    return run


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _share(prefixes: list[np.ndarray]) -> np.ndarray:
    """Boolean matrix: which sets share a prefix token."""
    m = np.zeros((len(prefixes), len(prefixes)), bool)
    tokens = np.concatenate(prefixes)
    owner = np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes])
    o = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[o], owner[o]
    edge = np.flatnonzero(np.diff(tokens)) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(tokens)]])
    for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
        m[np.ix_(owner[a:b], owner[a:b])] = True
    return m


def _linked(num: int, den: int):
    """Unit to (a, b): with one side, every set connected to another and the root of its
    class within the unit; with two, spanning edges between the labels (those roots) of
    either side, pairs across them only being looked at."""
    def run(table):
        table = table.take(pa.array(np.argsort(np.array(table.column("sig").to_pylist(), dtype=str), kind="stable")))
        sig, label = (table.column(c).to_pylist() for c in ("sig", "label"))
        side = np.array(table.column("side").to_pylist())
        n = np.array(table.column("n").to_pylist(), "int64")
        pre = [[np.array(p, "int64").view("uint64") for p in table.column("pre0").to_pylist()]]
        rest = table.column("pre").to_pylist()
        for k in range(ORDERS - 1):
            pre.append([np.frombuffer(r[k], "uint64") for r in rest])
        shared = [np.frombuffer(s, "uint64") for s in table.column("shared").to_pylist()]
        # the prefix filters of all orders, and the size filter
        ok = np.triu(np.ones((len(n), len(n)), bool), 1)
        for p in pre:
            ok &= _share(p)
        ok &= den * np.minimum.outer(n, n) >= num * np.maximum.outer(n, n)
        two = len(set(side.tolist())) > 1
        if two:
            ok &= side[:, None] != side[None, :]
        forest, edges = Forest(), []
        for i, j in zip(*(x.tolist() for x in np.nonzero(ok))):
            if forest.root(label[i]) == forest.root(label[j]):
                continue
            both = overlap(shared[i], shared[j])
            if den * both >= num * (int(n[i]) + int(n[j]) - both):
                forest.join(label[i], label[j])
                edges.append((label[i], label[j]))
        if not two:
            edges = [(s, forest.root(s)) for s in sig]
        large = bool(table.column("blocks")[0].as_py() > 1)
        return pa.table({"a": pa.array([a for a, _ in edges], pa.string()), "b": pa.array([b for _, b in edges], pa.string()),
                         "large": pa.array([large] * len(edges), pa.bool_())})
    return run


def join(docs: DataFrame, size: int, num: int, den: int, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, th, n, component, class): ``component`` is the smallest id reachable over links
    of similarity ``num / den`` or more between sets of ``size``-word shingles, ``th`` a hash
    of the text. ``class`` is the key of the class itself, which ids that are null or used
    twice do not change; a text without words is a class of its id and text."""
    body = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("th"), body.alias("text"))
    n_docs = d.count()
    chunks = max(1, math.ceil(n_docs / CHUNK_DOCS))
    bits = range_bits(n_docs)
    d = d.select(F.pmod(F.xxhash64(key_of(F.col("id")), "th"), F.lit(chunks)).alias("chunk"), "id", "th", "text")
    packed = d.groupBy("chunk").applyInArrow(_packed(size, bits), PACKED)
    id_type = d.schema["id"].dataType
    nodes = d.groupBy("chunk").cogroup(often(packed).groupBy("chunk")).applyInArrow(
        _prefixed(size, bits, num, den), _NODES.format(id=id_type.simpleString()))
    nodes = stored(nodes, "jaccard-nodes")
    live = nodes.filter("shared is not null").select("sig", "n", "pre0", "pre", "shared")

    # families over the buckets of the first order
    index = live.select("sig", F.explode("pre0").alias("token")).distinct()
    least = index.groupBy("token").agg(F.min("sig").alias("low"), F.count("*").alias("size")).filter("size > 1")
    family = components(index.join(least, "token").filter("sig <> low").select(F.col("sig").alias("a"), F.col("low").alias("b")))
    sizes = family.groupBy("root").agg(F.count("*").alias("members"))
    family = family.join(sizes, "root").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    sets = live.dropDuplicates(["sig"]).join(family.withColumnRenamed("node", "sig"), "sig") \
        .withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    sets = stored(sets, "jaccard-sets")
    unit, edge = _linked(num, den), "a string, b string, large boolean"
    cols = ["sig", "n", "pre0", "pre", "shared", "blocks"]
    own = sets.select("root", "block", *cols, F.col("sig").alias("label"), F.lit(0).alias("side"))
    within = stored(own.groupBy("root", "block").applyInArrow(unit, edge), "jaccard-within")
    classes = within.select(F.col("a").alias("sig"), F.col("b").alias("root"))
    if not within.filter("large").isEmpty():
        large = sets.filter("blocks > 1").join(classes.withColumnRenamed("root", "label"), "sig")
        across = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("other <> block")
        across = across.select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                               *cols, "label", F.col("block").alias("side"))
        links = stored(across.groupBy("root", "lo", "hi").applyInArrow(unit, edge).select("a", "b").distinct(), "jaccard-across")
        top = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
        classes = classes.join(top, "root", "left").select("sig", F.coalesce("top", "root").alias("root"))

    # the smallest id of every class
    lows = nodes.filter("sig is not null").groupBy("sig").agg(F.min("id").alias("low"))
    lows = lows.join(classes, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    names = lows.groupBy("root").agg(F.min("low").alias("component"))
    by_sig = lows.join(names, "root").select("sig", "component", F.col("root").alias("class"))
    some = nodes.filter("sig is not null").select("id", "th", "n", "sig").join(by_sig, "sig")
    alone = F.concat_ws(":", F.col("th").cast("string"), key_of(F.col("id")))
    none = nodes.filter("sig is null").select("id", "th", "n", F.col("id").alias("component"), alone.alias("class"))
    return some.select("id", "th", "n", "component", "class").unionByName(none)
