"""SimHash near-duplicates by tiled exact comparison.

Every document gets a 64-bit fingerprint of its word shingles (bit set where it is set in more
than half of the shingles' hashes). Documents of one fingerprint are one node, so exact copies
never meet as pairs. Nodes are laid out by population counts (of the whole fingerprint and of
its quarters) in tiles of bounded size; a cell of equal counts that fills several tiles is dealt
over them by hash. Two fingerprints within the radius differ by at most the radius in every
population count and in the sum of differences over any split of the bits, so a pair of tiles
whose boxes of counts (whole, halves, quarters, bytes) lie further apart is skipped: first among
the tiles, in a join on the population count, then again among the small tiles inside them. What
remains is compared bit by bit, with numpy's exclusive-or and bit counts. A pair of tiles returns
spanning edges only, at most one less than its nodes, and components name the classes.

Work units are pairs of packed tiles, two times ``TILE`` fingerprints each. How many there are
grows with the square of the number of different fingerprints (the skips take out a share that
grows with the number of tiles); that is the price of an exact comparison by tiles. The driver
sees one count per cell: at most 17^4 cells exist, as each quarter has 17 population counts.

Defined results: a null or empty text has no shingles and the fingerprint zero, which links like
any other; with fewer words than a shingle the whole sequence is one shingle; texts are read
whole; rows are kept apart even if they repeat; a null id never names a class (a class without
ids has the component null); an empty table gives an empty result; columns other than the id
and the text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import stored
from talentgrid.llm.components import components

#: Fingerprints of a tile; a unit holds two of them.
TILE = 16384
#: Rows of a small tile, the grain of the comparison.
SMALL = 128
#: Shingles hashed together.
SLAB = 100_000
SEED = 42
OUT_ROWS = 4096

#: Bits of the parts whose population counts are boxed.
SPLITS = (64, 32, 16, 8)
_BYTES = np.uint64(0x0101010101010101)


def _hashes(words: list[bytes], size: int) -> list[int]:
    """XXH64 of every shingle, repeats included."""
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    text = b" ".join(words)
    ends = np.cumsum(np.array([len(w) for w in words]) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(text[a:b], SEED) for a, b in zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per group of consecutive hashes the bits set in more than half of them."""
    out = np.zeros(len(sizes), "uint64")
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    n = sizes[some]
    # byte lanes count up to 255 hashes at a time, whose sums are then added per group
    lots = -(-n // 255)
    first = np.concatenate([[0], np.cumsum(lots)[:-1]])
    inner = np.arange(lots.sum()) - np.repeat(first, lots)
    at = np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), lots) + 255 * inner
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _BYTES, at)
        counts = np.add.reduceat(lanes.view("u1").reshape(-1, 8).astype("int64"), first, axis=0)
        most = 2 * counts > n[:, None]
        for byte in range(8):  # lane i of a little-endian number holds bit 8 i + j
            out[some] |= most[:, byte].astype("uint64") << np.uint64(8 * byte + j)
    return out


def _fingerprinted(size: int):
    def run(it):
        for batch in it:
            ids, hashes, sizes = [], [], []
            for at in range(batch.num_rows):
                got = _hashes((batch.column(1)[at].as_py() or b"").lower().split(), size)
                ids.append(batch.column(0).slice(at, 1))
                sizes.append(len(got))
                hashes += got
                if len(hashes) >= SLAB or len(sizes) >= OUT_ROWS:
                    yield _prints(ids, hashes, sizes)
                    ids, hashes, sizes = [], [], []
            if sizes:
                yield _prints(ids, hashes, sizes)
    return run


def _prints(ids, hashes, sizes):
    fp = majority(np.array(hashes, "uint64"), np.array(sizes, "int64"))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(fp.view("int64"))], ["id", "fp"])


def fingerprints(docs: DataFrame, size: int = 5, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, fp) for every row; ``fp`` holds the 64 bits as a long. Only A-Z are lower-cased;
    a word is a run of characters other than ASCII white space."""
    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return x.mapInArrow(_fingerprinted(size), f"id {x.schema['id'].dataType.simpleString()}, fp long")


def hexed(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _part(bits: int, k: int):
    """Population count of the k-th part of that many bits."""
    return F.bit_count(F.shiftrightunsigned("fp", bits * k).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long")))


def _laid_out(nodes: DataFrame, tile: int) -> DataFrame:
    """(fp, tile): tiles of about that many fingerprints, neighbours in the order of their
    population counts (whole, upper half, two of the quarters: these fix all four quarters)."""
    spark = nodes.sparkSession
    cell = ["c0", "c1", "c2", "c3"]
    x = nodes.select("fp", _part(64, 0).alias("c0"), _part(32, 1).alias("c1"), _part(16, 0).alias("c2"), _part(16, 2).alias("c3"))
    # at most 17^4 rows
    counts = sorted(tuple(r) for r in x.groupBy(*cell).count().collect())
    plan, number, held = [], 0, 0
    for *c, n in counts:
        lots = -(-n // tile)
        if held and held + n > tile or lots > 1:
            number, held = number + (held > 0), 0
        plan.append((*c, number, lots))
        held += n
        if lots > 1:
            number, held = number + lots, 0
    table = spark.createDataFrame(plan, "c0 int, c1 int, c2 int, c3 int, first int, lots int")
    x = x.join(F.broadcast(table), cell)
    return x.select("fp", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("lots"))).cast("long").alias("tile"))


def _counts(fp: np.ndarray) -> np.ndarray:
    """Population counts of all parts of all splits, as columns."""
    out = []
    for bits in SPLITS:
        mask = np.uint64((1 << bits) - 1)
        out += [np.bitwise_count((fp >> np.uint64(bits * k)) & mask) for k in range(64 // bits)]
    return np.stack(out, 1).astype("int16")


def _packed(key, table):
    fp = np.asarray(table.column("fp")).view("uint64")
    counts = _counts(fp)
    fp = fp[np.lexsort((fp, *counts.T[::-1]))]
    counts = _counts(fp)
    return pa.table({"tile": [key[0].as_py()], "fps": pa.array([fp.tobytes()], pa.binary()),
                     "lo": pa.array([counts.min(0).astype("int32")], pa.list_(pa.int32())),
                     "hi": pa.array([counts.max(0).astype("int32")], pa.list_(pa.int32()))})


def _near(radius: int):
    """Condition on two tiles: no split of the bits parts their boxes by more than the radius."""
    out, at = F.lit(True), 0
    for bits in SPLITS:
        parts = range(at, at + 64 // bits)
        gap = sum((F.greatest(F.lit(0), F.col("lo")[i] - F.col("hi2")[i], F.col("lo2")[i] - F.col("hi")[i]) for i in parts), F.lit(0))
        out, at = out & (gap <= radius), parts.stop
    return out


def tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """(tile, tile2) of all pairs that may hold a link, each once, a tile with itself too: met
    in a join on the population count, whose range the first tile widens by the radius."""
    box = tiles.select("tile", "lo", "hi")
    wide = box.withColumn("at", F.explode(F.sequence(F.col("lo")[0] - radius, F.col("hi")[0] + radius)))
    other = box.select(F.col("tile").alias("tile2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    other = other.withColumn("at", F.explode(F.sequence(F.col("lo2")[0], F.col("hi2")[0])))
    met = wide.join(other, "at").filter("tile <= tile2")
    # of the counts at which two tiles meet, the least
    met = met.filter(F.col("at") == F.greatest(F.col("lo")[0] - radius, F.col("lo2")[0]))
    return met.filter(_near(radius)).select("tile", "tile2")


def links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[list[int], list[int]]:
    """Spanning edges of the links between two sorted tiles (or inside one): pairs of places,
    those of ``b`` counted behind those of ``a`` unless the tiles are the same."""
    shift = 0 if same else len(a)
    label = np.arange(len(a) if same else len(a) + len(b))
    ca, cb = _counts(a), _counts(b)
    cut_a, cut_b = np.arange(0, len(a), SMALL), np.arange(0, len(b), SMALL)
    lo_a, hi_a = np.minimum.reduceat(ca, cut_a), np.maximum.reduceat(ca, cut_a)
    lo_b, hi_b = np.minimum.reduceat(cb, cut_b), np.maximum.reduceat(cb, cut_b)
    left, right = [], []
    for t, start in enumerate(cut_a):
        gap = np.maximum(0, np.maximum(lo_b - hi_a[t], lo_a[t] - hi_b))
        far, at = np.zeros(len(cut_b), bool), 0
        for bits in SPLITS:
            far |= gap[:, at:at + 64 // bits].sum(1) > radius
            at += 64 // bits
        if same:
            far |= cut_b < start
        near = np.flatnonzero(~far)
        for some in np.array_split(near, -(-len(near) // 64)) if len(near) else ():
            cols = (cut_b[some][:, None] + np.arange(SMALL)).ravel()
            cols = cols[cols < len(b)]
            rows = np.arange(start, min(start + SMALL, len(a)))
            i, j = np.nonzero(np.bitwise_count(a[rows][:, None] ^ b[cols][None, :]) <= radius)
            if not len(i):
                continue
            i, j = rows[i], cols[j] + shift
            for x, y0, y1 in zip(*_groups(i)):
                y = j[y0:y1]
                roots, place = np.unique(label[y], return_index=True)
                other = roots != label[x]
                if other.any():
                    left += [int(x)] * int(other.sum())
                    right += y[place[other]].tolist()
                    every = np.append(roots[other], label[x])
                    label[np.isin(label, every)] = every.min()
    return left, right


def _groups(sorted_ids):
    first = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
    return sorted_ids[first].tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_ids)]


def _compared(radius: int):
    def run(it):
        for batch in it:
            for r in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[r].as_py(), "<u8") for c in ("fps", "fps2"))
                same = batch.column("tile")[r].as_py() == batch.column("tile2")[r].as_py()
                left, right = links(a, b, radius, same)
                both = a if same else np.concatenate([a, b])
                yield pa.RecordBatch.from_arrays([pa.array(both[left].view("int64")), pa.array(both[right].view("int64"))], ["a", "b"])
    return run


def join(docs: DataFrame, size: int = 5, radius: int = 4, id_col="doc_id", text_col="text", tile: int = TILE) -> DataFrame:
    """(id, fp, component): ``component`` is the smallest id reachable over links of
    fingerprints that differ in at most ``radius`` bits."""
    prints = stored(fingerprints(docs, size, id_col, text_col), "simhash-prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("low")), "simhash-nodes")
    tiles = _laid_out(nodes, tile).groupBy("tile").applyInArrow(_packed, "tile long, fps binary, lo array<int>, hi array<int>")
    tiles = stored(tiles, "simhash-tiles")
    pairs = stored(tile_pairs(tiles, radius), "simhash-pairs")
    units = pairs.join(tiles.select("tile", "fps"), "tile") \
        .join(tiles.select(F.col("tile").alias("tile2"), F.col("fps").alias("fps2")), "tile2")
    edges = units.select("tile", "tile2", "fps", "fps2").mapInArrow(_compared(radius), "a long, b long")
    classes = components(edges.select(hexed(F.col("a")).alias("a"), hexed(F.col("b")).alias("b")))
    lows = nodes.withColumn("node", hexed(F.col("fp"))).join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = lows.groupBy("root").agg(F.min("low").alias("component"))
    return prints.join(lows.join(names, "root").select("fp", "component"), "fp").select("id", "fp", "component")
