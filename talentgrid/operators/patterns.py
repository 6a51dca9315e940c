"""Many terms looked up in many texts, in one pass over each text.

A vocabulary is compiled into one automaton (a trie with failure links), which reads a text once
and reports every term it contains, whatever the number of terms. The automaton is built once per
Python worker from broadcast terms; rows are not shuffled, not joined and not keyed, so equal ids
stay separate rows and texts of any length go through whole. A term counts as often as it occurs
without overlapping itself (as ``str.count`` has it).

What is broadcast is bounded: a vocabulary of more than ``CHUNK_TERMS`` terms is cut by hash into
chunks, each with an automaton and a pass of its own.
"""

from __future__ import annotations

import math
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms of one automaton.
CHUNK_TERMS = 100_000
#: Characters of a chunk's terms; only reached by a few very long terms.
CHUNK_CHARS = 32 << 20


class _Automaton:
    """The last automaton of a Python worker, by the name of its terms."""

    made: dict = {}

    @classmethod
    def get(cls, name: str, terms):
        if name not in cls.made:
            a = ahocorasick.Automaton()
            for no, term in terms:
                same = a.get(term, None)
                a.add_word(term, (len(term), (*(same[1] if same else ()), no)))
            if len(a):
                a.make_automaton()
            cls.made = {name: a}
        return cls.made[name]


def _found(automaton, text):
    """(no, n) of the terms in the text, by number."""
    if not text or not len(automaton):
        return []
    count: dict = {}
    for end, (size, nos) in automaton.iter(text):
        seen = count.get(nos)
        if seen is None:
            count[nos] = [1, end]
        elif end - size >= seen[1]:  # begins behind the last one counted
            seen[0] += 1
            seen[1] = end
    return sorted((no, n) for nos, (n, _) in count.items() for no in nos)


def _looked_up(terms, at: int):
    name = uuid.uuid4().hex

    def run(it):
        for batch in it:
            automaton = _Automaton.get(name, terms.value)
            hits = [[{"no": no, "n": n} for no, n in _found(automaton, t.as_py())] for t in batch.column(at)]
            kind = pa.list_(pa.struct([("no", pa.int64()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, kind)], [*batch.schema.names, "_hits"])
    return run


def find_terms(rows: DataFrame, text_col: str, terms: DataFrame, out_col: str = "hits") -> DataFrame:
    """Adds ``out_col``: array of (no, n) of the ``terms`` (no long, term string) that the text
    contains, by number. Matching is exact: lower-case both sides first where case must not
    count. Null texts contain nothing; null and empty terms are never found."""
    some = terms.select(F.col("no").cast("long").alias("no"), "term").filter("term is not null and term <> ''")
    n, chars = some.agg(F.count("*"), F.sum(F.length("term"))).first()
    chunks = max(1, math.ceil(n / CHUNK_TERMS), math.ceil((chars or 0) / CHUNK_CHARS))
    part = F.pmod(F.xxhash64("term"), F.lit(chunks))
    out, names = rows, rows.columns
    for c in range(chunks):
        # at most about CHUNK_TERMS rows
        shared = rows.sparkSession.sparkContext.broadcast([(r.no, r.term) for r in some.filter(part == c).collect()])
        schema = _with(out, "_hits")
        out = out.mapInArrow(_looked_up(shared, names.index(text_col)), schema)
        both = F.col("_hits") if c == 0 else F.concat(F.col(out_col), F.col("_hits"))
        out = out.withColumn(out_col, F.array_sort(both) if chunks > 1 else both).select(*names, out_col)
    return out


def _with(df: DataFrame, name: str):
    kind = T.ArrayType(T.StructType([T.StructField("no", T.LongType()), T.StructField("n", T.IntegerType())]))
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def sum_terms(rows: DataFrame, text_col: str, entries: list, n_groups: int, value, out_col: str = "sums") -> DataFrame:
    """Adds ``out_col``: per row an array of ``n_groups`` sums over the entries (term, group,
    weight) that the text contains, of ``value(times, weight)``. An entry listed twice counts
    twice; rows are not shuffled, and equal ids stay separate rows."""
    numbered, by_no = {}, []
    for term, group, weight in entries:
        if not term:
            continue
        if term not in numbered:
            numbered[term] = len(by_no)
            by_no.append([])
        by_no[numbered[term]].append((group, weight))
    shared = rows.sparkSession.sparkContext.broadcast(([(no, t) for t, no in numbered.items()], by_no))
    name, at = uuid.uuid4().hex, rows.columns.index(text_col)

    def run(it):
        for batch in it:
            terms, groups = shared.value
            automaton = _Automaton.get(name, terms)
            out = []
            for t in batch.column(at):
                sums = [0.0] * n_groups
                for no, times in _found(automaton, t.as_py()):
                    for group, weight in groups[no]:
                        sums[group] += value(times, weight)
                out.append(sums)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, out_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))]))
