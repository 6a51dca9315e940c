"""Language identification by prediction by partial matching.

Every language has a byte context tree of variable order: for each context of up to
``ORDER`` bytes the frozen counts of the bytes that followed it. A byte is coded in the
longest context that has been seen; a byte new to that context costs the escape
probability (distinct / (total + distinct)) and is coded in the next shorter one, down to
a uniform byte. The code length of a text is the exact sum over its bytes, in every
language; the shortest code wins and its posterior probability is the score. Contexts begin
at the space before a word, so a word costs the same wherever it stands and is coded once
per worker.

The trees are fitted on whole training documents: for each language the ``max_docs`` texts
of smallest hash (rows with equal id and text count once), and of these as many as have
``max_bytes`` bytes together, texts of over a sixteenth of that last (the first is always
taken). The sample is chosen by hashes and lengths; only its own texts are shuffled. That
bounded sample is all that reaches the driver; every document is scored.

Defined results: ``und`` with score 0 for a null text, one without a letter, or where no
language was learned; ties go to the smallest language name; texts of any length are read
whole; repeated rows are scored alike; an empty table gives an empty result. Only the
columns named are looked at.
"""

from __future__ import annotations

from collections import Counter
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talentgrid.llm.common import stored

ORDER = 4
MAX_DOCS = 2000
MAX_BYTES = 1 << 20
#: Per-worker tables: entries, and the longest word that is kept.
MAX_WORDS = 500_000
MAX_GRAMS = 400_000
KEPT_WORD = 64
ROWS = 64


def sample(train: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The bounded training sample (lang, text) of rows (id, text, lang)."""
    t = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()) \
        .select("lang", "text", F.xxhash64("id", "text").alias("h"))
    keys = stored(t.select("lang", "h", F.octet_length("text").cast("long").alias("b")), "langid-keys")
    # a share of the hashes that holds max_docs of them beyond doubt; copies share their hash
    share = keys.groupBy("lang").agg((F.lit(1.5 * max_docs + 100) / F.approx_count_distinct("h", 0.02)).alias("share"))
    near = keys.join(F.broadcast(share), "lang").filter(F.col("h") < F.lit(-2.0 ** 63) + F.col("share") * F.lit(2.0 ** 64)) \
        .groupBy("lang", "h").agg(F.max("b").alias("b"))
    t_rank = near.withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("rn") <= max_docs)
    by = W.partitionBy("lang").orderBy(F.col("b") > max_bytes // 16, "rn").rowsBetween(W.unboundedPreceding, 0)
    chosen = t_rank.withColumn("upto", F.sum("b").over(by)).filter((F.col("upto") <= max_bytes) | (F.col("upto") == F.col("b"))) \
        .select("lang", "h")
    # max_docs short rows a language at most; a copy of a chosen text goes no further than its partition
    return t.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def _count_grams(it):
    """(lang, context bytes, next byte, count) of every order, summed per batch."""
    for batch in it:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(text.encode().split())
        for lang, counts in words.items():
            grams: Counter = Counter()
            for word, n in counts.items():
                w = b" " + word + b" "
                for i in range(1, len(w)):
                    for k in range(min(i, ORDER) + 1):
                        grams[w[i - k:i + 1]] += n
            keys = list(grams)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.binary()),
                 pa.array([grams[k] for k in keys], pa.int64())], ["lang", "gram", "n"])


def fit(train: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES):
    """``(languages, trees)``: trees[language][context] = (total, {byte: count})."""
    grams = sample(train, max_docs, max_bytes).mapInArrow(_count_grams, "lang string, gram binary, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    trees: dict[str, dict[bytes, list]] = {}
    for lang, gram, n in grams.toLocalIterator():  # bounded by the sample
        gram = bytes(gram)
        node = trees.setdefault(lang, {}).setdefault(gram[:-1], [0, {}])
        node[0] += n
        node[1][gram[-1]] = n
    langs = sorted(trees)
    return langs, [trees[x] for x in langs]


def code_length(tree: dict, context: bytes, byte: int) -> float:
    """Bits of a byte after a context, with escapes to shorter contexts."""
    bits = 0.0
    for k in range(len(context) + 1):
        node = tree.get(context[k:])
        if node is None:
            continue
        total, seen = node
        n = seen.get(byte)
        if n:
            return bits + log2((total + len(seen)) / n)
        bits += log2((total + len(seen)) / len(seen))
    return bits + 8.0


class _Words(dict):
    """Word to row of the table of code lengths. Missing words get a row and are noted in
    ``new``, or, if the older generation has them, in ``moved``."""

    def __init__(self, old):
        super().__init__()
        self.old, self.rows, self.new, self.moved = old, 0, [], []

    def __missing__(self, word):
        at = self.rows
        self.rows += 1
        was = self.old.get(word)
        if was is None:
            self.new.append((at, word))
        else:
            self.moved.append((at, was))
        if len(word) <= KEPT_WORD:
            self[word] = at
        return at


class _Grams(dict):
    """Context and byte to row of the table of their code lengths in every language. A
    context that a language has not seen costs what the next shorter one does."""

    def __init__(self, langs, nodes):
        super().__init__()
        self.nodes = nodes
        self.bits = np.full((1024, langs), 8.0)  # the row of the empty gram is the uniform byte
        self[b""] = 0

    def __missing__(self, gram):
        context, byte = gram[:-1], gram[-1]
        base = self[gram[1:] if context else b""]
        shorter = self.bits[base].tolist()
        for lang, total, seen in self.nodes.get(context, ()):
            n = seen.get(byte)
            kinds = len(seen)
            shorter[lang] = log2((total + kinds) / n) if n else log2((total + kinds) / kinds) + shorter[lang]
        at = self[gram] = len(self)
        if at == len(self.bits):
            self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
        self.bits[at] = shorter
        return at


class Scorer:
    """Code lengths of words in all languages, through bounded tables."""

    def __init__(self, langs, trees):
        self.langs = langs
        self.nodes: dict[bytes, list] = {}
        for lang, tree in enumerate(trees):
            for context, (total, seen) in tree.items():
                self.nodes.setdefault(context, []).append((lang, total, seen))
        self.words, self.grams = _Words({}), _Grams(len(langs), self.nodes)
        self.bits = self.old_bits = np.zeros((1024, len(langs)))

    def _renew(self):
        if self.words.rows > MAX_WORDS:
            self.words, self.old_bits = _Words(dict(self.words)), self.bits
            self.bits = np.zeros_like(self.bits)
        if len(self.grams) > MAX_GRAMS:
            self.grams = _Grams(len(self.langs), self.nodes)

    def _fill(self):
        """Code lengths of the words that came up since the last call."""
        words = self.words
        if words.rows > len(self.bits):
            more = max(words.rows - len(self.bits), len(self.bits))
            self.bits = np.concatenate([self.bits, np.zeros((more, len(self.langs)))])
        if words.moved:
            at, was = zip(*words.moved)
            self.bits[list(at)] = self.old_bits[list(was)]
        if words.new:
            rows, sizes = [], []
            for _, w in words.new:
                x = b" " + w + b" "
                head = [x[:i] for i in range(2, min(ORDER, len(x)) + 1)]
                rows += map(self.grams.__getitem__, head)
                rows += map(self.grams.__getitem__, [x[i:i + ORDER + 1] for i in range(len(x) - ORDER)])
                sizes.append(len(x) - 1)
            starts = np.cumsum([0, *sizes[:-1]])
            self.bits[[at for at, _ in words.new]] = np.add.reduceat(self.grams.bits[rows], starts)
        words.new, words.moved = [], []

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text in every language."""
        self._renew()
        index = [list(map(self.words.__getitem__, t.split())) for t in texts]
        self._fill()
        return np.array([self.bits[row].sum(0) if row else np.zeros(len(self.langs)) for row in index])


def predict(docs: DataFrame, model, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, lang_pred, score) of every document."""
    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    langs, trees = model
    shared = x.sparkSession.sparkContext.broadcast((langs, trees))  # bounded by the sample

    def run(it):
        scorer = Scorer(*shared.value)
        for batch in it:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(1).to_pylist()
                known = [bool(langs) and t is not None and any(map(str.isalpha, t)) for t in texts]
                total = scorer.totals([(t or "").encode() if k else b"" for t, k in zip(texts, known)])
                if langs:
                    best = total.argmin(1)
                    score = 1 / np.exp2(total.min(1, keepdims=True) - total).sum(1)
                pred = [langs[best[i]] if k else "und" for i, k in enumerate(known)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(pred, pa.string()),
                     pa.array([float(score[i]) if k else 0.0 for i, k in enumerate(known)], pa.float64())],
                    ["id", "lang_pred", "score"])

    return x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, lang_pred string, score double")
