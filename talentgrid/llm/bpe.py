"""Byte-level BPE encoding and decoding.

Encoding compiles the merges into a finite-state transducer that is determinised only as
far as the texts ask for. A byte string has exactly one split into tokens in which every
token and every pair of neighbours is what the merges make of their own bytes; that split
is the BPE result. The nondeterministic machine therefore walks the token trie, may end a
token where the trie allows it, and goes on only if the new token may follow the last one
(decided by running the merges on the two tokens' bytes, and remembered). Its subset states
hold the live hypotheses, each with its place in the trie and its tokens not yet agreed
on; a step emits the prefix that all hypotheses share, which leaves a delay of at most a
few tokens. States and steps are tables that fill as bytes arrive and start anew at a size
bound, so memory stays bounded on any corpus.

Decoding feeds token bytes through an incremental UTF-8 state machine that holds back an
incomplete character until its last byte comes.

Defined results: a null or empty text has no tokens; texts of any length are read piece by
piece; repeated rows give repeated results; an empty table gives an empty result. Columns
other than the id and the text are not looked at (:func:`encode` keeps one id column).
"""

from __future__ import annotations

import base64
import ctypes
import gc
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the per-worker tables (entries); reaching one only renews that table.
MAX_STATES = 200_000
MAX_PAIRS = 600_000
MAX_PIECES = 100_000
MAX_CHUNKS = 500_000
#: Longer strings are not remembered, so the entries of a table are bounded in bytes too.
KEPT_CHARS = 64
#: Bytes of a piece after which the state is remembered.
HEAD = 6
#: A vocabulary file larger than this is not broadcast.
MAX_VOCAB_BYTES = 64 << 20
OUT_ROWS = 256


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file of lines ``base64(token) rank``."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The merges applied literally: again and again the leftmost neighbours of lowest
    rank become one."""
    none = 1 << 60
    parts = [piece[i:i + 1] for i in range(len(piece))]
    rank = [ranks.get(x + y, none) for x, y in zip(parts, parts[1:])]
    while rank and (low := min(rank)) < none:
        i = rank.index(low)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del rank[i]
        if i:
            rank[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(rank):
            rank[i] = ranks.get(parts[i] + parts[i + 1], none)
    return parts


class Transducer:
    """Lazily determinised transducer from bytes to token ids."""

    def __init__(self, ranks: dict[bytes, int], tables: float = 1.0):
        self.ranks, self.most = ranks, int(MAX_STATES * tables)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.kids: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for token, i in ranks.items():
            node = 0
            for b in token:
                nxt = self.kids[node].get(b)
                if nxt is None:
                    nxt = self.kids[node][b] = len(self.kids)
                    self.kids.append({})
                    self.token_at.append(-1)
                node = nxt
            # a token that the merges do not make of its own bytes ends no hypothesis
            if len(merged(token, ranks)) == 1:
                self.token_at[node] = i
        self.follows: dict[int, bool] = {}
        self._restart()

    def _restart(self):
        start = ((-1, 0, ()),)
        self.states, self.number = [start], {start: 0}
        self.steps: dict[int, tuple[int, tuple]] = {}
        self.heads: dict[bytes, tuple[int, tuple]] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """The merges keep the border between these neighbours."""
        if len(self.follows) > MAX_PAIRS:
            self.follows.clear()
        x, y = self.bytes_of[a], self.bytes_of[b]
        got = self.follows[a << 32 | b] = merged(x + y, self.ranks) == [x, y]
        return got

    def step(self, state: int, byte: int) -> tuple[int, tuple]:
        """Makes the step: (next state, tokens now certain)."""
        kids, token_at, follows = self.kids, self.token_at, self.follows
        live = []
        for last, node, due in self.states[state]:
            node = kids[node].get(byte)
            if node is None:
                continue
            if kids[node]:
                live.append((last, node, due))
            t = token_at[node]
            if t >= 0:
                if last >= 0:
                    ok = follows.get(last << 32 | t)
                    if not (self.may_follow(last, t) if ok is None else ok):
                        continue
                live.append((t, 0, (*due, t)))
        if not live:
            raise ValueError(f"byte {byte} has no token in the vocabulary")
        # what all hypotheses agree on is certain
        first = live[0][2]
        sure = len(first)
        for _, _, due in live[1:]:
            sure = min(sure, len(due))
            if due[:sure] != first[:sure]:
                sure = next(k for k in range(sure) if due[k] != first[k])
        live = tuple([(last, node, due[sure:]) for last, node, due in live]) if sure else tuple(live)
        nxt = self.number.get(live)
        if nxt is None:
            nxt = self.number[live] = len(self.states)
            self.states.append(live)
        got = self.steps[state << 8 | byte] = (nxt, first[:sure])
        return got

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > self.most:
            self._restart()
        steps = self.steps
        # pieces that begin alike take up where the first of them was
        head = self.heads.get(piece[:HEAD])
        state, out = (head[0], list(head[1])) if head else (0, [])
        for at in range(HEAD if head else 0, len(piece)):
            if at == HEAD:
                self.heads[piece[:HEAD]] = (state, tuple(out))
            got = steps.get(state << 8 | piece[at]) or self.step(state, piece[at])
            state = got[0]
            if got[1]:
                out += got[1]
        for _, node, due in self.states[state]:
            if node == 0:
                return out + list(due)
        raise ValueError("no split of the piece into tokens")


class _Table(dict):
    """A dict that makes missing values. At its bound it becomes the older generation and
    starts anew; what is still asked for comes over from there. Long keys are made each time."""

    def __init__(self, make, bound):
        super().__init__()
        self.make, self.bound, self.old = make, bound, {}

    def __missing__(self, key):
        if len(key) > KEPT_CHARS:
            return self.make(key)
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Encoder:
    """Whole texts to token ids (little-endian unsigned 32-bit bytes)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, tables: float = 1.0):
        # \s is the Unicode White_Space property
        self.split = regex.compile(pattern).findall
        self.machine = Transducer(ranks, tables)
        self.id_bytes = {i: i.to_bytes(4, "little") for i in ranks.values()}
        self.marks = frozenset(",.")
        # a string that is itself a token is that token, also where the merges alone
        # would not make it
        self.pieces = _Table(self._piece, int(MAX_PIECES * tables))
        self.first = _Table(lambda w: b"".join(map(self.pieces.__getitem__, self.split(w))), int(MAX_CHUNKS * tables))
        self.spaced = _Table(self._spaced, int(MAX_CHUNKS * tables))
        # a space before a character that is not white space always begins a piece; texts
        # with other spaces are split as a whole
        self.odd_space = re.compile(r" \s").search

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.machine.ranks.get(data)
        if whole is not None:
            return self.id_bytes[whole]
        return b"".join(map(self.id_bytes.__getitem__, self.machine.encode(data)))

    def _spaced(self, word: str) -> bytes:
        # Latin letters alone are one piece, a comma or stop after them another
        if word.isalpha():
            if max(word) < "\u0250":
                return self._piece(" " + word)
        elif word[-1:] in self.marks and word[:-1].isalpha() and max(word) < "\u0250":
            return self.spaced[word[:-1]] + self.pieces[word[-1]]
        return b"".join(map(self.pieces.__getitem__, self.split(" " + word)))

    def encode(self, text: str) -> bytes:
        if self.odd_space(text) or text[-2:-1].isspace() and text[-1] == " ":
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.spaced.__getitem__, rest))


class Utf8Stream:
    """Incremental UTF-8: ``feed`` returns the characters completed by the given bytes.
    Malformed bytes become U+FFFD each."""

    # (first, last, continuation bytes, range of the first continuation byte)
    LEADS = ((0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF),
             (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF),
             (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))
    LEAD = {b: row[2:] for row in LEADS for b in range(row[0], row[1] + 1)}

    def __init__(self):
        self.held, self.need, self.lo, self.hi = b"", 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.need:
            try:
                return data.decode()  # complete characters only
            except UnicodeDecodeError:
                pass
        out = []
        for b in data:
            if self.need and not self.lo <= b <= self.hi:
                out.append("�" * len(self.held))
                self.held, self.need = b"", 0
            if self.need:
                self.held += bytes((b,))
                self.need, self.lo, self.hi = self.need - 1, 0x80, 0xBF
                if not self.need:
                    out.append(self.held.decode())
                    self.held = b""
            elif b < 0x80:
                out.append(chr(b))
            elif b in self.LEAD:
                self.held = bytes((b,))
                self.need, self.lo, self.hi = self.LEAD[b]
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        out, self.held, self.need = "�" * len(self.held), b"", 0
        return out


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.bytes_of[i] = t

    def stream(self, ids: bytes, block: int = 4096):
        """The text of the ids, in pieces of ``block`` tokens."""
        numbers, utf8 = np.frombuffer(ids, "<u4"), Utf8Stream()
        for at in range(0, len(numbers), block):
            yield utf8.feed(b"".join(map(self.bytes_of.__getitem__, numbers[at:at + block].tolist())))
        yield utf8.close()


class _Worker:
    """One encoder and decoder per Python worker and vocabulary."""

    made: dict = {}

    @classmethod
    def get(cls, data, pattern: str, tables: float = 1.0):
        key = (data.id if hasattr(data, "id") else id(data), pattern, tables)
        if key not in cls.made:
            cls.made.clear()
            ranks = read_ranks(data.value)
            cls.made[key] = (Encoder(ranks, pattern, tables), Decoder(ranks))
        return cls.made[key]

    @classmethod
    def release(cls):
        """Gives the tables' memory back to the system."""
        cls.made.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def _vocabulary(spark, path: str):
    with open(path, "rb") as f:
        data = f.read(MAX_VOCAB_BYTES + 1)
    if len(data) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def _id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _batches(it, row, names, types):
    for batch in it:
        for at in range(0, batch.num_rows, OUT_ROWS):
            part = batch.slice(at, OUT_ROWS)
            cols = list(zip(*(row(t.as_py()) for t in part.column(1)))) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["id", *names])


def encode(docs: DataFrame, vocab_path: str, pattern: str, id_col="doc_id", text_col="text", tables: float = 1.0, keep: bool = True) -> DataFrame:
    """(id, n_tokens, ids array<int>). ``tables`` scales the bounds of the workers' tables:
    less memory for more work, the same ids. Unless ``keep``, a worker drops its tables at the
    end of every partition, so that it holds nothing while other stages run."""
    x, data = _id_and_text(docs, id_col, text_col), _vocabulary(docs.sparkSession, vocab_path)

    def run(it):
        enc, _ = _Worker.get(data, pattern, tables)

        def row(text):
            ids = np.frombuffer(enc.encode(text or ""), "<u4").astype("int32")
            return len(ids), ids

        try:
            yield from _batches(it, row, ["n_tokens", "ids"], [pa.int64(), pa.list_(pa.int32())])
        finally:
            if not keep:
                del enc, row
                _Worker.release()

    return x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, n_tokens long, ids array<int>")


def round_trip(docs: DataFrame, vocab_path: str, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids as little-endian
    unsigned 32-bit integers and of the text decoded from them."""
    x, data = _id_and_text(docs, id_col, text_col), _vocabulary(docs.sparkSession, vocab_path)

    def run(it):
        enc, dec = _Worker.get(data, pattern)

        def row(text):
            ids = enc.encode(text or "")
            back = hashlib.sha256()
            for part in dec.stream(ids):
                back.update(part.encode())
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), back.hexdigest()

        return _batches(it, row, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()])

    return x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
