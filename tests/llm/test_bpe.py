import base64
import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from talentgrid.llm import bpe  # noqa: E402
from tests.llm.helpers import awkward_rows, documents  # noqa: E402

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_the_merges(ranks):
    machine, rng = bpe.Transducer(ranks), random.Random(2)
    for _ in range(3000):
        piece = "".join(chr(rng.choice([rng.randint(97, 122), rng.randint(192, 400), 0x4E2D])) for _ in range(rng.randint(1, 25))).encode()
        assert [machine.bytes_of[t] for t in machine.encode(piece)] == bpe.merged(piece, ranks)


def test_transducer_emits_early(ranks):
    """Tokens come while bytes still arrive, after a bounded delay."""
    machine, state, out, delay = bpe.Transducer(ranks), 0, [], 0
    data = ("internationalisation " * 40).replace(" ", "").encode()
    for i, b in enumerate(data):
        state, sure = machine.step(state, b)
        out += sure
        delay = max(delay, i + 1 - sum(len(machine.bytes_of[t]) for t in out))
    assert delay < 100 and len(out) > 100


def test_small_tables_give_the_same(ranks, library, monkeypatch):
    for name in ("MAX_STATES", "MAX_PAIRS", "MAX_PIECES", "MAX_CHUNKS"):
        monkeypatch.setattr(bpe, name, 5)
    enc, rng = bpe.Encoder(ranks, P.PATTERN), random.Random(4)
    for _ in range(300):
        t = " ".join(rng.choice(["the", "then,", "naïve", "12", "x_y", "\n", "", "'s"]) for _ in range(12))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == library.encode_ordinary(t)


def test_odd_white_space_and_scripts(ranks, library):
    enc, dec, rng = bpe.Encoder(ranks, P.PATTERN), bpe.Decoder(ranks), random.Random(3)
    parts = [" ", "  ", "\n", " \n", "\t", " ", " ", "\u0085", "\x1c", "​", "'s", "'ll", "a", "the", "é", "日本",
             "🙂", "١٢", "½", "ª", "̀", "\x00", "|", "##", "23", "_", "İ"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        ids = enc.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert "".join(dec.stream(ids, 1)) == t


def test_utf8_stream_holds_back_and_replaces():
    s = bpe.Utf8Stream()
    assert [s.feed(bytes([b])) for b in "é🙂".encode()] == ["", "é", "", "", "", "🙂"]
    rng = random.Random(1)
    for _ in range(2000):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0xFF, 0xED, 0xA0]) for _ in range(rng.randint(0, 9)))
        s = bpe.Utf8Stream()
        whole = "".join(s.feed(data[i:i + 1]) for i in range(len(data))) + s.close()
        t = bpe.Utf8Stream()
        assert whole == t.feed(data) + t.close()
        try:
            assert whole == data.decode()
        except UnicodeDecodeError:
            assert "�" in whole


def test_round_trip_query(spark, library):
    rows = awkward_rows()
    got = bpe.round_trip(documents(spark, rows, clash=True), PATH, P.PATTERN).collect()
    want = []
    for i, text, *_ in rows:
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.round_trip(documents(spark, []), PATH, P.PATTERN).count() == 0
    ids = {r.id: r.ids for r in bpe.encode(documents(spark, rows[:5]), PATH, P.PATTERN).collect()}
    assert ids[0] == library.encode_ordinary(rows[0][1])


def test_large_vocabulary_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_VOCAB_BYTES", 10)
    with pytest.raises(ValueError):
        bpe.encode(documents(spark, []), PATH, P.PATTERN)
    assert base64.b64decode("QQ==") == b"A"
