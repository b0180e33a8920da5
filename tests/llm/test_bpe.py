import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import bpe
from tallyweave.llm.queries import RANKS

from .rows import documents, empty, texts

V = bpe.vocabulary(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=V.ranks, special_tokens={})


def ids(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def test_awkward_texts():
    for t in texts():
        assert ids(V.encode(t or "")) == ENC.encode_ordinary(t or "")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_round_trips(t):
    t = t.encode("utf-8", "replace").decode()
    assert ids(V.encode(t)) == ENC.encode_ordinary(t)
    assert V.decode(V.encode(t)) == t.encode()


def test_memory_bound_changes_nothing(monkeypatch):
    want = [V.encode(t or "") for t in texts()]
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    fresh = bpe.Vocabulary(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    assert fresh.encode_all([t or "" for t in texts()]) == want


def test_edits_and_appends_equal_new_encodings():
    rng = random.Random(5)
    parts = ["the", " ", "  ", "\n", "é", "nder", "12", "!", "'s", "schen", " a"]
    for _ in range(60):
        table = bpe.PrefixTable(V, "".join(rng.choices(parts, k=20)))
        for _ in range(6):
            a = rng.randint(0, len(table.text))
            b = rng.randint(a, len(table.text))
            new = "".join(rng.choices(parts, k=2))
            table.append(new) if rng.random() < 0.4 else table.replace(a, b, new)
            assert table.ids() == ENC.encode_ordinary(table.text)


def test_an_edit_touches_few_pieces():
    table = bpe.PrefixTable(V, "some words " * 2000)
    table.replace(5000, 5003, "xyz")
    assert table.recomputed < 8
    table.append(" more")
    assert table.recomputed < 8


def test_query_shape(spark):
    docs = documents(spark)
    got = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    want = []
    for r in docs.collect():
        t = r.text or ""
        e = ENC.encode_ordinary(t)
        want.append((r.doc_id, len(e), hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, got.drop("ids", "decoded").collect()), key=str) == sorted(want, key=str)
    assert bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_unreachable_token_is_an_error():
    v = bpe.Vocabulary(b"YQ== 0\nYg== 1\nYWI= 2\n", r"\w+")
    assert ids(v.encode("ab")) == [2]
    with pytest.raises((KeyError, ValueError)):
        v.encode("ac")
