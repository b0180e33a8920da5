from __future__ import annotations

import hashlib
import random
import re

import pytest

from tallyweave.llm import fill_in_middle as fim

from .rows import documents, empty

AWKWARD = [
    "", "<", "<P", "<P>", "a<P>b", "<<S>", "<P<M>", "<p>", "<PP>", "<P >", "ab<Pab>", "é<M>", "🙂", "🙂a🙂", "日本語 text ß", "a" * 5000, "<" * 5000, "🙂" * 3000,
    "<P" * 2000 + ">", "x" * 255 + "é" + "y" * 255, " \n\t", "A1b2C3", "no<S", "M>", "<M",
]


def plain_reading(doc_id: int | None, text: str | None):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    form = "spm" if h4 % 100 < 20 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def held_against(rows, outputs: bool = True):
    for text, r in rows:
        n, form, prefix, middle, output = plain_reading(r.doc_id, text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle), (r.doc_id, text)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert bytes(r.output) == output.encode() if outputs else r.output is None


def test_against_a_plain_reading(spark):
    rng = random.Random(5)
    pieces = ["<", ">", "P", "S", "M", "<P", "<S>", "word", " ", "é", "🙂", "日", "\n", "1"]
    texts = AWKWARD + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += [None, " ".join("word" * rng.randint(1, 3) for _ in range(40_000)), "long" * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = fim.transform(docs).collect()
    assert len(rows) == len(texts) and {r.form for r in rows} == {"plain", "psm", "spm"}
    held_against((texts[r.doc_id], r) for r in rows)


def test_awkward_rows(spark):
    docs = documents(spark)
    made = fim.transform(docs, keep_output=False)
    kept = {}
    for r in docs.select("doc_id", "text").collect():
        kept.setdefault(r.doc_id, []).append(r.text)
    rows = made.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert any(r.restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and r.n == plain_reading(r.doc_id, t)[0] for t in kept[r.doc_id])
        assert r.output_sha256 in {hashlib.sha256(plain_reading(r.doc_id, t)[4].encode()).hexdigest() for t in kept[r.doc_id]}
    assert fim.transform(empty(spark)).collect() == []


@pytest.mark.parametrize("lanes", [1, 7, 8192])
def test_lanes_agree(monkeypatch, lanes):
    rng = random.Random(lanes)
    joined = "".join(rng.choice("ab<P>S Mé🙂日\n") for _ in range(9000)).encode()
    whole = fim.scan(joined)
    monkeypatch.setattr(fim, "LANES", lanes)
    assert (fim.scan(joined) == whole).all()
    text = joined.decode()
    assert int((whole & fim.UNIT != 0).sum()) == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text)) and int((whole & fim.POINT != 0).sum()) == len(text)
    assert int((whole & fim.SENTINEL != 0).sum()) == len(re.findall("<[PSM]>", text))


def test_shares_are_parameters(spark):
    docs = spark.createDataFrame([(i, f"text number {i} with words") for i in range(50)], "doc_id long, text string")
    assert {r.form for r in fim.transform(docs, transformed=0).collect()} == {"plain"}
    assert {r.form for r in fim.transform(docs, transformed=100, suffix_first=100).collect()} == {"spm"}
    one, other = fim.transform(docs), fim.transform(docs, seed=2)
    assert one.select("output").collect() != other.select("output").collect()
