import hashlib
import random
import re
import sys
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import pii

from .rows import documents, empty

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


sys.set_int_max_str_digits(0)  # brute force reads whole numbers


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", *m.span()) for m in EMAIL.finditer(t)]
    found += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", *m.span()) for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


def base(t):
    return [s for s in pii.spans(t) if s[0] in pii.BASE_KINDS]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.+- ()9b%:/_é\n0", max_size=60))
def test_base_equals_regexes(t):
    assert base(t) == brute(t)


def test_base_on_made_texts():
    rng = random.Random(4)
    parts = ["a.b@c.de", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (212) 555-0100", "+49 30 1234567", "x@y", "@", ".", "-", " ", "word", "5500-0000-0000-0004", "1.2.3.4.5.6.7.8", "é", "00000000000000"]
    for _ in range(600):
        t = "".join(rng.choices(parts, k=8))
        assert base(t) == brute(t), t


def test_long_numbers_and_logins(spark):
    sys.set_int_max_str_digits(4300)  # as in a worker
    found = [pii.spans(t) for t in ("0" * 5000 + ".1.1.1", "9" * 5000 + ".1.1.1", "0" * 5000 + "255.0.0.256", "https://" + "u" * 300 + ":" + "p" * 3000 + "@host.example")]
    sys.set_int_max_str_digits(0)
    assert found == [[("ip", 0, 5006)], [], [], [("login", 8, 3309), ("email", 309, 3322)]]
    assert pii.find(spark.createDataFrame([(1, "0" * 5000 + ".1.1.1")], "doc_id long, text string")).first().n_ip == 1


def test_more_kinds():
    t = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" iban DE89 3704 0044 0532 0130 00, account no: 12345678 http://joe:pw1@host.example/x'
    assert [(k, t[a:b]) for k, a, b in pii.spans(t) if k not in pii.BASE_KINDS] == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"), ("iban", "DE89 3704 0044 0532 0130 00"), ("account", "12345678"), ("login", "joe:pw1")]
    assert pii.spans("the token was lost, so the account of the password is a mystery 12") == []
    assert pii.redact("mail a@b.cd now") == "mail <email> now"


def test_query_on_awkward_rows(spark):
    docs = documents(spark)
    docs = docs.union(docs.where("doc_id in (3, 5)").selectExpr("doc_id", "'a@b.cd 1.2.3.4' as text", *docs.columns[2:]))
    got = pii.find(docs).collect()
    want = []
    for r in docs.collect():
        b = brute(r.text or "")
        want.append((r.doc_id, *(sum(s[0] == k for s in b) for k in pii.BASE_KINDS), hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in b).encode()).hexdigest()))
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(want, key=str)
    assert pii.find(empty(spark)).count() == 0


def test_long_inputs_take_seconds():
    for text, n in (("1" * 10_000_000, 0), ("token=" * 500_000, 0), ("1." * 500_000, 125_000), ("9" * 2_000_000 + ".1.1.1 10.0.0.1", 1)):
        began = time.time()
        assert len(pii.spans(text)) == n
        assert time.time() - began < 60
