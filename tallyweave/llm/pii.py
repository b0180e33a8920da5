"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds at-signs, schemes, digits and identifier cues. From each anchor a local
parser goes outwards to the borders of what it may be: an email from its at-sign, a number from the run of number
characters around a digit, a secret or an account number behind its cue. Then it is checked: parts of an address, Luhn and
IBAN sums, counts of digits. Matches of a kind don't overlap and the leftmost wins.

Kinds: email, ip, card, phone; then iban, account, secret (a value behind a cue such as ``token =``) and login (user and
password in an URL).

Defined cases: null and empty texts have no spans, an empty table no rows. Very long texts are read whole, in time linear in their
length. Spans of different kinds may overlap; those of equal starts are listed in the order of KINDS. Offsets count code points. Rows are handled one by one,
repeated or not, a null doc_id stays null, and columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, blobs, by_size, doc_rows

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "account", "secret", "login")
_RANK = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBER = frozenset("0123456789+ ().-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9+ ().-]+")
#: Each run of digits is read once: where it doesn't begin an address, none of its digits does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\s*[:=#]?\s*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\s*(?:number|no\.?|nr\.?))?\s*[:=#]\s*([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
_SECRET = re.compile(r"\s*[:=]\s*[\"']?([A-Za-z0-9_\-/+=.]{16,})")
_LOGIN = re.compile(r"[A-Za-z0-9._%+-]++:[^\s@/]++(?=@)")

#: Cues by kind, lower case; they are looked for in lower, upper and title case.
CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "konto", "cuenta", "compte"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key"),
}


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    out.add_word("@", "email")
    out.add_word("://", "login")
    for d in "0123456789":
        out.add_word(d, "number")
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.title()}:
                out.add_word(form, kind)
    out.make_automaton()
    return out


_ANCHORS: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _iban_holds(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _numbers(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """All that a run of number characters holds."""
    for m in _IP.finditer(text, start, end):
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in (own.lstrip("0") for own in m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text, start, end):
        if 14 <= m.end() - m.start() - m[0].count(" ") - m[0].count("-") <= 19:
            if luhn(m[0].replace(" ", "").replace("-", "")):
                yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text, start, end):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield "phone", m.start(), m.end()


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; offsets in code points."""
    if not _ANCHORS:
        _ANCHORS.append(_automaton())
    found: list[tuple[str, int, int]] = []
    upto = dict.fromkeys((*KINDS, "number"), 0)
    for end, kind in _ANCHORS[0].iter(text):
        if kind == "number":
            if end < upto[kind]:
                continue
            start = end
            while start > 0 and text[start - 1] in _NUMBER:
                start -= 1
            stop = _RUN.match(text, start).end()
            upto[kind] = stop
            if stop - start >= 7:
                found += _numbers(text, start, stop)
        elif kind == "email":
            start = end
            while start > upto[kind] and text[start - 1] in _LOCAL:
                start -= 1
            if start < end and (m := _DOMAIN.match(text, end + 1)):
                found.append((kind, start, m.end()))
                upto[kind] = m.end()
        elif kind == "login":
            if m := _LOGIN.match(text, end + 1):
                found.append((kind, m.start(), m.end()))
        elif end >= upto[kind]:
            m = {"iban": _IBAN, "account": _ACCOUNT, "secret": _SECRET}[kind].match(text, end + 1)
            if m and (kind == "account" or kind == "iban" and _iban_holds(m[1]) or kind == "secret" and any(c.isdigit() for c in m[1])):
                found.append((kind, m.start(1), m.end(1)))
                upto[kind] = m.end(1)
            elif m and kind == "secret":  # what has no digit has none behind a later cue either
                upto[kind] = m.end(1)
    return sorted(found, key=lambda s: (s[1], _RANK[s[0]]))


def listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, a, b in spans(text):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join(out) + text[at:]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for each row. One pass, no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, 1, 8 << 20):
                rows = []
                for doc_id, body in zip(part.column(0).to_pylist(), blobs(part.column(1))):
                    found = spans(body.decode("utf-8", "replace"))
                    base = [s for s in found if s[0] in BASE_KINDS]
                    rows.append((doc_id, *(sum(s[0] == k for s in base) for k in BASE_KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)))
                yield batch(schema, *zip(*rows))

    return doc_rows(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
