"""Operator 5, personal data: anchors by Aho-Corasick, expanded by local parsers.

One automaton pass over a text finds at-signs, plus signs, digits, schemes
and identifier cues.  Deterministic parsers expand each anchor to the left
and right, validate it (octets, Luhn, digit counts, IBAN check) and keep the
leftmost non-overlapping spans of each kind.  Every parser moves forward, and
overlaps are looked up in sorted spans, so time is about linear in the text's
length.  No span has a bound on its length but those of its format.

Base kinds: email, ip, card, phone.  Kinds the cues add: iban, account, ssn
and login (user:password in a url); these never overlap another span.

Runs batch by batch in Arrow without a shuffle; a batch is bounded in rows and
bytes.  Defined cases: null and empty texts have no spans; whole texts are
read, however long; repeated rows are judged alike; an empty table gives no
rows; other columns of the input pass through, one named `out` is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import slices

BATCH_BYTES = 16 << 20
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "ssn", "login")
CUES = {"iban": ("iban",), "account": ("account", "acct", "konto", "compte", "cuenta"), "ssn": ("ssn", "social security")}
SCHEMES = ("://",)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIAL = re.compile(r"[ ().0-9-]+")
NOT_DIGIT = re.compile(r"[^0-9]+")
IBAN = re.compile(r"(?i:[ ]?(?:number|no\.?|nr\.?))?[\s:#]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?:[ ]?(?:number|no\.?|nr\.?))?[\s:#]{1,4}([0-9][0-9-]{4,17}[0-9])(?![0-9])", re.I)
SSN = re.compile(r"(?i:[ ]?(?:number|no\.?|nr\.?))?[\s:#]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
LOGIN = re.compile(r"([^\s/@:]++:[^\s/@]++)@[A-Za-z0-9.-]+")  # up to the next slash, so no two anchors read the same letters


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i & 1:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _iban(value: str) -> bool:
    v = value.replace(" ", "")
    if not 15 <= len(v) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _iban_end(text: str, a: int, b: int) -> int:
    """The last end of a word up to b at which the checksum holds, or 0: a word after the number may have been read with it."""
    while b > a and not _iban(text[a:b]):
        b = text.rfind(" ", a, b)
    return max(b, 0)


def _lower(text: str) -> str:
    """In lower case, each letter at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Taken:
    """Sorted spans that have been given away; those added come from left to right."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)
        self.more: list[tuple[int, int]] = []

    def add(self, a: int, b: int) -> bool:
        """Take a span unless it overlaps one."""
        i = bisect_left(self.starts, b) - 1
        k = bisect_left(self.more, (b,)) - 1
        if (i >= 0 and self.ends[i] > a) or (k >= 0 and self.more[k][1] > a):
            return False
        self.more.insert(k + 1, (a, b))
        return True


def automaton():
    """Anchors in lower case: the letter itself, or the kind that a cue opens."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for ch in "@+0123456789":
        a.add_word(ch, (ch, 1))
    for s in SCHEMES:
        a.add_word(s, ("login", len(s)))
    for kind, cues in CUES.items():
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def find(text: str, anchors) -> list[tuple[int, int, int]]:
    """Spans (kind number, start, end), by kind, then start."""
    email, ip, card, phone, more = [], [], [], [], []
    email_at = ip_at = card_at = phone_at = 0
    n = len(text)
    for end, (what, size) in anchors.iter(_lower(text)):
        if what == "@":
            left = end
            while left > email_at and text[left - 1] in LOCAL:
                left -= 1
            if left < end and (m := DOMAIN.match(text, end + 1)):
                email.append((0, left, m.end()))
                email_at = m.end()
        elif what == "+":
            if end >= phone_at and end + 2 < n and "0" <= text[end + 1] <= "9" and (m := DIAL.match(text, end + 2)):
                last = m.end() - 1
                while last >= end + 3 and not "0" <= text[last] <= "9":
                    last -= 1
                if last >= end + 3:
                    phone_at = last + 1
                    if 9 <= len(NOT_DIGIT.sub("", text[end:phone_at])) <= 15:
                        phone.append((3, end, phone_at))
        elif size == 1:
            if end >= ip_at and (end == ip_at or end == 0 or not "0" <= text[end - 1] <= "9") and (m := QUAD.match(text, end)):
                ip_at = m.end()
                if all(map(_octet, m.group().split("."))):
                    ip.append((1, end, ip_at))
            if end >= card_at and (m := CHAIN.match(text, end)):
                card_at = m.end()
                if card_at - end >= 13 and 13 <= len(digits := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
                    card.append((2, end, card_at))
        else:
            more.append((what, end + 1))
    found = email + ip + card + phone
    if more:
        taken = Taken([(a, b) for _, a, b in found])
        for what, at in more:
            if what == "login":
                m = LOGIN.match(text, at)
            else:
                m = {"iban": IBAN, "account": ACCOUNT, "ssn": SSN}[what].match(text, at)
            if m:
                a, b = m.span(1)
                if what == "iban":
                    b = _iban_end(text, a, b)
                if b > a and taken.add(a, b):
                    found.append((KINDS.index(what), a, b))
        found.sort()
    return found


def scan(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add `out`, an array of (kind, start, end), to docs; offsets in code points."""
    rest = [c for c in docs.columns if c.lower() != out.lower()]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(out, T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in slices(it, text, BATCH_BYTES):
            found = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in find(t, anchors)] if t else [] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(found, pa.list_(item))], [*rest, out])

    return docs.select(*rest).mapInArrow(batches, schema)


def joined(found):
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
