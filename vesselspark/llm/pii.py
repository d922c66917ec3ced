"""Personal data: an Aho-Corasick automaton finds anchors in whole texts, local parsers expand each anchor to a span and validate it."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import slices

#: Kinds in the order of results; the base ones first.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account", "secret")
#: Characters of an address's local part, and what comes right of an anchor.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIALLED = re.compile(r"[ ().0-9-]+")
AUTHORITY = re.compile(r"(?:([^\s/?#@\"'<>\[\]]+)@)?(\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9.-]+)(?::[0-9]{1,5})?(?:[/?#][^\s\"'<>]*)?")
#: Words that announce an identifier, by what its parser expects.
CUES = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security"),
    "account": ("account", "acct", "routing", "passport", "konto", "kontonummer", "compte", "cuenta", "passeport", "pasaporte", "reisepass"),
    "secret": ("token", "api_key", "api-key", "apikey", "secret", "password", "passwd"),
}
#: Between a cue and its identifier: a word for number, a mark or two.
BETWEEN = re.compile(r"[ \t]*(?:(?:number|num|no|nr|id|key)\b\.?)?[ \t]*[:=#]{0,2}[ \t]*[\"']?", re.IGNORECASE)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
SSN = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9])")
NUMBER = re.compile(r"[A-Z]{0,2}[0-9](?:[ -]?[0-9]){5,16}(?![0-9A-Za-z])")
SECRET = re.compile(r"(?=[A-Za-z_.~+/-]*[0-9])[A-Za-z0-9_.~+/-]{16,}")


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def iban_holds(text: str) -> bool:
    """The check number of an account in international form."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


class Finder:
    """Anchors of all kinds in one automaton; each kind has a parser that takes (text, anchor's first place, anchor's end, where the kind's
    last match ended) and returns (span or None, whether it is valid). A match that fails its check still ends there."""

    def __init__(self) -> None:
        self.anchors = ahocorasick.Automaton()
        digits = "0123456789"
        known = {"@": "email", "://": "address"} | {"+" + d: "phone" for d in digits} | {d + ".": "ip" for d in digits}
        known |= {a + mark + b: "card" for a in digits for b in digits for mark in ("", " ", "-")}
        known |= {form: kind for kind, words in CUES.items() for w in words for form in (w, w.capitalize(), w.upper())}
        for anchor, kind in known.items():
            self.anchors.add_word(anchor, (kind, len(anchor)))
        self.anchors.make_automaton()
        self.parsers = {kind: getattr(self, kind) for kind in {*known.values()}}

    def email(self, text: str, first: int, end: int, least: int):
        begin = first
        while begin > least and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, end) if begin < first else None
        return ((begin, domain.end()), True) if domain else None

    def ip(self, text: str, first: int, end: int, least: int):
        while first > least and text[first - 1] in DIGITS:
            first -= 1
        quad = QUAD.match(text, first)
        # a part of any length is a number, but only short ones can be small
        return ((first, quad.end()), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in quad.groups())) if quad else None

    def card(self, text: str, first: int, end: int, least: int):
        chain = CHAIN.match(text, first)
        if chain.end() - first > 64:  # no more than 19 digits have a mark each between them
            return (first, chain.end()), False
        digits = chain[0].replace(" ", "").replace("-", "")
        return (first, chain.end()), 16 <= len(digits) <= 19 and luhn(digits)

    def phone(self, text: str, first: int, end: int, least: int):
        run = DIALLED.match(text, end)
        size = len(run[0].rstrip(" ().-")) if run else 0
        if size < 2:
            return None
        return (first, end + size), 8 <= sum(c in DIGITS for c in text[first : end + size]) <= 15

    def address(self, text: str, first: int, end: int, least: int):
        """A web address that tells a person's access or machine: with a user before the host, or with a number as host."""
        begin = first
        while begin > least and text[begin - 1] in SCHEME:
            begin -= 1
        while begin < first and not text[begin].isalpha():
            begin += 1
        found = AUTHORITY.match(text, end) if begin < first else None
        if not found:
            return None
        host = found[2].strip("[]")
        try:
            numbered = bool(ipaddress.ip_address(host))
        except ValueError:
            numbered = False
        size = len(found[0].rstrip(".,;:!?)")) if found[0][-1:] in ".,;:!?)" else len(found[0])
        return ((begin, end + size), True) if numbered or found[1] else None

    def after(self, text: str, first: int, end: int, pattern: re.Pattern) -> re.Match | None:
        """What follows a cue that is a word of its own."""
        if (first and text[first - 1].isalnum()) or text[end : end + 1].isalnum():
            return None
        return pattern.match(text, BETWEEN.match(text, end).end())

    def iban(self, text: str, first: int, end: int, least: int):
        found = self.after(text, first, end, IBAN)
        # the longest part that ends a group and holds the check number
        for size in sorted({m.end() for m in re.finditer(r"[A-Z0-9]+", found[0])} | {len(found[0])}, reverse=True) if found else ():
            tight = found[0][:size].replace(" ", "")
            if 15 <= len(tight) <= 34 and iban_holds(tight):
                return (found.start(), found.start() + size), True
        return None

    def ssn(self, text: str, first: int, end: int, least: int):
        found = self.after(text, first, end, SSN)
        good = found and found[1] not in ("000", "666") and found[1] < "900" and found[2] != "00" and found[3] != "0000"
        return (found.span(), True) if good else None

    def account(self, text: str, first: int, end: int, least: int):
        found = self.after(text, first, end, NUMBER)
        return (found.span(), True) if found else None

    def secret(self, text: str, first: int, end: int, least: int):
        found = self.after(text, first, end, SECRET)
        return (found.span(), True) if found else None

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, first, end) by kind, then place. Spans of kinds beyond the base ones yield to base spans they touch and to earlier ones."""
        spans: list[tuple[int, int, int]] = []
        ended = dict.fromkeys(self.parsers, 0)
        for last, (kind, size) in self.anchors.iter(text):
            first = last + 1 - size
            if first < ended[kind]:
                continue
            found = self.parsers[kind](text, first, last + 1, ended[kind])
            if found:
                (begin, end), good = found
                ended[kind] = end
                if good:
                    spans.append((KINDS.index("account" if kind in ("iban", "ssn") else kind), begin, end))
        spans.sort()
        base = [s for s in spans if s[0] < len(BASE)]
        own = [s for s in spans if s[0] >= len(BASE)]
        if own:
            taken, kept, at, until = sorted((b, e) for _, b, e in base), [], 0, 0
            for kind, begin, end in sorted(own, key=lambda s: (s[1], s[0])):
                while at < len(taken) and taken[at][1] <= begin:
                    at += 1
                # base spans of several kinds may overlap; any that reaches into the span counts
                if begin >= until and not any(b < end and e > begin for b, e in taken[max(at - len(BASE), 0) : at + len(BASE)]):
                    kept.append((kind, begin, end))
                    until = end
            own = sorted(kept)
        return [(KINDS[k], b, e) for k, b, e in base + own]


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span's kind in place of it; of spans that overlap the first to begin names them all."""
    out, at = [], 0
    for kind, begin, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin >= at:
            out += [text[at:begin], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: bool = False) -> DataFrame:
    """For each row of docs: doc_id and spans (kind, first, end) in code points, end exclusive, by kind, then place; with mask also the text with its spans masked.

    Base kinds: email, ip (parts at most 255), card (16 to 19 digits, Luhn) and phone (8 to 15 digits), each as the leftmost matches that
    don't overlap; one that fails its check is dropped with all its characters. Further kinds, which base spans go before: address
    (a URL with a user or a numbered host), account (what follows a cue: an international account number that checks, a social
    security number, digits) and secret (a long key after a cue). Anchors are read once; parsers look only around them, and what two
    neighbouring anchors of a kind look at doesn't overlap but for a part of bounded number, so a text costs time in proportion to its length. Null counts as empty.
    Rows stand alone: ties, repeated rows and null ids are kept as they are.
    """
    span = pa.struct([("kind", pa.string()), ("first", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            spans = [finder.find(t) for t in texts]
            columns = [batch.column("doc_id"), pa.array([[{"kind": k, "first": b, "end": e} for k, b, e in s] for s in spans], pa.list_(span))]
            if mask:
                columns.append(pa.array([masked(t, s) for t, s in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "spans", "masked"][: len(columns)])

    fields = "doc_id long, spans array<struct<kind: string, first: long, end: long>>" + ", masked string" * mask
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, fields)
