"""Personal data by anchor expansion.

One Aho-Corasick pass over a text, with digits written as 0 and A-Z as a-z, finds the anchors:
at-signs in several writings, schemes, digits next to digits, dots or a plus sign, and the words
that announce an identifier. From each anchor a local parser of its kind goes outwards as far as
the kind's characters go, checks the boundaries, and validates: part values, digit counts, check
digits. Every parser moves on from where it stopped, so a text is read a bounded number of times
whatever it holds.

Base spans are those of the patterns in BASE, leftmost and without overlap in each kind. Added to
them are: addresses with letters beyond ASCII and written-out at-signs and dots, account names in
the authority of a URL, numbers after tel: and after words for a telephone, IPv6 addresses, and
after their cue IBANs (mod 97), account numbers and personal numbers. Kinds stand in the order of KINDS.

Defined cases: a null or empty text has no spans; repeated rows and ids give a row each; whole
texts are read whatever their length; an empty table gives no rows; other columns of the input are
ignored.
"""

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from fairline.llm.words import sliced

KINDS = ("email", "ip", "card", "phone", "account", "person")
#: The base spans' patterns, for readers and tests; the parsers below find the same without them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What an anchor's text is as the automaton sees it. The words that announce an identifier.
ANCHORS = {"@": "email", "\xef\xbc\xa0": "wide", "[at]": "wide", "(at)": "wide", "{at}": "wide", "0.0": "ip", "::": "ipv6", "00": "card", "0 0": "card", "0-0": "card", "+0": "phone", "tel:": "tel", "://": "scheme"}
CUES = {
    "iban": "iban",
    "account": "account", "acct": "account", "konto": "account", "kontonummer": "account", "compte": "account", "cuenta": "account",
    "phone": "call", "telephone": "call", "telefon": "call", "téléphone": "call", "teléfono": "call", "mobile": "call", "handy": "call",
    "ssn": "person", "social security": "person",
}
FOLDED = bytes(48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset(b"0123456789")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
#: The characters around a written-out at-sign, in text.
WIDE_DOMAIN = re.compile(r"\s?\w[\w-]*(?:(?:\.|\s?[\[({]dot[\])}]\s?)\w[\w-]*)+", re.I)
CALLED = re.compile(r"(?:\s?(?:number|no\.?|nummer|#))?\s?[:=]?\s?(\(?[0-9][ ().0-9/-]+[0-9])", re.I)
TEL = re.compile(r"\+?[0-9][0-9().-]+[0-9]")
NUMBERED = re.compile(r"(?:\s?(?:number|no\.?|nr\.?|nummer|num[eé]ro|#))?\s?[:=#]\s?([0-9][0-9 -]{4,22}[0-9])(?![0-9A-Za-z])", re.I)
IBAN = re.compile(r"(?:\s?(?:number|no\.?|nr\.?|nummer))?\s?[:=]?\s?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
PERSON = re.compile(r"(?:\s?(?:number|no\.?))?\s?[:=#]?\s?([0-9]{3})[- ]([0-9]{2})[- ]([0-9]{4})(?![0-9-])", re.I)
IPV6 = re.compile(rb"[0-9A-Fa-f:]+(?:\.[0-9]+)*")
Span = tuple[str, int, int]


def passes_luhn(digits: bytes) -> bool:
    total = sum(digits[-1::-2]) - 48 * len(digits[-1::-2])
    return (total + sum((2 * d - 96) // 10 + (2 * d - 96) % 10 for d in digits[-2::-2])) % 10 == 0


def only_digits(data: bytes) -> bytes:
    return bytes(b for b in data if b in DIGITS)


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for text, kind in ANCHORS.items():
        machine.add_word(text, (kind, len(text)))
    for word, kind in CUES.items():
        text = word.encode().decode("latin1")
        machine.add_word(text, (kind, len(text)))
    machine.make_automaton()
    return machine


class Text:
    """One text as bytes, and where each kind's next base span may begin."""

    def __init__(self, text: str) -> None:
        self.data = text.encode()
        self.plain = len(self.data) == len(text)
        self.next = dict.fromkeys((*KINDS, "chain"), 0)

    def email(self, at: int) -> Iterator[Span]:
        """Left over the local part's characters, right over labels and dots."""
        data, start = self.data, at
        least = self.next["email"]
        while start > least and data[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(data, at + 1)):
            self.next["email"] = domain.end()
            yield "email", start, domain.end()

    def wide(self, at: int, after: int) -> Iterator[Span]:
        """An address whose at-sign, dots or letters are not plain ones: letters and digits of any alphabet on both sides."""
        data, begin = self.data, at
        while begin > max(0, at - 1) and data[begin - 1] == 32:  # one space before a written-out sign
            begin -= 1
        edge = begin
        while begin and (data[begin - 1] in LOCAL or data[begin - 1] >= 128):
            begin -= 1
        local = data[begin:edge].decode()
        n = len(local)
        while n and (local[n - 1].isalnum() or local[n - 1] in "._%+-"):
            n -= 1
        own = local[n:].lstrip(".-+%")
        end = after
        while end < len(data) and (data[end] in LOCAL or data[end] >= 128 or data[end] in b" [](){}") and end - after < 400:
            end += 1
        domain = WIDE_DOMAIN.match(data[after:end].decode(errors="ignore"))
        if own and domain and domain[0].rsplit(".")[-1].strip()[-1:].isalpha():
            yield "email", edge - len(own.encode()), after + len(domain[0].encode())

    def ip(self, at: int) -> Iterator[Span]:
        """A chain of numbers and single dots, four at a time."""
        data, start = self.data, at
        if at < self.next["chain"]:
            return
        while start and data[start - 1] in DIGITS:
            start -= 1
        chain = CHAIN.match(data, start)
        self.next["chain"] = chain.end()
        parts = chain[0].split(b".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(int(p.lstrip(b"0")[:4] or b"0") <= 255 for p in four):
                yield "ip", start, end
            start = end + 1

    def ipv6(self, at: int) -> Iterator[Span]:
        data, start = self.data, at
        while start and at - start < 40 and data[start - 1] in b"0123456789abcdefABCDEF:":
            start -= 1
        found = IPV6.match(data, start, start + 60)
        if found and at >= self.next["ip"] and found.end() - start >= 6 and any(b in DIGITS for b in found[0]) and not (start and chr(data[start - 1]).isalnum()) and data[found.end() : found.end() + 1].isalnum() is False:
            self.next["ip"] = found.end()
            try:
                if len([p for p in ipaddress.IPv6Address(found[0].decode()).exploded.split(":") if int(p, 16)]) >= 3:
                    yield "ip", start, found.end()
            except ValueError:
                pass

    def card(self, at: int) -> Iterator[Span]:
        if at < self.next["card"]:
            return
        chain = CARD.match(self.data, at)
        self.next["card"] = chain.end()
        if chain.end() - at >= 14 and 14 <= len(digits := only_digits(chain[0])) <= 19 and passes_luhn(digits):
            yield "card", at, chain.end()

    def phone(self, at: int) -> Iterator[Span]:
        if (found := PHONE.match(self.data, at)) and 10 <= len(only_digits(found[0])) <= 15:
            yield "phone", at, found.end()

    def tel(self, at: int, length: int) -> Iterator[Span]:
        yield from self.after(TEL, at, length, "phone", lambda m: 7 <= len(only_digits(m[0].encode())) <= 15, 0)

    def call(self, at: int, length: int) -> Iterator[Span]:
        yield from self.after(CALLED, at, length, "phone", lambda m: 7 <= len(only_digits(m[1].encode())) <= 15)

    def account(self, at: int, length: int) -> Iterator[Span]:
        yield from self.after(NUMBERED, at, length, "account", lambda m: 6 <= len(only_digits(m[1].encode())) <= 18)

    def iban(self, at: int, length: int) -> Iterator[Span]:
        def valid(m: re.Match) -> bool:
            code = m[1].replace(" ", "")
            return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1

        yield from self.after(IBAN, at, length, "account", valid)

    def person(self, at: int, length: int) -> Iterator[Span]:
        """A number of three, two and four digits, none of them all zeros, the first neither 666 nor from 900 on."""
        for kind, start, end in self.after(PERSON, at, length, "person", lambda m: m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000", 1):
            yield kind, start, end + 8

    def after(self, pattern: re.Pattern, at: int, length: int, kind: str, valid: Callable[[re.Match], bool], group: int = 1) -> Iterator[Span]:
        """The span of a pattern's group right after a cue that begins a word."""
        data, end = self.data, at + length
        if at and (chr(data[at - 1]).isalnum() or data[at - 1] >= 128):
            return
        text = data[end : end + 120].decode(errors="ignore")
        if (found := pattern.match(text)) and valid(found):
            yield kind, end + len(text[: found.start(group)].encode()), end + len(text[: found.end(group)].encode())

    def scheme(self, at: int) -> Iterator[Span]:
        """The account name between a scheme and an at-sign, without a password."""
        data, end = self.data, at + 3
        while end < len(data) and (data[end] in LOCAL or data[end] in b":~!$&'()*,;=") and end - at < 300:
            end += 1
        name = data[at + 3 : end].split(b":")[0]
        if data[end : end + 1] == b"@" and name and at and chr(data[at - 1]).isalnum():
            yield "account", at + 3, at + 3 + len(name)


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """Base and added spans of a text in code points, each in order of start, kind and end."""
    own = Text(text)
    data = own.data
    base: list[Span] = []
    added: list[Span] = []
    for end, (kind, length) in automaton().iter(data.translate(FOLDED).decode("latin1")):
        at = end + 1 - length
        if kind == "card":
            base += own.card(at)
        elif kind == "ip":
            base += own.ip(at)
        elif kind == "phone":
            base += own.phone(at)
        elif kind == "email":
            base += own.email(at)
            if not own.plain:
                added += [s for s in own.wide(at, at + 1) if not data[s[1] : s[2]].isascii()]
        elif kind == "wide":
            added += own.wide(at, end + 1)
        elif kind in ("ipv6", "scheme"):
            added += getattr(own, kind)(at)
        else:
            added += getattr(own, kind)(at, length)
    if not base and not added:
        return base, added
    known = set(base)
    added = [s for s in dict.fromkeys(added) if s not in known]
    if not own.plain:
        places, chars, before = {}, 0, 0
        for p in sorted({p for _, a, b in (*base, *added) for p in (a, b)}):
            chars += len(data[before:p].decode())
            places[p], before = chars, p
        base, added = ([(k, places[a], places[b]) for k, a, b in some] for some in (base, added))
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(added, key=order)


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every document."""
    names = [key, *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                counts, digests, written_spans = [], [], []
                for x in part.column("text"):
                    base, added = spans_of(x.as_py() or "")
                    kinds = [s[0] for s in base]
                    counts.append([kinds.count(k) for k in BASE])
                    digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                    written_spans.append(written(sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))) if added else written(base))
                columns = zip(*counts, strict=True) if counts else [[]] * len(BASE)
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string()), pa.array(written_spans, pa.string())], names=names)

    schema = f"{key} long, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string"
    return docs.select(key, "text").mapInArrow(find, schema)
