"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, URL schemes and
identifier cues. From each anchor a local parser expands and validates what it finds: e-mail
addresses to both sides of an at-sign; phone numbers from a plus sign; IPv4 addresses and payment
cards (Luhn) from the first digit of a run; credentials in URLs, IBANs (mod 97) and values after
cues such as ``token =`` or ``passport:``. No pattern is searched for in the whole text. The
first four are the base kinds, which equal a leftmost non-overlapping match of their patterns: an
anchor inside the last match of its kind is passed over, and a candidate that fails its check is
dropped without a retry.

Defined results: a null or empty text has no spans; offsets count code points; spans of several
kinds at one place are all given; a text of any length is read whole, in one pass; repeated rows
are read alike, row by row; extra columns are passed on, and one named like the result is replaced;
an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanegrid.runtime import small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("credential", "iban", "secret", "identifier")
_ORDER = {kind: i for i, kind in enumerate(BASE_KINDS + EXTRA_KINDS)}
#: Anchor -> parser; matched in lower case.
ANCHORS = {
    "@": "email",
    "+": "phone",
    **dict.fromkeys("0123456789", "number"),
    "://": "credential",
    "iban": "iban",
    "token": "secret", "api_key": "secret", "apikey": "secret", "api key": "secret", "secret": "secret", "password": "secret", "passwd": "secret",
    "passport": "identifier", "ssn": "identifier", "social security": "identifier", "account": "identifier", "acct": "identifier", "tax id": "identifier", "licence no": "identifier", "license no": "identifier",
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USER = re.compile(r"[^\s/@:]+:[^\s/@]+@")
_IBAN = re.compile(r"[\s:=#]{0,4}([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,40})")
_SECRET = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_./+=-]{12,})")
_IDENTIFIER = re.compile(r"(?: (?:number|no\.?|id|#))?\s{0,2}[:=#]?\s{0,2}([A-Za-z]{0,3}[0-9](?:[ -]?[A-Za-z0-9]){5,19})(?![A-Za-z0-9])")


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor, parser in ANCHORS.items():
        found.add_word(anchor, (parser, len(anchor)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _iban(text: str) -> str:
    """The longest valid account number that starts the text and ends where a group of its characters does."""
    while text:
        code = text.replace(" ", "").upper()
        if 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return text
        text = text.rpartition(" ")[0]
    return ""


def _is_ip(text: str) -> bool:
    return all(len(part) <= 3 and int(part or 0) <= 255 for part in (p.lstrip("0") for p in text.split(".")))


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 14 <= len(digits) <= 19 and _luhn(digits)


_DIGIT = re.compile(r"[0-9]")


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, by start, then kind."""
    found: list[tuple[str, int, int]] = []
    if not text:
        return found
    lower = text.lower()
    if len(lower) != len(text):  # a letter whose lower case is longer: only A-Z then, so that offsets hold
        lower = "".join(c.lower() if c < "\x80" else c for c in text)
    taken = dict.fromkeys(BASE_KINDS, 0)  # where the last match of a kind ends

    def expand(kind: str, pattern: re.Pattern, at: int, valid: Callable[[str], bool]) -> None:
        if at >= taken[kind] and (m := pattern.match(text, at)):
            taken[kind] = m.end()
            if valid(m[0]):
                found.append((kind, at, m.end()))

    for last, (parser, size) in _automaton().iter(lower):
        at = last + 1 - size
        if parser == "email":
            start = at
            while start > taken["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                found.append(("email", start, m.end()))
                taken["email"] = m.end()
        elif parser == "phone":
            expand("phone", _PHONE, at, lambda t: 10 <= len(_digits(t)) <= 15)
        elif parser == "number":
            if not at or text[at - 1] not in _DIGITS:  # a match starts where a run of digits does
                expand("ip", _IP, at, _is_ip)
                expand("card", _CARD, at, _is_card)
        elif parser == "credential":
            if m := _USER.match(text, last + 1):
                found.append(("credential", last + 1, m.end() - 1))
        elif parser == "iban":
            if (m := _IBAN.match(text, last + 1)) and (code := _iban(m[1])):
                found.append(("iban", m.start(1), m.start(1) + len(code)))
        elif parser == "secret":
            if (m := _SECRET.match(text, last + 1)) and _DIGIT.search(m[1]):
                found.append(("secret", *m.span(1)))
        elif m := _IDENTIFIER.match(text, last + 1):
            if len(_digits(m[1])) >= 6:
                found.append(("identifier", *m.span(1)))
    found = sorted(set(found), key=lambda s: (s[1], _ORDER[s[0]], s[2]))
    return found


def _found(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in texts], dtype=object)


def find_spans(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with an array of spans (kind, start, end in code points), by start, then kind."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, F.pandas_udf(_found, "array<struct<kind:string,start:long,end:long>>")(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in angle brackets; of overlapping spans the first counts."""

    @F.pandas_udf("string")
    def _redact(texts: pd.Series) -> pd.Series:
        out = []
        for value in texts:
            parts, at = [], 0
            for kind, start, end in find(value):
                if start >= at:
                    parts += [value[at:start], f"<{kind}>"]
                    at = end
            out.append(None if value is None else "".join([*parts, value[at:]]))
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, _redact(F.col(text)))
