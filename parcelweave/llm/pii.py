"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes and identifier
cues, these two in any case.  From each anchor a deterministic parser expands to the boundaries of one kind and
validates what it has found.  Within a kind, spans are leftmost and don't overlap; what fails
validation is dropped and not tried again.

Base kinds: email, ip, card, phone.  Added kinds: ``login`` (a scheme with user and password, or
with an address for a host), ``iban`` (after its cue, by its check digits), ``ssn`` and
``account`` (numbers after their cues).

Edge cases: a null or empty text has no spans; a text of any length is searched whole; offsets are
code points, ends exclusive; repeated rows are searched alike; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame

from parcelweave.llm.spans import Span, find, redact

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "ssn", "account")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://", "amqp://")
CUES = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security"),
    "account": ("account", "acct", "passport", "customer id", "customer no", "konto", "kundennummer", "compte", "cuenta"),
}
#: Cues that must not be the end of a word.
ALONE = ("iban", "ssn")
#: Lengths of account numbers by country in the registry of ISO 13616; fixed values.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"(?:[^\s/@:\"'<>]+:[^\s/@\"'<>]+@[A-Za-z0-9.-]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[[0-9A-Fa-f:.]+\])(?::[0-9]+)?")
AFTER = {
    "iban": re.compile(r"(?:\x20(?:number|no\.?|nr\.?))?[\x20:#=.]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})", re.ASCII | re.IGNORECASE),
    "ssn": re.compile(r"(?:\x20(?:number|no\.?))?[\x20:#=.]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])", re.ASCII | re.IGNORECASE),
    "account": re.compile(r"(?:\x20(?:number|no\.?|nr\.?|id))?[\x20:#=]{1,4}([A-Z]{0,2}[0-9](?:[\x20-]?[0-9]){5,19})(?![0-9A-Za-z])", re.ASCII | re.IGNORECASE),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_length(text: str) -> int:
    """The length of the prefix that is an account number by its check digits; of a country that is not listed the longest; else 0."""
    best, seen = 0, ""
    size = IBAN_LENGTHS.get(text[:2].upper())
    for i, c in enumerate(text):
        if c == " ":
            continue
        seen += c
        if (len(seen) == size if size else 15 <= len(seen) <= 34) and int("".join(str(int(x, 36)) for x in seen[4:] + seen[:4])) % 97 == 1:
            best = i + 1
    return best


def lowered(text: str) -> str:
    """In lower case, but for the few letters that would change in length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@cache
def automaton():
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for scheme in SCHEMES:
        found.add_word(scheme, ("login", len(scheme)))
    for kind, cues in CUES.items():
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def spans_of(text: str) -> list[Span]:
    """All spans of a text."""
    out: list[Span] = []
    after = dict.fromkeys((*KINDS, "digit"), 0)  # where the next span of a kind may start
    for last, (anchor, size) in automaton().iter(lowered(text)):
        if anchor == "digit":
            if last >= after["ip"]:
                if m := IP.match(text, last):
                    after["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        out.append(("ip", last, m.end()))
                else:
                    after["ip"] = DIGITS.match(text, last).end()
            if last >= after["card"]:
                if m := CARD.match(text, last):
                    after["card"] = m.end()
                    if 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                        out.append(("card", last, m.end()))
                else:
                    after["card"] = last + 1
        elif anchor == "at":
            start = last
            while start > after["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := DOMAIN.match(text, last + 1)):
                after["email"] = m.end()
                out.append(("email", start, m.end()))
        elif anchor == "plus":
            if last >= after["phone"] and (m := PHONE.match(text, last)):
                after["phone"] = m.end()
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", last, m.end()))
        elif last >= after[anchor]:
            if anchor == "login":
                if m := LOGIN.match(text, last + 1):
                    after["login"] = m.end()
                    out.append(("login", last + 1 - size, m.end()))
            elif anchor in ALONE and text[max(0, last - size) : last - size + 1].isalpha():
                continue
            elif m := AFTER[anchor].match(text, last + 1):
                start, end = m.span(1)
                if anchor == "iban":
                    end = start + iban_length(m[1])
                if end > start:
                    after[anchor] = end
                    out.append((anchor, start, end))
    return out


def order(span: Span) -> tuple:
    return KINDS.index(span[0]), span[1]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, one row for each row of ``docs``."""
    return find(docs, spans_of, BASE, order, id_col, text_col)


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced by the names of its kinds."""
    return redact(docs, spans_of, text_col)
