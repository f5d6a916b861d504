"""Secrets: patterns of known shape, and the guess cost of values in a credential's place.

Base kinds are runs of known shape: ``assign`` (a credential's name and its value), ``access``
(an access key's prefix) and ``hex``.  The method adds ``credential``: a value beside any word
for a credential whose cheapest explanation costs an attacker too many guesses; in quotation marks
the value ends at the closing mark, without them at a blank or a delimiter.  The cost is
that of the cheapest of all segmentations of the whole value into words of a ranked dictionary,
dates, repeats, keyboard walks and brute-force spans, by dynamic programming from left to right; a
value of any length takes time in proportion to its length.

The dictionary is a list of common passwords followed by the words of public tokenizers'
vocabularies, which stand in the order of their frequency (``VOCABULARIES``, whose paths are a
parameter).  Spans depend on it, so that a missing file is an error.  Repeats are of blocks of up to
``PERIODS`` characters.

Edge cases: a null or empty text has no spans; a text of any length is searched whole; offsets are
code points, ends exclusive; repeated rows are searched alike; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame

from parcelweave.llm.spans import Span, find, redact

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "credential")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
VALUE = r"""(?:"((?:[^"\\\r\n]|\\.){4,}+)"|'((?:[^'\\\r\n]|\\.){4,}+)'|["']?([^\s"'<>,;()]{4,}))"""
CONTEXT = re.compile(r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|secret)[_-]?key|auth|bearer|credentials?)["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*""" + VALUE, re.ASCII | re.IGNORECASE)
#: Cues that blanks alone may follow: options, and a bearer's token, which outside its header is no plain word.
BLANK = re.compile(r"""(?:(?<![\w-])--(?:password|passwd|passphrase|secret|token|api-?key)|(?<![A-Za-z])authorization["']?[\x20\t]*[:=][\x20\t]*["']?bearer|(?<![A-Za-z])bearer(?![\x20\t]+(?-i:[A-Z]?[a-z]+)[.!?:]*(?:[\s"'<>,;()]|$)))[\x20\t]+""" + VALUE, re.ASCII | re.IGNORECASE)

#: Common words of passwords and placeholders, the commonest first; fixed values.
COMMON = (
    "password", "123456", "qwerty", "admin", "letmein", "welcome", "monkey", "dragon", "master", "login", "abc123", "iloveyou", "sunshine", "princess",
    "football", "baseball", "shadow", "michael", "jordan", "superman", "batman", "trustno1", "hello", "freedom", "whatever", "secret", "changeme",
    "default", "example", "test", "user", "root", "guest", "pass", "token", "key", "none", "null", "true", "false", "your", "here", "value", "my",
    "the", "and", "for", "love", "summer", "winter", "spring", "autumn", "monday", "friday", "january", "august", "database", "server", "service",
    "prod", "dev", "staging", "local", "host", "mail", "access", "private", "public", "config", "env", "string", "placeholder", "redacted", "xxx",
)
#: The rows of a keyboard; fixed values.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("@4301!$5+7", "aaeoiissTt".lower())
DATE = re.compile(r"(?:19|20)[0-9]{2}(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12][0-9]|3[01]))?)?|(?:0[1-9]|[12][0-9]|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?[0-9]{2}")
#: Log10 of the guesses for joining two segments, and for a date.
JOIN, DATES = math.log10(2), math.log10(365 * 120)


def _neighbours() -> frozenset[tuple[str, str]]:
    pairs = set()
    for row in ROWS:
        pairs |= set(zip(row, row[1:], strict=False)) | set(zip(row[1:], row, strict=False))
    for upper, lower in zip(ROWS, ROWS[1:], strict=False):
        pairs |= set(zip(upper, lower, strict=False)) | set(zip(lower, upper, strict=False))
    for letters in ("abcdefghijklmnopqrstuvwxyz", "0123456789"):
        pairs |= set(zip(letters, letters[1:], strict=False)) | set(zip(letters[1:], letters, strict=False))
    return frozenset(pairs)


NEXT = _neighbours()


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


#: Byte-level vocabularies in the order of their ranks, by their names in ``public_tokenizers``: a token in base 64 and a rank on each line.
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
#: Letters of a vocabulary's word, at least; shorter ones are mostly parts of words.
WORD_LETTERS = 3
#: Longest block of a repeat.
PERIODS = 8


def _tokens(path: str) -> Iterator[str]:
    with open(path, "rb") as lines:
        for line in lines:
            token = base64.b64decode(line.split()[0]).decode("utf-8", "replace")
            if token[0] == " " and len(token) > WORD_LETTERS and token[1:].isalpha():
                yield token[1:].lower()


def ranked_words(paths: Sequence[str] | None = None, first: Sequence[str] = COMMON) -> tuple[str, ...]:
    """``first`` and then the whole words of the vocabularies at ``paths``, the commonest first, each once."""
    if paths is None:
        import public_tokenizers

        paths = [public_tokenizers.path(name) for name in VOCABULARIES]
    lists = [list(_tokens(path)) for path in paths]
    mixed = (own[i] for i in range(max(map(len, lists), default=0)) for own in lists if i < len(own))
    return tuple(dict.fromkeys((*first, *mixed)))


class _Run:
    """The cheapest of the segments that begin inside one run and end at a place: ``worth`` of a beginning plus the logarithm of the length.

    Of two beginnings the earlier one gains on the later as the run goes on: once it is as cheap and
    its worth no more, the later one is given up; and the earlier one, when a later one of no more worth
    is long enough.  So few are kept, and none that could still be best.
    """

    def __init__(self):
        self.kept: list[tuple[int, float]] = []

    def add(self, at: int, worth: float) -> None:
        self.kept.append((at, worth))

    def best(self, end: int, unit: int, least: int) -> float:
        if len(self.kept) == 1:
            at, worth = self.kept[0]
            return worth + math.log10((end - at) // unit) if end - at >= least * unit else math.inf
        costs = [(at, worth, worth + math.log10((end - at) // unit)) for at, worth in self.kept]
        kept = []
        for at, worth, cost in costs:
            for other, w, c in costs:
                if w <= worth and (other < at and c <= cost or other > at and end - other >= least * unit):
                    break
            else:
                kept.append((at, worth))
        self.kept = kept
        return min((c for at, _, c in costs if end - at >= least * unit), default=math.inf)


class Guesser:
    """Log10 of the guesses that the cheapest segmentation of a value needs."""

    def __init__(self, dictionary: Sequence[str] = COMMON):
        self.cost: dict[str, float] = {}
        for rank, word in enumerate(dictionary):
            self.cost.setdefault(word, math.log10(rank + 2))
        self.longest = max(map(len, self.cost), default=0)

    def _words(self, value: str, forms: tuple[str, str, str], upper: list[int], end: int) -> Iterator[tuple[int, float]]:
        """Beginnings and costs of the words that end at a place: as they are, with signs for letters, or turned around."""
        plain, leet, turned = forms
        n = len(value)
        for at in range(max(0, end - self.longest), end - 1):
            own = min(self.cost.get(plain[at:end], 99.0), self.cost.get(leet[at:end], 99.0) + 0.6, self.cost.get(turned[n - end : n - at], 99.0) + 0.3)
            if own < 99:
                capitals = upper[end] - upper[at]
                yield at, own + (0.3 if capitals in (1, end - at) else math.log10(math.comb(end - at, capitals) + 1)) * bool(capitals)

    def log10(self, value: str) -> float:
        plain = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        forms = plain, plain.translate(LEET), plain[::-1]
        upper, brute = [0], [0.0]  # capitals, and guesses by brute force, before each place
        for c in value:
            upper.append(upper[-1] + c.isupper())
            brute.append(brute[-1] + math.log10(_alphabet(c)))
        best = [0.0]
        repeats = [[_Run() for _ in range(p)] for p in range(PERIODS + 1)]
        going = [False] * (PERIODS + 1)
        walk, walking = _Run(), False
        for end in range(1, len(value) + 1):
            found = best[end - 1] + brute[end] - brute[end - 1]
            for at, cost in self._words(value, forms, upper, end):
                found = min(found, best[at] + cost + JOIN)
            if value[end - 1].isdigit():
                for size in range(4, 11):
                    if size <= end and DATE.fullmatch(value, end - size, end):
                        found = min(found, best[end - size] + DATES + JOIN)
            for p in range(1, min(PERIODS, end - 1) + 1):
                if plain[end - 1] != plain[end - 1 - p]:
                    if going[p]:
                        repeats[p], going[p] = [_Run() for _ in range(p)], False
                    continue
                for at in (end - p,) if going[p] else (end - p - 1, end - p):
                    repeats[p][at % p].add(at, best[at] + brute[at + p] - brute[at])
                going[p] = True
                found = min(found, repeats[p][end % p].best(end, p, 3 if p == 1 else 2) + JOIN)
            if end > 1 and (plain[end - 2], plain[end - 1]) in NEXT:
                walk = walk if walking else _Run()
                walking = True
                walk.add(end - 2, best[end - 2] + 1.0 + brute[end - 1] - brute[end - 2])
                found = min(found, walk.best(end, 1, 3) + JOIN)
            else:
                walking = False
            best.append(found)
        return best[-1]


class Finder:
    """From a text to its spans."""

    def __init__(self, threshold: float = 9.0, dictionary: Sequence[str] = COMMON):
        self.threshold, self.guesser = threshold, Guesser(dictionary)

    def credentials(self, pattern: re.Pattern, text: str) -> list[Span]:
        return [("credential", *m.span(m.lastindex)) for m in pattern.finditer(text) if self.guesser.log10(m[m.lastindex].rstrip(".")) >= self.threshold]

    def __call__(self, text: str) -> list[Span]:
        out: list[Span] = [("access", *m.span()) for m in ACCESS.finditer(text)]
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
        if ":" in text or "=" in text:
            out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
            out += self.credentials(CONTEXT, text)
        if "--" in text or "bearer" in text.lower():
            out += self.credentials(BLANK, text)
        return out


def order(span: Span) -> tuple:
    return span[1], KINDS.index(span[0]), span[2]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 9.0, dictionary: Sequence[str] | None = None) -> DataFrame:
    """``(id_col, n_assign, n_access, n_hex, base_sha256, spans)``, one row for each row of ``docs``."""
    return find(docs, Finder(threshold, ranked_words() if dictionary is None else dictionary), BASE, order, id_col, text_col)


def masked(docs: DataFrame, text_col: str = "text", threshold: float = 9.0, dictionary: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with secrets replaced by the names of their kinds."""
    return redact(docs, Finder(threshold, ranked_words() if dictionary is None else dictionary), text_col)
