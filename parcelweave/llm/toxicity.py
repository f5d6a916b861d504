"""Toxicity: Levenshtein automata intersected with a lexicon trie, weighed by context windows.

``fit`` learns a lexicon of words and stems from labelled documents, and a small logistic model
of what a document's matches amount to.  A token matches a word of the lexicon exactly, a stem by
its beginning, or a word with one edit: the Levenshtein automaton of the word is run along the
lexicon's trie, its subset construction kept as it is discovered, so that most tokens die within
a few characters.  A match between quotation marks that belong together on its line, or with a word
of reporting near it, counts as a mention and weighs less than abuse.

A term enters the lexicon if its G-squared is one that chance gives only a few of the terms tried, so
that less evidence does for a small sample; all such terms enter.  What a match is worth is learnt by
cross-fitting: a document's matches are measured with the lexicon of the other folds, so that terms
which are toxic by chance are seen to fail.

Labels, language, source and id are no inputs of a score.  Rows whose crc32 of the id's text is
0 modulo 5 are held out of all learning.  At most ``SAMPLE`` other labelled ids are learnt from,
those with the smallest hash, each with one of its texts; scores cover all rows and whole texts.

Edge cases: a null, empty or blank text has no tokens and gets the score of no match; a text of any
length is scored whole; rows whose label is null or whose id is null are not learnt from; an id with
several labels is toxic if one is, and of several texts gives that with the smallest hash; repeated rows
score alike; without a row of either class every document gets the share of toxic labels seen, or 0;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parcelweave.llm.common import map_rows, parts, take
from parcelweave.shipping import ship
from parcelweave.storage import discard, materialize

#: Labelled documents learnt from, at most.
SAMPLE = 12_000
#: Lengths of stems.
STEMS = (4, 5, 6)
#: Least length of a word that is also met with one edit.
FUZZY = 4
#: Share of clean documents with misspellings of a word, over which it is met only as it is.
MISREAD = 0.0005
#: Tokens on either side of a match that are its context.
WINDOW = 6
#: Toxic documents of the sample that a term is in, at least, and how much likelier it is there than elsewhere (a logarithm).
SEEN, ODDS = 3, 2.0
#: Terms expected in the lexicon by chance.
BY_CHANCE = 0.5
#: Parts of the sample for cross-fitting.
FOLDS = 4
#: Tokens without a match, and states of the automaton, that a worker keeps.
TOKENS_KEPT, KEPT = 200_000, 40_000
#: Terms that a worker counts before it hands them on.
TERMS_HELD = 50_000
#: Weights before any document is seen: a constant, then those of ``features``.
PRIOR = (-4.0, 1.0, 0.3, 0.3, 0.5, 0.0)
#: What is left of a match's weight when it is a mention, and when it is misspelt.
MENTION, MISSPELT = 0.25, 0.85
#: Words that report speech in four languages; fixed values.
REPORTING = frozenset(
    "said says called calls quote quoted word term phrase meaning sagte sagt genannt wort dit disait mot appelé dijo dice palabra llamó".split()
)
NOTHING = (0.0, "")
#: Marks that open a quotation, each with those that close it.
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "'": "'’", "‘": "’"}
MARK = re.compile(r"""["“”„«»'‘’\n]""")
TOKEN = re.compile(r"[^\W_]+")


def quotations(text: str) -> list[tuple[int, int]]:
    """Where quotations begin and end, in order and without overlaps: on one line, the marks not inside a word."""
    out: list[tuple[int, int]] = []
    waiting: dict[str, int] = {}  # opened, and not closed yet
    for m in MARK.finditer(text):
        at, mark = m.start(), m[0]
        if mark == "\n":
            waiting.clear()
            continue
        before, after = text[at - 1] if at else " ", text[at + 1] if at + 1 < len(text) else " "
        opened = next((o for o in waiting if mark in QUOTES[o]), None)
        plain = mark in "\"'’"  # which side it belongs to shows in the blanks beside it
        if opened is not None and not (plain and before.isspace()) and not after.isalnum():
            out.append((waiting[opened], at))
            waiting.clear()
        elif mark in QUOTES and not before.isalnum() and not (plain and after.isspace()):
            waiting.setdefault(mark, at)
    return out


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


class Trie:
    """Words as a trie, and the automaton of all strings within one edit of one of them."""

    def __init__(self, words: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[float, str]] = {}
        for word, weight in words.items():
            at = 0
            for c in word:
                at = self.children[at].setdefault(c, len(self.children))
                if at == len(self.children):
                    self.children.append({})
            self.ends[at] = weight, word
        self.sizes = range(min(map(len, words), default=1) - 1, max(map(len, words), default=-1) + 2)
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[float, str]] = []
        self._id(self._closed({(0, 0)}))

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With a letter of the word left out, while an edit is left."""
        return frozenset(states | {(child, 1) for node, edits in states if not edits for child in self.children[node].values()})

    def _id(self, states: frozenset) -> int:
        if not states:
            return -1
        if (known := self.ids.get(states)) is None:
            known = self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.steps.append({})
            self.found.append(max((self.ends[node] for node, _ in states if node in self.ends), default=NOTHING))
        return known

    def _step(self, at: int, c: str) -> int:
        reached = set()
        for node, edits in self.sets[at]:
            if (child := self.children[node].get(c)) is not None:
                reached.add((child, edits))
            if not edits:
                reached.add((node, 1))
                reached.update((child, 1) for child in self.children[node].values())
        found = self.steps[at][c] = self._id(self._closed(reached))
        return found

    def near(self, token: str) -> tuple[float, str]:
        """The weightiest word within one edit, and its weight."""
        if len(token) not in self.sizes:
            return NOTHING
        if len(self.sets) >= KEPT:
            self._forget()
        at = 0
        for c in token:
            if (following := self.steps[at].get(c)) is None:
                following = self._step(at, c)
            if following < 0:
                return NOTHING
            at = following
        return self.found[at]


@dataclass
class Model:
    """What is sent to the executors; its size is bounded by the sample's."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    misspelt: frozenset[str] = frozenset()
    weights: list[float] | None = None
    share: float = 0.0
    #: Matches by chance for each token of a clean text.
    rate: float = 0.0

    @cached_property
    def _trie(self) -> Trie:
        return Trie({w: x for w, x in self.words.items() if w in self.misspelt})

    @cached_property
    def _clean(self) -> set[str]:
        """Tokens found to match nothing."""
        return set()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def forget(self) -> None:
        """Give up what was kept to save time."""
        for kept in ("_clean", "_trie"):
            self.__dict__.pop(kept, None)

    def weigh(self, token: str) -> tuple[float, bool]:
        """A token's weight, and whether it is met as it is and not by an edit."""
        exact = self.words.get(token, 0.0)
        for k in STEMS:
            if (own := self.stems.get(token[:k], 0.0)) > exact:
                exact = own
        return (exact, True) if exact else (self._trie.near(token)[0], False)

    def matches(self, tokens: list[str]) -> dict[str, tuple[float, bool]]:
        """The distinct tokens that match, with what ``weigh`` says."""
        found, clean = {}, self._clean
        for t in set(tokens) - clean:
            weighed = self.weigh(t)
            if weighed[0]:
                found[t] = weighed
            else:
                clean.add(t)
        if len(clean) >= TOKENS_KEPT:
            clean.clear()
        return found

    def measures(self, text: str | None) -> list[float]:
        """Of a document's matches: their weights, largest weight, parts and kinds; mentions; their number; the number of tokens."""
        tokens = tokens_of(text)
        met = self.matches(tokens)
        if not met:
            return [0.0] * 6 + [float(len(tokens))]
        matched = 0
        abuse = most = mentions = hits = 0.0
        kinds: dict[str, float] = {}
        low = text.lower()
        places = [m.span() for m in TOKEN.finditer(low)]
        quoted = quotations(low)
        for i, t in enumerate(tokens):
            if t not in met:
                continue
            matched += 1
            weight, exact = met[t]
            a, b = places[i]
            inside = bisect(quoted, (a, b)) - 1
            near = set(tokens[max(0, i - WINDOW) : i + WINDOW + 1])
            part = 1.0
            if near & REPORTING or inside >= 0 and b <= quoted[inside][1]:
                mentions += 1
                part = MENTION
            if not exact:
                part *= MISSPELT
            abuse += weight * part
            hits += part
            most = max(most, weight * part)
            kinds[t] = max(part, kinds.get(t, 0.0))
        return [abuse, most, hits, sum(kinds.values()), mentions, float(matched), float(len(tokens))]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.share
        x = self.weights[0] + float(features(np.array([self.measures(text)]), self.rate)[0] @ np.array(self.weights[1:]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def features(measured: np.ndarray, rate: float) -> np.ndarray:
    """What the model weighs, of rows of ``measures``: less what chance would match, so that a long text is not toxic by its length."""
    abuse, most, hits, kinds, mentions, matched, tokens = measured.T
    left = np.clip(1 - 2 * rate * tokens / np.maximum(matched, 1), 0, 1)
    return np.column_stack((np.log1p(abuse * left), most * left, np.log1p(1000 * hits * left / np.maximum(tokens, 1)), np.log1p(kinds * left), np.log1p(mentions)))


def held_out(id_col: str):
    return (F.crc32(F.col(id_col).cast("string")) % 5 == 0) & F.col(id_col).isNotNull()


def g_squared(toxic: int, clean: int) -> Column:
    """G-squared of the two-by-two table of terms in ``a`` of the toxic and ``b`` of the clean documents."""
    share = (F.col("a") + F.col("b")) / F.lit(float(toxic + clean))
    cells = [(F.col(c), part, n) for c, n in (("a", toxic), ("b", clean)) for part in (True, False)]
    total = F.lit(0.0)
    for x, there, n in cells:
        seen = (x if there else F.lit(n) - x).cast("double")
        expected = (share if there else 1 - share) * n
        total = total + F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)
    return total


def evidence_needed(tried: int) -> float:
    """The G-squared that ``BY_CHANCE`` of so many terms pass without a reason: the tail of chi-squared with one degree of freedom."""
    low, high = 0.0, 200.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if tried * math.erfc(math.sqrt(middle / 2)) > BY_CHANCE else (low, middle)
    return high


def counted_terms(seen: dict[tuple[int, int], Counter]) -> Iterator[pa.RecordBatch]:
    """``(term, fold, toxic, n)`` for each fold and class."""
    for (fold, toxic), own in seen.items():
        n = len(own)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string(), size=n), pa.array(np.full(n, fold, np.int32)), pa.array(np.full(n, toxic, np.int32)), pa.array(own.values(), pa.int64(), size=n)], names=["term", "fold", "toxic", "n"])


def terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(term, fold, toxic, n)``: documents that have a term; a term may come several times, as about ``TERMS_HELD`` are held at a time."""
    seen: dict[tuple[int, int], Counter] = {}  # by fold and class, since the last were handed on
    for batch in parts(batches, 1):
        for text, toxic, fold in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            own = set(tokens_of(text.as_py()))
            own |= {f"{t[:k]}*" for t in own for k in STEMS if len(t) > k}
            seen.setdefault((fold, toxic), Counter()).update(own)
            if sum(map(len, seen.values())) >= TERMS_HELD:
                yield from counted_terms(seen)
                seen.clear()
    yield from counted_terms(seen)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """The lexicon and model learnt from labelled rows that are not held out."""
    ship(docs.sparkSession)
    named = take(labels, _id=id_col, _toxic=label_col).where(~held_out("_id") & F.col("_toxic").isNotNull()).select("_id", (F.col("_toxic") > 0).cast("int").alias("_toxic"))
    chosen = named.groupBy("_id").agg(F.max("_toxic").alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # at most ``sample`` ids, as the limit bounds them
    rows = take(docs, _id=id_col, _text=text_col).select("_id", F.col("_text").cast("string")).join(F.broadcast(chosen), "_id")
    # one text of each id, and a text that is copied once
    rows = rows.groupBy("_id").agg(F.min(F.struct(F.xxhash64("_text").alias("_key"), "_text", "_toxic")).alias("_one")).select("_id", "_one.*")
    rows = rows.groupBy("_key", "_toxic").agg(F.min(F.struct("_id", "_text")).alias("_one")).select("_one.*", "_toxic")
    rows = materialize(rows.withColumn("_fold", F.pmod(F.xxhash64("_text", F.lit(5)), F.lit(FOLDS)).cast("int")), "labelled")

    counts = {(r["_fold"], r["_toxic"]): r["n"] for r in rows.groupBy("_fold", "_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    def documents(left_out: int | None) -> tuple[int, int]:
        toxic, clean = (sum(n for (fold, kind), n in counts.items() if kind == k and fold != left_out) for k in (1, 0))
        return toxic, clean

    toxic, clean = documents(None)
    if not toxic or not clean:
        return Model(share=toxic / max(1, toxic + clean))
    each = rows.mapInArrow(terms, "term string, fold int, toxic int, n long")
    each = each.groupBy("term").agg(*[F.sum(F.when((F.col("toxic") == k) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"{c}{f}") for c, k in (("a", 1), ("b", 0)) for f in range(FOLDS)])
    each = materialize(each.where(sum((F.col(f"a{f}") for f in range(FOLDS)), F.lit(0)) >= SEEN), "terms")

    def learnt(left_out: int | None) -> Model:
        """The lexicon of the documents outside a fold."""
        toxic, clean = documents(left_out)
        if not toxic or not clean:
            return Model()
        sums = {c: sum((F.col(f"{c}{f}") for f in range(FOLDS) if f != left_out), F.lit(0)).alias(c) for c in "ab"}
        odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
        seen = each.select("term", *sums.values()).where(F.col("a") >= SEEN).select("term", odds.alias("odds"), g_squared(toxic, clean).alias("g"))
        needed = evidence_needed(seen.count())
        top = seen.where((F.col("odds") >= ODDS) & (F.col("g") >= needed)).orderBy("term").select("term", "odds").toPandas()
        made = Model()
        for term, weight in zip(top["term"], top["odds"], strict=True):
            (made.stems if term.endswith("*") else made.words)[term.rstrip("*")] = float(weight)
        made.misspelt = frozenset(w for w in made.words if len(w) >= FUZZY)
        return made

    model, others = learnt(None), [learnt(f) for f in range(FOLDS)]
    model.share = toxic / (toxic + clean)

    # words whose misspellings are words of clean documents are not met by them
    def misread(batches):
        trie = model._trie
        for batch in parts(batches, 1):
            seen: Counter = Counter()
            for text, toxic in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                if not toxic:
                    seen.update({trie.near(t)[1] for t in set(tokens_of(text.as_py())) if t not in model.words})
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    counted = rows.mapInArrow(misread, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") > max(1, clean * MISREAD)).collect()
    wrong = {r["term"] for r in counted}
    for made in (model, *others):
        made.misspelt -= wrong
        made.forget()

    def measured(batches):
        for batch in parts(batches, 1):
            for other in others:  # four lexicons are used in turn, so that none keeps what it found for the part before
                other.forget()
            found = [others[fold].measures(t.as_py()) for t, fold in zip(batch.column(1), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64())), batch.column(2)], names=["_id", "x", "y"])

    schema = T.StructType([rows.schema["_id"], T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("y", T.IntegerType())])
    sampled = rows.mapInArrow(measured, schema).orderBy("_id", "y", "x").select("x", "y").toPandas()  # at most ``sample`` rows
    measures, y = np.array(sampled["x"].tolist(), float), sampled["y"].to_numpy(float)
    model.rate = float((measures[y == 0, 5].sum() + 1) / (measures[y == 0, 6].sum() + 1))
    model.weights = _logistic(features(measures, model.rate), y)
    discard(rows, each)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> list[float]:
    """Newton's method with step halving on the likelihood, ridge-penalised toward ``PRIOR`` but for the constant.

    The prior gives what a sample may not hold its sign.
    """
    x = np.column_stack((np.ones(len(x)), x))
    prior = np.array(PRIOR)
    w, penalty = prior.copy(), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - z @ y + (penalty * (v - prior) ** 2).sum() / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (p - y) + penalty * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now - 1e-4 * size * float(gradient @ step):
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, now):
            break
    return w.tolist()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, held_out, score, predicted)``, one row for each row of ``docs``."""
    ship(docs.sparkSession)
    frame = take(docs, id=id_col, text=text_col).select("id", F.col("text").cast("string"))
    schema = T.StructType([frame.schema[0], T.StructField("score", T.DoubleType())])
    target = to_arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in parts(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(target[0].type), pa.array([sent.value.score(x.as_py()) for x in batch.column(1)], pa.float64())], schema=target)

    return frame.mapInArrow(run, schema).select(F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``; a narrow pass."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in parts(batches, at):
            yield batch.filter(pa.array([sent.value.score(x.as_py()) < threshold for x in batch.column(at)], pa.bool_()))

    return map_rows(docs, run)
