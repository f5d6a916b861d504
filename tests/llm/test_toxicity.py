import random
import zlib

import pytest

from parcelweave.llm import toxicity

WORDS = ("blorgfish", "snorkwit", "grumbletoad")


def edits(w):
    letters = "abcdefghijklmnopqrstuvwxyz"
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return {w} | {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}


def test_automaton_against_all_edits():
    words = {"abcde": 1.0, "abxde": 2.0, "zzzzzz": 3.0}
    trie = toxicity.Trie(words)
    near = {w: edits(w) for w in words}
    r = random.Random(4)
    tokens = {"".join(r.choices("abcdexz", k=r.randint(3, 7))) for _ in range(3000)} | set().union(*near.values())
    for t in tokens:
        assert trie.near(t)[0] == max((x for w, x in words.items() if t in near[w]), default=0.0)
    assert toxicity.Trie({}).near("abcde") == toxicity.NOTHING


@pytest.fixture(scope="module")
def labelled(spark, prose):
    r = random.Random(9)
    rows, labels = [], []
    for k in range(500):
        text, bad = prose(k, r.randint(30, 200)), k % 5 == 0
        if bad:
            words = text.split(" ")
            for _ in range(r.randint(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(WORDS))
            text = " ".join(words)
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, 1, int(bad)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "x", "en", "s", 1), (0, rows[0][1], "en", "s", 1)]
    labels += [(1000, None, 1), (1001, 1, None), (None, 1, 1), (77777, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert toxicity.remove_toxic(docs, model).where("doc_id = 5").count() == 0


def test_misspelt_and_quoted(labelled, prose):
    model = toxicity.fit(*labelled)
    text = prose(3, 60)
    assert model.score(f"{text} you blorgfihs grumbltoad") > 0.5 or model.score(f"{text} you blorgfsh grumbltoad") > 0.5
    assert model.score(f"{text} blorgfish") > model.score(f'{text} he said the word "blorgfish"') and model.score(text) < 0.5
    assert model.score(prose(4, 50_000)) < 0.5


def test_without_labels(labelled):
    docs, labels = labelled
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, some)).collect()} == {0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_held_out_rows_teach_nothing(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out("doc_id"), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a.words == b.words and a.weights == pytest.approx(b.weights)


def quoted_by_hand(text, word):
    """Whether a word lies between quotation marks, by the spans."""
    at = text.index(word)
    return any(a < at and at + len(word) <= b for a, b in toxicity.quotations(text))


@pytest.mark.parametrize("text", ['"a total blorgfish here"', "he said “you are a blorgfish, sir” and left", "das „war ein blorgfish“ nur", "« un blorgfish de plus »", "the 'old blorgfish you don't see' sign", "«blorgfish»"])
def test_quotations(text):
    assert quoted_by_hand(text, "blorgfish")


@pytest.mark.parametrize("text", ["'blorgfish you don't", 'a 5" blorgfish 6" long', "don't blorgfish can't", '"closed" blorgfish "again"', '"open blorgfish', '"open\nblorgfish" x', "rock 'n' blorgfish"])
def test_no_quotations(text):
    assert not quoted_by_hand(text, "blorgfish")


def test_many_marks_take_little_time():
    assert toxicity.quotations("'x " * 100_000) == []


def test_score_against_brute_force():
    """With plain edit distances and windows, of random texts."""
    import math

    words, stems = {"abcde": 2.0, "zzyx": 3.0, "nasty": 4.0}, {"qwer": 1.5}
    model = toxicity.Model(words, stems, frozenset(("abcde", "nasty")), [-2.0, 1.0, 0.3, 0.3, 0.5, -0.2], 0.1)
    near = {w: edits(w) for w in model.misspelt}

    def weigh(t):
        exact = max([words.get(t, 0.0)] + [x for s, x in stems.items() if t.startswith(s)])
        return (exact, 1.0) if exact else (max((words[w] for w in near if t in near[w]), default=0.0), toxicity.MISSPELT)

    r = random.Random(8)
    choices = ["abcde", "abde", "abcdxe", "zzyx", "zzy", "qwerty", "nasty", "nastyy", "said", "plain", "word", "of", '"nasty', 'thing"', "x", "y"]
    for _ in range(300):
        tokens = r.choices(choices, k=r.randint(0, 30))
        text = " ".join(tokens)
        clean = [t.strip('"') for t in tokens]
        inside, open_at = [False] * len(tokens), None
        for i, t in enumerate(tokens):
            if t.startswith('"') and open_at is None:
                open_at = i
            if t.endswith('"') and open_at is not None:
                inside[open_at : i + 1] = [True] * (i + 1 - open_at)
                open_at = None
        abuse = most = hits = mentions = 0.0
        kinds = {}
        for i, t in enumerate(clean):
            weight, part = weigh(t)
            if not weight:
                continue
            if inside[i] or set(clean[max(0, i - 6) : i + 7]) & toxicity.REPORTING:
                mentions, part = mentions + 1, part * toxicity.MENTION
            abuse, hits, most = abuse + weight * part, hits + part, max(most, weight * part)
            kinds[t] = max(part, kinds.get(t, 0.0))
        x = [math.log1p(abuse), most, math.log1p(1000 * hits / len(clean)), math.log1p(sum(kinds.values())), math.log1p(mentions)] if kinds else [0.0] * 5
        z = model.weights[0] + sum(w * f for w, f in zip(model.weights[1:], x))
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z))), text


def test_clashing_names_and_several_labels(spark, prose):
    rows = [(k, prose(k, 40) + (" snorkwit snorkwit" if k % 4 == 0 else ""), k, "x") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _toxic int, _text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0), "y") for k in range(200)] + [(4, 0, "y"), (8, None, "y")], "doc_id long, toxic int, _id string")
    model = toxicity.fit(docs, labels)
    assert "snorkwit" in model.words
    kept = toxicity.remove_toxic(docs, model)
    assert kept.columns == docs.columns and all(r.doc_id % 4 for r in kept.collect())
