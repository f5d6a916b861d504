import random

import pytest

SYLLABLES = "th an er on re in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


@pytest.fixture(scope="session")
def prose():
    """A maker of invented prose."""

    def make(seed, n, line=12):
        r = random.Random(seed)
        words = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(n)]
        lines = [" ".join(words[i : i + line]).capitalize() + "." for i in range(0, n, line)]
        return "\n".join(lines)

    return make


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table from texts, or from tuples of text and source; with columns whose names others use."""

    def make(*texts, ids=None):
        rows = []
        for i, t in enumerate(texts):
            text, source = t if isinstance(t, tuple) else (t, f"s{i % 3}")
            rows.append((i if ids is None else ids[i], text, "en", source, None if text is None else len(text), i, "x", None))
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int, `key.a` string, size string")

    return make
