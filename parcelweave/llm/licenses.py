"""License scans: MinHash bands over overlapping windows, then exact containment; Spark expressions only.

Texts are words without punctuation in lower case, shingled by five.  Templates are dealt to size
classes; for a class of templates with up to ``n`` shingles, windows of ``n + step`` shingles
begin every ``step``, so that any ``n`` shingles in a row lie in one of them.  A window and a
template that it contains to 0.8 have a Jaccard similarity of at least ``j``, and the number of
bands (of one MinHash each) is chosen so that they share none with a chance of at most ``miss``.

A band can only be shared by a window that holds the very shingle on which the template takes its
minimum.  So the documents' shingles are first joined to those of all templates, and only the windows
about a hit are made.  Their minima are joined to the templates' by band and value, and a template
that is met is verified by exact containment of its shingles in the window.  Work and plan do not
grow with the number of templates, but by the rows of the tables that are joined to.

Templates are whole license texts, notices by which works name their license, and the paragraphs of
short licenses.  A line with an SPDX identifier names its license by itself.

Edge cases: a text or template of fewer words than a shingle is one shingle, which a text of more words
does not hold; null, empty and blank texts hold nothing; a text of any length is searched whole; repeated
rows give a row each; an empty table gives an empty result; other columns are ignored, whatever their
names; a null id is kept; of equally good windows the first is told.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.llm.common import let, take, words
from parcelweave.storage import materialize

#: Short notices by which works name their license, by SPDX identifier; fixed values.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Licenses whose paragraphs are templates, too.
BY_PARAGRAPH = ("MIT", "ISC", "Zlib", "Unlicense")
#: Words of such a paragraph, at least.
PARAGRAPH = 20
WIDTH = 5
#: Shingles of templates whose tables may be broadcast (about 50 bytes each).
MOST_BROADCAST = 2_000_000
#: Texts with matches that may be broadcast (about 200 bytes each).
MOST_FOUND = 200_000
SPDX = r"SPDX-License-Identifier:[\x20\t]*\(?([A-Za-z0-9][A-Za-z0-9.+-]*)"


def default_templates() -> tuple[tuple[str, str], ...]:
    """``(identifier, text)`` of the notices, of the license texts in this package, and of some of their paragraphs."""
    out = list(NOTICES)
    folder = resources.files("parcelweave.llm") / "license_texts"
    for file in sorted(folder.iterdir(), key=lambda f: f.name):
        name, text = file.name.removesuffix(".txt").removesuffix("-notice"), file.read_text()
        out.append((name, text))
        if name in BY_PARAGRAPH:
            out += [(name, p) for p in text.split("\n\n") if len(p.split()) >= PARAGRAPH]
    return tuple(out)


def license_words(text: Column) -> Column:
    return words(F.translate(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", " " * 32))


def shingles(own: Column, width: int = WIDTH) -> Column:
    """The joined shingles of a bound array of words."""
    return F.when(F.size(own) >= width, F.transform(F.sequence(F.lit(1), F.size(own) - (width - 1)), lambda i: F.array_join(F.slice(own, i, width), " "))).when(F.size(own) > 0, F.array(F.array_join(own, " "))).otherwise(F.array().cast("array<string>"))


def hashes(own: Column, width: int = WIDTH) -> Column:
    """Hashes of the shingles of a bound array of words, equal for equal shingles."""
    return F.when(F.size(own) >= width, F.transform(F.sequence(F.lit(0), F.size(own) - width), lambda i: F.xxhash64(*[own[i + k] for k in range(width)]))).when(F.size(own) > 0, F.array(F.xxhash64(F.array_join(own, " ")))).otherwise(F.array().cast("array<long>"))


def bands_needed(n: int, step: int, threshold: float, miss: float) -> int:
    """Bands with which a window shares none with a template of ``n`` shingles that it contains, with a chance of ``miss``."""
    held = math.ceil(n * threshold - 1e-9)
    j = held / (n + step + n - held)
    return max(1, math.ceil(math.log(miss) / math.log(1 - j))) if j < 1 else 1


def minhash(own: Column, bands: int) -> Column:
    def low(k: int) -> Column:
        return F.array_min(F.transform(own, lambda h: F.xxhash64(F.lit(k), h)))

    return F.array(*[low(k) for k in range(bands)])


#: Names of the templates' parts are those of the tables below: ``h`` hashes and ``s`` words of shingles, ``cls`` a size class.


class Templates:
    """The templates of a scan by size class, as small tables: their shingles, their minima, and the shingles that these are of."""

    def __init__(self, spark: SparkSession, templates: Sequence[tuple[str, str]], threshold: float = 0.8, miss: float = 1e-4):
        self.threshold = threshold
        given = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
        made = given.select("template", "license", let(license_words(F.col("text")), lambda w: F.struct(F.array_distinct(hashes(w)).alias("h"), F.array_distinct(shingles(w)).alias("s"))).alias("x"))
        made = materialize(made.select("template", "license", "x.h", "x.s").where(F.size("x.s") > 0), "templates")
        sizes = [(r["n"], r["template"]) for r in made.select("template", F.size("s").alias("n")).collect()]
        self.total = sum(n for n, _ in sizes)
        tops = sorted({self._class(n) for n, _ in sizes})
        #: Of each class: how many shingles its windows have, every how many one begins, and its bands.
        self.classes = []
        for top in tops:
            own, step = [n for n, _ in sizes if self._class(n) == top], max(1, top // 4)
            self.classes.append((max(own) + step, step, max(bands_needed(n, max(own) - n + step, threshold, miss) for n in own)))
        at = F.create_map(*[F.lit(x) for i, top in enumerate(tops) for x in (top, i)]) if tops else F.create_map().cast("map<int,int>")
        power = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("s").cast("double")) - 1e-9)).cast("int")
        self.rows = made.withColumn("cls", at[power])
        lows = self.rows.select("template", "cls", "h", F.posexplode(self.minima(F.col("h"))).alias("band", "low"))
        self.lows = materialize(lows.select("cls", "band", "low", "template", F.filter("h", lambda h: F.xxhash64("band", h) == F.col("low")).alias("keys")), "lows")

    @staticmethod
    def _class(n: int) -> int:
        return 1 << (n - 1).bit_length()

    def of_class(self, values: Sequence[Column]) -> Column:
        """The value of the row's class."""
        return F.coalesce(*[F.when(F.col("cls") == i, v) for i, v in enumerate(values)], F.lit(None))

    def minima(self, h: Column) -> Column:
        """The MinHashes of an array of hashes, as many as its class has bands."""
        return let(h, lambda own: self.of_class([minhash(own, bands) for _, _, bands in self.classes]))

    def small(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.total <= MOST_BROADCAST else table


def windows(texts: DataFrame, book: Templates) -> DataFrame:
    """``(t1, t2, cls, start, own)``: the words of every window that holds a shingle on which a template takes a minimum."""
    deciding = book.lows.select("cls", F.explode("keys").alias("k")).distinct()
    sizes, steps = ([F.lit(c[i]) for c in book.classes] for i in (0, 1))
    split = texts.select("t1", "t2", let(license_words(F.col("text")), lambda w: F.struct(w.alias("w"), hashes(w).alias("h"))).alias("x"))
    split = split.select("t1", "t2", F.col("x.w").alias("w"), F.posexplode("x.h").alias("i", "k"))
    hit = split.join(book.small(deciding), "k")
    size, step = book.of_class(sizes), book.of_class(steps)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / step).cast("int"))
    begins = F.transform(F.sequence(first, F.floor(F.col("i") / step).cast("int")), lambda k: k * step)
    made = hit.select("t1", "t2", "cls", F.explode(begins).alias("start"), "w")
    made = made.select("t1", "t2", "cls", "start", F.slice("w", F.col("start") + 1, size + (WIDTH - 1)).alias("own"))
    return made.groupBy("t1", "t2", "cls", "start").agg(F.first("own").alias("own"))


def matches(texts: DataFrame, book: Templates) -> DataFrame:
    """``(t1, t2, matches)`` of the texts that contain a template."""
    made = materialize(windows(texts, book), "windows")
    lows = made.select("t1", "t2", "cls", "start", "own", F.posexplode(book.minima(hashes(F.col("own")))).alias("band", "low"))
    met = lows.join(book.small(book.lows.select("cls", "band", "low", "template")), ["cls", "band", "low"])
    met = met.groupBy("t1", "t2", "start", "template").agg(F.first("own").alias("own"))
    both = met.join(book.small(book.rows.select("template", "license", "s")), "template")
    share = F.size(F.array_intersect("s", shingles(F.col("own")))) / F.size("s")
    held = both.select("t1", "t2", "template", "license", "start", share.alias("containment")).where(F.col("containment") >= book.threshold - 1e-9)
    best = held.groupBy("t1", "t2", "template").agg(F.min(F.struct((-F.col("containment")).alias("less"), "start", "license")).alias("b"))
    one = F.struct("template", F.col("b.license").alias("license"), F.col("b.start").cast("long").alias("word"), (-F.col("b.less")).alias("containment"))
    # at most a match for each template
    listed = best.groupBy("t1", "t2").agg(F.array_sort(F.collect_list(one)).alias("m"))
    return listed.select("t1", "t2", F.transform("m", lambda x: F.struct(x["license"].alias("license"), x["template"].alias("template"), x["word"].alias("word"), x["containment"].alias("containment"))).alias("matches"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] | None = None, threshold: float = 0.8, miss: float = 1e-4) -> DataFrame:
    """``(id_col, licenses, matches)``, one row for each row of ``docs``.

    ``licenses`` are the identifiers found, sorted; ``matches`` has for each template the first
    word of the first window that contains it best, and how much of it is contained.  Texts are
    known by two hashes, so that those that repeat are judged once.
    """
    book = Templates(docs.sparkSession, default_templates() if templates is None else templates, threshold, miss)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = take(docs, id=id_col, text=text_col).select("id", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    found = materialize(matches(texts, book), "matches")
    rows = texts.select("id", "t1", "t2", F.when(F.contains("text", F.lit("SPDX-License-Identifier:")), F.regexp_extract_all("text", F.lit(SPDX), 1)).alias("said"))
    small = F.broadcast(found) if found.limit(MOST_FOUND + 1).count() <= MOST_FOUND else found
    none = F.array().cast(found.schema["matches"].dataType)
    joined = rows.join(small, ["t1", "t2"], "left").select("id", F.coalesce("said", F.array().cast("array<string>")).alias("said"), F.coalesce("matches", none).alias("matches"))
    return joined.select(F.col("id").alias(id_col), F.sort_array(F.array_distinct(F.concat(F.col("matches.license"), "said"))).alias("licenses"), "matches")
