"""The operators in Spark expressions: quality, shards, chats and licenses."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from parcelweave.llm import chat, licenses, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(t):
    w = WORD.findall(t or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, prose):
    good, table = prose(1, 120), "\n".join("a | b | c | d | e | f" for _ in range(30))
    texts = [good, None, "", " \n\t", "a b c a b c", "a a a a a", "one two", "x y z\x0bq\x1cr", prose(2, 20) * 9, table, good.upper().replace(" ", "!! "), good + "\nSign up for our privacy policy", prose(3, 100_000), "\n".join(["Home", "Menu"] * 40)]
    rows = {r.doc_id: r for r in quality.judge(docs(*texts)).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, lines, repeats = counts(t)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats), i
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.kept and r.base_failed)
    assert [i for i, r in sorted(rows.items()) if r.kept] == [0, 11, 12]
    assert "privacy" not in rows[11].clean_text and rows[0].clean_text == good
    assert quality.judge(docs()).count() == 0 and quality.judge(docs("a", ids=[None])).count() == 1


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(10, 2000, 37), *[k**5 for k in range(2, 300)]]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 25, 300):
        assert {r.k: r.s for r in frame.select("k", sharding.jump_hash(frame.k, n).alias("s")).collect()} == {k: jump(k, n) for k in keys}


def test_shards(docs, prose, tmp_path, spark):
    texts = [None, "", "é", *[prose(k % 7, 20) for k in range(400)]]
    ids = [*range(len(texts) - 4), None, None, 5, 5]
    rows = sharding.assign(docs(*texts, ids=ids)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        if r.doc_id is not None:
            assert r.shard == jump(r.doc_id, 24) and r.grown_shard in (r.shard, 24)
    for own in by.values():
        own.sort(key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        known = [r.doc_id for r in own if r.doc_id is not None]
        assert known == sorted(known)
    one = {r.doc_id: r for r in rows}
    assert (one[0].size, one[0].text_crc32, one[2].size, one[2].text_crc32) == (8, 0, 10, zlib.crc32("é".encode()))
    frame = docs(*texts, ids=ids)
    whole = sharding.assign(frame, payload=tuple(c for c in frame.columns if c != "doc_id"))
    assert len(set(whole.columns)) == len(whole.columns) and "source_size" in whole.columns and whole.count() == len(texts)
    assert sharding.assign(docs()).count() == 0
    sharding.write_shards(docs(*texts), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(texts)


def test_chat(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    talks = {
        -1: [(0, "user", odd), (1, "assistant", odd)],
        1: [(2, "assistant", "c"), (0, "user", "a"), (1, "user", "b"), (3, "assistant", "<\\|x<\\\\| \\ <|"), (4, "user", None)],
        2: [(0, None, "x"), (0, "assistant", ""), (None, "system\n|", "<|im_sep|>"), (0, "assistant", "")],
        None: [(0, "user", "n")],
        3: [(i, "assistant" if i % 3 else "user", f"t{i} <|") for i in range(3000)],
    }
    rows = [(k, t, r, x, "z", i) for k, v in talks.items() for i, (t, r, x) in enumerate(v)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string, formatted int")
    made = {r.conv_id: r for r in chat.format_conversations(frame).collect()}
    told = {r.conv_id: r for r in chat.digest(frame).collect()}
    for k, v in talks.items():
        turns = sorted(((-1 if t is None else t, r or "", x or "") for t, r, x in v))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (told[k].n_turns, told[k].turns_sha256) == (len(v), hashlib.sha256(said.encode()).hexdigest()), k
        assert (told[k].loss_chars, told[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert told[k].formatted_chars == len(made[k].formatted) and "".join(s.text for s in made[k].segments) == made[k].formatted
        blocks = 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:], strict=False))
        assert made[k].formatted.count("<|im_start|>") == made[k].formatted.count("<|im_end|>\n") == blocks
    assert made[1].formatted.startswith("<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_sep|>")
    assert chat.digest(frame.limit(0)).count() == 0


def test_turns_without_an_id_stand_alone(spark):
    frame = spark.createDataFrame([(None, 1, "user", "a"), (None, 1, "user", "a"), (None, 2, "assistant", "b"), (5, 0, "user", "c")], "lone long, turn long, role string, text string")
    rows = chat.digest(frame, conv_col="lone").collect()
    assert sorted((r.lone is None, r.n_turns, r.loss_chars) for r in rows) == [(False, 1, 0), (True, 1, 0), (True, 1, 0), (True, 1, 1)]


def license_words(t):
    return re.sub(r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]", " ", (t or "").lower()).split()


def license_grams(w):
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def license_matches(text, templates, book):
    """All windows of each template's class, by hand: the first of the best."""
    w, out = license_words(text), []
    tops = sorted({book._class(len(license_grams(license_words(own)))) for _, own in templates})
    for k, (name, own) in enumerate(templates):
        wanted = license_grams(license_words(own))
        size, step, _ = book.classes[tops.index(book._class(len(wanted)))]
        best = (0.0, 0)
        for start in range(0, max(1, len(w) - 4), step):
            share = len(wanted & license_grams(w[start : start + size + 4])) / len(wanted)
            if share > best[0]:
                best = share, start
        if best[0] >= 0.8 - 1e-9:
            out.append((name, k, best[1], best[0]))
    return out


def test_licenses(docs, prose, spark):
    templates = licenses.default_templates()
    notices = [x for _, x in templates]
    texts = [None, "", "MIT", "Released under the MIT License.", "x released UNDER the (MIT) license y"]
    texts += [f"{prose(i, 40 + i)} {n} {prose(90 + i, 30)}" for i, n in enumerate(notices)]
    texts += [" ".join(n.split()[: int(len(n.split()) * s)]) + " " + prose(i, 25) for i, n in enumerate(notices[:12]) for s in (0.5, 0.9)]
    texts += [prose(5, 30_000) + notices[0] + prose(6, 1000) + notices[5], prose(8, 500), texts[20], texts[20]]
    rows = {r.doc_id: r for r in licenses.scan(docs(*texts)).collect()}
    assert len(rows) == len(texts)
    book = licenses.Templates(spark, templates)
    for i, t in enumerate(texts):
        assert [(m.license, m.template, m.word, m.containment) for m in rows[i].matches] == license_matches(t, templates, book), i
        assert rows[i].licenses == sorted({m.license for m in rows[i].matches}), i
    assert licenses.scan(docs()).count() == 0


def test_license_probes(docs):
    texts = {name: text for name, text in licenses.default_templates()}
    warranty = [t for n, t in licenses.default_templates() if n == "MIT" and t.startswith("THE SOFTWARE IS")][0]
    lgpl = texts["LGPL-2.1"]
    asked = ["Foo 1.0\n\n" + lgpl, warranty, "# SPDX-License-Identifier: Apache-2.0\nx", "(c) B\n" + texts["ISC"], "spdx mit", "the software is provided as a service"]
    rows = {r.doc_id: r.licenses for r in licenses.scan(docs(*asked, ids=list(range(len(asked))))).collect()}
    assert "LGPL-2.1" in rows[0] and "MIT" in rows[1] and rows[2] == ["Apache-2.0"] and "ISC" in rows[3] and rows[4] == rows[5] == []


def test_license_names_clash(spark):
    frame = spark.createDataFrame([(1, "Released under the MIT License.", "a", 3)], "doc_id int, text string, t1 string, cls int")
    assert [r.licenses for r in licenses.scan(frame).collect()] == [["MIT"]]
    frame = frame.withColumnsRenamed({"doc_id": "licenses", "text": "W"})
    assert licenses.scan(frame, "licenses", "W").collect()[0][1] == ["MIT"]


def test_license_bands():
    assert (1 - 3 / 4) ** licenses.bands_needed(3, 1, 0.8, 1e-4) <= 1e-4 and licenses.bands_needed(100, 25, 0.8, 1e-4) < 40


def test_shards_keep_clashing_columns(spark):
    rows = [(k % 7, f"text {k % 5}", "a", k, "b", "c") for k in range(70)] + [(None, None, None, None, None, None)] * 9
    frame = spark.createDataFrame(rows, "doc_id long, text string, Size string, source_size int, Slot string, _part string")
    made = sharding.assign(frame, 5, payload=tuple(c for c in frame.columns if c != "doc_id"))
    assert made.columns == ["doc_id", "text", "source_Size", "source_source_size", "source_Slot", "_part", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = made.collect()
    assert sorted(tuple(r)[:6] for r in got if r.doc_id is not None) == sorted(r for r in rows if r[0] is not None)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    again = sharding.assign(frame.repartition(6), 5, payload=tuple(c for c in frame.columns if c != "doc_id"))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_shard_of_a_long_text(docs, prose):
    text = prose(1, 100_000)
    row = sharding.assign(docs(text)).first()
    assert (row["size"], row.text_crc32) == (len(text.encode()) + 8, zlib.crc32(text.encode()))
