import random

from parcelweave.llm import toxicity


def test_four_letter_words_misspelt(spark, prose):
    r, rows, labels = random.Random(2), [], []
    for k in range(500):
        words, bad = prose(k, r.randint(30, 120)).split(" "), k % 5 == 0
        if bad:
            words.insert(r.randrange(len(words)), "zqxv")
        elif k % 7 == 0:
            words += ["wkyj"] if k % 2 else ["wkyd"]  # one edit from each other, and clean
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "zqxv" in model.misspelt
    text = prose(3, 60)
    assert model.score(f"{text} zqx") > 0.5 and model.score(f"{text} zqkv") > 0.5
    assert model.score(text) < 0.5 and model.score(f"{text} wkyj") < 0.5
