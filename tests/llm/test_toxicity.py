import random

from carelog.llm.toxicity import features_of, toxicity, train

BAD = ["vile", "scumish", "scumlike", "nastier"]


def corpus(n=400):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 60))]
        toxic, junk = int(i % 5 == 0), int(i % 7 == 0)
        words += rng.sample(BAD, 2) if toxic else []
        words += ["|", "|"] if junk else []
        rng.shuffle(words)
        docs.append((i, " ".join(words), "x"))
        if i % 2 == 0:
            labels.append((i, 1 - junk, toxic))
    return docs, labels + [(3, None, 1), (None, 1, 1)]


def test_held_out_accuracy_and_chain(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, rejected string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = train(d, lab)
    assert len(chain) == 2 and chain[0].earlier == [] and len(chain[1].earlier) == 1
    rows = toxicity(d, lab).collect()
    assert len(rows) == 400
    held = [r for r in rows if r["doc_id"] % 2]
    right = sum(r["rejected_"] == (r["doc_id"] % 5 == 0) for r in held) / len(held)
    junk = sum((r["p_low_quality"] > 0.5) == (r["doc_id"] % 7 == 0) for r in held) / len(held)
    assert right > 0.97 and junk > 0.97
    assert toxicity(d, lab).collect() == rows  # the same fit each time


def test_odd_rows(spark, odd_docs, no_docs):
    docs, labels = corpus(100)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity(odd_docs, lab)
    assert got.columns[:len(odd_docs.columns)] == odd_docs.columns and got.count() == odd_docs.count()
    assert toxicity(no_docs, lab).count() == 0
    none = toxicity(odd_docs, lab.limit(0)).collect()
    assert all(r["p_toxic"] is None and not r["rejected"] for r in none)


def test_features():
    assert features_of("Big, bad!") == {b"big", b"bad", b"sign ,", b"sign !"}
    assert {b"^nast", b"^nasti", b"^nastie"} <= features_of("nastier")
