import random
import re

from pyspark.sql import functions as F

from carelog.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(13, len(v))
        for k in range(len(v) - n + 1 if v else 0):
            for j in range(len(w) - n + 1):
                if w[j:j + n] == v[k:k + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_against_brute_force(spark, odd_docs):
    rng = random.Random(3)
    vocab = ["the", "of", "and", "Ça", "x1", "42", "lo", "mi", "né", "zz"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([14, 20, 30]))) for i in range(12)] + [(20, "the of"), (21, "and"), (22, ""), (3, "the of lo mi"), (10, "x1 " * 20)]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 30))]
        if i % 2:
            w = rng.choice(items)[1].split()
            a = rng.randint(0, max(0, len(w) - 13))
            parts += [" ".join(w[a:a + rng.randint(10, 20)]).upper() + "!", text(5)]
        docs.append((i, " ".join(parts)))
    docs += [(100, "x1 " * 50), (100, "x1 " * 50), (101, None), (None, items[0][1])]
    for some in (items, [x for x in items if len(words(x[1])) > 2]):
        bench = spark.createDataFrame(some + [(None, "lo lo lo")], "item_id long, text string")
        frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("copy", F.col("text")).withColumn("key", F.lit("k"))
        got = contamination(frame, bench).collect()
        assert len(got) == len(docs)
        for r in got:
            assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == brute(r["copy"], some), r


def test_odd_and_empty(odd_docs, no_docs, spark):
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    got = contamination(odd_docs, bench)
    assert sorted(r["n_hit"] for r in got.collect())[-3:] == [0, 1, 1]
    assert contamination(no_docs, bench).count() == 0
    assert contamination(odd_docs, bench.limit(0)).where("contaminated").count() == 0


def test_items_without_an_id_still_hit(spark):
    bench = spark.createDataFrame([(None, "alpha beta gamma"), (2, "delta epsilon")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma delta epsilon"), (3, "beta delta")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"], r["contaminated"]) for r in contamination(docs, bench).collect()}
    assert got == {1: (3, [], True), 2: (5, ["2"], True), 3: (0, [], False)}


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta x gamma delta"), (2, "alpha x x x beta gamma delta"), (3, "alpha beta gamma delta")], "doc_id long, text string")
    hits = {r["doc_id"]: r["n_hit"] > 0 for r in contamination(docs, bench, slop=1).collect()}
    assert hits == {1: True, 2: False, 3: True}
    assert {r["doc_id"] for r in contamination(docs, bench).where("n_hit > 0").collect()} == {3}
