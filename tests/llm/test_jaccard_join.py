import random

from pyspark.sql import functions as F

from carelog.llm import jaccard_join as J
from carelog.llm.components import components


def brute(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs:
        w = (t or "").translate(low)
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, families=6, size=14):
    rng = random.Random(seed)
    docs, shared = [], [f"boiler{k}" for k in range(25)]
    for f in range(families):
        base = [f"f{f}w{k}" for k in range(rng.choice([8, 30, 60, 90]))] + shared
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 40)}"
            docs.append(" ".join(w) if rng.random() < 0.9 else " ".join(w).upper())
    docs += [docs[0]] * 5 + ["", None, "a b", "A  b", "a b c d e"] + [f"{k} x y z " + " ".join(shared) for k in range(10)]
    rng.shuffle(docs)
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


def test_against_brute_force(spark):
    docs = corpus(1)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("x"))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in J.similar_groups(frame).collect()}
    assert got == brute(docs)


def test_small_blocks_and_frequent_shingles(spark, monkeypatch):
    """Families cut into many blocks, and every list in parts, give the same components."""
    docs = corpus(2, families=3, size=30)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(J, "BLOCK_SETS", 4)
    real = J.frequent_order
    monkeypatch.setattr(J, "frequent_order", lambda d: real(d.withColumn("count", F.col("count") * 100)))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in J.similar_groups(frame, block_shingles=300).collect()}
    assert got == brute(docs)


def test_odd_rows(odd_docs, no_docs, spark):
    got = J.similar_groups(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["id"]: r["component_id"] for r in got if r["id"] not in (None, 3)}
    assert by[50] == by[51] == by[7] == 7 and by[0] == 0 and by[1] == 1
    assert all(r["component_id"] is None for r in got if r["id"] is None)
    assert J.similar_groups(no_docs).count() == 0
    kept = J.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {50, 51} & {r["doc_id"] for r in kept.collect()} == set()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(110)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_short_sets_of_few_words_are_no_family(spark, monkeypatch):
    """Texts of repeated words share single shingles with many others; that alone joins no family."""
    rng = random.Random(6)
    docs = [(i, " ".join(" ".join([f"v{rng.randrange(60)}"] * 9) for _ in range(8))) for i in range(400)]
    docs += [(1000 + i, t + " end") for i, t in docs[:40]]
    members = []
    real = J.family_edges
    monkeypatch.setattr(J, "family_edges", lambda m, *a: members.append(m.groupBy("family").count().agg(F.max("count")).first()[0]) or real(m, *a))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in J.similar_groups(frame).collect()}
    assert got == brute(docs)
    assert members[0] < 40
