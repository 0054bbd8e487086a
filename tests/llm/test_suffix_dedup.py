import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from carelog.llm import suffix_dedup as S


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k:k + 400] for d in data for k in range(len(d) - 399))
    out = []
    for d in data:
        gone = [False] * len(d)
        for k in range(len(d) - 399):
            if seen[d[k:k + 400]] > 1:
                gone[k:k + 400] = [True] * 400
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(d), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return sorted(out)


def corpus():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, line, chunk = text(900), text(200), text(399)
    texts = [text(rng.randint(0, 1500)) for _ in range(15)]
    texts += [text(50) + passage[a:a + 450] + text(30) for a in (0, 100, 300, 449)]
    texts += [text(rng.randint(0, 300)) + line + text(400) for _ in range(12)]  # too short a passage
    texts += [text(20) + chunk + "x" + text(20), text(20) + chunk + "x" + text(20), text(10) + chunk + "y" + text(10)]
    texts += [texts[0], texts[0], text(399), None, "", "ab" * 700, "z" * 400, "z" * 401, text(500) * 2, passage]
    return texts


def rows(df):
    return sorted((r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in df.collect())


def test_against_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string")
    assert rows(S.remove_repeats(docs)) == brute(texts)


def test_split_groups_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 2)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(S.remove_repeats(docs)) == brute(texts)


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.choice(b"abc") for _ in range(5000))
    whole = S.contexts(data)
    monkeypatch.setattr(S, "_PART", 700)
    parts = S.contexts(data)
    cover = lambda c: {(s, p) for p, a, z in zip(c[1], c[2], c[3]) for s in range(a, z + 1)}
    assert cover(whole) == cover(parts) and len({s for s, _ in cover(whole)}) == 4601


def test_odd_rows(odd_docs, no_docs):
    with pytest.raises(ValueError):
        S.remove_repeats(odd_docs)
    docs = odd_docs.drop("kept", "spans").withColumn("copy", F.col("text"))
    got = S.remove_repeats(docs)
    assert rows(got) == brute([r["text"] for r in odd_docs.collect()])
    assert S.remove_repeats(no_docs.drop("kept", "spans")).count() == 0


def test_passages_of_over_fifty_words_may_be_shorter_than_the_removed_strings(spark, tmp_path):
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 6))) for _ in range(n)]
    passage, long_ = words(51), words(49)
    texts = [" ".join(words(60) + (passage if k % 4 == 0 else long_ if k % 4 == 1 else []) + words(rng.randint(0, 90))) for k in range(40)]
    texts += ["\n".join(passage), " ".join(passage[:50]), " ".join(passage[:49]), None, "", *[" ".join(passage[:20] + words(29))] * 2, *[" ".join(words(50))] * 2]
    texts.append(" ".join((part := words(50)) + words(3) + part))  # repeats itself, and shares with none
    runs = {}
    for k, t in enumerate(texts):
        ws = (t or "").split()
        for i in range(len(ws) - 49):
            runs.setdefault(tuple(ws[i:i + 50]), set()).add(k)
    want = set().union(*(v for v in runs.values() if len(v) > 1))
    assert want == {*range(0, 40, 4), 40, 41, 47, 48}
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in S.op9_suffix_dedup(spark, str(tmp_path)).collect()}
    assert {k for k, r in got.items() if r["shares_passage"]} == want
    assert not got[0]["has_repeats"] and got[0]["n_removed"] == 0  # the contract's removal is as it was
