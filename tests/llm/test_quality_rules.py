import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from carelog.llm.quality_rules import default_rules, estimate, posterior, quality, text_statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    n = len(words)
    count = Counter(tuple(words[i:i + 3]) for i in range(n - 2))
    hit = {p for i in range(n - 2) if count[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dups, len(hit)


def test_statistics(spark, odd_docs):
    texts = ["a b c a b c", "a a a a", "l1\nl1\n l1\n\n\nl1 ", "x|y *** <p>\n", "a b c d a b c x b c d"]
    docs = odd_docs.select("text").unionAll(spark.createDataFrame([(t,) for t in texts], "text string"))
    docs = docs.withColumn("copy", F.col("text"))
    for r in text_statistics(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(r["copy"]), r


def test_estimation_finds_reliable_rules(spark):
    rows = [(1, 1, 1, 700), (-1, -1, -1, 150), (1, 1, -1, 60), (-1, -1, 1, 50), (0, 1, 0, 30), (1, 0, 0, 10)]
    patterns = spark.createDataFrame(rows, "a int, b int, c int, n long").coalesce(1)
    model = estimate(patterns, ["a", "b", "c"])
    assert model["accuracy"]["a"] > 0.95 and model["accuracy"]["a"] > model["accuracy"]["c"]
    p = {tuple(r[:3]): r["p"] for r in patterns.withColumn("p", posterior(model)).collect()}
    assert p[1, 1, -1] > 0.5 > p[-1, -1, 1]


def test_a_single_failure_does_not_drop(spark):
    good = "Plain words make a sentence that ends well here today. " * 3
    texts = [f"{good} number {i} " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60)) + "." for i in range(40)]
    junk = [" ".join(f"w{i}{j}%%%" for j in range(80)) for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts + junk)), "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality(docs).collect()}
    assert not any(kept[i] for i in range(40, 46)) and sum(kept[i] for i in range(40)) >= 38


def test_odd_rows_and_clashes(odd_docs, no_docs):
    with pytest.raises(ValueError):
        quality(odd_docs)
    got = quality(odd_docs.drop("kept")).collect()
    assert len(got) == odd_docs.count() and all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    assert quality(no_docs.drop("kept")).count() == 0
    plan = text_statistics(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert set(default_rules())
