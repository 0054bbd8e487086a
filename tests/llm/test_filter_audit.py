import itertools
import re
from collections import defaultdict

import pytest

from carelog.llm.filter_audit import FILTERS, METRICS, filter_audit

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """Rows of the audit from (id, text, part) and (id, quality, toxic), by applying every order to every document."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    docs = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)}
        docs.append((part or "", {f for f in fails if fails[f]}, i is not None and i in good, i is not None and i in toxic))
    out = {}
    shapley = defaultdict(int)
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {d[0] for d in docs}:
            mine = [d for d in docs if d[0] == part]
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [d for d in mine if f in d[1] and not d[1] & before]
                out[part, order, k + 1] = (sum(not d[1] & (before | {f}) for d in mine), len(here), sum(f in d[1] and bool(d[1] & before) for d in mine),
                                           sum(d[1] == {f} for d in mine), sum(d[2] for d in here), sum(d[3] for d in here))
                shapley[part, f] += len(here)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def found(df):
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in [*METRICS, "shapley"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_every_order_of_odd_documents(spark):
    plain = " ".join(f"word{i}" for i in range(60))
    texts = [plain, plain, plain + " #", "A B C", "", None, " \t\n", "the " * 80, "The " * 80, plain.upper(), plain.upper() + " $", "é中😀 " * 70, "a\x85b \x1c " * 60]
    rows = [(k, t, ["x", "y", None, ""][k % 4]) for k, t in enumerate(texts)]
    rows += [(None, plain, "x"), (None, plain, "x"), (0, plain, "x"), (0, plain, "z"), (0, "A B C", "x"), (3, "", "z"), (40, plain, "z")]
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (9, None, 1), (None, 1, 1), (5, 1, 0), (40, 1, None)]
    docs = spark.createDataFrame([(*r, "m", 1) for r in rows], "doc_id long, text string, source string, mask string, n int")
    got = found(filter_audit(docs, spark.createDataFrame(labels, LABELS)))
    want = brute(rows, labels)
    assert got == want
    assert len(want) == 600 * len({r[2] or "" for r in rows})


def test_empty_tables(spark, odd_docs, no_docs):
    docs = no_docs.withColumnRenamed("kept", "source")
    none = spark.createDataFrame([], LABELS)
    assert filter_audit(docs, none).count() == 0
    assert filter_audit(odd_docs.withColumnRenamed("kept", "source"), none).where("good_lost + toxic_lost > 0").count() == 0


@pytest.mark.parametrize("duplicates", ["E", None])
def test_other_filters_and_a_hot_part(spark, duplicates):
    """Totals hold whatever the order: kept at the last step, and Shapley sums over the filters."""
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'copy' else concat('text ', id % 900) end as text",
                                        "case when id % 3 = 0 then 'hot' else concat('s', id % 5) end as source")
    some = {"A": FILTERS["A"], "Z": lambda t: t.endswith("7")}
    got = filter_audit(docs, spark.createDataFrame([], LABELS), some, duplicates).collect()
    size = 3 if duplicates else 2
    kept = defaultdict(set)
    for r in got:
        if r["step"] == size:
            kept[r["part"]].add(r["kept"])
    assert all(v == {0} for v in kept.values())  # every text is short
    orders = {2: 2, 3: 6}[size]
    hot = {r["letter"]: r["shapley"] for r in got if r["part"] == "hot"}
    assert sum(hot.values()) == 1000 * orders
