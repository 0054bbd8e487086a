import math
from collections import Counter

import numpy as np
import pytest

from carelog.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=100, positives=5, negatives=10):
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, lab) in enumerate(rows):
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, u)), j, lab == other) for b, (j, u, other) in enumerate(rows) if b != a and len(u) == len(v))
        for p, pos, same in [s for s in scored if s[2]][:positives]:
            far = [(s, j) for s, j, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(i, pos, k + 1, j, -p, -s) for k, (s, j) in enumerate(far)]
    return Counter(out)


def found(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def random_rows(n, seed, dim=8, labels=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.2, (n, dim)).astype(np.float32)
    lab = rng.integers(0, labels, n)
    return [(k, x[k].tolist(), int(lab[k])) for k in range(n)]


@pytest.mark.parametrize("part_rows, block_anchors", [(100_000, 100_000), (64, 7)])
def test_every_row_against_brute_force(spark, part_rows, block_anchors):
    rows = random_rows(900, 3)
    rows += [(1000 + k, [0.1, 0.2, 0.3, 0.1, 0.1, 0.1, 0.1, 0.1], 1) for k in range(300)]  # one vector many times: ties go to the smaller id
    rows += [(2000 + k, [0.1, 0.15, 0.3, 0.1, 0.1, 0.1, 0.1, 0.1], 2) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(hn.hard_negatives(df, part_rows=part_rows, block_anchors=block_anchors))
    assert got == brute(rows)
    assert len(got) > 300


def test_rows_that_take_no_part_and_repeated_rows(spark):
    good = random_rows(120, 5, dim=3, labels=2)
    odd = [(None, [0.1, 0.1, 0.1], 0), (300, None, 0), (400, [0.1, None, 0.1], 0), (500, [float("nan"), 0.1, 0.1], 0), (600, [float("inf"), 0.1, 0.1], 0),
           (700, [0.2, 0.1, 0.1], None), (800, [], 0), (801, [], 1), (900, [0.3], 0), (901, [0.2], 0), (902, [0.15], 1), (-100, [0.3, 0.2, 0.1], 0), (-7, [0.2, 0.2, 0.1], 1),
           (0, [0.3, 0.2, 0.1], 0), (0, [0.3, 0.2, 0.1], 0), (31, [0.2, 0.2, 0.1], 1), (31, [0.2, 0.2, 0.1], 1)]
    rows = good + odd
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", part int, score string")
    assert found(hn.hard_negatives(df, part_rows=40)) == brute(rows)


def test_empty_table_and_no_anchor(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hn.hard_negatives(df).columns == COLUMNS
    assert hn.hard_negatives(df).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(1, [0.1], 0), (2, [0.1], 1)], SCHEMA)).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(k, [2.0**18 + k, 2.0**17 - 3 * k, 1.0], k % 2) for k in range(0, 200, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute([(i, v, lab) for i, v, lab in rows])
    assert found(hn.hard_negatives(df)) == want
    huge = spark.createDataFrame([(0, [1e15], 0), (1, [1e15], 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="56 bits"):
        hn.hard_negatives(huge)


def test_boxes_hold_their_rows_and_prune():
    """Packed leaves hold each row once; on clustered vectors most leaves are never scored."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (64, 3))
    x = np.concatenate([c + rng.integers(-20, 20, (256, 3)) for c in centres])
    labels = rng.integers(0, 2, len(x))
    t = hn.build(np.arange(len(x)), labels, x)
    assert sorted(t["ids"].tolist()) == list(range(len(x)))
    low, high, label_low, label_high = t["levels"][0]
    for k in range(len(low)):
        part = t["x"][t["starts"][k]:t["starts"][k + 1]]
        assert (part >= low[k]).all() and (part <= high[k]).all()
        assert len(part) <= hn.LEAF_ROWS
    assert len(t["levels"][-1][0]) == 1
    t |= {"top": int(np.abs(x).max()), "keys": np.arange(len(x))}
    q = centres[:1]
    window = np.full((1, 1), hn.LEAST), np.full((1, 1), -hn.LEAST)
    a, w, score, ids, visited = hn.best_first(t, q, np.array([0]), np.array([-1]), *window, 5, True)
    want = sorted((-int(x[r] @ q[0]), r) for r in np.flatnonzero(labels == 0))[:5]
    assert [(-s, i) for s, i in zip(score.tolist(), ids.tolist())] == want
    assert visited < len(low) / 8
