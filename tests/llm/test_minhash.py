import random

import numpy as np
import pytest

from carelog.llm import minhash as M


def brute(docs, width=3, num=85):
    """(n, component, kept) of each row from (id, text); rows with a null id are left out."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in docs:
        w = (t or "").translate(low)
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets.append((i, frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    root = {s: s for _, s in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    distinct = [s for s in root if s]
    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if 100 * len(a & b) >= num * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for i, s in sets:
        if s and i is not None:
            r = find(s)
            least[r] = min(i, least.get(r, i))
    out = []
    for i, s in sets:
        c = i if not s or i is None else least[find(s)]
        out.append((i, len(s), c, i is None or c == i))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def corpus(seed, families=8, size=20):
    rng = random.Random(seed)
    docs, shared = [], [f"boiler{k}" for k in range(25)]
    for f in range(families):
        base = [f"f{f}w{k}" for k in range(rng.choice([3, 12, 40, 120, 300]))] + shared * (f % 2)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 40)}"
            docs.append(" ".join(w) if rng.random() < 0.9 else " ".join(w).upper())
    docs += [docs[0]] * 5 + ["", None, "a b", "A  b", "a b c"] + [f"{k} x y z " + " ".join(shared) for k in range(10)]
    rng.shuffle(docs)
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed, block", [(1, 2048), (2, 3)])
def test_against_brute_force(spark, seed, block):
    docs = corpus(seed)
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, kept string, n int")
    assert found(M.near_duplicates(frame, block=block)) == brute(docs)


def test_chains_and_a_hot_group(spark):
    """A chain whose ends are unlike is one component; a third of all rows is one group of near copies."""
    words = [f"c{k}" for k in range(100)]
    chain = []
    for k in range(12):
        words = words[:k * 4] + [f"n{k}a", f"n{k}b", f"n{k}c"] + words[k * 4 + 3:]
        chain.append(" ".join(words))
    base = [f"h{k}" for k in range(60)]
    hot = [" ".join(base + [f"tail{k}"]) for k in range(150)] + [" ".join(base)] * 150
    other = [" ".join(f"d{k}w{j}" for j in range(20)) for k in range(200)]
    docs = list(enumerate(chain + hot + other))
    random.Random(0).shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    want = brute(docs)
    assert found(M.near_duplicates(frame, block=16)) == want
    assert len({c for _, _, c, _ in want}) == 202


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    docs += [(70, "one two three four"), (70, "one two three four"), (70, "quite another text here"), (None, "one two three four"), (60, "One two three four")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, row string")
    assert found(M.near_duplicates(frame)) == brute(docs)
    assert M.near_duplicates(no_docs).count() == 0


def test_estimate_counts_differing_positions(spark):
    rng = np.random.default_rng(4)
    universe = np.unique(rng.integers(0, 1 << 63, 40_000, dtype=np.uint64))
    errors = []
    for k in range(40):
        n = 400
        shared = rng.integers(250, 399)
        pool = rng.choice(universe, 2 * n - shared, replace=False)
        a, b = np.sort(pool[:n]), np.sort(pool[n - shared:])
        x, y = M.packed(M.minima(a)), M.packed(M.minima(b))
        d = int(M.differing(x.view(np.uint64)[None], y.view(np.uint64)[None])[0, 0])
        want = sum(((int(p) >> s) ^ (int(q) >> s)) & 15 != 0 for p, q in zip(x, y) for s in range(0, 64, 4))
        assert d == want
        errors.append(M.estimate(d) - shared / (2 * n - shared))
        if k < 3:
            row = spark.createDataFrame([(x.tolist(), y.tolist())], "a array<long>, b array<long>")
            assert row.select(M.differing_columns("a", "b").alias("d")).first()["d"] == want
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 0.06


def test_signatures_find_links_at_the_threshold():
    """Sets just at the threshold share a band and pass the estimate (the odds against are 1 in a million)."""
    rng = np.random.default_rng(9)
    for n in (7, 40, 170, 850):
        for _ in range(60):
            pool = np.unique(rng.integers(0, 1 << 63, 3 * n + 50, dtype=np.uint64))
            rng.shuffle(pool)
            extra = int(0.15 * n / 0.85)
            a, b = np.sort(pool[:n]), np.sort(pool[:n + extra])
            ma, mb = M.minima(a), M.minima(b)
            assert (M.band_keys(ma) == M.band_keys(mb)).any()
            assert M.differing(M.packed(ma).view(np.uint64)[None], M.packed(mb).view(np.uint64)[None])[0, 0] <= M.most_differing(85)
