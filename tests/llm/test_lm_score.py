import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from carelog.llm import lm_score as L

TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def corpus(n=400):
    rng = random.Random(2)
    parts = ["th", "an", "der", "tion", "es", "qu", "en", "ing", "ou", "wh", "re", "ble", "st", "ha"]
    words = ["the", "of", "and", "de", "la"]
    word = lambda: rng.choice(words) if rng.random() < 0.5 else "".join(rng.choice(parts) for _ in range(rng.randint(2, 5)))
    return [(i, " ".join(word() for _ in range(rng.randint(0, 120)))) for i in range(n)]


def test_base_counts_are_exact_and_context_helps(spark, monkeypatch):
    monkeypatch.setattr(L, "WORDS", 20)  # most words take the way of the rare ones
    monkeypatch.setattr(L, "LOCAL_PAIR", 1)  # a small corpus: count everything
    monkeypatch.setattr(L, "LOCAL_TRIPLE", 1)
    monkeypatch.setattr(L, "WINDOW_RATE", 2)
    docs = corpus() + [(1000, None), (None, "the the"), (5, "x y"), (5, "x y")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1))
    tokens = [((t or "").encode().translate(TABLE).split() + [None], i) for i, t in docs]
    c = Counter(w for ws, i in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n,
                   round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for ws, i in tokens)
    got = L.lm_scores(frame).collect()
    assert sorted((str(r["id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    out = [r for r in got if r["held_out"]]
    words = L.Words(L.vocabulary())
    ids = lambda text: words.subwords(words.rows([(text or "").encode().translate(TABLE).split()])[0]).tolist()
    single = Counter(x for i, t in docs if not held(i) for x in ids(t))
    n = sum(single.values())
    alone = sum(math.log10((single[x] + 0.1) / (n + 0.1 * L.IDS)) for i, t in docs if held(i) for x in ids(t))
    assert len(out) > 30 and sum(r["score"] for r in out) > 0.9 * alone


def small_model():
    rng = np.random.default_rng(0)
    ids = np.array([5, 9, 17, 300, L.END, L.START])
    single = (ids, np.array([50, 30, 20, 3, 10, 10]))
    pairs = (np.array([5 << 16 | 9, 9 << 16 | 17, L.START << 16 | 5]), np.array([20, 12, 9]))
    triples = (np.array([5 << 32 | 9 << 16 | 17]), np.array([8]))
    memory = L.Memory(single, pairs, triples)
    model = L.Attention(single)
    model.theta += rng.normal(0, 0.2, len(model.theta)).astype(np.float32)
    return model, memory


def test_probabilities_add_up_to_one():
    model, memory = small_model()
    every = np.concatenate([np.arange(L.START), np.arange(L.START + 1, L.IDS)])
    for two, one in ((5, 9), (L.START, 5), (L.PAD, L.START), (9, 300), (1, 2)):
        p = memory(np.full(len(every), two), np.full(len(every), one), every)
        assert abs(float(p.astype(np.float64).sum()) - 1) < 1e-3
    w = np.full((1, L.CONTEXT + L.SCORED + 1), L.PAD, np.uint16)
    w[0, L.CONTEXT:L.CONTEXT + 3] = [L.START, 5, 9]
    total = 0.0
    for part in np.array_split(every, 200):
        many = np.repeat(w, len(part), axis=0)
        many[:, L.CONTEXT + 3] = part
        total += float(model.probability(many, memory)[0][:, 2].astype(np.float64).sum())
    assert abs(total - 1) < 1e-3


def test_gradient_by_differences():
    model, memory = small_model()
    ids = np.random.default_rng(1).choice([5, 9, 17, 300], 70).astype(np.uint16)
    w, _ = L.windows([np.append(ids, np.uint16(L.END))])
    real = w[:, L.CONTEXT + 1:] != L.PAD
    value = lambda m: float(np.log(m.probability(w, memory)[0][real].astype(np.float64)).mean())
    g = model.gradient(w, memory, itself=False)
    for k in np.argsort(-np.abs(g))[[0, 3, 10, 40, 100]]:
        step = 1e-2
        model.theta[k] += step
        up = value(model)
        model.theta[k] -= 2 * step
        down = value(model)
        model.theta[k] += step
        assert abs((up - down) / (2 * step) - g[k]) < 2e-3 + 0.05 * abs(g[k])


def test_windows_score_each_id_once_and_see_only_the_past():
    model, memory = small_model()
    texts = [np.append(np.random.default_rng(k).choice([5, 9, 17], n).astype(np.uint16), np.uint16(L.END)) for k, n in enumerate((0, 1, 15, 16, 17, 100))]
    w, owner = L.windows(texts)
    for k, t in enumerate(texts):
        assert w[owner == k][:, L.CONTEXT + 1:].ravel()[:len(t)].tolist() == t.tolist()
    p = model.probability(w, memory)[0]
    later = w.copy()
    later[:, -5:] = 9
    changed = model.probability(later, memory)[0]
    assert np.allclose(p[:, :-5], changed[:, :-5])
    taken = [L.windows(texts, [k] * len(texts))[0] for k in range(L.WINDOW_RATE)]
    assert sum(map(len, taken)) == len(w)


def test_every_window_of_a_training_text_trains_once(spark, monkeypatch):
    docs = [(i, f"short text {i} " * (1 + i % 9)) for i in range(60)]
    words = L.Words(L.vocabulary())
    ids = [words.subwords(words.rows([t.encode().split()])[0]) for i, t in docs if not held(i)]
    seen, train = [], L.train

    def watched(gathered, shared):
        seen.extend(bytes(r["ids"]) for r in gathered.where("kind = 'window'").collect())
        return train(gathered, shared)

    monkeypatch.setattr(L, "train", watched)
    L.lm_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(seen) == sorted(w.tobytes() for w in L.windows(ids)[0])


def test_counts_do_not_depend_on_partitions_and_no_key_is_lost(spark):
    docs = spark.createDataFrame([(f"one two three {i % 3}", 0) for i in range(24)], "text string, pick int")
    gathered = lambda n: L.gather(docs.repartition(n), L.vocabulary()).where("kind <> 'window'")
    counts = lambda n: sorted((r["kind"], r["key"], r["c"]) for r in gathered(n).groupBy("kind", "key").agg(F.sum("count").alias("c")).collect())
    assert counts(1) == counts(12)
    assert sum(c for kind, _, c in counts(12) if kind == "id3") == sum(c for kind, _, c in counts(12) if kind == "id1") - 48
    keys = np.arange(1, 5001, dtype=np.int64) << 32 | 7 << 16 | 9
    pairs = (keys >> 16, np.full(5000, 3))
    memory = L.Memory((np.array([7]), np.array([15000])), pairs, (keys, np.full(5000, 2)))
    assert (memory.triple.get(keys) > 0).all() and (memory.pair.get(pairs[0]) > 0).all()


def test_empty(spark, no_docs):
    assert L.lm_scores(no_docs).count() == 0
    only_held = [i for i in range(200) if held(i)][:2]
    got = L.lm_scores(spark.createDataFrame([(i, "some text") for i in only_held], "doc_id long, text string")).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)


def test_a_step_reads_and_moves_only_the_rows_of_its_windows():
    model, memory = small_model()
    texts = [np.append(np.random.default_rng(k).choice([5, 9, 17, 300], 40 + 30 * k).astype(np.uint16), np.uint16(L.END)) for k in range(20)]
    w, _ = L.windows(texts)
    g = model.gradient(w, memory)
    before, squares = model.theta.copy(), np.full(len(g), 1e-6, np.float32)
    model.step(w, memory, model.views(squares))
    assert np.allclose(squares, 1e-6 + g * g) and np.allclose(model.theta, before + L.RATE * g / np.sqrt(1e-6 + g * g), atol=1e-5)
    rows, sums = L._sum_rows(w.ravel() % 50, np.ones((w.size, 3), np.float32))
    assert dict(zip(rows.tolist(), sums[:, 2].tolist())) == dict(Counter((w.ravel() % 50).tolist()))


def test_lookup_and_memory_of_windows():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 48, 3000))
    for n in (0, 1, 7, 3000):
        held = L.Lookup(keys[:n], np.arange(n) + 1)
        assert held.get(keys).tolist() == [k + 1 if k < n else 0 for k in range(len(keys))]
        assert not held.at(np.array([[1 << 50, 1 << 60]])).any()
    _, memory = small_model()
    w, _ = L.windows([np.append(np.random.default_rng(5).choice([5, 9, 17, 300], 90).astype(np.uint16), np.uint16(L.END))])
    for itself in (False, True):
        assert np.array_equal(memory.of_windows(w, itself), memory(w[:, L.CONTEXT - 1:-2], w[:, L.CONTEXT:-1], w[:, L.CONTEXT + 1:], itself))


def test_words_with_odd_spaces_keep_their_ids():
    words = [w.encode() for w in ("plain", "a\x85b", "x　y", "last", "é")]
    one = L.Words(L.vocabulary())
    together = one.rows([words, words[::-1]])
    for w, k in zip(words, together[0]):
        alone = L.Words(L.vocabulary())
        assert alone.subwords(alone.rows([[w]])[0]).tolist() == one.subwords(np.array([k])).tolist()
    assert together[1].tolist() == together[0].tolist()[::-1]


def test_gathered_keys_come_once_with_whole_counts(spark):
    texts = [f"one two three {i % 3} qzx{i}" for i in range(40)]
    docs = spark.createDataFrame([(t, 0) for t in texts], "text string, pick int").repartition(5)
    got = L.gather(docs, L.vocabulary()).where("kind <> 'window'").collect()
    assert len({(r["kind"], r["key"]) for r in got}) == len(got)
    assert sorted(r["count"] for r in got if r["kind"] == "word") == sorted(Counter(w for t in texts for w in t.split()).values())
    keys = np.array([0, 1, 1 << 47, -1, -(1 << 63)])
    assert np.array_equal(L.unpacked(L.packed(keys), 5), keys)


def test_words_of_texts_as_split_in_python():
    texts = [None, "", " \t\n", "One two\x0b\x0cTWO  two ", "ÄÖ É\x85x \x1c　y", "end\n", "x" * 3000]
    words = L.Words(L.vocabulary())
    rows, counts = words.of_texts(pa.array(texts))
    cut = [(t or "").encode().translate(TABLE).split() for t in texts]
    assert counts.tolist() == [len(c) for c in cut]
    assert rows.tolist() == np.concatenate(words.rows(cut)).tolist()
    ids = words.subwords_of(rows, counts)
    assert [i.tolist() for i in ids] == [words.subwords(r).tolist() for r in words.rows(cut)]
    assert all(i[-1] == L.END for i in ids) and [len(i) for i in ids[:3]] == [1, 1, 1]


def test_reused_arrays_keep_nothing_of_other_batches():
    ids = [np.append(np.random.default_rng(k).choice([5, 9, 17, 300], 90 + k).astype(np.uint16), np.uint16(L.END)) for k in range(12)]
    w, _ = L.windows(ids)
    model, memory = small_model()
    alone = [model.gradient(w[:n], memory).copy() for n in (7, len(w), 30)]
    for n, g in zip((7, len(w), 30), alone):
        fresh, _ = small_model()
        assert np.allclose(fresh.gradient(w[:n], memory), g, atol=1e-6)
    first = model.probability(w[:20], memory)[0]
    kept = first.copy()
    model.probability(w[20:60], memory)
    assert np.array_equal(first, kept)
    model.out *= 1e4  # odds that overflow are shifted
    p = model.probability(w, memory)[0]
    assert np.isfinite(p).all() and (p >= 0).all()
