"""Operator 12, hard-negative mining by best-first search over STR-packed R-trees.

Every vector is indexed.  Rows are dealt by (length, label, first component, id)
into parts of about ``PART_ROWS`` rows, and each part packs its rows into R-trees by
sort-tile-recursive: rows of a label are sorted by their most varying component, cut
into slabs, each slab by the next component, and so on down to leaves of
``LEAF_ROWS`` rows; ``FANOUT`` neighbours make the node above.  A node holds its
minimum bounding box and the span of its labels.

A box gives an interval for the inner product with an anchor: each component adds
its smaller and its larger product with the box's two ends.  The search of a part
takes a block of anchors through one queue, the box with the largest upper end
first.  An anchor follows a box only while the interval meets one of its score
windows and its upper end is not strictly below that window's kth score so far (an
equal score may still win by its id).  What remains is scored exactly; integers keep
sums exact.

Two searches follow each other.  The first finds each anchor's best rows of its own
label, in parts that hold the label.  Their scores make the windows of the second,
which looks at rows of other labels.  Each part returns at most k rows for an anchor
and window, and these are merged.  Anchors travel to parts in blocks; a part's rows
travel once for every ``BLOCK_ANCHORS`` anchors, so no task holds more than one part
and so many anchors.  The result is exact, so recall is 1; where boxes are too wide
to prune (many independent components), every leaf is scored.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component take no part; vectors meet only vectors of their length (empty ones score
0); repeated rows are rows like any others, and an anchor leaves out only itself; a
score that could need more than 56 bits raises ``ValueError``; empty tables give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, scratch, table, tidy

#: Rows of a part, rows of a leaf, children of a node, and anchors that a task takes at a time.
PART_ROWS, LEAF_ROWS, FANOUT, BLOCK_ANCHORS = 16_384, 128, 8, 32_768
LEAST = -(1 << 62)
PAGE = ("part int, page long, dim int, n int, top long, ids binary, labels binary, x binary, levels array<int>, "
        "low binary, high binary, label_low binary, label_high binary")


def usable(vectors: DataFrame, vec_id: str, vector: str, label, scale: int) -> DataFrame:
    """(id, label, v): rows that take part, components as floor(scale * x)."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"),
                          F.col(vector).cast("array<double>").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & whole)
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))


def tiles(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of the leaves, by sort-tile-recursive over the components, most varying first."""
    order = np.argsort(-x.var(axis=0), kind="stable") if x.shape[1] else np.zeros(0, int)

    def cut(rows, depth):
        leaves = -(-len(rows) // leaf)
        if leaves <= 1:
            return [rows]
        left = len(order) - depth
        if left <= 0:  # no component left: equal boxes would not help either
            return [rows[k:k + leaf] for k in range(0, len(rows), leaf)]
        slabs = max(2, int(np.ceil(leaves ** (1 / left) - 1e-9)))
        rows = rows[np.argsort(x[rows, order[depth]], kind="stable")]
        size = leaf * -(-leaves // slabs)
        return [t for k in range(0, len(rows), size) for t in cut(rows[k:k + size], depth + 1)]

    return cut(np.arange(len(x)), 0)


def build(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF_ROWS) -> dict:
    """An R-tree over the rows: rows in leaf order, and the boxes of all levels, leaves first."""
    leaves = []
    by_label = np.argsort(labels, kind="stable")
    first = np.flatnonzero(np.diff(labels[by_label], prepend=labels[by_label[0]] - 1))
    for rows in np.split(by_label, first[1:]):
        leaves += [rows[t] for t in tiles(x[rows].astype(np.float64), leaf)]
    # small labels share leaves
    merged, now = [], []
    for t in leaves:
        if now and sum(map(len, now)) + len(t) > leaf:
            merged.append(np.concatenate(now))
            now = []
        now.append(t)
    merged.append(np.concatenate(now))
    order = np.concatenate(merged)
    ids, labels, x = ids[order], labels[order], x[order]
    starts = np.cumsum([0, *map(len, merged)])
    cut = starts[:-1]
    levels = [(np.minimum.reduceat(x, cut), np.maximum.reduceat(x, cut), np.minimum.reduceat(labels, cut), np.maximum.reduceat(labels, cut))]
    while len(levels[-1][0]) > 1:
        cut = np.arange(0, len(levels[-1][0]), FANOUT)
        low, high, label_low, label_high = levels[-1]
        levels.append((np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut),
                       np.minimum.reduceat(label_low, cut), np.maximum.reduceat(label_high, cut)))
    return {"ids": ids, "labels": labels, "x": x, "starts": starts, "levels": levels}


def _small(a: np.ndarray) -> np.ndarray:
    """Half-words where every value fits, to save shuffle and disk."""
    return a.astype(np.int16) if not a.size or (a.min() >= -32768 and a.max() <= 32767) else a


def _ints(raw: bytes, cells: int) -> np.ndarray:
    return np.frombuffer(raw, np.int16 if len(raw) == 2 * cells else np.int64).astype(np.int64)


def pack(rows: DataFrame, parts: int, part_rows: int) -> DataFrame:
    """One R-tree (``PAGE``) for each part and vector length; parts that came out too long make several."""
    def page(part, number, dim, ids, labels, x):
        t = build(ids, labels, x)
        box = [np.concatenate([level[k] for level in t["levels"]]) for k in range(4)]
        top = int(np.abs(x).max()) if x.size else 0
        sizes = np.diff(t["starts"]).tolist()
        return [part, part * (1 << 20) + number, dim, len(ids), top, t["ids"].tobytes(), t["labels"].tobytes(), _small(t["x"]).tobytes(),
                [len(t["levels"]), *(len(level[0]) for level in t["levels"]), *sizes],
                _small(box[0]).tobytes(), _small(box[1]).tobytes(), box[2].tobytes(), box[3].tobytes()]

    names = [c.split()[0] for c in PAGE.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()),
             pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush():
            nonlocal number
            ids, labels, sizes = (np.concatenate([h[k] for h in held]) for k in range(3))
            values = np.concatenate([h[3] for h in held])
            begin = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                mine = np.flatnonzero(sizes == dim)
                x = values[begin[mine][:, None] + np.arange(dim)].reshape(len(mine), dim)
                made = page(part, number, int(dim), ids[mine], labels[mine], x)
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made, kinds)], names)

        for b in batches:
            v = b.column("v")
            sizes = np.asarray(v.value_lengths()).astype(np.int64)
            held.append((b.column("id").to_numpy(), b.column("label").to_numpy(), sizes, np.asarray(v.flatten()).astype(np.int64)))
            if sum(len(h[0]) for h in held) >= 4 * part_rows:
                yield from flush()
                held = []
        if sum(len(h[0]) for h in held):
            yield from flush()

    dealt = rows.repartitionByRange(parts, F.size("v"), "label", F.try_element_at("v", F.lit(1)), "id")
    return dealt.mapInArrow(tidy(run), PAGE)


def unpack(page) -> dict:
    """The tree of a row of ``PAGE``."""
    n, dim, shape = int(page["n"]), int(page["dim"]), np.asarray(page["levels"])
    counts, sizes = shape[1:1 + shape[0]], shape[1 + shape[0]:]
    total = int(counts.sum())
    low, high = (_ints(page[c], total * dim).reshape(total, dim) for c in ("low", "high"))
    label_low, label_high = (np.frombuffer(page[c], np.int64) for c in ("label_low", "label_high"))
    ends = np.cumsum(counts)
    levels = [(low[e - c:e], high[e - c:e], label_low[e - c:e], label_high[e - c:e]) for c, e in zip(counts, ends)]
    return {"ids": np.frombuffer(page["ids"], np.int64), "labels": np.frombuffer(page["labels"], np.int64), "top": int(page["top"]),
            "x": _ints(page["x"], n * dim).reshape(n, dim), "starts": np.concatenate([[0], np.cumsum(sizes)]), "levels": levels,
            "keys": (int(page["page"]) << 32) + np.arange(n)}


def best_first(tree: dict, q: np.ndarray, labels: np.ndarray, keys: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
    """The first k rows of each anchor and window: arrays (anchor, window, score, id).

    ``q`` holds the anchors' vectors, ``keys`` the rows that they are, ``low`` and
    ``high`` (anchors, windows) the scores allowed, both ends included.  ``same``: rows of the
    anchor's label but itself; else rows of other labels.  Also returns how many leaves were scored.
    """
    count, windows = low.shape
    reach = (int(np.abs(q).max()) if q.size else 0) * tree["top"] * max(q.shape[1], 1)
    if reach >= 1 << 56:  # a hundred times a score must fit a long
        raise ValueError("scores need more than 56 bits")
    exact = np.float64 if reach < 1 << 53 else np.int64  # sums in doubles are exact below 2^53
    product = lambda a, b: (a.astype(exact) @ b.astype(exact).T).astype(np.int64)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    best = np.full((3, count, windows, k), LEAST, np.int64)  # scores, ids, rows
    queue: list[tuple] = []
    made = visited = 0

    def push(level, nodes):
        nonlocal made
        lo, hi, label_low, label_high = (a[nodes] for a in tree["levels"][level])
        least, most = product(up, lo) + product(down, hi), product(up, hi) + product(down, lo)
        for j, node in enumerate(range(nodes.start, nodes.start + len(lo))):
            fits = (label_low[j] <= labels) & (labels <= label_high[j]) if same else (label_low[j] != labels) | (label_high[j] != labels)
            heapq.heappush(queue, (-int(most[:, j].max()), made, level, node, least[:, j], most[:, j], fits))
            made += 1

    if count:
        push(len(tree["levels"]) - 1, slice(0, 1))
    while queue:
        _, _, level, node, least, most, fits = heapq.heappop(queue)
        floor = np.maximum(low, best[0, :, :, -1])
        active = np.flatnonzero(fits & ((most[:, None] >= floor) & (least[:, None] <= high)).any(axis=1))
        if not len(active):
            continue
        if level:
            push(level - 1, slice(node * FANOUT, (node + 1) * FANOUT))
            continue
        visited += 1
        rows = slice(tree["starts"][node], tree["starts"][node + 1])
        score = product(q[active], tree["x"][rows])
        fits = tree["labels"][rows][None, :] == labels[active][:, None]
        fits = fits & (tree["keys"][rows][None, :] != keys[active][:, None]) if same else ~fits
        for w in range(windows):
            a, r = np.nonzero(fits & (score >= floor[active, w][:, None]) & (score <= high[active, w][:, None]))
            if not len(a):
                continue
            touched = np.unique(active[a])
            old = best[:, touched, w]
            who = np.concatenate([np.repeat(touched, k), active[a]])
            s, i, row = (np.concatenate([old[j].ravel(), new]) for j, new in enumerate((score[a, r], tree["ids"][rows][r], np.arange(rows.start, rows.stop)[r])))
            by = np.lexsort((row, i, -s, who))
            who = who[by]
            first = np.flatnonzero(np.diff(who, prepend=-1))
            rank = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
            keep = rank < k
            for j, values in enumerate((s, i, row)):
                best[j, who[keep], w, rank[keep]] = values[by][keep]
    a, w, j = np.nonzero(best[0] > LEAST)
    return a, w, best[0, a, w, j], best[1, a, w, j], visited


def anchor_blocks(pages: DataFrame, every: int) -> DataFrame:
    """(block, label, dim, keys, ids, q): the anchors of each page and label."""
    names = ["block", "label", "dim", "keys", "ids", "q"]

    def run(batches):
        for b in batches:
            for page in b.to_pylist():
                t = unpack(page)
                chosen = np.flatnonzero(t["ids"] % every == 0)
                rows = [[] for _ in names]
                for k, label in enumerate(np.unique(t["labels"][chosen])):
                    mine = chosen[t["labels"][chosen] == label]
                    for c, v in zip(rows, ((page["page"] << 20) + k, int(label), page["dim"], t["keys"][mine].tobytes(), t["ids"][mine].tobytes(), _small(t["x"][mine]).tobytes())):
                        c.append(v)
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names)

    return pages.mapInArrow(tidy(run), "block long, label long, dim int, keys binary, ids binary, q binary")


def search(pages: DataFrame, blocks: DataFrame, rounds: int, k: int, same: bool) -> DataFrame:
    """(block, slot, w, score, id): at most k rows of each part for each anchor and window.

    ``blocks`` says which part each block visits (``part``) and has the windows of its
    anchors as (slot, w, low, high); without windows every score is allowed.
    """
    turn = F.pmod(F.xxhash64("block"), F.lit(rounds)).cast("int")
    pages = pages.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))

    def run(key, trees: pd.DataFrame, visits: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not len(visits):
            trees = trees[:0]
        for page in trees.to_dict("records"):
            t = unpack(page)
            mine = visits[visits["dim"] == page["dim"]]
            if not len(mine):
                continue
            sizes = np.array([len(b) // 8 for b in mine["ids"]])
            q = np.concatenate([_ints(b, n * page["dim"]) for b, n in zip(mine["q"], sizes)]).reshape(sizes.sum(), page["dim"])
            keys = np.frombuffer(b"".join(mine["keys"]), np.int64)
            labels = np.repeat(mine["label"].to_numpy(), sizes)
            block, begin = np.repeat(mine["block"].to_numpy(), sizes), np.cumsum(sizes) - sizes
            slot = np.arange(len(q)) - np.repeat(begin, sizes)
            if same:
                low, high = np.full((len(q), 1), LEAST), np.full((len(q), 1), -LEAST)
            else:
                wide = 1 + max((x["w"] for windows in mine["windows"] for x in windows), default=0)
                low, high = np.full((len(q), wide), -LEAST), np.full((len(q), wide), LEAST)  # closed
                for at, windows in zip(begin, mine["windows"]):
                    for x in windows:
                        low[at + x["slot"], x["w"]], high[at + x["slot"], x["w"]] = x["low"], x["high"]
            a, w, score, found, _ = best_first(t, q, labels, keys, low, high, k, same)
            out.append(pd.DataFrame({"block": block[a], "slot": slot[a].astype(np.int32), "w": w.astype(np.int32), "score": score, "id": found}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("block", "int64"), ("slot", "int32"), ("w", "int32"), ("score", "int64"), ("id", "int64"))})

    key = ["part", "round"]
    return pages.groupBy(*key).cogroup(blocks.withColumn("round", turn).groupBy(*key)).applyInPandas(
        run, "block long, slot int, w int, score long, id long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("block", "slot", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _hundredth(x):
    """floor(x / 100) of a long."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def _labels_of(batches):
    for b in batches:
        for page in b.to_pylist():
            labels = np.unique(np.frombuffer(page["labels"], np.int64))
            n = len(labels)
            yield pa.RecordBatch.from_arrays([pa.array([page["part"]] * n, pa.int32()), pa.array([page["dim"]] * n, pa.int32()), pa.array(labels)], ["part", "dim", "label"])


def _anchor_ids(batches):
    for b in batches:
        for row in b.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(ids), pa.int64()), pa.array(np.arange(len(ids)), pa.int32()), pa.array(ids)], ["block", "slot", "anchor_id"])


def hard_negatives(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label="label", scale: int = 256, every: int = 100,
                   positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
                   part_rows: int = PART_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``.  For each of an anchor's
    first ``positives`` rows of the same label it returns the first ``negatives`` rows
    of other labels whose score lies between ``least`` and ``most`` per cent of the
    positive's.  ``label`` is a column or its name.
    """
    label = F.col(label) if isinstance(label, str) else label
    with scratch():
        return saved(_mine(vectors, vec_id, vector, label, scale, every, positives, negatives, least, most, part_rows, block_anchors), "negatives", keep=True)


def _mine(vectors, vec_id, vector, label, scale, every, positives, negatives, least, most, part_rows, block_anchors) -> DataFrame:
    rows = usable(vectors, vec_id, vector, label, scale)
    total = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("anchors")).first()
    parts, rounds = max(1, -(-total["n"] // part_rows)), max(1, -(-total["anchors"] // block_anchors))
    pages = saved(pack(rows, parts, part_rows), "pages")
    blocks = saved(anchor_blocks(pages, every), "anchors")
    held = pages.select("part", "dim", "labels").mapInArrow(_labels_of, "part int, dim int, label long").distinct()
    near = search(pages, blocks.join(held, ["dim", "label"]), rounds, positives, True)
    top = saved(_first(near, positives).select("block", "slot", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"),
                                               F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score")
    ends = F.struct("slot", "w", (-_hundredth(-least * score)).alias("low"), _hundredth(most * score).alias("high"))
    windows = top.groupBy("block").agg(F.collect_list(ends).alias("windows"))  # at most ``positives`` for each anchor of a block
    last = pages.agg(F.max("part")).first()[0] or 0
    visits = blocks.join(windows, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last))))
    found = _first(search(pages, visits, rounds, negatives, False), negatives)
    ids = blocks.select("block", "ids").mapInArrow(_anchor_ids, "block long, slot int, anchor_id long")
    return (found.select("block", "slot", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(top, ["block", "slot", "w"]).join(ids, ["block", "slot"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=moved)


OP12_SQL = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""
