"""Operator 8, exact n-gram Jaccard self-join with set-relation skipping.

A text's set are its distinct word shingles.  Texts with the same set form one
class.  Two classes link when their Jaccard similarity reaches ``num / 100``;
the result is the connected component of each text.

Index lists.  All shingles have one order: those that many texts share (counted
over all texts) come last, ties by hash.  Linked sets share a shingle among the
first ``n - ceil(t n) + 1`` of their order, so these prefixes are indexed:
(shingle, set, size, position).  Lists of one set are dropped.

Skipping inside lists.  Entries lie in blocks by size; a set meets only the blocks
its size can link to.  There the join makes all pairs, and a filter leaves those
whose positions still allow the overlap that the threshold needs.

Skipping by relations between sets.  The smallest set of a list is its leader; a set
and a leader are alike if they share one in ``FAMILY_SHARE`` of the set's prefix and
``FAMILY_LEAST`` shingles, and what this connects is a family.  Sets of a
family are like each other, so they are compared together: overlaps of all pairs
of them come from one matrix product over the shingles they have in common, plus
the few shared rare ones (none is derived from another set's answers).  Sets linked through others need no comparison of
their own: in large families, cut into blocks, only sets outside the largest
component meet the other blocks; between families, lists are searched only for
pairs of different components.

Sets are held as 64-bit shingle hashes and named by 64-bit digests.

Defined results: a null text, or one without words, has the empty set, no links
and its own id as component; fewer words than the shingle length make one
shingle; repeated rows are copies like any others; a row with a null id links with
nothing and has a null component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, free_shuffles, likely, lower_bytes, pieces, saved, scratch, table, texts_of, tidy
from .components import components

#: Shingles counted this often in one task enter the global count.
LOCAL_COUNT = 4
#: Shingles a task holds for that count at a time.
CHUNK = 1_000_000
#: At most this many shingles are sent out as frequent ones (8 MB).
MOST_FREQUENT = 1 << 20
#: A set and a leader are alike if they share one in so many of the set's prefix shingles,
#: and at least so many (or all): one shingle in common joins short sets that are not alike.
FAMILY_SHARE, FAMILY_LEAST = 8, 3
#: Shingles and sets of a family that one task compares with each other.
BLOCK_SHINGLES, BLOCK_SETS = 1_000_000, 1000
#: Parts of the list of a shingle counted 2 ** SPLIT_CLASS times or more.
PARTS, SPLIT_CLASS = 64, 6
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    import xxhash
    words = lower_bytes(text).split()  # exactly the ASCII white space of the contract
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    v = np.zeros(n, np.uint64)
    for k in range(width):
        v = (v ^ h[k:k + n]) * _MIX
        v ^= v >> np.uint64(29)
    return np.unique(v)


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True)


def prefix_length(n, num: int):
    """Shingles of a set of ``n`` that must be indexed for similarity ``num`` in 100."""
    return n + (-num * n) // 100 + 1


def describe(docs: DataFrame, text: str, row_id: str, width: int) -> DataFrame:
    """Rows (id, n, sid) of all texts, and rows (token, count) of shingles frequent in a task."""
    names = ["id", "n", "sid", "token", "count"]

    def counted(arrays, counts, least):
        s, at = np.unique(np.concatenate(arrays), return_inverse=True)
        c = np.bincount(at, np.concatenate(counts) if counts else None, len(s)).astype(np.int64)
        return s[c >= least], c[c >= least]

    def run(batches):
        held, size = [], 0  # whole sets, up to CHUNK shingles
        tokens, counts = [], []  # shingles met twice or more in a chunk
        for b in pieces(batches, "text", 2 << 20):
            n, sid = [], []
            for t in texts_of(b, "text"):
                s = shingles(t, width)
                n.append(len(s))
                sid.append(set_id(s))
                held.append(s)
                size += len(s)
                if size > CHUNK:
                    s, c = counted(held, None, 2)
                    tokens.append(s)
                    counts.append(c)
                    held, size = [], 0
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), none, none], names)
        if held:
            s, c = counted(held, None, 2)
            tokens.append(s)
            counts.append(c)
        if tokens:
            s, c = counted(tokens, counts, LOCAL_COUNT)
            none = pa.nulls(len(s), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(s.view(np.int64)), pa.array(c)], names)

    slim = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(tidy(run), "id long, n long, sid long, token long, count long")


def frequent_order(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles (sorted) and the class of each, its count's power of two.

    Those of the highest classes that fit ``MOST_FREQUENT`` shingles together are
    told apart; all others count as class 0, the rarest.
    """
    counts = (described.where("token is not null").groupBy("token").agg(F.sum("count").alias("c"))
              .select("token", F.floor(F.log2(F.col("c").cast("double"))).cast("int").alias("class")))
    sizes = {r["class"]: r["count"] for r in counts.groupBy("class").count().collect()}
    least, held = 64, 0
    for c in sorted(sizes, reverse=True):
        held += sizes[c]
        if held > MOST_FREQUENT:
            break
        least = c
    got = counts.where(F.col("class") >= least).toArrow()
    tokens = got.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], got.column("class").to_numpy().astype(np.uint8)[order]


def prefix_index(docs: DataFrame, order: tuple[np.ndarray, np.ndarray], text: str, width: int, num: int) -> DataFrame:
    """Postings (token, part, sid, n, pos) of the prefixes of all sets.

    ``part`` splits the lists of frequent shingles; it is -1 for the others.
    """
    frequent, classes = order

    def run(batches):
        done: set[int] = set()
        for b in pieces(batches, "text", 2 << 20):
            cols = [[], [], [], [], []]
            for t in texts_of(b, "text"):
                s = shingles(t, width)
                sid = set_id(s)
                if not len(s) or sid in done:
                    continue
                if len(done) < 200_000:  # saves time only; repeated postings are the same row
                    done.add(sid)
                rank = np.zeros(len(s), np.uint8)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    rank = np.where(frequent[at] == s, classes[at], 0).astype(np.uint8)
                    by = np.argsort(rank, kind="stable")
                    s, rank = s[by], rank[by]
                p = prefix_length(len(s), num)
                cols[0].append(s[:p])
                cols[1].append(np.where(rank[:p] >= SPLIT_CLASS, sid % PARTS, -1).astype(np.int32))
                cols[2].append(np.full(p, sid, np.int64))
                cols[3].append(np.full(p, len(s), np.int32))
                cols[4].append(np.arange(p, dtype=np.int32))
            if cols[0]:
                made = [np.concatenate(c) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(made[0].view(np.int64)), *map(pa.array, made[1:])],
                                                 ["token", "part", "sid", "n", "pos"])

    return docs.select(F.col(text).alias("text")).mapInArrow(tidy(run), "token long, part int, sid long, n int, pos int")


def shared_lists(postings: DataFrame) -> DataFrame:
    """(token, sid, n, pos, leader) of all lists with two sets or more.

    Postings move once.  Lists of frequent shingles arrive in parts; their leader is
    the smallest of the parts' leaders.
    """
    part = Window.partitionBy("token", "part")
    local = (postings.repartition("token", "part").dropDuplicates(["token", "part", "sid"])
             .withColumns({"leader": F.min("sid").over(part), "last": F.max("sid").over(part)})
             .where((F.col("leader") < F.col("last")) | (F.col("part") >= 0)).drop("last"))
    local = saved(local, "shared")
    often = local.where("part >= 0")
    leaders = (often.groupBy("token").agg(F.min("sid").alias("first"), F.max("sid").alias("last")).where("first < last")
               .select("token", F.col("first").alias("leader")))
    columns = ["token", "sid", "n", "pos", "leader"]
    out = saved(local.where("part < 0").select(*columns).unionAll(often.drop("leader").join(leaders, "token").select(*columns)), "shared")
    discard(local)
    free_shuffles(postings.sparkSession)
    return out


def fetch_sets(docs: DataFrame, wanted: DataFrame, text: str, row_id: str, width: int) -> DataFrame:
    """(sid, s) of the sets in ``wanted`` (sid, id): ``s`` holds the hashes, eight bytes each.

    Rows that repeat an id give a set once for each equal text.
    """
    def run(batches):
        for b in pieces(batches, "text", 2 << 20):
            made = [shingles(t, width) for t in texts_of(b, "text")]
            right = [set_id(s) == sid for s, sid in zip(made, b.column("sid").to_pylist())]
            out = pa.RecordBatch.from_arrays([b.column("sid"), pa.array([s.tobytes() for s in made], pa.binary())], ["sid", "s"])
            yield out.filter(pa.array(right))

    texts = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"))
    texts = likely(texts, "id", wanted.select("id"))
    return texts.join(wanted, "id").select("sid", "text").mapInArrow(tidy(run), "sid long, s binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, as a matrix."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    count = np.diff(np.append(first, len(token)))
    out = np.zeros((m, m), np.float32)
    often = np.flatnonzero(count > max(8, m // 16))  # shingles in common: a matrix product, some at a time
    for k in range(0, len(often), 1024):
        part = often[k:k + 1024]
        grid = np.zeros((m, len(part)), np.float32)
        for j, g in enumerate(part):
            grid[row[first[g]:first[g] + count[g]], j] = 1
        out += grid @ grid.T
    rare = (count > 1) & (count <= max(8, m // 16))
    flat = out.reshape(-1)
    for c in np.unique(count[rare]):  # rare ones: the pairs of each list, lists of one length at a time
        lists = row[first[rare & (count == c)][:, None] + np.arange(c)]
        i, j = np.triu_indices(c, 1)
        for k in range(0, len(lists), max(1, 2_000_000 // len(i))):
            part = lists[k:k + max(1, 2_000_000 // len(i))]
            a, b = part[:, i].ravel(), part[:, j].ravel()
            flat += np.bincount(a * m + b, minlength=m * m).astype(np.float32)
            flat += np.bincount(b * m + a, minlength=m * m).astype(np.float32)
    return out


def link_sets(sids: np.ndarray, sets: list[np.ndarray], num: int) -> list[tuple[int, int]]:
    """Edges that connect the sets linked directly or through each other: a star for each component."""
    size = np.array([len(s) for s in sets], np.int64)
    shared = np.rint(overlaps(sets)).astype(np.int64)
    linked = 100 * shared >= num * (size[:, None] + size[None, :] - shared)
    np.fill_diagonal(linked, False)
    label = np.full(len(sets), -1)
    edges = []
    for start in np.argsort(sids, kind="stable"):
        if label[start] >= 0:
            continue
        label[start] = start
        todo = [start]
        while todo:
            near = np.flatnonzero(linked[todo.pop()] & (label < 0))
            label[near] = start
            todo += near.tolist()
            edges += [(int(sids[x]), int(sids[start])) for x in near]
    return edges


def _edges_of_groups(members: DataFrame, keys: list[str], num: int) -> DataFrame:
    """Edges (a, b) among the sets of each group; ``members`` has the keys, sid and s."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("sid")
        got = link_sets(pdf["sid"].to_numpy(), [np.frombuffer(s, np.uint64) for s in pdf["s"]], num)
        return pd.DataFrame(got, columns=["a", "b"], dtype="int64")

    return members.select(*keys, "sid", "s").groupBy(*keys).applyInPandas(run, "a long, b long")


def family_edges(members: DataFrame, sets: DataFrame, num: int, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Edges that connect all linked sets of each family; ``members`` is (family, sid, n).

    A family of more than ``block_shingles``, or ``BLOCK_SETS`` sets, is cut into blocks by hash, each with
    the family's leader.  Within a block everything is compared.  Across blocks,
    sets of the family's largest component need no comparison with each other, so
    only the other sets, again in blocks, meet every block.
    """
    total = members.groupBy("family").agg(F.sum("n").alias("total"), F.count("*").alias("sets")).where("sets > 1")
    blocks = F.ceil(F.greatest(F.col("total") / block_shingles, F.col("sets") / BLOCK_SETS)).cast("int")
    placed = (members.join(total, "family").withColumn("blocks", blocks)
              .withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
              .select("family", "sid", "blocks", "block"))
    placed = saved(placed, "families")
    hub = placed.where("blocks > 1 and sid = family").select("family", "sid", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    first = placed.select("family", "sid", "block").unionAll(hub.select("family", "sid", "block"))
    edges = saved(_edges_of_groups(first.join(sets, "sid"), ["family", "block"], num), "links")
    if not placed.where("blocks > 1").limit(1).count():
        discard(placed)
        return edges
    # across blocks
    large = placed.where("blocks > 1")
    root = components(edges).select(F.col("node").alias("sid"), "root")
    large = saved(large.join(root, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "families")
    main = large.groupBy("family", "root").count().groupBy("family").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    rest = large.join(main, "family").where("root <> main").select("family", "sid", "blocks", F.col("block").alias("own"))
    meets = rest.select("family", "sid", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    tasks = meets.select("family", "own", "block").distinct()
    theirs = large.select("family", "sid", "block").join(tasks, ["family", "block"])
    pairs = meets.select("family", "own", "block", "sid").unionAll(theirs.select("family", "own", "block", "sid")).distinct()
    across = saved(_edges_of_groups(pairs.join(sets, "sid"), ["family", "own", "block"], num), "links")
    return edges.unionAll(across)


def cross_pairs(shared: DataFrame, family: DataFrame, root: DataFrame, num: int) -> DataFrame:
    """Pairs (x, y) of different components that the lists allow and no family has compared.

    In each list, sets of its most frequent component are met only by the others.
    A pair is met in every list that it shares, so the shared part of the prefixes
    is known; with all that can follow behind a prefix it must reach the overlap
    that the threshold needs.
    """
    known = (shared.drop("leader").join(family, "sid").join(root, "sid", "left")
             .withColumn("root", F.coalesce("root", "sid")))
    known = saved(known, "lists")
    main = (known.groupBy("token", "root").count().groupBy("token")
            .agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("k")).where("k > 1"))
    block = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / num)) + 1e-9).cast("int")
    alive = saved(known.join(main.drop("k"), "token").withColumn("block", block), "lists")
    x = alive.where("root <> main").select(
        "token", *[F.col(c).alias(f"x_{c}") for c in ("sid", "n", "pos", "family", "root")],
        F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"))
    y = alive.select("token", "block", "sid", "n", "pos", "family", "root", "main")
    most = F.least("x_pos", "pos") + 1 + F.least(F.col("x_n") - F.col("x_pos") - 1, F.col("n") - F.col("pos") - 1)
    open_pair = ((F.col("x_root") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("x_sid") < F.col("sid")))
                 & (F.col("x_family") != F.col("family")) & (F.col("x_family") != F.col("sid")) & (F.col("family") != F.col("x_sid"))
                 & (100 * F.least("x_n", "n") >= num * F.greatest("x_n", "n"))
                 & ((100 + num) * most >= num * (F.col("x_n") + F.col("n"))))
    behind = lambda n: F.ceil(F.col(n) * num / 100) - 1
    small, large = F.least("x_n", "n"), F.greatest("x_n", "n")
    found = (x.join(y, ["token", "block"]).where(open_pair)
             .groupBy(F.least("x_sid", "sid").alias("x"), F.greatest("x_sid", "sid").alias("y"), small.alias("n"), large.alias("m"))
             .agg(F.count("*").alias("c"))
             .where((100 + num) * (F.col("c") + behind("m")) >= num * (F.col("n") + F.col("m"))).select("x", "y"))
    out = saved(found, "pairs")
    discard(known, alive)
    return out


def verify(pairs: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """The pairs whose similarity reaches the threshold, as edges (a, b)."""
    both = (pairs.join(sets.select(F.col("sid").alias("x"), F.col("s").alias("xs")), "x")
            .join(sets.select(F.col("sid").alias("y"), F.col("s").alias("ys")), "y"))

    @F.pandas_udf("boolean")
    def reach(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(xs, ys):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= num * (len(a) + len(b) - both))
        return pd.Series(out)

    return both.where(reach("xs", "ys")).select(F.col("x").alias("a"), F.col("y").alias("b"))


def similar_groups(docs: DataFrame, text: str = "text", row_id: str = "doc_id", width: int = 5, num: int = 80,
                   block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, n_shingles, class, component_id) of every row; ``class`` names the shingle set.

    ``component_id`` is the smallest id reachable over links and copies, the row's
    own included.  The result is a written table; what it is made from goes.
    """
    with scratch():
        return saved(_groups(docs, text, row_id, width, num, block_shingles), "groups", keep=True)


def _groups(docs: DataFrame, text: str, row_id: str, width: int, num: int, block_shingles: int) -> DataFrame:
    described = saved(describe(docs, text, row_id, width), "sets")
    everything = described.where("token is null").select("id", "n", "sid")
    rows = everything.where("id is not null")
    docs = docs.where(F.col(row_id).isNotNull())
    order = frequent_order(described)
    shared = shared_lists(prefix_index(docs, order, text, width, num))

    counted = shared.where("sid <> leader").groupBy("sid", "n", "leader").agg(F.count("*").alias("c"))
    prefix = F.col("n") - F.ceil(F.col("n") * num / 100) + 1
    alike = (FAMILY_SHARE * F.col("c") >= prefix) & (F.col("c") >= F.least(prefix, F.lit(FAMILY_LEAST)))
    steps = counted.where(alike).select(F.col("sid").alias("a"), F.col("leader").alias("b"))
    grouped = saved(components(steps).select(F.col("node").alias("sid"), F.col("root").alias("family")), "families")
    own = shared.groupBy("sid").agg(F.first("n").alias("n"))
    family = own.join(grouped, "sid", "left").select("sid", F.coalesce("family", "sid").alias("family"))

    first = rows.groupBy("sid").agg(F.min("id").alias("id"))  # a text with each set
    fetch = lambda sids: fetch_sets(docs, saved(first.join(sids, "sid", "left_semi"), "wanted"), text, row_id, width)
    everyone = saved(grouped.join(own, "sid").select("family", "sid", "n"), "members")
    # hashes do not compress: made from the texts for each use, not written
    near = saved(family_edges(everyone, fetch(everyone.select("sid")), num, block_shingles), "links")
    free_shuffles(docs.sparkSession)
    root = components(near).select(F.col("node").alias("sid"), "root")
    pairs = cross_pairs(shared, family, root, num)
    discard(shared)
    free_shuffles(docs.sparkSession)
    apart = saved(fetch(pairs.select(F.col("x").alias("sid")).unionAll(pairs.select("y")).distinct()), "hashes")
    edges = near.unionAll(verify(pairs, apart, num))
    root = saved(components(edges), "roots")
    smallest = (rows.groupBy("sid").agg(F.min("id").alias("least")).join(root.withColumnRenamed("node", "sid"), "sid", "left")
                .withColumn("root", F.coalesce("root", "sid")))
    smallest = saved(smallest, "classes")
    least = smallest.groupBy("root").agg(F.min("least").alias("component_id"))
    named = smallest.join(least, "root").select("sid", "component_id")
    empty = everything.where("n = 0 or id is null").select("id", "n", "sid", F.col("id").alias("component_id"))
    full = rows.where("n > 0").join(named, "sid", "left").select("id", "n", "sid", "component_id")
    return empty.unionAll(full).select("id", F.col("n").alias("n_shingles"), F.col("sid").alias("class"), "component_id")


def keep_one_of_each(docs: DataFrame, text: str = "text", row_id: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the texts that are similar to one that stays: of each component, its smallest id.

    Rows that repeat an id stay or go together.  Texts without words stay, as do
    rows with a null id.
    """
    groups = similar_groups(docs, text, row_id, **how)
    go = groups.where("id <> component_id").select(F.col("id").alias("gone")).distinct()
    return docs.join(go, F.col(row_id).cast("long") == F.col("gone"), "left_anti").select(*docs.columns)


def op8_jaccard_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_groups(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
