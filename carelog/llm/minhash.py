"""Operator 13, near-duplicate removal by b-bit MinHash.

A text's set are its distinct word shingles; texts with the same set form one class.
One pass takes ``HASHES`` minima of every set.  Rows of ``BAND`` whole minima make the
band keys that bring candidates together; of each minimum only the ``BITS`` low bits
are kept, packed into longs.  The similarity of a candidate pair is estimated from its
packed signatures: positions that differ are counted by folding the xor of two longs
onto one bit a position and counting bits, and the share that agrees by chance,
2^-BITS, is taken out.  Pairs whose estimate lies ``SIGMAS`` standard errors below the
threshold go; the others are confirmed on the full sets.

Pairs of a bucket are not all made.  First every class meets only the leaders (smallest
numbers) of its buckets; what pairs that signatures call similar connect is a family.  The sets of a family are confirmed together, in
blocks inside tasks that return links enough to connect what is linked.  Then, in
buckets that still hold several components, classes outside the bucket's largest
component meet those of other families, in blocks of ``BLOCK`` signatures inside a
task; a row is made only for a pair of different components and families whose
estimate is high enough.

A pair at the threshold shares no band with probability (1 - t^BAND)^bands, 4e-7 at
0.85, and is lost by its estimate with probability 3e-7; confirmed links are exact.

Defined results: a null text, or one without words, has the empty set, no links and
its own id as component; fewer words than the shingle length make one shingle;
repeated rows are copies like any others; a row with a null id links with nothing,
has a null component and is kept; rows that repeat an id are kept or go by the id.
Sets are held as 64-bit shingle hashes and named by 128-bit digests.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import likely, pieces, saved, scratch, table, texts_of, tidy
from .components import components
from .jaccard_join import family_edges, shingles

#: Minima of a set, minima of a band, bits kept of each, and bits of a class number.
HASHES, BAND, BITS, NUMBER_BITS = 128, 5, 4, 57
BANDS, LONGS = HASHES // BAND, HASHES * BITS // 64
#: Standard errors that an estimate may fall short of the threshold.
SIGMAS = 5
#: Signatures that a task compares with each other at a time.
BLOCK = 2048
#: Classes of a task whose signatures are remembered: saves time only.
REMEMBERED = 50_000
_random = np.random.default_rng(13)
_FACTOR = _random.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_SEED = _random.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW_BITS = sum(1 << k for k in range(0, 64, BITS))  # the lowest bit of each position


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of the set under each hash."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), 1024):
        v = _FACTOR[:, None] * h[None, k:k + 1024]
        v += _SHIFT[:, None]
        np.minimum(out, v.min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    v = _SEED.copy()
    for k in range(BAND):
        v = (v ^ m[k:BANDS * BAND:BAND].astype(np.uint64)) * _MIX
        v ^= v >> np.uint64(29)
    return v.view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """The low bits of the minima, as ``LONGS`` longs."""
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(LONGS, 64 // BITS)
    return np.bitwise_or.reduce(low << np.arange(0, 64, BITS, dtype=np.uint64), axis=1).view(np.int64)


def estimate(differing):
    """Similarity from the number of positions that differ, without agreement by chance."""
    chance = 2.0 ** -BITS
    return (1 - differing / HASHES - chance) / (1 - chance)


def most_differing(num: int) -> int:
    """Positions in which two sets of similarity ``num`` / 100 differ, with ``SIGMAS`` standard errors more."""
    p = (1 - num / 100) * (1 - 2.0 ** -BITS)
    return min(HASHES, math.floor(HASHES * p + SIGMAS * math.sqrt(HASHES * p * (1 - p))))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions that differ, for all pairs of two arrays of packed signatures."""
    out = np.zeros((len(a), len(b)), np.int16)
    for k in range(LONGS):
        z = a[:, k, None] ^ b[None, :, k]
        step = BITS // 2
        while step:
            z |= z >> np.uint64(step)
            step //= 2
        out += np.bitwise_count(z & np.uint64(_LOW_BITS))
    return out


def differing_columns(x: str, y: str):
    """The same count for two array columns of packed signatures, as a column."""
    def fold(k):
        z = F.col(x)[k].bitwiseXOR(F.col(y)[k])
        step = BITS // 2
        while step:
            z = z.bitwiseOR(F.shiftrightunsigned(z, step))
            step //= 2
        return F.bit_count(z.bitwiseAND(F.lit(_LOW_BITS)))

    return sum((fold(k) for k in range(1, LONGS)), fold(0))


def digest(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes()).digest()


def signatures(docs: DataFrame, text: str, row_id: str, width: int) -> DataFrame:
    """(row, id, n, digest, bands, sig) of every text; bands and sig are null for empty sets."""
    names = ["row", "id", "n", "digest", "bands", "sig"]

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        met: dict[bytes, tuple] = {}
        for b in pieces(batches, "text", 2 << 20):
            rows = [[], [], [], []]
            for t in texts_of(b, "text"):
                s = shingles(t, width)
                d = digest(s)
                if not len(s):
                    found = None, None
                elif d in met:
                    found = met[d]
                else:
                    m = minima(s)
                    found = band_keys(m), packed(m)
                    if len(met) < REMEMBERED:
                        met[d] = found
                for c, v in zip(rows, (len(s), d, *found)):
                    c.append(v)
            row = pa.array(range(number, number + b.num_rows), pa.int64())
            number += b.num_rows
            yield pa.RecordBatch.from_arrays([row, b.column("id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()),
                                              pa.array(rows[2], pa.list_(pa.int64())), pa.array(rows[3], pa.list_(pa.int64()))], names)

    slim = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(tidy(run), "row long, id long, n long, digest binary, bands array<long>, sig array<long>")


def buckets(reps: DataFrame) -> DataFrame:
    """(key, cls, leader) of all buckets of two classes or more."""
    postings = reps.select("cls", F.explode("bands").alias("key"))
    ends = postings.groupBy("key").agg(F.min("cls").alias("leader"), F.max("cls").alias("last")).where("leader < last").drop("last")
    return postings.join(ends, "key").select("key", "cls", "leader")


def families(shared: DataFrame, reps: DataFrame, num: int) -> DataFrame:
    """(cls, family): what is connected by classes and leaders of their buckets that signatures call similar.

    A family is named by its smallest class; a class without a similar leader or member is in none.
    """
    pairs = shared.where("cls <> leader").select(F.col("cls").alias("x"), F.col("leader").alias("y")).distinct()
    steps = similar(pairs, reps, num).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return components(steps).select(F.col("node").alias("cls"), F.col("root").alias("family"))


def similar(pairs: DataFrame, reps: DataFrame, num: int) -> DataFrame:
    """The pairs (x, y) whose estimated similarity may reach the threshold."""
    sig = lambda c: reps.select(F.col("cls").alias(c), F.col("sig").alias(f"sig_{c}"))
    both = pairs.join(sig("x"), "x").join(sig("y"), "y")
    return both.where(differing_columns("sig_x", "sig_y") <= most_differing(num)).select("x", "y")


def fetch_sets(docs: DataFrame, wanted: DataFrame, text: str, row_id: str, width: int) -> DataFrame:
    """(cls, s) of the classes in ``wanted`` (cls, id, digest): ``s`` holds the hashes, eight bytes each."""
    def run(batches):
        for b in pieces(batches, "text", 2 << 20):
            made = [shingles(t, width) for t in texts_of(b, "text")]
            right = [digest(s) == d for s, d in zip(made, b.column("digest").to_pylist())]
            out = pa.RecordBatch.from_arrays([b.column("cls"), pa.array([s.tobytes() for s in made], pa.binary())], ["cls", "s"])
            yield out.filter(pa.array(right))

    texts = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"))
    texts = likely(texts, "id", wanted.select("id"))
    return texts.join(wanted, "id").select("cls", "digest", "text").mapInArrow(tidy(run), "cls long, s binary")


def confirm(pairs: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """The pairs linked by their full sets, as edges (a, b)."""
    @F.pandas_udf("boolean")
    def reach(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(xs, ys):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= num * max(len(a), len(b)) else 0
            out.append(100 * both >= num * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    of = lambda c: sets.select(F.col("cls").alias(c), F.col("s").alias(f"s_{c}"))
    return pairs.join(of("x"), "x").join(of("y"), "y").where(reach("s_x", "s_y")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def open_pairs(shared: DataFrame, root: DataFrame, family: DataFrame, reps: DataFrame, num: int, block: int) -> DataFrame:
    """Pairs (x, y) of different components and families that share a bucket and whose estimate is high enough.

    In each bucket the classes outside its largest component (``rest``) meet all
    others; both sides are cut into blocks by hash, and a task takes two blocks.
    """
    known = shared.select("key", "cls").join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    several = known.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
    members = saved(known.join(several, "key"), "open")
    counted = members.groupBy("key", "root").agg(F.count("*").alias("k"))
    main = counted.groupBy("key").agg(F.max_by("root", F.struct("k", -F.col("root"))).alias("main"), F.sum("k").alias("k"),
                                      (F.sum("k") - F.max("k")).alias("others"))
    part = lambda size: F.ceil(F.col(size) / block).cast("int")
    placed = (members.join(main, "key").join(family, "cls", "left").withColumn("family", F.coalesce("family", "cls"))
              .join(reps.select("cls", "n", "sig"), "cls")
              .withColumns({"own": F.pmod(F.xxhash64("cls"), part("k")).cast("int"), "turn": F.pmod(F.xxhash64("cls", F.lit(1)), part("others")).cast("int")}))
    what = ["key", "own", "turn", "rest", "cls", "root", "family", "n", "sig"]
    rest = (placed.where("root <> main").withColumn("own", F.explode(F.sequence(F.lit(0), part("k") - 1)))
            .withColumn("rest", F.lit(True)).select(*what))
    every = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), part("others") - 1))).withColumn("rest", F.lit(False)).select(*what)
    group = ["key", "own", "turn"]
    dealt = rest.unionAll(every).repartition(*group).sortWithinPartitions(*group)
    limit = most_differing(num)

    def compare(t: dict) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.flatnonzero(t["rest"]), np.flatnonzero(~t["rest"])
        made = []
        for k in range(0, len(x), BLOCK):
            i = x[k:k + BLOCK]
            for m in range(0, len(y), BLOCK):
                j = y[m:m + BLOCK]
                fits = t["root"][i][:, None] != t["root"][j][None, :]
                ni, nj = t["n"][i][:, None], t["n"][j][None, :]
                fits &= 100 * np.minimum(ni, nj) >= num * np.maximum(ni, nj)
                fits &= t["family"][i][:, None] != t["family"][j][None, :]
                if not fits.any():
                    continue
                fits &= differing(t["sig"][i], t["sig"][j]) <= limit
                a, b = np.nonzero(fits)
                made.append((t["cls"][i][a], t["cls"][j][b]))
        if not made:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (np.concatenate(v) for v in zip(*made))
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches):
        def arrays(b):
            out = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "own", "turn", "rest", "cls", "root", "family", "n")}
            out["sig"] = np.asarray(b.column("sig").flatten()).view(np.uint64).reshape(-1, LONGS)
            return out

        def done(t, upto):
            cut = np.flatnonzero((np.diff(t["key"][:upto]) != 0) | (np.diff(t["own"][:upto]) != 0) | (np.diff(t["turn"][:upto]) != 0)) + 1
            xs, ys = [], []
            for a, z in zip([0, *cut], [*cut, upto]):
                x, y = compare({c: v[a:z] for c, v in t.items()})
                xs.append(x)
                ys.append(y)
            x, y = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            new = arrays(b)
            held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in held}
            last = np.flatnonzero((held["key"] != held["key"][-1]) | (held["own"] != held["own"][-1]) | (held["turn"] != held["turn"][-1]))
            if len(last):
                upto = int(last[-1]) + 1
                yield from done(held, upto)
                held = {c: v[upto:] for c, v in held.items()}
        if held is not None:
            yield from done(held, len(held["key"]))

    return dealt.mapInArrow(tidy(run), "x long, y long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", row_id: str = "doc_id", width: int = 3, num: int = 85, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Rows link when 100 * intersection >= ``num`` * union of their sets of
    ``width``-word shingles; ``component_id`` is the smallest id reachable, the row's
    own included, and rows with another id than that are not kept.
    """
    with scratch():
        return saved(_components(docs, text, row_id, width, num, block), "near", keep=True)


def _components(docs: DataFrame, text: str, row_id: str, width: int, num: int, block: int) -> DataFrame:
    signed = saved(signatures(docs, text, row_id, width), "signed")
    rows = signed.where("n > 0 and id is not null")
    # the first row of a class stands for it
    classes = saved(rows.groupBy("digest").agg(F.min("id").alias("id"), F.min("row").alias("row")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    reps = saved(rows.join(classes.select("row", "cls"), "row").select("cls", "id", "digest", "n", "bands", "sig"), "reps")
    repeated = rows.groupBy("id", "digest").count().where("count > 1").limit(1).count()  # whole rows that repeat
    docs = docs.where(F.col(row_id).isNotNull())

    def fetched(wanted):
        sets = fetch_sets(docs, saved(reps.select("cls", "id", "digest").join(wanted, "cls", "left_semi"), "wanted"), text, row_id, width)
        return saved(sets.dropDuplicates(["cls"]) if repeated else sets, "hashes")

    shared = saved(buckets(reps), "buckets")
    family = saved(families(shared, reps, num), "families")
    members = saved(family.join(reps.select("cls", "n"), "cls").select("family", F.col("cls").alias("sid"), "n"), "members")
    edges = saved(family_edges(members, fetched(family.select("cls")).withColumnRenamed("cls", "sid"), num), "links")
    root = saved(components(edges).select(F.col("node").alias("cls"), "root"), "roots")
    more = saved(open_pairs(shared, root, family, reps, num, block), "pairs")
    if more.limit(1).count():
        sets = fetched(more.select(F.col("x").alias("cls")).unionAll(more.select("y")).distinct())
        root = components(edges.unionAll(confirm(more, sets, num))).select(F.col("node").alias("cls"), "root")
    known = saved(classes.join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "classes")
    least = known.groupBy("root").agg(F.min("id").alias("component_id"))
    named = known.join(least, "root").select("digest", "component_id")
    rest = signed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    full = rows.select("id", "n", "digest").join(named, "digest").select("id", "n", "component_id")
    return rest.unionAll(full).select("id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op13_minhash_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).withColumnRenamed("id", "doc_id")
