"""Operator 3, sharding by histogram sort.

Rows are ordered by (hash of the text, id), so equal texts are neighbours and
one very frequent text can still be split.  Shards are ranges of that order with
near-equal bytes (law ``bytes``).  The splitters come from histograms:

1. every splitter has a bracket of the key space, at first all of it;
2. probe keys are laid evenly into each bracket, and one job counts exactly the
   bytes and rows below every probe, summed over all partitions;
3. each bracket shrinks to the two probes around its target, until the bytes
   below one of its ends differ from the target by no more than the tolerance,
   or no key lies between the ends.

Then rows move once.  Between the shard splitters lie further, loosely placed
ones: their cells of about ``cell_rows`` rows are what is exchanged and sorted,
so no task holds a whole shard.  The histogram knows the rows below every cell,
which makes the slot numbers gapless without another pass.

Probes are at most ``PROBES`` per open bracket; brackets are as many as cells,
whose number is the row count over ``cell_rows``.

Defined results: a null text has size 1 and the CRC of the empty text.  Rows that
agree in text and id are ordered among themselves by their remaining hash only
and never split by a splitter; ids may repeat or be null (null counts as the
smallest long).  An empty table gives an empty result.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, free_name, saved, table

PROBES = 24
_LOW = -(1 << 63)
_SPACE = 1 << 64


def _key(n: int) -> tuple[int, int]:
    """The (hash, id) pair of a point of the joined 128-bit key space."""
    return n // _SPACE + _LOW, n % _SPACE + _LOW


class Histogram:
    """Exact bytes and rows below any key, one job for each list of keys."""

    def __init__(self, keys: DataFrame):
        self.keys, self.below = keys, {0: (0, 0)}

    def count(self, probes: list[int]) -> None:
        probes = sorted(set(probes) - self.below.keys())
        if not probes:
            return
        pairs = [_key(p) for p in probes]
        # each row is counted at the first probe above it; sums run up from there
        cell = bucket(F.col("h"), F.col("i"), pairs)
        counted = (self.keys.groupBy(cell.alias("cell"))
                   .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect())
        at = {r["cell"]: (r["bytes"], r["rows"]) for r in counted}
        size = n = 0
        for k, p in enumerate(probes):
            more = at.get(k, (0, 0))
            size, n = size + more[0], n + more[1]
            self.below[p] = (size, n)

    def refine(self, targets: list[tuple[int, float]], top: int) -> list[int]:
        """A key for each (target bytes, tolerance), with bytes below it as near as keys allow."""
        brackets = [[0, top] for _ in targets]
        while True:
            probes = []
            for b, (target, tolerance) in zip(brackets, targets):
                if not self._settled(b, target, tolerance):
                    width = b[1] - b[0]
                    n = min(PROBES, width - 1)
                    probes += [b[0] + width * k // (n + 1) for k in range(1, n + 1)]
            if not probes:
                return [min(b, key=lambda e, t=t: (abs(self.below[e][0] - t), e)) for b, (t, _) in zip(brackets, targets)]
            self.count(probes)
            known = sorted(self.below)
            sizes = [self.below[k][0] for k in known]
            for b, (target, _) in zip(brackets, targets):
                at = bisect.bisect_right(sizes, target) - 1
                b[0] = known[at]
                b[1] = known[min(at + 1, len(known) - 1)]

    def _settled(self, b: list[int], target: int, tolerance: float) -> bool:
        ends = [self.below[e] for e in b]
        return (b[1] - b[0] <= 1 or any(abs(e[0] - target) <= tolerance for e in ends)
                or ends[1][1] - ends[0][1] <= 0)


def bucket(h: Column, i: Column, pairs: list[tuple[int, int]]) -> Column:
    """Number of the sorted keys that are not above (h, i), by binary search."""
    hi = np.array([p[0] for p in pairs], np.int64)
    lo = np.array([p[1] for p in pairs], np.int64)

    @F.pandas_udf("int")
    def place(h: pd.Series, i: pd.Series) -> pd.Series:
        h, i = h.to_numpy(), i.to_numpy()
        first, last = np.searchsorted(hi, h, "left"), np.searchsorted(hi, h, "right")
        at = first.copy()
        for k in np.unique(first[first < last]):  # rows with the hash of a key: compare ids
            rows = np.flatnonzero((first == k) & (first < last))
            at[rows] = k + np.searchsorted(lo[k:last[rows[0]]], i[rows], "right")
        return pd.Series(at.astype(np.int32))

    return place(h, i)


def shard(docs: DataFrame, shards: int = 8, text: str = "text", row_id: str = "doc_id",
          tolerance: float = 0.001, cell_rows: int = 200_000) -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot; rows of a shard in key order.

    ``tolerance`` is the allowed difference of the bytes below a splitter from its
    target, as a share of a shard.
    """
    names = {c: free_name(docs, c) for c in ("size", "text_crc32", "shard", "slot", "h", "i")}
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keyed = docs.withColumns({
        names["size"]: F.octet_length(t).cast("long") + F.lit(1),
        names["text_crc32"]: F.crc32(t),
        names["h"]: F.xxhash64(t),
        names["i"]: F.coalesce(F.col(row_id).cast("long"), F.lit(_LOW)),
    })
    slim = saved(keyed.select(F.col(names["h"]).alias("h"), F.col(names["i"]).alias("i"),
                              F.col(names["size"]).alias("size")), "keys")
    edges = splitters(slim, shards, tolerance, cell_rows)
    discard(slim)
    pairs = [_key(k) for k, _, _ in edges[1:]]
    cell = free_name(keyed, "cell")
    placed = keyed.withColumn(cell, bucket(F.col(names["h"]), F.col(names["i"]), pairs))
    order = Window.partitionBy(cell).orderBy(names["h"], names["i"], names["size"])
    at = lambda values: F.get(F.lit(values), F.col(cell))
    return (placed.withColumn(names["shard"], at([s for _, s, _ in edges]))
            .withColumn(names["slot"], F.row_number().over(order) - 1 + at([r for _, _, r in edges]))
            .select(*docs.columns, names["size"], names["text_crc32"], names["shard"], names["slot"]))


def splitters(keys: DataFrame, shards: int, tolerance: float, cell_rows: int) -> list[tuple[int, int, int]]:
    """(first key, shard, rows of the shard below it) of every cell, in key order."""
    total = keys.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    size, n = total["b"] or 0, total["n"]
    if not n:
        return [(0, 0, 0)]
    top = _SPACE * _SPACE
    seen = Histogram(keys)
    seen.below[top] = (size, n)
    share = size / shards
    main = seen.refine([(round(share * k), tolerance * share) for k in range(1, shards)], top)
    parts = max(4, -(-n // (shards * cell_rows)))
    fine = seen.refine([(round(share * (k + j / parts)), share / parts / 4)
                        for k in range(shards) for j in range(1, parts)], top)
    starts = [0, *main]
    edges = []
    for key in sorted({0, *main, *fine} - {top}):
        s = max(k for k in range(shards) if starts[k] <= key)
        edges.append((key, s, seen.below[key][1] - seen.below[starts[s]][1]))
    return edges


def op3_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                              F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
