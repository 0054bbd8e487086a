"""Operator 9, removal of repeated byte strings by column-wise suffix sorting.

A byte goes if it lies in a string of ``LENGTH`` bytes (a window) that also starts
somewhere else in the collection.

Alignment.  Every window is assigned to its minimizer: the leftmost of its
``GRAM``-byte grams with the smallest hash.  Equal windows have equal minimizers
at equal places, so only windows of one minimizer hash, at the same distance from
it, need comparison.  Consecutive windows with the same minimizer form a context:
the bytes from the first window's start to the last one's end.

Contexts that occur twice are repeated as a whole; a count of their digests shows
that, and no text moves.  Of the other contexts, those that share their minimizer
with a different context go through the sort.

Sort.  The contexts of many minimizers are the documents of a collection, aligned
at the minimizer.  From the last column to the first, one symbol of every document
is inserted per round: documents are re-sorted, stably, by that symbol, which
turns the suffix order of the column to the right into that of this column, and
the common-prefix lengths of neighbours are updated from those of the round before
(one more where the symbols agree, by the smallest length between them).  A suffix
that shares ``LENGTH`` bytes or more with a neighbour starts a repeated window.
Order, symbols and lengths are read and written strictly from front to back; since
collections are bounded (``BATCH`` documents) they stay in memory, not in files.

Very frequent minimizers.  A minimizer with more than ``GROUP`` contexts is split:
its window starts are cut into narrower ranges, and a range is grouped by all bytes
that its windows have in common.  What is still too frequent is split again, down
to single windows, where the count of equal digests decides.  No task gets more
than a bounded group.

Equal texts are handled once, by a 64-bit hash of the text; two rows with the same
text repeat each other wholly.  Digests that decide have 128 bits.

Passages.  Repeats of some words can be shorter than ``LENGTH`` bytes, so nothing of
them is removed.  On demand a column tells which rows share so many consecutive words
with another row: runs of words are led by their smallest hash of ``LEAD`` words, and
only those whose leader two texts hold are compared, by 64-bit hashes of the run.

Defined results: a null text counts as empty; texts shorter than ``LENGTH`` lose
nothing; repeated rows count as copies of each other; an empty table gives an empty
result.  Kept bytes need not be valid UTF-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, free_name, free_shuffles, pieces, saved, scratch, table, tidy

LENGTH, GRAM = 400, 128
GROUP, BATCH = 512, 4096
WIDTHS = (32, 4, 1)
PASSAGE, LEAD = 50, 16  # words
_SPAN = LENGTH - GRAM  # a minimizer lies at most so far from its window's start
_COLUMNS = _SPAN + LENGTH
_PART = 1 << 22  # bytes of a text that are searched at a time
_PLACE = np.uint64((1 << 24) - 1)  # bits that hold a place in a part
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _data(value: str | None) -> bytes:
    return (value or "").encode("utf-8", "surrogatepass")


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of every GRAM-byte gram, by doubling."""
    h = (b.astype(np.uint64) + np.uint64(1)) * _MIX
    size, factor = 1, 0xD6E8FEB86659FD93
    while size < GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        h ^= h >> np.uint64(32)
        factor = factor * factor % (1 << 64)
        size *= 2
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from running minima inside blocks of w."""
    n = len(x)
    m = -(-n // w) * w
    padded = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def contexts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position) of the minimizer and (first, last) window start of each context."""
    parts = []
    for at in range(0, max(1, len(data) - LENGTH + 1), _PART):
        b = np.frombuffer(data, np.uint8, min(len(data) - at, _PART + LENGTH - 1), at)
        if len(b) < LENGTH:
            break
        h = _gram_hashes(b)
        packed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        low = _sliding_min(packed, _SPAN + 1)
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        last = np.append(first[1:], len(low)) - 1
        pos = (low[first] & _PLACE).astype(np.int64)
        parts.append((h[pos].view(np.int64), pos + at, first + at, last + at))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts))


def find_contexts(docs: DataFrame, text: str) -> DataFrame:
    """(t, h, pos, lo, hi, digest) of all contexts of all texts."""
    def run(batches):
        import xxhash
        for b in pieces(batches, "text", 4 << 20):
            cols = [[], [], [], [], [], []]
            for value in b.column("text").to_pylist():
                data = _data(value)
                if len(data) < LENGTH:
                    continue
                h, pos, lo, hi = contexts(data)
                cols[0].append(np.full(len(h), text_key(data), np.int64))
                for c, x in zip(cols[1:5], (h, pos, lo, hi)):
                    c.append(x)
                # the place of the minimizer in the context is part of the digest
                cols[5] += [xxhash.xxh3_128_digest(data[a:z + LENGTH], seed=p - a)
                            for p, a, z in zip(pos.tolist(), lo.tolist(), hi.tolist())]
            if cols[0]:
                made = [pa.array(np.concatenate(c)) for c in cols[:5]]
                yield pa.RecordBatch.from_arrays([*made, pa.array(cols[5], pa.binary())], ["t", "h", "pos", "lo", "hi", "digest"])

    return docs.select(F.col(text).alias("text")).mapInArrow(tidy(run), "t long, h long, pos long, lo long, hi long, digest binary")


def text_key(data: bytes) -> int:
    return int.from_bytes(hashlib.md5(data).digest()[:8], "little", signed=True)


def repeated_starts(rows: list[tuple[object, int, int, int, bytes]]) -> list[list[tuple[int, int]]]:
    """Runs of repeated window starts of each document of a collection.

    ``rows`` are (group, pos, lo, hi, bytes from lo to hi + LENGTH); rows of a group
    are neighbours.  Runs are (first start, last start).
    """
    m = len(rows)
    grid = np.full((m, _COLUMNS), 256, np.uint16)  # 256: no byte here
    low, high = np.zeros(m, np.int64), np.zeros(m, np.int64)
    group = np.zeros(m, np.int64)
    for k, (g, pos, lo, hi, data) in enumerate(rows):
        at = lo - pos + _SPAN
        grid[k, at:at + len(data)] = np.frombuffer(data, np.uint8)
        low[k], high[k] = at, hi - pos + _SPAN
        group[k] = group[k - 1] + (k > 0 and g != rows[k - 1][0])
    columns = np.ascontiguousarray(grid.T).astype(np.int64)
    order = np.arange(m)
    shared = np.zeros(m, np.int64)  # with the document before it in the order
    key = group * 257
    hits = np.zeros((_COLUMNS, m), bool)
    for c in range(_COLUMNS - 1, -1, -1):
        symbol = key[order] + columns[c][order]
        by = np.argsort(symbol, kind="stable")
        order, symbol = order[by], symbol[by]
        same = np.zeros(m, bool)
        same[1:] = (symbol[1:] == symbol[:-1]) & (columns[c][order[1:]] != 256)
        new = np.zeros(m, np.int64)
        near = np.flatnonzero(same)
        before, here = by[near - 1], by[near]
        step = here - before == 1
        new[near[step]] = shared[here[step]] + 1
        far = ~step
        if far.any():
            cut = np.column_stack([before[far] + 1, here[far] + 1]).ravel()
            new[near[far]] = np.minimum.reduceat(np.append(shared, 0), cut)[::2] + 1
        shared = new
        most = np.maximum(shared, np.append(shared[1:], 0))
        hits[c][order[most >= LENGTH]] = True
    out = []
    for k, (_, pos, _, _, _) in enumerate(rows):
        at = np.flatnonzero(hits[low[k]:high[k] + 1, k])
        cut = np.flatnonzero(np.diff(at) > 1)
        first, last = at[np.append(0, cut + 1)] if len(at) else at, at[np.append(cut, len(at) - 1)] if len(at) else at
        base = low[k] - _SPAN + pos
        out.append([(int(a + base), int(z + base)) for a, z in zip(first, last)])
    return out


def sort_groups(rows: DataFrame) -> DataFrame:
    """Repeated spans (t, a, z) of the contexts in ``rows`` (g, t, pos, lo, hi, bytes), group by group."""
    def run(batches):
        held = []

        def flush(part):
            got = [(t, a, z + LENGTH) for (t, *_), runs in zip(part, repeated_starts([r[1:] for r in part])) for a, z in runs]
            t, a, z = zip(*got) if got else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["t", "a", "z"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("t", "g", "pos", "lo", "hi", "bytes"))):
                if len(held) >= BATCH and held[-1][1] != r[1]:
                    yield flush(held)
                    held = []
                held.append(r)
        if held:
            yield flush(held)

    return (rows.select("t", "g", "pos", "lo", "hi", "bytes").repartition("g").sortWithinPartitions("g")
            .mapInArrow(tidy(run), "t long, a long, z long"))


def fetch_bytes(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """``wanted`` (t, g, pos, lo, hi, k) with the bytes from lo to hi + LENGTH."""
    def keyed(batches):
        for b in pieces(batches, "text"):
            keys = [text_key(_data(v)) for v in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column("text")], ["t", "text"])

    def run(batches):
        for b in pieces(batches, "text"):
            made = [[] for _ in range(7)]
            for t, v, list_ in zip(b.column("t").to_pylist(), b.column("text").to_pylist(), b.column("wanted").to_pylist()):
                data = _data(v)
                for w in list_:
                    row = (t, w["g"], w["pos"], w["lo"], w["hi"], data[w["lo"]:w["hi"] + LENGTH], w["k"])
                    for m, x in zip(made, row):
                        m.append(x)
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(m, x) for m, x in zip(made, kinds)], ["t", "g", "pos", "lo", "hi", "bytes", "k"])

    texts = docs.select(F.col(text).alias("text")).where(F.octet_length("text") >= LENGTH).mapInArrow(tidy(keyed), "t long, text string")
    lists = wanted.groupBy("t").agg(F.collect_list(F.struct("g", "pos", "lo", "hi", "k")).alias("wanted"))
    return (texts.join(lists, "t").select("t", "text", "wanted")
            .mapInArrow(tidy(run), "t long, g binary, pos long, lo long, hi long, bytes binary, k long").dropDuplicates(["t", "g", "lo"]))


def narrow(rows: DataFrame, width: int) -> DataFrame:
    """The rows cut into ranges of ``width`` window starts, each grouped by the bytes its windows share.

    Ranges are places relative to the minimizer.  ``digest`` is of all bytes of the
    (cut) context.
    """
    def run(batches):
        import xxhash
        for b in batches:
            made = [[] for _ in range(7)]
            for t, g, pos, lo, hi, data in zip(*(b.column(c).to_pylist() for c in ("t", "g", "pos", "lo", "hi", "bytes"))):
                for k in range((lo - pos + _SPAN) // width, (hi - pos + _SPAN) // width + 1):
                    first, last = k * width - _SPAN + pos, k * width + width - 1 - _SPAN + pos
                    a, z = max(lo, first), min(hi, last)
                    common = data[last - lo:first + LENGTH - lo]  # inside every window of the range
                    part = data[a - lo:z + LENGTH - lo]
                    key = xxhash.xxh3_128_digest(g + k.to_bytes(4, "little") + common)
                    # the place of the part is told by key and by its start in the range
                    row = (t, key, pos, a, z, part, xxhash.xxh3_128_digest(part, seed=a - first))
                    for m, x in zip(made, row):
                        m.append(x)
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(m, x) for m, x in zip(made, kinds)], ["t", "g", "pos", "lo", "hi", "bytes", "digest"])

    return rows.mapInArrow(tidy(run), "t long, g binary, pos long, lo long, hi long, bytes binary, digest binary")


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(t, a, z): bytes a to z of the text with key t are covered by repeated windows."""
    rows = saved(find_contexts(docs, text), "contexts")
    place = F.struct("t", "lo")  # copies of a text repeat places, and a place counts once
    kinds = saved(rows.groupBy("h", "digest").agg(F.min(place).alias("x"), F.max(place).alias("y"),
                                                  F.min(F.struct("t", "pos", "lo", "hi")).alias("one"))
                  .select("h", "digest", (F.col("x") < F.col("y")).alias("twice"), "one"), "kinds")
    whole = saved(rows.join(kinds.where("twice").select("h", "digest"), ["h", "digest"])
                  .select("t", F.col("lo").alias("a"), (F.col("hi") + LENGTH).alias("z")), "whole")
    groups = kinds.groupBy("h").agg(F.count("*").alias("k"), F.min("twice").alias("all_twice")).where("k > 1 and not all_twice").drop("all_twice")
    wanted = saved(kinds.join(groups, "h").select(F.col("one.t").alias("t"), F.encode(F.hex("h"), "utf-8").alias("g"), F.col("one.pos").alias("pos"),
                                                  F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"), "k"), "wanted")
    discard(rows, kinds)
    del rows, kinds, groups
    free_shuffles(docs.sparkSession)
    fetched = saved(fetch_bytes(docs, wanted, text), "bytes")
    discard(wanted)
    spans = [whole, sort_groups(fetched.where(F.col("k") <= GROUP))]
    rest = fetched.where(F.col("k") > GROUP)
    for width in WIDTHS:
        cut = saved(narrow(rest, width), "ranges")
        if not cut.limit(1).count():
            break
        kinds = saved(cut.groupBy("g", "digest").agg(F.min(place).alias("x"), F.max(place).alias("y"),
                                                     F.min(place).alias("one"))
                      .select("g", "digest", (F.col("x") < F.col("y")).alias("twice"), "one"), "kinds")
        spans.append(cut.join(kinds.where("twice").select("g", "digest"), ["g", "digest"])
                     .select("t", F.col("lo").alias("a"), (F.col("hi") + LENGTH).alias("z")))
        if width == 1:
            break
        sizes = kinds.groupBy("g").agg(F.count("*").alias("k"), F.min("twice").alias("all_twice")).where("k > 1 and not all_twice")
        ones = kinds.join(sizes.select("g", "k"), "g").select("g", "digest", F.col("one.t").alias("t"), F.col("one.lo").alias("lo"), "k")
        alive = saved(cut.join(ones, ["g", "digest", "t", "lo"]).drop("digest"), "ranges")
        spans.append(sort_groups(alive.where(F.col("k") <= GROUP)))
        rest = alive.where(F.col("k") > GROUP).drop("k")
    out = spans[0]
    for s in spans[1:]:
        out = out.unionAll(s)
    return out


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` neighbours, by doubling; two overlapping runs make the last step."""
    size, total = 1, len(h)
    while size < n:
        step = min(size, n - size)
        h = h[:total - size - step + 1] * np.uint64(0xD6E8FEB86659FD93) + h[step:]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        size += step
    return h


def passages(batches, text: str, words: int):
    """(leader, run hash, text key) arrays of all runs of ``words`` words, for each piece of the batches."""
    import xxhash
    for b in pieces(batches, text, 4 << 20):
        data = [_data(v) for v in b.column(text).to_pylist()]
        parts = [d.split() for d in data]
        some = [k for k, p in enumerate(parts) if len(p) >= words]
        if not some:
            continue
        h = np.concatenate([np.fromiter(map(xxhash.xxh3_64_intdigest, parts[k]), np.uint64, len(parts[k])) for k in some])
        owner = np.repeat(np.arange(len(some)), [len(parts[k]) for k in some])
        inside = np.flatnonzero(owner[words - 1:] == owner[:len(owner) - words + 1])
        lead = _sliding_min(_runs(h, LEAD), words - LEAD + 1)[inside]
        keys = np.array([text_key(data[k]) for k in some], np.int64)
        yield lead.view(np.int64), _runs(h, words)[inside].view(np.int64), keys[owner[inside]]


def sharing_texts(docs: DataFrame, text: str = "text", words: int = PASSAGE) -> DataFrame:
    """(t): keys of the texts that share ``words`` consecutive words with a different text."""
    def leaders(batches):
        for m, _, t in passages(batches, "text", words):
            new = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (t[1:] != t[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(m[new]), pa.array(t[new])], ["key", "t"])

    several = lambda rows: rows.groupBy("key").agg(F.min("t").alias("x"), F.max("t").alias("y")).where("x < y").select("key")
    texts = docs.select(F.col(text).alias("text"))
    with scratch():
        common = saved(several(texts.mapInArrow(tidy(leaders), "key long, t long")), "leaders")
        # a bitmap of the leaders' last bits; beyond 2^27 it lets more runs through, and loses none
        cells = 1 << min(27, max(16, (8 * common.count()).bit_length()))
        got = (common.select(F.expr(f"key & {cells - 1}").alias("c")).groupBy(F.expr("bitmap_bucket_number(c + 1)").alias("b"))
               .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(c + 1))").alias("bits")).collect())
        bits = np.zeros(cells // 8, np.uint8)
        for r in got:
            part = np.frombuffer(bytes(r["bits"]), np.uint8)
            bits[(r["b"] - 1) * len(part):r["b"] * len(part)] = part

        def runs(batches):
            for m, key, t in passages(batches, "text", words):
                at = m & (cells - 1)
                likely = np.flatnonzero(bits[at >> 3] >> (at & 7) & 1)
                yield pa.RecordBatch.from_arrays([pa.array(key[likely]), pa.array(t[likely])], ["key", "t"])

        rows = saved(texts.mapInArrow(tidy(runs), "key long, t long"), "runs")
        out = saved(rows.join(several(rows), "key").select("t").distinct(), "sharing", keep=True)
    free_shuffles(docs.sparkSession)
    return out


def remove_repeats(docs: DataFrame, text: str = "text", passage: int | None = None) -> DataFrame:
    """``docs`` without the text, with n_bytes, kept (binary) and removed spans [(a, z)].

    With ``passage`` also shares_passage: whether the row has so many consecutive words
    in common with another row.
    """
    rest = [c for c in docs.columns if c != text]
    clash = {"n_bytes", "kept", "spans", "t", "copies", *(("shares_passage",) if passage else ())} & {c.lower() for c in rest}
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    sharing = sharing_texts(docs, text, passage) if passage else None
    shares = free_name(docs, "shares")
    spans = repeated_spans(docs, text)
    found = spans.groupBy("t").agg(F.array_sort(F.collect_set(F.struct("a", "z"))).alias("found"))

    def keyed(batches):
        for b in pieces(batches, text):
            keys = [text_key(_data(v)) for v in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], [*b.schema.names, "t"])

    def run(batches):
        for b in pieces(batches, text):
            sizes, kept, gone, flags = [], [], [], []
            for v, list_, copies, shared in zip(*(b.column(c).to_pylist() for c in (text, "found", "copies", shares))):
                data = _data(v)
                cuts = []
                if copies > 1 and len(data) >= LENGTH:
                    cuts = [[0, len(data)]]
                else:
                    for s in list_ or ():
                        if cuts and s["a"] <= cuts[-1][1]:
                            cuts[-1][1] = max(cuts[-1][1], s["z"])
                        else:
                            cuts.append([s["a"], s["z"]])
                at, out = 0, []
                for a, z in cuts:
                    out.append(data[at:a])
                    at = z
                sizes.append(len(data))
                kept.append(b"".join(out) + data[at:])
                gone.append([{"a": a, "z": z} for a, z in cuts])
                flags.append(shared or bool(passage) and copies > 1 and len(data.split()) >= passage)
            kind = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
            last = [pa.array(flags, pa.bool_())] if passage else []
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(gone, kind), *last],
                                             [*rest, "n_bytes", "kept", "spans", *["shares_passage"] * len(last)])

    with_key = StructType([*docs.schema.fields, *StructType.fromDDL("t long").fields])
    rows = docs.mapInArrow(tidy(keyed), with_key)
    copies = rows.groupBy("t").agg(F.count("*").alias("copies")).where("copies > 1")
    notes = found.join(copies, "t", "full_outer")
    if passage:
        notes = notes.join(sharing.withColumn(shares, F.lit(True)), "t", "full_outer")
    else:
        notes = notes.withColumn(shares, F.lit(False))
    joined = (rows.join(notes, "t", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
              .withColumn(shares, F.coalesce(shares, F.lit(False))))
    schema = StructType([*docs.select(*rest).schema.fields,
                         *StructType.fromDDL("n_bytes long, kept binary, spans array<struct<a:long,z:long>>" + ", shares_passage boolean" * bool(passage)).fields])
    return joined.select(*docs.columns, "found", "copies", shares).mapInArrow(tidy(run), schema)


def op9_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = remove_repeats(docs, passage=PASSAGE)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("spans") > 0).alias("has_repeats"), "shares_passage")
