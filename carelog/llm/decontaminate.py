"""Operator 5, benchmark decontamination by a positional inverted index.

The index has a row for each (term, text): the sorted positions of the term in
the text.  A test window is a phrase of ``WINDOW`` words.  Its terms are put in
order of their frequency in the index, and the position lists, shifted by the
term's place in the phrase, are intersected from the rarest term on:

1. the list of the rarest term gives the possible starts in each text;
2. the list of the second rarest, found by (term, text), is intersected with it;
3. starts that remain are confirmed against the lists of all other terms.

What the index holds.  A position can belong to a phrase match only if it lies in
a run of words whose neighbouring pairs all occur in the benchmark, and the run
is as long as the shortest window.  Pairs are looked up in a bitmap of fixed size
(no position is lost; chance hits only make the index larger), so the index is
small without a join and without a broadcast that grows with the benchmark.
With ``slop`` above 0 (proximity: every term within ``slop`` words of its place)
all positions of benchmark terms are indexed.

Equal texts are indexed once, by the MD5 of the text; results are joined back to
their rows.

Defined results: a null text has no words, no hits and is clean; benchmark rows
without words have no windows; windows of rows with a null id count as hits but add
nothing to the items; rows of one id that repeat count as one item; an empty benchmark leaves all clean; repeated rows are judged alike.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import UPPER, append, discard, free_name, pieces, saved, table, texts_of, tidy

#: Fixed values of the contract.
WINDOW = 13
#: Sizes of the two bitmaps, in powers of two.
TERM_BITS, PAIR_BITS = 22, 24
_WORDS = bytes(ord(chr(c).lower()) if chr(c) in UPPER else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased; words are runs of ASCII letters, digits and all non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def _term_cells(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def _pair_cells(h: np.ndarray) -> np.ndarray:
    mixed = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed >> np.uint64(64 - PAIR_BITS)


def windows_of(benchmark: DataFrame, text: str, item: str) -> DataFrame:
    """Distinct windows (wid, terms) of each item: (item, wid, terms)."""
    def run(batches):
        for b in pieces(batches, "text"):
            ids, digests, terms = [], [], []
            for k, t in zip(b.column("item").to_pylist(), texts_of(b, "text")):
                words = words_of(t)
                size = min(WINDOW, len(words))
                phrases = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else ()
                for p in sorted(phrases):
                    ids.append(k)
                    digests.append(hashlib.md5(b" ".join(p)).hexdigest())
                    terms.append([w.decode("utf-8", "surrogatepass") for w in p])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(digests, pa.string()),
                                              pa.array(terms, pa.list_(pa.string()))], ["item", "wid", "terms"])

    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    return items.mapInArrow(tidy(run), "item string, wid string, terms array<string>")


def bitmaps(windows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Bits of the terms and of the pairs of all windows, and the length of the shortest window."""
    def run(batches):
        for b in batches:
            cells = set()
            for terms in b.column("terms").to_pylist():
                h = _term_cells([t.encode("utf-8", "surrogatepass") for t in terms])
                cells.update((h & np.uint64((1 << TERM_BITS) - 1)).tolist())
                cells.update(((1 << TERM_BITS) + _pair_cells(h).astype(np.int64)).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(cells), pa.int64())], ["cell"])

    cells = windows.select("terms").mapInArrow(tidy(run), "cell long").select((F.col("cell") + 1).alias("c"))
    got = (cells.groupBy(F.expr("bitmap_bucket_number(c)").alias("b"))
           .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(c))").alias("bits")).collect())
    bits = np.zeros((1 << TERM_BITS) + (1 << PAIR_BITS), bool)
    for r in got:
        part = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little").astype(bool)
        at = (r["b"] - 1) * len(part)
        bits[at:at + len(part)] = part[:len(bits) - at]
    shortest = windows.agg(F.min(F.size("terms"))).first()[0] or WINDOW
    return np.packbits(bits[:1 << TERM_BITS]), np.packbits(bits[1 << TERM_BITS:]), shortest


def _kept(words: list[bytes], terms: np.ndarray, pairs: np.ndarray, shortest: int, phrases: bool) -> np.ndarray:
    """Positions that can be part of a match."""
    h = _term_cells(words)
    cell = (h & np.uint64((1 << TERM_BITS) - 1)).astype(np.int64)
    known = (terms[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
    if not phrases or not known.any():
        return np.flatnonzero(known)
    cell = _pair_cells(h).astype(np.int64)
    linked = (pairs[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool) & known[:-1] & known[1:]
    run = np.concatenate([[0], np.cumsum(~linked)])
    return np.flatnonzero(known & (np.bincount(run)[run] >= shortest))


def postings(docs: DataFrame, maps: tuple[np.ndarray, np.ndarray, int], text: str, phrases: bool) -> DataFrame:
    """``docs`` without ``text``, with key, n_words and postings [(term, positions)]."""
    rest = [c for c in docs.columns if c != text]
    names = [free_name(docs, c) for c in ("key", "n_words", "postings")]
    kind = pa.list_(pa.struct([("term", pa.string()), ("positions", pa.list_(pa.int32()))]))
    terms, pairs, shortest = maps

    def run(batches):
        for b in pieces(batches, text):
            keys, sizes, lists = [], [], []
            for t in texts_of(b, text):
                words = words_of(t)
                found: dict[bytes, list[int]] = {}
                for p in _kept(words, terms, pairs, shortest, phrases).tolist():
                    found.setdefault(words[p], []).append(p)
                keys.append(hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest())
                sizes.append(len(words))
                lists.append([{"term": w.decode("utf-8", "surrogatepass"), "positions": p} for w, p in found.items()])
            yield append(b.select(rest), names, [pa.array(keys), pa.array(sizes, pa.int64()), pa.array(lists, kind)])

    more = StructType.fromDDL(f"{names[0]} string, {names[1]} long, {names[2]} array<struct<term:string,positions:array<int>>>")
    return docs.mapInArrow(tidy(run), StructType([*docs.select(*rest).schema.fields, *more.fields]))


def search(index: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """All (wid, key, start, size) at which a phrase of (wid, terms) matches.

    ``index`` is (term, key, positions).
    """
    frequency = index.groupBy("term").agg(F.sum(F.size("positions")).alias("f"))
    places = phrases.select("wid", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "term"))
    # a phrase with a term that the index lacks cannot match
    ordered = (places.join(frequency, "term")
               .groupBy("wid", "size").agg(F.array_sort(F.collect_list(F.struct("f", "off", "term"))).alias("t"))
               .where(F.size("t") == F.col("size")))
    shifted = lambda off: F.transform("positions", lambda p: p - off)

    def meet(starts, others):
        if not slop:
            return F.array_intersect(starts, others)
        return F.filter(starts, lambda s: F.exists(others, lambda o: F.abs(o - s) <= slop))

    first = F.col("t")[0]
    found = (ordered.withColumn("term", first["term"]).join(index, "term")
             .select("wid", "size", "t", "key", F.filter(shifted(first["off"]), lambda s: s >= 0).alias("starts")))
    if not slop:  # (with slop, starts are places of the rarest term)
        found = found.where(F.size("starts") > 0)
    second = F.get("t", F.lit(1))
    # one-word phrases are complete; the others meet the list of their second term
    single = found.where("size = 1").select("wid", "key", "size", F.explode("starts").alias("start"))
    pair = (found.where("size > 1").withColumn("term", second["term"]).join(index, ["term", "key"])
            .withColumn("starts", meet(F.col("starts"), shifted(second["off"])))
            .where(F.size("starts") > 0).select("wid", "size", "t", "key", "starts"))
    double = pair.where("size = 2").select("wid", "key", "size", F.explode("starts").alias("start"))
    rest = (pair.where("size > 2").select("wid", "size", "key", "starts", F.explode(F.expr("slice(t, 3, size)")).alias("r"))
            .select("wid", "size", "key", "starts", F.col("r.term").alias("term"), F.col("r.off").alias("off"))
            .join(index, ["term", "key"])
            .select("wid", "size", "key", F.explode(meet(F.col("starts"), shifted(F.col("off")))).alias("start"))
            .groupBy("wid", "size", "key", "start").count().where(F.col("count") == F.col("size") - 2)
            .select("wid", "key", "size", "start"))
    return single.unionAll(double).unionAll(rest)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                  item_text: str = "text", slop: int = 0) -> DataFrame:
    """``docs`` without the text, with n_words, n_hit, items (sorted strings) and contaminated."""
    windows = saved(windows_of(benchmark, item_text, item), "windows")
    rows = saved(postings(docs, bitmaps(windows), text, phrases=slop == 0), "postings")
    key, n_words, lists = rows.columns[-3:]
    some = F.size(lists) > 0
    index = (rows.where(some).select(F.col(key).alias("key"), F.col(lists).alias("p")).dropDuplicates(["key"])
             .select("key", F.explode("p").alias("p")).select("p.term", "key", "p.positions"))
    index = saved(index, "index")
    matches = saved(search(index, windows.select("wid", "terms").dropDuplicates(["wid"]), slop), "matches")
    discard(index)

    ends = matches.groupBy("key", "start").agg(F.max("size").alias("size")).withColumn("end", F.col("start") + F.col("size"))
    before = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    hits = (ends.withColumn("fresh", F.greatest(fresh, F.lit(0)))
            .groupBy("key").agg(F.sum("fresh").cast("long").alias("hit")))
    items = (matches.select("wid", "key").distinct().join(windows.select("wid", "item"), "wid")
             .groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("which")))
    found = hits.join(items, "key").withColumnRenamed("key", "found_key")

    names = [free_name(rows, c) for c in ("n_hit", "items", "contaminated")]
    rest = rows.columns[:-3]

    def judged(df, hit, which):
        df = df.withColumns({names[0]: hit, names[1]: which})
        bad = (F.col(names[0]) > 0) & (20 * F.col(names[0]) >= F.col(n_words))
        return df.withColumn(names[2], bad).select(*rest, n_words, *names)

    none = F.array().cast("array<string>")
    clean = judged(rows.where(~some), F.lit(0).cast("long"), none)
    looked = rows.where(some).join(found, F.col(key) == F.col("found_key"), "left")
    return clean.unionAll(judged(looked, F.coalesce("hit", F.lit(0).cast("long")), F.coalesce("which", none)))


def op5_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
