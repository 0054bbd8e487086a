"""Operator 11, audit of how filters interact over every order of applying them.

Each document gets the set of filters that it fails as a bit mask.  Documents are
counted once, by part and mask (*mask cells*: at most 2^k of them a part), so what
follows never sees a document again.  A recursive common table expression then
extends prefixes of filter letters by the letters they lack, carrying the bits that
are applied; each level joins the cells of the part and emits that step's metrics.
Every prefix is worked out once, however many orders begin with it.

The filter for duplicates is judged over the whole table: a document fails it if
any document with a smaller id has the identical text.  Equal texts are grouped by
SHA-256 and pre-aggregated before they meet, so a text of a third of all rows moves
as a few rows.

Defined results: a null text is empty (and a duplicate of other empty ones); a null
part is the empty string; a document with a null id neither makes others duplicates
nor is one; rows that repeat an id with the same text are not duplicates of each
other; labels that repeat an id count as good or toxic if any of them does; an empty
table has no parts and gives no rows.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, UPPER, saved, table


def _words(text):
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _few_words(text):
    return F.size(_words(text)) < 50


def _repetitive(text):
    words = _words(text)
    return 100 * F.size(F.array_distinct(words)) < 65 * F.size(words)


def _shouting(text):
    return 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 5 * F.length(text)


def _symbols(text):
    return text.rlike("[#$%&*|]")


#: Letter -> condition under which a text fails.
FILTERS = {"A": _few_words, "B": _repetitive, "C": _shouting, "D": _symbols}
METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def mask_cells(docs: DataFrame, labels: DataFrame, filters: dict, duplicates: str | None, text: str, row_id: str, part: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail.

    Bit k of the mask is the k-th letter of ``filters``; the last bit is ``duplicates``.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    mask = sum((F.when(fails(body), F.lit(1 << k)).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    judged = (docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
              .select("id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2(body, 256)).alias("digest")))
    known = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = judged.join(known, "id", "left").select("id", "part", "mask", "digest", flag("good"), flag("toxic"))
    kinds = ["part", "mask", "good", "toxic"]
    if duplicates is None:
        counted = rows.groupBy(*kinds).agg(F.count("*").alias("n"))
    else:
        # of each text and kind: all rows, the least id, rows with that id, rows without an id
        by_id = rows.groupBy("digest", "id", *kinds).agg(F.count("*").alias("n"))
        some = F.col("id").isNotNull()
        texts = saved(by_id.groupBy("digest", *kinds).agg(
            F.sum("n").alias("n"), F.min(F.when(some, F.struct("id", "n"))).alias("first"),
            F.sum(F.when(some, 0).otherwise(F.col("n"))).alias("without")), "texts")
        least = texts.groupBy("digest").agg(F.min("first.id").alias("least"))
        stays = F.col("without") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
        split = texts.join(least, "digest").withColumn("stays", stays)
        again = 1 << len(filters)
        counted = (split.select(*kinds, F.explode(F.array(
            F.struct(F.col("mask").alias("m"), F.col("stays").alias("c")),
            F.struct(F.col("mask").bitwiseOR(F.lit(again)).alias("m"), (F.col("n") - F.col("stays")).alias("c")))).alias("x"))
            .select("part", F.col("x.m").alias("mask"), "good", "toxic", F.col("x.c").alias("n")))
    cells = counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
                                                F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    return cells.select("part", "mask", *[F.col(c).cast("long").alias(c) for c in ("n", "good", "toxic")])


@contextmanager
def _unlimited_recursion(spark):
    """Recursion may return a row for each part and prefix: the default bound of a million rows is lifted."""
    setting = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def prefix_metrics(cells: DataFrame, letters: str) -> DataFrame:
    """(part, prefix, step, letter and ``METRICS`` of its last step) of every prefix of the letters' orders."""
    spark = cells.sparkSession
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    parts = saved(parts, "cells")
    spare = ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << k})" for k, c in enumerate(letters))
    fresh, fails = "(x.mask & r.applied) = 0", "(x.mask & r.next.bit) <> 0"
    tests = {"kept": f"{fresh} and not {fails}", "removed": f"{fresh} and {fails}", "redundant": f"not {fresh} and {fails}", "unique_fails": "x.mask = r.next.bit",
             "good_lost": f"{fresh} and {fails}", "toxic_lost": f"{fresh} and {fails}"}
    counts = {"good_lost": "x.good", "toxic_lost": "x.toxic"}
    zero = ", ".join(f"'{m}', 0L" for m in METRICS)
    add = ", ".join(f"'{m}', s.{m} + if({tests[m]}, {counts.get(m, 'x.n')}, 0L)" for m in METRICS)
    query = f"""
        WITH RECURSIVE steps(part, prefix, applied, step, letter, metrics) AS (
            SELECT part, '', 0, 0, '', named_struct({zero}) FROM {{parts}}
            UNION ALL
            SELECT r.part, r.prefix || r.next.letter, r.applied | r.next.bit, r.step + 1, r.next.letter,
                   aggregate(c.cells, named_struct({zero}), (s, x) -> named_struct({add}))
            FROM (SELECT part, prefix, applied, step, explode(filter(array({spare}), l -> (applied & l.bit) = 0)) AS next
                  FROM steps WHERE step < {len(letters)}) r
            JOIN {{parts}} c ON c.part = r.part
        )
        SELECT part, prefix, step, letter, metrics.* FROM steps WHERE step > 0"""
    with _unlimited_recursion(spark):
        return saved(spark.sql(query, parts=parts), "prefixes")


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict | None = None, duplicates: str | None = "E",
                 text: str = "text", row_id: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, filter_order, step, letter, the ``METRICS``, shapley) of every part, order and step.

    ``filters`` maps letters to failing conditions on the text; ``duplicates`` is the
    letter of the duplicate filter (None: not applied).  All k! orders are listed, so
    this is meant for a handful of filters.  ``shapley`` is what the step's filter
    removes summed over all orders.
    """
    filters = FILTERS if filters is None else filters
    letters = "".join(filters) + (duplicates or "")
    cells = mask_cells(docs, labels, filters, duplicates, text, row_id, part)
    steps = prefix_metrics(cells, letters)
    size = len(letters)
    share = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * F.factorial(F.lit(size) - F.col("step"))).alias("shapley"))
    orders = (steps.where(F.col("step") == size).select("part", F.col("prefix").alias("filter_order"))
              .select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
              .withColumn("prefix", F.expr("substring(filter_order, 1, step)")))
    return (orders.join(steps, ["part", "prefix", "step"]).join(share, ["part", "letter"])
            .select("part", "filter_order", "step", "letter", *METRICS, F.col("shapley").cast("long").alias("shapley")))


def op11_filter_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit(docs, table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH judged AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
known AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
flagged AS (
    SELECT doc_id, part,
           (len(words) < 50)::INT AS a,
           (100 * len(list_distinct(words)) < 65 * len(words))::INT AS b,
           (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body))::INT AS c,
           regexp_matches(body, '[#$%&*|]')::INT AS d,
           (doc_id IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY body))::INT AS e
    FROM judged),
cells AS (
    SELECT part, a, b, c, d, e, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
    FROM flagged LEFT JOIN known USING (doc_id) GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
    SELECT v.l || w.l || x.l || y.l || z.l AS filter_order
    FROM letter v, letter w, letter x, letter y, letter z
    WHERE v.l NOT IN (w.l, x.l, y.l, z.l) AND w.l NOT IN (x.l, y.l, z.l) AND x.l NOT IN (y.l, z.l) AND y.l <> z.l),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before
          FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
tested AS (
    SELECT part, filter_order, step, letter, n, good, toxic,
           (CASE letter WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) = 1 AS fails,
           (a = 1 AND contains(before, 'A')) OR (b = 1 AND contains(before, 'B')) OR (c = 1 AND contains(before, 'C'))
           OR (d = 1 AND contains(before, 'D')) OR (e = 1 AND contains(before, 'E')) AS gone,
           a + b + c + d + e AS n_fails
    FROM cells, steps),
summed AS (
    SELECT part, filter_order, step, letter,
           sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
    FROM tested GROUP BY ALL)
SELECT part, filter_order, step, letter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM summed"""
