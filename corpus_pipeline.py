"""The corpus pipeline: toxicity, near duplicates, contamination, secrets, encoding.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it
kept, and returns the columns of ``docs`` (the last one: one row of digests for each
text).  ``run`` writes what a stage returns to the shared checkpoint folder and
gives the next stage that table, so a lost executor repeats one stage at most.

Rows with null texts pass the filters (nothing is found in them) and encode as
empty.  Columns beyond those of ``documents`` stay through the filters; the last
stage drops them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from carelog.llm import bpe, decontaminate, jaccard_join, secret_scan, toxicity
from carelog.llm.common import free_name, saved, small_batches, table


def drop_toxic(spark, docs, sf_dir):
    """Operator 6: texts that the classifier chain rejects go."""
    judged = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return judged.where(~F.col(judged.columns[-1])).select(*docs.columns)


def drop_near_duplicates(spark, docs, sf_dir):
    """Operator 8: of each component of similar texts the one with the smallest id stays."""
    return jaccard_join.keep_one_of_each(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Operator 5: texts that consist of benchmark passages to a twentieth go."""
    judged = decontaminate.contamination(docs.withColumn(free_name(docs, "kept_text"), F.col("text")),
                                         table(spark, sf_dir, "benchmark"))
    copy = free_name(docs, "kept_text")
    back = [F.col(copy).alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return judged.where(~F.col(judged.columns[-1])).select(*back)


def redact_secrets(spark, docs, sf_dir):
    """Operator 7: secrets are replaced by a mark; ``n_chars`` follows the new text."""
    small_batches(spark)
    clean = secret_scan.redact_secrets(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def encode(spark, docs, sf_dir):
    """Operator 4: token count and digests of the ids and of the text decoded from them."""
    small_batches(spark)
    return bpe.round_trip_digests(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("encoding", encode),
]
#: The stages are models, similarity joins and encoders that SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
