"""Operator 6, toxicity by a chain of classifiers.

Categories are predicted one after the other.  Each has a linear model (logistic
regression, L1) on the words, beginnings of words and signs a text contains and
on the log-odds of all earlier categories.  For training, those earlier log-odds come from models
that have not seen the row (out-of-fold), so a later model learns how far an
earlier one can be trusted on new rows; for prediction the models fitted on all
folds feed each other.

The models are fitted on the driver on a bounded sample of labelled rows:
``sample`` rows for each combination of labels, those with the smallest hash of
their id, weighted back to their share.  Features enter by a chi-square test inside
each fit, the largest ``features`` of them.  What is sent to the executors are
the features with a weight, at most ``features`` for each category.

Every row of ``docs`` is scored, whole text, in one pass.  Defined results: a null
or empty text has no words and gets the models' base rate; labels with a null
count as unlabelled; without any labelled row the probabilities are null and
nothing is toxic; repeated rows are scored alike.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import append, free_name, likely, lower_bytes, pieces, saved, table, texts_of, tidy

#: Category: SQL condition on a row of labels, in the order of the chain.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SIGN = b"sign "
CLIP = 8.0  # log-odds that a link passes on
STEMS = (4, 5, 6)  # bytes of a word's beginning, which inflected forms share
_SPLIT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> set[bytes]:
    """Words (A-Z lower-cased, cut at ASCII signs and spaces) and signs of a text."""
    data = lower_bytes(text)
    found = set(data.translate(_SPLIT).split())
    found.update(SIGN + s.encode() for s in SIGNS if s in text)
    return found


def features_of(text: str) -> set[bytes]:
    """Words, signs and beginnings of words of a text."""
    found = words_of(text)
    plain = [w for w in found if not w.startswith(SIGN)]
    for k in STEMS:
        found.update([b"^" + w[:k] for w in plain if len(w) >= k])
    return found


@dataclass
class Linear:
    """One link of the chain: bias, weights of words, weights of earlier log-odds."""

    bias: float
    words: dict[bytes, float]
    earlier: list[float]

    def log_odds(self, words: set[bytes], earlier: list[float]) -> float:
        z = self.bias + sum(map(self.words.__getitem__, words & self.words.keys()))
        z += sum(w * e for w, e in zip(self.earlier, earlier))
        return max(-CLIP, min(CLIP, z))


class Rows:
    """Features of the sampled rows as index arrays, from the distinct words of each (joined by line ends)."""

    def __init__(self, texts: list[bytes]):
        at: dict[bytes, int] = {}
        cols = [np.fromiter((at.setdefault(w, len(at)) for w in t.split(b"\n")), np.int32) if t else np.zeros(0, np.int32)
                for t in texts]
        row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) for c in cols])
        col = np.concatenate([*cols, np.zeros(0, np.int32)])
        rows, cols = [row], [col]
        beginnings: dict[bytes, int] = {}
        for k in STEMS:
            of = np.full(len(at) + 1, -1, np.int32)
            for w, c in at.items():
                if len(w) >= k and not w.startswith(SIGN):
                    of[c] = len(at) + beginnings.setdefault(b"^" + w[:k], len(beginnings))
            stem = of[col]
            pairs = np.unique(row[stem >= 0].astype(np.int64) << 32 | stem[stem >= 0])
            rows.append((pairs >> 32).astype(np.int32))
            cols.append((pairs & 0xFFFFFFFF).astype(np.int32))
        self.vocabulary = list(at) + list(beginnings)
        self.row, self.col, self.n = np.concatenate(rows), np.concatenate(cols), len(texts)

    def log_odds(self, model: Linear, earlier: np.ndarray) -> np.ndarray:
        weight = np.array([model.words.get(w, 0.0) for w in self.vocabulary])
        z = model.bias + np.bincount(self.row, weight[self.col], self.n) + earlier @ np.array(model.earlier)
        return np.clip(z, -CLIP, CLIP)


def fit(rows: Rows, y: np.ndarray, weight: np.ndarray, earlier: np.ndarray, use: np.ndarray,
        features: int, least_rows: int = 5, penalty: float = 5e-4, rounds: int = 250) -> Linear:
    """L1-penalised weighted logistic regression on the rows ``use``, by accelerated proximal steps.

    The penalty grows as the rows get fewer, and holds for the earlier log-odds too,
    which are scaled to the range of the other features.
    """
    earlier = earlier / CLIP
    w = np.where(use, weight, 0.0)
    total, positive = w.sum(), (w * y).sum()
    bias = math.log((positive + 0.5) / (total - positive + 0.5))
    inside = use[rows.row]
    row, col = rows.row[inside], rows.col[inside]
    size = len(rows.vocabulary)
    seen = np.bincount(col, minlength=size)
    has, hits = np.bincount(col, w[row], size), np.bincount(col, (w * y)[row], size)
    rate = positive / max(total, 1e-9)
    chi = (hits - has * rate) ** 2 / np.maximum(has * rate * (1 - rate) * (1 - has / max(total, 1e-9)), 1e-9)
    good = np.flatnonzero((seen >= least_rows) & (chi > 15))
    chosen = np.sort(good[np.argsort(-chi[good], kind="stable")[:features]])
    new = np.full(size, -1)
    new[chosen] = np.arange(len(chosen))
    inside = new[col] >= 0
    row, col = row[inside], new[col[inside]]
    k, m = len(chosen), earlier.shape[1]
    rare = min(rate, 1 - rate)
    penalty = max(penalty * rare, 0.03 * math.sqrt(rare / max(int(use.sum()), 1)))
    scale = w / max(total, 1e-9)

    def score(t):
        z = t[0] + np.bincount(row, t[1 + m:][col], rows.n)
        return z + earlier @ t[1:1 + m] if m else z

    # step from the largest eigenvalue of the weighted design, by power rounds
    v = np.ones(1 + m + k)
    for _ in range(12):
        z = scale * score(v)
        u = np.concatenate([[z.sum()], earlier.T @ z, np.bincount(col, z[row], k)])
        norm = float(np.linalg.norm(u))
        v = u / max(norm, 1e-12)
    step = 4 / max(1.2 * norm, 1e-9)
    theta = np.zeros(1 + m + k)
    theta[0] = bias
    ahead, t = theta.copy(), 1.0
    for _ in range(rounds):
        g = scale * (1 / (1 + np.exp(-np.clip(score(ahead), -30, 30))) - y)
        grad = np.concatenate([[g.sum()], earlier.T @ g, np.bincount(col, g[row], k)])
        moved = ahead - step * grad
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - step * penalty, 0)
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = moved + (t - 1) / t_next * (moved - theta)
        theta, t = moved, t_next
    words = {rows.vocabulary[c]: float(x) for c, x in zip(chosen, theta[1 + m:]) if x}
    return Linear(float(theta[0]), words, [float(x) / CLIP for x in theta[1:1 + m]])


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, text: str = "text",
          row_id: str = "doc_id", sample: int = 2000, features: int = 500, folds: int = 5) -> list[Linear]:
    """The fitted chain, or an empty list without labelled rows."""
    marks = [f"y{k}" for k in range(len(categories))]
    known = labels.select(F.col(row_id).cast("string").alias("id"), *[F.expr(f"cast({c} as int)").alias(m)
                                                       for m, c in zip(marks, categories.values())]).dropna()
    patterns = list(product((0, 1), repeat=len(marks)))
    is_pattern = [reduce(lambda a, b: a & b, [F.col(m) == v for m, v in zip(marks, p)]) for p in patterns]
    counts = known.agg(*[F.count(F.when(c, 1)).alias(f"n{k}") for k, c in enumerate(is_pattern)]).first()
    drawn = reduce(DataFrame.unionAll, [known.where(c).orderBy(F.xxhash64("id"), "id").limit(sample) for c in is_pattern])
    drawn = saved(drawn, "sample")

    def to_words(batches):
        for b in pieces(batches, "text"):
            found = [b"\n".join(sorted(words_of(t))) for t in texts_of(b, "text")]
            yield append(b.select(["id", *marks]), ["words"], [pa.array(found, pa.binary())])

    texts = likely(docs.select(F.col(row_id).cast("string").alias("id"), F.col(text).alias("text")), "id", drawn.select("id"))
    joined = texts.join(drawn, "id").select("id", "text", *marks)
    schema = StructType([f for f in joined.schema.fields if f.name != "text"] + StructType.fromDDL("words binary").fields)
    got = joined.mapInArrow(tidy(to_words), schema).collect()
    if not got:
        return []
    got.sort(key=lambda r: (r["id"], bytes(r["words"])))
    rows = Rows([bytes(r["words"]) for r in got])
    label = np.array([[r[m] for m in marks] for r in got], float)
    which = [patterns.index(tuple(int(v) for v in r)) for r in label]
    drawn_n = np.bincount(which, minlength=len(patterns))
    weight = np.array([counts[k] / drawn_n[k] for k in which], float)
    fold = np.array([zlib.crc32(r["id"].encode()) % folds for r in got])
    everything = np.ones(len(got), bool)

    chain, earlier = [], np.zeros((len(got), 0))
    for k in range(len(marks)):
        y = label[:, k]
        chain.append(fit(rows, y, weight, earlier, everything, features))
        if k + 1 == len(marks):
            break
        out = np.zeros(len(got))
        for f in range(folds):
            model = fit(rows, y, weight, earlier, fold != f, features)
            out[fold == f] = rows.log_odds(model, earlier)[fold == f]
        earlier = np.column_stack([earlier, out])
    return chain


def score(docs: DataFrame, chain: list[Linear], names: list[str], text: str = "text") -> DataFrame:
    """``docs`` with one probability column for each name (lengthened on a clash)."""
    names = [free_name(docs, n) for n in names]

    def run(batches):
        for b in pieces(batches, text):
            made = [[] for _ in names]
            for t in texts_of(b, text):
                words, earlier = features_of(t), []
                for k, model in enumerate(chain):
                    earlier.append(model.log_odds(words, earlier))
                    made[k].append(1 / (1 + math.exp(-earlier[k])))
                if not chain:
                    for m in made:
                        m.append(None)
            yield append(b, names, [pa.array(m, pa.float64()) for m in made])

    fields = StructType.fromDDL(", ".join(f"`{n}` double" for n in names)).fields
    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, *fields]))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id",
             categories: dict[str, str] = CATEGORIES, threshold: float = 0.5, **training) -> DataFrame:
    """``docs`` with p_<category> for each category and ``rejected`` (the last category's verdict)."""
    chain = train(docs, labels, categories, text, row_id, **training)
    names = [free_name(docs, f"p_{c}") for c in categories]
    rejected = free_name(docs, "rejected")
    return score(docs, chain, names, text).withColumn(
        rejected, F.coalesce(F.col(names[-1]) >= threshold, F.lit(False)))


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "p_low_quality", "p_toxic", F.col("rejected").alias("toxic"))
