"""Operator 2, quality rules (native): weak supervision by voting rules.

Each rule looks at a few text statistics and votes 1 (good), -1 (bad) or 0
(abstains).  Nobody knows how reliable a rule is; expectation-maximisation
estimates it from the agreement of the rules over all documents:

- E step: the posterior probability of good for each pattern of votes, from the
  share of good documents and the current accuracy of each rule that votes;
- M step: the accuracies anew from the posterior counts.

Documents are first counted by vote pattern.  With ``R`` rules there are at most
``3^R`` patterns, whatever the number of documents, so both steps are one
aggregate over a table of bounded size.  A document is kept if its posterior
probability of good is at least ``threshold`` - one failing rule among passing
ones does not drop it, as all-must-pass filtering would.

Everything is DataFrame and SQL functions.  Defined results: a null or empty text
has no words and no lines, and fails the base test; repeated rows are judged
alike and count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, saved, table

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_ended")
#: Start of the estimation: rules are better than chance, most documents are good.
PRIOR, START, LEAST = 0.8, 0.8, 0.55


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the columns of ``STATISTICS`` (long)."""
    rest = [c for c in docs.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    chars = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    # each array is used more than once below, so it is made once
    df = docs.select(
        *rest,
        F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1)).alias("_words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).alias("_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("_symbols"),
        chars(r"[\p{L}]+").alias("_letters"),
    )
    return _with_repeats(df).select(
        *rest,
        F.size("_words").cast("long").alias("n_words"),
        F.col("_chars").cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_repeated").cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.col("_letters").cast("long").alias("n_letters"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?:;\"')][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended"),
    )


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds ``_repeated``: words inside 3-word windows that the text has twice or more.

    Each window gives one long: as many bits of its hash as its position leaves
    free.  Sorted, windows of equal hash are neighbours; the few that have such a
    neighbour are compared by their words.  The words covered by repeated windows
    at positions p1 < p2 < ... are the sum of min(3, next - p), 3 for the last.
    """
    bits = F.col("_bits")
    left = lambda x: F.call_function("shiftleft", x, bits)
    high = lambda x: F.call_function("shiftright", x, bits)
    at = lambda name, i: F.get(F.col(name), i)
    df = df.withColumn("_bits", F.length(F.bin(F.size("_words"))))
    keys = F.transform("_words", lambda w, i: left(F.xxhash64(w, at("_words", i + 1), at("_words", i + 2))).bitwiseOR(i.cast("long")))
    df = df.withColumn("_keys", F.sort_array(F.slice(keys, F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0)))))
    twin = F.transform("_keys", lambda x, i: F.when(
        (high(x) == high(at("_keys", i + 1))) | (high(x) == high(at("_keys", i - 1))),
        x.bitwiseAND(left(F.lit(1).cast("long")) - 1).cast("int")))
    df = df.withColumn("_twins", F.filter(twin, lambda x: x.isNotNull()))
    window = lambda i: F.concat_ws(" ", at("_words", i), at("_words", i + 1), at("_words", i + 2))
    df = df.withColumn("_sorted", F.sort_array(F.transform("_twins", lambda i: F.struct(window(i).alias("w"), i.alias("i")))))
    same = F.transform("_sorted", lambda s, k: F.when(
        (s["w"] == at("_sorted", k + 1)["w"]) | (s["w"] == at("_sorted", k - 1)["w"]), s["i"]))
    df = df.withColumn("_at", F.sort_array(F.filter(same, lambda x: x.isNotNull())))
    steps = F.transform("_at", lambda p, k: F.least(F.coalesce(at("_at", k + 1) - p, F.lit(3)), F.lit(3)))
    return df.withColumn("_repeated", F.aggregate(steps, F.lit(0), lambda x, y: x + y))


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0)


def default_rules() -> dict[str, Column]:
    """Votes from the statistics; counts are compared without division.

    A sign of junk votes bad and otherwise abstains, because its absence says
    little; rules on the shares of letters and symbols vote both ways.
    """
    n, c = F.col("n_words"), F.col("word_chars")
    symbols, repeats, letters = F.col("n_symbols"), F.col("n_repeat_words"), F.col("n_letters")
    lines, dups, ended = F.col("n_lines"), F.col("n_dup_lines"), F.col("n_ended")
    return {
        "symbols": _vote(10 * symbols > 3 * n, 50 * symbols <= n),
        "symbol_share": _vote(100 * symbols > 8 * c, 100 * symbols <= c),
        "letters": _vote(100 * letters < 85 * c, 100 * letters >= 92 * c),
        "repeats": _vote(100 * repeats > 40 * n),
        "lines": _vote(100 * dups > 30 * lines),
        "word_length": _vote((2 * c < 5 * n) | (c > 12 * n)),
        "length": _vote(n < 20),
        "sentences": _vote(10 * ended < lines),
    }


def estimate(patterns: DataFrame, rules: list[str], count: str = "n", prior: float = PRIOR,
             tolerance: float = 1e-4, max_rounds: int = 500) -> dict:
    """Accuracy of each rule by expectation-maximisation.

    ``patterns`` has one column of votes for each rule and a count.  The accuracy
    of a rule is the probability that a vote it casts is right; an abstention
    says nothing.  Accuracies stay above ``LEAST`` (a rule is better than
    chance), which also fixes which class is the good one.  The share of good
    documents, ``prior``, is given: estimated along with the accuracies it would
    run off to 1, where all votes for bad count as errors.  Rounds end when no
    accuracy moves by ``tolerance``; without that after ``max_rounds`` an error
    tells so.
    """
    model = {"prior": prior, "accuracy": dict.fromkeys(rules, START)}
    for _ in range(max_rounds):
        n, p = F.col(count), posterior(model)
        sums = [F.sum(n).alias("n")]
        for r in rules:
            sums += [F.sum(n * F.abs(r)).alias(f"votes_{r}"),
                     F.sum(n * F.when(F.col(r) == 1, p).when(F.col(r) == -1, 1 - p).otherwise(0.0)).alias(f"right_{r}")]
        s = patterns.agg(*sums).first()
        if not s["n"]:
            return model
        # one right and one wrong vote more, so that nothing becomes certain
        new = {r: max(LEAST, (s[f"right_{r}"] + 1) / (s[f"votes_{r}"] + 2)) for r in rules}
        moved = max(abs(new[r] - model["accuracy"][r]) for r in rules)
        model = {"prior": prior, "accuracy": new}
        if moved < tolerance:
            return model
    raise RuntimeError(f"no convergence in {max_rounds} rounds; the last moved a parameter by {moved:.2g}")


def posterior(model: dict) -> Column:
    """Probability of good, given the votes."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r, a in model["accuracy"].items():
        odds = odds + F.col(r) * F.lit(math.log(a / (1 - a)))
    return 1 / (1 + F.exp(-odds))


def quality(docs: DataFrame, text: str = "text", rules: dict[str, Column] | None = None,
            prior: float = PRIOR, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the text, with statistics, votes, ``posterior``, base_failed and kept.

    Raises ``ValueError`` if a column of ``docs`` has the name of a result.
    """
    rules = default_rules() if rules is None else rules
    votes = {f"vote_{r}": e for r, e in rules.items()}
    made = {*STATISTICS, *votes, "posterior", "base_failed", "kept"}
    clash = made & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    judged = saved(text_statistics(docs, text).withColumns(votes), "quality")
    patterns = saved(judged.groupBy(*votes).agg(F.count("*").alias("n")).orderBy(*votes).coalesce(1), "votes")
    model = estimate(patterns, list(votes), prior=prior)
    n = F.col("n_words")
    return (judged.withColumn("posterior", posterior(model))
            .withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * n))
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)))


def op2_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                "base_failed", "kept", "posterior")
