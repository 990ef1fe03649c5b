"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. The accuracies
of the rules are not known: expectation-maximisation estimates them, and the
prior share of good documents, from how the rules agree. A document's posterior
probability of being good then replaces the rule that all rules must pass.

The votes of ``k`` rules take at most ``3**k`` patterns, so the EM runs on the
counts of patterns (a DataFrame of bounded size), and each pass sends one row of
sums to the driver. Only DataFrame functions run here.

Defined results: a null or empty text has no words, all counts 0, and fails the
base rules; repeated rows and rows without ``doc_id`` are judged like any other;
an empty table gives an empty result (accuracies stay at their start); extra
columns are kept by :func:`filter_quality` and ignored elsewhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RE, words, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ROUNDS = 20
#: Start and bounds of the accuracies. Most bad documents break one or two rules, so
#: a rule's vote is seldom right on bad documents and nearly always on good ones.
START_PRIOR, START_ON_GOOD, START_ON_BAD = 0.8, 0.97, 0.3
LEAST_ON_GOOD, LEAST_ON_BAD, MOST_ACCURACY = 0.9, 0.05, 0.998
PSEUDO_VOTES = 4
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the base counts and the inputs of the rules, one
    row for one row, without text. No shuffle: every document is counted where it is."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.select(
        "doc_id",
        words(F.col("text")).alias("w"),
        lines.alias("lines"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.char_length(F.regexp_replace(text, r"[^0-9]+", "")).cast("long").alias("n_digits"),
        F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")).cast("long").alias("n_alnum"),
        (F.size(F.split(text, r"[#*$%&|<>]+")) - 1).cast("long").alias("n_symbol_runs"),
    )
    w, n = F.col("w"), F.size("w")
    # (hash, position) of every 3-word window, sorted, so that equal windows stand side by side
    grams = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )
    b = a.select(
        "doc_id", n.cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        "n_symbols", "n_upper", "n_digits", "n_alnum", "n_symbol_runs",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended"),
        F.when(n >= 3, F.sort_array(grams)).otherwise(F.array()).alias("g"),
    )
    g = F.col("g")
    c = b.select(
        "*",
        F.filter(
            g,
            lambda x, i: F.coalesce(F.get(g, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(g, i + 1)["h"] == x["h"], F.lit(False)),
        ).alias("twice"),
    ).drop("g")
    d = c.select("*", F.sort_array(F.transform("twice", lambda x: x["i"])).alias("p")).drop("twice")
    p = F.col("p")
    covered = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    return d.select(
        "doc_id", *[c for c in d.columns if c not in ("doc_id", "p")],
        F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_repeat_words"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


#: Name -> (good, bad) conditions on the counts; neither: the rule abstains.
def rules() -> dict[str, Column]:
    mean = _share("word_chars", "n_words")
    return {
        "long_enough": _vote(F.col("n_words") >= 80, F.col("n_words") < MIN_WORDS),
        "word_length": _vote(mean.between(3.0, 8.5), (mean < 2.5) | (mean > 11.0)),
        "few_symbols": _vote(_share("n_symbols", "n_words") < 0.05, _share("n_symbols", "n_words") > 0.2),
        "few_symbol_runs": _vote(_share("n_symbol_runs", "n_words") < 0.05, _share("n_symbol_runs", "n_words") > 0.15),
        "mostly_alnum": _vote(_share("n_alnum", "word_chars") >= 0.94, _share("n_alnum", "word_chars") < 0.9),
        "few_dup_lines": _vote(_share("n_dup_lines", "n_lines") < 0.1, _share("n_dup_lines", "n_lines") > 0.3),
        "few_repeats": _vote(_share("n_repeat_words", "n_words") < 0.2, _share("n_repeat_words", "n_words") > 0.5),
        "few_capitals": _vote(_share("n_upper", "word_chars") < 0.1, _share("n_upper", "word_chars") > 0.3),
        "few_digits": _vote(_share("n_digits", "word_chars") < 0.05, _share("n_digits", "word_chars") > 0.25),
        "ended_lines": _vote(_share("n_ended", "n_lines") >= 0.5, _share("n_ended", "n_lines") < 0.2),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class LabelModel:
    """Prior share of good documents and, for each rule, how often a vote of it is
    right on good and on bad documents."""

    prior: float
    on_good: dict[str, float]
    on_bad: dict[str, float]

    def log_odds(self, votes: dict[str, Column]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for k, v in votes.items():
            g, b = self.on_good[k], self.on_bad[k]
            odds = odds + F.when(v == 1, math.log(g / (1 - b))).when(v == -1, math.log((1 - g) / b)).otherwise(0.0)
        return odds

    def posterior(self, votes: dict[str, Column]) -> Column:
        return 1.0 / (1.0 + F.exp(-self.log_odds(votes)))


def fit_label_model(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> LabelModel:
    """EM over vote columns ``names`` (-1, 0, 1) of all rows of ``votes``."""
    patterns = written(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "vote-patterns").coalesce(1)
    model = LabelModel(START_PRIOR, dict.fromkeys(names, START_ON_GOOD), dict.fromkeys(names, START_ON_BAD))
    for _ in range(rounds):
        p = model.posterior({k: F.col(k) for k in names})
        scored = patterns.select("*", (F.col("n") * p).alias("good__"), (F.col("n") * (1 - p)).alias("bad__"))
        sums = [F.sum("n").alias("n"), F.sum("good__").alias("good")]
        for k in names:
            sums += [
                F.sum(F.when(F.col(k) == 1, F.col("good__"))).alias(f"gr_{k}"), F.sum(F.when(F.col(k) != 0, F.col("good__"))).alias(f"gv_{k}"),
                F.sum(F.when(F.col(k) == -1, F.col("bad__"))).alias(f"br_{k}"), F.sum(F.when(F.col(k) != 0, F.col("bad__"))).alias(f"bv_{k}"),
            ]
        row = scored.agg(*sums).first()
        if not row["n"]:
            break

        def rate(part: str, whole: str, k: str, start: float, least: float, row=row) -> float:
            # pseudo-votes keep a rule that hardly ever votes near its start
            x = ((row[f"{part}_{k}"] or 0.0) + PSEUDO_VOTES * start) / ((row[f"{whole}_{k}"] or 0.0) + PSEUDO_VOTES)
            return min(MOST_ACCURACY, max(least, x))

        new = LabelModel(
            min(0.98, max(0.5, row["good"] / row["n"])),
            {k: rate("gr", "gv", k, START_ON_GOOD, LEAST_ON_GOOD) for k in names},
            {k: rate("br", "bv", k, START_ON_BAD, LEAST_ON_BAD) for k in names},
        )
        moved = max(abs(new.on_good[k] - model.on_good[k]) + abs(new.on_bad[k] - model.on_bad[k]) for k in names)
        model = new
        if moved < 1e-4:
            break
    return model


def judge(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``counts`` (a written table of with_counts) with base_failed, p_good and kept."""
    votes = rules()
    model = fit_label_model(counts.select(*[v.alias(k) for k, v in votes.items()]), list(votes), rounds)
    p = model.posterior(votes)
    return counts.select(
        "*", base_failed().alias("base_failed"), p.alias("p_good")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def quality_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the posterior p_good."""
    counts = written(with_counts(docs.select("doc_id", "text")), "quality-counts")
    return judge(counts).select("doc_id", *COUNTS, "base_failed", "kept", "p_good")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged."""
    from .common import fingerprint, packed

    keyed = docs.select(F.struct("doc_id", fingerprint(F.col("text")).alias("fp")).alias("doc_id"), "text")
    verdict = judge(written(with_counts(keyed), "quality-counts")).filter("kept").select("doc_id.*").distinct()
    rows = packed(docs, k_id=F.col("doc_id"), k_fp=fingerprint(F.col("text")))
    return rows.join(
        verdict, F.col("k_id").eqNullSafe(F.col("doc_id")) & (F.col("k_fp") == F.col("fp")), "left_semi"
    ).select("doc.*")
