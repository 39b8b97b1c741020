"""Weak supervision of quality: rules vote or abstain, and EM weighs them.

A rule has a side: it votes "bad" (junk detectors) or "good" where its condition holds, and abstains
elsewhere.  Spark counts how often each vote pattern occurs; EM over that table (at most 2 ** rules
rows, whatever the corpus) finds the share of good documents and how often each rule votes on either
class, hence its accuracy.  The posterior of a pattern then decides, so that one weak vote against a
document doesn't remove it.  A rule tends to one side, so where it abstains that is evidence too, and
the posterior counts it: ``(1 - rate on good) / (1 - rate on bad)``.  Null and empty texts are judged
by their votes like any other; an empty table gives an empty table.  Repeated rows count each time
and get equal results; texts with equal votes get equal posteriors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .textstats import text_counts

EM_ROUNDS = 500
START_GOOD = 0.9
#: Where EM starts: how often a rule votes on the class that it speaks of, and on the other one.
START_RATES = {"bad": (0.3, 0.02), "good": (0.9, 0.3)}
#: A rule stays at least this accurate on classes of equal size, so the classes can't change places.
MIN_ACCURACY = 0.6
KEEP_AT = 0.5


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, tuple[str, Column]]:
    """By name: the side that the rule votes for, and where it votes."""
    symbols, dup, repeats = _share("n_symbols", "n_words"), _share("n_dup_lines", "n_lines"), _share("n_repeat_words", "n_words")
    mean, upper, bangs, pipes = _share("word_chars", "n_words"), _share("n_upper", "word_chars"), _share("n_bangs", "n_words"), _share("n_pipes", "n_words")
    distinct, ends, punct, digits = _share("n_distinct_words", "n_words"), _share("n_ends", "n_words"), _share("n_other_punct", "n_words"), _share("n_digits", "word_chars")
    words = F.col("n_words")
    return {
        "v_symbols": ("bad", symbols > 0.1),
        "v_symbol_chars": ("bad", _share("n_symbols", "word_chars") > 0.03),
        "v_pipes": ("bad", pipes > 0.05),
        "v_upper": ("bad", upper > 0.35),
        "v_bangs": ("bad", bangs > 0.1),
        "v_dup_lines": ("bad", dup > 0.3),
        "v_repeats": ("bad", (words >= 20) & (repeats > 0.3)),
        "v_variety": ("bad", (words >= 50) & (distinct < 0.15)),
        "v_word_length": ("bad", (words > 0) & ((mean < 2.5) | (mean > 11))),
        "v_punctuation": ("bad", (punct > 0.8) | (digits > 0.3)),
        "v_no_words": ("bad", words == 0),
        "v_sentences": ("good", (words >= 5) & ends.between(0.01, 0.3) & (upper < 0.2)),
        "v_plain": ("good", (words >= 5) & (symbols < 0.02) & (bangs < 0.05) & (pipes < 0.01)),
        "v_no_repeats": ("good", (words >= 5) & (dup < 0.1) & (repeats < 0.15)),
    }


def _clamped(p: float) -> float:
    return min(max(p, 1e-6), 1 - 1e-6)


def _held(side: str, good: float, bad: float) -> tuple[float, float]:
    """Rates of votes on good and bad documents, apart enough for MIN_ACCURACY."""
    odds = MIN_ACCURACY / (1 - MIN_ACCURACY)
    return (_clamped(min(good, bad / odds)), _clamped(bad)) if side == "bad" else (_clamped(good), _clamped(min(bad, good / odds)))


def start() -> dict:
    own = {n: START_RATES[side] for n, (side, _) in rules().items()}
    return {"good": START_GOOD, "rates": {n: (b, a) if rules()[n][0] == "bad" else (a, b) for n, (a, b) in own.items()}}


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> dict:
    """EM on (pattern of 0/1 votes, count) rows; without rows the starting values.

    The start counts as one document, which keeps the rates of rules that never vote off 0 and 1.
    """
    model, sides = start(), {n: side for n, (side, _) in rules().items()}
    begin, total = model, sum(n for _, n in patterns)
    for _ in range(EM_ROUNDS if total else 0):
        mass = START_GOOD
        votes = {n: [g * START_GOOD, b * (1 - START_GOOD)] for n, (g, b) in begin["rates"].items()}
        for pattern, count in patterns:
            p = posterior(pattern, model)
            mass += count * p
            for n, v in zip(sides, pattern, strict=True):
                if v:
                    votes[n][0] += count * p
                    votes[n][1] += count * (1 - p)
        rest = total + 1 - mass
        rates = {n: _held(sides[n], g / mass, b / rest) for n, (g, b) in votes.items()}
        moved = max(abs(x - y) for n in rates for x, y in zip(rates[n], model["rates"][n], strict=True))
        model = {"good": _clamped(mass / (total + 1)), "rates": rates}
        if moved < 1e-9:
            break
    return model


def accuracies(model: dict) -> dict[str, float]:
    """Of each rule's votes, the share that EM holds right."""
    out = {}
    for n, (side, _) in rules().items():
        g, b = model["rates"][n][0] * model["good"], model["rates"][n][1] * (1 - model["good"])
        out[n] = (g if side == "good" else b) / (g + b)
    return out


def weights(model: dict) -> tuple[float, dict[str, tuple[float, float]]]:
    """Log odds of good: at the start, and what each rule adds when it votes or abstains."""
    log = math.log
    return log(model["good"] / (1 - model["good"])), {n: (log(g / b), log((1 - g) / (1 - b))) for n, (g, b) in model["rates"].items()}


def posterior(pattern: tuple[int, ...], model: dict) -> float:
    odds, by = weights(model)
    odds += sum(x if v else y for v, (x, y) in zip(pattern, by.values(), strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def posterior_column(model: dict) -> Column:
    base, by = weights(model)
    odds: Column = F.lit(base)
    for n, (x, y) in by.items():
        odds = odds + F.when(F.col(n) == 1, x).otherwise(y)
    return 1 / (1 + F.exp(-odds))


def quality_rules(counts: DataFrame) -> DataFrame:
    """Adds votes, ``posterior`` and ``good`` to a table of text counts; it is read twice."""
    votes = rules()
    voted = counts.withColumns({n: F.when(where, 1).otherwise(0) for n, (_, where) in votes.items()})
    rows = voted.groupBy(*votes).count().collect()  # at most 2 ** rules rows
    model = fit(sorted((tuple(r[n] for n in votes), r["count"]) for r in rows))
    return voted.withColumn("posterior", posterior_column(model)).withColumn("good", F.col("posterior") >= KEEP_AT)


def rated(docs: DataFrame) -> DataFrame:
    """Counts, votes and verdict of every document."""
    return quality_rules(written(text_counts(docs), "text-counts"))
