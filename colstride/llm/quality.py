"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how
often each is right, and the posterior probability of quality replaces all-must-pass filtering.

DataFrame functions only: the rules are columns, the votes are counted by pattern (at most
3 ** rules rows whatever the input), and the estimation works on those counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S

#: A document under so many words fails whatever the rules say.
MIN_WORDS = 50
#: (name, vote) of the rules: +1 votes quality, -1 votes junk, 0 abstains. SQL over the measured columns.
#: They are weak: several speak against good documents now and then, and none decides alone.
RULES = (
    ("symbols", "CASE WHEN 20 * n_symbols >= n_words THEN -1 WHEN 100 * n_symbols < n_words THEN 1 ELSE 0 END"),
    ("plain_words", "CASE WHEN 10 * n_plain < 7 * n_words THEN -1 WHEN 10 * n_plain > 9 * n_words THEN 1 ELSE 0 END"),
    ("letters", "CASE WHEN 100 * n_letters < 75 * word_chars THEN -1 WHEN 100 * n_letters > 90 * word_chars THEN 1 ELSE 0 END"),
    ("word_length", "CASE WHEN n_words = 0 OR 2 * word_chars < 9 * n_words OR word_chars > 7 * n_words THEN -1 ELSE 1 END"),
    ("short_words", "CASE WHEN 25 * n_short < n_words THEN -1 WHEN 7 * n_short >= n_words THEN 1 ELSE 0 END"),
    ("capitals", "CASE WHEN 100 * n_upper > 3 * n_letters THEN -1 ELSE 1 END"),
    ("repeats", "CASE WHEN 20 * n_repeat_words > n_words THEN -1 WHEN n_repeat_words = 0 THEN 1 ELSE 0 END"),
    ("dup_lines", "CASE WHEN n_dup_lines > 0 THEN -1 ELSE 1 END"),
    ("exclaims", "CASE WHEN 10 * n_exclaims > n_words THEN -1 WHEN 50 * n_exclaims < n_words THEN 1 ELSE 0 END"),
    ("sentences", "CASE WHEN 50 * n_ends < n_words OR 3 * n_ends > n_words THEN -1 WHEN 25 * n_ends >= n_words AND 5 * n_ends <= n_words THEN 1 ELSE 0 END"),
)
#: Share of documents taken as quality, and chances that a rule votes -1 (not +1) on quality and on
#: junk, where the estimation starts: the same for every rule.
START_PRIOR, START_MINUS = 0.85, (0.1, 0.6)
#: Belief in the start, as a share of all documents: so a few rules that often agree by their nature (a
#: repeated line repeats words) don't make a class of junk of their own where there is no other.
BELIEF = 0.1
#: Rounds of expectation-maximisation.
ROUNDS = 30
#: Posterior probability from which a document is kept.
KEEP = 0.5


#: A word of letters, with hyphens and apostrophes inside and the usual signs around it.
PLAIN = r"(?<![^\x20\x09-\x0D])[(\"]?\p{L}+(?:['-]\p{L}+)?[.,;:!?)\"]{0,2}(?![^\x20\x09-\x0D])"
#: The end of a sentence at the end of a word.
ENDS = r"[.!?](?![^\x20\x09-\x0D])"


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_exclaims", "n_short", "n_plain", "n_ends")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (a struct of the other columns of ``docs``) and the counts that the rules read; a null text counts as empty.

    ``n_repeat_words``: words that stand in some 3-word window which the text holds twice or more.
    ``n_dup_lines``: lines with a word that equal an earlier line. A sort is paid only by texts in
    which some window repeats.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    one = docs.select(F.struct(*others, F.lit(0).alias("no " + "_".join(docs.columns))).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("raw"))
    one = one.withColumn("w", S.words(F.col("raw"))).withColumn("lines", F.filter(F.split("raw", "\n"), lambda x: x.rlike(S.WORD)))
    one = one.withColumn(
        "h",
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
        .otherwise(F.array().cast("array<long>")),
    )
    one = one.withColumn("twice", F.size(F.array_distinct("h")) < F.size("h"))
    # (hash, place) sorted: equal neighbours are repeats, and both ends of such a pair count.
    one = one.withColumn("s", F.when(F.col("twice"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda a, i: F.get(F.col(a), i)
    one = one.withColumn("p", F.sort_array(F.transform(
        F.filter("s", lambda x, i: (at("s", i - 1)["h"] == x["h"]) | (at("s", i + 1)["h"] == x["h"])), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("p", lambda p, i: F.least(F.lit(3), F.coalesce(at("p", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    count = lambda pattern: F.regexp_count("raw", F.lit(pattern))
    found = (
        F.size("w"), F.char_length(F.array_join("w", "")), count(r"[#*$%&|<>]"), F.size("lines") - F.size(F.array_distinct("lines")), F.coalesce(covered, F.lit(0)),
        count(r"\p{Lu}"), count(r"\p{L}"), count("!"), F.size(F.filter("w", lambda w: F.char_length(w) <= 3)), count(PLAIN), count(ENDS),
    )
    return one.select("row", *[c.cast("long").alias(name) for name, c in zip(MEASURES, found, strict=True)])


def start_model(n_rules: int) -> tuple[list[float], list[list[float]]]:
    """(shares of quality and junk, chance of a -1 vote by class and rule) before the first round."""
    return [START_PRIOR, 1 - START_PRIOR], [[r] * n_rules for r in START_MINUS]


def posterior(votes: tuple[int, ...], priors: list[float], rates: list[list[float]]) -> float:
    """Probability of quality; an abstaining rule adds nothing."""
    good, junk = (math.log(p) + sum(math.log(r if v < 0 else 1 - r) for v, r in zip(votes, row, strict=True) if v) for p, row in zip(priors, rates, strict=True))
    return 1 / (1 + math.exp(min(junk - good, 700.0)))


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS) -> tuple[list[float], list[list[float]]]:
    """(priors, chances of a -1 vote) from counts of vote patterns, by expectation-maximisation.

    1 - chance on quality and the chance on junk are the accuracies of a rule, learnt from how far the
    rules agree. Given its class, a document's votes are taken as independent. The start counts like
    ``BELIEF`` of all documents; without documents it is the result.
    """
    start_priors, start_rates = start_model(n_rules)
    priors, rates = start_priors, start_rates
    belief = BELIEF * max(1, sum(n for _, n in patterns))
    for _ in range(rounds):
        mass = [belief * p for p in start_priors]
        minus = [[belief * p * r for r in row] for p, row in zip(start_priors, start_rates, strict=True)]
        cast = [[belief * p] * n_rules for p in start_priors]
        for votes, count in patterns:
            good = posterior(votes, priors, rates)
            for c, p in enumerate((good, 1 - good)):
                mass[c] += count * p
                for k, v in enumerate(votes):
                    if v:
                        cast[c][k] += count * p
                        minus[c][k] += count * p * (v < 0)
        priors = [m / sum(mass) for m in mass]
        rates = [[m / n for m, n in zip(a, b, strict=True)] for a, b in zip(minus, cast, strict=True)]
    return priors, rates


def judge(docs: DataFrame, text: str = "text", rules=RULES, keep_from: float = KEEP) -> DataFrame:
    """The columns of ``docs`` but its text, the measured counts, ``vote_`` and the name of each rule,
    ``quality`` (the posterior), ``base_failed`` and ``kept``.

    Null or empty texts fail the base rule; equal texts get equal verdicts; an empty table gives an
    empty result; columns of ``docs`` with names of the added ones are replaced. Two passes over the
    texts would be needed for estimating and for judging, so the counts are written once between them
    and texts are not carried along.
    """
    votes = F.array(*[F.expr(sql).cast("int") for _, sql in rules]).alias("votes")
    counts = S.stored(measure(docs, text).select("*", votes), "quality")
    # At most 3 ** rules groups: bounded by the rules, not by the data.
    tally = [(tuple(r.votes), r["count"]) for r in counts.groupBy("votes").count().collect()]
    priors, rates = estimate(sorted(tally), len(rules))
    scores = []
    for prior, row in zip(priors, rates, strict=True):
        score = F.lit(math.log(prior))
        for k, r in enumerate(row):
            vote = F.get("votes", F.lit(k))
            score = score + F.when(vote < 0, math.log(r)).when(vote > 0, math.log(1 - r)).otherwise(0.0)
        scores.append(score)
    quality = 1 / (1 + F.exp(F.least(scores[1] - scores[0], F.lit(700.0))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    added = {
        **{name: F.col(name) for name in MEASURES}, **{f"vote_{name}": F.get("votes", F.lit(k)) for k, (name, _) in enumerate(rules)},
        "quality": quality, "base_failed": failed, "kept": ~failed & (quality >= keep_from),
    }
    low = {name.lower() for name in added}
    keep = [c for c in docs.columns if c != text and c.lower() not in low]
    return counts.select(*[F.col("row")[c].alias(c) for c in keep], *[c.alias(name) for name, c in added.items()])
