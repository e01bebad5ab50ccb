"""Quality rules by weak supervision, in DataFrame functions only.

Rules read counts of a text and vote 1 (good), -1 (bad) or 0 (abstain). The accuracies
of the rules are unknown: expectation-maximisation over the table of vote patterns
estimates, for each rule, how it votes on good and on bad texts, and the share of good
texts. A text's posterior probability of being good then replaces "all rules must pass".

Words are ``[^\\x20\\x09-\\x0D]+``. Defined results
* null and empty texts have no words, and all counts are 0.
* rows are judged one by one, so repeated rows get equal results and clashing names of
  other columns are kept where they don't equal a name of ``COUNTS`` or of the verdict;
  names that begin with ``_qr_`` are refused.
* an empty table gives an empty table (the model is then the prior).

Scale: counts are expressions over one row, without a shuffle; what is gathered is the
table of vote patterns, at most 3 to the number of rules rows at any input size. It is
summed before the shuffle, and EM runs over it on the driver in a fixed number of steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm._shared import cut, let, refuse_reserved

SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"

#: The counts that rules read.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_stops", "n_ends")


def text_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text.

    Windows are sorted by a 64-bit hash of their words with their place, so equal ones
    are neighbours; places of those are spread to the words they cover and counted once.
    """

    def covered(w: Column) -> Column:
        last = F.size(w) - width
        keyed = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(F.xxhash64(*[F.get(w, i + j) for j in range(width)]).alias("h"), i.alias("i")),
        )

        def places(s: Column) -> Column:
            same = F.filter(
                F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
                lambda x: x.isNotNull(),
            )
            spread = F.flatten(F.transform(F.flatten(same), lambda i: F.sequence(i, i + (width - 1))))
            return F.size(F.array_distinct(spread))

        return F.when(F.size(w) < width + 1, F.lit(0)).otherwise(let(F.sort_array(keyed), places))

    return let(words, covered)


#: Frequent function words of the four languages of the tables.
STOPS = "the of and to in is that for it a de la le et les des en que el los las un una der die das und ist du se con por zu den von"


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``COUNTS`` (long); one pass, no shuffle."""
    refuse_reserved(docs, "_qr_")
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.col("_qr_words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    spaced = F.concat(F.lit(" "), F.lower(F.array_join(words, " ")), F.lit(" "))
    stops = F.array(*[F.lit(x) for x in STOPS.split()])
    count = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_window_words(words),
        "n_upper": F.regexp_count(text, F.lit("[A-Z]")),
        "n_letters": F.regexp_count(text, F.lit("[A-Za-z]")),
        "n_stops": F.size(F.array_intersect(F.split(spaced, " "), stops)),
        "n_ends": F.regexp_count(text, F.lit("[.?!][\\x20\\x09-\\x0D]")),
    }
    kept = [c for c in docs.columns if c not in count]
    return docs.withColumn("_qr_words", text_words(F.col(text_col))).select(*kept, *[v.cast("long").alias(k) for k, v in count.items()])


def rule_votes() -> dict[str, Column]:
    """Name -> vote: 1 good, -1 bad, 0 abstain. Ratios are in integers, so no rule divides."""
    n, c = F.col("n_words"), {k: F.col(k) for k in COUNTS}

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "long_enough": vote(n < 20, n >= 50),
        "word_length": vote((c["word_chars"] < 2 * n) | (c["word_chars"] > 12 * n), (c["word_chars"] >= 3 * n) & (c["word_chars"] <= 9 * n)),
        "symbols": vote(10 * c["n_symbols"] > n, 50 * c["n_symbols"] <= n),
        "lines": vote(c["n_dup_lines"] > 3, c["n_dup_lines"] == 0),
        "repeats": vote(100 * c["n_repeat_words"] > 50 * n, 100 * c["n_repeat_words"] <= 30 * n),
        "capitals": vote(2 * c["n_upper"] > c["n_letters"], 5 * c["n_upper"] <= c["n_letters"]),
        "function_words": vote((n >= 50) & (c["n_stops"] < 2), c["n_stops"] >= 4),
        "sentences": vote((n >= 50) & (200 * c["n_ends"] < n), (c["n_ends"] * 100 >= n) & (c["n_ends"] * 3 <= n)),
    }


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> dict:
    """EM over (votes, how many texts): two classes, each rule's votes given the class.

    Starts from the share of good votes in a pattern; every step adds one half to each
    vote's count, so no probability is 0. Returns the log odds of each rule's votes.
    """
    width = len(patterns[0][0]) if patterns else 0
    good = [(1 + sum(v > 0 for v in p)) / (2 + sum(v != 0 for v in p)) for p, _ in patterns]
    prior, odds = 0.5, [{-1: 0.0, 0: 0.0, 1: 0.0} for _ in range(width)]
    for _ in range(rounds):
        total = sum(k for _, k in patterns) or 1
        mass = sum(g * k for g, (_, k) in zip(good, patterns, strict=True))
        prior = (mass + 1) / (total + 2)
        for r in range(width):
            seen = {v: [0.5, 0.5] for v in (-1, 0, 1)}
            for g, (p, k) in zip(good, patterns, strict=True):
                seen[p[r]][0] += g * k
                seen[p[r]][1] += (1 - g) * k
            odds[r] = {v: math.log(a / (mass + 1.5)) - math.log(b / (total - mass + 1.5)) for v, (a, b) in seen.items()}
        base = math.log(prior) - math.log(1 - prior)
        good = [1 / (1 + math.exp(-max(-700.0, min(700.0, base + sum(o[v] for o, v in zip(odds, p, strict=True)))))) for p, _ in patterns]
    return {"base": math.log(prior) - math.log(1 - prior), "odds": odds}


def judge(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, carry: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (of its columns those in ``carry``, all by default) with the counts, ``votes``, ``p_good``, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated windows;
    such texts are not kept whatever the posterior.
    """
    rules = rule_votes()
    counted = with_counts(docs, text_col)
    if carry is not None:
        counted = counted.select(*carry, *COUNTS)
    counted = cut(counted, "rules")
    voted = counted.withColumn("votes", F.array(*rules.values()))
    patterns = sorted((tuple(r["votes"]), r["count"]) for r in voted.groupBy("votes").count().collect())
    model = fit_votes(patterns)
    log_odds = F.lit(model["base"])
    for r, odds in enumerate(model["odds"]):
        log_odds = log_odds + F.when(F.col("votes")[r] > 0, odds[1]).when(F.col("votes")[r] < 0, odds[-1]).otherwise(odds[0])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.withColumn("p_good", 1 / (1 + F.exp(-log_odds)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    )
