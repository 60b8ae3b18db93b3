"""Quality rules as weak supervision: rules vote or abstain, and expectation-maximisation weighs their votes.

DataFrame functions only; the model's few parameters are the only values that reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, WORD, staged

#: Frequent words of the languages that texts are in.
STOPWORDS = (
    "the of and to in a is that for it was on as with be at this are not by "
    "le la les de des et en un une du que est pour dans qui sur au par il "
    "der die das und ein eine den von zu mit im nicht auf ist sich auch es "
    "el los las y del que una por con se su para al lo como"
).split()

_BLANK = "".join(map(chr, SEPARATORS))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text in order; null has none."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(_BLANK))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more, its first occurrence included.

    Windows are compared by 64-bit hashes. Sorted by hash, equal windows are neighbours.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(seen: Column) -> Column:
        order = F.array_sort(F.transform(seen, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            at = F.transform(again, lambda x: x["i"])
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

        return F.when(F.size(F.array_distinct(seen)) == F.size(seen), F.lit(0)).otherwise(_let(order, positions))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(windows, covered)).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and what the rules look at; all counts are over the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("words", words_of(F.col("text")))
    rows = rows.withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    words, lines = F.col("words"), F.col("lines")
    long = lambda c: c.cast("long")
    return rows.select(
        "doc_id",
        long(F.size(words)).alias("n_words"),
        long(F.length(F.array_join(words, ""))).alias("word_chars"),
        long(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        long(F.size(lines)).alias("n_lines"),
        long(F.size(F.array_distinct(words))).alias("n_distinct"),
        long(F.regexp_count(text, F.lit(r"!!|\?\?"))).alias("n_shouts"),
        long(F.regexp_count(text, F.lit(r"(?<![\p{L}])\p{Lu}{2,}(?![\p{L}])"))).alias("n_capitals"),
        long(F.size(F.filter(words, lambda w: F.lower(w).isin(STOPWORDS)))).alias("n_stopwords"),
    )


def votes() -> dict[str, tuple[Column, Column]]:
    """For each rule, when it votes for a text and when against; it abstains where neither holds."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    of = lambda c: F.col(c) / n
    lines, mean = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("word_chars") / n
    return {
        "length": (F.col("n_words") >= 80, F.col("n_words") < 50),
        "repeats": (of("n_repeat_words") <= 0.2, of("n_repeat_words") > 0.5),
        "symbols": (of("n_symbols") <= 0.05, of("n_symbols") > 0.2),
        "shouts": (of("n_shouts") <= 0.02, of("n_shouts") > 0.2),
        "capitals": (of("n_capitals") <= 0.1, of("n_capitals") > 0.4),
        "lines": (lines <= 0.2, lines > 0.5),
        "word_length": ((mean >= 3) & (mean <= 10), (mean < 2) | (mean > 20)),
        "stopwords": (of("n_stopwords") >= 0.1, of("n_stopwords") < 0.02),
        "variety": (of("n_distinct") >= 0.2, (of("n_distinct") < 0.1) & (F.col("n_words") < 5000)),
    }


def expectation_maximisation(ballots: DataFrame, rules: list[str], rounds: int) -> tuple[float, list[tuple[float, float]]]:
    """The share of good texts, and for each rule how often it votes for a good and for a bad text, when it votes.

    ``ballots`` holds each combination of votes once with its count ``c``, so it has at most 3 ** rules rows. A round
    brings one row of sums a rule to the driver.
    """
    share, rates = 0.9, [(0.95, 0.4)] * len(rules)
    vote = F.col("vote")
    for _ in range(rounds):
        cast = ballots.select("c", (F.col("c") * posterior(share, rates)).alias("good"), F.posexplode("votes").alias("rule", "vote"))
        cast = cast.withColumn("bad", F.col("c") - F.col("good"))
        sums = [F.sum("c").alias("all"), F.sum("good").alias("good")]
        for y in ("good", "bad"):
            sums += [F.sum(F.when(vote == 1, F.col(y))).alias(f"{y}_for"), F.sum(F.when(vote != 0, F.col(y))).alias(f"{y}_cast")]
        now = {r["rule"]: r for r in cast.groupBy("rule").agg(*sums).collect()}
        if not now:
            break
        rate = lambda r, y, mean: round(((r[f"{y}_for"] or 0) + 2 * mean) / ((r[f"{y}_cast"] or 0) + 2), 9)
        share = round(min(max(now[0]["good"] / now[0]["all"], 0.01), 0.99), 9)
        rates = [(rate(now[i], "good", 0.95), rate(now[i], "bad", 0.4)) for i in range(len(rules))]
    return share, rates


def posterior(share: float, rates: list[tuple[float, float]]) -> Column:
    """The probability that a text with these votes is good.

    The log odds are one array constant, not numbers spread over the expression: Spark then compiles the same code for
    every round, whatever the numbers are.
    """
    clip = lambda x: min(max(x, 1e-4), 1 - 1e-4)
    odds = [math.log(share / (1 - share))]
    for good, bad in rates:
        good, bad = clip(good), clip(bad)
        odds += [math.log(good / bad), math.log((1 - good) / (1 - bad))]
    known = F.array(*map(F.lit, odds))
    said = F.transform("votes", lambda v, i: F.when(v == 1, F.get(known, 2 * i + 1)).when(v == -1, F.get(known, 2 * i + 2)).otherwise(0.0))
    return 1 / (1 + F.exp(-F.aggregate(said, F.get(known, F.lit(0)), lambda x, y: x + y)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 10) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality.

    base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows. Otherwise a text is kept
    if its posterior probability of being good is at least one half; the model learns from all texts
    that the base test passes. Null and empty texts have no words and fail.
    One row for each row of ``docs``, repeated ones included; other columns are ignored.
    """
    rules = votes()
    rows = measured(docs, id_col, text_col)
    cast = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = staged(rows.withColumns({"votes": F.array(*(cast(*v) for v in rules.values())), "base_failed": failed}))
    ballots = staged(rows.where("NOT base_failed").groupBy("votes").agg(F.count("*").alias("c")))
    share, rates = expectation_maximisation(ballots, list(rules), rounds)
    rows = rows.withColumn("quality", posterior(share, rates))
    kept = ~F.col("base_failed") & (F.col("quality") >= 0.5)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "quality")
