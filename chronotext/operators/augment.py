"""Seeded text perturbation: emphasis, tail tokens, a swapped vowel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.functions.hashing import pick, uniform

# What can be appended or swapped, and how often.
EMPHASES = ["!", "!!", "!?"]
HASHTAGS = ["#democracy", "#community", "#rights", "#security", "#accountability", "#elections", "#media"]
EMOJIS = ["🙂", "🙌", "⚖️", "🗳️", "🛡️", "🚫", "💬"]
URLS = ["http://example.com", "https://news.example.org/article"]
VOWELS = "aeiou"
RATES = {"emphasis": 0.25, "hashtag": 0.30, "emoji": 0.15, "url": 0.08, "typo": 0.05}
TYPO_TRIES = 3


def _one_of(options: list[str], u: Column) -> Column:
    return F.element_at(F.lit(options), pick(u, len(options)) + 1)


def perturb(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "row_id",
    seed: int = 42,
    rates: dict[str, float] = RATES,
    hashtags: list[str] = HASHTAGS,
    emojis: list[str] = EMOJIS,
    urls: list[str] = URLS,
) -> DataFrame:
    """Replace `text_col` by its perturbed form; each step happens at its rate, decided by the row's id."""

    def u(salt: str) -> Column:
        return uniform(seed, salt, id_col)

    def happens(step: str) -> Column:
        return u(step) < rates[step]

    text = F.col(text_col)
    stressed = F.concat(F.rtrim(text, F.lit(".")), _one_of(EMPHASES, u("emphasis-kind")))
    tail = F.concat_ws(
        " ",
        *[
            F.when(happens(step), _one_of(options, u(f"{step}-kind")))
            for step, options in (("hashtag", hashtags), ("emoji", emojis), ("url", urls))
        ],
    )
    first = df.withColumn(text_col, F.when(happens("emphasis"), stressed).otherwise(text)).withColumn("_tail", tail)
    tailed = first.withColumn(
        text_col, F.when(F.col("_tail") != "", F.concat(text, F.lit(" "), F.col("_tail"))).otherwise(text)
    )

    # the word, then up to three tries at a vowel in it
    chosen = tailed.withColumn("_words", F.when(happens("typo"), F.split(text, " "))).withColumn(
        "_at", pick(u("typo-word"), F.size("_words"))
    )
    word = chosen.withColumn("_word", F.get("_words", F.col("_at")))
    tries = [pick(u(f"typo-try-{t}"), F.length("_word")) + 1 for t in range(TYPO_TRIES)]
    is_vowel = [F.lower(F.substring("_word", t, F.lit(1))).isin(list(VOWELS)) for t in tries]
    spot = F.coalesce(*[F.when(v, t) for v, t in zip(is_vowel, tries)])
    placed = word.withColumn("_spot", spot).withColumn("_old", F.substring("_word", F.col("_spot"), F.lit(1)))
    others = F.replace(F.lit(VOWELS), F.lower("_old"), F.lit(""))
    new = F.substring(others, pick(u("typo-vowel"), len(VOWELS) - 1) + 1, F.lit(1))
    cased = F.when(F.col("_old") != F.lower("_old"), F.upper(new)).otherwise(new)
    swapped = F.overlay("_word", cased, F.col("_spot"), F.lit(1))
    rebuilt = F.array_join(
        F.concat(
            F.slice("_words", F.lit(1), F.col("_at")),
            F.array(swapped),
            F.slice("_words", F.col("_at") + 2, F.size("_words")),
        ),
        " ",
    )
    return placed.withColumn(text_col, F.when(F.col("_spot").isNotNull(), rebuilt).otherwise(text)).drop(
        "_tail", "_words", "_at", "_word", "_spot", "_old"
    )
