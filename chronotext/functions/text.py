"""Text expressions: trimming, tokens, n-grams, answers and post cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters removed by trimming, the token patterns and the date suffix of model names.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD_PATTERN = r"[A-Za-z][A-Za-z\-']+"
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
DATE_SUFFIX = r"-\d{4}-\d{2}-\d{2}$"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(WHITESPACE))


def filled(text: Column) -> Column:
    """Stripped text, or NULL when nothing is left."""
    stripped = strip(text)
    return F.when(F.length(stripped) > 0, stripped)


def computed_once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Replace or add `name` by a costly `value` that later filters will read.

    The planner moves a filter below the projection it reads from and repeats the expression there, once per mention;
    it does not do so for the output of a generator.
    """
    keep = [c for c in df.columns if c != name]
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def has_text(text: Column) -> Column:
    """True when anything but whitespace is there; stops at the first such character."""
    return text.rlike(f"[^{WHITESPACE}]")


def words(text: Column) -> Column:
    """ASCII words of two characters or more, lower-cased after matching."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)), F.lower)


def terms(text: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))


def _runs(tokens: Column, n: int) -> Column:
    """The n-grams of one length."""
    if n == 1:
        return tokens
    starts = F.sequence(F.lit(0), F.size(tokens) - n)
    joined = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i + F.lit(j)) for j in range(n)]))
    return F.when(F.size(tokens) >= n, joined).otherwise(F.array().cast("array<string>"))


def ngrams(tokens: Column, lo: int, hi: int) -> Column:
    """All n-grams of lengths lo..hi, tokens joined by one space.

    `tokens` should be a plain column: an expression here would be evaluated again for every n-gram.
    """
    return F.concat(*[_runs(tokens, n) for n in range(lo, hi + 1)])


def one_per_row(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """Take an array apart, one row per element, beside the columns `keep`.

    A plain explode makes the planner add a filter on the array's size below it, which evaluates the whole array
    expression a second time (and undoes the split into steps); the outer form followed by a null filter does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def is_json(text: Column) -> Column:
    """True when the whole text is one JSON value.

    The JSON functions read the first value and ignore what follows, and some accept single quotes. So the text is put
    into an object before a key made of its own digest: reading must arrive at that key, and strictly.
    """
    mark = F.md5(text)
    wrapped = F.concat(F.lit('{"v":'), text, F.lit(',"'), mark, F.lit('":0}'))
    whole = F.json_object_keys(wrapped) == F.array(F.lit("v"), mark)
    return F.coalesce(whole & F.try_parse_json(wrapped).isNotNull(), F.lit(False))


def short_model(name: Column) -> Column:
    """Model name without a trailing date; empty when missing."""
    return F.coalesce(F.regexp_replace(name, DATE_SUFFIX, ""), F.lit(""))


def title_case(text: Column) -> Column:
    """Capitalise each run of letters and lower-case the rest of it."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def outer_unquoted(text: Column) -> Column:
    """Drop one pair of matching outer quotes, then strip again."""
    quoted = text.rlike(r"(?s)^\".*\"$") | text.rlike(r"(?s)^'.*'$")
    inner = strip(F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0))))
    return F.when(quoted, inner).otherwise(text)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"[^{WHITESPACE}]+"), F.lit(0)))


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    low = F.lower(text)
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | low.startswith(prefix)
    return hit
