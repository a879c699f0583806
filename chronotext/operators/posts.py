"""Posts out of bulk text responses: parsing, cleaning, first occurrences, cyclic reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.functions.text import computed_once, is_json, outer_unquoted, starts_with_any, strip, word_count
from chronotext.operators.ranking import positions, quota_cut, within_cut

# Post lengths in words and the prefixes of lines that are not posts.
SHORTEST, LONGEST = 6, 32
LINE_PREFIXES = ("posts", "class=")
POST_PREFIXES = ("class=", "label=")
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

WINDOW_LIMIT = 1000


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _text_of(value: Column, path: str = "$") -> Column:
    """The string at `path`, or NULL when it is absent or not a string."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(_is_text(found), F.try_variant_get(value, path, "string"))


def parse_posts(responses: DataFrame, content_col: str = "content", id_col: str = "row_id") -> DataFrame:
    """(id, place, post) in response order.

    Understood are an object with a list `posts` of objects with `text`, a list of such objects or plain strings, and
    otherwise lines: a JSON object with `text`, a quoted text, or any line that does not look like a heading.
    """
    raw = responses.select(id_col, F.col(content_col).alias("_raw"))
    read = computed_once(raw, F.when(is_json(F.col("_raw")), F.try_parse_json("_raw")), "_json")
    in_object = F.try_variant_get("_json", "$.posts", "array<variant>")
    in_list = F.try_variant_get("_json", "$", "array<variant>")
    parts = computed_once(
        read.withColumns({"_object": in_object, "_list": in_list}), F.coalesce("_object", "_list"), "_items"
    )
    by_json = parts.where("_items IS NOT NULL").select(
        id_col, F.col("_object").isNull().alias("_bare"), F.posexplode_outer("_items").alias("place", "_item")
    )
    bare = F.when(F.col("_bare") & _is_text(F.col("_item")), F.try_variant_get("_item", "$", "string"))
    from_json = strip(F.coalesce(_text_of(F.col("_item"), "$.text"), bare))
    found = computed_once(by_json, from_json, "post").select(id_col, "place", "post")

    lines = parts.where("_items IS NULL AND _raw IS NOT NULL").select(
        id_col, F.posexplode_outer(F.split("_raw", LINE_BREAK)).alias("place", "_line")
    )
    bare_line = strip(F.btrim(strip(F.col("_line")), F.lit("-")))
    tidy = computed_once(lines, bare_line, "_line").where("_line <> ''")
    read_line = computed_once(tidy, F.when(is_json(F.col("_line")), F.try_parse_json("_line")), "_json")
    line = F.col("_line")
    quoted = line.startswith('"') & line.endswith('"') & (F.length(line) > 2)
    post = (
        F.when(F.col("_json").isNotNull(), strip(_text_of(F.col("_json"), "$.text")))
        .when(quoted, F.substring(line, F.lit(2), F.length(line) - 2))
        .when(~starts_with_any(line, LINE_PREFIXES), line)
    )
    by_line = computed_once(read_line, post, "post").select(id_col, "place", "post")
    return found.unionByName(by_line).where("post <> ''")


def clean_posts(posts: DataFrame, post_col: str = "post") -> DataFrame:
    """One line per post, outer quotes removed, 6 to 32 words, no heading prefix."""
    flat = F.replace(strip(F.col(post_col)), F.lit("\n"), F.lit(" "))
    tidy = computed_once(computed_once(posts, flat, post_col), outer_unquoted(F.col(post_col)), post_col)
    kept = word_count(F.col(post_col)).between(SHORTEST, LONGEST)
    return tidy.where(kept & ~starts_with_any(F.col(post_col), POST_PREFIXES))


def first_distinct(posts: DataFrame, group: str, text: str, order: str, n: int) -> DataFrame:
    """(group, text, order): the first `n` distinct texts of each group, by first appearance.

    `order` is a non-negative integer, unique in the group. For a small `n` the limit per group is applied before the
    shuffle as well, so a large group sends at most `n` rows per task; a large `n` is found by counting.
    """
    once = posts.groupBy(group, text).agg(F.min(order).alias(order))
    if n <= WINDOW_LIMIT:
        rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
        return once.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")
    quota = once.select(group).distinct().withColumn("quota", F.lit(n))
    cuts = quota_cut(once, group, order, order, quota)
    return once.join(cuts, group).where(within_cut(order, order)).drop("cut_key", "cut_tie")


def cyclic_reuse(draws: DataFrame, texts: DataFrame, group: str, text: str, order: str) -> DataFrame:
    """Add `text` to each draw (group, i): the texts of the group in order, starting over when they run out."""
    placed = positions(texts.select(group, text, order), [group, order, text], "at")
    bounds = placed.groupBy(group).agg(F.min("at").alias("first"), F.count("*").alias("n_texts"))
    wanted = draws.join(bounds, group).withColumn("at", F.col("first") + F.expr("pmod(i, n_texts)"))
    return wanted.join(placed.select("at", text), "at").drop("at", "first", "n_texts")
