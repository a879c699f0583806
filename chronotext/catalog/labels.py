"""Queries over labelling: prompts, answers, caches, posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.catalog import query, table
from chronotext.functions.text import short_model
from chronotext.operators.labelling import (
    KeywordLabeler,
    class_examples,
    class_names,
    cluster_count,
    distinct_names,
    label,
    labelling_scores,
    parse_answers,
    unexpected_labels,
    with_prompt,
)
from chronotext.operators.posts import clean_posts, cyclic_reuse, first_distinct, parse_posts

KEYWORDS = {
    "de": ["der", "die", "und", "das", "ist"],
    "en": ["the", "and", "of", "that", "is"],
    "es": ["el", "los", "las", "del", "una"],
    "fr": ["le", "les", "des", "est", "dans"],
}


def language_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("label_name")
    )


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SQL_HEAD = """'Your task is to label the following text as expressing exactly one of these class names: ['
 || (SELECT string_agg('''' || lang || '''', ', ' ORDER BY lang) FROM (SELECT DISTINCT lang FROM documents)) || ']. '
 || 'Use the label string exactly as written. '
 || 'Provide only the class name and a 10 word or less ''thought'' justifying the choice of label. '
 || 'Provide your response in JSON format, only as {"label": <label>, "thought": <thought>}.' || chr(10) || chr(10)"""

SQL_EXAMPLES = """
drawn AS (
  SELECT lang, doc_id, text, row_number() OVER (
    PARTITION BY lang ORDER BY ('0x' || substr(md5(doc_id || ':42:example'), 1, 15))::BIGINT, doc_id) AS place
  FROM documents),
examples AS (SELECT * FROM drawn WHERE place <= 3)
"""


@query(
    "class_examples",
    f"WITH {SQL_EXAMPLES} SELECT lang AS label_name, place::INT AS place, doc_id AS row_id, text FROM examples",
)
def sampled_examples(spark, sf_dir):
    return class_examples(language_corpus(spark, sf_dir))


@query("zero_shot_prompts", f"SELECT doc_id AS row_id, {SQL_HEAD} || 'Text: ' || text AS prompt FROM documents")
def zero_shot_prompts(spark, sf_dir):
    corpus = language_corpus(spark, sf_dir)
    return with_prompt(corpus, class_names(corpus), "zero").select("row_id", "prompt")


@query(
    "few_shot_prompts",
    f"""WITH {SQL_EXAMPLES}, head AS (SELECT {SQL_HEAD} AS h),
block AS (SELECT string_agg('Example: {{"text": "' || text || '", "label": "' || lang || '"}}', chr(10)
                            ORDER BY lang, place) AS b FROM examples)
SELECT doc_id AS row_id, md5(h || 'Here are some examples:' || chr(10) || b || chr(10) || chr(10)
  || 'Now classify this new text:' || chr(10) || 'Text: ' || text) AS prompt_md5
FROM documents, head, block""",
)
def few_shot_prompts(spark, sf_dir):
    corpus = language_corpus(spark, sf_dir)
    return with_prompt(corpus, class_names(corpus), "extended").select("row_id", F.md5("prompt").alias("prompt_md5"))


@query(
    "class_names",
    "SELECT DISTINCT lang AS label_name FROM documents WHERE trim(lang) <> ''",
)
def names_of_classes(spark, sf_dir):
    return distinct_names(language_corpus(spark, sf_dir))


@query(
    "resolved_cluster_count",
    "SELECT CASE WHEN count(DISTINCT lang) > 1 THEN count(DISTINCT lang) + 1 ELSE 4 END::INT AS k FROM documents",
)
def resolved_cluster_count(spark, sf_dir):
    return cluster_count(language_corpus(spark, sf_dir), 4)


def keyword_hits_sql() -> str:
    hits = [
        f"len(list_filter(w, lambda x: x IN ({', '.join(sql_text(k) for k in ks)}))) AS {c}" for c, ks in KEYWORDS.items()
    ]
    return ", ".join(hits)


SQL_LABELLED = f"""
found AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
hits AS (SELECT doc_id, lang, {keyword_hits_sql()} FROM found),
labelled AS (
  SELECT doc_id, lang, greatest(de, en, es, fr) AS best,
         CASE WHEN greatest(de, en, es, fr) = 0 THEN 'ERROR' WHEN de = greatest(de, en, es, fr) THEN 'de'
              WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS said
  FROM hits)
"""


@query(
    "labelled_documents",
    f"""WITH {SQL_LABELLED} SELECT doc_id AS row_id, lang AS label_name, said AS llm_label,
CASE WHEN best = 0 THEN '' ELSE best || ' keywords' END AS llm_thought FROM labelled""",
)
def labelled_documents(spark, sf_dir):
    labelled = label(language_corpus(spark, sf_dir), KeywordLabeler(KEYWORDS))
    return labelled.select("row_id", "label_name", "llm_label", "llm_thought")


@query(
    "labelling_scores",
    f"""WITH {SQL_LABELLED}, classes AS (SELECT lang AS c FROM labelled UNION SELECT said FROM labelled),
sums AS (SELECT c, count(*) FILTER (lang = c AND said = c) AS tp, count(*) FILTER (lang = c) AS support,
                count(*) FILTER (said = c) AS said FROM classes, labelled GROUP BY c)
SELECT round(sum(tp) / sum(support), 6) AS accuracy,
       round(sum(support * 2 * tp / (support + said)) / sum(support), 6) AS f1_weighted FROM sums""",
)
def scores_of_labelling(spark, sf_dir):
    labelled = label(language_corpus(spark, sf_dir), KeywordLabeler(KEYWORDS), style="extended", exclude_self=True)
    scores = labelling_scores(labelled)
    return scores.select(F.round("accuracy", 6).alias("accuracy"), F.round("f1_weighted", 6).alias("f1_weighted"))


SQL_RESPONSES = """
said AS (SELECT conv_id * 1000 + turn AS row_id, conv_id, text FROM conversations),
answers AS (
  SELECT row_id, text, conv_id % 5 AS kind, CASE conv_id % 5
    WHEN 0 THEN '{"label": " a ", "thought": ' || to_json(text)::VARCHAR || '}'
    WHEN 1 THEN '[' || to_json(text)::VARCHAR || ']' WHEN 2 THEN '```json ' || text || ' ```' WHEN 3 THEN text
    ELSE repeat(' ', length(text) % 7) END AS content
  FROM said)
"""


def all_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * F.lit(1000) + F.col("turn")).alias("row_id"), "conv_id", "text"
    )


def quoted_json(text: str):
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(F.col(text).alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)


@query(
    "parsed_answers",
    f"""WITH {SQL_RESPONSES}, bare AS (SELECT row_id, trim(content, e' \\t\\n\\r') AS c FROM answers)
SELECT row_id,
  CASE WHEN c = '' THEN 'ERROR' WHEN NOT json_valid(c) OR json_type(CASE WHEN json_valid(c) THEN c END) <> 'OBJECT'
       THEN 'PARSE_ERROR' ELSE trim(coalesce(json_extract_string(c, '$.label'), '')) END AS llm_label,
  CASE WHEN c = '' THEN '' WHEN NOT json_valid(c) OR json_type(CASE WHEN json_valid(c) THEN c END) <> 'OBJECT'
       THEN substr(c, 1, 50) ELSE coalesce(json_extract_string(c, '$.thought'), '') END AS llm_thought
FROM bare""",
)
def parsed_answers(spark, sf_dir):
    kind = F.col("conv_id") % 5
    content = (
        F.when(kind == 0, F.concat(F.lit('{"label": " a ", "thought": '), quoted_json("text"), F.lit("}")))
        .when(kind == 1, F.concat(F.lit("["), quoted_json("text"), F.lit("]")))
        .when(kind == 2, F.concat(F.lit("```json "), F.col("text"), F.lit(" ```")))
        .when(kind == 3, F.col("text"))
        .otherwise(F.repeat(F.lit(" "), F.length("text") % 7))
    )
    answered = all_turns(spark, sf_dir).select("row_id", content.alias("content"))
    return parse_answers(answered).select("row_id", "llm_label", "llm_thought")


@query(
    "unexpected_cached_labels",
    """SELECT DISTINCT lang AS label_name FROM documents
WHERE trim(lang) <> '' AND lang NOT IN (SELECT DISTINCT source FROM documents) AND lang NOT IN ('ERROR', 'PARSE_ERROR')""",
)
def unexpected_cached_labels(spark, sf_dir):
    """Labels in the cache that the class list lacks: here languages against sources, so none of them fits."""
    documents = table(spark, sf_dir, "documents")
    return unexpected_labels(
        documents.select(F.col("lang").alias("llm_label")), distinct_names(documents, "source")
    )


POST_RESPONSE_SQL = """
said AS (SELECT conv_id * 1000 + turn AS row_id, conv_id, text FROM conversations),
sentences AS (
  SELECT row_id, conv_id, trim(unnest(string_split(replace(text, chr(10), ' '), '.'))) AS s,
         generate_subscripts(string_split(replace(text, chr(10), ' '), '.'), 1) - 1 AS place FROM said),
posts AS (
  SELECT row_id, conv_id, place::INT AS place, trim(s, e' \\t\\n\\r') AS post FROM sentences
  WHERE conv_id % 4 IN (0, 1) AND trim(s, e' \\t\\n\\r') <> ''
  UNION ALL
  SELECT row_id, conv_id, place::INT, trim(trim(trim(s, e' \\t\\n\\r'), '-'), e' \\t\\n\\r') FROM sentences
  WHERE conv_id % 4 IN (2, 3) AND trim(trim(trim(s, e' \\t\\n\\r'), '-'), e' \\t\\n\\r') <> ''
    AND NOT json_valid(trim(trim(trim(s, e' \\t\\n\\r'), '-'), e' \\t\\n\\r'))
    AND NOT regexp_matches(lower(trim(trim(trim(s, e' \\t\\n\\r'), '-'), e' \\t\\n\\r')), '^(posts|class=)')),
cleaned AS (
  SELECT *, len(regexp_extract_all(post, '[^\\s]+')) AS n_words FROM posts),
clean AS (SELECT row_id, conv_id, place, post FROM cleaned
          WHERE n_words BETWEEN 6 AND 32 AND NOT regexp_matches(lower(post), '^(class=|label=)'))
"""


def post_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a bulk response: sentences in a `posts` object, in a list, or one per line."""
    turns = all_turns(spark, sf_dir).withColumn(
        "sentences", F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\.")
    )
    objects = F.transform("sentences", lambda s: F.struct(s.alias("text")))
    kind = F.col("conv_id") % 4
    content = (
        F.when(kind == 0, F.to_json(F.struct(objects.alias("posts"))))
        .when(kind == 1, F.to_json("sentences"))
        .otherwise(F.array_join("sentences", "\n"))
    )
    return turns.select("row_id", "conv_id", content.alias("content"))


@query("parsed_posts", f"WITH {POST_RESPONSE_SQL} SELECT row_id, place, post FROM posts")
def parsed_posts(spark, sf_dir):
    return parse_posts(post_responses(spark, sf_dir)).select("row_id", "place", "post")


@query("clean_posts", f"WITH {POST_RESPONSE_SQL} SELECT row_id, place, post FROM clean")
def cleaned_posts(spark, sf_dir):
    return clean_posts(parse_posts(post_responses(spark, sf_dir))).select("row_id", "place", "post")


SQL_FIRST = f"""{POST_RESPONSE_SQL},
keyed AS (SELECT (row_id // 1000) % 3 AS class, row_id * 100000 + place AS seq, post FROM clean),
once AS (SELECT class, post, min(seq) AS seq FROM keyed GROUP BY ALL)
"""


def posts_of_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = clean_posts(parse_posts(post_responses(spark, sf_dir)))
    return posts.select(
        (F.expr("row_id div 1000") % 3).alias("class"),
        (F.col("row_id") * F.lit(100000) + F.col("place")).alias("seq"),
        "post",
    )


@query(
    "first_distinct_posts",
    f"""WITH {SQL_FIRST}, ranked AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY seq) AS r FROM once)
SELECT class, seq, post FROM ranked WHERE r <= 50""",
)
def first_distinct_posts(spark, sf_dir):
    return first_distinct(posts_of_classes(spark, sf_dir), "class", "post", "seq", 50).select("class", "seq", "post")


@query(
    "cyclic_post_reuse",
    f"""WITH {SQL_FIRST}, ranked AS (
  SELECT class, post, row_number() OVER (PARTITION BY class ORDER BY seq) - 1 AS at, count(*) OVER (PARTITION BY class) AS n
  FROM once),
draws AS (SELECT o_custkey % 3 AS class, o_orderkey AS i FROM orders)
SELECT d.class, d.i, r.post FROM draws d JOIN ranked r ON r.class = d.class AND r.at = d.i % r.n""",
)
def cyclic_post_reuse(spark, sf_dir):
    """Every order drawn as a post of one of three classes."""
    posts = posts_of_classes(spark, sf_dir)
    once = posts.groupBy("class", "post").agg(F.min("seq").alias("seq"))
    draws = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("class"), F.col("o_orderkey").alias("i"))
    return cyclic_reuse(draws, once, "class", "post", "seq").select("class", "i", "post")


@query(
    "short_model_names",
    r"""SELECT o_orderkey AS row_id,
  regexp_replace(o_orderpriority || strftime(o_orderdate, '-%Y-%m-%d'), '-\d{4}-\d{2}-\d{2}$', '') AS model FROM orders""",
)
def short_model_names(spark, sf_dir):
    dated = F.concat("o_orderpriority", F.date_format("o_orderdate", "-yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), short_model(dated).alias("model"))
