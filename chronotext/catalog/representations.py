"""Queries over text representations: tokens, TF-IDF, word averages, encoder vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.catalog import query, table
from chronotext.functions.hashing import uniform
from chronotext.functions.text import one_per_row, words
from chronotext.functions.vectors import unit
from chronotext.operators.encode import HashingEncoder, encode, misses, read_store
from chronotext.operators.tfidf import document_frequencies, term_occurrences, tfidf, tfidf_fit, tfidf_transform
from chronotext.operators.wordaverage import average_vectors
from chronotext.session import fresh_path, spread, stage

SHIPPED_MIN_DF, SHIPPED_MAX_DF = 5, 0.95
VECTOR_DIM = 8
ENCODER_DIM = 32

SQL_TERMS = r"""
lists AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}', 0) AS t FROM documents),
tokens AS (SELECT doc_id, unnest(t) AS a, generate_subscripts(t, 1) AS i FROM lists),
pairs AS (SELECT doc_id, a, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM tokens),
grams AS (SELECT doc_id, a AS term FROM pairs UNION ALL SELECT doc_id, a || ' ' || b FROM pairs WHERE b IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
idf AS (
  SELECT term, df, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM freq
  WHERE df >= 5 AND df <= 0.95 * (SELECT count(*) FROM documents))
"""

SQL_WORDS = r"""
words AS (
  SELECT doc_id, lower(w) AS word
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z\-'']+', 0)) AS w FROM documents))
"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")


def hashed_word_vectors(corpus: DataFrame, dim: int = VECTOR_DIM) -> DataFrame:
    """A word vector table for the corpus: every value is the uniform of `word:dimension`."""
    found = one_per_row(spread(corpus.select("text")), F.array_distinct(words(F.col("text"))), "word").distinct()
    values = [uniform(42, "vec", "word", F.lit(i)) for i in range(dim)]
    return stage(found.select("word", F.array(*values).alias("vector")), "word-vectors")


@query(
    "word_tokens",
    f"WITH {SQL_WORDS} SELECT doc_id AS row_id, word, count(*) AS n FROM words GROUP BY ALL",
)
def word_tokens(spark, sf_dir):
    found = one_per_row(texts(spark, sf_dir), words(F.col("text")), "word", "row_id")
    return found.groupBy("row_id", "word").agg(F.count("*").alias("n"))


@query(
    "text_trigrams",
    r"""WITH lists AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}', 0) AS t FROM documents),
tokens AS (SELECT doc_id, unnest(t) AS a, generate_subscripts(t, 1) AS i FROM lists),
runs AS (SELECT a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT a || ' ' || b || ' ' || c AS term, count(*) AS n FROM runs WHERE c IS NOT NULL GROUP BY ALL""",
)
def text_trigrams(spark, sf_dir):
    return term_occurrences(texts(spark, sf_dir), (3, 3))


@query("document_frequencies", f"WITH {SQL_TERMS} SELECT term, df FROM freq")
def term_document_frequencies(spark, sf_dir):
    return document_frequencies(texts(spark, sf_dir), (1, 2))


@query("tfidf_vocabulary", f"WITH {SQL_TERMS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def tfidf_vocabulary(spark, sf_dir):
    fitted = tfidf_fit(texts(spark, sf_dir), SHIPPED_MIN_DF, SHIPPED_MAX_DF, (1, 2))
    return fitted.select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "tfidf_weights",
    f"""WITH {SQL_TERMS}, raw AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term))
SELECT doc_id AS row_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""",
)
def tfidf_weights(spark, sf_dir):
    weights = tfidf(texts(spark, sf_dir), SHIPPED_MIN_DF, SHIPPED_MAX_DF, (1, 2))
    return weights.select("row_id", "term", F.round("weight", 6).alias("weight"))


@query(
    "tfidf_transform_other",
    f"""WITH {SQL_TERMS},
l2 AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}', 0) AS t FROM benchmark),
t2 AS (SELECT item_id, unnest(t) AS a, generate_subscripts(t, 1) AS i FROM l2),
p2 AS (SELECT item_id, a, lead(a) OVER (PARTITION BY item_id ORDER BY i) AS b FROM t2),
g2 AS (SELECT item_id, a AS term FROM p2 UNION ALL SELECT item_id, a || ' ' || b FROM p2 WHERE b IS NOT NULL),
raw AS (SELECT item_id, term, count(*) * any_value(idf) AS w FROM g2 JOIN idf USING (term) GROUP BY ALL)
SELECT item_id AS row_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM raw""",
)
def tfidf_transform_other(spark, sf_dir):
    """Weights of the benchmark texts under the vocabulary fitted on the documents."""
    fitted = tfidf_fit(texts(spark, sf_dir), SHIPPED_MIN_DF, SHIPPED_MAX_DF, (1, 2))
    other = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), "text")
    return tfidf_transform(other, fitted, (1, 2)).select("row_id", "term", F.round("weight", 6).alias("weight"))


SQL_VECTORS = f"""{SQL_WORDS},
vectors AS (
  SELECT word, d AS dim, ('0x' || substr(md5(word || ':' || d || ':42:vec'), 1, 8))::BIGINT / 4294967296::DOUBLE AS v
  FROM (SELECT DISTINCT word FROM words), range({VECTOR_DIM}) r(d))
"""


@query(
    "word_vector_table",
    f"WITH {SQL_VECTORS} SELECT word, dim::INT AS dim, round(v, 6) AS value FROM vectors",
)
def word_vector_table(spark, sf_dir):
    vectors = hashed_word_vectors(texts(spark, sf_dir))
    long = vectors.select("word", F.posexplode("vector").alias("dim", "value"))
    return long.select("word", "dim", F.round("value", 6).alias("value"))


@query(
    "averaged_word_vectors",
    f"""WITH {SQL_VECTORS}, means AS (SELECT doc_id, dim, avg(v) AS v FROM words JOIN vectors USING (word) GROUP BY ALL)
SELECT d.doc_id AS row_id, r.dim::INT AS dim, round(coalesce(m.v, 0), 6) AS value
FROM documents d CROSS JOIN range({VECTOR_DIM}) r(dim) LEFT JOIN means m ON m.doc_id = d.doc_id AND m.dim = r.dim""",
)
def averaged_word_vectors(spark, sf_dir):
    corpus = texts(spark, sf_dir)
    averaged = average_vectors(corpus, hashed_word_vectors(corpus), VECTOR_DIM)
    long = averaged.select("row_id", F.posexplode("features").alias("dim", "value"))
    return long.select("row_id", "dim", F.round("value", 6).alias("value"))


SQL_ENCODED = f"""{SQL_WORDS},
hashed AS (
  SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % {ENCODER_DIM} AS dim,
         CASE WHEN ('0x' || substr(md5(word), 9, 1))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM words),
sums AS (SELECT doc_id, dim, sum(s)::DOUBLE AS v FROM hashed GROUP BY ALL),
lengths AS (SELECT doc_id, sqrt(sum(v * v)) + 1e-12 AS l FROM sums GROUP BY ALL)
"""


@query(
    "encoded_texts",
    f"""WITH {SQL_ENCODED}
SELECT d.doc_id AS row_id, r.dim::INT AS dim, round(coalesce(s.v / l.l, 0), 6) + 0.0 AS value
FROM documents d CROSS JOIN range({ENCODER_DIM}) r(dim)
LEFT JOIN sums s ON s.doc_id = d.doc_id AND s.dim = r.dim LEFT JOIN lengths l ON l.doc_id = d.doc_id""",
)
def encoded_texts(spark, sf_dir):
    vectors = encode(texts(spark, sf_dir), HashingEncoder(ENCODER_DIM))
    long = vectors.select("row_id", F.posexplode("features").alias("dim", "value"))
    return long.select("row_id", "dim", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query(
    "encoder_store_lookup",
    """SELECT DISTINCT sha256(text) AS text_key FROM documents
WHERE text NOT IN (SELECT text FROM conversations)""",
)
def encoder_store_lookup(spark, sf_dir):
    """Document texts still to encode after the conversations have been encoded into the same store."""
    path = fresh_path(spark, "lookup")
    encoder = HashingEncoder(ENCODER_DIM)
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * F.lit(1000) + F.col("turn")).alias("row_id"), "text"
    )
    encode(turns, encoder, store=path)
    keyed = texts(spark, sf_dir).select("text", F.sha2("text", 256).alias("text_key"))
    return misses(keyed, read_store(spark, path, encoder.name)).select("text_key")


@query(
    "unit_vectors",
    """WITH long AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT vec_id AS row_id, dim::INT AS dim, round(v / (sqrt(sum(v * v) OVER (PARTITION BY vec_id)) + 1e-12), 6) AS value
FROM long""",
)
def unit_vectors(spark, sf_dir):
    long = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.posexplode(unit(F.col("embedding"))).alias("dim", "value")
    )
    return long.select("row_id", "dim", F.round("value", 6).alias("value"))
