"""Queries over corpora: normalising, splitting, shares over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.catalog import query, table
from chronotext.operators.split import temporal_split, test_cutoff
from chronotext.operators.trends import monthly_shares
from chronotext.session import stage
from chronotext.sources.corpus import normalise, with_label_codes

LANGUAGE_NAMES = {"de": "german", "fr": "french"}

SQL_CORPUS = """
kept AS (
  SELECT doc_id, trim(text, e' \\t\\n\\r\\x0b\\x0c') AS text, lang FROM documents
  WHERE length(trim(text, e' \\t\\n\\r\\x0b\\x0c')) > 0),
corpus AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id, text,
         CASE trim(lang) WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' ELSE trim(lang) END AS label_name,
         TIMESTAMP '2020-01-01' + to_days((row_number() OVER (ORDER BY doc_id) - 1)::INT) AS ts
  FROM kept),
coded AS (SELECT *, dense_rank() OVER (ORDER BY label_name) - 1 AS label FROM corpus)
"""

SQL_ORDERS = """
named AS (
  SELECT o_orderkey AS row_id, o_orderpriority AS label_name, o_orderdate AS ts,
         dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label FROM orders),
cut AS (SELECT greatest(1, least(count(*) - 1, round_even(count(*) * 0.3, 0)))::BIGINT AS n FROM named),
ranked AS (SELECT *, row_number() OVER (ORDER BY ts, row_id) AS rn FROM named),
split AS (SELECT *, CASE WHEN rn <= (SELECT n FROM cut) THEN 'train' ELSE 'test' END AS split FROM ranked)
"""


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as a labelled corpus; it has no time column, so times follow the row numbers."""
    return normalise(
        table(spark, sf_dir, "documents"), label_col="lang", rename=LANGUAGE_NAMES, order_by="doc_id"
    )


def order_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as a labelled, timestamped corpus without text."""
    named = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderpriority").alias("label_name"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )
    return with_label_codes(named)


def order_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal_split(order_corpus(spark, sf_dir), 0.3)


def iso(column: str, pattern: str = "yyyy-MM-dd"):
    """The time as text; years beyond 9999 without the plus sign that Spark puts before them."""
    return F.ltrim(F.date_format(column, pattern), F.lit("+"))


@query(
    "normalised_corpus",
    f"""WITH {SQL_CORPUS}
SELECT row_id, text, label_name, strftime(ts, '%Y-%m-%d') AS day, label::INT AS label FROM coded""",
)
def normalised_corpus(spark, sf_dir):
    corpus = document_corpus(spark, sf_dir)
    return corpus.select("row_id", "text", "label_name", iso("timestamp").alias("day"), "label")


@query(
    "monthly_shares_with_cutoff",
    f"""WITH {SQL_CORPUS},
cut AS (SELECT greatest(1, least(count(*) - 1, round_even(count(*) * 0.3, 0)))::BIGINT AS n FROM coded),
cutoff AS (SELECT min(ts) AS c FROM coded WHERE row_id >= (SELECT n FROM cut)),
counts AS (SELECT date_trunc('month', ts) AS m, label_name, count(*) AS n FROM coded GROUP BY ALL)
SELECT strftime(m, '%Y-%m-%d') AS month, label_name, n,
       round(n / sum(n) OVER (PARTITION BY m), 6) AS share,
       strftime((SELECT c FROM cutoff), '%Y-%m-%d') AS cutoff
FROM counts""",
)
def monthly_shares_with_cutoff(spark, sf_dir):
    # the texts are read once; what follows needs only labels and times
    narrow = stage(document_corpus(spark, sf_dir).select("row_id", "label_name", "timestamp"), "narrow")
    split = temporal_split(narrow, 0.3)
    shares = monthly_shares(split, test_cutoff(split))
    return shares.select(
        iso("month").alias("month"), "label_name", "n", F.round("share", 6).alias("share"), iso("cutoff").alias("cutoff")
    )


@query(
    "order_month_shares",
    """WITH counts AS (
  SELECT date_trunc('month', o_orderdate) AS m, o_orderpriority AS label_name, count(*) AS n FROM orders GROUP BY ALL)
SELECT strftime(m, '%Y-%m-%d') AS month, label_name, n, round(n / sum(n) OVER (PARTITION BY m), 6) AS share
FROM counts""",
)
def order_month_shares(spark, sf_dir):
    named = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("label_name"), F.col("o_orderdate").cast("timestamp").alias("timestamp")
    )
    shares = monthly_shares(named)
    return shares.select(iso("month").alias("month"), "label_name", "n", F.round("share", 6).alias("share"))


@query(
    "temporal_split_orders",
    f"""WITH {SQL_ORDERS}
SELECT row_id, strftime(ts, '%Y-%m-%d') AS day, label_name, label::INT AS label, split FROM split""",
)
def temporal_split_orders(spark, sf_dir):
    split = order_split(spark, sf_dir)
    return split.select("row_id", iso("timestamp").alias("day"), "label_name", "label", "split")
