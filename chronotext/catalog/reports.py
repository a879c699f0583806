"""Queries over stores, score tables, reconstruction of the future and whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.catalog import query, table
from chronotext.catalog.corpora import SQL_ORDERS, document_corpus, iso, order_corpus, order_split
from chronotext.catalog.labels import KEYWORDS, SQL_LABELLED, language_corpus
from chronotext.catalog.models import SQL_COMPONENTS, vector_corpus, vectors
from chronotext.catalog.representations import hashed_word_vectors
from chronotext.catalog.scoring import SQL_CLUSTERED, clustered
from chronotext.operators.labelling import KeywordLabeler
from chronotext.operators.reduce import pca
from chronotext.operators.report import projection_view, score_comparison, scores_long, simple_scores
from chronotext.operators.trends import code_names, future_reconstruction, named_predictions, ordered_labels
from chronotext.plans.runs import Settings, run_labelling, run_representation
from chronotext.session import fresh_path, stage
from chronotext.sources.corpus import label_codes, load_or_build, normalise, read_corpus, write_corpus
from chronotext.sources.stores import (
    append_metrics,
    content_signature,
    load_run,
    read_metrics,
    save_run,
    union_metrics,
)


@query(
    "saved_corpus_csv",
    r"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, trim(text, e' \t\n\r') AS text, trim(lang) AS label_name,
strftime(TIMESTAMP '2020-01-01' + to_days((row_number() OVER (ORDER BY doc_id) - 1)::INT), '%Y-%m-%d') AS day,
(dense_rank() OVER (ORDER BY trim(lang)) - 1)::INT AS label FROM documents""",
)
def saved_corpus_csv(spark, sf_dir):
    """A corpus written as CSV, line breaks and quotes included, and read back."""
    corpus = normalise(table(spark, sf_dir, "documents"), label_col="lang", order_by="doc_id")
    path = fresh_path(spark, "corpus-csv")
    write_corpus(corpus, path, "csv")
    saved = read_corpus(spark, path, "csv")
    return saved.select("row_id", "text", "label_name", iso("timestamp").alias("day"), "label")


@query(
    "coerced_times",
    """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderpriority AS text,
CASE WHEN o_custkey % 7 = 0 THEN strftime(TIMESTAMP '2020-01-01' + to_days((row_number() OVER (ORDER BY o_orderkey) - 1)::INT), '%Y-%m-%d')
     ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, 'unlabeled' AS label_name, 0::INT AS label FROM orders""",
)
def coerced_times(spark, sf_dir):
    """Orders as unlabelled texts, a seventh of them with an unreadable time."""
    written = F.when(F.col("o_custkey") % 7 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    raw = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", written.alias("posted"))
    corpus = normalise(raw, "o_orderpriority", timestamp_col="posted", order_by="o_orderkey")
    return corpus.select("row_id", "text", iso("timestamp").alias("day"), "label_name", "label")


@query(
    "spelled_times",
    """WITH o AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_custkey % 8 AS form FROM orders)
SELECT row_id, form::INT AS form, strftime(CASE WHEN form = 7 THEN TIMESTAMP '2020-01-01' + to_days(row_id::INT) ELSE date_trunc('day', o_orderdate) END, '%Y-%m-%d') AS day
FROM o""",
)
def spelled_times(spark, sf_dir):
    """Order dates in every spelling that is read, one in eight of them as no time at all."""
    forms = ["yyyy-MM-dd", "yyyy/M/d", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy"]
    form = F.col("o_custkey") % 8
    written = F.coalesce(*[F.when(form == i, F.date_format("o_orderdate", f)) for i, f in enumerate(forms)], F.lit("32.13.99"))
    raw = table(spark, sf_dir, "orders").select("o_orderkey", form.cast("string").alias("form"), written.alias("posted"))
    corpus = normalise(raw, "form", timestamp_col="posted", order_by="o_orderkey")
    return corpus.select("row_id", F.col("text").cast("int").alias("form"), iso("timestamp").alias("day"))


@query(
    "reused_corpus",
    """WITH o AS (SELECT o_orderkey AS row_id, o_orderpriority AS label_name, date_trunc('month', o_orderdate) AS m FROM orders)
SELECT call, label_name, count(*) AS n, strftime(min(m), '%Y-%m') AS first_month
FROM (SELECT 'built' AS call, * FROM o UNION ALL SELECT 'reused', * FROM o UNION ALL SELECT 'built again', * FROM o WHERE row_id % 3 = 0)
GROUP BY ALL""",
)
def reused_corpus(spark, sf_dir):
    """A corpus built and saved, taken from its file although another one is offered, and replaced when that is asked for."""
    path = fresh_path(spark, "reused-corpus")
    orders = order_corpus(spark, sf_dir).withColumn("text", F.lit("order"))
    other = orders.where("row_id % 3 = 0")
    calls = [("built", orders, False), ("reused", other, False), ("built again", other, True)]
    found = None
    for call, build, regen in calls:
        got = load_or_build(spark, path, lambda build=build: build, "csv", regen).withColumn("call", F.lit(call))
        counted = got.groupBy("call", "label_name").agg(F.count("*").alias("n"), iso(F.min("timestamp"), "yyyy-MM").alias("first_month"))
        counted = stage(counted, "reused-counts")  # before the file is replaced
        found = counted if found is None else found.unionByName(counted)
    return found


@query(
    "simple_scores",
    """SELECT 'label-' || label AS method, 'LR' AS type, round(avg(CASE WHEN vec_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS f1 FROM embeddings GROUP BY label
UNION ALL
SELECT 'label-' || label, 'LLM', round(avg(CASE WHEN vec_id % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) FROM embeddings WHERE label < 5 GROUP BY label""",
)
def plain_scores(spark, sf_dir):
    """Two scores a label, one of them missing for half the labels, in the plain long form."""
    share = lambda m: F.avg(F.when(F.col("vec_id") % m == 0, 1.0).otherwise(0.0))
    metrics = table(spark, sf_dir, "embeddings").groupBy(F.concat(F.lit("label-"), F.col("label")).alias("Method")).agg(
        share(3).alias("LR_F1_weighted"), F.when(F.first("label") < 5, share(2)).alias("LLM_F1_weighted")
    )
    return simple_scores(metrics).select(F.col("Method").alias("method"), "type", F.round("f1", 6).alias("f1"))


@query(
    "preferred_label_order",
    """SELECT lang AS label_name, CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 3 END::BIGINT AS place
FROM (SELECT DISTINCT lang FROM documents)""",
)
def preferred_label_order(spark, sf_dir):
    return ordered_labels(table(spark, sf_dir, "documents"), "lang", ("fr", "en"))


SQL_PREDICTED = f"""{SQL_ORDERS},
noisy AS (SELECT *, CASE WHEN row_id % 20 = 0 THEN (label + 1) % 5 ELSE label END AS code FROM split),
first_seen AS (SELECT code, label_name, min(row_id) AS f FROM noisy GROUP BY ALL),
names AS (SELECT code, arg_max(label_name, f) AS name FROM first_seen GROUP BY code),
test AS (SELECT n.row_id, date_trunc('month', ts) AS m, n.label_name, c.o_custkey % 6 AS pred
         FROM noisy n JOIN orders c ON c.o_orderkey = n.row_id WHERE split = 'test'),
shown AS (SELECT t.*, coalesce(name, pred::VARCHAR) AS pred_name FROM test t LEFT JOIN names ON pred = code)
"""


def noisy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with one code in twenty shifted, so that codes have several names."""
    off = (F.col("label") + 1) % 5
    return order_split(spark, sf_dir).withColumn("label", F.when(F.col("row_id") % 20 == 0, off).otherwise(F.col("label")))


def order_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in predictions, one code of which has no name."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 6).cast("int").alias("pred")
    )


@query("code_names", f"WITH {SQL_PREDICTED} SELECT code::INT AS label, name AS label_name FROM names")
def names_of_codes(spark, sf_dir):
    return code_names(noisy_split(spark, sf_dir))


@query(
    "majority_code_names",
    f"""WITH {SQL_PREDICTED}, seen AS (SELECT code, label_name, count(*) AS n, min(row_id) AS f FROM noisy GROUP BY ALL)
SELECT code::INT AS label, label_name FROM seen QUALIFY row_number() OVER (PARTITION BY code ORDER BY n DESC, f) = 1""",
)
def majority_names_of_codes(spark, sf_dir):
    """The name that most rows of a code have, which shifted codes cannot change."""
    return code_names(noisy_split(spark, sf_dir), majority=True)


GIVEN_ORDER = ("fr", "none", "en")


@query(
    "given_label_codes",
    f"""WITH l AS (SELECT DISTINCT trim(lang) AS label_name FROM documents WHERE lang IS NOT NULL),
placed AS (SELECT label_name, list_position({list(GIVEN_ORDER)}, label_name) AS place FROM l)
SELECT label_name, CASE WHEN place > 0 THEN place - 1
  ELSE {len(GIVEN_ORDER)} + row_number() OVER (PARTITION BY coalesce(place, 0) > 0 ORDER BY label_name) - 1 END::INT AS label
FROM placed""",
)
def given_label_codes(spark, sf_dir):
    """Codes in a given class order, one class of which does not occur; the other classes follow by name."""
    labels = table(spark, sf_dir, "documents").select(F.trim("lang").alias("label_name"))
    return label_codes(labels, order=GIVEN_ORDER)


@query(
    "named_predictions",
    f"WITH {SQL_PREDICTED} SELECT row_id, pred_name AS pred_label_name FROM shown",
)
def predictions_with_names(spark, sf_dir):
    split = noisy_split(spark, sf_dir)
    test = split.where("split = 'test'").select("row_id").join(order_predictions(spark, sf_dir), "row_id")
    return named_predictions(test, code_names(split)).select("row_id", "pred_label_name")


@query(
    "future_reconstruction",
    f"""WITH {SQL_PREDICTED},
t AS (SELECT m, label_name, count(*) AS n FROM shown GROUP BY ALL),
p AS (SELECT m, pred_name AS label_name, count(*) AS n FROM shown GROUP BY ALL),
ts AS (SELECT m, label_name, n / sum(n) OVER (PARTITION BY m) AS s FROM t),
ps AS (SELECT m, label_name, n / sum(n) OVER (PARTITION BY m) AS s FROM p),
labels AS (SELECT label_name FROM t UNION SELECT label_name FROM p),
grid AS (SELECT m, label_name FROM (SELECT DISTINCT m FROM shown), labels)
SELECT strftime(m, '%Y-%m-%d') AS month, label_name, round(coalesce(ts.s, 0), 6) AS true_share, round(coalesce(ps.s, 0), 6) AS pred_share
FROM grid LEFT JOIN ts USING (m, label_name) LEFT JOIN ps USING (m, label_name)""",
)
def reconstructed_future(spark, sf_dir):
    shares = future_reconstruction(noisy_split(spark, sf_dir), order_predictions(spark, sf_dir))
    rounded = [F.round(c, 6).alias(c) for c in ("true_share", "pred_share")]
    return shares.select(iso("month").alias("month"), "label_name", *rounded)


@query(
    "content_signature",
    """WITH h AS (SELECT sha256(doc_id || chr(31) || text) AS h FROM documents),
s AS (SELECT 'documents' || ':' || count(*) || ':' || """
    + " || ':' || ".join(f"sum(('0x' || substr(h, {1 + 6 * i}, 6))::BIGINT)::VARCHAR" for i in range(10))
    + """ AS t FROM h) SELECT substr(sha256(t), 1, 16) AS signature FROM s""",
)
def signature_of_documents(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return content_signature(texts, "documents")


SQL_METRICS = """
lr AS (
  SELECT event_type || '-lr' AS Method, 'events' AS Data, round(avg(value) / 200, 3) AS TrainFrac, NULL::DOUBLE AS LLM_F1_weighted,
         round(count(*) / (SELECT count(*) FROM events), 6) AS LR_F1_weighted, NULL::VARCHAR AS LLM_model_name FROM events GROUP BY event_type),
llm AS (
  SELECT 'llm-' || lang AS Method, 'documents' AS Data, NULL::DOUBLE AS TrainFrac,
         round(count(*) / (SELECT count(*) FROM documents), 6) AS LLM_F1_weighted, NULL::DOUBLE AS LR_F1_weighted,
         lang || '-model-2025-04-14' AS LLM_model_name FROM documents GROUP BY lang),
metrics AS (SELECT * FROM lr UNION ALL BY NAME SELECT * FROM llm)
"""


def fit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in classifier scores: one row per event type."""
    events = table(spark, sf_dir, "events")
    whole = events.agg(F.count("*")).scalar()
    return events.groupBy("event_type").agg(F.avg("value").alias("v"), F.count("*").alias("n")).select(
        F.concat("event_type", F.lit("-lr")).alias("Method"),
        F.lit("events").alias("Data"),
        F.round(F.col("v") / 200, 3).alias("TrainFrac"),
        F.round(F.col("n") / whole, 6).alias("LR_F1_weighted"),
    )


def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in labelling scores: one row per language, NaN where a score does not apply."""
    documents = table(spark, sf_dir, "documents")
    whole = documents.agg(F.count("*")).scalar()
    return documents.groupBy("lang").agg(F.count("*").alias("n")).select(
        F.concat(F.lit("llm-"), "lang").alias("Method"),
        F.lit("documents").alias("Data"),
        F.lit(float("nan")).alias("TrainFrac"),
        F.round(F.col("n") / whole, 6).alias("LLM_F1_weighted"),
        F.concat("lang", F.lit("-model-2025-04-14")).alias("LLM_model_name"),
    )


@query("union_of_metrics", f"WITH {SQL_METRICS} SELECT * FROM metrics")
def union_of_metrics(spark, sf_dir):
    return union_metrics(fit_metrics(spark, sf_dir), label_metrics(spark, sf_dir))


@query("appended_metrics", f"WITH {SQL_METRICS} SELECT * FROM metrics UNION ALL BY NAME SELECT * FROM lr")
def appended_metrics(spark, sf_dir):
    """Three appends to one table, the first repeated; the model column comes with the second."""
    path = fresh_path(spark, "metrics")
    for rows in (fit_metrics(spark, sf_dir), label_metrics(spark, sf_dir), fit_metrics(spark, sf_dir)):
        append_metrics(rows, path)
    return read_metrics(spark, path).drop("run_sig", "created_at")


@query(
    "long_scores",
    f"""WITH {SQL_METRICS} SELECT Method, 'LR' AS type, LR_F1_weighted AS f1 FROM metrics WHERE LR_F1_weighted IS NOT NULL
UNION ALL SELECT Method, 'LLM', LLM_F1_weighted FROM metrics WHERE LLM_F1_weighted IS NOT NULL""",
)
def long_scores(spark, sf_dir):
    metrics = union_metrics(fit_metrics(spark, sf_dir), label_metrics(spark, sf_dir))
    return scores_long(metrics).select("Method", "type", "f1")


@query(
    "score_comparison",
    f"""WITH {SQL_METRICS}
SELECT upper(replace(Method, '-lr', '')) || ' LR' || chr(10) || 'train=' || round_even(TrainFrac * 100, 0)::INT || '%' AS label,
       LR_F1_weighted AS f1, 'LR-' || upper(replace(Method, '-lr', '')) AS family FROM lr
UNION ALL
SELECT 'LLM ' || upper(substr(Method, 5, 1)) || substr(Method, 6) || chr(10) || replace(LLM_model_name, '-2025-04-14', ''),
       LLM_F1_weighted, 'LLM-' || substr(Method, 5) FROM llm""",
)
def compared_scores(spark, sf_dir):
    return score_comparison(union_metrics(fit_metrics(spark, sf_dir), label_metrics(spark, sf_dir)))


@query(
    "saved_run_rows",
    f"WITH {SQL_CLUSTERED} SELECT vec_id AS row_id, label, cluster FROM clustered",
)
def saved_run_rows(spark, sf_dir):
    """Run products saved twice and read back through the newest run of the method."""
    rows = clustered(spark, sf_dir).select("row_id", "label", "cluster")
    path = fresh_path(spark, "runs")
    for sig in ("first", "second"):
        save_run(rows, path, "embeddings", "encoder", sig, {"k": 4})
    return load_run(spark, path, "embeddings", "encoder")


@query(
    "projection_view",
    f"""WITH axes AS ({SQL_COMPONENTS}), {SQL_CLUSTERED}
SELECT row_id, x, y, 'class-' || label AS label_name, cluster FROM axes JOIN clustered ON vec_id = row_id""",
)
def viewed_projection(spark, sf_dir):
    """Coordinates, true label and cluster of every vector."""
    data = clustered(spark, sf_dir)
    view = projection_view(pca(vectors(spark, sf_dir), 2), vector_corpus(spark, sf_dir), data)
    return view.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in "xy"})


@query("tfidf_run_products")
def tfidf_run_products(spark, sf_dir):
    run = run_representation(document_corpus(spark, sf_dir), "tfidf", "documents", Settings(reducer="pca"))
    return run.products()


@query("encoder_run_metrics")
def encoder_run_metrics(spark, sf_dir):
    return run_representation(document_corpus(spark, sf_dir), "encoder", "documents").metrics


@query("word_run_future")
def word_run_future(spark, sf_dir):
    corpus = document_corpus(spark, sf_dir)
    settings = Settings(reducer="pca")
    run = run_representation(corpus, "words", "documents", settings, word_vectors=hashed_word_vectors(corpus))
    return run.future()


@query(
    "labelling_run_metrics",
    f"""WITH {SQL_LABELLED}, classes AS (SELECT lang AS c FROM labelled UNION SELECT said FROM labelled),
sums AS (SELECT c, count(*) FILTER (lang = c AND said = c) AS tp, count(*) FILTER (lang = c) AS support,
                count(*) FILTER (said = c) AS said FROM classes, labelled GROUP BY c)
SELECT 'llm-zero' AS Method, 'documents' AS Data, NULL::DOUBLE AS LR_F1_weighted,
       round(sum(tp) / sum(support), 6) AS LLM_Accuracy,
       round(sum(support * 2 * tp / (support + said)) / sum(support), 6) AS LLM_F1_weighted, 'keywords' AS LLM_model_name
FROM sums""",
)
def labelling_run_metrics(spark, sf_dir):
    row = run_labelling(language_corpus(spark, sf_dir), KeywordLabeler(KEYWORDS), data="documents")[1]
    rounded = [F.round(c, 6).alias(c) for c in ("LLM_Accuracy", "LLM_F1_weighted")]
    return row.select("Method", "Data", "LR_F1_weighted", *rounded, "LLM_model_name")
