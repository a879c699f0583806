"""Report tables: scores side by side, and the view data of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.functions.text import short_model, title_case
from chronotext.sources.stores import MODEL_COLUMN

# The score columns that are compared, and the suffix of classifier methods.
SCORE_COLUMNS = {"LR_F1_weighted": "LR", "LLM_F1_weighted": "LLM"}
CLASSIFIER_SUFFIX = "-lr"


def scores_long(metrics: DataFrame) -> DataFrame:
    """(.., type, f1): one row per score that is there."""
    ids = [c for c in metrics.columns if c not in SCORE_COLUMNS]
    named = metrics.select(*ids, *[F.col(c).alias(kind) for c, kind in SCORE_COLUMNS.items()])
    return named.unpivot(ids, list(SCORE_COLUMNS.values()), "type", "f1").where("f1 IS NOT NULL AND NOT isnan(f1)")


def simple_scores(metrics: DataFrame) -> DataFrame:
    """(Method, type, f1), the plain form without model or train fraction."""
    return scores_long(metrics).select("Method", "type", "f1")


def score_comparison(metrics: DataFrame, sort: str | None = "desc") -> DataFrame:
    """(label, f1, family): one line per configuration, best first (`desc`), worst first (`asc`) or as it comes."""
    if MODEL_COLUMN not in metrics.columns:
        metrics = metrics.withColumn(MODEL_COLUMN, F.lit(None).cast("string"))
    long = scores_long(metrics)
    method = F.coalesce("Method", F.lit(""))
    base = F.upper(F.replace(method, F.lit(CLASSIFIER_SUFFIX), F.lit("")))
    fraction = F.when(~F.isnan("TrainFrac"), F.col("TrainFrac"))
    percent = F.bround(fraction * 100).cast("int").cast("string")
    trained = F.coalesce(F.concat(F.lit("train="), percent, F.lit("%")), F.lit(""))
    dash = F.instr(method, "-")
    style = F.when(dash > 0, F.substring(method, dash + 1, F.length(method))).otherwise(method)
    is_fit = F.col("type") == "LR"
    label = F.when(is_fit, F.concat(base, F.lit(" LR\n"), trained)).otherwise(
        F.concat(F.lit("LLM "), title_case(style), F.lit("\n"), short_model(F.col(MODEL_COLUMN)))
    )
    family = F.when(is_fit, F.concat(F.lit("LR-"), base)).otherwise(F.concat(F.lit("LLM-"), style))
    lines = long.select(F.btrim(label, F.lit(" \n")).alias("label"), "f1", family.alias("family"))
    if sort == "desc":
        return lines.orderBy(F.col("f1").desc(), "label")
    if sort == "asc":
        return lines.orderBy(F.col("f1").asc(), "label")
    return lines


def projection_view(coords: DataFrame, corpus: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Coordinates with the true label, and with the cluster when clusters are given."""
    view = coords.join(corpus.select("row_id", "label_name"), "row_id")
    return view if clusters is None else view.join(clusters.select("row_id", "cluster"), "row_id")
