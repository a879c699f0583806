"""Corpus tables: reading, normalising to one schema, writing.

A corpus has columns `row_id long, text string, label_name string, timestamp timestamp, label int`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.functions.text import has_text, strip
from chronotext.operators.ranking import number_in_order, positions
from chronotext.session import stage
from chronotext.sources.quoted import read_quoted

# Fixed values of the normalised schema.
ORIGIN = "2020-01-01"
NO_LABEL = "unlabeled"
UNMAPPED = -1
SAVED_COLUMNS = "row_id bigint, text string, label_name string, timestamp timestamp, label int"

# Spellings of a time besides the ISO form: (shape, format), the first shape that fits is read; month before day.
TIME_FORMATS = (
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
)


def read_table(spark: SparkSession, path: str, fmt: str = "csv", schema: str | T.StructType | None = None) -> DataFrame:
    """Any user table. CSV needs no inference pass: columns stay strings unless a schema is given."""
    if fmt == "csv":
        return read_quoted(spark, path, schema)
    reader = spark.read.format(fmt)
    return (reader if schema is None else reader.schema(schema)).load(path)


def read_corpus(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A saved corpus. Refused when the time or label column is missing; a value that is not of its type becomes null."""
    raw = read_table(spark, path, fmt)
    missing = [c for c in ("timestamp", "label_name") if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    types = {f.name: f.dataType for f in T.StructType.fromDDL(SAVED_COLUMNS).fields}
    return raw.select(*[F.col(c).try_cast(types.get(c, raw.schema[c].dataType)).alias(c) for c in raw.columns])


def parsed_time(value: Column, kind: T.DataType, formats: Sequence[tuple[str, str]] = TIME_FORMATS) -> Column:
    """ISO times, then those of `formats`; null for any other text."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return value.cast("timestamp")
    said = strip(value.cast("string"))
    spelled = [F.when(said.rlike(shape), F.try_to_timestamp(said, F.lit(form))) for shape, form in formats]
    return F.coalesce(F.try_to_timestamp(said), *spelled)


def day_after_origin(row_id: Column, origin: str = ORIGIN) -> Column:
    """The origin plus `row_id` days; an error beyond the last day a timestamp can hold."""
    return F.timestamp_add("DAY", row_id.cast("int"), F.lit(origin).cast("timestamp"))


def label_codes(named: DataFrame, label_col: str = "label_name", order: Sequence[str] = ()) -> DataFrame:
    """(label_name, label): codes 0..K-1 by sorted name; null names get no code.

    Names of `order` have their place there as code, whether the others occur or not; the rest follow by name.
    """
    if len(set(order)) != len(order):
        raise ValueError("a label is named twice in the order")
    names = named.select(F.col(label_col).alias("label_name")).where("label_name IS NOT NULL").distinct()
    if order:
        place = F.array_position(F.lit(list(order)), F.col("label_name"))
        given = names.where(place > 0).withColumn("label", place - 1)
        rest = positions(names.where(place == 0), ["label_name"], "label")
        coded = given.unionByName(rest.withColumn("label", F.col("label") + len(order)))
    else:
        coded = positions(names, ["label_name"], "label")
    return stage(coded.select("label_name", F.col("label").cast("int").alias("label")), "label-codes")


def with_label_codes(named: DataFrame) -> DataFrame:
    codes = label_codes(named)
    return named.join(codes, "label_name", "left").withColumn("label", F.coalesce("label", F.lit(UNMAPPED)))


def renamed_labels(label: Column, rename: Mapping[str, str] | None) -> Column:
    """Stripped label, replaced by the map when it has the name."""
    name = strip(label.cast("string"))
    if not rename:
        return name
    table = F.create_map(*[F.lit(x) for pair in rename.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), name)


def normalise(
    df: DataFrame,
    text_col: str = "text",
    label_col: str | None = None,
    timestamp_col: str | None = None,
    rename: Mapping[str, str] | None = None,
    order_by: str | None = None,
    origin: str = ORIGIN,
    label_order: Sequence[str] = (),
) -> DataFrame:
    """Bring any table to the corpus schema.

    Rows with null or blank text are dropped and the rest numbered 0..n-1: by the column `order_by`, nulls last and equal
    values by digest of the text, label and time, or in file order when none is given. A missing or unreadable time becomes `origin` plus `row_id` days. Without a label
    column every row is `unlabeled` with code 0; a null label is `unlabeled` too. Codes follow `label_order`, then the names.
    """
    if text_col not in df.columns:
        raise ValueError(f"no text column '{text_col}' among {df.columns}")
    has_label = label_col is not None and label_col in df.columns
    has_time = timestamp_col is not None and timestamp_col in df.columns
    missing_time = F.lit(None).cast("timestamp")
    kept = df.where(has_text(F.col(text_col).cast("string"))).select(
        strip(F.col(text_col).cast("string")).alias("text"),
        (F.coalesce(renamed_labels(F.col(label_col), rename), F.lit(NO_LABEL)) if has_label else F.lit(NO_LABEL)).alias(
            "label_name"
        ),
        (parsed_time(F.col(timestamp_col), df.schema[timestamp_col].dataType) if has_time else missing_time).alias(
            "timestamp"
        ),
        *([F.col(order_by).alias("_key")] if order_by else []),
    )

    if order_by:
        # the rows move once, in the sort; the last key spreads repeated rows over tasks
        keyed = kept.withColumns({"_digest": F.sha2("text", 256), "_row": F.monotonically_increasing_id()})
        order = [F.col("_key").asc_nulls_last(), "_digest", "label_name", F.col("timestamp").asc_nulls_last(), "_row"]
        numbered = positions(keyed, order, "row_id").drop("_key", "_digest", "_row")
    else:
        numbered = number_in_order(kept, "row_id")
    if has_label:
        coded = numbered.join(label_codes(numbered, order=label_order), "label_name", "left")
    else:
        coded = numbered.withColumn("label", F.lit(0))
    return coded.select(
        "row_id",
        "text",
        "label_name",
        F.coalesce("timestamp", day_after_origin(F.col("row_id"), origin)).alias("timestamp"),
        F.col("label").cast("int").alias("label"),
    )


def write_corpus(corpus: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = corpus.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(header=True, quote='"', escape='"', quoteAll=True)
    writer.save(path)


def load_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], fmt: str = "parquet", regen: bool = False
) -> DataFrame:
    """Reuse the corpus at `path`, or build and save it when it is not there or `regen` is set."""
    if not regen:
        try:
            return read_corpus(spark, path, fmt)
        except AnalysisException as gone:
            if gone.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    write_corpus(build(), path, fmt)
    return read_corpus(spark, path, fmt)
