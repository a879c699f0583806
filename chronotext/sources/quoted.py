"""Quoted CSV read in byte ranges: a range learns from those before it whether it starts inside quotes.

Spark cuts a text file into ranges of lines. A line is read under both assumptions, that it starts inside quotes and that
it does not, which makes a range a function from one bit to one bit. Composing these functions along a file (a prefix scan
over one small row for each range) tells every range how it starts; then each range puts its own records together, and only
the pieces of records that cross a range's edge are moved. Nothing depends on how many lines a record has.

A file without line breaks inside quotes needs none of this. Its first line starts outside quotes; if every line that starts
outside also ends there, each line is a record. One pass finds out, which tells most lines by string functions alone.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.session import stage

OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}
#: Records of one batch that goes back to Spark, in characters.
BATCH_CHARS = 1 << 24
#: What a record is to its range: whole, the rest of one begun before, or one that goes on behind the range.
WHOLE, REST, BEGUN = 0, 1, 2

_QUOTED = re.compile(r'(?:[^"]++|"")*+')
#: Lines that start and end outside quotes: fields with quotes around them, or without a quote at their beginning.
_FIELD = r'(?:"(?:[^"]|"")*"(?:[^",][^,]*)?|[^",][^,]*|)'
_CLOSED = f"^{_FIELD}(?:,{_FIELD})*$"
_RANGE_KIND = "file string, start bigint, outside boolean, inside boolean"
_RECORD_KIND = "file string, start bigint, number bigint, kind int, record string"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether quotes are open behind `line`; only a quote that begins a field opens them, a doubled one is text."""
    if not inside and not line.startswith('"'):
        at = line.find(',"')
        if at < 0:
            return False
        at += 2
    else:
        at = 0 if inside else 1
    while True:
        at = _QUOTED.match(line, at).end()
        if at == len(line):
            return True
        at = line.find(',"', at + 1)
        if at < 0:
            return False
        at += 2


def _ranges(lines: DataFrame) -> DataFrame:
    """(file, start, outside, inside): for each range, whether quotes are open at its end, by how it starts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, outside, inside = None, False, True
        for batch in batches:
            done = []
            files, starts = batch["file"].to_pylist(), batch["start"].to_pylist()
            for file, start, line in zip(files, starts, batch["value"].to_pylist()):
                if (file, start) != here:
                    if here is not None:
                        done.append((*here, outside, inside))
                    here, outside, inside = (file, start), False, True
                if '"' in line:
                    outside, inside = ends_inside(line, outside), ends_inside(line, inside)
            if done:
                yield _batch(done, _RANGE_ARROW)
        if here is not None:
            yield _batch([(*here, outside, inside)], _RANGE_ARROW)

    return lines.select("file", "start", "value").mapInArrow(each, _RANGE_KIND)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_RANGE_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_())])
_RECORD_ARROW = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("number", pa.int64()), ("kind", pa.int32()), ("record", pa.string())]
)


def _entered(ranges: DataFrame) -> DataFrame:
    """(file, start, entered): whether a range starts inside quotes, composed from the ranges before it in its file.

    A range either ends alike however it starts, or keeps the bit, or turns it. So the bit at a start is that of the last
    range of the first sort, turned as often as ranges turned it since.
    """
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("outside") & ~F.col("inside")).cast("int")
    counted = ranges.withColumn("turns", F.sum(turns).over(upto))
    settled = F.when(F.col("outside") == F.col("inside"), F.col("outside").cast("int") + F.col("turns"))
    bit = F.coalesce(F.last(settled, ignorenulls=True).over(before), F.lit(0))
    turned = F.coalesce(F.last("turns").over(before), F.lit(0))
    return counted.select("file", "start", ((bit + turned) % 2 == 1).alias("entered"))


def _records(lines: DataFrame) -> DataFrame:
    """Records of every range, from its lines in order with the bit `entered`."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, inside, open_lines, number, kind = None, False, [], 0, WHOLE
        out, chars = [], 0

        def close(how: int) -> None:
            nonlocal open_lines, number, chars
            record = "\n".join(open_lines)
            out.append((*here, number, how, record))
            open_lines, number, chars = [], number + 1, chars + len(record)

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("file", "start", "entered", "value")]
            for file, start, entered, line in zip(*columns):
                if (file, start) != here:
                    if open_lines:
                        close(REST if kind == REST else BEGUN)
                    here, inside, number = (file, start), entered, 0
                    kind = REST if entered else WHOLE
                open_lines.append(line)
                if inside or '"' in line:
                    inside = ends_inside(line, inside)
                if not inside:
                    if kind == WHOLE and line in ("", "\r") and len(open_lines) == 1:
                        open_lines = []  # a blank line between records
                    else:
                        close(kind)
                    kind = WHOLE
                if chars >= BATCH_CHARS:
                    yield _batch(out, _RECORD_ARROW)
                    out, chars = [], 0
        if open_lines:
            close(REST if kind == REST else BEGUN)
        if out:
            yield _batch(out, _RECORD_ARROW)

    return lines.select("file", "start", "entered", "value").mapInArrow(each, _RECORD_KIND)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def closes(line: Column) -> Column:
    """True when a line that starts outside quotes is seen to end outside them: it has none, or plain fields all in quotes."""
    bare = F.when(F.endswith(line, F.lit("\r")), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    return (F.instr(line, '"') == 0) | F.replace(bare, F.lit('","'), F.lit("")).rlike(r'^"[^"]*+"\z')


@F.arrow_udf(T.BooleanType())
def _ends_outside(lines: pa.Array) -> pa.Array:
    return pc.match_substring_regex(lines, _CLOSED)


def _files(lines: DataFrame) -> DataFrame:
    """(file, first, broken): the place of the first line that is not blank, and whether a record has several lines."""
    first = F.min(F.when((F.col("start") == 0) & ~F.col("value").isin("", "\r"), F.col("at")))
    files = stage(lines.groupBy("file").agg(first.alias("first"), F.max(~closes(F.col("value"))).alias("unsure")), "csv-files")
    if files.where("unsure").isEmpty():
        return files.withColumnRenamed("unsure", "broken")
    unsure = lines.where(~closes(F.col("value"))).join(files.where("unsure").select("file"), "file", "left_semi")
    broken = unsure.where(~_ends_outside("value")).select("file", F.lit(True).alias("broken")).distinct()
    return stage(files.join(broken, "file", "left").select("file", "first", F.coalesce("broken", F.lit(False)).alias("broken")), "csv-files")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, number, record): the records of the files at `path`; (start, number) is their order in a file.

    Line breaks inside quotes are kept; blank lines between records and a carriage return at a record's end are not
    part of any. Quotes that are never closed make one record of the rest of their file, as they do for any reader.
    """
    lines = _lines(spark, path)
    files = _files(lines)
    n_broken, n_plain = (files.where(c).count() for c in ("broken", "NOT broken"))
    plain = lines.where(~F.col("value").isin("", "\r")).join(files.where("NOT broken").select("file", "first"), "file")
    plain = plain.select(
        "file",
        "start",
        F.when(F.col("start") == 0, F.col("at") - F.col("first")).otherwise(F.col("at")).alias("number"),
        F.regexp_replace("value", r"\r\z", "").alias("record"),
    )
    if not n_broken:
        return plain
    if not n_plain:
        return _across_lines(lines)
    broken = lines.join(files.where("broken").select("file"), "file", "left_semi")
    return plain.unionByName(_across_lines(broken))


def _across_lines(lines: DataFrame) -> DataFrame:
    """The same of files whose records have line breaks inside quotes."""
    # one small row for each range; the planner broadcasts the table if its measured size allows
    entered = stage(_entered(_ranges(lines)), "csv-ranges")
    # `at` keeps the order of lines whichever join is chosen; after a broadcast they come sorted already
    known = lines.join(entered, ["file", "start"]).sortWithinPartitions("file", "start", "at")
    parts = _records(known)
    crossing = stage(parts.where(F.col("kind") != WHOLE), "csv-crossing")  # two a range at most
    order = Window.partitionBy("file").orderBy("start", "number").rowsBetween(Window.unboundedPreceding, 0)
    piece = F.struct("start", "number", "record")
    joined = (
        crossing.withColumn("_nth", F.sum((F.col("kind") == BEGUN).cast("int")).over(order))
        .groupBy("file", "_nth")
        .agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
        .select(
            "file",
            F.col("pieces")[0]["start"].alias("start"),
            F.col("pieces")[0]["number"].alias("number"),
            F.array_join(F.col("pieces.record"), "\n").alias("record"),
        )
    )
    records = parts.where(F.col("kind") == WHOLE).drop("kind").unionByName(joined)
    return records.withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def read_quoted(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A quoted CSV table with a header in each file; all columns are strings unless a schema is given.

    One file of any size is read by all tasks. A compressed file cannot be cut and stays one range. The header is the
    first record of a file that is not blank; it is looked for in the file's first range.
    """
    if schema is None:
        # only the first record is read for this
        schema = spark.read.options(header=True, **OPTIONS).csv(path).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if not schema.fields:
        return spark.createDataFrame([], schema)
    body = read_records(spark, path).where("start > 0 OR number > 0")
    # from_csv takes its schema as text, where names would have to be quoted: plain names inside, the real ones outside
    plain = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema.fields))
    parsed = body.select(F.from_csv("record", plain, OPTIONS).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(f.name) for i, f in enumerate(schema.fields)])


register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package
