"""Days beyond the year 9999, which row numbers from 2,914,635 on become."""

from pyspark.sql import functions as F

from chronotext.catalog.corpora import iso
from chronotext.sources.corpus import day_after_origin


def test_days_of_five_digit_years_are_written_as_sql_writes_them(spark):
    rows = spark.createDataFrame([(0,), (2914634,), (2914635,), (9000000,)], "row_id long")
    times = rows.select("row_id", day_after_origin(F.col("row_id")).alias("t"))
    got = times.select(iso("t").alias("day"), iso("t", "yyyy-MM").alias("month"), "row_id").orderBy("row_id").collect()
    assert [r["day"] for r in got] == ["2020-01-01", "9999-12-31", "10000-01-01", "26661-03-01"]
    assert [r["month"] for r in got] == ["2020-01", "9999-12", "10000-01", "26661-03"]
