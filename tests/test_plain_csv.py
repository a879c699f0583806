"""CSV whose records are lines: read without Python where every line closes its quotes, by the whole way where one does not."""

import csv
import itertools

import pytest

from chronotext.sources import quoted
from chronotext.sources.quoted import ends_inside, read_quoted


@pytest.fixture
def small_ranges(spark):
    small = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_lines_that_close_their_quotes(spark):
    """Every line of up to six of these characters, against the automaton; what is not seen at once is told by the pattern."""
    lines = ["".join(c) for n in range(7) for c in itertools.product('",a\r', repeat=n)]
    rows = spark.createDataFrame([(line,) for line in lines], "value string")
    got = {r.value: (r.sure, r.told) for r in rows.select("value", quoted.closes(rows.value).alias("sure"), quoted._ends_outside("value").alias("told")).collect()}
    assert all(told is not ends_inside(line, False) for line, (_, told) in got.items())
    assert all(told for _, (sure, told) in got.items() if sure) and got['"","a"'][0] and not got['"a""'][0]


@pytest.mark.parametrize("broken", [False, True])
def test_files_of_lines_and_others(small_ranges, tmp_path, monkeypatch, broken):
    if not broken:  # records that are lines never meet the Python reader
        monkeypatch.setattr(quoted, "_across_lines", None)
    want = []
    for part in range(3):
        rows = [[f"{part}-{i}", ["plain", 'a "quoted" word', "", "x,y", "é\t"][i % 5], str(i)] for i in range(150)]
        if broken and part == 1:
            rows[70][1] = 'two\nlines, "" and ,"'
        with open(tmp_path / f"part-{part}.csv", "w", newline="", encoding="utf-8") as out:
            out.write("\n\r\n" if part == 2 else "")
            csv.writer(out, lineterminator="\r\n" if part else "\n", quoting=csv.QUOTE_ALL if part else csv.QUOTE_MINIMAL).writerows([["id", "te,xt", "n"], *rows])
        want += [(a, b or None if not part else b, c) for a, b, c in rows]
    got = read_quoted(small_ranges, str(tmp_path))
    assert got.columns == ["id", "te,xt", "n"]
    assert sorted((r[0], r[1] or "", r[2]) for r in got.collect()) == sorted((a, b or "", c) for a, b, c in want)
