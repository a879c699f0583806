"""Quoted CSV in byte ranges against Python's own reader, with ranges far smaller than records."""

import csv
import io
import random

import pytest

from chronotext.sources.quoted import ends_inside, read_quoted, read_records

SMALL = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize(
    "line, inside, after",
    [
        ("a,b", False, False), ('"a', False, True), ('"a""', False, True), ('"a"', False, False), ('5" disk,x', False, False),
        ('x,"y', False, True), ('y",z', True, False), ('y"",z', True, True), ("", True, True), ("", False, False),
        ('",', True, False), ('","', True, True), ('"a"b,"c', False, True), (',"', False, True), ('""', False, False),
    ],
)
def test_line_bits(line, inside, after):
    assert ends_inside(line, inside) is after


def _rows(seed, n):
    rng = random.Random(seed)
    bits = ['"', ",", "\n", "\r\n", "word", "é", " ", '""', "\n\n", ',"', "x" * 40]
    return [[str(i), "".join(rng.choices(bits, k=rng.randrange(1, 30 if i % 9 else 300))), rng.choice(["a", "b,c", 'd"'])] for i in range(n)]


@pytest.mark.parametrize("terminator", ["\n", "\r\n"])
def test_records_across_ranges_equal_a_reader_of_whole_files(small_ranges, tmp_path, terminator):
    wanted = []
    for part in range(3):
        rows = _rows(part, 200)
        with open(tmp_path / f"part-{part}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator=terminator)
            writer.writerow(["id", 'the "text"', "c.d"])
            writer.writerows(rows)
        wanted += [tuple(r) for r in rows]
    got = read_quoted(small_ranges, str(tmp_path))
    assert got.columns == ["id", 'the "text"', "c.d"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(wanted)
    ranges = read_records(small_ranges, str(tmp_path)).select("file", "start").distinct().count()
    assert ranges > 30


def test_one_record_over_many_ranges_and_order(small_ranges, tmp_path):
    rows = [["0", "plain"], ["1", "line\n" * 500 + ',"' * 50], ["2", ""], ["3", "5 \" disk"]]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows([["id", "text"], *rows])
    (tmp_path / "one.csv").write_text("\n" + text.getvalue() + "\n\n")
    records = read_records(small_ranges, str(tmp_path)).orderBy("start", "number").collect()
    assert [next(csv.reader(io.StringIO(r.record, newline="")))[0] for r in records] == ["id", "0", "1", "2", "3"]
    got = {r.id: r.text for r in read_quoted(small_ranges, str(tmp_path), "id int, text string").collect()}
    assert got == {0: "plain", 1: rows[1][1], 2: None, 3: '5 " disk'}


def test_open_quotes_and_empty_files(small_ranges, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,x\n2,"never closed\n3,y\n')
    got = {r.id: r.text for r in read_quoted(small_ranges, str(tmp_path / "a.csv")).collect()}
    assert got["1"] == "x" and set(got) == {"1", "2"} and "3,y" in got["2"]
    (tmp_path / "b.csv").write_text("id,text\n")
    empty = read_quoted(small_ranges, str(tmp_path / "b.csv"))
    assert empty.columns == ["id", "text"] and empty.count() == 0
    (tmp_path / "c.csv").write_text("")
    assert read_quoted(small_ranges, str(tmp_path / "c.csv")).count() == 0
