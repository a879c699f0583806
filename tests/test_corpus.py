import pytest
from pyspark.sql import functions as F

from chronotext.functions.text import ngrams, terms, title_case, words
from chronotext.operators.trends import code_names, future_reconstruction, monthly_shares, ordered_labels
from chronotext.sources.corpus import load_or_build, normalise, read_corpus, write_corpus
from chronotext.sources.wordvectors import read_word_vectors
from chronotext.operators.wordaverage import average_vectors


def test_normalise_edge_rows(spark):
    raw = spark.createDataFrame(
        [(1, " a b ", " x ", "2024-05-01"), (2, "   ", "x", "2024-05-01"), (3, None, "y", None), (4, "\tc\xa0", None, "nope"), (5, "d", "y", None)],
        "id int, body string, stance string, posted string",
    )
    got = normalise(raw, "body", "stance", "posted", {"x": "z"}, order_by="id").orderBy("row_id").collect()
    assert [(r.row_id, r.text, r.label_name, str(r.timestamp), r.label) for r in got] == [
        (0, "a b", "z", "2024-05-01 00:00:00", 2),
        (1, "c", "unlabeled", "2020-01-02 00:00:00", 0),
        (2, "d", "y", "2020-01-03 00:00:00", 1),
    ]


def test_normalise_keeps_rows_with_null_and_repeated_keys(spark):
    raw = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (2, "d"), (2, "d"), (None, "e")], "id int, text string")
    got = normalise(raw, order_by="id").orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(6)) and got[0].text == "a"
    assert sorted(r.text for r in got[1:4]) == ["c", "d", "d"] and sorted(r.text for r in got[4:]) == ["b", "e"]


def test_time_spellings(spark):
    said = ["2024-05-13", "2024/05/13", "05/13/2024", "May 13, 2024", "13 May 2024", "January 2, 2024", "3 Feb 2024", "13/13/2024", "x"]
    raw = spark.createDataFrame([(i, "t", x) for i, x in enumerate(said)], "id int, text string, at string")
    got = [str(r.timestamp)[:10] for r in normalise(raw, timestamp_col="at", order_by="id").orderBy("row_id").collect()]
    assert got == ["2024-05-13"] * 5 + ["2024-01-02", "2024-02-03", "2020-01-08", "2020-01-09"]


def test_codes_in_a_given_order(spark):
    raw = spark.createDataFrame([(i, "t", x) for i, x in enumerate(["b", "a", "z", "c", None])], "id int, text string, lab string")
    got = normalise(raw, label_col="lab", order_by="id", label_order=("z", "y", "b")).collect()
    assert {r.label_name: r.label for r in got} == {"z": 0, "b": 2, "a": 3, "c": 4, "unlabeled": 5}
    with pytest.raises(ValueError):
        normalise(raw, label_col="lab", label_order=("z", "z"))


def test_normalise_without_labels_in_file_order(spark):
    raw = spark.createDataFrame([("b",), ("",), ("a",)], "text string").coalesce(1)
    got = normalise(raw).orderBy("row_id").collect()
    assert [(r.row_id, r.text, r.label_name, r.label) for r in got] == [(0, "b", "unlabeled", 0), (1, "a", "unlabeled", 0)]
    with pytest.raises(ValueError):
        normalise(raw, text_col="missing")


def test_csv_round_trip_and_refusal(spark, tmp_path):
    raw = spark.createDataFrame([('say "hi",\nthere', "x"), ("plain", "y")], "text string, lab string")
    corpus = normalise(raw, label_col="lab")
    path = str(tmp_path / "corpus")
    write_corpus(corpus, path, "csv")
    assert sorted(r.text for r in read_corpus(spark, path).collect()) == sorted(r.text for r in corpus.collect())
    write_corpus(corpus.drop("timestamp"), str(tmp_path / "bare"), "csv")
    with pytest.raises(ValueError):
        read_corpus(spark, str(tmp_path / "bare"))


def test_load_or_build_reuses(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return normalise(spark.createDataFrame([("a",)], "text string"))

    path = str(tmp_path / "saved")
    for regen in (False, False, True):
        assert load_or_build(spark, path, build, regen=regen).count() == 1
    assert len(built) == 2


def test_tokens_and_ngrams(spark):
    row = spark.createDataFrame([("Don't x A1b-c it's ÜBER 3_d",)], "t string")
    got = row.select(words(F.col("t")).alias("w"), terms(F.col("t")).alias("m")).first()
    assert got.w == ["don't", "b-c", "it's", "ber"]
    assert got.m == ["don", "a1b", "it", "über", "3_d"]
    lists = spark.createDataFrame([(["a"],), (["a", "b", "c"],), ([],)], "m array<string>")
    assert [r[0] for r in lists.select(ngrams(F.col("m"), 1, 2)).collect()] == [["a"], ["a", "b", "c", "a b", "b c"], []]
    assert row.select(title_case(F.lit("few-shot style"))).first()[0] == "Few-Shot Style"


def test_shares_and_names(spark):
    corpus = spark.createDataFrame(
        [(0, "a", "2024-01-01", 0), (1, "b", "2024-01-05", 0), (2, "a", "2024-02-01", 1), (3, "a", "2024-02-03", 0)],
        "row_id bigint, label_name string, t string, label int",
    ).withColumn("timestamp", F.to_timestamp("t"))
    shares = {(str(r.month)[:7], r.label_name): r.share for r in monthly_shares(corpus).collect()}
    assert shares == {("2024-01", "a"): 0.5, ("2024-01", "b"): 0.5, ("2024-02", "a"): 1.0}
    assert {r.label: r.label_name for r in code_names(corpus).collect()} == {0: "b", 1: "a"}
    mixed = corpus.union(corpus.select(F.col("row_id") + 10, F.lit("c"), "t", "label", "timestamp").limit(1))
    assert {r.label: r.label_name for r in code_names(mixed, majority=True).collect()}[0] in ("a", "b")
    assert {r.label: r.label_name for r in code_names(corpus.where("row_id <> 1"), majority=True).collect()} == {0: "a", 1: "a"}
    order = [r.label_name for r in ordered_labels(corpus.union(corpus.withColumn("label_name", F.lit(" "))), preferred=("b", "q")).collect()]
    assert order == ["b", "a"]

    split = corpus.withColumn("split", F.when(F.col("row_id") > 0, "test").otherwise("train"))
    predicted = spark.createDataFrame([(1, 7), (2, 1), (3, 0)], "row_id bigint, pred int")
    got = {(str(r.month)[:7], r.label_name): (r.true_share, r.pred_share) for r in future_reconstruction(split, predicted).collect()}
    assert got == {
        ("2024-01", "a"): (0.0, 0.0), ("2024-01", "b"): (1.0, 0.0), ("2024-01", "7"): (0.0, 1.0),
        ("2024-02", "a"): (1.0, 0.5), ("2024-02", "b"): (0.0, 0.5), ("2024-02", "7"): (0.0, 0.0),
    }
    with pytest.raises(ValueError):
        future_reconstruction(split.where("split = 'train'"), predicted)


def test_word_vectors_from_text(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 3\nred 1 0 0.5\nsky 0 2 1\n")
    table = read_word_vectors(spark, str(tmp_path / "v.txt"), "text")
    corpus = spark.createDataFrame([(0, "Red red sky unseen"), (1, "nothing known"), (2, "1 2")], "row_id bigint, text string")
    got = {r.row_id: r.features for r in average_vectors(corpus, table).collect()}
    assert got[0] == pytest.approx([2 / 3, 2 / 3, 2 / 3]) and got[1] == got[2] == [0.0, 0.0, 0.0]
