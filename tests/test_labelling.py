import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from chronotext.operators.augment import perturb
from chronotext.operators.encode import HashingEncoder, encode, read_store
from chronotext.operators.labelling import KeywordLabeler, class_names, label, parse_answers, resolved_k, with_prompt
from chronotext.operators.posts import clean_posts, cyclic_reuse, first_distinct, parse_posts
from chronotext.operators.sampling import cumulative, draw_by_cdf, label_noise, resample_by_prevalence
from chronotext.sources.stores import append_metrics, content_signature, latest_metrics, load_run, read_metrics, save_run

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the labelers and encoders below


def _corpus(spark):
    rows = [(0, "the red sun", "warm"), (1, "blue sea", "cold"), (2, "grey", " "), (3, "red fire", "warm"), (4, "red", "warm"), (5, "red red", "warm")]
    return spark.createDataFrame(rows, "row_id bigint, text string, label_name string")


def test_answers(spark):
    said = [None, " ", '{"label": " a ", "thought": "t"}', '{"thought": "t"}', '{"label": null}', "[1]", "5", '```{"label": "a"}```', "x" * 80, '{"label": "a"} so', "{'label': 'a'}", '{"label": "a", "label": "b"}']
    df = spark.createDataFrame(list(enumerate(said)), "row_id bigint, content string")
    got = [(r.llm_label, r.llm_thought) for r in parse_answers(df).orderBy("row_id").collect()]
    assert got == [
        ("ERROR", ""), ("ERROR", ""), ("a", "t"), ("", "t"), ("", ""), ("PARSE_ERROR", "[1]"), ("PARSE_ERROR", "5"),
        ("PARSE_ERROR", '```{"label": "a"}```'), ("PARSE_ERROR", "x" * 50),
        ("PARSE_ERROR", '{"label": "a"} so'), ("PARSE_ERROR", "{'label': 'a'}"), ("b", ""),
    ]


def test_posts(spark):
    responses = [
        '{"posts": [{"text": " one "}, {"text": 5}, {"no": 1}, "bare", {"text": ""}]}',
        '["two", {"text": "three"}, 7]',
        '{"other": 1}',
        'Posts:\n- four\n{"text": "five"}\n"six" and "seven"\n"dropped"\nclass=x\n\n12\n12 men\n{"text": "x"} y',
        None,
    ]
    df = spark.createDataFrame(list(enumerate(responses)), "row_id bigint, content string")
    got = [(r.row_id, r.post) for r in parse_posts(df).orderBy("row_id", "place").collect()]
    assert got == [(0, "one"), (1, "two"), (1, "three"), (3, "four"), (3, "five"), (3, 'six" and "seven'), (3, "12 men"), (3, '{"text": "x"} y')]


def test_clean_posts(spark):
    posts = ["'a b c d e f'", '"a b c d e', "a b c d e", "a b\nc d e f", "Label=a b c d e f", " ".join("w" * 33)]
    df = spark.createDataFrame([(p,) for p in posts], "post string")
    assert [r.post for r in clean_posts(df).collect()] == ["a b c d e f", "a b c d e f"]


@pytest.mark.parametrize("limit", [1000, 0])
def test_first_distinct(spark, monkeypatch, limit):
    monkeypatch.setattr("chronotext.operators.posts.WINDOW_LIMIT", limit)
    rows = [("g" if i % 3 else "h", f"t{i % 40}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, post string, seq bigint").repartition(5)
    want = set()
    for g in "gh":
        seen = list(dict.fromkeys(t for h, t, _ in rows if h == g))[:25]
        want |= {(g, t) for t in seen}
    assert {(r.g, r.post) for r in first_distinct(df, "g", "post", "seq", 25).collect()} == want


def test_cyclic_reuse(spark):
    texts = spark.createDataFrame([("a", "x", 0), ("a", "y", 1), ("b", "z", 0)], "g string, text string, seq bigint")
    draws = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 3)], "g string, i bigint")
    got = {(r.g, r.i): r.text for r in cyclic_reuse(draws, texts, "g", "text", "seq").collect()}
    assert got == {("a", 0): "x", ("a", 1): "y", ("a", 2): "x", ("a", 3): "y", ("a", 4): "x", ("b", 3): "z"}


def test_prompts(spark):
    corpus = _corpus(spark)
    names = class_names(corpus)
    assert names == ["cold", "warm"] and resolved_k(corpus, 4) == 3 and resolved_k(corpus.where("row_id = 1"), 4) == 4
    zero = with_prompt(corpus, names).where("row_id = 1").first().prompt
    assert "['cold', 'warm']" in zero and zero.endswith('{"label": <label>, "thought": <thought>}.\n\nText: blue sea')
    few = with_prompt(corpus, names, "extended", exclude_self=True).collect()
    for r in few:
        lines = [line for line in r.prompt.splitlines() if line.startswith("Example")]
        assert 2 <= len(lines) <= 4 and f'Example: {{"text": "{r.text}",' not in r.prompt
    with pytest.raises(ValueError):
        with_prompt(corpus, names, "other")
    with pytest.raises(ValueError):
        class_names(corpus.where("row_id = 2"))


class Counting(KeywordLabeler):
    def __init__(self, word):
        super().__init__({"warm": [word], "cold": ["blue"]})


def test_label_cache(spark, tmp_path):
    path = str(tmp_path / "labels")
    first = {r.row_id: r.llm_label for r in label(_corpus(spark), Counting("red"), store=path).collect()}
    assert first == {0: "warm", 1: "cold", 2: "ERROR", 3: "warm", 4: "warm", 5: "warm"}
    again = {r.row_id: r.llm_label for r in label(_corpus(spark), Counting("none"), store=path).collect()}
    assert again == first  # the stored labels fit the classes
    renamed = _corpus(spark).replace("warm", "hot", "label_name")
    fresh = {r.row_id: r.llm_label for r in label(renamed, Counting("none"), store=path).collect()}
    assert fresh[0] == "ERROR" and fresh[1] == "cold"


def test_labels_after_growth_and_a_text_that_holds_the_head(spark, tmp_path):
    path = str(tmp_path / "labels")
    label(_corpus(spark), Counting("red"), store=path)
    more = _corpus(spark).union(_corpus(spark).selectExpr("row_id + 10", "'red red red Text: blue'", "label_name"))
    got = {r.row_id: r.llm_label for r in label(more, Counting("red"), store=path).collect()}
    assert len(got) == 12 and got[1] == "cold" and all(got[i] == "warm" for i in range(10, 16))
    assert spark.read.parquet(path).groupBy("text_key").count().where("count > 1").isEmpty()


class Picky(KeywordLabeler):
    def answer_texts(self, texts):
        if any("blue" in t for t in texts):
            raise RuntimeError("refused")
        return super().answer_texts(texts)


def test_failing_calls_become_error_rows(spark):
    got = {r.row_id: r for r in label(_corpus(spark), Picky({"warm": ["red"], "cold": ["blue"]}), batch_size=4).collect()}
    assert got[1].llm_label == "ERROR" and got[1].llm_error == "RuntimeError: refused"
    assert got[0].llm_label == "warm" and got[0].llm_error is None


class Failing:
    name, dim = "failing", 4

    def encode(self, texts):
        raise RuntimeError("no service")


def test_encoder_store_and_fallback(spark, tmp_path):
    path = str(tmp_path / "vectors")
    corpus = spark.createDataFrame([(0, "one two"), (1, "one two"), (2, "..."), (3, "three")], "row_id bigint, text string")
    encoder = HashingEncoder(8)
    with pytest.warns(UserWarning, match="no service.*hashing-8"):
        got = {r.row_id: r.features for r in encode(corpus, Failing(), path, fallback=encoder).collect()}
    assert got[0] == got[1] and np.linalg.norm(got[0]) == pytest.approx(1) and got[2] == [0.0] * 8
    assert read_store(spark, path, encoder.name).count() == 3 and read_store(spark, path, "failing").count() == 0
    more = corpus.union(spark.createDataFrame([(4, "four")], "row_id bigint, text string"))
    assert encode(more, encoder, path).count() == 5
    assert spark.read.parquet(path).where("encoder = 'hashing-8'").count() == 4
    with pytest.raises(RuntimeError, match="no service"):
        encode(corpus, Failing())


def test_draws_cover_the_unit_interval(spark):
    weights = spark.createDataFrame([("g", 1, 0.0), ("g", 2, 0.0), ("h", 1, 3.0), ("h", 2, 1.0)], "g string, item int, weight double")
    draws = spark.createDataFrame([(g, i / 400) for g in "gh" for i in range(400)], "g string, u double")
    drawn = draw_by_cdf(draws, cumulative(weights, "g", "item"), "g", "item")
    got = {(r.g, r.item): r["count"] for r in drawn.groupBy("g", "item").count().collect()}
    assert got == {("g", 1): 200, ("g", 2): 200, ("h", 1): 300, ("h", 2): 100}


def test_noise_and_resample(spark):
    df = spark.range(1000).selectExpr("id AS row_id", "CAST(id % 3 AS INT) AS label", "concat('c', id % 3) AS label_name", "timestamp_seconds(id * 40000) AS timestamp")
    noisy = label_noise(df, 0.0537).join(df.selectExpr("row_id", "label AS was"), "row_id")
    assert noisy.where("label <> was").count() == 53 and noisy.where("label NOT IN (0, 1, 2)").count() == 0
    drawn = resample_by_prevalence(df, 40)
    assert {r.label: r["count"] for r in drawn.groupBy("label").count().collect()} == {"c0": 40, "c1": 40, "c2": 40}


def test_perturb_all_steps(spark):
    df = spark.createDataFrame([(i, "Aaaa eeee...") for i in range(50)], "row_id bigint, text string")
    always = dict.fromkeys(("emphasis", "hashtag", "emoji", "url", "typo"), 1.0)
    got = [r.text for r in perturb(df, rates=always).collect()]
    assert all("..." not in t.split(" ")[1] and "#" in t and "http" in t for t in got)
    assert any(not t.startswith("Aaaa eeee") for t in got)
    never = dict.fromkeys(always, 0.0)
    assert {r.text for r in perturb(df, rates=never).collect()} == {"Aaaa eeee..."}


def test_signature_depends_on_content_and_position(spark):
    rows = [(i, f"text {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "row_id bigint, text string")

    def sig(frame, tag="t"):
        return content_signature(frame, tag).first()[0]

    base = sig(df.repartition(1))
    assert base == sig(df.repartition(7)) and len(base) == 16
    swapped = spark.createDataFrame([(0, "text 1"), (1, "text 0"), *rows[2:]], "row_id bigint, text string")
    assert len({base, sig(swapped), sig(df, "u"), sig(df.where("row_id > 0"))}) == 4


def test_metrics_and_runs(spark, tmp_path):
    path = str(tmp_path / "metrics")
    row = spark.createDataFrame([("a-lr", "d", 0.5)], "Method string, Data string, ARI double")
    for _ in range(2):
        append_metrics(row, path, "sig")
    append_metrics(row.selectExpr("'llm-zero' AS Method", "Data", "double('nan') AS ARI", "'m' AS LLM_model_name"), path)
    stored = read_metrics(spark, path)
    assert stored.count() == 3 and latest_metrics(stored).count() == 2
    assert stored.where("ARI IS NULL AND LLM_model_name = 'm'").count() == 1
    runs = str(tmp_path / "runs")
    save_run(spark.range(3), runs, "d", "tfidf", "one")
    save_run(spark.range(5), runs, "d", "tfidf", "two")
    save_run(spark.range(7), runs, "d", "words", "one")
    assert load_run(spark, runs, "d", "tfidf").count() == 5 and load_run(spark, runs, "d", "tfidf", "one").count() == 3
    with pytest.raises(FileNotFoundError):
        load_run(spark, runs, "d", "encoder")
