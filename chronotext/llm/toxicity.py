"""Toxicity by multiple-instance learning: a document is a bag of sentences and only the bag has a label.

A sentence's score is a logistic function of its distinct words and their stems (first letters). A document's score is
the noisy-or of its sentences: one minus the chance that none offends. The likelihood of the document labels trains the
sentence scorer, which then also tells which sentence offends.

The model is learned on a bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm.registry import query, table
from chronotext.llm.sampling import bounded_sample, bounded_texts, remainder
from chronotext.session import stage

#: Rows of each label that the model is learned on, and the longest text among them.
PER_LABEL, LEARN_BYTES = 2000, 1 << 20
#: Bytes of text of one label that are learned from.
LABEL_BYTES = 1 << 26
#: Feature columns (by hash), documents that must hold a feature, steps of the optimiser, penalty on squared weights.
COLUMNS, MIN_DOCUMENTS, STEPS, PENALTY = 1 << 20, 4, 100, 0.1
#: Fits, and the least weight that keeps a column for the next.
ROUNDS, KEEP = 3, 1.5
STEMS = (4, 5)
#: Words a task remembers the scores of.
REMEMBER = 100_000
SENTENCE, WORD = re.compile(r"[.!?\n]+"), re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Columns of a word: itself and its stems."""
    marked = ["=" + word] + [f"{n}{word[:n]}" for n in STEMS if len(word) >= n]
    return [zlib.crc32(m.encode("utf-8", "surrogatepass")) % COLUMNS for m in marked]


def sentences(text: str) -> list[str]:
    """Sentences of a text that hold a letter."""
    return [s for s in SENTENCE.split(text) if WORD.search(s)]


def learn(texts: list[str], toxic: list[int], weights: list[float]) -> tuple[float, np.ndarray]:
    """(bias, weight by column) that maximise the weighted likelihood of the documents' labels; Adam on all rows."""
    columns, sentence_of, document_of = array("i"), array("i"), array("i")
    known: dict[str, list[int]] = {}
    for document, text in enumerate(texts):
        for sentence in sentences(text):
            for word in set(WORD.findall(sentence.lower())):
                found = known.get(word)
                if found is None:
                    found = known[word] = features(word)
                columns.extend(found)
                sentence_of.extend([len(document_of)] * len(found))
            document_of.append(document)
    if not len(columns):
        return -math.inf, np.zeros(COLUMNS)
    col, sent, doc = (np.frombuffer(x, np.int32) for x in (columns, sentence_of, document_of))
    seen = np.unique(doc[sent].astype(np.int64) * COLUMNS + col) % COLUMNS
    usable = np.bincount(seen, minlength=COLUMNS) >= MIN_DOCUMENTS
    col, sent = col[usable[col]], sent[usable[col]]
    y, row_weight = np.array(toxic, float), np.array(weights, float)
    row_weight = row_weight / row_weight.sum() * len(y)
    ids = np.unique(col)
    for _ in range(ROUNDS):  # fitted again on the columns that turned out to matter, the noise of the others is gone
        kept = np.isin(col, ids)
        w = ascend(np.searchsorted(ids, col[kept]), sent[kept], doc, y, row_weight, len(ids))
        weight = np.zeros(COLUMNS)
        weight[ids], bias = w[:-1], float(w[-1])
        ids = ids[np.abs(w[:-1]) >= KEEP]
    return bias, weight


def ascend(col: np.ndarray, sent: np.ndarray, doc: np.ndarray, y: np.ndarray, row_weight: np.ndarray, n: int) -> np.ndarray:
    """Weights of `n` columns and, last, the bias: Adam on the likelihood of the bags' labels.

    `col[i]` occurs in sentence `sent[i]`; sentence s is in bag `doc[s]`.
    """
    w = np.zeros(n + 1)
    w[-1] = -6.0
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.clip(w[-1] + np.bincount(sent, w[col], len(doc)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(doc, np.log1p(np.exp(z)), len(y))  # minus the log of the chance that no sentence offends
        bag = np.maximum(-np.expm1(-none), 1e-12)
        pull = row_weight * np.where(y == 1, (1 - bag) / bag, -1.0)
        slope = pull[doc] * p
        grad = np.r_[np.bincount(col, slope[sent], n) - PENALTY * w[:-1], slope.sum()]
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        w += 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[float, np.ndarray]:
    """Learn from `docs` (doc_id, text) joined with `labels` (doc_id, toxic 0 or 1).

    Other label values and nulls are not used; of repeated labels the greatest counts. At most `per_label` rows of each
    label, within `LABEL_BYTES` a label, and texts up to `LEARN_BYTES` are learned from, each label weighted by its rows.
    Rows alike in id and text are learned from once, whatever number of rows an id has. No rows: every score is 0.
    """
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = stage(marks, "marks")
    totals = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    drawn = stage(bounded_sample(marks, "doc_id", "toxic", per_label), "drawn")  # at most 2 * per_label narrow rows
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= LEARN_BYTES).join(F.broadcast(drawn), "doc_id")
    rows = bounded_texts(rows, "toxic", per_label, LABEL_BYTES).toPandas().sort_values(["doc_id", "text"])
    share = rows["toxic"].map(rows["toxic"].value_counts())
    return learn(rows["text"].tolist(), rows["toxic"].tolist(), (rows["toxic"].map(totals) / share).tolist())


def scorer(bias: float, used: np.ndarray, values: np.ndarray) -> Callable[[str | None], tuple[float, str | None, float | None]]:
    """A function from a text to (score, sentence likeliest to offend, that sentence's score)."""
    dense = np.zeros(COLUMNS)
    dense[used] = values
    known: dict[str, float] = {}

    def value_of(word: str) -> float:
        value = known.get(word)
        if value is None:
            if len(known) >= REMEMBER:
                known.clear()
            value = known[word] = float(dense[features(word)].sum())
        return value

    def score(text: str | None) -> tuple[float, str | None, float | None]:
        total, worst, worst_z = 0.0, None, -math.inf
        for sentence in SENTENCE.split(text or ""):
            words = set(WORD.findall(sentence.lower()))
            if not words:
                continue
            z = bias + sum(map(value_of, words))
            total += math.log1p(math.exp(min(z, 30.0)))
            if worst is None or z > worst_z:
                worst, worst_z = sentence, z
        chance = None if worst is None else 1 / (1 + math.exp(-max(min(worst_z, 30.0), -700.0)))
        return -math.expm1(-total), worst, chance

    return score


def scored(docs: DataFrame, model: tuple[float, np.ndarray]) -> DataFrame:
    """`doc_id, score, sentence, sentence_score` per row: the sentence is the one likeliest to offend.

    Null, empty and wordless texts score 0 and have no sentence. Repeated rows each come back.
    """
    bias, weights = model
    used = np.flatnonzero(weights)
    values = weights[used]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(bias, used, values)
        for batch in batches:
            out = [score(text) for text in batch.column(1).to_pylist()]
            kinds = (pa.float64(), pa.string(), pa.float64())
            arrays = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            names = ["doc_id", "score", "sentence", "sentence_score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, score double, sentence string, sentence_score double")


def clean(docs: DataFrame, model: tuple[float, np.ndarray], limit: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns kept, whose text scores below `limit`."""
    bias, weights = model
    used = np.flatnonzero(weights)
    values, at = weights[used], docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(bias, used, values)
        for batch in batches:
            yield batch.filter(pa.array([score(text.as_py())[0] < limit for text in batch.column(at)], pa.bool_()))
            pa.default_memory_pool().release_unused()  # the worker lives on through later stages

    return docs.mapInArrow(each, docs.schema)


@query("op9_toxicity_bags")
def toxicity_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(remainder("doc_id", 5) != 0))
    found = scored(docs, model)
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return found.select("doc_id", held_out, "score", predicted, F.sha2("sentence", 256).alias("sentence_sha256"), "sentence_score")
