"""Language identification: a linear-chain conditional random field labels every word of a text with a language.

A word's features are its first and last letters (affixes), its letter pairs and triples, and the entry it has in a
lexicon of words typical of one language; transitions between labels are learned too, so neighbours vote and switches
inside a text are found. Training sequences are made code-switched: runs of words from texts of different languages are
joined, each word labelled with its own text's language. Forward-backward gives each word's chance of each language; a
text has the language with the greatest sum of chances, and their mean as score.

The model is learned on a bounded sample of labelled rows; every text is labelled whole. Forward-backward goes through
all texts of a batch at once: texts are cut into lanes, a first sweep multiplies each lane's transfer matrices, so that
the exact messages at the lane borders are known, a second sweep fills the lanes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm.registry import query, table
from chronotext.llm.sampling import bounded_sample, bounded_texts, remainder
from chronotext.session import stage

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Texts of each language learned from, the longest of them, words of a run, runs joined to a sequence, sequences.
PER_LANGUAGE, LEARN_BYTES, RUN, RUNS, SEQUENCES = 400, 1 << 20, 16, 4, 3000
#: Bytes of text of one language that are learned from.
LANGUAGE_BYTES = 1 << 26
#: Feature columns (by hash), steps of the optimiser, penalty on squared weights, texts that must hold a lexicon word.
COLUMNS, STEPS, PENALTY, LEXICON_TEXTS = 1 << 16, 80, 0.5, 3
#: Letters of a word that are looked at: longer words lose their middle.
LETTERS = 32
#: Words of one lane; words of texts labelled at a time; words a task remembers.
LANE, CHUNK, REMEMBER = 128, 200_000, 300_000


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (zero after the end) and lengths of lower-case words."""
    half = LETTERS // 2
    short = [w if len(w) <= LETTERS else w[:half] + w[-half:] for w in words]
    codes = np.array(short, dtype=f"U{LETTERS}").view(np.uint32).reshape(len(words), LETTERS)
    return codes.astype(np.uint64), (codes != 0).sum(axis=1)


def mixed_hash(parts: list[np.ndarray], kind: int) -> np.ndarray:
    value = np.uint64(kind + 1)
    for part in parts:
        value = (value ^ part) * np.uint64(0x9E3779B97F4A7C15)
        value = value ^ (value >> np.uint64(29))
    return (value % np.uint64(COLUMNS)).astype(np.int32)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Columns of each word (one row per word) and which of them are there: affixes of 1 to 3 letters, pairs, triples."""
    code, length = letters(words)
    rows = np.arange(len(words))[:, None]
    columns, there = [], []
    for n in (1, 2, 3):
        ends = [code[rows, np.maximum(length[:, None] - n + i, 0)] for i in range(n)]
        columns += [mixed_hash([code[:, i : i + 1] for i in range(n)], 10 + n), mixed_hash(ends, 20 + n)]
        there += [length[:, None] >= n] * 2
    for n in (2, 3):
        columns.append(mixed_hash([code[:, i : LETTERS - n + 1 + i] for i in range(n)], 30 + n))
        there.append(np.arange(LETTERS - n + 1)[None, :] + n <= length[:, None])
    return np.concatenate(columns, axis=1), np.concatenate(there, axis=1)


class Model:
    """Labels, weights of columns by label, lexicon (word to label number), lexicon weights, transition weights."""

    def __init__(self, labels: list[str], weights: np.ndarray, lexicon: dict[str, int], entry: np.ndarray, moves: np.ndarray):
        self.labels, self.weights, self.lexicon, self.entry, self.moves = labels, weights, lexicon, entry, moves

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each label for each word."""
        columns, there = features(words)
        found = np.einsum("wfl,wf->wl", self.weights[columns], there.astype(self.weights.dtype)).astype(float)
        listed = np.array([self.lexicon.get(w, -1) for w in words])
        return found + np.where((listed >= 0)[:, None], self.entry[listed], 0.0)


def typical_words(texts: list[set[str]], codes: list[int], labels: int) -> dict[str, int]:
    """Words held by enough texts of the sample, most of them (by share of each language's texts) of one language."""
    held = [Counter() for _ in range(labels)]
    for words, code in zip(texts, codes, strict=True):
        held[code].update(words)
    size = np.maximum(np.bincount(codes, minlength=labels), 1)
    lexicon = {}
    for word in sorted(set().union(*held)):
        share = np.array([held[c][word] for c in range(labels)]) / size
        if sum(h[word] for h in held) >= LEXICON_TEXTS and share.max() >= 0.6 * share.sum():
            lexicon[word] = int(share.argmax())
    return lexicon


def learn(texts: list[str], langs: list[str]) -> Model | None:
    """The model that maximises the likelihood of the words' labels (Adam on all sequences); None without words."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(42)
    words = [WORD.findall(t.lower()) for t in texts]
    used = [i for i, w in enumerate(words) if w]
    if not used:
        return None
    codes = [labels.index(langs[i]) for i in used]
    lexicon = typical_words([set(words[i]) for i in used], codes, len(labels))
    by_label = [[i for i, c in zip(used, codes, strict=True) if c == label] for label in range(len(labels))]
    sequence, gold = [], []
    for _ in range(SEQUENCES):
        line, truth = [], []
        for _ in range(RUNS):
            label = int(rng.integers(len(labels)))
            if not by_label[label]:
                continue
            source = words[by_label[label][int(rng.integers(len(by_label[label])))]]
            start = int(rng.integers(max(1, len(source) - RUN + 1)))
            run = source[start : start + RUN]
            line += run
            truth += [label] * len(run)
        if line:
            sequence.append(line)
            gold.append(truth)
    vocabulary = sorted({w for line in sequence for w in line})
    number = {w: i for i, w in enumerate(vocabulary)}
    columns, there = features(vocabulary)
    word_at, column = np.nonzero(there)
    column = columns[word_at, column]
    listed = np.array([lexicon.get(w, -1) for w in vocabulary])
    length, size, n = max(map(len, sequence)), len(sequence), len(labels)
    ids, y = np.full((size, length), -1), np.zeros((size, length), int)
    for i, (line, truth) in enumerate(zip(sequence, gold, strict=True)):
        ids[i, : len(line)], y[i, : len(line)] = [number[w] for w in line], truth
    on = ids >= 0
    follows = on[:, 1:]
    true_moves = np.zeros((n, n))
    np.add.at(true_moves, (y[:, :-1][follows], y[:, 1:][follows]), 1.0)
    flat = np.r_[np.zeros(COLUMNS * n + n * n + n * n)]
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, STEPS + 1):
        weights, entry, moves = (part.reshape(-1, n) for part in np.split(flat, [COLUMNS * n, COLUMNS * n + n * n]))
        emit = np.stack([np.bincount(word_at, weights[column, c], len(vocabulary)) for c in range(n)], axis=1)
        emit += np.where((listed >= 0)[:, None], entry[listed], 0.0)
        score = np.where(on[:, :, None], emit[ids], 0.0)
        score = np.exp(score - score.max(axis=2, keepdims=True))
        jump = np.exp(moves - moves.max())
        ahead, behind = np.empty((size, length, n)), np.ones((size, length, n))
        ahead[:, 0] = score[:, 0] / score[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, length):
            value = (ahead[:, t - 1] @ jump) * score[:, t]
            ahead[:, t] = np.where(on[:, t, None], value / value.sum(axis=1, keepdims=True), ahead[:, t - 1])
        pairs = np.zeros((n, n))
        for t in range(length - 1, 0, -1):
            later = score[:, t] * behind[:, t]
            joint = ahead[:, t - 1, :, None] * jump * later[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += joint[on[:, t]].sum(axis=0)
            value = later @ jump.T
            behind[:, t - 1] = np.where(on[:, t, None], value / value.sum(axis=1, keepdims=True), behind[:, t])
        chance = ahead * behind
        chance /= chance.sum(axis=2, keepdims=True)
        miss = np.where(on[:, :, None], np.eye(n)[y] - chance, 0.0)[on]
        per_word = np.stack([np.bincount(ids[on], miss[:, c], len(vocabulary)) for c in range(n)], axis=1)
        g_weights = np.stack([np.bincount(column, per_word[word_at, c], COLUMNS) for c in range(n)], axis=1)
        g_entry = np.zeros((n, n))
        np.add.at(g_entry, listed[listed >= 0], per_word[listed >= 0])
        grad = np.r_[g_weights.ravel(), g_entry.ravel(), (true_moves - pairs).ravel()] - PENALTY * flat
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        flat += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights, entry, moves = (part.reshape(-1, n) for part in np.split(flat, [COLUMNS * n, COLUMNS * n + n * n]))
    return Model(labels, weights.astype(np.float32), lexicon, entry, moves)


def marginals(score: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward-backward over sequences laid end to end: each word's chance of each label.

    `score` (words x labels) holds the emissions, `lengths` (all positive) the words of each sequence.
    """
    n = score.shape[1]
    emit, jump = np.exp(score - score.max(axis=1, keepdims=True)), np.exp(moves - moves.max())
    lanes_of = -(-lengths // LANE)
    sequence = np.repeat(np.arange(len(lengths)), lanes_of)
    first_lane = np.r_[0, np.cumsum(lanes_of)[:-1]]
    rank = np.arange(len(sequence)) - first_lane[sequence]
    start = np.r_[0, np.cumsum(lengths)[:-1]][sequence] + rank * LANE
    count = np.minimum(LANE, lengths[sequence] - rank * LANE)
    depth = int(count.max())
    step_on = np.arange(depth)[None, :] < count[:, None]
    at = np.where(step_on, start[:, None] + np.arange(depth)[None, :], 0)
    lane_emit = np.where(step_on[:, :, None], emit[at], 1.0)
    # transfer of a lane: from the message before its first word to the message at its last (moves, then emissions)
    transfer = np.broadcast_to(np.eye(n), (len(sequence), n, n)).copy()
    for t in range(depth):
        value = (transfer @ jump) * lane_emit[:, t, None, :]
        value /= value.sum(axis=(1, 2), keepdims=True)
        transfer = np.where(step_on[:, t, None, None], value, transfer)
    before, after = np.ones((len(sequence), n)), np.ones((len(sequence), n))
    for r in range(1, int(rank.max()) + 1):  # messages into lane r from lane r - 1, for all sequences at once
        lane = np.flatnonzero(rank == r)
        prior = lane - 1
        if r == 1:  # the first word of a sequence has no move into it
            value = first_message(lane_emit, step_on, jump, prior)
        else:
            value = np.einsum("sl,slm->sm", before[prior], transfer[prior])
        before[lane] = value / value.sum(axis=1, keepdims=True)
    for r in range(int(rank.max()), 0, -1):
        lane = np.flatnonzero(rank == r)
        value = np.einsum("slm,sm->sl", transfer[lane], after[lane])
        after[lane - 1] = value / value.sum(axis=1, keepdims=True)
    ahead, behind = np.empty((depth, len(sequence), n)), np.empty((depth, len(sequence), n))
    message = before
    for t in range(depth):
        value = message @ jump if t else np.where((rank == 0)[:, None], 1.0, message @ jump)
        value = value * lane_emit[:, t]
        message = np.where(step_on[:, t, None], value / value.sum(axis=1, keepdims=True), message)
        ahead[t] = message
    message = after  # what the words after a lane say about the lane's last word, move included
    for t in range(depth - 1, -1, -1):
        behind[t] = message
        value = (message * lane_emit[:, t]) @ jump.T
        message = np.where(step_on[:, t, None], value / value.sum(axis=1, keepdims=True), message)
    chance = ahead * behind
    chance /= chance.sum(axis=2, keepdims=True)
    out = np.empty_like(score)
    out[at[step_on]] = chance.transpose(1, 0, 2)[step_on]
    return out


def first_message(lane_emit: np.ndarray, step_on: np.ndarray, jump: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """The message at the last word of the first lane of some sequences."""
    message = lane_emit[lanes, 0]
    for t in range(1, lane_emit.shape[1]):
        value = (message @ jump) * lane_emit[lanes, t]
        message = np.where(step_on[lanes, t, None], value / value.sum(axis=1, keepdims=True), message)
    return message


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from the rows of `docs` (doc_id, text, lang) that have a lang; at most `per_language` of each, within `LANGUAGE_BYTES`.

    Ids are drawn, then rows: an id on any number of rows is one of its language's ids, and rows alike count once.
    Null ids and langs and texts above `LEARN_BYTES` are not learned from. Without usable rows there is no model.
    """
    rows = docs.where("doc_id is not null and lang is not null")
    drawn = stage(bounded_sample(rows.select("doc_id", "lang").distinct(), "doc_id", "lang", per_language), "drawn")
    texts = rows.where(F.octet_length("text") <= LEARN_BYTES).select("doc_id", "text", F.col("lang").alias("_lang"))
    # drawn: at most per_language narrow rows for each of a few languages
    found = texts.join(F.broadcast(drawn.distinct()), ["doc_id"]).where("lang = _lang")
    found = bounded_texts(found, "lang", per_language, LANGUAGE_BYTES).toPandas().sort_values(["doc_id", "lang", "text"])
    return learn(found["text"].tolist(), found["lang"].tolist())


def labelled(docs: DataFrame, model: Model | None) -> DataFrame:
    """`doc_id, lang_pred, score, n_words, n_switches` per row.

    Null texts, texts without a letter and all texts if there is no model: `und`, score 0. Switches are neighbouring
    words whose likeliest languages differ. Repeated rows each come back.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        table_of = np.zeros((0, len(model.labels) if model else 0))
        names = ["doc_id", "lang_pred", "score", "n_words", "n_switches"]
        for batch in batches:
            lang, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            lengths, switches = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            held: list[tuple[int, list[str]]] = []
            size = 0
            for i, text in enumerate(batch.column(1).to_pylist() + [None]):
                words = WORD.findall(text.lower()) if text and model else []
                if words:
                    held.append((i, words))
                    lengths[i] = len(words)
                    size += len(words)
                if not held or (size < CHUNK and i < len(batch)):
                    continue
                fresh = list({w for _, ws in held for w in ws if w not in known})
                if len(known) + len(fresh) > REMEMBER:
                    known, table_of = {}, table_of[:0]
                    fresh = list({w for _, ws in held for w in ws})
                parts = [model.emissions(fresh[k : k + 20_000]) for k in range(0, len(fresh), 20_000)]
                known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                table_of = np.concatenate([table_of, *parts])
                counts = np.array([len(ws) for _, ws in held])
                ids = np.fromiter((known[w] for _, ws in held for w in ws), np.int64, size)
                chance = marginals(table_of[ids], counts, model.moves)
                starts = np.r_[0, np.cumsum(counts)[:-1]]
                mean = np.add.reduceat(chance, starts, axis=0) / counts[:, None]
                turns = np.r_[chance.argmax(axis=1)[1:] != chance.argmax(axis=1)[:-1], False]
                turns[starts[1:] - 1] = False
                rows = [r for r, _ in held]
                switches[rows] = np.add.reduceat(turns.astype(np.int64), starts)
                score[rows] = np.clip(mean.max(axis=1), 0.0, 1.0)
                for r, best in zip(rows, mean.argmax(axis=1), strict=True):
                    lang[r] = model.labels[best]
                held, size = [], 0
            columns = [batch.column(0), pa.array(lang), pa.array(score), pa.array(lengths), pa.array(switches)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, lang_pred string, score double, n_words long, n_switches long")


@query("op1_crf_language")
def crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(remainder("doc_id", 4) != 2))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return labelled(docs, model).select("doc_id", held_out, "lang_pred", "score", "n_words", "n_switches")
