"""Spelling variants: words one edit apart, found by PartEnum signatures of their letter multisets.

A word is a binary vector over (letter, how often it has occurred so far). One inserted or deleted letter changes one
component, one replaced letter two, so words one edit apart have vectors of Hamming distance at most two. The components
are dealt over `PARTS` parts; vectors that differ in two components agree on all but two parts, so of the signatures that
leave out each pair of parts at least one is the same (Arasu, Ganti and Kaushik 2006, one first-level partition). Signatures
of distinct multisets meet by an equality join; then the words of near multisets meet and their edit distance is checked.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions.text import computed_once
from chronotext.llm.registry import query, table
from chronotext.session import stage

#: Fixed values of the task: letters of a word, their lower case, and how rarely a letter is lost.
LETTERS = "a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOSS = 97
#: Parts of the components (28 signatures a word), bytes above which a text is taken in pieces, characters of a piece.
PARTS, PIECE = 8, 1 << 16


def runs(text: Column) -> Column:
    """Maximal runs of letters of a lower-cased text."""
    return F.regexp_extract_all(text, F.lit(f"[{LETTERS}]+"), F.lit(0))


def pieces(text: Column) -> Column:
    """A long text in pieces that end behind a character that is no letter, so that no run is cut; others whole."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{0,{PIECE - 1}}}[^{LETTERS}]|[{LETTERS}]+"), F.lit(0))
    return F.when(F.octet_length(text) <= PIECE, F.array(text)).otherwise(cut)


def words(docs: DataFrame, least_length: int = 5, least_count: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`word, n`: words of at least `least_length` letters that occur at least `least_count` times.

    Runs of letters are lower-cased (A-Z only); one in `LOSS` of them, by the checksum of key and run, loses one letter. A
    null text has no words, a null key counts as empty text; repeated rows count as often as they occur.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id")
    low = docs.select(name, F.translate(F.col(text).cast("string"), UPPER, LOWER).alias("text")).where("text is not null")
    parts = low.select("id", F.explode(pieces(F.col("text"))).alias("piece"))
    found = computed_once(parts, runs(F.col("piece")), "piece").select("id", F.explode("piece").alias("run"))
    found = found.where(F.octet_length("run") >= least_length)  # a letter lost makes a run shorter, never longer
    found = found.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    lost = F.expr("concat(substring(run, 1, int(h % length(run))), substring(run, int(h % length(run)) + 2))")
    word = F.when(F.col("h") % LOSS == 0, lost).otherwise(F.col("run")).alias("word")
    counts = found.select(word).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def signatures(codes: np.ndarray, starts: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """One row of hashes per word; words are slices of code points that begin at `starts`, none is empty."""
    with np.errstate(over="ignore"):

        def mixed(x: np.ndarray) -> np.ndarray:
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

        word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
        order = np.lexsort((codes, word))
        codes, at = codes[order], np.arange(len(codes))
        begins = np.append(True, (codes[1:] != codes[:-1]) | (word[1:] != word[:-1]))
        occurrence = at - np.maximum.accumulate(np.where(begins, at, 0))
        component = mixed((codes.astype(np.uint64) << np.uint64(32)) + occurrence.astype(np.uint64) + np.uint64(1))
        part = ((codes + occurrence * 3) % parts).astype(np.int64)
        sums = np.zeros(len(starts) * parts, np.uint64)
        np.add.at(sums, word * parts + part, component)
        sums = sums.reshape(-1, parts)
        total = sums.sum(axis=1, dtype=np.uint64)
        left_out = list(itertools.combinations(range(parts), 2))
        return np.stack([mixed(total - sums[:, a] - sums[:, b] + np.uint64(i)) for i, (a, b) in enumerate(left_out)], axis=1)


def signed(classes: DataFrame) -> DataFrame:
    """`signature, id, letters, members`, one row for each signature of each class (id, letters, members)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                some = batch.slice(at, 4096)
                texts = some.column("letters").to_pylist()
                sizes = np.array([len(t) for t in texts], np.int64)
                codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
                marks = signatures(codes, np.cumsum(sizes) - sizes)
                rows = pa.array(np.repeat(np.arange(len(texts)), marks.shape[1]))
                cells = [pa.array(marks.ravel().view(np.int64)), *(c.take(rows) for c in some.columns)]
                yield pa.RecordBatch.from_arrays(cells, names=["signature", *some.schema.names])

    return classes.select("id", "letters", "members").mapInArrow(each, "signature long, id long, letters string, members long")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """`word, n, other, other_n`: words one inserted, deleted or replaced letter apart, in both orders; each pair once.

    Words of the same letters are never one edit apart, so classes of them are signed and met; then the words of the
    smaller class of a pair look for those of the larger one. `id` is a hash of the letters: should two classes share one,
    their words meet needlessly and the edit distance parts them.
    """
    letters = F.array_join(F.sort_array(F.split("word", "")), "").alias("letters")
    words_ = stage(vocabulary.select("word", "n", letters).withColumn("id", F.xxhash64("letters")), "members")
    marked = signed(words_.groupBy("id", "letters").agg(F.count("*").alias("members")))
    one, two = marked.alias("one"), marked.alias("two")
    close = F.abs(F.length("one.letters") - F.length("two.letters")) <= 1
    close &= F.levenshtein("one.letters", "two.letters", 2) >= 0  # of sorted letters: two at most for Hamming distance two
    met = one.join(two, F.col("one.signature") == F.col("two.signature")).where((F.col("one.letters") < F.col("two.letters")) & close)
    swap = F.col("one.members") > F.col("two.members")
    ends = [F.when(swap, F.col(b)).otherwise(F.col(a)).alias(c) for a, b, c in (("one.id", "two.id", "few"), ("two.id", "one.id", "many"))]
    pairs = met.select(*ends).distinct()
    few = words_.select(F.col("id").alias("few"), "word", "n")
    many = words_.select(F.col("id").alias("many"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    found = pairs.join(few, "few").drop("few").join(many, "many").where(F.levenshtein("word", "other", 1) == 1)
    found = stage(found.select("word", "n", "other", "other_n"), "near-words")
    return found.union(found.select("other", "other_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """`word, root`: the end of the chain of forms (word, form) that starts at each word with a form.

    A chain's counts at least double with each step, so chains are short and without circles; each round doubles the steps
    that are looked ahead, and its state is written to the shared folder.
    """
    ahead = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("end"))
        moved = stage(ahead.join(further, "root", "left").select("word", F.coalesce("end", "root").alias("root"), "end"), "roots")
        ahead = moved.select("word", "root")
        if moved.where("end is not null").isEmpty():
            return ahead


def variant_groups(docs: DataFrame, least_length: int = 5, least_count: int = 3, times: int = 2) -> DataFrame:
    """`word, form, root, n, n_near, form_n` for every word of `words`.

    A word's form is its near word of the largest count (of equals the first in code-point order) if that is at least
    `times` its own; following forms gives the root, without a form the word itself. No words give no rows.
    """
    vocabulary = stage(words(docs, least_length, least_count), "words")
    near = near_pairs(vocabulary).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("first")
    )
    found = vocabulary.join(near, "word", "left")
    strong = -F.col("first.less") >= times * F.col("n")
    found = found.select(
        "word",
        F.when(strong, F.col("first.other")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, -F.col("first.less")).alias("form_n"),
    )
    found = stage(found, "forms")
    ends = roots(found.where("form is not null"))
    rooted = found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return rooted.select("word", "form", "root", "n", "n_near", "form_n")


VARIANT_SQL = """
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents
), often AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
    SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128
        THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b FROM often
), hashed AS (
    SELECT run, n, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS h
    FROM bytes, crc
), words AS (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
        ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
less AS (SELECT word, n, i, left(word, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM places),
pairs AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, w.word, w.n FROM less a JOIN words w ON a.rest = w.word
    UNION SELECT w.word, a.word, a.n FROM less a JOIN words w ON a.rest = w.word
), near AS (
    SELECT word, count(*) AS n_near, max(other_n) AS top FROM pairs GROUP BY word
), firsts AS (
    SELECT p.word, min(p.other) AS first FROM pairs p JOIN near USING (word) WHERE p.other_n = top GROUP BY p.word
), found AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN first END AS form,
        CASE WHEN top >= 2 * w.n THEN top END AS form_n
    FROM words w LEFT JOIN near USING (word) LEFT JOIN firsts USING (word)
), chain AS (
    SELECT word, word AS root, form AS next FROM found
    UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN found f ON c.next = f.word
)
SELECT word, form, c.root, n, n_near, form_n FROM found JOIN chain c USING (word) WHERE c.next IS NULL
"""


@query("op11_spelling_variants", VARIANT_SQL)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(table(spark, sf_dir, "documents"))
