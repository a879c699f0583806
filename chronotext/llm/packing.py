"""Packing without mixing documents: every document is cut into pieces whose lengths are powers of two.

A document of n tokens becomes n // 4096 pieces of 4,096 tokens and, for what is left, one piece for each set bit of its
length, longest first. A piece is a sequence of its own: no sequence crosses documents and none is padded. Pieces of equal
length form a bucket, and a trainer draws each batch from one bucket (`write_buckets` lays them out that way).

Tokens are taken from whole texts. White space always parts tokens for the tokenizers meant here, so a text is taken apart
at spaces, a word is encoded once and then looked up, and the text's ids are gathered. Nothing is shuffled: a document's
pieces are made where it is read, and a sequence's number is made of the task's partition, its bucket and a count.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm.registry import query, table

VOCABULARY, END, LONGEST = "word_bpe_49k.json", 2, 4096
#: Bytes of texts taken at a time, tokens of one batch handed out, words and their ids remembered by a worker, new words
#: encoded at a time.
PIECE, HANDED, WORDS, IDS, LINE = 1 << 21, 1 << 20, 600_000, 6_000_000, 1000
#: Words that normalising leaves alone and the word pattern takes whole: a-z and the small letters of Latin-1.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: ASCII marks (but ', which may begin an ending) between a letter or digit and a space: a word of their own in any case.
ENDING = r"([\pL\pN])([!-&(-/:-@\[-`{-~]+) "
KIND = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


class Words:
    """Ids of words, each encoded once while it is remembered.

    The file's normaliser and word pattern leave words of small Latin letters whole and as they are; those are given to its
    model in long lines, where the suffix that ends a word parts them again. All others are encoded one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.whole, self.lines = Tokenizer.from_file(path), Tokenizer.from_file(path)
        suffix = self.whole.model.end_of_word_suffix
        if not suffix:
            raise ValueError("the tokens of this vocabulary do not mark the ends of words")
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[i for token, i in self.whole.get_vocab().items() if token.endswith(suffix)]] = True
        self.lines.normalizer = None
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), level])
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.flat = np.zeros(1, np.int32), np.zeros(0, np.int32)  # where each word's ids start, and the next one's

    def learn(self, new: list[str]) -> None:
        """Remember the ids of some words."""
        odd, plain = [], []
        for word in new:
            (plain if PLAIN.fullmatch(word) else odd).append(word)
        found, sizes = [], [np.zeros(0, np.int32)]
        for at in range(0, len(odd), LINE):
            one_by_one = [e.ids for e in self.whole.encode_batch_fast(odd[at : at + LINE], add_special_tokens=False)]
            sizes.append(np.array([len(ids) for ids in one_by_one], np.int32))
            found.append(np.array([i for ids in one_by_one for i in ids], np.int32))
        for at in range(0, len(plain), LINE):
            line = self.lines.encode(" ".join(plain[at : at + LINE]), add_special_tokens=False)
            found.append(np.array(line.ids, np.int32))
            sizes.append(np.diff(np.flatnonzero(self.ends[found[-1]]), prepend=-1).astype(np.int32))
        self.place.update(zip(odd + plain, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(np.concatenate(sizes), dtype=np.int32)])
        self.flat = np.concatenate([self.flat, *found])

    def places(self, words: np.ndarray) -> np.ndarray:
        if len(self.place) > WORDS or len(self.flat) > IDS:
            self.clear()
        place = np.fromiter(map(self.place.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        if len(new):
            self.learn(words[new].tolist())
            place[new] = [self.place[w] for w in words[new]]
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's number of ids.

        Letters A-Z become small and marks that end a word become words of their own, but not where special tokens may be.
        """
        for mark in "\n\t":
            texts = pc.replace_substring(texts, mark, " ")
        parted = pc.replace_substring_regex(pc.ascii_lower(texts), ENDING, r"\1 \2 ")
        parts = pc.split_pattern(pc.if_else(pc.match_substring(texts, "<|"), texts, parted), " ")
        coded = parts.flatten().dictionary_encode()
        place = pa.array(self.places(coded.dictionary.to_numpy(zero_copy_only=False))).take(coded.indices)
        ids = pa.ListArray.from_arrays(pa.array(self.starts), pa.array(self.flat)).take(place)
        ends = ids.offsets.to_numpy()
        return ids.flatten().to_numpy(), np.diff(ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()]).astype(np.int64)

    def encode_long(self, text: str) -> np.ndarray:
        """Ids of a text of any length, some characters at a time (a word longer than that is taken whole)."""
        out, at = [], 0
        while at < len(text):
            space = text.find(" ", at + PIECE)
            to = len(text) if space < 0 else space
            out.append(self.encode(pa.array([text[at:to]]))[0])
            at = to
        return np.concatenate(out)


@functools.lru_cache(1)
def remembered(path: str) -> Words:
    """The words of this worker, which serves many tasks."""
    return Words(path)


def cut(counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of the pieces of documents with these numbers of tokens, in order."""
    top = longest.bit_length() - 1
    powers = 1 << np.arange(top, -1, -1)
    often = (counts[:, None] >> np.arange(top, -1, -1)) & 1
    often[:, 0] = counts >> top
    return np.repeat(np.arange(len(counts)), often.sum(axis=1)), np.repeat(np.tile(powers, len(counts)), often.ravel())


def packed(
    docs: DataFrame, path: str | None = None, end: int = END, longest: int = LONGEST, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of the documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    `path` names a file of the tokenizers library that every executor can read and whose tokens never cross white space;
    `longest` is a power of two. Each document's ids end with `end`. A null text counts as empty: one piece, `end` alone.
    Null and repeated keys are kept, each row by itself; of the other columns only the text is read. A very long text is
    held as text and as 32-bit ids, its words a part at a time. An empty table gives no rows. Sequence numbers are unique;
    they follow the partitions of `docs`, so the same files read alike give the same numbers.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    path = path or public_tokenizers.path(VOCABULARY)

    def pieces(words: Words, keys: pa.Array, ids: np.ndarray, counts: np.ndarray, used: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The pieces of some documents, `HANDED` tokens or one piece at a time; `used` counts the sequences of a bucket."""
        ends = np.cumsum(counts + 1)
        whole = np.full(ends[-1], end, np.int32)
        whole[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
        doc, lengths = cut(counts + 1, longest)
        starts = np.cumsum(lengths) - lengths
        bucket = np.log2(lengths).astype(np.int64)
        number = np.zeros(len(lengths), np.int64)
        for b in np.unique(bucket):
            mine = np.flatnonzero(bucket == b)
            number[mine] = used[b] + np.arange(len(mine))
            used[b] += len(mine)
        sequence = (TaskContext.get().partitionId() << 37) | (bucket << 32) | number
        at = 0
        while at < len(lengths):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + HANDED)))
            some, first = slice(at, to), starts[at]
            offsets = np.concatenate([starts[some] - first, [starts[to - 1] + lengths[to - 1] - first]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(doc[some])),
                    pa.array(starts[some] - (ends - counts - 1)[doc[some]]),
                    pa.array(lengths[some]),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole[first : first + offsets[-1]])),
                    pa.array((counts + 1)[doc[some]]),
                    pa.array(sequence[some]),
                    pa.array(np.zeros(to - at, np.int64)),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            at = to

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, used = remembered(path), np.zeros(longest.bit_length(), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            row = 0
            while row < len(batch):
                to = row + 1 + int(np.argmax(np.append(np.cumsum(sizes[row + 1 :]) + sizes[row] > PIECE, True)))
                keys, texts = batch.column(0).slice(row, to - row), batch.column(1).slice(row, to - row)
                if sizes[row] > PIECE:  # this one alone
                    ids = words.encode_long(texts[0].as_py())
                    counts = np.array([len(ids)])
                else:
                    ids, counts = words.encode(texts)
                yield from pieces(words, keys, ids, counts, used)
                row = to

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(each, KIND)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences under `path`, one folder per length: a batch is read from a single folder and needs no padding."""
    pieces.write.partitionBy("length").parquet(path)


def with_crc32(pieces: DataFrame) -> DataFrame:
    """`pieces` with ids_crc32, the checksum of their ids as little-endian 32-bit numbers, in place of the ids."""
    rest = [c for c in pieces.columns if c != "ids"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values = memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B")
            ends = (4 * lists.offsets.to_numpy().astype(np.int64)).tolist()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sums, pa.int64())], names=[*rest, "ids_crc32"])

    kind = ", ".join(f"{c} long" for c in [*rest, "ids_crc32"])
    return pieces.select("ids", *rest).mapInArrow(each, kind)


@query("op13_binary_packing")
def binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_crc32(packed(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
