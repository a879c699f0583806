"""Content-defined chunking with a gear rolling hash, and removal of chunk runs that an earlier document holds.

A chunk ends where the gear hash of the last 16 bytes has its top bits zero, so an insertion moves only the ends near it.
Chunks are short, so that most of a repeated passage is whole chunks; as short chunks meet by chance, what is compared is
the shortest run of chunks from each chunk on that has `RUN` bytes. Runs are compared by digest; of equal runs the one with
the least (doc_id, position) stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm.registry import query, table
from chronotext.session import stage

#: Bits that must be zero (one end in 2**4 bytes on average), least and greatest bytes of a chunk.
MASK_BITS, LEAST, GREATEST = 4, 16, 1024
#: Least bytes of a run that goes, unless it is a whole text.
RUN = 96
NO_ID = (1 << 63) - 1
GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=4).digest() for i in range(256)), np.uint32)


def ends_of(data: np.ndarray) -> np.ndarray:
    """Positions after which the gear hash allows a chunk to end; the hash is built by doubling its window to 16 bytes."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h = more
    return np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1


def cuts(size: int, ends: list[int]) -> list[int]:
    """Ends of the chunks of a text of `size` bytes, out of the allowed ends."""
    out, last = [], 0
    for end in [*ends, size]:
        while end - last > GREATEST:
            last += GREATEST
            out.append(last)
        if end - last >= LEAST or end == size and end > last:
            out.append(end)
            last = end
    return out


def runs_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of the chunks, first chunk of each run, chunk after its last) of a text.

    From each chunk on the shortest run of at least RUN bytes; a shorter text is one run. The last run always ends with
    the text: a short last chunk is in a run only together with what is before it.
    """
    found = ends_of(np.frombuffer(data, np.uint8)) if len(data) > LEAST else np.zeros(0, int)
    bounds = np.array([0, *cuts(len(data), found.tolist())], np.int64)
    chunks = len(bounds) - 1
    after = np.searchsorted(bounds, bounds[:-1] + RUN)
    after = after[after <= chunks]
    first = np.arange(len(after))
    if chunks and not len(after):
        first, after = np.array([0]), np.array([chunks])
    elif chunks and after[-1] < chunks:
        first, after = np.r_[first, first[-1]], np.r_[after, chunks]
    return bounds, first, after


def digested(texts: DataFrame) -> DataFrame:
    """`id, key, at, a, b` of every run of `texts` (id, key, data): its number in the text and 128 bits of digest."""
    names = ["id", "key", "at", "a", "b"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests = [], []
            for text in batch.column(2):
                data = text.as_buffer().to_pybytes()
                bounds, first, after = runs_of(data)
                digests += [xxhash.xxh3_128_digest(data[s:e]) for s, e in zip(bounds[first].tolist(), bounds[after].tolist(), strict=True)]
                counts.append(len(first))
            row = np.repeat(np.arange(len(counts)), counts)
            at = np.concatenate([np.arange(n, dtype=np.int32) for n in counts]) if counts else np.zeros(0, np.int32)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            own = [batch.column(c).take(pa.array(row, pa.int64())) for c in (0, 1)]
            arrays = [*own, pa.array(at, pa.int32()), *(pa.array(halves[:, c].copy(), pa.int64()) for c in (0, 1))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return texts.select("id", "key", "data").mapInArrow(each, "id long, key long, at int, a long, b long")


def without_repeats(docs: DataFrame) -> DataFrame:
    """`doc_id, n_bytes, n_chunks, n_repeated, n_removed, kept` for every row of `docs` (doc_id, text).

    `kept` holds the bytes of the chunks that stay, also where a text repeats its own runs. A null or empty text has no
    chunk; a null doc_id counts as greater than all others. Rows alike in doc_id and text are treated alike, so the first
    runs of a repeated row stay in each. An empty table gives no rows.
    """
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"),
    ).withColumn("key", F.xxhash64("data"))
    runs = digested(texts)  # taken twice: fewer bytes of disk than staging every run
    firsts = runs.groupBy("a", "b").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    repeats = stage(runs.join(firsts.where("n > 1").select("a", "b", "low"), ["a", "b"]), "repeats")
    ties = repeats.where("id = low")  # within the least id, the least (position, text) stays
    least = ties.groupBy("a", "b").agg(F.min(F.struct("at", "key")).alias("first"), F.count("*").alias("n"))
    ties = ties.join(least.where("n > 1").select("a", "b", "first"), ["a", "b"]).where(F.struct("at", "key") > F.col("first"))
    gone = repeats.where("id > low").select("id", "key", "at").union(ties.select("id", "key", "at"))
    gone = stage(gone.distinct().groupBy("id", "key").agg(F.collect_list("at").alias("gone")), "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_chunks", "n_repeated", "n_removed", "kept"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            rows = []
            for i, text, numbers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = kept = text.as_buffer().to_pybytes()
                bounds, first, after = runs_of(data)
                chunks, repeated = len(bounds) - 1, 0
                if numbers:
                    depth = np.zeros(chunks + 1, np.int64)
                    np.add.at(depth, first[numbers], 1)
                    np.add.at(depth, after[numbers], -1)
                    off = np.cumsum(depth)[:-1] > 0
                    repeated = int(off.sum())
                    kept = np.frombuffer(data, np.uint8)[~np.repeat(off, np.diff(bounds))].tobytes()
                rows.append((None if i == NO_ID else i, len(data), chunks, repeated, len(data) - len(kept), kept))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=names)

    marked = texts.join(gone, ["id", "key"], "left").select("id", "data", "gone")
    return marked.mapInArrow(cut, "doc_id long, n_bytes long, n_chunks long, n_repeated long, n_removed long, kept binary")


@query("op4_gear_chunks")
def gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_chunks", "n_repeated", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
