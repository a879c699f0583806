"""SimHash near-duplicates found by deletion-variant signatures.

Two 64-bit fingerprints within 3 bits of each other, cut into two halves, differ by at most one bit in one half. Each half
therefore gives one signature per bit, with that bit made a wildcard (deleted): two halves within one bit share at least
one of them. Equal signatures meet by a shuffle on the signature and a sort; candidates are checked on whole fingerprints.

Only distinct fingerprints are indexed, so exact copies cost nothing. Inside a run of equal signatures no pairs are
listed: a breadth-first search over the run gives a spanning forest of its links, which joins the same fingerprints
into components as all links would.

`one_of_near_copies` is for texts that share at least 0.8 of their word shingles, which a few bits of 64 do not reach:
`WIDE` fingerprints of a text are taken from mixed shingle hashes and cut into bands of 16 bits. Texts that agree in a band
and in most bits of two fingerprints, and whose sizes allow it, are loosely linked; a band tells only what hangs together in it,
never its pairs. Some alike texts agree in no band, or in too few bits, so texts of such sizes that share one of their rarest shingles are
linked, too: of so many that two alike texts share a stated number of them (prefix filter, Chaudhuri et al. 2006); texts that do not share
as many with all others together are left out before. What hangs together over all
bands and shingles is dealt into blocks by size, and all texts of a block, and of two blocks whose sizes allow it, are compared
by their shingles inside a task, which returns a spanning forest of the texts that are alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.llm.components import components
from chronotext.llm.registry import query, table
from chronotext.session import stage

BITS, MAX_DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
#: Bytes of a text that are taken apart at a time.
PIECE = 1 << 20
#: Fingerprints for near copies and bits of a band; two texts of similarity 0.8 share one of the 48 bands in 97 of 100 cases.
WIDE, BAND = 12, 16
#: Of 128 bits, how many loosely linked texts may differ in (19 on average at similarity 0.8); members of a band compared at a time.
REACH, CROWD = 36, 2048
#: Members of a band from which on it is searched by itself; loose links that a task contracts.
MANY, EDGES = 32, 1 << 17
#: Shingles of a block of texts to compare, as how many each text counts besides its own; frequent shingles counted at a time.
BLOCK, ROW, TERMS = 1 << 20, 512, 4096
#: Bits by which texts that are not to be compared are left out before the others are looked up; bits of a bitmap of Spark's.
PLACES, BITMAP = 1 << 24, 1 << 15
#: Numbers by which shingles are counted, and those added up in a task.
CELLS, CELLS_A_TASK = 1 << 21, 1 << 17


def pieces(text: bytes, shingle: int) -> Iterator[list[bytes]]:
    """Words of a lower-cased text in turns; each turn repeats the last `shingle - 1` words of the one before."""
    gap, at, tail = re.compile(rb"[\x20\x09-\x0D]"), 0, []
    while at < len(text):
        cut = gap.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        words = tail + text[at:end].lower().split()
        yield words
        tail, at = words[-(shingle - 1) :] if shingle > 1 else [], end


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit number; 0 without words."""
    counts, total = np.zeros(BITS, np.int64), 0
    few: list[bytes] = []
    for words in pieces(text or b"", shingle):
        few = words
        if len(words) < shingle:
            continue
        n = len(words) - shingle + 1
        joined = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, n)
        for i in range(0, n, 1 << 15):
            part = hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += n
    if total == 0 and few:
        counts = np.unpackbits(np.array([xxhash.xxh64_intdigest(b" ".join(few), SEED)], np.uint64).view(np.uint8), bitorder="little")
        counts, total = counts.astype(np.int64), 1
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """`doc_id, fp` for every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), shingle) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(each, "doc_id long, fp long")


def signatures(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """`key, fp`: for each segment of each fingerprint and each bit of it, the segment without that bit."""
    parts = max_distance // 2 + 1
    width = -(-BITS // parts)
    at = F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("at")
    segment = f"(at div {width}) * {width}"
    ones = (1 << width) - 1 if width < BITS else -1
    value = f"shiftrightunsigned(fp, cast({segment} as int)) & {ones}L & ~shiftleft(1L, cast(at - {segment} as int))"
    return prints.select("fp", at).select(F.xxhash64("at", F.expr(value)).alias("key"), "fp")


def forest(prints: np.ndarray, max_distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links within one run of fingerprints (uint64, distinct)."""
    found, rest = [], prints
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = np.bitwise_count(rest ^ node) <= max_distance
            if near.any():
                found.append((np.full(int(near.sum()), node), rest[near]))
                queue.extend(rest[near])
                rest = rest[~near]
    return found


def links(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Edges `a, b` between fingerprints within `max_distance` bits, enough to connect whatever such links connect."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # members of the run that the last batch ended in
        last = None
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]
            found = []
            if last is not None and key[0] == last:
                held.append(fp[: ends[0]])
                starts, ends = starts[1:], ends[1:]
            if len(starts):
                if held:
                    found += forest(np.unique(np.concatenate(held)), max_distance)
                held, last = [fp[starts[-1] :]], key[-1]
                starts, ends = starts[:-1], ends[:-1]
            two = ends - starts == 2
            a, b = fp[starts[two]], fp[starts[two] + 1]
            near = np.bitwise_count(a ^ b) <= max_distance
            found.append((a[near], b[near]))
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                found += forest(np.unique(fp[s:e]), max_distance)
            yield edges(found)
        if held:
            yield edges(forest(np.unique(np.concatenate(held)), max_distance))

    def edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
        b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    met = signatures(prints, max_distance).repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(runs, "a long, b long").where("a <> b").distinct()


def groups(docs: DataFrame, max_distance: int = MAX_DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """`doc_id, fp, root, component_id` for every row of `docs` (doc_id, text; other columns are not read).

    `root` is the least fingerprint of the group and `component_id` its least doc_id (null if none has one). Null and
    blank texts have fingerprint 0 and are linked like any other. Repeated rows each come back. An empty table gives none.
    """
    marked = stage(fingerprints(docs, shingle), "fingerprints")
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(prints.select("fp"), max_distance))
    prints = prints.join(roots, prints["fp"] == roots["node"], "left")
    prints = prints.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = prints.groupBy("root").agg(F.min("first").alias("component_id"))
    prints = stage(prints.join(least, "root").select("fp", "root", "component_id"), "groups")
    return marked.join(prints, "fp").select("doc_id", "fp", "root", "component_id")


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; a text of fewer words is one shingle, one without none."""
    parts, few = [], []
    for words in pieces(text or b"", shingle):
        few = words
        joined = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
        parts.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64)))
    found = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    return found if len(found) or not few else np.array([xxhash.xxh64_intdigest(b" ".join(few), SEED)], np.uint64)


def set_name(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """WIDE SimHashes of 64 bits, each of the same hashes mixed anew."""
    counts = np.zeros((WIDE, BITS), np.int64)
    salts = np.arange(1, WIDE + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for low in range(0, len(hashes), 1 << 13):
        h = hashes[None, low : low + (1 << 13)] + salts
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.view(np.uint8).reshape(WIDE, -1, 8), axis=2, bitorder="little")
        counts += bits.sum(axis=1, dtype=np.int32)
    return np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").view(np.uint64)[:, 0]


def shingle_counts(rows: DataFrame, shingle: int) -> np.ndarray:
    """How many texts (column text, binary) have a shingle of each number below `CELLS`, up to 65,535.

    A shingle counts at its hash modulo `CELLS`, so a 1 is a shingle that no second text has, and no count is too low.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int32)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, shingle_set(text.as_py(), shingle) % np.uint64(CELLS), 1)
        parts = [pa.compress(part.tobytes(), "zstd", asbytes=True) for part in total.reshape(-1, CELLS_A_TASK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    def added(met: pa.Table) -> pa.Table:
        total = np.zeros(CELLS_A_TASK, np.int64)
        for part in met["counts"].to_pylist():
            total += np.frombuffer(pa.decompress(part, 4 * CELLS_A_TASK, "zstd"), np.int32)
        total = np.minimum(total, (1 << 16) - 1).astype(np.uint16)
        return pa.table([met["part"][:1], pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    kind = "part int, counts binary"
    found = np.zeros((CELLS // CELLS_A_TASK, CELLS_A_TASK), np.uint16)
    for r in rows.select("text").mapInArrow(counted, kind).groupBy("part").applyInArrow(added, kind).collect():  # 4 MB, however many texts there are
        found[r.part] = np.frombuffer(r.counts, np.uint16)
    return found.reshape(-1)


def rare_needed(size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(room, shared) for sets of these sizes: two alike sets have `shared` of their `room` rarest shingles in common, by the smaller."""
    apart = size - np.ceil(similarity * size - 1e-6).astype(np.int64)  # of its shingles a set has so many alone, at most
    shared = np.maximum(1, (apart + 1) // 2)
    return apart + shared, shared


def rare_shingles(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest of a text's shingles (see `rare_needed`), without those that only it has."""
    room, _ = rare_needed(np.array(len(hashes)), similarity)
    texts = counts[hashes % np.uint64(CELLS)]
    first = np.lexsort((hashes, texts))[: int(room)]
    return hashes[first[texts[first] > 1]]


def least_reached(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Of each of the numbers 0 to n - 1 the least it reaches by the edges a, b and by `least` (what it reached before)."""
    while True:
        one, two = least[a], least[b]
        differ = one != two
        if not differ.any():
            return least
        a, b, one, two = a[differ], b[differ], one[differ], two[differ]
        low = np.minimum(one, two)
        np.minimum.at(least, one, low)
        np.minimum.at(least, two, low)
        while ((deeper := least[least]) != least).any():
            least = deeper


def near(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether rows of checks (two fingerprints, size, greatest size that can be alike) are within REACH bits and may be alike."""
    apart = np.bitwise_count(one[..., 0] ^ other[..., 0]) + np.bitwise_count(one[..., 1] ^ other[..., 1])
    return (apart <= REACH) & (one[..., 2] <= other[..., 3]) & (other[..., 2] <= one[..., 3])


def near_tree(checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (rows of `checks`) that connect whatever the pairs that are `near` connect, each with the least of its tree."""
    least = np.arange(len(checks))
    for low in range(0, len(checks), CROWD):
        for start in range(low, len(checks), CROWD):
            a, b = np.nonzero(near(checks[low : low + CROWD, None], checks[None, start : start + CROWD]))
            least = least_reached(a + low, b + start, least)
    members = np.flatnonzero(least != np.arange(len(checks)))
    return least[members], members


def loose_links(prints: DataFrame, similarity: float) -> DataFrame:
    """Edges `a, b` between names of `prints` (name, wide: WIDE longs as bytes, size, rare), enough to connect what may be alike:
    what is `near` in a band, and what shares one of its rare shingles (longs as bytes) and has a size that allows it.
    """

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = WIDE * BITS // BAND
        for batch in batches:
            wide = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, WIDE)
            values = wide.view(np.uint16).astype(np.int64) | np.arange(bands) << BAND
            beside = (*wide[:, :2].T.view(np.int64), batch.column(0).to_numpy(), batch.column(2).to_numpy())
            arrays = [values.ravel(), *(np.repeat(x, bands) for x in beside)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["key", "c", "d", "name", "size"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows since the last run that has ended
        for batch in batches:
            if not len(batch):
                continue
            got = [c.to_numpy() for c in batch.columns]
            if not held or got[0][-1] == held[0][0][-1]:
                held.append(got)
                continue
            at = int(np.searchsorted(got[0], got[0][-1]))
            held.append([c[:at] for c in got])
            yield connected(held)
            held = [[c[at:] for c in got]]
        if held:
            yield connected(held)

    def connected(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, c, d, name, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        most = np.floor(size / similarity + 1e-6).astype(np.uint64)
        checks = np.stack([c.view(np.uint64), d.view(np.uint64), size.astype(np.uint64), most], axis=1)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        sizes = np.diff(np.r_[starts, len(key)])
        small = np.repeat(sizes <= MANY, sizes)
        found = [(np.zeros(0, int),) * 2]
        for step in range(1, int(sizes[sizes <= MANY].max(initial=0))):
            at = np.flatnonzero((key[step:] == key[:-step]) & small[:-step])
            at = at[near(checks[at], checks[at + step])]
            found.append((at, at + step))
        for start in starts[sizes > MANY]:
            a, b = near_tree(checks[start : np.searchsorted(key, key[start], side="right")])
            found.append((a + start, b + start))
        return starred(name, *(np.concatenate(x) for x in zip(*found, strict=True)))

    def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if parts:
            yield joined(parts)

    def starred(name: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        least = least_reached(a, b, np.arange(len(name)))
        members = np.flatnonzero(least != np.arange(len(name)))
        return pa.RecordBatch.from_arrays([pa.array(name[least[members]]), pa.array(name[members])], names=["a", "b"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(r.as_buffer(), np.int64) for r in batch.column(1)]
            beside = [np.repeat(batch.column(c).to_numpy(), [len(k) for k in keys]) for c in (0, 2)]
            arrays = [np.concatenate([np.zeros(0, np.int64), *keys]), *beside]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["key", "name", "size"])

    def met_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(name, n): of how many of its shingles a text is not the only one, by task."""
        last, held, n = None, [], 0
        for batch in batches:
            key, name, size = (c.to_numpy() for c in batch.columns)
            if last is not None:  # the last row of the batch before has not met the first of this one
                key, name, known = np.r_[last[0], key], np.r_[last[1], name], last[2]
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            met = np.r_[known if last is not None else False, same] | np.r_[same, False]
            held.append(name[:-1][met[:-1]])
            last, n = (key[-1], name[-1], bool(met[-1])), n + len(held[-1])
            if n >= EDGES:
                yield told(held)
                held, n = [], 0
        if last is not None:
            yield told([*held, np.array([last[1]] if last[2] else [], np.int64)])

    def told(names: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(names), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["name", "n"])

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy().astype(np.int64)
            least = rare_needed(np.ceil(similarity * size - 1e-6).astype(np.int64), similarity)[1]  # of the smallest that may be alike
            yield batch.filter(pa.array(batch.column(3).to_numpy() >= least))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, n = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)], [], 0
        for batch in batches:
            key, name, size = (np.concatenate([x, c.to_numpy()]) for x, c in zip(last, batch.columns, strict=True))
            # sizes ascend within a shingle: if two texts may be alike, so may all neighbours between them
            at = np.flatnonzero((key[1:] == key[:-1]) & (size[1:] <= np.floor(size[:-1] / similarity + 1e-6)))
            held.append((name[at], name[at + 1]))
            last, n = [c[-1:] for c in (key, name, size)], n + len(at)
            if n >= EDGES:
                yield joined(held)
                held, n = [], 0
        if held:
            yield joined(held)

    def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        names, at = np.unique(np.r_[a, b], return_inverse=True)
        return starred(names, at[: len(a)], at[len(a) :])

    rows = prints.select("name", "wide", "size").mapInArrow(banded, "key long, c long, d long, name long, size int")
    found = rows.repartition("key").sortWithinPartitions("key", "name").mapInArrow(met, "a long, b long")
    kind = "key long, name long, size int"
    rare = prints.select("name", "rare", "size").mapInArrow(listed, kind).repartition("key").sortWithinPartitions("key")
    shared = stage(rare.mapInArrow(met_others, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")), "shared")
    likely = prints.select("name", "rare", "size").join(shared, "name").mapInArrow(enough, "name long, rare binary, size int, n long")
    rare = likely.select("name", "rare", "size").mapInArrow(listed, kind).repartition("key").sortWithinPartitions("key", "size", "name")
    found = found.union(rare.mapInArrow(chained, "a long, b long"))
    found = stage(found, "loose")  # every band and shingle has links of its own: what a task has of them is contracted, then all
    return found.repartition(max(1, found.count() // EDGES)).mapInArrow(contracted, "a long, b long")


def blocks_of(members: DataFrame, similarity: float) -> DataFrame:
    """`name, root, one, two, block`: members (name, root, size) of a root in blocks by size; each for every pair of blocks it is in.

    Of two blocks whose sizes rule out that any two texts are alike there is no pair.
    """
    weight = F.sum(F.col("size") + ROW).over(Window.partitionBy("root").orderBy("size", "name").rowsBetween(Window.unboundedPreceding, -1))
    members = stage(members.withColumn("block", F.coalesce(weight, F.lit(0)).cast("long") / F.lit(BLOCK)).withColumn("block", F.floor("block")), "members")
    ends = members.groupBy("root", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    one, two = ends.select("root", F.col("block").alias("one"), "high"), ends.select("root", F.col("block").alias("two"), "low")
    pairs = one.join(two, "root").where(f"one <= two and high >= low * {similarity} - 1e-6")
    turns = pairs.select("root", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    return members.join(turns, ["root", "block"]).select("name", "root", "one", "two", "block")


def alike_forest(sets: list[np.ndarray], second: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the sets (sorted, distinct) that are alike; with any `second`, only of those with the others."""
    size = np.array([len(s) for s in sets], np.int64)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    owner, across = np.repeat(np.arange(len(sets)), size), bool(second.any())
    while True:  # a text that shares too little with all the others is alike to none
        if across:
            met = (np.bincount(term[~second[owner]], minlength=term.max(initial=0) + 1) > 0) & (np.bincount(term[second[owner]], minlength=term.max(initial=0) + 1) > 0)
        else:
            met = np.bincount(term) > 1
        shared = met[term]
        enough = np.bincount(owner[shared], minlength=len(sets)) >= similarity * size - 1e-6
        keep = shared & enough[owner]
        if keep.all():
            break
        term, owner = term[keep], owner[keep]
    who, owner = np.unique(owner, return_inverse=True)
    if len(who) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.zeros((len(who), len(who)), np.int32)
    order = np.argsort(term, kind="stable")  # owners ascend within a term
    term, owner = term[order], owner[order]
    often = np.bincount(term)[term] > MANY
    few, mine = term[~often], owner[~often]
    for step in range(1, MANY):
        at = np.flatnonzero(few[step:] == few[:-step])
        if not len(at):
            break
        np.add.at(both.reshape(-1), mine[at] * len(who) + mine[at + step], 1)
    many, mine = term[often], owner[often]
    named, many = np.unique(many, return_inverse=True)
    for low in range(0, len(named), TERMS):
        held = np.zeros((len(who), min(TERMS, len(named) - low)), np.float32)
        some = (many >= low) & (many < low + TERMS)
        held[mine[some], many[some] - low] = 1
        both += (held @ held.T).astype(np.int32)
    size, second = size[who], second[who]
    fine = np.triu(both >= similarity * (size[:, None] + size[None] - both), 1)
    if across:
        fine &= second[:, None] != second[None]
    fine |= fine.T
    found, rest = [(np.zeros(0, np.int64),) * 2], np.ones(len(who), bool)
    for first in range(len(who)):
        queue = [first] if rest[first] else []
        rest[first] = False
        while queue:
            node = queue.pop()
            reached = np.flatnonzero(fine[node] & rest)
            rest[reached] = False
            queue.extend(reached.tolist())
            found.append((np.full(len(reached), who[node]), who[reached]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """`doc_id, fp, root, component_id` as `groups` gives, `fp` being a name of the text's set of shingles.

    Texts are linked if the Jaccard similarity of their sets, counted on the texts, is at least `similarity`; no such pair is left out.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), shingle) for text in batch.column(2)]
            names, sizes = pa.array([set_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())
            wide = pa.array([wide_print(s).tobytes() for s in sets], pa.binary())
            rare = pa.array([rare_shingles(s, counts, similarity).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names, sizes, wide, rare], names=["doc_id", "key", "name", "size", "wide", "rare"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(text.as_py(), shingle).tobytes() for text in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["name", "shingles"])

    def alike(met: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in met["shingles"]]
        a, b = alike_forest(sets, met["block"].to_numpy() > met["one"].to_numpy(), similarity)
        name = met["name"].to_numpy()
        return pa.table({"a": pa.array(name[a], pa.int64()), "b": pa.array(name[b], pa.int64())})

    text = F.col("text").cast("binary").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("binary")).alias("key"), text)
    counts = shingle_counts(rows, shingle)
    marked = stage(rows.mapInArrow(each, "doc_id long, key long, name long, size int, wide binary, rare binary"), "wide")
    least = (F.min(c).alias(c) for c in ("size", "wide", "rare", "key"))
    prints = stage(marked.groupBy("name").agg(*least, F.min("doc_id").alias("first")), "prints")
    loose = stage(components(loose_links(prints, similarity)), "roots")
    members = prints.join(loose, prints["name"] == loose["node"]).select("name", "root", "size", "key")
    dealt = stage(blocks_of(members.select("name", "root", "size"), similarity), "dealt")
    wanted = stage(members.select("name", "key"), "wanted")
    place = F.pmod("key", F.lit(PLACES)) + 1
    marks = wanted.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros((PLACES // BITMAP, BITMAP // 8), np.uint8)
    for r in marks.collect():  # at most 2 MB, however many texts there are
        bits[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    bits = bits.reshape(-1)

    def marked_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() % PLACES
            yield batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    likely = rows.select("key", "text").mapInArrow(marked_keys, "key long, text binary")
    found = likely.join(wanted, "key").select("name", "text").dropDuplicates(["name"])
    sets = stage(found.mapInArrow(listed, "name long, shingles binary"), "shingles")
    links = sets.join(dealt, "name").groupBy("root", "one", "two").applyInArrow(alike, "a long, b long")
    roots = stage(components(links), "roots")
    prints = prints.join(roots, prints["name"] == roots["node"], "left").select("name", "first", F.coalesce("root", "name").alias("root"))
    least = prints.groupBy("root").agg(F.min("first").alias("component_id"))
    prints = stage(prints.join(least, "root").select("name", "root", "component_id"), "groups")
    return marked.join(prints, "name").select("doc_id", F.col("name").alias("fp"), "root", "component_id")


def one_of_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` that stay of groups of near copies, chosen as `one_of_each` does."""
    return staying(docs, near_groups(docs, shingle, similarity), lambda text: set_name(shingle_set(text, shingle)))


def one_of_each(docs: DataFrame, max_distance: int = MAX_DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs` that stay: of each group, one row with its least doc_id, all columns kept.

    Rows without doc_id stay only in groups where no row has one, and then one row of the least fingerprint does.
    """
    return staying(docs, groups(docs, max_distance, shingle), lambda text: fingerprint(text, shingle))


def staying(docs: DataFrame, found: DataFrame, print_of: Callable[[bytes | None], int]) -> DataFrame:
    """One row of each group in `found`; `print_of` gives the fp of a text."""
    marked = stage(found, "groups")
    bare = marked.where("component_id is null").groupBy("root").agg(F.min("fp").alias("fp"))
    keep = marked.where("doc_id = component_id").select("doc_id", "fp", "root")
    # of rows that share the least doc_id but not the text, the one with the least fingerprint
    keep = keep.groupBy("root", "doc_id").agg(F.min("fp").alias("fp")).select("doc_id", "fp")
    twice = marked.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id")
    keep, twice = stage(keep, "kept"), stage(twice, "twice")
    plain = docs.join(keep.join(twice, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)

    # rows that doc_id alone does not tell apart: their fingerprints are taken again
    odd = docs.where("doc_id is null").union(docs.join(twice, "doc_id", "left_semi").select(*docs.columns))
    bits = F.udf(lambda text: print_of(bytes(text) if text is not None else None), "long")
    odd = odd.withColumn("_print", bits(F.col("text").cast("binary")))
    wanted = keep.union(bare.select(F.lit(None).cast("long"), "fp")).select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"))
    odd = odd.join(wanted, odd["doc_id"].eqNullSafe(F.col("_id")) & (odd["_print"] == F.col("_fp")), "left_semi")
    return plain.union(odd.dropDuplicates(["doc_id", "_print"]).select(*docs.columns))


@query("op2_simhash_components")
def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
