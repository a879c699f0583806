"""Removal of repeated byte strings by suffix sorting.

A byte goes if a string of `WIDTH` bytes that covers it also starts in a document with a smaller id. To find these
strings without moving every suffix, each window of `WIDTH` bytes is owned by its anchor: the leftmost least hash of a
shorter string (`GRAM` bytes) in it. Equal windows have equal anchors at equal offsets, so windows need to be compared
only with windows of the same anchor hash:

1. texts are dealt into blocks of about a MB by id and digest (many rows alike in both over several); each block lists its anchor hashes, dealt over buckets by hash;
2. a bucket tells each block which of its hashes occur elsewhere too (one bit each);
3. blocks send the windows of those anchors, once per distinct run of windows, to the buckets;
4. a bucket sorts the suffixes that start at these windows, deep-shallow: multikey quicksort on eight-byte words down to a
   shallow depth, then a blind trie for every group that is still equal; the least document id of a run of suffixes
   that agree on `WIDTH` bytes decides, and one bit per window goes back;
5. blocks unite the windows found and cut them out.

The texts are shuffled once (the three passes over blocks read the same exchange). Exact copies are recognised by digest
beforehand and not searched. No step collects what belongs to one hot string: a block sends each distinct run once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm.registry import query, table
from chronotext.session import stage

WIDTH, GRAM = 50, 20
#: Bytes of text meant for a block; window starts hashed at a time.
BLOCK_BYTES, PIECE = 1 << 20, 1 << 18
#: Bytes compared by multikey quicksort, eight at a time; the rest is left to blind tries.
SHALLOW = 24
#: Suffixes compared with their leaders at a time.
COMPARED = 1 << 15
#: Bytes that a row counts for besides its text when rows alike in id and text are dealt.
ROW_BYTES = 100
NO_ID = (1 << 63) - 1


# ---- anchors ----------------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every string of GRAM (16 + 4) bytes, built by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    four = h
    for step, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9), (8, 0x27D4EB2F165667C5)):
        h = h[:-step] * np.uint64(factor) + h[step:]
        four = h if step == 2 else four
    h = h[: len(data) - GRAM + 1] * np.uint64(0x85EBCA77C2B2AE63) + four[GRAM - 4 : len(data) - 3]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def owners(hashes: np.ndarray, span: int) -> np.ndarray:
    """Index of the leftmost least hash among each `span` in a row."""
    value, index, width = hashes, np.arange(len(hashes), dtype=np.int32), 1
    while width < span:
        step = min(width, span - width)
        left, right = value[: len(value) - step], value[step:]
        index = np.where(left <= right, index[: len(index) - step], index[step:])
        value = np.minimum(left, right)
        width += step
    return index


def scattered(hashes: np.ndarray) -> np.ndarray:
    """Least hashes are small: a one-to-one mixing spreads them evenly over the buckets."""
    h = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(30))) * np.uint64(0xD6E8FEB86659FD93)


class Block:
    """The texts of a block laid end to end, in order of (id, digest): `ids`, `starts`, `ends`, `data`."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids, self.data = np.array(ids, np.int64), b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor hash, first window, windows) of each run of windows with one owner, in pieces of bounded size."""
        whole = np.frombuffer(self.data, np.uint8)
        usable = np.zeros(len(whole), bool)
        for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            usable[s : max(s, e - WIDTH + 1)] = True
        for low in range(0, len(whole) - WIDTH + 1, PIECE):
            high = min(low + PIECE, len(whole) - WIDTH + 1)
            hashes = gram_hashes(whole[low : high + WIDTH - 1])
            owner = owners(hashes, WIDTH - GRAM + 1)
            at = np.flatnonzero(usable[low:high])
            if not len(at):
                continue
            mine = owner[at]
            new = np.r_[True, (mine[1:] != mine[:-1]) | (at[1:] != at[:-1] + 1)]
            first = np.flatnonzero(new)
            yield scattered(hashes[mine[first]]), at[first] + low, np.diff(np.r_[first, len(at)])


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def dealt(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of sorted hashes."""
    if not len(hashes):
        return
    of = bucket_of(hashes, buckets)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    for s, e in zip(first, np.r_[first[1:], len(of)], strict=True):
        yield int(of[s]), slice(s, e)


# ---- deep-shallow suffix sorting --------------------------------------------------------------------------------------


def suffix_groups(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of `data` at `starts` by their first WIDTH bytes, and where runs of equal ones begin in it.

    Every suffix has at least WIDTH bytes.
    """
    raw = np.frombuffer(data + bytes(8), np.uint8)
    word = np.zeros(len(data), np.uint64)
    for i in range(8):
        word <<= np.uint64(8)
        word |= raw[i : i + len(data)]
    order = np.argsort(word[starts], kind="stable")
    key = word[starts[order]]
    new = np.r_[True, key[1:] != key[:-1]] if len(order) else np.zeros(0, bool)
    for depth in range(8, SHALLOW, 8):  # multikey quicksort: what is equal so far is sorted by the next word
        part = np.flatnonzero(~(new & np.r_[new[1:], True]))
        group = np.cumsum(new)[part]
        key = word[starts[order[part]] + depth]
        inner = np.lexsort((key, group))
        order[part], key = order[part][inner], key[inner]
        new[part] = new[part] | np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
    blind_tries(raw, starts, order, new)
    return order, np.flatnonzero(new)


def blind_tries(raw: np.ndarray, starts: np.ndarray, order: np.ndarray, new: np.ndarray) -> None:
    """Order the groups that agree on SHALLOW bytes, in place, by blind tries grown level by level.

    A node keeps a leading suffix, the depth at which others leave it and the byte they leave by. All groups grow at once:
    each member is compared with its group's leader, and members that leave at one depth by one byte form a child.
    Children that leave by a smaller byte come before the leader (earlier leavers first), the others after it.
    """
    part = np.flatnonzero(~(new & np.r_[new[1:], True])) if len(new) else np.zeros(0, int)
    rest = WIDTH - SHALLOW
    while len(part):
        group = np.cumsum(new[part])
        leader = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])[group - group[0]]
        keys = np.empty(len(part), np.int64)
        for low in range(0, len(part), COMPARED):
            some = slice(low, low + COMPARED)
            here = starts[order[part[some]]][:, None] + np.arange(SHALLOW, WIDTH)
            lead = starts[order[part[leader[some]]]][:, None] + np.arange(SHALLOW, WIDTH)
            mine, theirs = raw[here], raw[lead]
            differ = mine != theirs
            depth = np.where(differ.any(axis=1), differ.argmax(axis=1), rest)
            at = np.minimum(depth, rest - 1)[:, None]
            byte, other = (np.take_along_axis(x, at, axis=1)[:, 0].astype(np.int64) for x in (mine, theirs))
            before = (depth << 8) | byte
            after = (2 << 16) | ((rest - depth) << 8) | byte
            keys[some] = np.where(depth == rest, 1 << 16, np.where(byte < other, before, after))
        inner = np.lexsort((keys, group))
        order[part], keys = order[part][inner], keys[inner]
        new[part] = np.r_[True, (group[1:] != group[:-1]) | (keys[1:] != keys[:-1])]
        size = np.diff(np.r_[np.flatnonzero(new[part]), len(part)])
        size = np.repeat(size, size)
        part = part[(size > 1) & (keys != 1 << 16)]


# ---- the passes --------------------------------------------------------------------------------------------------------

SIDE = "block long, kind int, bucket long, ids binary, starts binary, bits binary"
SIDE_SCHEMA = pa.schema(
    [("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("ids", pa.binary()), ("starts", pa.binary()), ("bits", pa.binary())]
)
LISTED = "bucket long, block long, hashes binary, twice binary"
LISTED_SCHEMA = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("twice", pa.binary())])
SENT = "bucket long, block long, ids binary, starts binary, counts binary, data binary"
SENT_SCHEMA = pa.schema(
    [("bucket", pa.int64()), ("block", pa.int64()), *((n, pa.binary()) for n in ("ids", "starts", "counts", "data"))]
)
COPY, BITS, MARKS = 0, 1, 2


def opened(texts: pa.Table, side: pa.Table) -> tuple[Block, np.ndarray, np.ndarray]:
    """The block of one group, row numbers of its texts in `texts`, and row numbers of copies of earlier documents."""
    copies = {(r["ids"], r["bits"]) for r in side.to_pylist() if r["kind"] == COPY}
    ids, datas = texts["id"].to_pylist(), texts["data"]
    keys = [(i, bytes.fromhex(d)) for i, d in zip(ids, texts["digest"].to_pylist(), strict=True)]
    packed = [i.to_bytes(8, "big", signed=True) for i in ids]
    order = sorted(range(len(ids)), key=keys.__getitem__)
    kept = [i for i in order if (packed[i], keys[i][1]) not in copies]
    gone = [i for i in order if (packed[i], keys[i][1]) in copies]
    block = Block([ids[i] for i in kept], [datas[i].as_buffer().to_pybytes() for i in kept])
    return block, np.array(kept, np.int64), np.array(gone, np.int64)


def candidates(block: Block, side: pa.Table, buckets: int) -> dict[bytes, tuple[int, int, int, list[tuple[int, int]]]]:
    """Runs whose anchor hash occurs elsewhere, by content: (hash, least id, first such window, [(id, window)])."""
    bits = {r["bucket"]: r["bits"] for r in side.to_pylist() if r["kind"] == BITS}
    pieces = list(block.runs())
    listed = np.unique(np.concatenate([h for h, _, _ in pieces])) if pieces else np.zeros(0, np.uint64)
    again = np.zeros(len(listed), bool)
    for bucket, some in dealt(listed, buckets):
        if bucket in bits:
            again[some] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8))[: some.stop - some.start].astype(bool)
    wanted = listed[again]
    found: dict[bytes, tuple[int, int, int, list[tuple[int, int]]]] = {}
    if not len(wanted):
        return found
    for hashes, first, count in pieces:
        at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
        hit = wanted[at] == hashes
        ids = block.ids[np.searchsorted(block.ends, first[hit], side="right")]
        for h, s, n, i in zip(hashes[hit].tolist(), first[hit].tolist(), count[hit].tolist(), ids.tolist(), strict=True):
            content = block.data[s : s + n + WIDTH - 1]
            entry = found.get(content)
            if entry is None:
                found[content] = (h, i, s, [(i, s)])
            else:
                entry[3].append((i, s))  # texts are in order of id: the first one seen has the least
    return found


def cut(docs: DataFrame, carry: bool = False) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept, rest` for every row of `docs` (doc_id, text).

    `kept` holds the remaining bytes; `rest` is, with `carry`, the row's other columns as a struct. Null and empty texts
    and texts under WIDTH bytes lose nothing. A null doc_id counts as greater than all others. Rows that share a doc_id
    never remove from one another; a string repeated only within one document stays. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rest = F.struct(*[F.col(c) for c in docs.columns if c != "text"]) if carry else F.lit(None).cast("int")
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"),
        rest.alias("rest"),
    ).withColumn("digest", F.sha2("data", 256))
    narrow = stage(texts.select("id", "digest", F.octet_length("data").alias("n")), "digests")
    size = narrow.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, size // BLOCK_BYTES)
    buckets = max(1, blocks // 2)

    block_of = F.pmod(F.xxhash64("id", "digest", "salt"), F.lit(blocks)).alias("block")
    weight = F.sum(F.col("n") + ROW_BYTES)
    alike = narrow.groupBy("id", "digest").agg(F.ceil(weight / BLOCK_BYTES).cast("int").alias("salts"), F.count("*").alias("rows"))
    alike = stage(alike.where("salts > 1 and rows > 1").select("id", "digest", "salts"), "alike")
    salts = F.coalesce("salts", F.lit(1))
    # results do not depend on which block a row is in: ids decide, and each block learns which texts are copies
    texts = texts.withColumn("row", F.monotonically_increasing_id()).join(alike, ["id", "digest"], "left")
    texts = texts.withColumn("salt", F.pmod("row", salts).cast("int")).select(block_of, "id", "digest", "data", "rest")
    first = narrow.where(F.col("n") >= WIDTH).groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    copies = narrow.join(first.where("first < last").select("digest", "first"), "digest").where("id > first")
    packed_id = F.unhex(F.lpad(F.hex("id"), 16, "0"))
    none = F.lit(None).cast("binary")
    copies = copies.select("id", "digest").distinct().join(alike, ["id", "digest"], "left")
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    copies = copies.select(
        block_of, F.lit(COPY).alias("kind"), F.lit(0).cast("long").alias("bucket"),
        packed_id.alias("ids"), none.alias("starts"), F.unhex("digest").alias("bits"),
    ).distinct()
    copies = stage(copies, "copies")

    def listing(texts_: pa.Table, side: pa.Table) -> pa.Table:
        if not texts_.num_rows:
            return LISTED_SCHEMA.empty_table()
        number = texts_["block"][0].as_py()
        block, _, _ = opened(texts_, side)
        hashes, of = [], []
        for h, s, _ in block.runs():
            hashes.append(h)
            of.append(np.searchsorted(block.ends, s, side="right"))
        if not hashes:
            return LISTED_SCHEMA.empty_table()
        h, d = np.concatenate(hashes), np.concatenate(of)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        first_ = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        last = np.r_[first_[1:], len(h)] - 1
        h, twice = h[first_], d[first_] != d[last]
        rows = [(b, number, h[s].tobytes(), np.packbits(twice[s]).tobytes()) for b, s in dealt(h, buckets)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), LISTED_SCHEMA, strict=True)], schema=LISTED_SCHEMA)

    def shared(listed: pa.Table) -> pa.Table:
        bucket = listed["bucket"][0].as_py()
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in listed["hashes"]]
        twice = [
            np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8))[: len(p)].astype(bool)
            for x, p in zip(listed["twice"], parts, strict=True)
        ]
        h, t = np.concatenate(parts), np.concatenate(twice)
        order = np.argsort(h, kind="stable")
        h = h[order]
        same = h[1:] == h[:-1]
        many = np.r_[False, same] | np.r_[same, False]
        out = np.empty(len(h), bool)
        out[order] = many
        out |= t
        rows, at = [], 0
        for number, p in zip(listed["block"].to_pylist(), parts, strict=True):
            mine = out[at : at + len(p)]
            at += len(p)
            if mine.any():
                rows.append((number, BITS, bucket, None, None, np.packbits(mine).tobytes()))
        if not rows:
            return SIDE_SCHEMA.empty_table()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SIDE_SCHEMA, strict=True)], schema=SIDE_SCHEMA)

    def sending(texts_: pa.Table, side: pa.Table) -> pa.Table:
        if not texts_.num_rows:
            return SENT_SCHEMA.empty_table()
        number = texts_["block"][0].as_py()
        block, _, _ = opened(texts_, side)
        found = candidates(block, side, buckets)
        h = np.array([v[0] for v in found.values()], np.uint64)
        order = np.argsort(h, kind="stable")
        contents, values = list(found), list(found.values())
        rows = []
        for bucket, some in dealt(h[order], buckets):
            mine = order[some]
            ids = np.array([values[i][1] for i in mine], np.int64)
            starts = np.array([values[i][2] for i in mine], np.int64)
            counts = np.array([len(contents[i]) - WIDTH + 1 for i in mine], np.int32)
            rows.append((bucket, number, ids.tobytes(), starts.tobytes(), counts.tobytes(), b"".join(contents[i] for i in mine)))
        if not rows:
            return SENT_SCHEMA.empty_table()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SENT_SCHEMA, strict=True)], schema=SENT_SCHEMA)

    def deciding(sent: pa.Table) -> pa.Table:
        bucket = sent["bucket"][0].as_py()
        column = {n: [x.as_buffer() for x in sent[n]] for n in ("ids", "starts", "counts")}
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in column["ids"]])
        counts = np.concatenate([np.frombuffer(x, np.int32) for x in column["counts"]]).astype(np.int64)
        data = b"".join(x.as_buffer().to_pybytes() for x in sent["data"])
        begin = np.r_[0, np.cumsum(counts + WIDTH - 1)[:-1]]
        run = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        offset = (np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int8)
        order, first_ = suffix_groups(data, begin[run] + offset)
        own = ids[run[order]]
        least = np.repeat(np.minimum.reduceat(own, first_), np.diff(np.r_[first_, len(own)]))
        earlier = order[least < own]
        masks = np.bincount(run[earlier], np.exp2(offset[earlier].astype(float)), len(counts)).astype(np.int64)
        rows, at = [], 0
        for number, starts in zip(sent["block"].to_pylist(), column["starts"], strict=True):
            place = np.frombuffer(starts, np.int64)
            mine = masks[at : at + len(place)]
            at += len(place)
            if mine.any():
                rows.append((number, MARKS, bucket, None, place[mine > 0].tobytes(), mine[mine > 0].tobytes()))
        if not rows:
            return SIDE_SCHEMA.empty_table()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SIDE_SCHEMA, strict=True)], schema=SIDE_SCHEMA)

    kind_of_rest = docs.select(rest.alias("rest")).schema[0].dataType
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, rest " + kind_of_rest.simpleString()

    def cutting(texts_: pa.Table, side: pa.Table) -> pa.Table:
        block, kept, gone = opened(texts_, side) if texts_.num_rows else (Block([], []), np.zeros(0, int), np.zeros(0, int))
        mask = np.zeros(len(block.data) + 1, bool)
        marks: dict[int, int] = {}
        for r in side.to_pylist():
            if r["kind"] == MARKS:
                marks.update(zip(np.frombuffer(r["starts"], np.int64).tolist(), np.frombuffer(r["bits"], np.int64).tolist(), strict=True))
        for content, (_, least, start, places) in candidates(block, side, buckets).items():
            bits = marks.get(start, 0)
            every = (1 << (len(content) - WIDTH + 1)) - 1
            for i, s in places:
                left = every if i > least else bits
                if left == every:
                    mask[s : s + len(content)] = True
                    continue
                while left:
                    low = (left & -left).bit_length() - 1
                    mask[s + low : s + low + WIDTH] = True
                    left &= left - 1
        whole = np.frombuffer(block.data, np.uint8)
        rows = []
        for s, e in zip(block.starts.tolist(), block.ends.tolist(), strict=True):
            off = mask[s:e]
            removed = int(off.sum())
            spans = int((off[1:] & ~off[:-1]).sum() + off[:1].sum()) if removed else 0
            rows.append((e - s, removed, spans, whole[s:e][~off].tobytes() if removed else block.data[s:e]))
        rows += [(n, n, 1, b"") for n in (len(texts_["data"][int(i)].as_buffer()) for i in gone)]
        order = np.r_[kept, gone].astype(np.int64)
        taken = texts_.take(pa.array(order))
        ids = pa.array([None if i == NO_ID else i for i in taken["id"].to_pylist()], pa.int64())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        others = taken["rest"].combine_chunks()
        if pa.types.is_struct(others.type):  # a literal column says it has no nulls; the declared type allows them
            others = others.cast(pa.struct([pa.field(f.name, f.type, nullable=True) for f in others.type]))
        arrays = [ids, *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)), others]
        pa.default_memory_pool().release_unused()  # the worker lives on through later stages
        return pa.Table.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "rest"])

    dealt_texts = texts.groupBy("block")
    listed = dealt_texts.cogroup(copies.groupBy("block")).applyInArrow(listing, LISTED)
    bits = listed.groupBy("bucket").applyInArrow(shared, SIDE)
    sent = dealt_texts.cogroup(copies.union(bits).groupBy("block")).applyInArrow(sending, SENT)
    marks = sent.groupBy("bucket").applyInArrow(deciding, SIDE)
    side = copies.union(bits).union(marks)
    return dealt_texts.cogroup(side.groupBy("block")).applyInArrow(cutting, out)


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with repeated strings cut out of `text`; bytes that are no longer whole characters go too.

    A column n_chars, if there is one, is set to the new text's length. Null texts become empty.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([b.as_buffer().to_pybytes().decode("utf-8", "ignore") for b in batch.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([texts, batch.column(1)], names=["text", "rest"])

    kept = cut(docs, carry=True).select("kept", "rest")
    kept = kept.mapInArrow(whole, "text string, rest " + kept.schema["rest"].dataType.simpleString())
    columns = [F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns = [F.length("text").cast(kind).alias("n_chars") if c == "n_chars" else x for c, x in zip(docs.columns, columns, strict=True)]
    return kept.select(*columns)


@query("op3_suffix_repeats")
def suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
