"""Feature tables in blocks of rows, met by tables of columns: cluster centres, coefficients, directions.

A block holds some thousand rows, dense or sparse, as one row of a table that is kept partitioned by block. A table of
columns is (at, slot, value): column number, which vector, value. `Blocks.met` sends a block only the columns that it has,
so neither the features nor a table of columns is ever whole in one place, on the driver or in a task, whatever their width.
What goes between blocks and columns is packed: columns lie in buckets, a bucket knows which of its columns a block has and
where, and one row carries all that a bucket and a block have to tell each other.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.operators.packed import loosened, tightened
from chronotext.session import stage

#: Values meant to go to one block, and rows below which a table is not dealt further just to fill the task slots.
BLOCK_VALUES, LEAST_ROWS = 1 << 20, 64
#: Blocks for each bucket of columns.
BLOCKS_A_BUCKET = 4
#: Column numbers below zero name what belongs to a whole vector (its length, an intercept); every block gets those.
WHOLE = (-1, -2, -3)

#: Widths below zero: sparse blocks of values as they are, and of values made from counts (see `counted_row`).
PLAIN, SHARES, SURPRISE = -1, -2, -3
BLOCK_KIND = "block long, width int, ids binary, starts binary, at binary, local binary, slim binary"
SENT_KIND = "block long, pos binary, slot binary, value binary, payload binary"
#: What `Blocks.gathered` takes: packed sums of a bucket's columns (kind -1), or anything else.
SUM_KIND = "kind int, a long, b long, v double, payload binary, at binary, slot binary, value binary"


class Part:
    """The rows of one block inside a task."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.block, width = row["block"], row["width"]
        self.ids = read("ids", np.int64)
        self.n = len(self.ids)
        if width >= 0:
            self.values = read("slim", np.float64)
            self.at, self.matrix = np.arange(width), self.values.reshape(self.n, width)
            return
        self.matrix, self.starts, self.at = None, read("starts", np.int64), read("at", np.int64)  # the columns of the block in order
        self.row = np.repeat(np.arange(self.n), np.diff(self.starts))
        if width == PLAIN:
            self.local, self.values = read("local", np.int32), read("slim", np.float64)
            return
        self.local = np.cumsum(loosened(row["local"], np.int32, len(self.row)), dtype=np.int32)
        beside = 8 * (self.n + len(self.at) + 1)
        scale, of_row, of_column = np.split(np.frombuffer(row["slim"][:beside]), [1, self.n + 1])
        count = loosened(row["slim"][beside:], np.int64, len(self.row))
        self.values = from_counts(width, count * scale, of_row[self.row], of_column[self.local])

    def some(self, rows: np.ndarray) -> Part:
        """These rows alone, with all columns of the block."""
        if len(rows) == self.n and (rows == np.arange(self.n)).all():
            return self
        out = object.__new__(Part)
        out.block, out.ids, out.n, out.at = self.block, self.ids[rows], len(rows), self.at
        if self.matrix is not None:
            out.matrix, out.values = self.matrix[rows], None
            return out
        sizes = np.diff(self.starts)[rows]
        out.matrix, out.starts = None, np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(self.starts[rows] - out.starts[:-1], sizes) + np.arange(out.starts[-1])
        out.local, out.values, out.row = self.local[take], self.values[take], np.repeat(np.arange(len(rows)), sizes)
        return out

    def squares(self) -> np.ndarray:
        """The squared length of every row."""
        if self.matrix is not None:
            return np.einsum("ij,ij->i", self.matrix, self.matrix)
        return np.bincount(self.row, self.values * self.values, self.n)

    def products(self, columns: np.ndarray) -> np.ndarray:
        """Rows times columns (the columns of this block x vectors)."""
        if self.matrix is not None:
            return self.matrix @ columns
        return self._summed(self.row, self.local, columns, self.n)

    def transposed(self, by: np.ndarray) -> np.ndarray:
        """Columns of this block x vectors: the rows summed with the weights `by` (rows x vectors)."""
        if self.matrix is not None:
            return self.matrix.T @ by
        return self._summed(self.local, self.row, by, len(self.at))

    def _summed(self, to: np.ndarray, of: np.ndarray, by: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, by.shape[1]))
        for j, column in enumerate(np.ascontiguousarray(by.T)):  # one column at a time stays near
            out[:, j] = np.bincount(to, self.values * column[of], size)
        return out

    def columns(self, sent: Sent, slots: np.ndarray) -> np.ndarray:
        """What was sent of these vectors, as (columns of this block x vectors)."""
        out = np.zeros((len(self.at), len(slots)))
        for pos, slot, value in sent.cells:
            want = np.isin(slot, slots)
            out[pos[want], np.searchsorted(slots, slot[want])] = value[want]
        return out


class Sent:
    """Cells of the columns of one block, and of vectors as a whole."""

    def __init__(self, table: pa.Table, alone: dict[tuple[int, int], float]):
        self.alone, self.cells = alone, []
        for pos, slot, value in zip(*(table[c].to_pylist() for c in ("pos", "slot", "value")), strict=True):
            if pos is not None:
                value = np.frombuffer(value)
                self.cells.append((np.frombuffer(pos, np.int32), _unpacked(slot, len(value)), value))


def from_counts(width: int, count: np.ndarray, of_row: np.ndarray, of_column: np.ndarray) -> np.ndarray:
    """Values of a block made from counts: shares of a row's length, or logarithms of counts over what is expected."""
    return count * of_column / of_row if width == SHARES else np.log(count / (of_row * of_column))


def _packed(slot: np.ndarray) -> bytes:
    """Vector numbers in two bytes each, if they are small."""
    return slot.astype(np.int16 if not len(slot) or slot.max() < 1 << 15 else np.int64).tobytes()


def _unpacked(slot: bytes, n: int) -> np.ndarray:
    return np.frombuffer(slot, np.int16 if len(slot) == 2 * n else np.int64).astype(np.int64)


def whole(sent: Sent, at: int) -> dict[int, float]:
    """What was sent of vectors as a whole, by vector."""
    return {slot: value for (where, slot), value in sent.alone.items() if where == at}


def sums(at: np.ndarray, slot: np.ndarray, value: np.ndarray, n_buckets: int, rest: list[tuple] = ()) -> pa.Table:
    """Rows of `SUM_KIND`: what a block adds to (at, slot), packed by bucket, and `rest` as (kind, a, b, v, payload).

    Cells at `WHOLE` go to a bucket of their own.
    """
    at, slot = np.asarray(at, np.int64), np.broadcast_to(np.asarray(slot, np.int64), np.shape(at))
    value = np.broadcast_to(np.asarray(value, float), at.shape)
    bucket = _bucket(at, n_buckets)
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    runs = np.split(order, first[1:]) if len(names) else []
    rows = [(-1, int(n), 0, 0.0, None, at[r].tobytes(), _packed(slot[r]), value[r].tobytes()) for n, r in zip(names, runs, strict=True)]
    rows += [(*r, None, None, None) for r in rest]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), *[pa.binary()] * 4]
    columns = list(zip(*rows, strict=True)) or [()] * 8
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[p.split()[0] for p in SUM_KIND.split(", ")])


def _bucket(at: np.ndarray, n: int) -> np.ndarray:
    return np.where(at < 0, -1, (at ^ (at >> 31)) % n)


def labels_of(part: Part, payload: bytes | None) -> tuple[Part, np.ndarray]:
    """The rows of a block that have a label, and their labels."""
    ids, label = np.frombuffer(payload, np.int64).reshape(2, -1) if payload else np.zeros((2, 0), np.int64)
    order = np.argsort(part.ids)
    return part.some(order[np.searchsorted(part.ids[order], ids)]), label


def added_up(made: DataFrame) -> DataFrame:
    """(at, slot, value): the sums over all blocks of what was packed by `sums`."""

    def added(rows: pa.Table) -> pa.Table:
        value = [np.frombuffer(b) for b in rows["value"].to_pylist()]
        slot = np.concatenate([_unpacked(b, len(v)) for b, v in zip(rows["slot"].to_pylist(), value, strict=True)])
        at = np.concatenate([np.frombuffer(b, np.int64) for b in rows["at"].to_pylist()])
        names, column = np.unique(at, return_inverse=True)
        slots, which = np.unique(slot, return_inverse=True)
        both, place = np.unique(column * len(slots) + which, return_inverse=True)
        total = np.bincount(place, np.concatenate(value), len(both))
        cells = [names[both // max(len(slots), 1)], slots[both % max(len(slots), 1)], total]
        return pa.table([pa.array(c) for c in cells], names=["at", "slot", "value"])

    packed = made.where("kind = -1").select(F.col("a").alias("bucket"), "at", "slot", "value")
    return packed.groupBy("bucket").applyInArrow(added, "at long, slot long, value double")


class Blocks:
    """Blocks of rows (`rows`, kept) and the columns that each has (`columns`: bucket, block, at, pos; kept)."""

    def __init__(self, made: DataFrame, n_rows: int, n_blocks: int):
        spark = made.sparkSession
        most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        parts = max(1, min(n_blocks, most))
        self.n_rows, self.n_blocks, self.spark = n_rows, n_blocks, spark
        n_buckets = self.n_buckets = max(-(-n_blocks // BLOCKS_A_BUCKET), min(n_blocks, spark.sparkContext.defaultParallelism))
        self.rows = made.repartition(parts, "block").persist(StorageLevel.MEMORY_AND_DISK)

        def found(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    at = Part(row).at
                    bucket = _bucket(at, n_buckets)
                    order = np.argsort(bucket, kind="stable")
                    names, first = np.unique(bucket[order], return_index=True)
                    runs = np.split(order, first[1:]) if len(names) else []
                    packs = [pa.array([c[r].tobytes() for r in runs], pa.binary()) for c in (at, np.arange(len(at), dtype=np.int32))]
                    cells = [pa.array(names, pa.int64()), pa.array([row["block"]] * len(names), pa.int64()), *packs]
                    yield pa.RecordBatch.from_arrays(cells, names=["bucket", "block", "at", "pos"])

        columns = self.rows.mapInArrow(found, "bucket long, block long, at binary, pos binary")
        self.columns = columns.repartition(max(1, min(n_buckets, most)), "bucket").persist(StorageLevel.MEMORY_AND_DISK)

    def _names(self) -> DataFrame:
        """(bucket, names): the distinct columns of every bucket, packed."""

        def named(rows: pa.Table) -> pa.Table:
            names = np.unique(np.concatenate([np.frombuffer(b, np.int64) for b in rows["at"].to_pylist()]))
            return pa.table([rows["bucket"][:1], pa.array([names.tobytes()], pa.binary())], names=["bucket", "names"])

        return self.columns.groupBy("bucket").applyInArrow(named, "bucket long, names binary")

    def every_column(self) -> DataFrame:
        """(at): all column numbers."""

        def listed(batches):
            for batch in batches:
                for names in batch["names"].to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(names, np.int64))], names=["at"])

        return self._names().mapInArrow(listed, "at long")

    def n_columns(self) -> int:
        return (self._names().agg(F.sum(F.length("names").cast("long"))).first()[0] or 0) // 8

    def column_names(self) -> np.ndarray:
        """All column numbers in order; for tables that are known to have few."""
        return np.array(sorted(r["at"] for r in self.every_column().collect()), np.int64)

    def block_of(self, row_id: str | Column = "row_id") -> Column:
        return F.pmod(F.xxhash64(row_id), F.lit(self.n_blocks))

    def _routed(self, cells: DataFrame) -> DataFrame:
        """Rows of `SENT_KIND`: the cells (at, slot, value) of the columns that each block has, with their places there."""

        def routed(asked: pa.Table, cells: pa.Table) -> pa.Table:
            out = []
            if len(asked) and len(cells):
                at = cells["at"].to_numpy()
                order = np.argsort(at, kind="stable")
                names, first, size = np.unique(at[order], return_index=True, return_counts=True)
                slot, value = cells["slot"].to_numpy()[order], cells["value"].to_numpy()[order]
                for block, mine, pos in zip(*(asked[c].to_pylist() for c in ("block", "at", "pos")), strict=True):
                    mine, pos = np.frombuffer(mine, np.int64), np.frombuffer(pos, np.int32)
                    place = np.minimum(np.searchsorted(names, mine), len(names) - 1)
                    hit = names[place] == mine
                    sizes = size[place[hit]]
                    take = np.repeat(first[place[hit]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                    if len(take):
                        out.append((block, np.repeat(pos[hit], sizes).tobytes(), _packed(slot[take]), value[take].tobytes(), None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            return pa.table([pa.array(c, pa.binary() if i else pa.int64()) for i, c in enumerate(columns)], names=names_)

        names_ = [p.split()[0] for p in SENT_KIND.split(", ")]
        at = F.col("at").cast("long")
        bucket = F.pmod(at.bitwiseXOR(F.shiftright(at, 31)), F.lit(self.n_buckets))
        mine = cells.where("at >= 0").select(bucket.alias("bucket"), at.alias("at"), F.col("slot").cast("long").alias("slot"), F.col("value").cast("double").alias("value"))
        return self.columns.groupBy("bucket").cogroup(mine.groupBy("bucket")).applyInArrow(routed, SENT_KIND)

    def met(self, cells: DataFrame | None, each: Callable, kind: str, state: DataFrame | None = None) -> DataFrame:
        """each(part, sent, payload) -> pa.Table for every block.

        `sent` has the cells (at, slot, value) of the block's columns and of `WHOLE` (a few numbers a vector); `payload` is the
        block's row of `state` (block, payload), or None.
        """
        nothing = [F.lit(None).cast("binary").alias(c) for c in ("pos", "slot", "value")]
        sides, alone = [], {}
        if cells is not None:
            sides.append(self._routed(cells))
            alone = {(r["at"], r["slot"]): r["value"] for r in cells.where("at < 0").select("at", "slot", "value").collect()}
        if state is not None:
            sides.append(state.select("block", *nothing, "payload"))
        if not sides:
            sides.append(self.rows.limit(0).select("block", *nothing, F.lit(None).cast("binary").alias("payload")))
        sent = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])

        def meeting(block: pa.Table, sent: pa.Table) -> pa.Table:
            if not len(block):
                return empty
            payloads = [p for p in sent["payload"].to_pylist() if p is not None]
            return each(Part(block.to_pylist()[0]), Sent(sent, alone), payloads[0] if payloads else None)

        empty = _empty(self.spark, kind)
        return self.rows.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(meeting, kind)

    def summed(self, made: DataFrame) -> DataFrame:
        """(at, slot, value): the sums over all blocks of what was packed by `sums`."""
        return added_up(made)

    def labelled(self, rows: DataFrame) -> DataFrame:
        """(block, payload): row ids and labels of (row_id, label) by block, for `met` and `labels_of`."""

        def packed(rows_: pa.Table) -> pa.Table:
            ids, label = rows_["row_id"].to_numpy(), rows_["label"].to_numpy()
            order = np.argsort(ids)
            cells = [[rows_["block"][0].as_py()], [np.concatenate([ids[order], label[order]]).astype(np.int64).tobytes()]]
            return pa.table([pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.binary())], names=["block", "payload"])

        named = rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("label").cast("long").alias("label"))
        named = named.withColumn("block", self.block_of())
        return stage(named.groupBy("block").applyInArrow(packed, "block long, payload binary"), "labels")

    def of_rows(self, wanted: DataFrame) -> DataFrame:
        """(slot, at, value) of the rows named by `wanted` (slot, row_id)."""
        kind = "slot long, at long, value double"

        def picked(block: pa.Table, wanted: pa.Table) -> pa.Table:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if len(block) and len(wanted):
                part = Part(block.to_pylist()[0])
                place = {i: p for p, i in enumerate(part.ids.tolist())}
                for slot, row_id in zip(wanted["slot"].to_pylist(), wanted["row_id"].to_pylist(), strict=True):
                    p = place[row_id]
                    if part.matrix is not None:
                        at, values = part.at, part.matrix[p]
                    else:
                        some = slice(part.starts[p], part.starts[p + 1])
                        at, values = part.at[part.local[some]], part.values[some]
                    out.append((np.full(len(at), slot), at, values))
            return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("slot", "at", "value"), zip(*out, strict=True), strict=True)})

        asked = wanted.select("slot", "row_id", self.block_of().alias("block"))
        return self.rows.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(picked, kind)

    def close(self) -> None:
        self.rows.unpersist()
        self.columns.unpersist()

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _empty(spark, kind: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.table({n: pa.array([], kinds[t]) for n, t in (part.split() for part in kind.split(", "))})


def block_count(spark, rows: int, values: int) -> int:
    return max(1, -(-values // BLOCK_VALUES), min(spark.sparkContext.defaultParallelism, rows // LEAST_ROWS))


def dense_blocks(features: DataFrame) -> Blocks:
    """Blocks of (row_id, features array); column numbers are positions in the array."""
    held = features.select(F.col("row_id").cast("long").alias("row_id"), F.col("features").cast("array<double>").alias("features"))
    rows, width = held.agg(F.count("*"), F.coalesce(F.max(F.size("features")), F.lit(0))).first()
    n_blocks = block_count(held.sparkSession, rows, rows * width)

    def made(rows_: pa.Table) -> pa.Table:
        ids = rows_["row_id"].to_numpy()
        values = rows_["features"].combine_chunks().flatten().to_numpy()
        cells = [[rows_["block"][0].as_py()], [width], [ids.tobytes()], [b""], [b""], [b""], [values.tobytes()]]
        return pa.table([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=names)

    kinds, names = _layout()
    placed = held.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(n_blocks)))
    return Blocks(stage(placed.groupBy("block").applyInArrow(made, BLOCK_KIND), "blocks"), rows, n_blocks)


def sparse_row(block: int, ids: np.ndarray, starts: np.ndarray, at: np.ndarray, value: np.ndarray) -> pa.Table:
    """A sparse block: entries of the rows `ids`, from `starts` on, at columns `at`."""
    names_, local = np.unique(np.asarray(at, np.int64), return_inverse=True)
    cells = (np.asarray(ids, np.int64), np.asarray(starts, np.int64), names_, local.astype(np.int32), np.asarray(value, float))
    kinds, names = _layout()
    return pa.table([pa.array(c, t) for c, t in zip([[block], [PLAIN], *([c.tobytes()] for c in cells)], kinds, strict=True)], names=names)


def counted_row(
    width: int, block: int, ids: np.ndarray, starts: np.ndarray, at: np.ndarray, count: np.ndarray, of_row: np.ndarray, of_column: np.ndarray,
    scale: float = 1.0,
) -> pa.Table:
    """A sparse block of the values `from_counts` of `count` x `scale`: only small numbers are kept by entry.

    `of_row` is given by row, `of_column` by entry.
    """
    names_, first, local = np.unique(np.asarray(at, np.int64), return_index=True, return_inverse=True)
    slim = np.concatenate([[scale], of_row, of_column[first]]).astype(float).tobytes() + tightened(np.asarray(count, np.int64))
    cells = (np.asarray(ids, np.int64).tobytes(), np.asarray(starts, np.int64).tobytes(), names_.tobytes(), tightened(np.diff(local, prepend=0).astype(np.int32)), slim)
    kinds, names = _layout()
    return pa.table([pa.array(c, t) for c, t in zip([[block], [width], *([c] for c in cells)], kinds, strict=True)], names=names)


def sparse_blocks(values: DataFrame, ids: DataFrame) -> Blocks:
    """Blocks of (row_id, at, value), with an empty row for those of `ids` (row_id) that have no entry."""
    every = ids.select(F.col("row_id").cast("long").alias("row_id"))
    some = values.select(F.col("row_id").cast("long").alias("row_id"), F.col("at").cast("long").alias("at"), F.col("value").cast("double").alias("value"))
    rows, entries_ = every.count(), some.count()
    n_blocks = block_count(every.sparkSession, rows, entries_)

    def made(rows_: pa.Table) -> pa.Table:
        rows_ = rows_.sort_by([("row_id", "ascending"), ("at", "ascending")])
        row = rows_["row_id"].to_numpy()
        ids_, sizes = np.unique(row, return_counts=True)
        real = rows_["at"].is_valid().to_numpy()
        sizes = sizes - np.bincount(np.searchsorted(ids_, row[~real]), minlength=len(ids_))
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        at, value = (rows_[c].drop_null().to_numpy() for c in ("at", "value"))
        return sparse_row(rows_["block"][0].as_py(), ids_, starts, at, value)

    nothing = every.select("row_id", F.lit(None).cast("long").alias("at"), F.lit(None).cast("double").alias("value"))
    placed = some.unionByName(nothing).withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(n_blocks)))
    return Blocks(stage(placed.groupBy("block").applyInArrow(made, BLOCK_KIND), "blocks"), rows, n_blocks)


def _layout() -> tuple[list[pa.DataType], list[str]]:
    return [pa.int64(), pa.int32(), *[pa.binary()] * 5], [part.split()[0] for part in BLOCK_KIND.split(", ")]


register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package
