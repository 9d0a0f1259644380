"""Best-fit decreasing packing of documents into sequences of bounded length.

Texts become token ids and an end id. A document longer than a sequence is cut;
its first piece takes the remainder, all others are full. Pieces are packed by
best-fit decreasing: longest first, each into the open sequence with the least room
that is enough. Pieces of one length are alike, so the packing of any number of them
is settled by the counts of lengths, at most `capacity` numbers. The driver packs the
counts, whole runs of alike sequences at a time; a segment tree over remaining
capacities finds the tightest open run. Its result is a list of runs whose size
depends on the capacity, not on the number of documents. Spark numbers the pieces of
each length and looks every number up in the runs.

Null and empty texts are pieces of the end id alone. Repeated rows are packed each.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored
from .tokens import Encoder

PIECES = (
    "doc_id bigint, piece int, start bigint, length int, ids binary, ids_crc32 bigint, chunk int, nth bigint"
)


def _encoded(batch: pa.RecordBatch, encode) -> Iterator[tuple[int, bytes]]:
    for i in range(0, len(batch), 1000):
        some = batch.slice(i, 1000)
        yield from zip(some.column(0).to_pylist(), encode([t or "" for t in some.column(1).to_pylist()]))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their ids. (chunk, nth) number those of one length
    in a task; they hold only for this result, so it is written before it is used."""
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(tokenizer).ids
        end = np.array([end_id], "<u4").tobytes()
        seen: dict[int, int] = defaultdict(int)
        chunk = TaskContext.get().partitionId()
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
            made = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names)

        for b in batches:
            for doc, ids in _encoded(b, encode):
                ids += end
                n = len(ids) // 4
                at = 0
                for k in range(-(-n // capacity)):
                    size = (n - 1) % capacity + 1 if k == 0 else capacity
                    part = ids[4 * at : 4 * (at + size)]
                    rows.append((doc, k, at, size, part, zlib.crc32(part), chunk, seen[size]))
                    seen[size] += 1
                    at += size
                if len(rows) >= 2000:
                    yield batch()
            if rows:
                yield batch()

    return docs.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(run, PIECES)


class Tightest:
    """Segment tree over capacities: the smallest one with something open, from a
    given one on, in logarithmic time."""

    def __init__(self, top: int) -> None:
        self.size = 1 << top.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, at: int, value: bool) -> None:
        at += self.size
        self.open[at] = value
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def first(self, least: int) -> int | None:
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


@dataclass
class Runs:
    """For every length, from which number on pieces go `each` to a sequence, from
    which sequence on, and at which offset."""

    numbers: dict[int, np.ndarray]
    sequences: dict[int, np.ndarray]
    each: dict[int, np.ndarray]
    offsets: dict[int, np.ndarray]
    total: int

    def place(self, length: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.numbers[length], number, "right") - 1
        step = number - self.numbers[length][run]
        each = self.each[length][run]
        return self.sequences[length][run] + step // each, self.offsets[length][run] + step % each * length


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Runs:
    """Packs counts[n] pieces of each length n. Equal to placing one piece at a time."""
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs (first sequence, how many)
    tree = Tightest(capacity)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    total = 0

    def put(room: int, first: int, many: int) -> None:
        if many and room:
            rooms[room].append((first, many))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, number, out = counts[length], 0, []
        while left:
            room = tree.first(length)
            if room is None:
                room = capacity
                many = -(-left // (capacity // length))
                first = total
                total += many
            else:
                first, many = rooms[room].pop()
                tree.set(room, bool(rooms[room]))
            each = room // length
            filled = min(many, left // each)
            if filled:
                out.append((number, first, each, capacity - room))
                put(room - each * length, first, filled)
                number, left = number + filled * each, left - filled * each
                first, many = first + filled, many - filled
            if many and 0 < left < each:
                out.append((number, first, left, capacity - room))
                put(room - left * length, first, 1)
                number, left = number + left, 0
                first, many = first + 1, many - 1
            put(room, first, many)
        runs[length] = out
    columns = [{n: np.array([r[i] for r in out], np.int64) for n, out in runs.items()} for i in range(4)]
    return Runs(*columns, total)


def pack(made: DataFrame, capacity: int = 1024) -> DataFrame:
    """Written pieces without their ids, and `sequence_id`, `offset`."""
    spark = made.sparkSession
    light = made.drop("ids")
    per = stored(light.groupBy("chunk", "length").agg(F.count("*").alias("n")), "packing-counts")
    counts = {r[0]: r[1] for r in per.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    runs = spark.sparkContext.broadcast(best_fit_decreasing(counts, capacity))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = light.join(base, ["chunk", "length"]).select(
        *light.columns[: light.columns.index("chunk")], (F.col("base") + F.col("nth")).alias("number")
    )
    names = [*numbered.columns[:-1], "sequence_id", "offset"]
    at = numbered.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = b.column(at).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            sizes, first = np.unique(length[order], return_index=True)
            for n, rows in zip(sizes.tolist(), np.split(order, first[1:])):
                sequence[rows], offset[rows] = runs.value.place(n, number[rows])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields[:-1])
    return numbered.mapInArrow(run, schema + ", sequence_id bigint, `offset` bigint")


def sequences(made: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of every packed sequence. A group holds at
    most `capacity` ids."""
    whole = made.select("doc_id", "piece", "start", "length", "ids_crc32", "ids").distinct()
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    on = same[0] & same[1] & same[2] & same[3] & same[4]
    joined = placed.alias("p").join(whole.alias("w"), on)
    parts = F.array_sort(F.collect_list(F.struct("p.offset", "w.ids")))
    return joined.groupBy("p.sequence_id").agg(
        F.aggregate(parts, F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )
