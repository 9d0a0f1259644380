"""Token ids as canonical length-limited Huffman codes in independent blocks.

Format: a folder with two Parquet tables.

`codebook` (id, length): the code length of every id that occurs, at most LIMIT bits.
Codes are canonical: by length, then by id, counting up.

`blocks`, one row for each block: `part` and `block` order the blocks; `doc_ids` and
`doc_tokens` are the documents and their numbers of ids; `first_token` is the number
of ids before the block in its part; `payload` is the bit stream, most significant bit
first, padded with zero bits; `checkpoints` are the bit offsets of every STEP-th id,
as little-endian unsigned 32-bit numbers. A block needs the codebook and nothing else.
Decoding reads LIMIT bits at a time from a table of all bit patterns, at all
checkpoints at once.

Documents lie in ascending order of their ids over all parts, null first; rows with
one id by their tokens. A block ends after the document with which it reaches
BLOCK ids, so a document is never cut. Null and empty texts hold the end id alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import shared_folder, stored
from .tokens import Encoder

LIMIT = 16  # or what so many ids need
STEP = 128
BLOCK = 1 << 18
PART = 1 << 23  # ids of a part, about
BLOCKS = (
    "part int, block int, doc_ids array<bigint>, doc_tokens array<bigint>, first_token bigint, n_tokens bigint,"
    " checkpoints binary, payload binary"
)


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits, by package merge."""
    n = len(counts)
    if limit is None:
        limit = max(LIMIT, n.bit_length())
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit in codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, kinds = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        place = np.argsort(both, kind="stable")
        level = both[place]
        kinds.append(place < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for kind in reversed(kinds):
        chosen = int(kind[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes of ids (ascending) with their lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((ids, lengths))
        self.top = int(lengths.max()) if len(lengths) else 1
        sizes = lengths[order]
        steps = np.int64(1) << (self.top - sizes)
        starts = np.concatenate([[0], np.cumsum(steps)[:-1]]) if len(steps) else np.zeros(0, np.int64)
        codes = starts >> (self.top - sizes)
        span = int(ids.max()) + 1 if len(ids) else 1
        self.code, self.length = np.zeros(span, np.uint64), np.zeros(span, np.uint64)
        self.code[ids[order]], self.length[ids[order]] = codes, sizes
        # every pattern of `top` bits starts with one code
        self.table = np.ones(1 << self.top, np.uint64)  # id, then 8 bits of length
        self.table[: int(steps.sum())] = np.repeat((ids[order] << 8) | sizes, steps)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(payload, checkpoints) of a block."""
        code, size = self.code[ids], self.length[ids]
        ends = np.cumsum(size)
        begins = ends - size
        word, bit = (begins >> np.uint64(6)).astype(np.int64), begins & np.uint64(63)
        out = np.zeros(int(ends[-1] >> np.uint64(6)) + 2, np.uint64)
        over = bit + size > np.uint64(64)
        room = np.uint64(64) - bit
        head = np.where(over, code >> np.where(over, size - room, np.uint64(0)),
                        code << np.where(over, np.uint64(0), room - size))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.bitwise_or.reduceat(head, first)
        out[word[over] + 1] |= code[over] << (np.uint64(64) - (size[over] - room[over]))
        n = int(ends[-1] + np.uint64(7)) >> 3
        return out.astype(">u8").tobytes()[:n], begins[::STEP].astype("<u4").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The n ids of a block."""
        at = np.frombuffer(checkpoints, "<u4").astype(np.int64)  # a copy
        data = np.frombuffer(payload + bytes(STEP * self.top // 8 + 8), np.uint8).astype(np.int64)
        wide = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        out = np.empty((STEP, len(at)), np.int64)
        table = self.table.astype(np.int64)
        low, mask = 32 - self.top, (1 << self.top) - 1
        for k in range(STEP):
            np.take(table, (np.take(wide, at >> 3) >> (low - (at & 7))) & mask, out=out[k])
            at += out[k] & 255
        return (out >> 8).astype(np.uint32).T.reshape(-1)[:n]


def id_type(tokenizer: str, end_id: int) -> str:
    return "<u2" if max(Encoder.of(tokenizer).size, end_id + 1) <= 1 << 16 else "<u4"


def token_rows(docs: DataFrame, tokenizer: str, end_id: int, key: str, text: str) -> DataFrame:
    """(kind 0, id, its ids) of every document, then (kind 1, token id, its count)
    of the task: at most one row for each entry of the vocabulary. Ids have two bytes
    where the whole vocabulary fits, else four."""
    kind = id_type(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(tokenizer), np.array([end_id], "<u4").tobytes()
        encode = encoder.ids
        counts = np.zeros(0, np.int64)
        for b in batches:
            for i in range(0, len(b), 1000):
                some = [x + end for x in encode([t or "" for t in b.column(1).slice(i, 1000).to_pylist()])]
                c = np.bincount(np.frombuffer(b"".join(some), "<u4"))
                if len(c) > len(counts):
                    c[: len(counts)] += counts
                    counts = c
                else:
                    counts[: len(c)] += c
                some = [np.frombuffer(x, "<u4").astype(kind).tobytes() for x in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(some), np.int8)), b.column(0).slice(i, 1000).cast(pa.int64()),
                     pa.array(some, pa.binary()), pa.nulls(len(some), pa.int64())], ["kind", "doc", "ids", "n"])
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(found), np.int8)), pa.array(found), pa.nulls(len(found), pa.binary()),
             pa.array(counts[found])], ["kind", "doc", "ids", "n"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, "kind tinyint, doc bigint, ids binary, n bigint")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encodes all documents into the folder `path`, in two passes over their ids."""
    spark = docs.sparkSession
    rows = stored(token_rows(docs, tokenizer, end_id, key, text), "huffman-ids")
    # the vocabulary bounds this: one row for each id that occurs
    found = rows.where("kind = 1").groupBy("doc").agg(F.sum("n")).collect()
    found = np.array(sorted(map(tuple, found)), np.int64).reshape(-1, 2)
    lengths = code_lengths(found[:, 1]) if len(found) else found[:, 1]
    table = [(int(i), int(n)) for i, n in zip(found[:, 0], lengths)]
    spark.createDataFrame(table, "id bigint, length int").coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast(Codebook(found[:, 0], lengths))
    parts = max(1, -(-int(found[:, 1].sum()) // PART))
    kind = id_type(tokenizer, end_id)
    width = int(kind[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        docs_of, data, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, held
            payload, points = book.value.encode(np.frombuffer(b"".join(data), kind))
            row = {"part": part, "block": block, "doc_ids": list(docs_of), "doc_tokens": [len(d) // width for d in data],
                   "first_token": before, "n_tokens": held, "checkpoints": points, "payload": payload}
            block, before = block + 1, before + held
            docs_of.clear()
            data.clear()
            held = 0
            return pa.RecordBatch.from_pylist([row], pa.schema([
                ("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                ("doc_tokens", pa.list_(pa.int64())), ("first_token", pa.int64()), ("n_tokens", pa.int64()),
                ("checkpoints", pa.binary()), ("payload", pa.binary())]))

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs_of.append(doc)
                data.append(ids)
                held += len(ids) // width
                if held >= BLOCK:
                    yield flush()
        if data:
            yield flush()

    ordered = rows.where("kind = 0").select("doc", "ids").repartitionByRange(parts, "doc")
    ordered.sortWithinPartitions("doc", "ids").mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids): every document with the number of ids before it
    and its ids as little-endian unsigned 32-bit numbers, from the files alone."""
    table = np.array([tuple(r) for r in spark.read.parquet(f"{path}/codebook").collect()], np.int64).reshape(-1, 2)
    book = spark.sparkContext.broadcast(Codebook(table[:, 0], table[:, 1]))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # one row for each part, of which each was one task
    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = {r[0]: r[1] for r in sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0))).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                data = book.value.decode(r["payload"], r["checkpoints"], r["n_tokens"]).astype("<u4").tobytes()
                sizes = np.array(r["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                ids = [data[4 * a : 4 * z] for a, z in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["first_token"] + bases[r["part"]]),
                     pa.array(sizes), pa.array(ids, pa.binary())], [key, "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, f"`{key}` bigint, start bigint, n_tokens bigint, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    path = shared_folder(docs.sparkSession, "huffman")
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)
