"""Hard negatives by exact inner-product search with length buckets and coordinate
pruning.

All rows are ordered by length, longest first, and dealt into groups of consecutive
buckets. A bucket holds its vectors and, for every coordinate, the list of its rows
sorted by that coordinate of the unit vector. An anchor meets a group's buckets in
turn. It has a least score that still matters; divided by its own and the bucket's
largest length that is a least cosine. A bucket that cannot reach it is passed over
whole. Otherwise each focus coordinate (where the anchor is largest) has a feasible
range of values: outside, the best that all other coordinates could add is too little.
The ranges are cut out of the sorted lists, rows that are in all of them are candidates,
and candidates are verified by their exact score. What is found raises the least score.

The search runs twice: for the positives, the best rows of an anchor's own label, and
with their scores for the negatives, the best rows of other labels in each positive's
band of scores. Every (group, block of anchors) is a task of bounded size and hands on
at most `n` rows for each anchor (and positive), so neither rows nor anchors are ever
sent whole to all tasks.

Rows with a null id, label or vector, or a null component, take no part. Rows of one id
are one row, that of the least label and vector. An anchor is never its own positive.
Shorter vectors count as having zeros behind. Ties of scores go to the smaller id. Scores
beyond 64 bits are cut to the ends of that range. An empty table, or no anchors, gives no
rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

BUCKET = 2048  # rows of a bucket
GROUP = 65_536  # rows of a group at most, however many there are
ANCHORS = 4096  # anchors of a block, about
FOCUS = 5  # focus coordinates
EXACT = 2.0**53
INDEX = "grp int, bucket int, n int, dim int, width int, ids binary, labels binary, vectors binary, lists binary"


# ---- the index


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers of any lengths, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    dim = int(sizes.max(initial=0))
    if (sizes == dim).all():
        return values.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = values
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; zero stays zero."""
    wide = vectors.astype(np.float64)
    lengths = np.sqrt((wide * wide).sum(axis=1, keepdims=True))
    return wide / np.where(lengths > 0, lengths, 1)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of length to buckets of this partition's group."""
    names = [f.split()[0] for f in INDEX.split(", ")]
    types = [pa.int32()] * 5 + [pa.binary()] * 4
    group, number = TaskContext.get().partitionId(), 0
    waiting: list[pa.RecordBatch] = []

    def bucket(rows: pa.Table) -> pa.RecordBatch:
        nonlocal number
        vectors = _matrix(rows.column("vector"))
        lists = np.argsort(_unit(vectors), axis=0, kind="stable").T.astype("<u2")
        top = int(max(vectors.max(initial=0), -int(vectors.min(initial=0))))
        width = next(w for w in (1, 2, 4, 8) if w == 8 or top < 1 << (8 * w - 1))
        row = [group, number, len(vectors), vectors.shape[1], width,
               rows.column("id").to_numpy().astype("<i8").tobytes(), rows.column("label").to_numpy().astype("<i8").tobytes(),
               vectors.astype(f"<i{width}").tobytes(), lists.tobytes()]
        number += 1
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) >= BUCKET:
            rows = pa.Table.from_batches(waiting)
            at = 0
            while len(rows) - at >= BUCKET:
                yield bucket(rows.slice(at, BUCKET))
                at += BUCKET
            waiting = rows.slice(at).to_batches()
    if sum(map(len, waiting)):
        yield bucket(pa.Table.from_batches(waiting))


def index(rows: DataFrame) -> DataFrame:
    """Written buckets of (id, label, vector) rows. Rows of equal length, copies of one
    vector for instance, are dealt out by id."""
    total = rows.count()
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(-(-total // BUCKET), max(tasks, -(-total // GROUP))))
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    ordered = rows.withColumn("length", length).repartitionByRange(groups, F.desc("length"), "id")
    ordered = ordered.sortWithinPartitions(F.desc("length"), "id").select("id", "label", "vector")
    return stored(ordered.mapInArrow(_buckets, INDEX), "length-buckets")


# ---- the search of a group by a block of anchors


class Bucket:
    def __init__(self, row: dict) -> None:
        n, dim = row["n"], row["dim"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.labels = np.frombuffer(row["labels"], "<i8")
        self.vectors = np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(n, dim).astype(np.float64 if row["width"] < 8 else object)
        self.lists = np.frombuffer(row["lists"], "<u2").reshape(dim, n)
        wide = self.vectors.astype(np.float64)
        self.longest = float(np.sqrt((wide * wide).sum(axis=1).max(initial=0.0)))
        self.top = float(np.abs(wide).max(initial=0.0))
        unit = _unit(wide)
        self.sorted = np.take_along_axis(unit.T, self.lists.astype(np.int64), axis=1)

    def scores(self, anchor: Anchor, rows: np.ndarray | slice) -> np.ndarray:
        vectors = self.vectors[rows]
        dim = min(vectors.shape[1], len(anchor.vector))
        if dim * self.top * anchor.top < EXACT and vectors.dtype != object:
            return (vectors[:, :dim] @ anchor.wide[:dim]).astype(np.int64)
        exact = [sum(int(a) * int(b) for a, b in zip(v, anchor.vector)) for v in vectors]
        return np.array([max(min(s, 2**63 - 1), -(2**63)) for s in exact], np.int64)

    def candidates(self, anchor: Anchor, least: float) -> np.ndarray | slice:
        """Rows whose score may be `least` or more."""
        reach = anchor.length * self.longest
        if least <= -reach:
            return slice(None)
        cosine = (least / reach if reach > 0 else np.inf) - 1e-9
        if cosine > 1:
            return slice(0, 0)
        # a coordinate is the cosine of an angle to its axis; the anchor's angle and a
        # row's differ by no more than the angle between the two
        wide = float(np.arccos(max(cosine, -1.0))) + 1e-9
        met = np.zeros(len(self.ids), np.uint8)
        used = 0
        for f in anchor.focus:
            if f >= len(self.lists):
                continue
            at = anchor.angles[f]
            low = np.cos(min(np.pi, at + wide)) - 1e-9
            high = np.cos(max(0.0, at - wide)) + 1e-9
            values = self.sorted[f]
            first, last = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            if first == 0 and last == len(values):
                continue
            met[self.lists[f, first:last]] += 1
            used += 1
        if not used:
            return slice(None)
        return np.flatnonzero(met == used)


class Anchor:
    def __init__(self, id_: int, label: int, vector: np.ndarray, wanted: list[tuple[int, int]]) -> None:
        self.id, self.label, self.vector = id_, label, vector
        self.wide = vector.astype(np.float64)
        self.length = float(np.sqrt((self.wide * self.wide).sum()))
        self.top = float(np.abs(self.wide).max(initial=0.0))
        unit = self.wide / self.length if self.length else self.wide
        self.focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        self.angles = np.arccos(np.clip(unit, -1.0, 1.0))
        self.bands = wanted

    def search(self, buckets: list[Bucket], same: bool, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each band the scores and ids of its first n rows of the same (other) labels."""
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.bands]
        for bucket in buckets:
            least = min(max(low, int(s[-1])) if len(s) == n else low for (low, _), (s, _) in zip(self.bands, best))
            rows = bucket.candidates(self, least)
            labels = bucket.labels[rows]
            ids = bucket.ids[rows]
            right = (labels == self.label) & (ids != self.id) if same else labels != self.label
            if not right.any():
                continue
            scores, ids = bucket.scores(self, rows)[right], ids[right]
            for k, (low, high) in enumerate(self.bands):
                floor = max(low, int(best[k][0][-1])) if len(best[k][0]) == n else low
                fit = (scores >= floor) & (scores <= high)
                if fit.any():
                    s, i = np.concatenate([best[k][0], scores[fit]]), np.concatenate([best[k][1], ids[fit]])
                    order = np.lexsort((i, -s.astype(object) if (s == -(2**63)).any() else -s))[:n]
                    best[k] = (s[order], i[order])
        return best


ALL = [(-(2**63), 2**63 - 1)]


def _searched(same: bool, n: int, low: int, high: int):
    names = ["anchor_id", "positive_id", "positive_score", "id", "score"]

    def run(key, anchors: pa.Table, index: pa.Table) -> pa.Table:
        columns = [[] for _ in names]
        if len(anchors) and len(index):
            buckets = [Bucket(r) for r in sorted(index.to_pylist(), key=lambda r: r["bucket"])]
            positives = [None] * len(anchors) if same else anchors.column("positives").to_pylist()
            vectors = _matrix(anchors.column("vector"))
            for id_, label, vector, own in zip(anchors.column("id").to_pylist(), anchors.column("label").to_pylist(), vectors, positives):
                # low * p <= 100 * s <= high * p in whole numbers
                bands = ALL if same else [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in own]
                found = Anchor(id_, label, vector, bands).search(buckets, same, n)
                for k, (scores, ids) in enumerate(found):
                    p = (None, None) if same else (own[k]["id"], own[k]["score"])
                    rows = ([id_] * len(ids), [p[0]] * len(ids), [p[1]] * len(ids), ids.tolist(), scores.tolist())
                    for column, more in zip(columns, rows):
                        column.extend(more)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def _search(anchors: DataFrame, buckets: DataFrame, groups: int, blocks: int, same: bool, n: int, low: int, high: int) -> DataFrame:
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    left = anchors.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    right = buckets.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    schema = "anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"
    return left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInArrow(_searched(same, n, low, high), schema)


def _first(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30,
                   high: int = 90, key: str = "vec_id", label: str = "label", vector: str = "vector") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vector is an array of whole numbers. For each of an anchor's first n_positives rows of
    its label, the first n_negatives rows of other labels whose score is from `low` to
    `high` percent of the positive's."""
    whole = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(
        ~F.exists(vector, lambda x: x.isNull())
    )
    given = whole.select(
        F.col(key).cast("bigint").alias("id"), F.struct(F.col(label).cast("bigint").alias("label"),
        F.transform(vector, lambda x: x.cast("bigint")).alias("vector"), is_anchor.alias("anchor")).alias("row"),
    )
    base = given.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.vector", "row.anchor")
    base = stored(base, "vectors")
    buckets = index(base.select("id", "label", "vector"))
    anchors = base.where("anchor").select("id", "label", "vector")
    groups = (buckets.agg(F.max("grp")).first()[0] or 0) + 1
    blocks = max(1, -(-anchors.count() // ANCHORS))
    found = _search(anchors, buckets, groups, blocks, True, n_positives, low, high)
    positives = stored(_first(found, ["anchor_id"], n_positives).select("anchor_id", "id", "score"), "positives")
    # at most n_positives for each anchor
    wanted = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "score"))).alias("positives"))
    found = _search(anchors.join(wanted, "id"), buckets, groups, blocks, False, n_negatives, low, high)
    best = _first(found, ["anchor_id", "positive_id"], n_negatives)
    return best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                       F.col("score").alias("negative_score"))
