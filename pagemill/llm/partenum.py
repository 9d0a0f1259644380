"""Near duplicates by an exact n-gram Jaccard join with PartEnum signatures.

Texts are sets of five-word shingles. Sets with a Jaccard similarity of at least
0.8 differ in at most (|r| + |s|) / 9 shingles. Sizes are cut into bands; a set
joins its own band and, if it can have a partner there, the next one. In a band the
shingle domain is partitioned by hash, and one signature is the set's content of one
partition. Two similar sets agree in all but k partitions. A set enumerates the first
k + 1 of its partitions that are not empty, in an order by their content alone, and
then two similar sets share one of these: the first of r's that s has too could only be
left out by s if k + 1 partitions, all of them different in r, came before it. The order
puts partitions with many shingles first that are not common, so a passage that many
texts share forms no large bucket unless texts consist of it. Common shingles are found
by a bounded count over all texts. Sets with too few non-empty partitions (small ones,
by chance) also enumerate single shingles, floor(|r| / 5) + 1 of them. No link is lost.

Equal sets are one node. In a bucket all nodes are compared with the smallest, and
nodes that are then in different components with each other, in blocks of bounded
size. Buckets of the same nodes are one. A comparison looks at parity sketches first: four bits or more for each shingle, whose
difference is never more than that of the sets, so it drops no similar pair. What passes
is compared by the whole sets; those of the nodes of a block are sent to its task, so no
row is made for a pair of the block that is not a link. Sets are 64-bit hashes of windows.

Null and empty texts, and texts without words, have no shingles and are linked with
nothing. Repeated rows are equal sets. A null id is ignored when the smallest id of
a component is sought, and remains null where there is no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .components import components
from .storage import stored

SHINGLE = 5
SIMILAR = Fraction(4, 5)
DENSITY = 0.4  # partitions for each shingle of the largest set of a band
COMMON_FROM = 16  # texts that have a common shingle, at least
COMMON_KEPT = 500_000  # entries of the list of common shingles; the most frequent stay
FOLD = 4_000_000  # shingles counted at a time
BLOCK = 1024  # nodes of a bucket that are compared in one piece
MAX_BROADCAST_IDS = 2_000_000
I = np.int64
U = np.uint64


def bands(size: int) -> list[tuple[int, int, int, int]]:
    """(band, its partitions, differences allowed, largest size) for a set of `size`."""
    out, low, band = [], 1, 0
    while low <= size:
        high = max(int(Fraction(low) / SIMILAR**2), low)
        largest = min(int(size / SIMILAR), high)
        if size <= high:
            out.append((band, low, high, largest))
            if int(size / SIMILAR) > high:  # partners in the next band
                nxt = max(int(Fraction(high + 1) / SIMILAR**2), high + 1)
                out.append((band + 1, high + 1, nxt, int(size / SIMILAR)))
        low, band = high + 1, band + 1
    return [(b, int(np.ceil(DENSITY * hi)) + 2, (size + most) // 9, hi) for b, _, hi, most in out]


def signatures(elements: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Signatures of a non-empty sorted set of shingles."""
    place = np.searchsorted(common, elements)
    rare = common[np.minimum(place, len(common) - 1)] != elements if len(common) else np.ones(len(elements), bool)
    out, short = [], False
    for band, parts, allowed, _ in bands(len(elements)):
        seed = U((band * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
        spread = hashing.mix(elements ^ seed)
        part = (spread % U(parts)).astype(I)
        order = np.argsort(part, kind="stable")
        part, first = np.unique(part[order], return_index=True)
        content = np.add.reduceat(hashing.mix(spread + U(1))[order], first)
        weight = np.add.reduceat(rare[order].astype(I), first)
        chosen = np.lexsort((part, -weight))[: allowed + 1]
        short |= len(part) <= allowed
        out.append(hashing.mix(content[chosen] ^ hashing.mix(part[chosen].astype(U) + seed)))
    if short:
        order = np.lexsort((elements, ~rare))
        out.append(hashing.mix(elements[order][: len(elements) // 5 + 1] + U(0x5DEECE66D)))
    return np.unique(np.concatenate(out))


def sketch_of(elements: np.ndarray) -> bytes:
    """Parities of the set's shingles over 4 to 8 bits for each, a power of two and 64
    at least. A longer sketch folds to a shorter one by exclusive or of its halves."""
    bits = max(64, 1 << (4 * len(elements) - 1).bit_length())
    at, many = np.unique((hashing.mix(elements + U(77)) % U(bits)).astype(I), return_counts=True)
    odd = np.zeros(bits, np.uint8)
    odd[at] = many & 1
    return np.packbits(odd, bitorder="little").tobytes()


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of sketches (as 64-bit words) differ from one sketch."""
    while a.shape[-1] > b.shape[-1]:
        a = a[..., : a.shape[-1] // 2] ^ a[..., a.shape[-1] // 2 :]
    while b.shape[-1] > a.shape[-1]:
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return np.bitwise_count(a ^ b).sum(-1)


def node_of(elements: np.ndarray) -> int:
    """Signed 64-bit number of a set; equal sets have equal numbers."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(elements.tobytes())).astype(I)))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, hash of the text, n, node, sketch) of every text, and (null, null, count,
    shingle, null) of shingles that several texts of the task have, not counting copies:
    those met twice in a fold, the rarest dropped when there are too many. They only
    set an order, so they need not be exact."""
    found, counts = np.zeros(0, U), np.zeros(0, I)
    waiting: list[np.ndarray] = []
    done: set[int] = set()
    held = 0

    def fold() -> None:
        nonlocal found, counts, held
        if waiting:
            u, c = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            held = 0
            keep = c >= 2
            both, at = np.unique(np.concatenate([found, u[keep]]), return_inverse=True)
            total = np.bincount(at, np.concatenate([counts, c[keep]]), len(both)).astype(I)
            if len(both) > 2 * COMMON_KEPT:
                top = np.sort(np.argpartition(total, -COMMON_KEPT)[-COMMON_KEPT:])
                both, total = both[top], total[top]
            found, counts = both, total

    def batch(ids, texts, ns, nodes, sketches, kind):
        return pa.RecordBatch.from_arrays(
            [ids, texts, pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary()),
             pa.array(np.full(len(ns), kind, np.int8), pa.int8())], ["id", "h", "n", "node", "sketch", "kind"])

    for b in batches:
        ns, nodes, sketches = [], [], []
        for s in hashing.shingle_sets(b.column(2), SHINGLE):
            node = node_of(s)
            ns.append(len(s))
            nodes.append(node)
            sketches.append(sketch_of(s) if len(s) else b"")
            if node not in done:
                if len(done) > 500_000:
                    done.clear()
                done.add(node)
                waiting.append(s)
                held += len(s)
                if held > FOLD:
                    fold()
        yield batch(b.column(0), b.column(1), ns, nodes, sketches, 0)
    fold()
    keep = counts >= 3
    none = pa.nulls(int(keep.sum()), pa.int64())
    yield batch(none, none, counts[keep], found[keep].astype(I), [None] * int(keep.sum()), 1)


def _signed(common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            sigs, nodes, held = [], [], 0
            for s in hashing.shingle_sets(b.column(0), SHINGLE):
                if not len(s) or (node := node_of(s)) in done:
                    continue  # a copy in the same task
                if len(done) > 500_000:
                    done.clear()
                done.add(node)
                sig = signatures(s, common)
                sigs.append(sig)
                nodes.append(np.full(len(sig), node, I))
                held += len(sig)
                if held > 500_000:
                    yield _pairs(sigs, nodes)
                    sigs, nodes, held = [], [], 0
            if sigs:
                yield _pairs(sigs, nodes)

    return run


def _pairs(sigs, nodes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(sigs).astype(I)), pa.array(np.concatenate(nodes))], ["sig", "node"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes, sets = [], []
        for s in hashing.shingle_sets(b.column(0), SHINGLE):
            nodes.append(node_of(s))
            sets.append(s.astype(I))
        ends = np.cumsum([0, *map(len, sets)])
        values = np.concatenate(sets) if sets else np.zeros(0, I)
        for a in range(0, len(sets), 1000):
            z = min(a + 1000, len(sets))
            made = pa.ListArray.from_arrays(pa.array(ends[a : z + 1] - ends[a], pa.int32()), pa.array(values[ends[a] : ends[z]]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a:z], pa.int64()), made], ["node", "set"])


def _words_of(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, "<u8")


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (u, v, un, us, vn, vs): the pairs (u, v) whose sketches do not rule them out."""
    for b in batches:
        u, v = b.column(0), b.column(1)
        allowed = (b.column(2).to_numpy() + b.column(4).to_numpy()) // 9
        left, right = b.column(3).to_pylist(), b.column(5).to_pylist()
        near = [int(apart(_words_of(x), _words_of(y))) <= k for x, y, k in zip(left, right, allowed.tolist())]
        yield pa.RecordBatch.from_arrays([u.filter(pa.array(near, pa.bool_())), v.filter(pa.array(near, pa.bool_()))], ["u", "v"])


PIECE = "sig bigint, i int, j int, block int, node bigint, component bigint, n bigint, sketch binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of rows that agree in the first three columns (sig, i, j), from rows in order."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        keys = [b.column(k).to_numpy() for k in range(3)]
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        if held and b.num_rows:
            new[0] = any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != b.column(k)[0].as_py() for k in range(3))
        first = 0
        for at in np.flatnonzero(new).tolist():
            if at:
                held.append(b.slice(first, at - first))
            yield pa.Table.from_batches(held)
            held, first = [], at
        if b.num_rows:
            held.append(b.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _near_pairs(piece: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(row, later rows) of nodes of a piece in different components whose sketches do
    not rule them out. In a piece of two blocks only pairs across them are compared."""
    component, n, block = (piece.column(c).to_numpy() for c in ("component", "n", "block"))
    sketches = [_words_of(x) for x in piece.column("sketch").to_pylist()]
    widths = np.array([len(x) for x in sketches])
    groups = [(at, np.stack([sketches[k] for k in at])) for at in (np.flatnonzero(widths == w) for w in np.unique(widths))]
    across = piece.column("i")[0].as_py() != piece.column("j")[0].as_py()
    for k, one in enumerate(sketches):
        out = []
        for at, stacked in groups:
            fits = (at > k) & (component[at] != component[k]) & (10 * np.minimum(n[at], n[k]) >= 8 * np.maximum(n[at], n[k]))
            if across:
                fits &= block[at] != block[k]
            chosen = np.flatnonzero(fits)
            out.append(at[chosen[apart(stacked[chosen], one) <= (n[at[chosen]] + n[k]) // 9]] if len(chosen) else at[:0])
        found = np.sort(np.concatenate(out))
        if len(found):
            yield k, found


def _doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of PIECE, ordered by (sig, i, j), that have a near pair in their piece."""
    for piece in _pieces(batches):
        wanted = np.zeros(piece.num_rows, bool)
        for k, others in _near_pairs(piece):
            wanted[k] = True
            wanted[others] = True
        if wanted.any():
            yield from piece.filter(pa.array(wanted)).combine_chunks().to_batches()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of such rows with their whole sets: links (u, v) that join all similar nodes of a
    piece, fewer than it has nodes."""
    for piece in _pieces(batches):
        node, component = piece.column("node").to_numpy(), piece.column("component").to_numpy()
        whole = piece.column("set").combine_chunks()
        ends, flat = whole.offsets.to_numpy(), whole.values.to_numpy()
        root = {c: c for c in component.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        made = []
        for k, others in _near_pairs(piece):
            one = flat[ends[k] : ends[k + 1]]
            for x in others.tolist():
                a, b = top(int(component[k])), top(int(component[x]))
                if a == b:
                    continue
                other = flat[ends[x] : ends[x + 1]]
                both = len(np.intersect1d(one, other, assume_unique=True))
                if 100 * both >= 80 * (len(one) + len(other) - both):
                    root[a] = b
                    made.append((int(node[k]), int(node[x])))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int64()) for k in (0, 1)], ["u", "v"])


def _once(named: DataFrame) -> DataFrame:
    """(sig, size) of buckets (sig, node, component) with nodes of several components, one
    for each set of nodes: similar texts share many signatures, but are compared once."""
    content = [F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("y")]
    mixed = named.groupBy("sig").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size"), *content
    ).where("a <> b")
    return mixed.groupBy("size", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "size")


def _by_piece(rows: DataFrame) -> DataFrame:
    return rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")


def _linked(pairs: DataFrame, described: DataFrame, base: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes whose whole sets are similar enough."""
    sets = _node_sets(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), described, base)
    left = sets.select(F.col("node").alias("u"), F.col("set").alias("us"))
    right = sets.select(F.col("node").alias("v"), F.col("set").alias("vs"))
    both = pairs.join(left, "u").join(right, "v")
    shared = F.size(F.array_intersect("us", "vs"))
    n = both.select("u", "v", shared.alias("i"), (F.size("us") + F.size("vs")).alias("n"))
    return stored(n.where("100 * i >= 80 * (n - i)").select("u", "v"), "partenum-links")


def _common(raw: DataFrame) -> np.ndarray:
    """Hashes of common shingles, in order; the most frequent if there are many."""
    counted = raw.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_FROM)
    counted = stored(counted, "partenum-common")
    # one row for each frequency
    many = counted.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).limit(COMMON_KEPT).collect()
    least, total = COMMON_FROM, 0
    for r in many:
        if total + r["c"] > COMMON_KEPT:
            least = r["n"] + 1
            break
        total += r["c"]
    rows = counted.where(F.col("n") >= least).select("node").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(U))


def _node_sets(nodes: DataFrame, described: DataFrame, base: DataFrame) -> DataFrame:
    """Whole sets of the given nodes, made again from the texts with these ids."""
    chosen = described.join(nodes, "node").groupBy("node").agg(F.min("id").alias("id")).select("id").distinct()
    chosen = stored(chosen, "partenum-chosen")
    if chosen.count() <= MAX_BROADCAST_IDS:  # else Spark joins by shuffling the texts
        chosen = F.broadcast(chosen)
    texts = base.alias("t").join(chosen.alias("c"), F.col("t.id").eqNullSafe(F.col("c.id")), "left_semi")
    made = texts.select("text").mapInArrow(_sets, "node bigint, set array<bigint>")
    # rows with one id may have several texts; only the wanted sets are kept, once each
    made = made.join(nodes, "node", "left_semi").groupBy("node").agg(F.any_value("set").alias("set"))
    return stored(made, "partenum-sets")


def _result(described: DataFrame, label: DataFrame, key: str) -> DataFrame:
    own = described.where("n > 0").groupBy("node").agg(F.min("id").alias("low"), F.min(F.struct("id", "h")).alias("first"))
    named = own.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"), F.min("first").alias("first"))
    table = named.select("node", "component").join(lowest, "component").drop("component")
    return described.join(table, "node", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.col("h").alias("text_hash"),
        ((F.col("n") == 0) | F.struct("id", "h").eqNullSafe(F.col("first"))).alias("is_first"),
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, text_hash, is_first): one row per row of docs.
    `text_hash` is Spark's xxhash64 of the text. `is_first` holds for one document of
    each component, that of the smallest id, and for texts without words. Rows with
    equal id and text are one document."""
    spark = docs.sparkSession
    base = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    hashed = base.select("id", F.xxhash64("text").alias("h"), "text")
    raw = hashed.mapInArrow(_described, "id bigint, h bigint, n bigint, node bigint, sketch binary, kind tinyint")
    raw = stored(raw, "partenum-texts")
    described = raw.where("kind = 0").select("id", "h", "n", "node")
    common = spark.sparkContext.broadcast(_common(raw))  # at most COMMON_KEPT numbers

    def signed(batches):
        return _signed(common.value)(batches)

    sigs = base.select("text").mapInArrow(signed, "sig bigint, node bigint")
    one = Window.partitionBy("sig")
    met = sigs.select("sig", "node", F.min("node").over(one).alias("hub"), F.max("node").over(one).alias("top"))
    buckets = stored(met.where("hub <> top").select("sig", "node", "hub"), "partenum-buckets")
    # sketches of the nodes that share a bucket with another
    shared = buckets.select("node").distinct()
    sketches = raw.where("kind = 0").join(shared, "node", "left_semi").groupBy("node").agg(
        F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")
    )
    sketches = stored(sketches, "partenum-sketches")
    u = sketches.select(F.col("node").alias("u"), F.col("n").alias("un"), F.col("sketch").alias("us"))
    v = sketches.select(F.col("node").alias("v"), F.col("n").alias("vn"), F.col("sketch").alias("vs"))
    hubs = buckets.where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    near = hubs.join(u, "u").join(v, "v").where("10 * un >= 8 * vn AND 10 * vn >= 8 * un")
    near = near.select("u", "v", "un", "us", "vn", "vs").mapInArrow(_close, "u bigint, v bigint")
    links = _linked(stored(near, "partenum-pairs"), described, base)
    label = components(links, "partenum-components")

    # what is left to compare: nodes of one bucket in different components
    named = buckets.join(label, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
    named = stored(named.distinct(), "partenum-named")
    mixed = _once(named).select("sig", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod("node", "blocks").cast("int")
    placed = named.join(mixed, "sig").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.join(sketches, "node").select(
        "sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "n", "sketch"
    )
    doubtful = stored(_by_piece(placed).mapInArrow(_doubtful, PIECE), "partenum-doubtful")
    sets = _node_sets(doubtful.select("node").distinct(), described, base)
    whole = doubtful.join(sets, "node").select(*doubtful.columns, "set")
    more = stored(_by_piece(whole).mapInArrow(_verified, "u bigint, v bigint").distinct(), "partenum-links")
    if not more.isEmpty():
        label = components(links.union(more), "partenum-components")
    return _result(described, label, key)
