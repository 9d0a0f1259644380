"""Main text of pages, by a suffix array over the token streams of a host.

The words of all blocks of a host's pages are put one after another, pages apart. A
suffix array, built by doubling prefixes up to `RUN` words, brings equal runs of words
next to each other. A run that two pages or more have is repeated. It is boilerplate
if two of them are not copies of each other; its words go, and the others stay.

Copies (mobile, print and dated addresses) share nearly all of their text, and differ in
a date or a line. A page's class is the page that has its words first: among its
repeated words outside menus and the like, each counted 1 / (1 + log2 of the pages that
have it), the least page that holds the largest sum of them, if the page's own words are
no more than half of this sum; else the page itself. Pages of one class are copies. So a
short article below a notice of the whole site is no copy of the other articles.

Structure checks the array. Blocks in menus, headers, footers, side bars, notices,
adverts, forms and comments go even if they are unique. If the article and main elements
of a page have at least as many words as the array leaves of the blocks around them, they
are its text and stay whole, also what repeats in them; the other blocks go. Else they
are cards beside the text, and the array decides about all blocks, as it does in a page
without such elements. A page of which nothing would be left stays whole.

The pages of a host lie together; a host of more than GROUP_BYTES is cut into groups
of about that size by a hash of its pages, so no task holds more. Each group then gives
a mark, the first bits of a hash, for every run in its suffix array, and gets back the marks that it has
on two pages or another group has too; the few wrong ones do no harm. Runs with these marks
are given with their whole hashes, added up over the host, and a group gets back those of
its runs that any two pages of the host have. So the size of a group changes no result.
Marks and runs meet by ranges of their hashes, as many as a host has groups, and travel as
compressed columns, a row for each group and range. Null, empty and broken pages give the text that can be read, or an
empty text. Pages without a url form one host. Equal rows are one page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .page_blocks import CHROME, CONTENT, blocks

U = np.uint64
RUN = 8
GROUP_BYTES = 20 << 20
BITS = 27  # of a mark, and those of the number of groups: some million runs of a group seldom have one by chance
MAX_BROADCAST_HOSTS = 1_000_000
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)"


def equal_runs(words: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(where each run of `run` words in a page begins, the number of the run: equal runs
    have equal numbers, from 0 on). Words are numbers; page numbers ascend."""
    n = len(words)
    if n < run:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    # rank of every suffix by its first `width` words; a suffix ends with its page
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    sizes = np.bincount(page)
    last = np.repeat(np.cumsum(sizes), sizes).astype(np.int32)  # end of the page, for every word
    width = 1
    while width < run:
        step = min(width, run - width)
        key = rank * (n + 2)
        inside = np.arange(step, n, dtype=np.int32) < last[: max(n - step, 0)]
        key[: n - step] += rank[step:] * inside
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        del key
        rank[order] = np.cumsum(new)
        width += step
    begins = np.flatnonzero(np.arange(n, dtype=np.int32) + run <= last).astype(np.int32)
    rank = rank[begins].astype(np.int32)
    used = np.zeros(n + 1, np.int32)
    used[rank] = 1
    return begins, (np.cumsum(used, dtype=np.int32) - 1)[rank]


def spread(begins: np.ndarray, n: int, run: int = RUN) -> np.ndarray:
    """Which of n words lie in a run that begins at one of these places."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, begins, 1)
    np.add.at(edges, begins + run, -1)
    return np.cumsum(edges[:-1]) > 0


def _firsts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each of the ascending hashes is first, its number for every one)."""
    new = np.append(len(hashes) > 0, hashes[1:] != hashes[:-1])[: len(hashes)]
    return np.flatnonzero(new), np.cumsum(new) - 1


def holders(number: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many pages have each run, the least of them), for runs numbered from 0 in
    pages that ascend."""
    if not len(number):
        return np.zeros(0, np.int64), page[:0]
    place, rank = _firsts(page)
    both = np.sort(number.astype(np.int64) << 32 | rank)
    both = both[_firsts(both)[0]]
    number = both >> 32
    first = _firsts(number)[0]
    return np.bincount(number).astype(np.int64), page[place[both[first] & 0xFFFFFFFF]]


def repeated(words: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which words lie in a run of `run` words that two pages have."""
    begins, number = equal_runs(words, page, run)
    many = holders(number, page[begins])[0] > 1
    return spread(begins[many[number]], len(words), run)


def parse(batches):
    """Pages with the blocks of their html: a byte for the kind of each, and a line."""
    for b in batches:
        found = [blocks(p) for p in b.column("html").to_pylist()]
        kinds = pa.array([bytes(k for k, _ in f) for f in found], pa.binary())
        lines = pa.array(["\n".join(text for _, text in f) for f in found], pa.string())
        names = [n for n in b.schema.names if n != "html"]
        yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], kinds, lines], [*names, "kinds", "lines"])


def _found(ascending: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is a value there, at which place)."""
    if not len(ascending):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values, at


class Group:
    """The token streams of some pages of a host, and their runs: all, by a suffix array,
    or those with the given hashes, which ascend. Pages ascend by key; equal pages have
    equal keys."""

    def __init__(self, pages: pa.Table, given: np.ndarray | None = None) -> None:
        self.pages = pages
        self.keys = pages.column("page_key").to_numpy()
        lines, words, counts = pages.column("lines").combine_chunks(), [], []
        for _, _, data, offsets in hashing.slices(lines):
            hashes, at = hashing.words(data, offsets, False)
            words.append(hashes)
            counts.append(np.diff(at))
        self.words = np.concatenate([np.zeros(0, np.uint64), *words])
        self.page = np.repeat(np.arange(len(self.keys), dtype=np.int32), np.concatenate([np.zeros(0, np.int64), *counts]))
        if given is None:
            self.begins, self.number = equal_runs(self.words, self.page)
        elif len(given):
            begins, hashes = self.windows()
            there, at = _found(given, hashes)
            self.begins, self.number = begins[there], at[there]
        else:
            self.begins = self.number = np.zeros(0, np.int32)
        self.holder = self.keys[self.page[self.begins]]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(where the runs begin, their hashes)."""
        last = max(len(self.words) - RUN + 1, 0)
        begins = np.flatnonzero(self.page[:last] == self.page[RUN - 1 :][:last]).astype(np.int32)
        return begins, hashing.windows(self.words, RUN)[begins]

    def hashes(self) -> np.ndarray:
        """A hash of each run, the same in every group."""
        out = np.zeros(int(self.number.max()) + 1 if len(self.number) else 0, np.int64)
        if len(out):
            out[self.number] = hashing.windows(self.words, RUN).view(np.int64)[self.begins]
        return out

    def blocks(self) -> Iterator[list[tuple[int, list[str]]]]:
        """For every page the kind and the words of its blocks."""
        for kinds, lines in zip(self.pages.column("kinds"), self.pages.column("lines")):
            yield [(k, line.split(" ")) for k, line in zip(kinds.as_py(), lines.as_py().split("\n"))]

    def classes(self, n: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The class of every page, given how many pages of the host have each run and
        the least of them."""
        size = len(self.words)
        fewest, first = np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
        many = n[self.number] > 1
        begins, number = self.begins[many], self.number[many]
        for k in range(RUN):  # the rarest repeated run that a word lies in
            at = begins + k
            fewer = (n[number] < fewest[at]) | ((n[number] == fewest[at]) & (least[number] < first[at]))
            fewest[at[fewer]], first[at[fewer]] = n[number[fewer]], least[number[fewer]]
        sizes = [(k != CHROME, len(words)) for found in self.blocks() for k, words in found]
        text = np.repeat([t for t, _ in sizes], [n for _, n in sizes]).astype(bool)
        shared = text & (fewest < np.iinfo(np.int64).max)
        own = np.bincount(self.page[text & ~shared], minlength=len(self.keys))
        page, first, weight = self.page[shared], first[shared], 1 / (1 + np.log2(fewest[shared]))
        out = self.keys.copy()
        if len(page):
            order = np.lexsort((first, page))
            page, first, weight = page[order], first[order], weight[order]
            new = np.flatnonzero(np.append(True, (page[1:] != page[:-1]) | (first[1:] != first[:-1])))
            page, first, weight = page[new], first[new], np.add.reduceat(weight, new).round(6)
            order = np.lexsort((first, -weight, page))  # the largest sum of each page comes first
            page, first, weight = page[order], first[order], weight[order]
            new = np.append(True, page[1:] != page[:-1])
            page, first, weight = page[new], first[new], weight[new]
            copy = 2 * own[page] <= weight
            out[page[copy]] = first[copy]
        return out

    def bounds(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest class of the pages that have each run."""
        n = int(self.number.max()) + 1 if len(self.number) else 0
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, self.number, classes[self.page[self.begins]])
        np.maximum.at(high, self.number, classes[self.page[self.begins]])
        return low, high

    def texts(self, boilerplate: np.ndarray) -> list[str]:
        """The main text of every page, given which runs are boilerplate."""
        covered = spread(self.begins[boilerplate[self.number]], len(self.words))
        out, end = [], 0
        for found in self.blocks():
            kept = []  # kind, words, the words that are not boilerplate
            for k, words in found:
                start, end = end, end + len(words)
                if k != CHROME:
                    kept.append((k, words, [w for w, c in zip(words, covered[start:end]) if not c]))
            body = sum(len(words) for k, words, _ in kept if k == CONTENT)
            around = sum(len(left) for k, _, left in kept if k != CONTENT)
            if body and body >= around:
                texts = [words for k, words, _ in kept if k == CONTENT]
            else:
                texts = [left for _, _, left in kept if left] or [words for _, words, _ in kept]
            out.append(" ".join(w for words in texts for w in words))
        return out


PARSED = "page_key bigint, page_id bigint, url string, kinds binary, lines string"
RESULT = "page_id bigint, url string, text string"


def _group(table: pa.Table) -> Group:
    return Group(table.sort_by("page_key").combine_chunks())


def _result(group: Group, boilerplate: np.ndarray) -> pa.Table:
    texts = pa.array(group.texts(boilerplate), pa.string())
    return pa.table({"page_id": group.pages.column("page_id"), "url": group.pages.column("url"), "text": texts})


def _packed(*columns: np.ndarray) -> bytes:
    """Columns, compressed. Bytes of a column lie by their place in the number, so the
    upper ones are long runs."""
    planes = [np.ascontiguousarray(c.astype(np.int64).view(np.uint8).reshape(-1, 8).T).ravel() for c in columns]
    return pa.compress(np.concatenate(planes), "zstd", asbytes=True)


def _unpacked(blob: pa.Buffer, n: int, columns: int) -> list[np.ndarray]:
    data = np.frombuffer(pa.decompress(blob, 8 * n * columns, "zstd"), np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(c.T).view(np.int64).ravel() for c in data]


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending[:1] * 0)


RUNS = "host_id bigint, grp bigint, groups bigint, bucket bigint, n_runs bigint, n_keys bigint, runs binary, numbers binary"


class Runs:
    """RUNS rows: numbers about runs, a row for the runs of a group in a range of hashes."""

    def __init__(self) -> None:
        self.rows: dict[str, list] = {f.split()[0]: [] for f in RUNS.split(", ")}

    def add(self, own: tuple, hashes: np.ndarray, *columns: np.ndarray) -> None:
        """Hashes of runs, which ascend, with columns of keys of pages or counts; keys of a
        row are stored once."""
        if len(hashes):
            keys, at = np.unique(np.concatenate([*columns, np.zeros(0, np.int64)]), return_inverse=True)
            values = (*own, len(hashes), len(keys), _packed(_steps(hashes), *at.reshape(len(columns), len(hashes))), _packed(_steps(keys)))
            for column, v in zip(self.rows.values(), values):
                column.append(v)

    def table(self) -> pa.Table:
        kinds = {f.split()[0]: pa.binary() if f.endswith("binary") else pa.int64() for f in RUNS.split(", ")}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in self.rows.items()})


def _ranges(hashes: np.ndarray, groups: int, bits: int) -> list[tuple[int, slice]]:
    """The ranges of ascending hashes of so many bits."""
    bucket = (hashes >> U(max(bits - 32, 0))) * U(groups) >> U(min(bits, 32))
    ends = np.searchsorted(bucket, np.arange(groups + 1, dtype=U))
    return [(k, slice(a, z)) for k, (a, z) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if a < z]


def _read(rows: pa.Table, columns: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(hashes, columns, row of each) of RUNS rows, in order of the hashes."""
    hashes, numbers, of = [np.zeros(0, U)], [[np.zeros(0, np.int64)] for _ in range(columns)], [np.zeros(0, np.int32)]
    plain = rows.select(["n_runs", "n_keys"]).to_pylist()
    for k, (row, blob, keys) in enumerate(zip(plain, rows.column("runs"), rows.column("numbers"))):
        found = _unpacked(blob.as_buffer(), row["n_runs"], columns + 1)
        keys = np.cumsum(_unpacked(keys.as_buffer(), row["n_keys"], 1)[0])
        hashes.append(np.cumsum(found[0].astype(U)))
        for column, at in zip(numbers, found[1:]):
            column.append(keys[at])
        of.append(np.full(row["n_runs"], k, np.int32))
    hashes, of = np.concatenate(hashes), np.concatenate(of)
    order = np.argsort(hashes, kind="stable")
    return hashes[order], [np.concatenate(c)[order] for c in numbers], of[order]


def _back(rows: pa.Table, of: np.ndarray, hashes: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """To every group its runs, given the row that each came with."""
    out, order = Runs(), np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(rows.num_rows + 1))
    for k, row in enumerate(rows.select(["host_id", "grp", "groups", "bucket"]).to_pylist()):
        at = order[ends[k] : ends[k + 1]]
        out.add(tuple(row.values()), hashes[at], *(c[at] for c in columns))
    return out.table()


def _mark_bits(groups: int) -> int:
    return BITS + (groups - 1).bit_length()


def pack(batches):
    """Pages of a group of a host in one compressed piece for each batch."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    own, fields = ["host_id", "grp", "groups"], [f.split()[0] for f in PARSED.split(", ")]
    for b in parse(batches):
        table = pa.Table.from_batches([b]).sort_by([(c, "ascending") for c in own]).combine_chunks()
        keys = np.stack([table.column(c).to_numpy() for c in own], 1)
        first = np.flatnonzero(np.append(len(keys) > 0, (keys[1:] != keys[:-1]).any(1))[: len(keys)])
        pieces = []
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(keys)]):
            sink = pa.BufferOutputStream()
            piece = table.select(fields).slice(a, z - a)
            with pa.ipc.new_stream(sink, piece.schema, options=options) as writer:
                writer.write_table(piece)
            pieces.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([*(pa.array(keys[first, k]) for k in range(3)), pa.array(pieces, pa.binary())], [*own, "pages"])


def _unpack(table: pa.Table) -> pa.Table:
    pieces = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in table.column("pages")]
    return pa.concat_tables(pieces).sort_by("page_key").combine_chunks()


def _own(table: pa.Table) -> tuple[int, int, int]:
    return tuple(table.column(c)[0].as_py() for c in ("host_id", "grp", "groups"))


def _to_ranges(table: pa.Table, hashes: np.ndarray, *columns: np.ndarray, bits: int = 64) -> pa.Table:
    host, grp, groups = _own(table)
    out = Runs()
    for bucket, part in _ranges(hashes, groups, bits):
        out.add((host, grp, groups, bucket), hashes[part], *(c[part] for c in columns))
    return out.table()


def _over_hosts(pages: DataFrame) -> DataFrame:
    """RESULT for hosts of several groups: (host_id, grp, groups, pages), these as `pack` gives them."""
    groups = pages.groupBy("host_id", "grp")

    def marks(table: pa.Table) -> pa.Table:
        """Marks of all runs, with 2 if two pages of the group have one, else 1."""
        group, bits = Group(_unpack(table)), _mark_bits(_own(table)[2])
        found = group.hashes().view(U) >> U(64 - bits)
        many = holders(group.number, group.holder)[0] > 1
        del group
        order = np.argsort(found)
        found, many = found[order], many[order]
        first = _firsts(found)[0]
        many = np.maximum.reduceat(many, first) if len(first) else many
        return _to_ranges(table, found[first], 1 + many.astype(np.int64), bits=bits)

    def shared(rows: pa.Table) -> pa.Table:
        found, (n,), of = _read(rows, 1)
        number = _firsts(found)[1]
        more = np.bincount(number, n)[number] > 1
        return _back(rows, of[more], found[more])

    def counts(table: pa.Table, rows: pa.Table) -> pa.Table:
        """Runs with such marks: on how many pages of the group they are, and the least of these."""
        wanted, _, _ = _read(rows, 0)
        group = Group(_unpack(table), np.zeros(0, U))
        begins, hashes = group.windows()
        there = _found(wanted, hashes >> U(64 - _mark_bits(_own(table)[2])))[0]
        found, number = np.unique(hashes[there], return_inverse=True)
        return _to_ranges(table, found, *holders(number, group.keys[group.page[begins[there]]]))

    def totals(rows: pa.Table) -> pa.Table:
        found, (n, least), of = _read(rows, 2)
        first, number = _firsts(found)
        n = np.bincount(number, n).astype(np.int64)[number]
        least = np.minimum.reduceat(least, first)[number]
        more = n > 1
        return _back(rows, of[more], found[more], n[more], least[more])

    def bounds(table: pa.Table, rows: pa.Table) -> pa.Table:
        found, (n, least), _ = _read(rows, 2)
        group = Group(_unpack(table), found)
        return _to_ranges(table, found, *group.bounds(group.classes(n, least)))

    def differ(rows: pa.Table) -> pa.Table:
        found, (low, high), of = _read(rows, 2)
        first, number = _firsts(found)
        more = (np.minimum.reduceat(low, first) < np.maximum.reduceat(high, first))[number]
        return _back(rows, of[more], found[more])

    def run(table: pa.Table, rows: pa.Table) -> pa.Table:
        found, _, _ = _read(rows, 0)
        return _result(Group(_unpack(table), found), np.ones(len(found), bool))

    def met(rows: DataFrame, step) -> DataFrame:
        return rows.groupBy("host_id", "bucket").applyInArrow(step, RUNS).groupBy("host_id", "grp")

    every = groups.applyInArrow(marks, RUNS)
    every = groups.cogroup(met(every, shared)).applyInArrow(counts, RUNS)
    every = groups.cogroup(met(every, totals)).applyInArrow(bounds, RUNS)
    return groups.cogroup(met(every, differ)).applyInArrow(run, RESULT)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
            group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(key, url, text) of every row of pages."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1))
    base = pages.select(
        F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"), host.alias("host"),
    )
    page_key = F.xxhash64("page_id", "url", "html").alias("page_key")
    large = base.groupBy("host").agg(F.sum(F.octet_length("html").cast("bigint")).alias("bytes"))
    large = large.where(F.col("bytes") > group_bytes).select(
        F.col("host").alias("large"), F.ceil(F.col("bytes") / group_bytes).alias("groups")
    )
    n_large = large.count()
    if n_large <= MAX_BROADCAST_HOSTS:
        large = F.broadcast(large)

    def run(table: pa.Table) -> pa.Table:
        group = _group(table)
        low, high = group.bounds(group.classes(*holders(group.number, group.holder)))
        return _result(group, low < high)

    small = base.join(large, F.col("host") == F.col("large"), "left_anti") if n_large else base
    small = small.select("host", page_key, "page_id", "url", "html").mapInArrow(parse, f"host string, {PARSED}")
    out = small.groupBy("host").applyInArrow(run, RESULT)
    if n_large:
        group = F.pmod(F.xxhash64("page_id", "url"), F.col("groups")).alias("grp")
        placed = base.join(large, F.col("host") == F.col("large"))
        placed = placed.select(F.xxhash64("host").alias("host_id"), group, F.col("groups").cast("bigint"), page_key, "page_id", "url", "html")
        out = out.unionByName(_over_hosts(placed.mapInArrow(pack, "host_id bigint, grp bigint, groups bigint, pages binary")))
    return out.withColumnRenamed("page_id", key).withColumnRenamed("url", url) if (key, url) != ("page_id", "url") else out
