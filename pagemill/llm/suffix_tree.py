"""Probabilistic suffix tree over words: variable-length contexts, scored by the
longest suffix.

A text is its words (A-Z lower-cased) and one end token; a start mark stands before
it. Words are 64-bit hashes. The root holds the smoothed word counts of the base
score. Every context of 1 to `depth` words of the training texts is a candidate, and
every next word that it has `least` times is stored, however large the corpus is. A
candidate is retained if its counts diverge from its parent's (the context without its
first word) by at least `divergence` nats: count times the Kullback-Leibler divergence
over the stored next words and the rest. Ancestors of retained contexts stay, and so do
contexts of more than BRANCH tokens.

A next-word distribution is the stored counts less `discount`, and the mass left goes
to the parent's distribution, so that every state sums to one. A token is scored by
the longest suffix of its past that is a state.

The tree is never in one place. Tokens are dealt with the words before them, by the
last of these, so a task has whole branches: it grows them from its training tokens and
scores all its tokens with them, a few at a time. A branch of more than BRANCH tokens is dealt by its
longer contexts, or, where these are as frequent, by texts. Counts of the contexts of such
branches, one for BRANCH tokens at most, are summed in Spark and sent to the parts of the
branch. Blocks of texts get back the scores of their tokens and add them up.

Word counts of the whole corpus are summed in Spark. While they are few they are sent
to all tasks; beyond MAX_BROADCAST_WORDS each block of texts is sent the counts of its
own words, by a join and a cogroup.

Null and empty texts consist of the end token. A null id is held out. Repeated rows
count each. Without training texts nothing is known and every token has the
probability of an unknown word, which is then 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .storage import release, stored

U, I = np.uint64, np.int64
START, END = U(0x0123456789ABCDEF), U(0x0FEDCBA987654321)
GROW = U(0xC2B2AE3D27D4EB4F)
PAIR = U(0xA0761D6478BD642F)
SPREAD = U(0x9FB21C651E98DF25)
MAX_BROADCAST_WORDS = 6_000_000
BLOCK_BYTES = 16 << 20
FLUSH = 1_500_000
BRANCH = 500_000  # tokens that are grown at once, about; a branch above is dealt by longer contexts
PART = 2_000_000  # tokens of a part, about, whose branches are grown one after another
FINER = 4  # pieces of a twig, by the same contexts, that are grown one after another
CHUNK, CHUNK_ROWS, BATCH_ROWS = 500_000, 32_000, 10_000  # tokens and texts that are dealt at once
AT_START, UNDEFINED, UNKNOWN = -1, -2, -3  # numbers beside those of words


@dataclass(frozen=True)
class Shape:
    depth: int = 3
    least: int = 2
    divergence: float = 10.0
    discount: float = 0.5


def extend(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return hashing.mix(context * GROW + word)


def sequences(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens with start and end marks, index of each text's start mark, with the end)."""
    for first, end, data, offsets in hashing.slices(texts):
        words, at = hashing.words(data, offsets, True)
        n = end - first
        starts = at[:-1] + 2 * np.arange(n)
        out = np.empty(len(words) + 2 * n, U)
        marks = np.zeros(len(out), bool)
        marks[starts] = True
        out[starts] = START
        ends = at[1:] + 2 * np.arange(n) + 1
        marks[ends] = True
        out[ends] = END
        out[~marks] = words
        yield out, np.append(starts, len(out))


def contexts(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Hash of the `depth` tokens before each token; the first ones are undefined."""
    out = tokens[: max(len(tokens) - depth, 0)].copy()
    for k in range(1, depth):
        out = extend(out, tokens[k : k + len(out)])
    return np.concatenate([np.zeros(min(depth, len(tokens)), U), out])


def reach(starts: np.ndarray, n: int) -> np.ndarray:
    """How many tokens of its text stand before each token, the start mark included."""
    sizes = np.diff(starts)
    return np.arange(n) - np.repeat(starts[:-1], sizes)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, where one of each is, the place of every key among them)."""
    order = np.argsort(keys).astype(np.int32)
    keys = keys[order]
    new = np.append(len(keys) > 0, keys[1:] != keys[:-1])[: len(keys)]
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[new], order[new], at


class Sums:
    """Counts of keys with the columns that belong to them, folded now and then."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.held, self.size = names, [], 0

    def add(self, key: np.ndarray, columns: list[np.ndarray], n: np.ndarray | None = None) -> None:
        u, at, place = ranked(key)
        total = np.bincount(place, n, len(u)).astype(I)
        self.held.append((u, [c[at] for c in columns], total))
        self.size += len(u)

    def fold(self) -> None:
        if len(self.held) > 1:
            held, self.held, self.size = self.held, [], 0
            columns = [np.concatenate(c) for c in zip(*[h[1] for h in held])]
            self.add(np.concatenate([h[0] for h in held]), columns, np.concatenate([h[2] for h in held]))

    def batches(self, last: bool) -> Iterator[pa.RecordBatch]:
        if self.size < FLUSH and not last:
            return
        self.fold()
        if self.size < FLUSH // 2 and not last:
            return
        for _, columns, n in self.held:
            yield pa.RecordBatch.from_arrays([*[pa.array(c.view(I)) for c in columns], pa.array(n)], [*self.names, "n"])
        self.held, self.size = [], 0


def count_words(texts: DataFrame) -> DataFrame:
    def run(batches):
        sums = Sums(["word"])
        for b in batches:
            for tokens, _ in sequences(b.column(0)):
                words = tokens[tokens != START]
                sums.add(words, [words])
                yield from sums.batches(False)
        yield from sums.batches(True)

    return texts.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def found(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the value in the sorted table, at which place)."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), I)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


@dataclass
class Level:
    """States of one depth: contexts in order, what they leave to the parent, and
    the probabilities of stored next words by the hash of context and word."""

    context: np.ndarray
    rest: np.ndarray
    pair: np.ndarray
    share: np.ndarray


@dataclass
class Tree:
    total: int
    distinct: int
    levels: list[Level] = field(default_factory=list)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.total + 0.1 * (self.distinct + 1))

    def score(self, tokens: np.ndarray, starts: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Probability of every token but start marks, given the root's."""
        past, p = reach(starts, len(tokens)), base.copy()
        live = np.flatnonzero(past >= 1)
        for depth, level in enumerate(self.levels, 1):
            context = contexts(tokens, depth)[live]
            there, at = found(level.context, context)
            there &= past[live] >= depth
            live, context, at = live[there], context[there], at[there]
            stored_here, place = found(level.pair, hashing.mix(context * PAIR + tokens[live]))
            own = np.where(stored_here, level.share[place] if len(level.share) else 0.0, 0.0)
            p[live] = own + level.rest[at] * p[live]
        return p


@dataclass
class Lookup:
    """Words in order of their hashes, with their numbers and counts, as narrow as these are."""

    word: np.ndarray
    number: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Lookup:
        """Of (word, n), numbered by their counts, or of (word, n, number)."""
        word, n = _ordered(table)
        if table.num_columns > 2:
            number = table.column(2).to_numpy()[np.argsort(table.column(0).to_numpy().astype(U))]
        else:
            number = np.empty(len(word), I)
            number[np.argsort(-n, kind="stable")] = np.arange(len(word))
        return cls(word, number.astype(np.int32), n.astype(np.min_scalar_type(n.max(initial=0))))

    def by_number(self, column: np.ndarray) -> np.ndarray:
        out = np.empty_like(column)
        out[self.number] = column
        return out


class Corpus:
    """(doc_id, held_out, text) rows with their word counts, and how to go over the
    texts with the numbers of their words."""

    def __init__(self, every: DataFrame, words: DataFrame, shape: Shape, max_words: int) -> None:
        self.every, self.words, self.shape = every, words, shape
        total, distinct = words.agg(F.sum("n"), F.count("*")).first()
        self.tree = Tree(total or 0, distinct)
        self.few = distinct <= max_words
        send = every.sparkSession.sparkContext.broadcast
        if self.few:
            self.sent = send(Lookup.of(words.toArrow()))
            return
        self.words = stored(_numbered(words, distinct), "numbered")
        size = every.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
        block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(size // BLOCK_BYTES + 1)).alias("block")
        self.blocks = stored(every.select(block, "doc_id", "held_out", "text"), "blocks")

        def distinct_words(table: pa.Table) -> pa.Table:
            seen = [np.unique(t) for t, _ in sequences(table.column("text"))]
            seen = np.unique(np.concatenate(seen)) if seen else np.zeros(0, U)
            return pa.table({"block": pa.array(np.full(len(seen), table.column("block")[0].as_py(), I)), "word": pa.array(seen.astype(I))})

        need = self.blocks.select("block", "text").groupBy("block").applyInArrow(distinct_words, "block bigint, word bigint")
        self.given = need.join(self.words, "word").select("block", "word", "n", "number")

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Numbers of a few words by their hashes; UNKNOWN if they are in no text."""
        if self.few:
            known, at = found(self.sent.value.word, words)
            return np.where(known, self.sent.value.number[at] if known.any() else 0, UNKNOWN)
        rows = self.words.where(F.col("word").isin([int(w) for w in words.astype(I)])).select("word", "number").collect()
        by = {r["word"]: r["number"] for r in rows}
        return np.array([by.get(int(w), UNKNOWN) for w in words.astype(I)], I)

    def over(self, step: Callable, schema: str) -> DataFrame:
        """step(task, batches of (doc_id, held_out, text), lookup) for all texts."""
        if self.few:
            sent = self.sent

            def run(batches):
                from pyspark import TaskContext

                yield from step(TaskContext.get().partitionId(), batches, sent.value)

            return self.every.mapInArrow(run, schema)
        names = [f.split()[0] for f in schema.split(", ")]

        def run_block(texts: pa.Table, counts: pa.Table) -> pa.Table:
            block = texts.column("block")[0].as_py() if texts.num_rows else 0
            texts = texts.select(["doc_id", "held_out", "text"]).combine_chunks()
            made = list(step(block, texts.to_batches(), Lookup.of(counts.select(["word", "n", "number"]))))
            return pa.Table.from_batches([m.select(names) for m in made])

        return self.blocks.groupBy("block").cogroup(self.given.groupBy("block")).applyInArrow(run_block, schema)


def _numbered(words: DataFrame, distinct: int) -> DataFrame:
    """(word, n, number) with numbers from 0 on, made in buckets of words."""
    bucket = F.pmod(F.xxhash64("word"), F.lit(distinct // 100_000 + 1)).alias("bucket")
    placed = stored(words.select("word", "n", bucket), "word-buckets")
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("c")).orderBy("bucket").collect()
    first = np.cumsum([0, *[r["c"] for r in sizes]]).tolist()
    starts = words.sparkSession.createDataFrame([(r["bucket"], a) for r, a in zip(sizes, first)], "bucket bigint, first bigint")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("word")) - 1
    return placed.join(F.broadcast(starts), "bucket").select("word", "n", (F.col("first") + place).cast("int").alias("number"))


def values(numbers: np.ndarray) -> np.ndarray:
    return (numbers.astype(I) - UNKNOWN).astype(U)


def suffixes(past: list[np.ndarray], at_start: U) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(hashes of the contexts of 1, 2, ... words, whether they are defined) of tokens,
    given the words before them, the last one first, as (number, value)."""
    out, defined, there = [], [], None
    for depth in range(1, len(past) + 1):
        number, value = past[depth - 1]
        there = number >= AT_START if there is None else there & (number >= AT_START)
        context = np.where(number == AT_START, at_start, value)
        for k in range(depth - 2, -1, -1):
            context = extend(context, past[k][1])
        out.append(context)
        defined.append(there)
    return out, defined


def numbered_tokens(batches, lookup: Lookup, depth: int) -> Iterator[tuple]:
    """(batch, tokens, starts, place in the lookup, known, [word numbers before each token,
    the last first], word numbers) of slices of texts."""
    for b in batches:
        for a in range(0, b.num_rows, BATCH_ROWS):
            part, row = b.slice(a, BATCH_ROWS), 0
            for tokens, starts in sequences(part.column(part.num_columns - 1)):
                u, _, place = ranked(tokens)
                known, at = (x[place] for x in found(lookup.word, u))
                number = np.where(known, lookup.number[at] if len(lookup.number) else 0, UNKNOWN).astype(np.int32)
                number[starts[:-1]] = AT_START
                back, past = reach(starts, len(tokens)), []
                for k in range(1, depth + 1):
                    before = np.full(len(tokens), UNDEFINED, np.int32)
                    before[k:] = number[:-k] if k < len(number) else number[:0]
                    before[back < k] = UNDEFINED
                    past.append(before)
                n = len(starts) - 1
                yield part.slice(row, n), tokens, starts, at, known, past, number
                row += n


@dataclass
class Heavy:
    """Contexts of one depth with more than BRANCH training tokens, in order of their
    hashes: tokens, mass left to the parent, first of their twigs and number of twigs."""

    context: np.ndarray
    size: np.ndarray
    rest: np.ndarray
    first: np.ndarray
    twigs: np.ndarray


@dataclass
class Plan:
    """A twig is some branches, dealt in FINER pieces that are grown at once; a part has
    several twigs. Twigs of a heavy context follow one another and lie in as few parts as
    hold them, since each of these is sent the context's next words."""

    parts: int
    twigs: int
    heavy: list[Heavy]
    total: int = 0

    def ends(self) -> np.ndarray:
        """Training tokens of all twigs up to each, about."""
        light = max(self.total - sum(int(h.size.sum()) for h in self.heavy[:1]), self.twigs) / self.twigs
        return np.cumsum(np.concatenate([np.full(self.twigs, light), *(np.repeat(h.size / h.twigs, h.twigs) for h in self.heavy)]))

    def part_of(self) -> np.ndarray:
        """The part of every twig; parts have about as many tokens each."""
        ends = self.ends()
        middle = ends - np.diff(ends, prepend=0) / 2
        return np.minimum(middle * self.parts / ends[-1], self.parts - 1).astype(I)

    def deal(self, past: list[np.ndarray], row: np.ndarray, chunk: int) -> np.ndarray:
        """The twig of every token, times FINER, and the piece."""
        contexts, defined = suffixes([(p, values(p)) for p in past], values(np.array([AT_START]))[0])
        single = hashing.mix(row.astype(U) + hashing.mix(np.array([chunk], I).astype(U)))
        by = [np.where(d, hashing.mix(c + SPREAD), single) for c, d in zip(contexts, defined)]
        twig = (by[0] % U(FINER * self.twigs)).astype(I)
        on = np.flatnonzero(defined[0])
        for depth, heavy in enumerate(self.heavy):
            there, at = found(heavy.context, contexts[depth][on])
            on, at = on[there], at[there]
            finer = by[depth + 1] if depth + 1 < len(by) else single
            twig[on] = FINER * heavy.first[at] + (finer[on] % (FINER * heavy.twigs[at]).astype(U)).astype(I)
            on = on[defined[depth + 1][on]] if depth + 1 < len(by) else on
        return twig


def planned(corpus: Corpus, branch: int) -> tuple[Plan, DataFrame | None]:
    """How tokens are dealt, and (part, depth, context, word, n) of next words of heavy
    contexts for the parts whose twigs need them."""
    tree, depths, least = corpus.tree, corpus.shape.depth, corpus.shape.least
    spark = corpus.every.sparkSession
    plan = Plan(tree.total // PART + 1, tree.total // branch + 1, [], tree.total)
    ends, rows = 0, []
    if tree.total > branch:
        top = corpus.words.where(F.col("n") > branch).select("word", "n").collect()
        end = corpus.words.where(F.col("word") == int(END.astype(I))).select("n").first()
        ends = end["n"] if end else 0
        number = corpus.numbers(np.array([r["word"] for r in top], I).astype(U))
        rows = [((int(k),), r["n"]) for k, r in zip(number, top) if r["word"] != int(END.astype(I))]
        if ends > branch:
            rows.append(((AT_START,), ends))
    end_number = int(corpus.numbers(np.array([END]))[0])
    free, given, placed, own = plan.twigs, None, [], {}
    for depth in range(1, depths + 1):
        if not rows:
            break
        # a context is its words, the first one first
        hashes = [int(_context(words)) for words, _ in rows]
        order = np.argsort(np.array(hashes, U))
        rows, context = [rows[k] for k in order], np.array(hashes, U)[order]
        wanted = spark.sparkContext.broadcast(context)
        table = stored(_next_words(corpus, wanted, depth, least), "next-words")
        sums = {r["context"]: (r["n"], r["c"]) for r in table.groupBy("context").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()}
        size = np.array([n for _, n in rows], I)
        held = np.array([sums.get(int(c), (0, 0)) for c in context.astype(I)], float)
        twigs = -(-size // branch)
        first = free + np.cumsum(twigs) - twigs
        free = int(first[-1] + twigs[-1])
        plan.heavy.append(Heavy(context, size, 1 - (held[:, 0] - corpus.shape.discount * held[:, 1]) / size, first, twigs))
        for (words, _), f, k in zip(rows, first.tolist(), twigs.tolist()):
            for skip in range(depth):  # the context and its ancestors
                placed += [(int(_context(words[skip:]).astype(I)), depth - skip, f + i) for i in range(k)]
        table = table.withColumn("depth", F.lit(depth))
        given = table if given is None else given.union(table)
        own |= {int(c): words for c, (words, _) in zip(context.astype(I), rows)}
        longer = table.where((F.col("n") > branch) & (F.col("word") != end_number)).collect()
        rows = [((*own[r["context"]], r["word"]), r["n"]) for r in longer]
    if given is not None:
        plan.parts = int(plan.ends()[-1]) // PART + 1
        parts = plan.part_of()[[twig for _, _, twig in placed]].tolist()
        wanted = sorted({(context, depth, part) for (context, depth, _), part in zip(placed, parts)})
        where = spark.createDataFrame(wanted, "context bigint, depth int, part bigint")
        given = given.join(F.broadcast(where), ["context", "depth"]).select("part", "depth", "context", "word", "n")
    return plan, given


def _context(words: tuple[int, ...]) -> np.uint64:
    numbers = values(np.array(words))
    out = numbers[:1]
    for w in numbers[1:]:
        out = extend(out, w)
    return out[0]


def _next_words(corpus: Corpus, wanted, depth: int, least: int) -> DataFrame:
    """(context, word, n) of next words of the wanted contexts in training texts, n >= least."""

    def step(_, batches, lookup):
        sums, known = Sums(["context", "word"]), wanted.value
        for part, _, starts, _, _, past, number in numbered_tokens(batches, lookup, depth):
            contexts, defined = suffixes([(p, values(p)) for p in past], values(np.array([AT_START]))[0])
            free = ~part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            usable = defined[-1] & np.repeat(free, np.diff(starts)) & found(known, contexts[-1])[0]
            context, word = contexts[-1][usable], number[usable].astype(I)
            sums.add(hashing.mix(context * PAIR + values(word)), [context, word])
            yield from sums.batches(False)
        yield from sums.batches(True)

    rows = corpus.over(step, "context bigint, word bigint, n bigint")
    return rows.groupBy("context", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


@dataclass
class Grown:
    """States of one depth in a twig: place of each token's context and of its pair of
    context and word (for the tokens `on`), what is known of these."""

    on: np.ndarray
    context: np.ndarray
    pair: np.ndarray
    contexts: np.ndarray | None
    pairs: np.ndarray | None
    keep: np.ndarray
    rest: np.ndarray
    share: np.ndarray
    of: np.ndarray


def grown(contexts: list[np.ndarray], defined: list[np.ndarray], word: np.ndarray, trains: np.ndarray, base: np.ndarray,
          shape: Shape, heavy: list[Heavy], given: list[tuple[np.ndarray, np.ndarray]], named: bool = False) -> list[Grown]:
    """Branches of the tree from the tokens of a twig: values of the words, whether they
    are of training texts, probabilities at the root; and (pair, count) of the next
    words of heavy contexts, in order of the pairs, for each depth."""
    levels: list[Grown] = []
    q_of = base
    first_of = []
    for depth, (context, there) in enumerate(zip(contexts, defined), 1):
        on = np.flatnonzero(there).astype(np.int32)
        u, first, at = ranked(context[on])
        pairs, pair_first, pair_at = ranked(hashing.mix(context[on] * PAIR + word[on]))
        size = np.bincount(at, trains[on], len(u)).astype(float)
        n = np.bincount(pair_at, trains[on], len(pairs)).astype(float)
        of = at[pair_first]  # the context of a pair
        known = np.zeros(len(u), bool)
        if depth <= len(heavy):
            known, place = found(heavy[depth - 1].context, u)
            size[known] = heavy[depth - 1].size[place[known]]
            summed = known[of]
            has, where = found(given[depth - 1][0], pairs)
            n[summed] = np.where(has, given[depth - 1][1][where] if len(given[depth - 1][1]) else 0, 0)[summed]
        p = n / np.maximum(size[of], 1)
        held = n >= shape.least
        p_held, q_held, of_held = p[held], np.minimum(q_of[on[pair_first[held]]], 1.0), of[held]
        gain = np.bincount(of_held, p_held * np.log(p_held / q_held), len(u)).astype(float)
        rest_p = np.maximum(1 - np.bincount(of_held, p_held, len(u)), 0)
        rest_q = np.maximum(1 - np.bincount(of_held, q_held, len(u)), 1e-12)
        gain += np.where(rest_p > 0, rest_p * np.log(np.maximum(rest_p, 1e-300) / rest_q), 0)
        share = np.where(held, (n - shape.discount) / np.maximum(size[of], 1), 0.0)
        rest = 1.0 - np.bincount(of, share, len(u))
        keep = (gain * size >= shape.divergence) | known
        if known.any():
            rest[known] = heavy[depth - 1].rest[place[known]]
        levels.append(Grown(on, at, pair_at, u if named else None, pairs if named else None, keep, rest, share, of))
        first_of.append(on[first])
        q_of = np.ones(len(word))
        q_of[on] = p[pair_at]
        del u, first, pairs, pair_first, n, p, held, gain, size, rest_p, rest_q, p_held, q_held, of_held
    for depth in range(len(levels) - 1, 0, -1):  # ancestors stay
        level, upper = levels[depth], levels[depth - 1]
        place = np.zeros(len(word), I)
        place[upper.on] = upper.context
        upper.keep[place[first_of[depth][level.keep]]] = True
    return levels


def scored(levels: list[Grown], base: np.ndarray) -> np.ndarray:
    """Probability of every token of a twig, given the root's."""
    p, live = base.copy(), np.ones(len(base), bool)
    for level in levels:
        kept = level.keep[level.context] & live[level.on]
        live = np.zeros(len(base), bool)
        live[level.on[kept]] = True
        own = level.share[level.pair[kept]]
        p[level.on[kept]] = own + level.rest[level.context[kept]] * p[level.on[kept]]
    return p


RESULT = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
)
TEXTS = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64()}


def _schema(fields: dict[str, pa.DataType]) -> str:
    plain = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.int16(): "smallint", pa.bool_(): "boolean", pa.float64(): "double"}
    return ", ".join(f"{k} {f'array<{plain[t.value_type]}>' if isinstance(t, pa.ListType) else plain[t]}" for k, t in fields.items())


def _lists(offsets: np.ndarray, column: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(column, kind))


DEALT = {"part": pa.int64(), "chunk": pa.int64(), "n_tokens_dealt": pa.int64(), "n_twigs": pa.int64(), "packed": pa.binary(),
         **{k: pa.list_(t) for k, t in TEXTS.items()}}


def packed(columns: list[np.ndarray], twigs: np.ndarray, sizes: np.ndarray) -> bytes:
    """Columns of tokens in order of their twigs, and the sizes of these, compressed. Bytes
    of a column lie by their place in the number, so the upper ones are long runs."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.itemsize).T).ravel() for c in columns]
    return pa.compress(np.concatenate([twigs.view(np.uint8), sizes.view(np.uint8), *planes]), "zstd", asbytes=True)


def unpacked(blob: pa.Buffer, n: int, n_twigs: int, kinds: list[type]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(twigs, their sizes, columns) of n tokens."""
    end = 16 * n_twigs
    data = np.frombuffer(pa.decompress(blob, end + n * sum(np.dtype(k).itemsize for k in kinds), "zstd"), np.uint8)
    columns = []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        columns.append(np.ascontiguousarray(data[end : end + n * width].reshape(width, n).T).view(kind).ravel())
        end += n * width
    return data[: 8 * n_twigs].view(I), data[8 * n_twigs : 16 * n_twigs].view(I), columns


def _token_kinds(depth: int, few: bool) -> list[type]:
    """Numbers of a token's word and of those before it, its text, its word's count."""
    return [np.int32] * (depth + 1) + [np.int16] + ([] if few else [I])


def _twigs(table: pa.Table, depth: int, few: bool) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(twig and piece, columns of its tokens, the table's row of each) of a part's rows;
    rows about texts are passed over."""
    counts = table.column("n_tokens_dealt").fill_null(0).to_numpy()
    kinds, total, end = _token_kinds(depth, few), int(counts.sum()), 0
    every, held, row = [np.empty(total, k) for k in kinds], np.empty(total, np.int32), np.empty(total, np.int32)
    number: dict[int, int] = {}
    rows = zip(table.column("packed"), counts.tolist(), table.column("n_twigs").to_pylist())
    for k, (blob, n, n_twigs) in enumerate(rows):
        if not blob.is_valid:
            continue
        twigs, sizes, columns = unpacked(blob.as_buffer(), n, n_twigs, kinds)
        for whole, c in zip(every, columns):
            whole[end : end + n] = c
        held[end : end + n] = np.repeat([number.setdefault(t, len(number)) for t in twigs.tolist()], sizes)
        row[end : end + n] = k
        end += n
    for twig, k in number.items():
        at = np.flatnonzero(held == k)
        yield twig, [c[at] for c in every], row[at]


def dealt(corpus: Corpus, plan: Plan) -> DataFrame:
    """Tokens with the words before them, packed for each part and chunk of texts, and
    one row about the texts of each chunk. Rows of texts that are held out are
    inverted. Counts of the words come along if they are not sent to all tasks."""
    depth, few, tree = corpus.shape.depth, corpus.few, corpus.tree
    fields = DEALT
    part_of = plan.part_of()
    rank = np.empty(len(part_of), I)
    rank[np.argsort(part_of, kind="stable")] = np.arange(len(part_of))

    def step(task, batches, lookup):
        release()
        chunk, texts, columns, rows, size = task << 32, [], [], 0, 0

        def batch():
            past = [np.concatenate([c[k] for c in columns]) for k in range(depth)]
            word, row = (np.concatenate([c[k] for c in columns]) for k in (depth, depth + 1))
            n = None if few else np.concatenate([c[depth + 2] for c in columns])
            columns.clear()
            twig = plan.deal(past, np.where(row < 0, ~row, row), chunk)
            # by part, then by twig
            place = rank[twig // FINER] * FINER + twig % FINER
            order = np.argsort(place * (1 << 32) + past[0].astype(I) - UNKNOWN)
            del place
            twig = twig[order]
            # frequent words have small numbers, so the upper bytes compress well
            every = [*(c[order] - np.int32(UNKNOWN) for c in (word, *past)), row[order], *([] if few else [n[order]])]
            del past, word, row, n, order
            new = np.flatnonzero(np.append(len(twig) > 0, twig[1:] != twig[:-1]))
            twigs, sizes = twig[new], np.diff(np.append(new, len(twig)))
            part = part_of[twigs // FINER]
            first = np.flatnonzero(np.append(len(part) > 0, part[1:] != part[:-1]))
            made = {name: [] for name in ("part", "chunk", "n_tokens_dealt", "n_twigs", "packed")}
            for a, z in zip(first.tolist(), [*first[1:].tolist(), len(part)]):
                at, to = int(new[a]), int(new[z]) if z < len(new) else len(twig)
                values = (int(part[a]), chunk, to - at, z - a, packed([c[at:to] for c in every], twigs[a:z], sizes[a:z]))
                for name, v in zip(made, values):
                    made[name].append(v)
            made = {name: pa.array(v, fields[name]) for name, v in made.items()}
            about = {"part": pa.array([(chunk * 31 + (chunk >> 32)) % plan.parts], pa.int64()), "chunk": pa.array([chunk], pa.int64())}
            for k, name in enumerate(TEXTS):
                column = pa.concat_arrays([t[k] for t in texts])
                about[name] = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
            for m in (made, about):
                count = len(m["part"])
                yield pa.RecordBatch.from_arrays([m[f] if f in m else pa.nulls(count, t) for f, t in fields.items()], list(fields))

        for part, tokens, starts, at, known, past, number in numbered_tokens(batches, lookup, depth):
            mark, n_texts = starts[:-1], len(starts) - 1
            if texts and (rows + n_texts > CHUNK_ROWS or size + len(tokens) > CHUNK):
                yield from batch()
                chunk, texts, columns, rows, size = chunk + 1, [], [], 0, 0
            known = known.copy()
            known[mark] = False
            count = np.where(known, lookup.n[at] if len(lookup.n) else 0, 0).astype(I)
            base = np.log10(tree.base(count)) if tree.total else np.zeros(len(tokens))
            base[mark] = 0.0
            sums = [np.add.reduceat(x, mark) for x in (known.astype(I), base)]
            texts.append([part.column(0), part.column(1), pa.array(np.diff(starts) - 1), pa.array(sums[0]), pa.array(sums[1])])
            own = np.arange(rows, rows + n_texts)
            own = np.where(part.column(1).to_numpy(zero_copy_only=False).astype(bool), ~own, own).astype(np.int16)
            real = np.ones(len(tokens), bool)
            real[mark] = False
            columns.append([*(p[real] for p in past), number[real], np.repeat(own, np.diff(starts))[real], None if few else count[real]])
            rows, size = rows + n_texts, size + len(tokens)
        if texts:
            yield from batch()

    return corpus.over(step, _schema(fields))


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def sent_pairs(plan: Plan, given: pa.Table | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pairs of heavy contexts and next words in order, their counts) of each depth."""
    sent = []
    for depth in range(1, len(plan.heavy) + 1):
        mine = given.filter(pa.compute.equal(given.column("depth"), depth)) if given is not None else None
        if mine is None:
            sent.append((np.zeros(0, U), np.zeros(0, I)))
            continue
        context, word, count = (mine.column(c).to_numpy() for c in ("context", "word", "n"))
        pair = hashing.mix(context.astype(U) * PAIR + values(word))
        order = np.argsort(pair)
        sent.append((pair[order], count[order]))
    return sent


def _branches(corpus: Corpus, plan: Plan, counts, value: Callable = values, at_start: U | None = None) -> Callable:
    """(the levels of a twig, base probabilities), of the columns of its tokens and the counts
    that its part was given, as `sent_pairs` has them."""
    shape, tree = corpus.shape, corpus.tree
    at_start = values(np.array([AT_START]))[0] if at_start is None else at_start

    def run(tokens: list[np.ndarray], sent: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[Grown], np.ndarray]:
        numbers = [c + np.int32(UNKNOWN) for c in tokens[: shape.depth + 1]]
        if counts is not None:
            n = np.where(numbers[0] >= 0, counts.value[np.maximum(numbers[0], 0)] if len(counts.value) else 0, 0)
        else:
            n = tokens[shape.depth + 2]
        base = tree.base(n) if tree.total else np.ones(len(n))
        contexts, defined = suffixes([(c, value(c)) for c in numbers[1:]], at_start)
        trains = (tokens[shape.depth + 1] >= 0).astype(float)
        return grown(contexts, defined, value(numbers[0]), trains, base, shape, plan.heavy, sent, counts is not None and at_start == START), base

    return run


def grow(texts: DataFrame, words: DataFrame, shape: Shape) -> Tree:
    """The whole tree of training texts with these word counts, collected, for corpora
    whose tree fits one machine. Scores of a corpus come from `score`."""
    every = texts.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(False).alias("held_out"), texts.columns[0])
    corpus = Corpus(every, words, shape, 1 << 31)
    sent = corpus.sent
    plan = Plan(corpus.tree.total // BRANCH + 1, corpus.tree.total // BRANCH + 1, [])
    counts = every.sparkSession.sparkContext.broadcast(sent.value.by_number(sent.value.n))
    known = every.sparkSession.sparkContext.broadcast(sent.value.by_number(sent.value.word))

    def value(numbers: np.ndarray) -> np.ndarray:
        words = known.value
        return np.where(numbers >= 0, words[np.maximum(numbers, 0)], values(numbers)) if len(words) else values(numbers)

    branches = _branches(corpus, plan, counts, value, START)

    def run(table: pa.Table) -> pa.Table:
        made = [pa.table({c: pa.array([], t) for c, t in (("depth", pa.int64()), ("kind", pa.int64()), ("hash", pa.int64()), ("x", pa.float64()))})]
        for _, tokens, _ in _twigs(table, shape.depth, True):
            for depth, x in enumerate(branches(tokens, [])[0], 1):
                pair = x.keep[x.of] & (x.share > 0)
                for kind, key, number in ((0, x.contexts[x.keep], x.rest[x.keep]), (1, x.pairs[pair], x.share[pair])):
                    made.append(pa.table({"depth": pa.array(np.full(len(key), depth, I)), "kind": pa.array(np.full(len(key), kind, I)),
                                          "hash": pa.array(key.astype(I)), "x": pa.array(number)}))
        return pa.concat_tables(made)

    rows = dealt(corpus, plan).groupBy("part").applyInArrow(run, "depth bigint, kind bigint, hash bigint, x double").toArrow()
    depth, kind, key, x = (rows.column(k).to_numpy() for k in range(4))
    for d in range(1, shape.depth + 1):
        states = []
        for k in (0, 1):
            mine = (depth == d) & (kind == k)
            order = np.argsort(key[mine].astype(U))
            states += [key[mine].astype(U)[order], x[mine][order]]
        corpus.tree.levels.append(Level(*states))
    return corpus.tree


def _ordered(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    word, n = (table.column(k).to_numpy() for k in (0, 1))
    word = word.astype(U)
    order = np.argsort(word)
    return word[order], n[order]


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", shape: Shape = Shape(),
          max_words: int = MAX_BROADCAST_WORDS, branch: int = BRANCH) -> DataFrame:
    """RESULT for every row of docs; texts with crc32(id as text) mod 10 = 0 are held out."""
    spark = docs.sparkSession
    number = F.col(key).cast("bigint")
    held = (F.crc32(F.coalesce(number.cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out")
    every = docs.select(number.alias("doc_id"), held, F.col(text).alias("text"))
    words = stored(count_words(every.where(~F.col("held_out")).select("text")), "words")
    corpus = Corpus(every, words, shape, max_words)
    plan, given = planned(corpus, branch)
    counts = spark.sparkContext.broadcast(corpus.sent.value.by_number(corpus.sent.value.n)) if corpus.few else None
    branches = _branches(corpus, plan, counts)
    total, depth, few = corpus.tree.total, shape.depth, corpus.few
    fields = {"chunk": pa.int64(), "row": pa.list_(pa.int16()), "p": pa.list_(pa.float64()), **{k: pa.list_(t) for k, t in TEXTS.items()}}

    def run(table: pa.Table, sent: pa.Table | None = None) -> pa.Table:
        """Sums of the logarithms for the texts of each chunk."""
        release()
        about = table.filter(pa.compute.is_valid(table.column("doc_id")))
        made = {name: about.column(name).combine_chunks() for name in ("chunk", *TEXTS)}
        out = [pa.RecordBatch.from_arrays([made[f] if f in made else pa.nulls(about.num_rows, t) for f, t in fields.items()], list(fields))]
        dealt_rows = pa.compute.is_valid(table.column("packed")).to_numpy()
        chunk_of = np.zeros(table.num_rows, I)
        chunks, chunk_of[dealt_rows] = np.unique(table.column("chunk").to_numpy()[dealt_rows], return_inverse=True)
        where, sums = [np.zeros(0, I)], [np.zeros(0)]

        def fold() -> None:
            texts, at = np.unique(np.concatenate(where), return_inverse=True)
            sums[:] = [np.bincount(at, np.concatenate(sums), len(texts)).astype(float)]
            where[:] = [texts]

        pairs = sent_pairs(plan, sent)
        for _, tokens, from_row in _twigs(table, depth, few):
            levels, base = branches(tokens, pairs)
            p, row = np.log10(scored(levels, base)), tokens[depth + 1].astype(I)
            del levels, tokens, base
            texts, at = np.unique(chunk_of[from_row] * CHUNK_ROWS + np.where(row < 0, ~row, row), return_inverse=True)
            where.append(texts)
            sums.append(np.bincount(at, p, len(texts)))
            del p, row, at, from_row
            if sum(map(len, where[1:])) > max(CHUNK, len(where[0])):
                fold()
        fold()
        texts = where[0]
        offsets = np.searchsorted(texts, np.arange(len(chunks) + 1) * CHUNK_ROWS)
        made = {"chunk": pa.array(chunks), "row": _lists(offsets, texts % CHUNK_ROWS, pa.int16()),
                "p": _lists(offsets, sums[0], pa.float64())}
        out.append(pa.RecordBatch.from_arrays([made[f] if f in made else pa.nulls(len(chunks), t) for f, t in fields.items()], list(fields)))
        return pa.Table.from_batches(out)

    def add(table: pa.Table) -> pa.Table:
        """The texts of a chunk with the sums of all parts."""
        about = table.filter(pa.compute.is_valid(table.column("doc_id")))
        made = {name: about.column(name).combine_chunks().flatten() for name in TEXTS}
        n = len(made["doc_id"])
        made["train_tokens"] = pa.array(np.full(n, total, I))
        made["score"] = pa.array(np.bincount(_flat(table, "row"), _flat(table, "p"), n))
        names = [f.split()[0] for f in RESULT.split(", ")]
        return pa.table([made[f] for f in names], names)

    parts = dealt(corpus, plan).groupBy("part")
    if given is None:
        sums = parts.applyInArrow(lambda table: run(table), _schema(fields))
    else:
        def run_given(table: pa.Table, sent: pa.Table) -> pa.Table:
            return run(table, sent)

        sums = parts.cogroup(given.groupBy("part")).applyInArrow(run_given, _schema(fields))
    return sums.groupBy("chunk").applyInArrow(add, RESULT)
