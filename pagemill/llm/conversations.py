"""Conversations brought into a legal order of roles, at the least cost, by a shared
automaton of signatures.

A row is blank (no character but white space), a duplicate (role and text seen earlier in
its conversation) or truncated (its last character but white space is none of . ! ?);
the first of these counts. A legal conversation is empty or has an optional system row
and then pairs of user and assistant. Edits: Keep costs 0, Rerole to user or assistant 1,
Delete 2 (the only way for blank and duplicate rows), Insert an empty user or assistant
row 5; a truncated row that stays costs 5 more. Of the cheapest edits those count whose
initials come first in ASCII order.

A row is a letter (its role, upper case if truncated, d if it must go), a conversation a
word, its signature. Words are sorted from their ends, so that equal suffixes of all
conversations meet: a suffix is a node, and its cost-to-go and first edit are computed
once for each grammar state (start, after system, user, assistant), when the first word
with it is met. Nodes with equal differences of cost are one class of the minimal
automaton, and a step from a class by a letter is worked out once in a task. The
candidates for the first edit differ in their initial, so the cheapest one with the least
initial begins the best audit, which is read off from node to node.

Rows of a conversation are ordered by turn (nulls first), then role, then MD5 of the
text. Null roles and texts are one space; a role that does not begin with s, u or a cannot
be kept. Null conversation ids are one conversation. Repeated rows are rows. An empty
table gives no rows. Other columns are left out.

Rows are sorted by Spark and streamed, so a task holds a batch of texts, and a byte for
each row of one conversation; a conversation's rows pass through one task, because a
digest of the whole must.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
ADDED = (USER, USER, ASSISTANT, USER)  # the state after an inserted or reroled row
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
BYTES = 4 << 20  # texts in an Arrow batch that is handed on


# ---- rows and their faults


def _rows(rows: DataFrame, conv: str, turn: str, present: str | None) -> DataFrame:
    """(c, t, role, text, m, here); rows that are not present have a conversation only."""
    here = F.lit(True) if present is None else F.coalesce(F.col(present), F.lit(False))
    text = F.coalesce(F.col("text"), F.lit(" "))

    def own(value: Column) -> Column:
        return F.when(here, value)

    return rows.select(
        F.col(conv).alias("c"), own(F.col(turn).cast("bigint")).alias("t"), own(F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
        own(text).alias("text"), own(F.unhex(F.md5(text))).alias("m"), here.alias("here"),
    )


def _faults(rows: DataFrame) -> DataFrame:
    """(c, t, role, m, first letter of the role, fault): 1 blank, 2 duplicate, 3 truncated,
    0 none, -1 not present. No text is shuffled."""
    body = F.rtrim("text", F.lit(SPACE))
    own = (
        F.when(~F.col("here"), -1).when(body == "", 1).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    )
    slim = rows.select("c", "t", "role", "m", own.cast("tinyint").alias("own")).repartition("c")
    # the window needs no other exchange: it is within conversations
    nth = F.row_number().over(Window.partitionBy("c", "role", "m").orderBy(F.asc_nulls_first("t")))
    fault = F.when((F.col("own") != 1) & (F.col("own") >= 0) & (nth > 1), 2).otherwise(F.col("own"))
    return slim.select("c", "t", "role", "m", F.left("role", F.lit(1)).alias("letter"), fault.cast("tinyint").alias("fault"))


STATS = "c {key}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, suffix string"


def _assessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a sorted stream; suffix: the signature from its end."""
    done: list[tuple] = []
    conv = turn = letter = low = None
    n = [0, 0, 0, 0]
    turns = illegal = 0
    word: bytearray | None = None
    key = names = None

    def end() -> None:
        gaps = turn - low + 1 - turns if turns else 0
        done.append((conv, gaps, n[1], n[2], n[3], illegal, bytes(reversed(word)).decode("ascii")))

    def batch() -> pa.RecordBatch:
        types = [key, *[pa.int64()] * 5, pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], names)
        done.clear()
        return made

    names = ["c", "gaps", "blank", "duplicate", "truncated", "illegal", "suffix"]
    for b in batches:
        key = b.column(0).type
        for c, t, first, fault in zip(*[x.to_pylist() for x in b.columns]):
            if word is None or c != conv:
                if word is not None:
                    end()
                conv, turn, letter, low, word = c, None, None, None, bytearray()
                n, turns, illegal = [0, 0, 0, 0], 0, 0
            if fault < 0:
                continue
            if t is not None and (not turns or t != turn):
                low = t if low is None else low
                turn, turns = t, turns + 1
            if letter is not None and letter + first not in ("su", "ua", "au"):
                illegal += 1
            letter = first
            n[fault] += 1
            sign = first if first in ("s", "u", "a") else "x"
            word += b"d" if fault in (1, 2) else (sign.upper() if fault == 3 else sign).encode()
        if len(done) >= 5000:
            yield batch()
    if word is not None:
        end()
        yield batch()


# ---- the automaton


class Automaton:
    """Classes of suffixes. costs[k]: cost-to-go from each grammar state, less the least
    of them; steps[k, letter]: (class before that letter, what the least cost grows by,
    the first edit from each state)."""

    def __init__(self) -> None:
        self.costs: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int, str]] = {}
        finish = self._inserted([(0, ""), (99, ""), (99, ""), (0, "")])
        self.end = self._number(tuple(c for c, _ in finish))
        self.last = [e for _, e in finish]

    def _number(self, costs: tuple[int, ...]) -> int:
        if costs not in self.numbers:
            self.numbers[costs] = len(self.costs)
            self.costs.append(costs)
        return self.numbers[costs]

    @staticmethod
    def _inserted(best: list[tuple[int, str]]) -> list[tuple[int, str]]:
        for _ in range(3):  # two insertions lead from any state to any state they can reach
            best = [min(best[q], (INSERT + best[ADDED[q]][0], "I")) for q in range(4)]
        return best

    def before(self, after: int, letter: str) -> tuple[int, int, str]:
        """The class of the suffix that begins with this letter and goes on as `after`."""
        if (after, letter) not in self.steps:
            costs = self.costs[after]
            role, more = letter.lower(), TRUNCATED if letter.isupper() else 0
            best = []
            for q in range(4):
                edits = [(DELETE + costs[q], "D")]
                if role != "d":
                    edits.append((REROLE + more + costs[ADDED[q]], "R"))
                    if role in KEPT[q]:
                        edits.append((more + costs[KEPT[q][role]], "K"))
                best.append(min(edits))
            best = self._inserted(best)
            least = min(c for c, _ in best)
            number = self._number(tuple(c - least for c, _ in best))
            self.steps[after, letter] = (number, least, "".join(e for _, e in best))
        return self.steps[after, letter]


class Audits:
    """Cost and audit of signatures that come sorted by their ends: nodes of the suffix
    shared with the signature before are not computed again."""

    def __init__(self) -> None:
        self.automaton = Automaton()
        self.word = ""  # from the end
        self.nodes = [self.automaton.end]
        self.least = [0]
        self.computed = 0
        self.result = self._read()

    def of(self, word: str) -> tuple[int, str]:
        if word != self.word:
            shared = 0
            top = min(len(word), len(self.word))
            while shared < top and word[shared] == self.word[shared]:
                shared += 1
            del self.nodes[shared + 1 :], self.least[shared + 1 :]
            for letter in word[shared:]:
                number, more, _ = self.automaton.before(self.nodes[-1], letter)
                self.nodes.append(number)
                self.least.append(self.least[-1] + more)
                self.computed += 1
            self.word = word
            self.result = self._read()
        return self.result

    def _read(self) -> tuple[int, str]:
        state, audit = START, []
        for at in range(len(self.word), 0, -1):
            letter = self.word[at - 1]
            edits = self.automaton.before(self.nodes[at - 1], letter)[2]
            while edits[state] == "I":
                audit.append("I")
                state = ADDED[state]
            audit.append(edits[state])
            if edits[state] != "D":
                state = KEPT[state][letter.lower()] if edits[state] == "K" else ADDED[state]
        while self.automaton.last[state]:
            audit.append("I")
            state = ADDED[state]
        return self.least[-1] + self.automaton.costs[self.nodes[-1]][START], "".join(audit)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    audits = Audits()
    for b in batches:
        rows = [audits.of(word) for word in b.column("suffix").to_pylist()]
        own = b.drop_columns(["suffix"])
        made = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())]
        yield pa.RecordBatch.from_arrays([*own.columns, *made], [*own.schema.names, "cost", "audit"])


def _audits(rows: DataFrame) -> DataFrame:
    """(c, gaps, blank, duplicate, truncated, illegal, cost, audit), written."""
    faults = _faults(rows)
    key = rows.schema["c"].dataType.simpleString()
    ordered = faults.sortWithinPartitions("c", F.asc_nulls_first("t"), "role", "m").select("c", "t", "letter", "fault")
    assessed = stored(ordered.mapInArrow(_assessed, STATS.format(key=key)), "signatures")
    # equal suffixes come together; many equal ones are dealt out by the conversation
    dealt = assessed.repartitionByRange("suffix", "c").sortWithinPartitions("suffix")
    schema = STATS.format(key=key).replace("suffix string", "cost bigint, audit string")
    return stored(dealt.mapInArrow(_audited, schema), "audits")


# ---- repaired rows


REPAIRED = "c {key}, position bigint, role string, text string, edit string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream of conversations, each its audit and then its rows in order, to repaired
    rows; every conversation begins with a row of position 0."""
    out: list[tuple] = []
    size = 0
    key = None
    conv, audit, at, state, position = None, "", 0, START, 0

    def batch() -> pa.RecordBatch:
        types = [key, pa.int64(), pa.string(), pa.string(), pa.string()]
        made = [pa.array(x, t) for x, t in zip(zip(*out), types)]
        out.clear()
        return pa.RecordBatch.from_arrays(made, ["c", "position", "role", "text", "edit"])

    def insert() -> None:
        nonlocal at, state, position
        while at < len(audit) and audit[at] == "I":
            state, at, position = ADDED[state], at + 1, position + 1
            out.append((conv, position, "user" if state == USER else "assistant", "", "I"))

    for b in batches:
        key = b.column(0).type
        for i in range(0, len(b), 500):
            for c, found, role, text in zip(*[x.to_pylist() for x in b.slice(i, 500).columns]):
                if found is not None:
                    conv, audit, at, state, position = c, found, 0, START, 0
                    out.append((conv, 0, None, None, None))
                else:
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        if edit == "K":
                            state = KEPT[state][role[0]]
                        else:
                            state = ADDED[state]
                            role = "user" if state == USER else "assistant"
                        position += 1
                        out.append((conv, position, role, text, edit))
                        size += len(text)
                insert()
            if size >= BYTES or len(out) >= 5000:
                yield batch()
                size = 0
    if out:
        yield batch()


def _stream(rows: DataFrame, audits: DataFrame) -> DataFrame:
    none = F.lit(None)
    heads = audits.select("c", F.lit(0).alias("kind"), none.cast("bigint").alias("t"), none.cast("string").alias("role"),
                          none.cast("binary").alias("m"), "audit", none.cast("string").alias("text"))
    body = rows.where("here").select("c", F.lit(1).alias("kind"), "t", "role", "m", none.cast("string").alias("audit"), "text")
    ordered = heads.unionAll(body).repartition("c").sortWithinPartitions("c", "kind", F.asc_nulls_first("t"), "role", "m")
    key = rows.schema["c"].dataType.simpleString()
    return ordered.select("c", "audit", "role", "text").mapInArrow(_repaired, REPAIRED.format(key=key))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of role:text lines of every conversation, as its rows pass by."""
    conv = digest = key = None
    done: list[tuple] = []

    def batch() -> pa.RecordBatch:
        made = [pa.array([c for c, _ in done], key), pa.array([d for _, d in done], pa.string())]
        done.clear()
        return pa.RecordBatch.from_arrays(made, ["c", "repaired_sha256"])

    for b in batches:
        key = b.column(0).type
        for c, position, role, text in zip(*[b.column(k).to_pylist() for k in range(4)]):
            if position == 0:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(f"{chr(10) if position > 1 else ''}{role}:{text}".encode())
        if len(done) >= 5000:
            yield batch()
    if digest is not None:
        done.append((conv, digest.hexdigest()))
        yield batch()


def repair_report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", present: str | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one
    row per conversation. rows has columns role and text; rows whose column `present` is
    not true do not count, but their conversation is reported."""
    own = _rows(rows, conv, turn, present)
    audits = _audits(own)
    key = own.schema["c"].dataType.simpleString()
    digests = _stream(own, audits).mapInArrow(_digests, f"c {key}, repaired_sha256 string").withColumnRenamed("c", "d")
    joined = audits.join(digests, F.col("c").eqNullSafe(F.col("d"))).drop("d")
    return joined.withColumnRenamed("c", conv)


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", present: str | None = None) -> DataFrame:
    """(conv, position, role, text, edit): the repaired conversations, positions from 1."""
    own = _rows(rows, conv, turn, present)
    return _stream(own, _audits(own)).where("position > 0").withColumnRenamed("c", conv)
