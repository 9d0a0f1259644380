"""Conversation repair against a search over all edits, and its edge cases."""

import hashlib
import itertools
import random

import pytest

from pagemill.llm import conversations as C

WHITE = " \t\n\x0b\x0c\r"


def legal(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return not initials or (rest != "" and rest == "ua" * (len(rest) // 2))


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(WHITE)
        out.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def searched(rows):
    """(cost, audit, repaired) of the best of all edits with at most two inserts in a row."""
    faults, best = faults_of(rows), None
    inserts = ["", "I", "II"]
    for kept in itertools.product("DKR", repeat=len(rows)):
        if any(k != "D" and f in ("b", "d") for k, f in zip(kept, faults)):
            continue
        base = sum({"D": 2, "K": 0, "R": 1}[k] + (5 if k != "D" and f == "t" else 0) for k, f in zip(kept, faults))
        if best and base > best[0]:
            continue
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            audit = "".join(g + k for g, k in zip(gaps, [*kept, ""]))
            cost = base + 5 * audit.count("I")
            if best and (cost, audit) >= best[:2]:
                continue
            at, out, ok = 0, [], True
            for e in audit:
                need = "u" if not out or out[-1][0][:1] != "u" else "a"
                if e == "I":
                    out.append(("user" if need == "u" else "assistant", ""))
                    continue
                role, text = rows[at]
                at += 1
                if e == "K":
                    ok = ok and role[:1] in ("s", "u", "a")
                    out.append((role, text))
                elif e == "R":
                    out.append(("user" if need == "u" else "assistant", text))
            if ok and legal("".join(r[:1] for r, _ in out)):
                best = (cost, audit, out)
    return best


def test_audits_against_all_edits():
    draw = random.Random(3)
    audits, words = C.Audits(), {}
    for _ in range(250):
        rows = [(draw.choice(["system", "user", "user", "assistant", "assistant", "tool", " "]),
                 draw.choice(["a.", "b!", "c", " ", "d?", f"{draw.random()}."])) for _ in range(draw.randint(0, 4))]
        word = ""
        for (role, _), f in zip(rows, faults_of(rows)):
            sign = role[0] if role[0] in "sua" else "x"
            word += "d" if f in ("b", "d") else sign.upper() if f == "t" else sign
        words[word[::-1]] = searched(rows)[:2]
    for word in sorted(words):
        assert audits.of(word) == words[word], word
    # a suffix is computed once, whatever the number of signatures with it
    suffixes = {w[:k] for w in words for k in range(1, len(w) + 1)}
    assert audits.computed == len(suffixes)
    assert len(audits.automaton.costs) < 60


def expected(rows):
    """Report of one conversation from its (turn, role, text) rows in order."""
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [(r, t) for _, r, t in rows]
    faults = faults_of(pairs)
    joined = [a[0][:1] + b[0][:1] for a, b in zip(pairs, pairs[1:])]
    cost, audit, out = searched(pairs) if rows else (0, "", [])
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
        sum(p not in ("su", "ua", "au") for p in joined), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
    )


def ordered(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or " ", hashlib.md5((" " if r[2] is None else r[2]).encode()).digest())
    return [(t, " " if r is None else r, " " if x is None else x) for t, r, x in sorted(rows, key=key)]


def test_report(spark):
    long = "word " * 50_000 + "end."
    given = {
        1: [(0, "user", "Hi?"), (1, "assistant", "Yes.")],
        2: [(0, "system", "Be kind."), (1, "user", "x"), (4, "user", "Hi?")],
        3: [(None, "user", "a."), (None, None, None), (2, "assistant", "b."), (2, "assistant", "b.")],
        4: [(None, "tool", "a.")],
        5: [(3, "assistant", "")],
        6: [(1, "user", long), (1, "user", "tie."), (1, "user", "another tie!")],
        None: [(9, "student", "é."), (7, "", "q.")],
    }
    rows = [(c, t, r, x, True, "z") for c, own in given.items() for t, r, x in own] + [(7, 1, "user", "gone.", False, "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, present boolean, c string").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair_report(df, present="present").collect()}
    assert got == {c: expected(ordered(own)) for c, own in {**given, 7: []}.items()}
    turns = {}
    for r in sorted(C.repaired_turns(df, present="present").collect(), key=lambda r: r.position):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {c: searched([(r, x) for _, r, x in ordered(own)])[2] for c, own in given.items() if got[c][5] is not None
                     and searched([(r, x) for _, r, x in ordered(own)])[2]}


def test_a_long_conversation_and_many_equal_ones(spark):
    rows = [(0, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(3000)]
    rows += [(c, k, ["user", "assistant"][k], "the same.") for c in range(1, 400) for k in range(2)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    got = C.repair_report(df).collect()
    assert len(got) == 400 and all(r.cost == 0 and set(r.audit) == {"K"} for r in got)
    assert [len(r.audit) for r in got if r.conv_id == 0] == [3000]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_empty_table(spark, kind):
    df = spark.createDataFrame([], f"conv_id {kind}, turn bigint, role string, text string")
    assert C.repair_report(df).collect() == [] and C.repaired_turns(df).collect() == []
