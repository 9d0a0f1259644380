"""Operators in built-in functions: laws and edge cases."""

import datetime
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.llm import containment, line_windows, quality_rules, shuffling, url_lists

LONG = " ".join(f"w{i}" for i in range(30000))


# --- line windows


def brute_lines(pairs):
    seen, out = set(), {}
    for doc, text in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0)):
        if text is None:
            out[doc] = None
            continue
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if any(x.split() for x in w):
                if w in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(w)
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_windows(docs_of):
    block = "a b\nc d\ne f\ng h"
    pairs = [
        (1, f"x\n{block}\ny"), (2, f"{block}\nz"), (3, block), (4, None), (5, ""), (6, "a b\nc d"), (7, "\n\n\n\n"),
        (8, "\n\n\n\n"), (9, "q\nq\nq\nq\nq\nq"), (None, "n\nn2\nn3"), (10, "n\nn2\nn3\nn4"), (11, LONG + "\nb\nc\n" + LONG),
        (12, f"{block}\nmid\n{block}\nc d\ne f"),
    ]
    out = line_windows.drop_repeated_lines(docs_of(pairs))
    assert out.columns[-2:] == ["n_lines", "n_removed"]
    rows = out.collect()
    assert {r.doc_id: r.text for r in rows} == brute_lines(pairs)
    by = {r.doc_id: r for r in rows}
    assert (by[4].n_lines, by[4].n_removed, by[3].n_lines, by[3].n_removed) == (0, 0, 4, 4)
    assert by[1]._id == "x" and by[1].n_words == 1


def test_line_windows_repeated_rows_and_empty(docs_of):
    rows = line_windows.drop_repeated_lines(docs_of([(1, "a\nb\nc")] * 3 + [(1, "a\nb\nc\nd")])).collect()
    assert Counter(r.text for r in rows) in (Counter({"a\nb\nc": 3, "d": 1}), Counter({"": 3, "a\nb\nc\nd": 1}))
    assert line_windows.drop_repeated_lines(docs_of([(1, "a")]).limit(0)).count() == 0


# --- quality rules


def brute_measures(text):
    text = text or ""
    words = text.split()
    lines = [x for x in text.split("\n") if x.split()]
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(wins)
    covered = {k for i, w in enumerate(wins) if many[w] > 1 for k in range(i, i + 5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def test_measures(docs_of):
    texts = [None, "", " \t ", "a b c d e f g h i j", "a b c d e a b c d e", "x " * 50, "A B# |é\nA B# |é\n\n", LONG,
             "p q r s t u p q r s t u p q r s t v w x y z", "one two three four five six seven eight nine"]
    rows = quality_rules.measure(docs_of(list(enumerate(texts)))).collect()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute_measures(texts[r.doc_id]), texts[r.doc_id]


def test_binomial_bound(spark):
    cases = [(k, n) for n in (1, 5, 40, 300, 5000, 10**7) for k in (0, 1, 3, n // 200, n // 130) if k <= n]
    df = spark.createDataFrame(cases, "k bigint, n bigint")
    p = 0.05 / 6
    for r in df.select("k", "n", quality_rules.binomial_cdf(F.col("k"), F.col("n"), p).alias("c")).collect():
        if r.k > r.n * p:
            assert r.c == 1.0
            continue
        terms = (math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(p)
                          + (r.n - i) * math.log1p(-p)) for i in range(r.k + 1))
        assert r.c == pytest.approx(min(1.0, math.fsum(terms)), rel=1e-6)


def test_cutoffs_hold_the_risk(spark, docs_of):
    good = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bad = "##alpha $$beta %%gamma ##delta &&epsilon zeta## eta%% theta$$ iota&& kappa** lambda## mu##"
    pairs = [(i, f"{good} {i}" if i % 4 else f"{bad} {i}") for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(2000)] + [(None, 1, 0), (5000, None, 0)],
                                   "doc_id bigint, quality int, toxic int")
    measured = quality_rules.measure(docs_of(pairs))
    cutoffs = quality_rules.learn(measured, labels, "lang")
    on = cutoffs.collect()
    assert any(r.rule == "symbols" for r in on) and all(r.rejected_good == 0 for r in on)
    rows = quality_rules.judge(measured, cutoffs, "lang").collect()
    assert all(r.kept == (r.doc_id % 4 > 0) for r in rows) and len(rows) == 3000
    few = labels.where("doc_id < 100")  # too few to guarantee anything
    assert quality_rules.learn(measured, few, "lang").count() == 0
    none = quality_rules.learn(measured, labels.limit(0), "lang")
    assert none.count() == 0 and quality_rules.judge(measured, none, "lang").where("kept").count() == 3000


# --- containment


def test_containment(spark, docs_of):
    item = " ".join(f"t{i}" for i in range(24))  # 20 shingles
    lose = lambda k: item.replace(f"t{k} ", "other ", 1)
    pairs = [
        (1, f"{LONG} {item} {LONG}"), (2, item.upper()), (3, "pre " + lose(0)), (4, lose(10)), (5, None), (6, ""),
        (7, " ".join(item.split()[:20])), (8, "say hello world now"), (9, "hello"), (10, item), (10, item), (10, "unlike"),
        (None, item),
    ]
    items = spark.createDataFrame([(1, item), (2, "Hello  world"), (3, None), (4, ""), (5, item), (6, "b " * 5)],
                                  "item_id bigint, text string")
    got = Counter((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in containment.contained_items(docs_of(pairs), items).collect())
    want = Counter()
    for doc, text in pairs:
        words = (text or "").lower().split()
        for k, body in ((1, item), (2, "hello world"), (5, item), (6, "b b b b b")):
            q = body.split()
            n = min(5, len(q))
            grams = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)}
            own = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
            if 100 * len(grams & own) >= 80 * len(grams):
                want[doc, k, len(grams), len(grams & own)] += 1
    assert got == want and (2, 1, 20, 20) in got and (4, 1, 20, 15) not in got and (8, 2, 1, 1) in got
    assert containment.contained_items(docs_of(pairs), items.limit(0)).count() == 0
    assert containment.contained_items(docs_of(pairs).limit(0), items).count() == 0


# --- sharding


def test_shuffle_is_a_balanced_permutation(docs_of):
    pairs = [(i % 50 if i % 7 else None, None if i % 11 == 0 else f"text {i % 60}" * (i % 5)) for i in range(403)]
    docs = docs_of(pairs)
    out = shuffling.shuffled(docs, shards=16, bucket_bytes=300).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(pairs)
    sizes = Counter(r.shard for r in out)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    few = shuffling.shuffled(docs_of([(i, "x") for i in range(3)]), shards=16).collect()
    assert len(few) == 3 and all(r.slot == 0 for r in few)
    assert shuffling.shuffled(docs.limit(0)).count() == 0


def test_shuffle_moves_rows(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    out = shuffling.shuffled(docs, shards=4, bucket_bytes=2000).collect()
    # a uniform permutation leaves every shard a quarter of any range of ids, about
    for s in range(4):
        low = sum(r.doc_id < 1000 for r in out if r.shard == s)
        assert 190 < low < 310


def test_shuffle_does_not_depend_on_the_session(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat(cast(id AS string), 1 + id % 9) AS text")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    seen = []
    try:
        for partitions, adaptive, given in (("8", "true", docs), ("3", "true", docs.repartition(5)), ("5", "false", docs.orderBy(F.desc("text")))):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            out = shuffling.shuffled(given, shards=4, bucket_bytes=2000)
            seen.append(sorted(tuple(r) for r in out.select("doc_id", "shard", "slot").collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert seen[0] == seen[1] == seen[2]


# --- dated lists


def at(hour):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour)


def test_url_lists(spark):
    entries = spark.createDataFrame(
        [(1, "block", False, "Example.com", True, at(10)), (2, "block", False, "example.com", False, at(50)),
         (3, "block", False, "example.com", True, at(51)), (4, "allow", True, "example.com/ok", True, at(0)),
         (5, "b2", False, "a.example.com/ok/x", True, at(20)), (6, "b2", False, "other.org", True, at(5)),
         (7, "b2", False, "other.org", False, at(5)), (8, "b3", None, "tie.net", True, at(1)), (9, "allow", True, "tie.net", True, at(1)),
         (10, None, False, "x.y", True, at(1)), (11, "b2", False, None, True, at(1)), (12, "b2", False, "z.z", None, at(1))],
        "entry_id bigint, list string, allow boolean, pattern string, added boolean, at timestamp")
    cases = [
        ("http://example.com/", 9, False), ("http://EXAMPLE.com:80/a?b", 10, True), ("https://u@www.example.com", 49, True),
        ("http://example.com/", 50, False), ("http://example.com/", 51, True), ("http://example.com/", 400, True),
        ("http://example.com/ok/1", 20, False), ("http://a.example.com/ok/x#f", 30, True), ("http://a.example.com//ok/xy", 30, False),
        ("http://notexample.com/", 30, False), ("http://other.org", 30, False), ("http://tie.net", 2, False),
        (None, 5, False), ("no url", 5, False), ("http://" + "d." * 50 + "example.com/" + "p/" * 2000, 60, True), ("http://example.com/", None, False),
        ("http://example.com/", 9, False),
    ]
    rows = [(i, u, None if h is None else at(h), "x") for i, (u, h, _) in enumerate(cases)]
    captures = spark.createDataFrame(rows, "page_id bigint, url string, fetched_at timestamp, pattern string")
    captures = captures.withColumn("_n", F.lit(1)).withColumn("_url", F.lit(2))
    out = url_lists.evaluate(captures, entries).collect()
    assert len(out) == len(cases)
    for r in out:
        assert r.blocked == cases[r.page_id][2], cases[r.page_id]
    by = {r.page_id: r for r in out}
    assert (by[7].n_active, by[7].decided_by, by[7].pattern) == (3, "b2", "a.example.com/ok/x")
    assert (by[4].since, by[11].decided_by, by[0].pattern) == (at(51), "allow", None)
    assert url_lists.evaluate(captures, entries.limit(0)).where("blocked").count() == 0
    assert url_lists.evaluate(captures.limit(0), entries).count() == 0
