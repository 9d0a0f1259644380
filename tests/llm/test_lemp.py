"""Hard negatives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import lemp as L

SCHEMA = "vec_id bigint, label int, vector array<bigint>, rank int, row string, `grp` int"


def brute(rows, anchor, n_positives=5, n_negatives=10, low=30, high=90):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or None in v:
            continue
        best[i] = min(best.get(i, (label, v)), (label, v))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (la, va) in best.items():
        if not anchor(a):
            continue
        scores = sorted((-score(va, v), i, label) for i, (label, v) in best.items() if i != a)
        for ps, p, _ in [s for s in scores if s[2] == la][:n_positives]:
            fit = [(s, i) for s, i, label in scores if label != la and low * -ps <= 100 * -s <= high * -ps]
            out += [(a, p, k + 1, i, -ps, -s) for k, (s, i) in enumerate(fit[:n_negatives])]
    return sorted(out)


def found(spark, rows, parts=4, every=10, **kw):
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in L.hard_negatives(df, F.col("vec_id") % every == 0, **kw).collect())


def test_random_clusters_copies_and_ties(spark, monkeypatch):
    draw = np.random.default_rng(5)
    centers = draw.normal(size=(6, 16)) * 40
    rows = []
    for i in range(900):
        v = np.floor(centers[i % 6] * draw.uniform(0.2, 2) + draw.normal(size=16) * 15).astype(int).tolist()
        rows.append((i, int(draw.integers(0, 4)), v))
    rows += [(1000 + i, i % 2, rows[3][2]) for i in range(200)]  # one vector held by many
    rows += [(2000 + i, i % 3, [0] * 16) for i in range(5)]
    assert found(spark, rows, low=10, high=95) == brute(rows, lambda i: i % 10 == 0, low=10, high=95)
    assert found(spark, rows, 2, 25, n_positives=2, n_negatives=3) == brute(rows, lambda i: i % 25 == 0, 2, 3)


def test_pruning_loses_nothing_and_prunes():
    draw = np.random.default_rng(1)
    axis = np.eye(8) * 100
    vectors = np.floor(axis[np.arange(400) % 8] + draw.normal(size=(400, 8)) * 6).astype(np.int64)
    row = {"n": 400, "dim": 8, "width": 2, "ids": np.arange(400).tobytes(), "labels": np.zeros(400, "<i8").tobytes(),
           "vectors": vectors.astype("<i2").tobytes(), "lists": np.argsort(L._unit(vectors), axis=0).T.astype("<u2").tobytes()}
    bucket = L.Bucket(row)
    for a in range(20):
        anchor = L.Anchor(a, 0, vectors[a], L.ALL)
        exact = vectors @ vectors[a]
        for least in (-20000, 0, 1, 5000, 9000, 11000, int(exact.max())):
            kept = np.arange(400)[bucket.candidates(anchor, least)]
            assert set(np.flatnonzero(exact >= least)) <= set(kept)
        assert len(np.arange(400)[bucket.candidates(anchor, 9000)]) < 100
        assert len(np.arange(400)[bucket.candidates(anchor, 30000)]) == 0


def test_edge_cases(spark):
    big = 2**30
    rows = [
        (0, 1, [1, 2]), (0, 0, [5]), (0, 0, [5]), (10, 0, [3, 0, 0, 9]), (11, 0, [4]), (12, 1, [3]), (13, 2, [2, 2, 2]), (14, None, [9]),
        (15, 1, None), (16, 1, [1, None]), (None, 1, [4]), (17, 1, []), (18, 0, [-9, -9]), (20, 3, [1]), (30, 0, [big, -big]), (31, 0, [big, -big]),
        (32, 2, [big // 2, -big // 2]),
    ]
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert found(spark, rows, low=0, high=100) == brute(rows, lambda i: i % 10 == 0, low=0, high=100)


def test_no_rows_and_no_anchors(spark):
    assert found(spark, [(1, 1, [1]), (2, 1, [2])]) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert L.hard_negatives(empty, F.col("vec_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("block", [3, 4096])
def test_blocks_do_not_change_results(spark, monkeypatch, block):
    monkeypatch.setattr(L, "ANCHORS", block)
    draw = random.Random(2)
    rows = [(i, draw.randint(0, 2), [draw.randint(-50, 50) for _ in range(6)]) for i in range(300)]
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0)
