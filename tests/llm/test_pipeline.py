"""The corpus pipeline against a brute-force version of its five stages."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from pagemill.llm.queries import tokenizer
from tests.llm.test_arrow import brute_components, library, BYTE
from tests.llm.test_native import brute_lines, brute_measures

GOOD = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def texts():
    passage = "\n".join(f"this line number {k} stands in a passage that several documents share" for k in range(5))
    item = " ".join(f"item{k}" for k in range(24))
    out = [f"{GOOD} number {i}\n{' '.join(f'w{i}x{k}' for k in range(i % 60))}" for i in range(40)]
    out += [f"first {i} own words here and more of them in a row\n{passage}\nlast {i}" for i in range(4)]
    near = " ".join(f"n{k}" for k in range(80))
    out += [near, near.replace("n7 ", "m7 "), near, f"{near} more", None, "", "too few words", "again and again " * 20]
    out += [f"before it {item} and after it", f"{item[:100]} but not the whole of it here", "long " + " ".join(f"l{k}" for k in range(3000))]
    return out, item


def test_stages(spark, docs_of, tmp_path):
    bodies, item = texts()
    docs = docs_of(list(enumerate(bodies)))
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")

    kept = [(i, t) for i, t in enumerate(bodies) if not brute_measures(t)[-1]]  # 20 labels learn nothing
    lined = brute_lines(kept)
    kept = [(i, lined[i]) for i, t in kept if lined[i] == t or lined[i].split()]
    kept = [(i, t) for (i, t), c in zip(kept, brute_components(kept)) if c[1] == 0 or c[2] == i]
    grams = lambda t: {tuple(w[k : k + 5]) for w in [(t or "").lower().split()] for k in range(len(w) - 4)}
    want_item = grams(item)
    kept = [(i, t) for i, t in kept if 100 * len(want_item & grams(t)) < 80 * len(want_item)]

    now = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stored(stage(spark, now, folder), "stage")
        assert now.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted(kept)

    rows = corpus_pipeline.run(spark, folder).collect()
    pieces, tok = defaultdict(list), library(BYTE)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == {i for i, _ in kept}
    for i, t in kept:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        for r in own:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert sum(r.length for r in own) == len(ids)
    rooms = defaultdict(list)
    for r in rows:
        rooms[r.sequence_id].append((r.offset, r.length))
    for parts in rooms.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024
    assert tokenizer(BYTE)


def test_empty_documents(spark, docs_of, tmp_path):
    folder = str(tmp_path)
    docs = docs_of([(1, "x")]).limit(0).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


@pytest.mark.parametrize("extra", ["_id", "_hash"])
def test_stage_with_clashing_columns(spark, docs_of, tmp_path, extra):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = docs_of([(1, "a b c d e f"), (2, "other")])
    assert extra in docs.columns
    assert [r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, folder).collect()] == [2]


def test_measure_names_in_documents_stay(spark, docs_of, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = docs_of([(1, GOOD), (2, "too few"), (None, GOOD), (3, None), (3, GOOD), (3, GOOD)])
    assert "n_words" in docs.columns
    rows = corpus_pipeline.quality(spark, docs, folder)
    assert rows.columns == docs.columns
    given = {(r.doc_id, r.text): r for r in docs.collect()}
    got = rows.collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, 1, 3, 3]
    assert all(r == given[(r.doc_id, r.text)] for r in got)


def test_expressions_of_a_stage_are_not_copied(spark, tmp_path):
    """A filter pushed into copies of an expression made the first stage run for hours."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plan = stage(spark, docs, folder)._jdf.queryExecution().optimizedPlan().toString()
        for word in ("regexp_extract_all", "xxhash64", "split("):
            assert plan.count(word) <= 24, (name, word, plan.count(word))
