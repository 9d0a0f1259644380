"""Operators with Arrow batches: brute force, round trips and edge cases."""

import heapq
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import components, hashing, host_suffixes, huffman, packing, page_blocks, partenum, suffix_tree
from pagemill.llm.queries import tokenizer
from pagemill.llm.storage import stored
from pagemill.llm.tokens import Encoder

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
ODD = ["", " ", "a  b", "x\n\n y \n", "tab\tz\r\nq", "don't STOP, we'll go!! (yes)…", "é è ﬀ İstanbul ΣΑΣ", "a \n\nb", "é ́x",
       "日本語 テキスト", "\0 a", "x  ", "wait... what?!,,, ok", "²³ ½a", "<|endoftext|> a<|endoftext|>b", "U.S.A. \x1c z",
       "long " * 3000]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name))


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_tokens_equal_the_library(name):
    whole, ours = library(name), Encoder(tokenizer(name))
    for _ in range(2):
        for text, ids in zip(ODD, ours.ids(ODD)):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_hashes_follow_words():
    texts = pa.array([None, "", "A b\tA", "b", "xA b", "a\x0bb", "é É", " lead trail "])
    seen = {}
    for _, _, data, offsets in hashing.slices(texts, 8):
        hashes, at = hashing.words(data, offsets, True)
        for i in range(len(offsets) - 1):
            words = bytes(data[offsets[i] : offsets[i + 1]]).lower().split()
            got = hashes[at[i] : at[i + 1]].tolist()
            assert len(words) == len(got)
            for w, h in zip(words, got):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) == 7
    sets = list(hashing.shingle_sets(pa.array([None, "a b", "A  B", "a b c d e f", "b a"])))
    assert [len(s) for s in sets] == [0, 1, 1, 2, 1] and sets[1] == sets[2] and sets[1] != sets[4]


# --- near duplicates


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(pairs):
    sets = [grams(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and both:
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (doc, _) in enumerate(pairs):
        low[find(i)].append(doc)
    return [(d, len(s), min((x for x in low[find(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(pairs, sets))]


def varied(seed):
    """Chains of near copies, copies, texts that share a long passage, short texts."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("ijklmnop") + r.choice("qrstuvw")
    passage = [word() for _ in range(60)]
    texts = []
    for size in (6, 9, 15, 24, 40, 80, 200):
        base = [word() for _ in range(size)]
        for k in range(6):
            texts.append(" ".join(base))
            base = list(base)
            base[(k * 7) % size] = word()  # drifts away step by step
        at = r.randrange(size)
        texts.append(" ".join(base[:at] + passage + base[at:]))
    texts += [" ".join([word() for _ in range(12)] + passage) for _ in range(12)]
    texts += ["", None, " ", "one", "one", "ONE two", "one two", "a b c d", "a b c d e", "a b c d e"] + [texts[3]] * 4
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_partenum_loses_no_link(docs_of, seed):
    pairs = list(enumerate(varied(seed)))
    random.Random(seed).shuffle(pairs)
    rows = partenum.near_duplicates(docs_of(pairs)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == sorted(brute_components(pairs))
    first = Counter(r.component_id for r in rows if r.is_first and r.n_shingles)
    assert set(first.values()) == {1} and set(first) == {r.component_id for r in rows if r.n_shingles}


def test_partenum_null_and_repeated_ids(docs_of):
    text = "a b c d e f g h i j k"
    rows = partenum.near_duplicates(docs_of([(None, text), (5, text), (5, text), (5, "other words than these here"), (None, "alone")])).collect()
    got = Counter((r.doc_id, r.component_id) for r in rows)
    assert got == Counter({(None, 5): 1, (5, 5): 3, (None, None): 1})
    assert partenum.near_duplicates(docs_of([(1, "a")]).limit(0)).count() == 0


def test_signatures_of_similar_sets_meet():
    r = np.random.default_rng(3)
    none = np.zeros(0, np.uint64)
    for n in [*range(1, 40), 63, 100, 255, 700]:
        for _ in range(8):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            drop = r.integers(0, n // 9 + 1)
            add = r.integers(0, 2**63, r.integers(0, n // 9 + 1)).astype(np.uint64)
            b = np.unique(np.concatenate([r.permutation(a)[drop:], add]))
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                common = np.sort(r.permutation(a)[: n // 3]) if r.random() < 0.5 else none
                assert len(np.intersect1d(partenum.signatures(a, common), partenum.signatures(b, common)))


def test_partenum_makes_no_row_for_a_pair_that_is_no_link():
    """Many sets about the threshold: sketches pass most pairs, links are fewer than nodes."""
    r = np.random.default_rng(3)
    base = np.unique(r.integers(1, 1 << 62, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[:170], r.integers(1, 1 << 62, 30, dtype=np.uint64)])) for _ in range(60)]
    sets += [np.append(sets[0][:-1], np.uint64(1 << 63)), np.append(sets[0][:-2], np.uint64(1 << 63))]
    table = pa.table({
        "sig": pa.array([7] * 62), "i": pa.array([0] * 62, pa.int32()), "j": pa.array([0] * 62, pa.int32()),
        "block": pa.array([0] * 62, pa.int32()), "node": pa.array(range(62)), "component": pa.array(range(62)),
        "n": pa.array([len(s) for s in sets]), "sketch": pa.array([partenum.sketch_of(s) for s in sets]),
        "set": pa.array([np.sort(s).astype(np.int64).tolist() for s in sets], pa.list_(pa.int64()))})
    rows = table.to_batches(max_chunksize=7)
    doubtful = list(partenum._doubtful(iter(b.drop_columns(["set"]) for b in rows)))
    assert 3 <= sum(b.num_rows for b in doubtful) <= 62
    links = [(u, v) for b in partenum._verified(iter(rows)) for u, v in zip(*(c.to_pylist() for c in b.columns))]
    close = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    assert all(close(sets[u], sets[v]) for u, v in links) and len(links) < 62
    root = list(range(62))
    for u, v in links:
        root = [root[u] if x == root[v] else x for x in root]
    assert all(root[a] == root[b] for a in range(62) for b in range(a) if close(sets[a], sets[b]))


def test_partenum_compares_buckets_of_the_same_nodes_once(spark):
    """Similar texts share many signatures; buckets of other nodes stay."""
    rows = [(sig, node, node) for sig in range(40) for node in (5, 6, 7)] + [(50, 5, 5), (50, 6, 6), (60, 6, 6), (60, 7, 7), (70, 5, 5), (70, 7, 5)]
    got = partenum._once(spark.createDataFrame(rows, "sig bigint, node bigint, component bigint")).collect()
    assert sorted((r.sig, r.size) for r in got) == [(0, 3), (50, 2), (60, 2)]


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)]
    edges += [(1000, 1001 + i) for i in range(50)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in root}


# --- packing


def test_best_fit_decreasing_equals_the_plain_loop():
    r = random.Random(1)
    for _ in range(150):
        cap = r.choice([10, 37, 64])
        items = [r.randint(1, cap) for _ in range(r.randint(0, 200))]
        plain = []
        for n in sorted(items, reverse=True):
            fits = [(room, i) for i, room in enumerate(plain) if room >= n]
            if fits:
                plain[min(fits)[1]] -= n
            else:
                plain.append(cap - n)
        runs = packing.best_fit_decreasing(Counter(items), cap)
        room, taken = [cap] * runs.total, set()
        for n, many in Counter(items).items():
            for s, o in zip(*(x.tolist() for x in runs.place(n, np.arange(many)))):
                room[s] -= n
                assert not taken & {(s, k) for k in range(o, o + n)}
                taken |= {(s, k) for k in range(o, o + n)}
        assert sorted(room) == sorted(plain)


def test_packing(docs_of):
    texts = [None, "", "a b c", "word " * 2500, "x " * 63, "y " * 31, "", *ODD]
    docs = docs_of([(i % 20, t) for i, t in enumerate(texts)])
    made = stored(packing.pieces(docs, tokenizer(BYTE), 64), "pieces")
    placed = packing.pack(made, 64)
    rows = placed.collect()
    whole = Counter()
    for r in made.select("doc_id", "piece", "length", "ids").collect():
        assert len(r.ids) == 4 * r.length
    tok = library(BYTE)
    want = Counter(i % 20 for i, t in enumerate(texts) for _ in range(-(-(len(tok.encode(t or "").ids) + 1) // 64)))
    for r in rows:
        whole[r.doc_id] += 1
        assert r.length == 64 or r.piece == 0
    assert whole == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    total = sum(r.length for r in rows)
    assert len(by) <= 1.1 * total / 64 + 2
    ids = {r.sequence_id: r.ids for r in packing.sequences(made, placed).collect()}
    for s, parts in by.items():
        end = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
            assert zlib.crc32(ids[s][4 * r.offset : 4 * end]) == r.ids_crc32
        assert end <= 64 and len(ids[s]) == 4 * end
    empty = stored(packing.pieces(docs.limit(0), tokenizer(BYTE), 64), "pieces")
    assert packing.pack(empty, 64).count() == 0


# --- Huffman


def test_code_lengths_are_optimal():
    r = random.Random(2)
    for _ in range(60):
        counts = [r.choice([1, 2, 5, 100, 10**6]) * r.randint(1, 9) for _ in range(r.randint(2, 60))]
        lengths = huffman.code_lengths(np.array(counts), 40)
        heap = list(counts)
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert (2.0**-lengths).sum() == 1 and (lengths * counts).sum() == cost
        short = huffman.code_lengths(np.array(counts), 7)
        assert short.max() <= 7 and (2.0**-short).sum() <= 1 and (short * counts).sum() >= cost


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 4000, 70000])
def test_blocks_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.sort(r.choice(50000, 900, replace=False))
    weight = r.zipf(1.2, 900).astype(float)
    book = huffman.Codebook(ids, huffman.code_lengths(weight))
    data = r.choice(ids, n, p=weight / weight.sum())
    payload, points = book.encode(data)
    assert (book.decode(payload, points, n) == data).all()
    one = huffman.Codebook(np.array([7]), huffman.code_lengths(np.array([5])))
    assert (one.decode(*one.encode(np.full(n, 7)), n) == 7).all()


def test_huffman_files(docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(huffman, "PART", 2000)
    texts = [*ODD, None, *[f"word{i} some more {i % 7}" for i in range(300)]]
    pairs = [(None if i == 3 else (i * 37) % 251, t) for i, t in enumerate(texts)]
    docs, path = docs_of(pairs), str(tmp_path / "out")
    huffman.write(docs, path, tokenizer(WORD))
    got = huffman.read(docs.sparkSession, path).collect()
    tok = library(WORD)
    want = Counter((d, bytes(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))) for d, t in pairs)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    at = 0
    order = sorted(got, key=lambda r: r.start)
    for r in order:
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)
    spark = docs.sparkSession
    assert spark.read.parquet(f"{path}/blocks").select("part").distinct().count() > 1
    huffman.write(docs.limit(0), path + "0", tokenizer(WORD))
    assert huffman.read(spark, path + "0").count() == 0


# --- suffix tree


def test_suffix_tree(docs_of):
    r = random.Random(4)
    line = "the cat sat on the mat and the dog ran off".split()
    texts = [" ".join(line[: r.randint(3, 11)] + [r.choice("xyz")]) for _ in range(200)] + [None, "", "Never seen words", "THE cat"]
    pairs = list(enumerate(texts))
    rows = suffix_tree.score(docs_of(pairs)).collect()
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in pairs}
    out = {i for i, _ in pairs if zlib.crc32(str(i).encode()) % 10 == 0}
    c = Counter(w for i in tokens if i not in out for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for x in rows:
        t = tokens[x.doc_id]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (x.doc_id in out, len(t), sum(c[w] > 0 for w in t), n)
        assert x.base_score == pytest.approx(base) and x.score <= 0
    held = [x for x in rows if x.held_out and x.doc_id < 200]
    assert sum(x.score for x in held) > sum(x.base_score for x in held) + len(held)
    blocks = {x.doc_id: x for x in suffix_tree.score(docs_of(pairs), max_words=0).collect()}
    assert len(blocks) == len(pairs) and all(blocks[x.doc_id].score == pytest.approx(x.score) for x in rows)


def test_suffix_tree_states_sum_to_one(docs_of):
    r = random.Random(8)
    texts = [" ".join(r.choice(["a b c", "b c d", "c", "d a"]) for _ in range(8)) for _ in range(120)]
    docs = docs_of(list(enumerate(texts)))
    words = stored(suffix_tree.count_words(docs.select("text")), "words")
    tree = suffix_tree.grow(docs.select("text"), words, suffix_tree.Shape(divergence=1.0))
    assert len(tree.levels) == 3 and all(len(x.context) for x in tree.levels[:2])
    known, counts = suffix_tree._ordered(words.toArrow())
    past = list(suffix_tree.sequences(pa.array(["a b c"])))[0][0][:-1]
    every = np.append(known, np.uint64(99))  # and an unknown word
    total = 0.0
    for w in every:
        tokens = np.append(past, w)
        there, at = suffix_tree.found(known, tokens)
        base = tree.base(np.where(there, counts[at], 0))
        total += tree.score(tokens, np.array([0, len(tokens)]), base)[-1]
    assert total == pytest.approx(1.0)


def plain_scores(pairs, branch, of=None, depth=3, divergence=10.0):
    """Scores by a tree in dictionaries, with every context and next word that occurs twice."""
    split = {i: ["<s>", *(t or "").lower().split(), "</s>"] for i, t in pairs}
    count, words = {}, Counter()
    for i, t in split.items():
        if zlib.crc32(str(i).encode()) % 10:
            for k in range(1, len(t)):
                words[t[k]] += 1
                for d in range(1, min(depth, k) + 1):
                    count.setdefault(tuple(t[k - d : k]), Counter())[t[k]] += 1
    total = sum(words.values())
    base = lambda w: (words[w] + 0.1) / (total + 0.1 * (len(words) + 1))
    keep = set()
    for c, after in count.items():
        size, up = sum(after.values()), count.get(c[1:])
        q = (lambda w: up[w] / sum(up.values())) if len(c) > 1 else (lambda w: min(base(w), 1.0))
        held = [w for w in after if after[w] >= 2]
        gain = sum(after[w] / size * math.log(after[w] / size / q(w)) for w in held)
        rest = 1 - sum(after[w] for w in held) / size
        if rest > 1e-12:
            gain += rest * math.log(rest / max(1 - sum(q(w) for w in held), 1e-12))
        if gain * size >= divergence or size > branch:
            keep |= {c[k:] for k in range(len(c))}
    out = {}
    for i, t in split.items():
        if of is not None and i not in of:
            continue
        out[i] = 0.0
        for k in range(1, len(t)):
            p = base(t[k])
            for d in range(1, min(depth, k) + 1):
                after = count.get(c := tuple(t[k - d : k]), Counter())
                if c not in keep:
                    break
                size = sum(after.values())
                held = [w for w in after if after[w] >= 2]
                own = (after[t[k]] - 0.5) / size if t[k] in held else 0.0
                p = own + (1 - sum(after[w] - 0.5 for w in held) / size) * p
            out[i] += math.log10(p)
    return out


@pytest.mark.parametrize("branch, max_words", [(1 << 40, 1 << 20), (800_000, 0)])
def test_suffix_tree_keeps_rare_contexts_of_a_large_corpus(docs_of, branch, max_words):
    """A passage that occurs twice among more tokens than any share of them would keep
    is learnt, however branches are dealt."""
    r = random.Random(9)
    some = [f"w{int(r.paretovariate(0.7))}" for _ in range(60)]
    texts = [" ".join(r.choice(some) if r.random() < 0.7 else "of the" for _ in range(60)) for _ in range(300)]
    texts += ["of the " * 30000] * 60
    rare = " ".join(f"rare{k}" for k in range(30))
    texts += [rare, rare, rare, None, "", "never seen words"]
    pairs = [(i * 10 + 3, t) for i, t in enumerate(texts)]
    rows = {x.doc_id: x for x in suffix_tree.score(docs_of(pairs), max_words=max_words, branch=branch).collect()}
    assert len(rows) == len(pairs) and rows[pairs[0][0]].train_tokens > 2.5e6
    short = {i for i, t in pairs if len(t or "") < 1000}
    want = plain_scores(pairs, branch, short)
    for i in short:
        assert rows[i].score == pytest.approx(want[i], rel=1e-9)
    learnt = [rows[i] for i, t in pairs if t == rare]
    assert all(x.score > x.base_score + 60 for x in learnt)


@pytest.mark.parametrize("branch", [300, 40])
def test_suffix_tree_branches_dealt_by_longer_contexts(docs_of, branch):
    """Heavy contexts of every depth are whole, wherever their tokens are."""
    r = random.Random(5)
    line = "the cat sat on the mat and the dog ran off to see".split()
    texts = [" ".join(line[: r.randint(3, 13)] + [r.choice("xyz")]) for _ in range(300)] + ["the cat sat on " * 20] * 9 + [None, ""]
    pairs = list(enumerate(texts))
    want = plain_scores(pairs, branch)
    for max_words in (1 << 20, 0):
        rows = suffix_tree.score(docs_of(pairs), max_words=max_words, branch=branch).collect()
        assert len(rows) == len(pairs)
        for x in rows:
            assert x.score == pytest.approx(want[x.doc_id], rel=1e-9)


def test_suffix_tree_sends_next_words_to_few_parts(docs_of, monkeypatch):
    """Twigs of a heavy context share parts, which get its next words once; parts have
    about as many tokens each. Scores do not depend on the parts."""
    r = random.Random(6)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(300)]
    pairs = [(i, " ".join(r.choice(["the"] + words) if k % 2 else "the" for k in range(40))) for i in range(150)]
    want = {x.doc_id: x.score for x in suffix_tree.score(docs_of(pairs), branch=60).collect()}
    monkeypatch.setattr(suffix_tree, "PART", 600)
    docs = docs_of(pairs)
    got = {x.doc_id: x.score for x in suffix_tree.score(docs, branch=60).collect()}
    assert got == pytest.approx(want, rel=1e-9)
    every = docs.select("doc_id", F.lit(False).alias("held_out"), "text")
    corpus = suffix_tree.Corpus(every, stored(suffix_tree.count_words(every.select("text")), "words"), suffix_tree.Shape(), 1 << 20)
    plan, given = suffix_tree.planned(corpus, 60)
    first = plan.heavy[0]
    top = int(np.argmax(first.size))
    rows = given.where((F.col("depth") == 1) & (F.col("context") == int(first.context[top].astype(np.int64)))).collect()
    words = {x.word for x in rows}
    # before, a row for each of its twigs; now for each part that has some of them or of longer contexts
    assert plan.parts > 5 and first.twigs[top] > 40 and len(rows) <= plan.parts * len(words)
    assert len(rows) == len({(x.part, x.word) for x in rows})
    of, ends = plan.part_of(), plan.ends()
    assert len(of) == len(ends) and set(of.tolist()) == set(range(plan.parts)) and (np.diff(of) >= 0).all()
    sizes = np.bincount(of, np.diff(ends, prepend=0))
    assert sizes.max() < 1.5 * ends[-1] / plan.parts + 60


def test_suffix_tree_packs_tokens_and_grows_pieces_of_twigs():
    """Dealt tokens come back as they were, in fewer bytes, and a twig is grown in pieces
    that have whole contexts."""
    r = np.random.default_rng(4)
    words = np.minimum(r.zipf(1.3, 20_000), 1 << 20).astype(np.int32)
    columns = [words, words[::-1].copy(), r.integers(-500, 500, len(words)).astype(np.int16)]
    twigs, sizes = np.array([3, 1 << 40], np.int64), np.array([7, len(words) - 7], np.int64)
    blob = suffix_tree.packed(columns, twigs, sizes)
    assert len(blob) < 0.7 * sum(c.nbytes for c in columns)
    got = suffix_tree.unpacked(blob, len(words), 2, [np.int32, np.int32, np.int16])
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip([*got[:2], *got[2]], [twigs, sizes, *columns]))
    plan = suffix_tree.Plan(1, 2, [])
    pieces = plan.deal([words, words[::-1].copy()], np.zeros(len(words), np.int64), 0)
    assert len(set(pieces.tolist())) == 2 * suffix_tree.FINER
    assert len(set(zip(words.tolist(), pieces.tolist()))) == len(set(words.tolist()))


def test_suffix_tree_reads_a_part_without_a_copy_and_keeps_counts_narrow():
    columns = [np.arange(6, dtype=np.int32)] * 4 + [np.zeros(6, np.int16)]
    blob = suffix_tree.packed(columns, np.array([5, 7], np.int64), np.array([2, 4], np.int64))
    about = {"packed": None, "n_tokens_dealt": None, "n_twigs": None}  # a row about texts
    table = pa.Table.from_pylist([about, {"packed": blob, "n_tokens_dealt": 6, "n_twigs": 2}, about],
                                 pa.schema([("packed", pa.binary()), ("n_tokens_dealt", pa.int64()), ("n_twigs", pa.int64())]))
    got = {twig: (tokens[0].tolist(), row.tolist()) for twig, tokens, row in suffix_tree._twigs(table, 3, True)}
    assert got == {5: ([0, 1], [1, 1]), 7: ([2, 3, 4, 5], [1] * 4)}
    lookup = suffix_tree.Lookup.of(pa.table({"word": [3, 1, 2], "n": [70_000, 5, 9]}))
    assert lookup.n.tolist() == [5, 9, 70_000] and lookup.n.itemsize == 4 and lookup.number.tolist() == [2, 1, 0]
    assert (lookup.n + 0.1).dtype == np.float64
    assert len(suffix_tree.Lookup.of(pa.table({"word": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})).n) == 0


def test_suffix_tree_without_training_texts(docs_of):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = suffix_tree.score(docs_of([(i, "a b") for i in held] + [(None, None)])).collect()
    assert {(r.held_out, r.n_known, r.train_tokens, r.score) for r in rows} == {(True, 0, 0, 0.0)}
    assert suffix_tree.score(docs_of([(1, "a")]).limit(0)).count() == 0


# --- pages


PAGES = {
    "<p title=it's>one</p><ul><li>a</li><li>b</li></ul><p>don't stop</p>": ["one", "a", "b", "don't stop"],
    '<img alt="a"b">x<a href=/foo/>text</a>': ["xtext"],
    "<b <b <b": ["<b <b <b"],
    "a<!-- x": ["a"],
    "<script>if(a</b)</script>ok<style>q": ["ok"],
    "<table><tr><td>a<td><p>b<tr><td>c</table>d": ["a", "b", "c", "d"],
    "<p>1 < 2 &amp;&nbsp; <b>bo</b>ld</p>": ["1 < 2 & bold"],
    "": [],
}


@pytest.mark.parametrize("page", PAGES)
def test_blocks(page):
    assert [t for _, t in page_blocks.blocks(page)] == PAGES[page]


def test_kinds():
    page = ("<body class=has-sidebar><nav>m</nav><div class='ad-box'>ad</div><article><header><h1>T</h1></header><p>x<aside>s</aside>"
            "<div id=comments>c</div><p>y</article><div class='site-footer'>f</div><form>q</form>n</body>")
    assert page_blocks.blocks(page) == [(0, "m"), (0, "ad"), (2, "T"), (2, "x"), (0, "s"), (0, "c"), (2, "y"), (0, "f"), (0, "q"), (1, "n")]


def test_repeated_runs():
    r = random.Random(6)
    for _ in range(150):
        pages = [[r.randint(0, 3) for _ in range(r.randint(0, 25))] for _ in range(r.randint(1, 5))]
        run = r.choice([2, 3, 5, 8])
        where = defaultdict(set)
        for i, p in enumerate(pages):
            for a in range(len(p) - run + 1):
                where[tuple(p[a : a + run])].add(i)
        want = []
        for p in pages:
            own = [False] * len(p)
            for a in range(len(p) - run + 1):
                if len(where[tuple(p[a : a + run])]) > 1:
                    own[a : a + run] = [True] * run
            want += own
        words = np.array([w for p in pages for w in p], np.int64)
        got = host_suffixes.repeated(words, np.repeat(np.arange(len(pages)), [len(p) for p in pages]), run)
        assert got.tolist() == want


def test_pages(spark):
    notice = "<div>all rights are reserved here by the owners of this very site</div>"
    article = "<nav>menu</nav>" + notice + "<article><p>the same article stands on two pages of this host today</article>"
    rows = [
        (1, "http://h.org/1", article), (2, "http://h.org/2", article), (3, "http://h.org/3", notice + "<div>one of a kind</div>"),
        (4, "http://i.org/4", notice + "<p>x"), (5, None, None), (6, None, ""), (7, "http://c.org/a", "<p>a copy of a page that has no article at all"),
        (8, "http://c.org/b", "<p>a copy of a page that has no article at all"), (9, "bad", "<p>plain"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1))
    for size in (host_suffixes.GROUP_BYTES, 250):
        got = {r.page_id: r.text for r in host_suffixes.extract(pages, group_bytes=size).collect()}
        assert got[1] == got[2] == "the same article stands on two pages of this host today"
        assert got[4].endswith("site x") and got[5] == got[6] == "" and got[9] == "plain"
        assert got[7] == got[8] == "a copy of a page that has no article at all"
        if size > 250:
            assert got[3] == "one of a kind"
    assert host_suffixes.extract(pages.limit(0)).count() == 0


def test_pages_do_not_depend_on_the_size_of_a_group(spark):
    r = random.Random(8)
    prose = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    notices = [prose(20) for _ in range(6)]
    rows, own = [], {}
    for i in range(120):
        # each notice stands on two pages, which a cut by page hash seldom leaves together
        own[i] = prose(40)
        rows.append((i, f"http://big.org/{i}", f"<div>{notices[i // 20] if i % 20 < 2 else prose(20)}</div><div>{own[i]}</div>"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    whole = {x.page_id: x.text for x in host_suffixes.extract(pages).collect()}
    assert all(whole[i] == own[i] for i in range(120) if i % 20 < 2)
    cut = {x.page_id: x.text for x in host_suffixes.extract(pages, group_bytes=1500).collect()}
    assert cut == whole


def test_groups_of_a_host_hand_on_little_for_runs_of_one_page():
    """Runs of all groups were rows of 40 bytes; these are compressed marks."""
    r = np.random.default_rng(3)
    pages = [" ".join(f"{w:x}" for w in r.integers(0, 1 << 40, 1000)) for _ in range(40)]
    group = host_suffixes.Group(pa.table({"page_key": range(40), "lines": pages}))
    bits = host_suffixes._mark_bits(5)
    marks = np.unique(group.hashes().view(np.uint64) >> np.uint64(64 - bits))
    own = pa.table({"host_id": [1], "grp": [2], "groups": [5]})
    rows = host_suffixes._to_ranges(own, marks, np.ones(len(marks), np.int64), bits=bits)
    assert rows.num_rows == 5 and rows.nbytes < 4 * len(marks)
    back, (n,), of = host_suffixes._read(rows, 1)
    assert (back == marks).all() and (n == 1).all() and rows.column("bucket").to_pylist() == sorted(set(of.tolist()))
    odd = np.array([0, 1, 1 << 63, (1 << 64) - 1], np.uint64)  # the ends of the hashes, and of the keys of pages
    keys = np.array([-(1 << 63), (1 << 63) - 1, 0, -(1 << 63)], np.int64)
    back, (got,), _ = host_suffixes._read(host_suffixes._to_ranges(own, odd, keys), 1)
    assert back.tolist() == odd.tolist() and got.tolist() == keys.tolist()


@pytest.mark.parametrize("seed", [1, 2])
def test_cut_hosts_give_what_whole_ones_give(spark, seed):
    """Copies, equal rows, notices of some pages, pages without words or url, two large hosts."""
    r = random.Random(seed)
    prose = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    notices, bodies, rows = [prose(r.randrange(5, 30)) for _ in range(8)], [prose(r.randrange(60)) for _ in range(40)], []
    for i in range(150):
        body = r.choice(bodies) if r.random() < 0.5 else prose(r.randrange(60))
        parts = [f"<div>{x}</div>" for x in [*r.sample(notices, r.randrange(3)), body, prose(r.randrange(9))]]
        r.shuffle(parts)
        rows.append((i, r.choice([None, f"http://a.org/{i}", f"http://b.org/{i}"]), r.choice(["", "<article>x y</article>"]) + "".join(parts)))
    rows += rows[:20]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = [sorted(map(str, host_suffixes.extract(pages, group_bytes=size).collect())) for size in (1 << 20, 700, 4000)]
    assert got[0] == got[1] == got[2]


def test_a_group_of_a_large_host_takes_little_memory():
    r = np.random.default_rng(8)
    line = "".join(f"{w:04x} " for w in r.integers(0, 1 << 16, host_suffixes.GROUP_BYTES // 5 // 100)).strip()
    table = pa.table({"page_key": pa.array(range(100)), "kinds": pa.array([bytes([page_blocks.CONTENT])] * 100, pa.binary()), "lines": [line] * 100})
    tracemalloc.start()
    group = host_suffixes._group(table)
    assert len(group.hashes()) and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_copies_with_a_line_of_their_own_stay_and_notices_go(spark):
    r = random.Random(9)
    prose = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    notice, articles = prose(30), [prose(80) for _ in range(12)]
    rows = [(i, f"http://h.org/{i}", f"<div>{notice}</div><div>{articles[i]}</div>") for i in range(12)]
    rows += [(100 + i, f"http://h.org/print/{i}", f"<p>printed on day {i} of may</p><div>{articles[i]}</div><p>{notice}") for i in range(6)]
    # the notice within a block of the article: its words go, not the block
    inside = prose(50)
    rows.append((200, "http://h.org/inside", f"<div>{inside} {notice} {inside[::-1]}</div>"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for size in (host_suffixes.GROUP_BYTES, 1500):
        got = {x.page_id: x.text for x in host_suffixes.extract(pages, group_bytes=size).collect()}
        assert all(got[i] == articles[i] for i in range(12))
        assert all(got[100 + i] == f"printed on day {i} of may {articles[i]}" for i in range(6))
        assert got[200] == f"{inside} {inside[::-1]}"


def test_body_beside_a_card_stays(spark):
    r = random.Random(10)
    prose = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    card, bodies, cards = prose(12), [prose(60) for _ in range(4)], [prose(9) for _ in range(4)]
    rows = [(i, f"http://h.org/{i}", f"<div>{bodies[i]}</div><article>{card}</article>") for i in range(3)]
    rows += [(3, "http://h.org/3", f"<div>{bodies[3]}</div><article>{cards[3]}</article>")]
    rows += [(4, "http://h.org/4", f"<div>{cards[0]}</div><article>{cards[1]} {card}</article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for size in (host_suffixes.GROUP_BYTES, 500):
        got = {x.page_id: x.text for x in host_suffixes.extract(pages, group_bytes=size).collect()}
        assert all(got[i] == bodies[i] for i in range(3))  # the card repeats on other pages
        assert got[3] == f"{bodies[3]} {cards[3]}"
        assert got[4] == f"{cards[1]} {card}"  # the article is the text


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_every_latin_letter_with_marks(name):
    """Cut before its marks a letter must give the ids that it gives with them."""
    parts = [(a, chr(c), m, b) for c in range(0x41, 0x250) if chr(c).isalpha() for a in ("", "ka", " x ")
             for m in [*".,!?;:", "", "..", "!?"] for b in ("", "x", " end")]
    texts = ["".join(p) for p in parts]
    tok = library(name)
    for text, ids in zip(texts, Encoder.of(tokenizer(name)).ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)
