"""Operators with one right answer, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate, jaccard, language_model, recurring, suffix_array, suffix_tree, topk
from tessera.llm import text_kernels as tk
from tessera.llm.repeats import Scheme


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def without(seqs, span):
    where = defaultdict(list)
    for d, s in enumerate(seqs):
        for i in range(len(s) - span + 1):
            where[tuple(s[i : i + span]) if isinstance(s, list) else s[i : i + span]].append((d, i))
    gone = [np.zeros(len(s), bool) for s in seqs]
    for at in where.values():
        if len(at) > 1:
            for d, i in at:
                gone[d][i : i + span] = True
    return gone


@pytest.mark.parametrize("hot", [4096, 1])
def test_words(docs, texts, hot):
    seqs = [words(t) for t in texts]
    gone = without(seqs, 35)
    got = {r["doc_id"]: r for r in suffix_tree.dedup(docs, scheme=Scheme("words", 12, 24, hot=hot)).collect()}
    assert len(got) == len(texts)
    for i, (s, g) in enumerate(zip(seqs, gone, strict=True)):
        assert (got[i]["n_units"], got[i]["n_removed"], bytes(got[i]["kept"]).decode()) == (len(s), g.sum(), " ".join(w for w, x in zip(s, g, strict=True) if not x))
        assert got[i]["row"] == "r" and got[i]["h"] == i


@pytest.mark.parametrize("hot", [4096, 1])
def test_bytes(docs, texts, hot):
    seqs = [(t or "").encode() for t in texts]
    gone = without(seqs, 200)
    got = {r["doc_id"]: r for r in suffix_array.dedup(docs, scheme=Scheme("bytes", 100, 101, hot=hot)).collect()}
    for i, (s, g) in enumerate(zip(seqs, gone, strict=True)):
        assert (got[i]["n_units"], got[i]["n_removed"], bytes(got[i]["kept"])) == (len(s), g.sum(), bytes(b for b, x in zip(s, g, strict=True) if not x))
        assert got[i]["n_spans"] == (np.diff(g.astype(int), prepend=0) == 1).sum()


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(100):
        s = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 80)), 0)
        sa, text = suffix_array.suffix_array(s), s.tolist()
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        lcp = suffix_array.permuted_lcp(s, sa, 5)
        for a, b in zip(sa[:-1], sa[1:], strict=True):
            n = next(k for k in range(len(text) + 1) if k == 5 or max(a, b) + k >= len(text) or text[a + k] != text[b + k])
            assert lcp[b] == n


def test_anchors_of_long_text_in_pieces(monkeypatch):
    sym = np.random.default_rng(2).integers(0, 1 << 60, 5000).astype(np.uint64)
    whole = tk.anchors(sym, np.array([0, 5000]), 12, 24)
    monkeypatch.setattr(tk, "PIECE", 1000)
    parts = tk.anchors(sym, np.array([0, 5000]), 12, 24)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def shingles(t):
    w = words(lower(t))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_jaccard(docs, texts):
    sets = [shingles(t) for t in texts]
    comp = list(range(len(sets)))
    find = lambda i: i if comp[i] == i else find(comp[i])
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    rows, found = jaccard.link(docs, "doc_id")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows.select("row", "rest.doc_id").join(found, "row").collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    kept = jaccard.deduplicated(docs, "doc_id")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({find(i) for i in range(len(sets))})


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 1 << 62, 60).astype(np.uint64) for _ in range(30)]
    sets = [np.unique(np.concatenate([b[: 60 - d], rng.integers(0, 1 << 62, d).astype(np.uint64)])) for b in base for d in (0, 3, 6, 30)]
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]
    tree = jaccard.Tree(np.array([len(s) for s in sets]), np.arange(len(sets)), jaccard.folded([jaccard.signature(s) for s in sets]))
    got = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in tree.pairs()), strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                assert (j, i) in got
    assert len(got) < 0.1 * len(sets) ** 2 / 2


def test_prefixes_hold_every_shared_token(monkeypatch):
    """Messages of many small tasks: each document's prefix lists what an order of all tokens by their counts gives."""
    rng = random.Random(8)
    monkeypatch.setattr(jaccard, "HELD", 300)
    texts = []
    for _ in range(12):
        w = [str(rng.randint(0, 10**9)) for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(1, 6)):
            v = list(w)
            v[rng.randrange(len(v))] = str(rng.randint(0, 10**9))
            texts.append(" ".join(v))
    texts += [texts[0], texts[0], "", "a b", texts[5]]
    order = rng.sample(range(len(texts)), len(texts))
    sent = []
    for part in range(4):  # four tasks
        own = [i for i in order if i % 4 == part]
        batch = pa.RecordBatch.from_pydict({"row": pa.array([(part << 33) + k for k in range(len(own))], pa.int64()), "text": [texts[i] for i in own]})
        sent += [r for b in jaccard._sent(3)(iter([batch])) for r in b.to_pylist()]
    rows = {(i % 4 << 33) + [x for x in order if x % 4 == i % 4].index(i): i for i in order}
    back = []
    by_box = sorted(sent, key=lambda r: (r["box"], r["kind"]))
    for b in recurring.answered(iter([pa.RecordBatch.from_pylist(by_box, recurring.message([(0, 0, 0, 0, *[None] * 5)]).schema)])):
        back += b.to_pylist()
    back.sort(key=lambda r: (r["msg"], r["kind"]))
    got = {}
    for b in recurring.used(jaccard._listed)(iter([pa.RecordBatch.from_pylist(back, recurring.message([(0, 0, 0, 0, *[None] * 5)]).schema)])):
        got |= {rows[r["row"]]: r for r in b.to_pylist()}
    sets = [shingles(t) for t in texts]
    assert sorted(got) == list(range(len(texts))) and all(got[i]["n"] == len(sets[i]) for i in got)
    classes = defaultdict(set)
    for i in got:
        classes[got[i]["cls"]].add(" ".join(words(lower(texts[i]))))
    assert all(len(c) == 1 for c in classes.values()) and len(classes) == len({" ".join(words(lower(t))) for t in texts})
    for i in got:
        for j in got:
            if i < j and sets[i] and got[i]["cls"] != got[j]["cls"] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                firsts = [min(r for r in got if got[r]["cls"] == got[x]["cls"]) for x in (i, j)]
                assert any(set(got[x]["tokens"]) & set(got[y]["tokens"]) for x in got for y in got if got[x]["cls"] == got[i]["cls"] and got[y]["cls"] == got[j]["cls"]), firsts


def test_links_among_join_as_all_pairs_do():
    rng = np.random.default_rng(6)
    for _ in range(30):
        base = [rng.integers(0, 1 << 62, 40).astype(np.uint64) for _ in range(3)]
        own = [np.unique(np.concatenate([b[: 40 - d], rng.integers(0, 1 << 62, d).astype(np.uint64)])) for b in base for d in rng.integers(0, 8, 6)]
        found = jaccard.links_among(own, list(range(len(own))), int(rng.integers(0, len(own))) if rng.random() < 0.5 else None)
        up, want = list(range(len(own))), list(range(len(own)))
        for comp, pairs in ((up, found), (want, [(i, j) for i in range(len(own)) for j in range(i) if jaccard.linked(own[i], own[j])])):
            for i, j in pairs:
                a, b = comp[i], comp[j]
                comp[:] = [min(a, b) if c in (a, b) else c for c in comp]
        assert up == want and len(found) == len(own) - len(set(want))


def test_words_of_any_pattern_have_their_own_hash():
    """Patterns that cancel out in sums of powers modulo 2**64."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    pairs = [(a, b), (a[:64], b[:64]), ("ab" * 16, "ba" * 16), ("abababab", "babababa")]
    for x, y in pairs:
        data, bounds = np.frombuffer(f"{x} {y}".encode(), np.uint8), np.array([0, len(x) + len(y) + 1])
        h = tk.word_hashes(data, *tk.words(data, bounds)[:2])
        assert len(set(h.tolist())) == 2
    h = tk.word_hashes(np.frombuffer(b"abc abcdefgh abcdefghi abc", np.uint8), np.array([0, 4, 13, 23]), np.array([3, 12, 22, 26]))
    assert h[0] == h[3] and len(set(h.tolist())) == 3


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)]) for i in range(300)]
    rows[7] = (7, rows[8][1])
    extra = [(900, None), (950, [float("nan")] * 8), (1000, [1.0, None] + [0.0] * 6), (None, rows[0][1])]
    df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<float>")
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), "vec_id", "embedding").collect()
    v = {i: np.floor(256 * np.array(x)).astype(int) for i, x in rows}
    want = set()
    for q in range(0, 300, 50):
        best = sorted(((-int(v[q] @ v[i]), i) for i in v if i != q))[:5]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want


def test_top_k_of_other_lengths_large_components_and_repeated_ids(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4)], "x") for i in range(30)]
    rows += [(i, [float(x) for x in rng.normal(0, 1, 3)], "x") for i in range(100, 108)]
    rows += [(150, [2.0**47, -(2.0**47), 1.0, 0.0], "x"), (151, [2.0**46, 2.0**45, -1.0, 3.0], "x"), (5, rows[6][1], "x"), (152, [2.0**49, 0.0, 0.0, 0.0], "x")]
    rows += [(200, [], "x"), (201, [], "x"), (250, [3e14, 0.5], "x"), (251, [0.25, -7e13], "x"), (252, [-1e300, 1e300], "x"), (300, [1e307, -1.7e308], "x"), (301, [1.0, 1.0], "x"), (302, [1e307, -1.6e308], "x")]
    rows += [(1000 + i, [float(i)] * (5 + i), "x") for i in range(0, 100, 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), "vec_id", "embedding").collect()
    v = [(i, [math.floor(256 * Fraction(c)) for c in x]) for i, x, _ in rows]
    want = set()
    for q, x in v:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in v if i != q and len(y) == len(x))[:5]
            want |= {(q, k, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(best, 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want


def test_max_score_of_one_shard():
    rng = np.random.default_rng(10)
    for _ in range(40):
        m, q = rng.integers(-50, 50, (int(rng.integers(1, 40)), int(rng.integers(1, 300)))), None
        q = rng.integers(-9, 9, m.shape[0])
        ids = rng.permutation(m.shape[1])
        found, score = topk.best_in_shard(ids, m, int(ids[0]), q, 5, m.max(1), m.min(1))
        want = sorted((-int(q @ m[:, i]), int(ids[i])) for i in range(1, m.shape[1]))[:5]
        assert [(-int(s), int(i)) for i, s in zip(found, score, strict=True)] == want


def test_language_model(spark, docs, texts):
    model = language_model.train(docs.filter("doc_id % 5 <> 1"))
    got = {r["doc_id"]: r for r in language_model.score(docs.select("doc_id", "text"), model, ["doc_id"]).collect()}
    own = [words(lower(t)) + ["</s>"] for t in texts]
    learned = [t for i, t in enumerate(own) if i % 5 != 1]
    c = Counter(w for t in learned for w in t)
    pairs = Counter(p for t in learned for p in zip(["<s>", *t], t, strict=False))
    cont, hist = Counter(w for _, w in pairs), Counter()
    kinds = defaultdict(Counter)
    for (v, w), n in pairs.items():
        hist[v] += n
        kinds[v][min(n, 3)] += 1
    d = language_model.discounts(*(Counter(pairs.values())[i] for i in (1, 2, 3, 4)))
    e = language_model.discounts(*(Counter(cont.values())[i] for i in (1, 2, 3, 4)))
    spread = sum(e[min(x, 3)] for x in cont.values()) / len(pairs)
    n_all = sum(c.values())

    def p_word(w):
        return max(cont[w] - e[min(cont[w], 3)], 0) / len(pairs) + spread / (len(c) + 1)

    def p(v, w):
        if not hist[v]:
            return p_word(w)
        n = pairs[v, w]
        return (n - d[min(n, 3)]) / hist[v] + sum(d[k] * kinds[v][k] for k in (1, 2, 3)) / hist[v] * p_word(w)

    for i, t in enumerate(own):
        r = got[i]
        assert (r["n_tokens"], r["n_known"]) == (len(t), sum(c[w] > 0 for w in t))
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n_all + 0.5 * (len(c) + 1))) for w in t))
        assert r["score"] == pytest.approx(sum(math.log10(p(v, w)) for v, w in zip(["<s>", *t], t, strict=False)))
    assert sum(p("ab", w) for w in c) + p("ab", "never seen") == pytest.approx(1)


def test_tiling():
    ids = lambda s: np.array([int(hashlib.md5(x.encode()).hexdigest()[:12], 16) for x in s.split()], np.uint64)
    item = ids("a b c d e f g h i j k l")
    assert decontaminate.tiles(ids("x g h i j k l y a b c d e f z"), item, 5) == [(8, 0, 6), (1, 6, 6)]
    assert decontaminate.tiles(ids("a b c d x e f g h"), item, 5) == []


def plain_tiles(doc, item, least):
    """Greedy string tiling by trying every length and place."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    for n in range(len(item), least - 1, -1):
        for i in range(len(item) - n + 1):
            for d in range(len(doc) - n + 1):
                if all(free_i[i : i + n]) and all(free_d[d : d + n]) and doc[d : d + n] == item[i : i + n]:
                    free_i[i : i + n] = free_d[d : d + n] = [False] * n
                    out.append((d, i, n))
    return out


@pytest.mark.parametrize("cuts", [[5, 6, 5], [11, 9], [5, 6, 5, 6, 5], [10, 10], [7, 5], [4, 9, 6]])
def test_tiling_of_reordered_chunks(cuts):
    item, edge = list(range(1, sum(cuts) + 1)), np.cumsum([0, *cuts])
    chunks = [item[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
    doc = [w for k, c in enumerate(reversed(chunks)) for w in [*c, 1000 + k]]
    got = decontaminate.tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 5)
    assert got == plain_tiles(doc, item, 5) and sum(t[2] for t in got) == sum(c for c in cuts if c >= 5)


def test_tiling_of_random_passages():
    """Items cut and put together in any order, with words between, against plain greedy string tiling."""
    rng = random.Random(12)
    for _ in range(400):
        item = [rng.randint(0, 30) for _ in range(rng.randint(5, 24))]
        cut = sorted(rng.sample(range(1, len(item)), min(len(item) - 1, rng.randint(0, 3))))
        chunks = [item[a:b] for a, b in zip([0, *cut], [*cut, len(item)], strict=True)]
        rng.shuffle(chunks)
        doc = [w for c in chunks for w in [*c, *(rng.randint(0, 40) for _ in range(rng.randint(0, 2)))]]
        got = decontaminate.tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 5)
        assert sorted(t[2] for t in got) == sorted(t[2] for t in plain_tiles(doc, item, 5))


def test_decontamination_by_several_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 1)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(8))) for i in range(3)]
    own = spark.createDataFrame([(d, f"a {items[d % 4][1]} b " * 2000 if d % 4 < 3 else "nothing here", None) for d in range(9)], "doc_id long, text string, tiles string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(own, bench).select("rest.doc_id", "item_id").collect()
    assert sorted(map(tuple, got)) == sorted((d, d % 4) for d in range(9) if d % 4 < 3)
    kept = decontaminate.clean(own, bench)
    assert kept.columns == own.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 7]


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa."), (2, None), (3, ""), (4, "one two"), (1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa.")], "item_id long, text string")
    own = spark.createDataFrame([(1, "x ALPHA Beta gamma delta epsilon y zeta eta theta iota kappa q", 5), (2, "zeta eta theta iota kappa, then alpha beta gamma delta epsilon", 5), (3, "alpha beta gamma delta", 5), (4, None, 5), (5, "", 5)], "doc_id long, text string, item_id long")
    got = decontaminate.contaminated(own, bench).select("rest.doc_id", "item_id", "coverage").collect()
    assert {tuple(r) for r in got} == {(1, 1, 1.0), (2, 1, 1.0)}
    assert sorted(r["doc_id"] for r in decontaminate.clean(own, bench).collect()) == [3, 4, 5]


def test_empty_tables(empty, spark):
    assert suffix_array.dedup(empty).count() == suffix_tree.dedup(empty).count() == jaccard.deduplicated(empty, "doc_id").count() == 0
    assert decontaminate.contaminated(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    model = language_model.train(empty)
    assert language_model.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model, ["doc_id"]).first()["n_known"] == 0
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(nothing, nothing, "vec_id", "embedding").count() == 0
