"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from tessera.llm import spelling


def plain_counts(rows):
    out = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{d}:{w}".encode())
            if d is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    form, near = {}, {}
    for w in n:
        own = [v for v in n if is_near(w, v)]
        near[w] = len(own)
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n[w], near[w], n.get(form[w])) for w in n), key=str)


def test_checksums_of_joined_texts():
    rng = random.Random(1)
    for size in range(1, spelling.SHORT + 1):
        a, b = rng.randbytes(rng.randrange(20)), rng.randbytes(size)
        got = spelling.crc_after(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([size]))
        assert int(got[0]) == zlib.crc32(a + b)


def test_deletion_keys_agree_exactly_where_texts_do():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(300)})
    key, of, at, _ = spelling.deletion_keys(words)
    text = {}
    for k, w, i in zip(key.tolist(), of.tolist(), at.tolist(), strict=True):
        s = words[w] if i < 0 else words[w][:i] + words[w][i + 1 :]
        assert text.setdefault(k, s) == s
    assert len(set(text.values())) == len(text)


def test_variants_of_random_words(spark):
    rng = random.Random(3)
    n = {}
    for _ in range(40):
        w = "".join(rng.choice("abcé") for _ in range(rng.randint(6, 9)))
        n[w] = rng.choice([5, 40, 900, 20_000])
        for _ in range(12):
            i, c = rng.randrange(len(w)), rng.choice("abc÷")
            v = rng.choice([w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1 :]])
            n.setdefault(v, rng.choice([5, 6, 25, 200, 1000]))
    long = "qwertz" * 400
    n |= {long: 100, long[:700] + "x" + long[701:]: 20, long + "y": 5, "a" * 30: 9, "a" * 31: 45, "a" * 32: 225, "a" * 33: 1125}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_variants(n)
    assert max(len(r) for r in [n]) > 100 and any(r[2] == "a" * 33 and r[0] == "a" * 30 for r in plain_variants(n))


def test_keys_that_agree_by_chance_change_nothing(spark, monkeypatch):
    n = {w: 5 + i for i, w in enumerate(["abcdef", "abcdeg", "abcde", "xbcdef", "bcdefa", "zzzzzz", "zzzzzy", "qqqqqqq"])}
    real = spelling.deletion_keys
    monkeypatch.setattr(spelling, "deletion_keys", lambda w: (real(w)[0] % np.uint64(3), *real(w)[1:]))
    key, of, at, other = spelling.deletion_keys(list(n))
    order = np.argsort(key, kind="stable")
    entry, cell = spelling.shared_cells(key[order].view(np.int64), at[order], other[order])
    members = [(int(of[order][e]), int(at[order][e]), int(c)) for e, c in zip(entry.tolist(), cell.tolist(), strict=True)]
    words = list(n)
    found = set()
    for a in members:  # what near() makes of cells: equal texts in equal cells
        for b in members:
            s, t = (words[x[0]] if x[1] < 0 else words[x[0]][: x[1]] + words[x[0]][x[1] + 1 :] for x in (a, b))
            if a[0] != b[0] and a[2] == b[2] and s == t and (a[2] >= 0 or (a[1] < 0) != (b[1] < 0)):
                found.add((words[a[0]], words[b[0]]))
    assert found == {(a, b) for a in words for b in words if is_near(a, b)}


def test_query_against_plain_version(spark, tmp_path, texts):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(base).title() if rng.random() < 0.1 else rng.choice(base) for _ in range(200)) + "-" + "Ä" * 5 + "×y") for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(texts)] + [(None, "abcdefg " * 6), (5, ""), (6, None), (7, "z" * 70 + " end"), *[(8, "z" * 70 + " end")] * 5]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, spelling.op11_spelling_variants(spark, str(tmp_path)).collect()), key=str)
    want = plain_variants(plain_counts(rows))
    assert got == want and sum(r[1] is not None for r in want) > 20


def test_empty(spark, empty):
    assert spelling.variants(spelling.counts(empty, key="doc_id")).count() == 0
