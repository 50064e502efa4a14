"""Periodic runs against a plain search."""

import hashlib
import random
import re
import zlib

import numpy as np

from tessera.llm import periods


def plain_runs(w):
    """Start, length and period by trying every period at every place."""
    n, out = len(w), {}
    for q in range(n // 4, 0, -1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out[i, j + q] = q  # the least period stays
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain(text, doc_id=None):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest)


def test_runs_of_random_sequences():
    rng = random.Random(4)
    seqs = [[rng.randrange(a) for _ in range(rng.randrange(60))] for a in (1, 2, 2, 3) for _ in range(60)]
    for _ in range(60):  # repeats within repeats, with a changed symbol
        block = [rng.randrange(3) for _ in range(rng.randint(1, 9))] * rng.randint(1, 5)
        s = [rng.randrange(3) for _ in range(rng.randrange(9))] + block * rng.randint(3, 6) + block[: rng.randrange(len(block))]
        s[rng.randrange(len(s))] = rng.randrange(4)
        seqs.append(s)
    seqs += [[], [0] * 5, [0] * 6, [0] * 999, [0, 1] * 500 + [0], list(range(300)) * 4, list(range(300)) * 3 + list(range(299))]
    flat, bounds = np.array([x for s in seqs for x in s], np.int64), np.cumsum([0, *map(len, seqs)])
    start, length, period = periods.runs_in(flat, bounds)
    doc = np.searchsorted(bounds, start, "right") - 1
    got = [[] for _ in seqs]
    for d, s, m, q in zip(doc.tolist(), (start - bounds[doc]).tolist(), length.tolist(), period.tolist(), strict=True):
        got[d].append((s, m, q))
    for s, g in zip(seqs, got, strict=True):
        assert sorted(g) == plain_runs(s), s
    assert periods.runs_in(np.empty(0, np.int64), np.zeros(1, np.int64))[0].size == 0


def test_collapse_of_awkward_documents(docs, texts, empty):
    got = {r["doc_id"]: r for r in periods.collapse(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if len((t or "").split()) > 5000:
            continue  # the plain search is quadratic
        want = plain(t)
        runs = [(r["start"], r["length"], r["period"]) for r in got[i]["runs"]]
        lines = "".join("{},{},{}\n".format(*r) for r in runs)
        assert (len(runs), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(got[i]["kept"]).hexdigest()) == (want[0], want[5], want[6])
        assert got[i]["row"] == "r" and got[i]["rest"] == "x"
    assert periods.collapse(empty).count() == 0


def test_query_against_plain_search(spark, tmp_path, texts):
    rows = [(i, t) for i, t in enumerate(texts * 3) if len((t or "").split()) < 4000] + [(None, "a b " * 9), (7, "a b " * 9)]
    rows += [(10_000 + i, " ".join(f"w{j % 97}" for j in range(i * 7))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple(str(x) for x in r)
    found = sorted(map(tuple, periods.op13_periodic_runs(spark, str(tmp_path)).collect()), key=key)
    assert found == sorted(((d, *plain(t, d)) for d, t in rows), key=key)
    assert sum(r[1] > 0 for r in found) > 10


def test_one_query_row_for_each_document_of_the_small_table(spark, sf):
    want = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = periods.op13_periodic_runs(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        if len(want[r["doc_id"]].split()) < 1500:
            assert tuple(r) == (r["doc_id"], *plain(want[r["doc_id"]], r["doc_id"]))
