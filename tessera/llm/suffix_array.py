"""Op 6. Suffix-array dedup: bytes covered by a 200-byte string that starts anywhere else are removed.

Contexts that share an anchor are laid end to end in shards; each shard's
suffix array is built by induced sorting and its permuted longest common
prefixes tell which windows another context repeats. The k bytes of the anchor
itself, equal within a group, are written as a short group code.

Null or empty text: no bytes, nothing removed. Repeated rows are separate
documents. Matches never cross documents. Works on columns of any other name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.repeats import Scheme, without_repeats

SCHEME = Scheme("bytes", k=100, width=101)
#: Symbols of a shard: 0 ends it, 1 parts contexts, 2 opens a group code, bytes follow from 3 on.
END, PART, CODE, FIRST = 0, 1, 2, 3


def s_types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last one counts as such."""
    n = len(s)
    t = np.ones(n, bool)
    if n > 1:
        ends = np.append(np.flatnonzero(s[1:] != s[:-1]), n - 1)
        run = np.zeros(n, np.int64)
        run[ends[:-1] + 1] = 1
        up = np.ones(len(ends), bool)
        up[:-1] = s[ends[:-1]] < s[ends[:-1] + 1]
        t = up[np.cumsum(run)]
    return t


def _place(sa: np.ndarray, edge: np.ndarray, s: np.ndarray, j: np.ndarray, way: int) -> None:
    """Put suffixes j, in order, at the edges of their buckets, which move up (way 1) or down (way -1)."""
    c = s[j]
    order = np.argsort(c.astype(np.uint16) if len(edge) <= 1 << 16 else c, kind="stable")  # small numbers are sorted by radix
    j, c = j[order], c[order]
    head = np.flatnonzero(np.diff(c, prepend=-1))
    size = np.diff(np.append(head, len(c)))
    rank = np.arange(len(c)) - np.repeat(head, size)
    sa[edge[c] + way * rank] = j
    edge[c[head]] += way * size


def induce(s: np.ndarray, t: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix array from its leftmost-smaller suffixes in order: L suffixes upwards, then S suffixes downwards.

    Buckets are taken one at a time; within one, what was put there is taken in batches until none is new.
    """
    n, k = len(s), len(bounds) - 1
    sa = np.full(n, -1, np.int64)
    tail = bounds[1:] - 1
    edge = tail.copy()
    _place(sa, edge, s, lms[::-1], -1)
    seeds = edge + 1  # where the LMS suffixes of each bucket begin
    head = bounds[:-1].copy()
    used = np.flatnonzero(np.diff(bounds))
    for c in used:
        at = bounds[c]
        while at < head[c]:
            batch, at = sa[at : head[c]] - 1, head[c]
            batch = batch[batch >= 0]
            batch = batch[~t[batch]]
            if len(batch):
                _place(sa, head, s, batch, 1)
        batch = sa[seeds[c] : bounds[c + 1]] - 1
        batch = batch[batch >= 0]
        batch = batch[~t[batch]]
        if len(batch):
            _place(sa, head, s, batch, 1)
    last = tail.copy()
    for c in used[::-1]:
        at = tail[c]
        while at > last[c]:
            batch, at = sa[last[c] + 1 : at + 1][::-1] - 1, last[c]
            batch = batch[batch >= 0]
            batch = batch[t[batch]]
            if len(batch):
                _place(sa, last, s, batch, -1)
        batch = sa[bounds[c] : head[c]][::-1] - 1
        batch = batch[batch >= 0]
        batch = batch[t[batch]]
        if len(batch):
            _place(sa, last, s, batch, -1)
    sa[0] = n - 1
    return sa


def _names(s: np.ndarray, order: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For LMS substrings in sorted order: a number for each, equal where the substrings are equal."""
    size = length[order]
    same = np.zeros(len(order), bool)
    same[1:] = size[1:] == size[:-1]
    live = np.flatnonzero(same)
    step = 0
    while len(live):
        ok = s[order[live] + step] == s[order[live - 1] + step]
        same[live[~ok]] = False
        live = live[ok]
        step += 1
        live = live[size[live] > step]
    return np.cumsum(~same) - 1


def _doubling(s: np.ndarray) -> np.ndarray:
    """Suffix array by rank doubling, for strings over nearly as many symbols as they are long, where induction would take its buckets one by one."""
    n = len(s)
    rank, step = np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        found, rank = np.unique(key, return_inverse=True)
        if len(found) == n or step >= n:
            return np.argsort(rank, kind="stable")
        step *= 2


def suffix_array(s: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of s in order; s ends with its only least symbol 0."""
    n = len(s)
    if n < 3:
        return np.arange(n)[::-1].copy()
    t = s_types(s)
    lms = np.flatnonzero(t[1:] & ~t[:-1]) + 1
    bounds = np.concatenate([[0], np.cumsum(np.bincount(s))])
    if len(lms) <= 1:
        return induce(s, t, lms, bounds)
    length = np.ones(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    rough = induce(s, t, lms, bounds)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    name = np.empty(n, np.int64)
    named = _names(s, order, length)
    name[order] = named
    short = name[lms]
    if named[-1] + 1 == len(lms):
        sorted_lms = order
    elif (named[-1] + 1) * 64 <= len(lms):
        sorted_lms = lms[suffix_array(short)]
    else:
        sorted_lms = lms[_doubling(short)]
    return induce(s, t, sorted_lms, bounds)


#: Symbols of 9 bits that are compared at once.
BITS, PACK = 9, 7


def permuted_lcp(s: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """For each suffix, in text order, the symbols shared with the suffix before it in sa, as far as limit.

    Only where the preceding symbols differ are symbols compared; elsewhere the value is the last one less the distance,
    or compared as well where the last one was cut at the limit. Symbols are below 511.
    """
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    before = np.where(at > 0, s[at - 1], -1)
    direct = (phi <= 0) | (at == 0) | (before != s[phi - 1])
    padded = np.concatenate([s, np.full(limit + 2 * PACK, 511, np.int64)])
    packed = padded[: len(padded) - PACK].copy()
    for i in range(1, PACK):
        packed |= padded[i : i + len(packed)] << (BITS * i)

    def compared(live: np.ndarray, have: np.ndarray) -> np.ndarray:
        """Shared symbols of suffixes and those before them, of which so many are known."""
        have = have.copy()
        todo = np.flatnonzero(phi[live] >= 0)
        while len(todo):
            x = packed[live[todo] + have[todo]] ^ packed[phi[live[todo]] + have[todo]]
            same = x == 0
            have[todo] += np.where(same, PACK, np.bitwise_count((x & -x) - 1) // BITS)
            todo = todo[same & (have[todo] < limit)]
        return np.minimum(have, limit)

    plcp = np.zeros(n, np.int64)
    start = np.flatnonzero(direct)
    plcp[start] = compared(start, np.zeros(len(start), np.int64))
    last = np.maximum.accumulate(np.where(direct, at, 0))
    out = np.maximum(plcp[last] - (at - last), 0)
    # a value cut at the limit may only fall short where the true one is beyond it
    cut = np.flatnonzero((plcp[last] >= limit) & ~direct)
    out[cut] = compared(cut, out[cut])
    return out


def resolve(groups: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], scheme: Scheme) -> list[np.ndarray]:
    """For each context, which of its windows over the anchor another context of its group repeats."""
    sizes = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    total = sizes[0] + sizes[1] + 5
    begin = np.concatenate([[0], np.cumsum(total)])
    s = np.empty(begin[-1] + 1, np.int64)
    s[-1] = END
    inside = np.ones(len(s), bool)
    inside[-1] = False
    code_at = begin[:-1] + sizes[0]
    for i in range(4):
        s[code_at + i] = CODE if i == 0 else FIRST + ((groups >> (8 * (i - 1))) & 255)
        inside[code_at + i] = False
    s[begin[1:] - 1] = PART
    inside[begin[1:] - 1] = False
    s[inside] = np.concatenate([x for pair in zip(left, right, strict=True) for x in pair]).astype(np.int64) + FIRST
    need = scheme.width - 1 + 4
    sa = suffix_array(s)
    lcp = permuted_lcp(s, sa, need)
    following = np.zeros(len(s), np.int64)
    following[sa[:-1]] = lcp[sa[1:]]
    repeated = np.maximum(lcp, following) >= need
    many = np.maximum(0, sizes[0] + sizes[1] - (scheme.width - 1) + 1)
    return [repeated[b : b + m] for b, m in zip(begin[:-1].tolist(), many.tolist(), strict=True)]


def dedup(docs: DataFrame, text: str = "text", scheme: Scheme = SCHEME, characters: bool = False) -> DataFrame:
    """docs without the text, with n_units, n_removed, n_spans and kept, the bytes (or whole characters) left."""
    return without_repeats(docs, text, scheme, resolve, characters)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k
      FROM d, LATERAL (SELECT unnest(range(0, greatest(0, length(h) // 2 - 199))) AS i)),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w JOIN r USING (k)),
g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i - p > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s),
v AS (SELECT doc_id, g, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY doc_id, g),
n AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS prev FROM v),
t AS (SELECT n.doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last,
             string_agg(substr(h, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) AS kept
      FROM n JOIN d ON d.doc_id = n.doc_id GROUP BY n.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
