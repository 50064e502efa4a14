"""Op 1. Substring dedup: words covered by a window of 35 words that starts anywhere else are removed.

Suffixes are split by prefixes of variable length: a window's prefix runs from
its first word to the end of its anchor's k words, so it has k to 35 words. The
suffixes of each prefix form a subtree, grown from the top: the leaves of a node
are parted by their next word and nodes with one leaf grow no further. Internal
nodes 35 words deep are the repeats. A prefix with too many suffixes for one
task is extended to whole windows, which are counted.

Null or empty text: no words, nothing removed. Repeated rows are separate
documents. Works on columns of any other name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.repeats import Scheme, without_repeats

SCHEME = Scheme("words", k=12, width=24)


def subtree_leaves(node: np.ndarray, word_at: list, depth: int) -> np.ndarray:
    """Leaves still below an internal node after depth more words, from the nodes at the prefixes' ends.

    word_at(leaves, d) gives the d-th further word of leaves, as numbers.
    """
    leaves = np.arange(len(node))
    for d in range(depth + 1):
        _, node, size = np.unique(node, return_inverse=True, return_counts=True)
        live = size[node] > 1
        leaves, node = leaves[live], node[live].astype(np.int64)
        if d == depth or not len(leaves):
            return leaves
        node = (node << 32) | word_at(leaves, d)
    return leaves


def resolve(groups: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], scheme: Scheme) -> list[np.ndarray]:
    """For each context, which of its windows over the anchor another context of its group repeats."""
    out = scheme.width - 1  # words of a window beyond its anchor's k
    sizes = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    _, flat = np.unique(np.concatenate([*left, *right, np.zeros(1, np.uint64)]), return_inverse=True)
    flat = flat.astype(np.int64)
    at_left = np.concatenate([[0], np.cumsum(sizes[0])])
    at_right = at_left[-1] + np.concatenate([[0], np.cumsum(sizes[1])])
    many = np.maximum(0, sizes[0] + sizes[1] - out + 1)
    row = np.repeat(np.arange(len(left)), many)
    first = np.concatenate([[0], np.cumsum(many)])
    start = np.arange(len(row)) - first[row]
    before = sizes[0][row] - start  # words of the window left of the anchor

    def word_at(leaves: np.ndarray, d: int) -> np.ndarray:
        r, b = row[leaves], before[leaves]
        return flat[np.where(d < b, at_left[r] + start[leaves] + d, at_right[r] + d - b)]

    leaves = subtree_leaves(groups[row] * (out + 1) + before, word_at, out)
    mark = np.zeros(len(row), bool)
    mark[leaves] = True
    return [mark[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def dedup(docs: DataFrame, text: str = "text", scheme: Scheme = SCHEME) -> DataFrame:
    """docs without the text, with n_units, n_removed, n_spans and kept, the words left joined by one space."""
    return without_repeats(docs, text, scheme, resolve)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k
      FROM d, LATERAL (SELECT unnest(range(1, greatest(1, len(ws) - 33))) AS i)),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + o AS p FROM w JOIN r USING (k), LATERAL (SELECT unnest(range(0, 35)) AS o)),
x AS (SELECT doc_id, p, ws[p] AS t FROM d, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS p)),
k AS (SELECT x.doc_id, string_agg(x.t, ' ' ORDER BY x.p) AS kept FROM x ANTI JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
