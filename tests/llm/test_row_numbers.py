"""Results stay the same when Spark cuts the files of a table anew between the steps of a job."""

import hashlib
import importlib
import random
import re
from itertools import count

import pytest

import corpus_pipeline
from tessera.llm import jaccard, repeats, suffix_array, suffix_tree

CONF = "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def shifting(spark, monkeypatch):
    """Each table that is written changes how the next read is dealt out."""
    turns = count()

    def turned(made):
        def run(*args, **more):
            out = made(*args, **more)
            n = next(turns)
            for name, value in zip(CONF, (("2", "1", "20000") if n % 2 else ("16", "1000", "3000")), strict=True):
                spark.conf.set(name, value)
            return out

        return run

    for module in (repeats, jaccard):
        monkeypatch.setattr(module, "materialise", turned(module.materialise))
    yield turns
    for name in CONF:
        spark.conf.unset(name)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(12)
    stock = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    passages = [" ".join(rng.choice(stock) for _ in range(60)) for _ in range(12)]
    text = lambda: " ".join(rng.choice(stock) for _ in range(rng.randint(5, 80)))
    texts = [text() + " " + rng.choice(passages) + " " + text() if rng.random() < 0.5 else text() for _ in range(400)]
    texts += [re.sub(r"^\w+", "changed", rng.choice(texts)) for _ in range(80)]
    path = str(tmp_path_factory.mktemp("numbers"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(23).write.parquet(f"{path}/documents.parquet")
    return path, texts


def digests(df):
    return sorted((r["doc_id"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("operator", [suffix_array.dedup, suffix_tree.dedup])
def test_repeats(spark, table, shifting, operator):
    path, texts = table
    got = digests(operator(spark.read.parquet(f"{path}/documents.parquet")))
    assert next(shifting) > 5 and sum(r[1] > 0 for r in got) > 100
    without = importlib.import_module("test_exact").without
    words = operator is suffix_tree.dedup
    seqs = [t.split() if words else t.encode() for t in texts]
    gone = without(seqs, 35 if words else 200)
    kept = [" ".join(w for w, x in zip(s, g, strict=True) if not x).encode() if words else bytes(b for b, x in zip(s, g, strict=True) if not x) for s, g in zip(seqs, gone, strict=True)]
    assert got == [(i, int(g.sum()), hashlib.sha256(k).hexdigest()) for i, (g, k) in enumerate(zip(gone, kept, strict=True))]


def test_components(spark, table, shifting):
    path, texts = table
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.op2_ngram_jaccard(spark, path).collect()}
    shingles = importlib.import_module("test_exact").shingles
    sets = [shingles(t) for t in texts]
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if comp[i] != comp[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    assert next(shifting) > 5 and got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, comp, strict=True))}


def test_stages_of_the_pipeline(spark, table, shifting):
    path, _ = table
    docs = lambda: spark.read.parquet(f"{path}/documents.parquet")
    once = [sorted(map(tuple, stage(spark, docs(), path).collect())) for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeated_bytes)]
    next(shifting)  # the other turn comes first now
    assert once == [sorted(map(tuple, stage(spark, docs(), path).collect())) for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeated_bytes)]
    assert len(once[0]) < len(once[1])
