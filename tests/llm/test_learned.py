"""Operators that learn, by held-out accuracy, and SentencePiece by parity."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import language_id, language_model, learn, pieces, quality, suffix_array, suffix_tree, toxicity


@pytest.fixture(scope="module")
def labelled(spark, sf):
    return spark.read.parquet(f"{sf[:-5]}0.01/documents.parquet").join(spark.read.parquet(f"{sf[:-5]}0.01/labels.parquet"), "doc_id")


def accuracy(df, truth):
    rows = df.filter("held_out").join(truth, "doc_id").toPandas()
    return (rows["predicted"] == rows["truth"]).mean()


def test_language(spark, sf):
    got = language_id.op8_language_id(spark, f"{sf[:-5]}0.01")
    truth = spark.read.parquet(f"{sf[:-5]}0.01/documents.parquet").selectExpr("doc_id", "lang AS truth")
    assert accuracy(got.withColumnRenamed("lang_pred", "predicted"), truth) > 0.95


def test_quality(spark, sf, labelled):
    assert accuracy(quality.op9_quality(spark, f"{sf[:-5]}0.01"), labelled.selectExpr("doc_id", "quality AS truth")) > 0.95


def test_toxicity(spark, sf, labelled):
    assert accuracy(toxicity.op7_toxicity(spark, f"{sf[:-5]}0.01"), labelled.selectExpr("doc_id", "toxic AS truth")) > 0.9


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["bad", "worse", "fine", "good", "so", "la", "ti"], 12, p=p)) for p in ([0.3, 0.3, 0, 0, 0.2, 0.1, 0.1], [0, 0, 0.3, 0.3, 0.2, 0.1, 0.1]) for _ in range(150)]
    index = toxicity.build(texts, np.repeat([1, 0], 150))
    vectors = [toxicity.queries_of(*toxicity.word_terms(*toxicity.learn.joined([t])), index.vocab, index.idf)[0] for t in texts]
    dense = np.zeros((len(texts), len(index.vocab)))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 300, 17):
        cos = np.round(dense @ dense[i], 12)
        want = sorted((j for j in range(300) if cos[j] > 0), key=lambda j: (-cos[j], j))[:15]
        assert index.nearest(*vectors[i], 15)[0].tolist() == want


def test_rare_words_are_terms():
    texts = [f"so la ti {'slur' if i < 40 else 'kind'}{'abcdefghijklmnopqrstuvwxyz'[i // 2 % 26]}{'xyz' * (i // 52)}" for i in range(400)]
    index = toxicity.build(texts, np.repeat([1, 0], [40, 360]))
    assert len(index.vocab) == len({w for t in texts for w in t.split()})
    for i in (0, 14, 38):
        vector = toxicity.queries_of(*toxicity.word_terms(*toxicity.learn.joined([texts[i]])), index.vocab, index.idf)[0]
        assert index.nearest(*vector, 2)[0].tolist() == [i, i + 1]


def test_edges(spark, docs, empty, labelled):
    model = language_id.fit(labelled, "lang")
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (43, 44, 45)] == ["und"] * 3 and got[44]["rejected"] and got[0]["row"] == "r"
    assert language_id.predict(empty, model).count() == 0 and language_id.fit(empty, "lang").langs == []
    q, t = quality.fit(labelled, "quality"), toxicity.fit(labelled, "toxic")
    for scored in (quality.score(docs, q, ["doc_id"]), toxicity.score(docs, t, ["doc_id"])):
        rows = scored.collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(empty, q, ["doc_id"]).count() == toxicity.score(empty, t, ["doc_id"]).count() == 0


def test_pieces(docs, empty, texts):
    with open(pieces.MODEL, "rb") as f:
        raw = f.read()
    got = {r["doc_id"]: r for r in pieces.encode(docs, raw).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        if t is None:
            assert r["ids"] is None and r["n_tokens"] == 0 and r["parity"] is None
        else:
            assert r["parity"] and r["round_trip"] and r["decoded"] == t and r["n_tokens"] == len(r["ids"])
    assert pieces.encode(empty, raw).count() == 0


def test_pieces_against_the_library(texts):
    """Ids and texts put together from cuts and pieces are those that the tokenizers library gives for whole texts."""
    with open(pieces.MODEL, "rb") as f:
        coder = pieces.Coder(f.read())
    rng = random.Random(11)
    odd = ["".join(rng.choice(["a", "the", " ", "  ", "\n", "▁", "é", "漢", "😀", "\x00", "\t"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    whole = [t or "" for t in texts] + odd
    ids, first, back, same = coder(pa.array(whole), True)
    theirs = coder.tokenizer.encode_batch(whole, add_special_tokens=False)
    mine = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert mine == [e.ids for e in theirs] and same.all()
    assert back.to_pylist() == coder.tokenizer.decode_batch(mine, skip_special_tokens=False) == [t.replace(pieces.MARK, " ") for t in whole]
    broken = np.array([coder.spec.pieces.index(p) for p in coder.spec.pieces if p[0] in ("<0xE6>", "<unk>")] * 2)
    assert coder.decode(broken, np.array([0, 1, 4])).to_pylist() == coder.tokenizer.decode_batch([broken[:1].tolist(), broken[1:].tolist()], skip_special_tokens=False)


def test_pieces_parity_is_of_whole_texts(monkeypatch):
    with open(pieces.MODEL, "rb") as f:
        coder = pieces.Coder(f.read())
    theirs = coder.reference.encode

    class Other:
        def encode(self, whole, num_threads):
            return [x if i != 1 else x[:-1] + [5] for i, x in enumerate(theirs(whole))]

    coder.reference = Other()
    assert coder(pa.array(["one two", "three four", "five", ""]), True)[3].tolist() == [True, False, True, True]


def test_unigram_model():
    spec = pieces.Spec([("<unk>", 0.0, pieces.UNKNOWN), ("▁", -2.0, pieces.NORMAL), ("▁ab", -1.0, pieces.NORMAL), ("a", -3.0, pieces.NORMAL), ("b", -3.0, pieces.NORMAL), ("c", -4.0, pieces.NORMAL)], pieces.UNIGRAM)
    t = pieces.build(spec)
    assert t.encode("ab  cab", add_special_tokens=False).tokens == ["▁ab", "▁", "c", "a", "b"]
    assert t.decode(t.encode("ab cab", add_special_tokens=False).ids) == "ab cab"


def test_sample_of_few_texts_in_many_copies(spark):
    rows = [("one", 0)] * 3000 + [("two", 0)] * 3000 + [(f"text {i}", 1) for i in range(500)] + [(None, 1), ("text 1", 1)]
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, y int")
    got = learn.sample(df, "y", 100, id_col="doc_id")
    assert sorted(got[got.label == 0].text) == ["one", "two"] and (got.label == 1).sum() == 100
    assert got.id[got.text == "one"].tolist() == [0] and got.text.is_unique


def test_nearest_examples_are_those_of_brute_force():
    rng = random.Random(4)
    stock = ["w" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(120)]
    texts = [" ".join(rng.choice(stock) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    index = toxicity.build(texts, np.array([i % 3 == 0 for i in range(300)], int))
    unit = [toxicity.queries_of(*toxicity.word_terms(*learn.joined([t])), index.vocab, index.idf)[0] for t in texts]
    dense = np.zeros((300, len(index.vocab)))
    for i, (t, w) in enumerate(unit):
        dense[i, t] = w
    for i in range(0, 300, 7):
        found, cosine = index.nearest(*unit[i], 15)
        want = dense @ dense[i]
        order = np.lexsort((np.arange(300), -np.round(want, 12)))[:15]
        assert found.tolist() == order[want[order] > 0].tolist() and np.allclose(cosine, want[found])


def test_language_is_that_of_the_nearest_centroid(labelled, docs):
    model = language_id.fit(labelled, "lang")
    for r in language_id.predict(docs, model).collect():
        low = (r["text"] or "").lower()
        if not any(c.isalpha() for c in low):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        cos = language_id.vectors(*learn.joined([low]), model.idf)[0] @ model.centroids
        best = [max(cos[model.owner == x]) for x in range(len(model.langs))]
        assert r["lang_pred"] == model.langs[int(np.argmax(best))]
        assert r["rejected"] == (max(best) < model.floor[len(low.encode()).bit_length()])


def test_quality_is_the_softmax_of_the_mean_vector(labelled, docs):
    model = quality.fit(labelled, "quality")
    for r in quality.score(docs, model, ["doc_id", "text"]).collect():
        x = quality.features(*learn.joined([r["text"] or ""]))[0]
        z = x @ model.vectors @ model.weights + model.bias
        assert r["score"] == pytest.approx(float(np.exp(z[1] - z.max()) / np.exp(z - z.max()).sum()), abs=1e-5)


def test_made_columns_win_over_those_of_the_same_name(spark, labelled):
    names = ["score", "evidence", "lang_pred", "rejected", "ids", "n_tokens", "decoded", "round_trip", "parity", "n_units", "n_removed", "n_spans", "kept", "n_known", "base_score", "rest", "row"]
    df = spark.createDataFrame([(1, "The quick text", *["x"] * len(names)), (1, None, *["y"] * len(names))], ["doc_id", "text", *names])
    keep = [c for c in df.columns if c != "text"]
    with open(pieces.MODEL, "rb") as f:
        raw = f.read()
    outs = [language_id.predict(df, language_id.fit(labelled, "lang")), pieces.encode(df, raw), suffix_array.dedup(df), suffix_tree.dedup(df)]
    outs += [m.score(df, m.fit(labelled, y), keep) for m, y in ((quality, "quality"), (toxicity, "toxic"))]
    outs.append(language_model.score(df, language_model.train(df), keep))
    for out in outs:
        assert len(set(out.columns)) == len(out.columns) and set(keep) <= set(out.columns) and out.count() == 2
        assert sorted(r["rest"] for r in out.collect()) == ["x", "y"]
