"""Token files: exact ids against the library text by text, the files' layout, and reads of a part."""

import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.llm import token_files

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def raw():
    with open(public_tokenizers.path(token_files.TOKENIZER), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(raw):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(raw)


def odd_texts(n=600):
    rng = random.Random(9)
    bits = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x85", "\xa0", " ", " ", "　", "\x1c", "a", "word", "don't", "I'LL", "é", "ß", "д", "中", "😀", "12", "3.5", "...", "-", "'s", "<|endoftext|>", "\x00", "é", "￿"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_ids_are_the_library_s(raw, library, texts):
    coder = token_files.Coder(raw)
    assert coder.cuts
    every = odd_texts() + [t or "" for t in texts] + ["don't; can't... (it's) x_y O'Neill's 'tis rock'n'roll l'été é. ñ! ×, ÷; a1b2. 3a, a-1"]
    parts = [coder(pa.array([t], pa.large_string())) for t in every]  # each in its own chunk, so that few hold the added token
    ids, edge = np.concatenate([x for x, _ in parts]), np.cumsum([0, *(len(x) for x, _ in parts)])
    for t, a, b in zip(every, edge[:-1], edge[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids + [2], t
    coder.cuts = False
    again, same = coder(pa.array(every, pa.large_string()))
    assert np.array_equal(ids, again) and np.array_equal(edge, same)


def expected(rows, library):
    """doc_id, start, n_tokens and crc of rows sorted by id."""
    start, out = 0, []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, tmp_path, texts, library):
    rows = [(3 * i - 40, t) for i, t in enumerate(texts + odd_texts(100))]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, token_files.op12_token_files(spark, str(tmp_path)).collect()))
    assert got == expected(sorted(rows, key=lambda r: r[0]), library)


def test_query_of_the_small_table(spark, sf, library):
    rows = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    assert sorted(map(tuple, token_files.op12_token_files(spark, sf).collect())) == expected(rows, library)


def test_layout_and_partial_reads(spark, tmp_path, docs, texts, library, raw):
    path = f"{tmp_path}/files"
    token_files.write(docs, raw, path)
    files = [f for f in sorted(glob.glob(f"{path}/*.parquet")) if pq.ParquetFile(f).metadata.num_rows]
    assert len(files) > 1
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        column = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert "RLE_DICTIONARY" in column["ids.list.element"].encodings and "DELTA_BINARY_PACKED" in column["first"].encodings and "RLE_DICTIONARY" not in column["id"].encodings
        assert all(c.has_column_index and c.has_offset_index for c in column.values())
    some = token_files.read(spark, path, ("id", "ids", "meta"), [3, 7, 999])
    got = {r["id"]: r for r in some.collect()}
    assert set(got) == {3, 7} and got[3]["ids"] == library.encode(texts[3], add_special_tokens=False).ids + [2] and got[3]["meta"]["rest"] == "x"
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "In(id" in plan.replace("`", "") and "n_tokens" not in plan.split("ReadSchema")[1]
    lengths = token_files.read(spark, path, ("id", "n_tokens"))
    assert "ids" not in lengths._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert {r[0]: r[1] for r in lengths.collect()} == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    token_files.write(docs, raw, f"{tmp_path}/delta", delta=True)
    group = next(m.row_group(0) for m in (pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/delta/*.parquet")) if m.num_rows)
    assert "DELTA_BINARY_PACKED" in next(c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == "ids.list.element").encodings


def test_many_row_groups_and_pages(spark, tmp_path, raw, monkeypatch):
    """A file of several row groups and pages; reading one document passes over the others."""
    monkeypatch.setattr(token_files, "GROUP_BYTES", 1 << 16)
    monkeypatch.setattr(token_files, "PAGE_ROWS", 20)
    rng = random.Random(2)
    rows = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(400))) for i in range(4000)]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), raw, f"{tmp_path}/f")
    metas = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/f/*.parquet")]
    assert max(m.num_row_groups for m in metas) > 1
    assert [r["id"] for r in token_files.read(spark, f"{tmp_path}/f", ids=[1234]).collect()] == [1234]


def test_ties_nulls_and_empty(spark, tmp_path, raw, empty):
    rows = [(1, "b"), (1, "b"), (1, "a a"), (None, None), (None, "x"), (0, "")]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), raw, f"{tmp_path}/t")
    got = token_files.read(spark, f"{tmp_path}/t", ("id", "start", "n_tokens")).collect()
    at = sorted((r["start"], r["n_tokens"]) for r in got)
    assert len(got) == 6 and at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at[:-1], at[1:], strict=True))
    assert [r["id"] for r in sorted(got, key=lambda r: r["start"])] == [None, None, 0, 1, 1, 1]
    token_files.write(empty, raw, f"{tmp_path}/e")
    assert token_files.read(spark, f"{tmp_path}/e", ("id", "start", "ids")).count() == 0
