import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, h long, rest string"


@pytest.fixture(scope="session")
def texts():
    """Words from a small stock, with copies, near copies, shared passages, nulls, empties and a very long text."""
    rng = random.Random(5)
    stock = ["".join(rng.choice("abcdé") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    words = lambda n: [rng.choice(stock) for _ in range(n)]
    passage = " ".join(words(70))
    out = [" ".join(words(rng.randint(1, 120))) for _ in range(40)]
    out += [out[3], out[3], out[4], "", None, "  \n ", "one two", "one two"]
    for i in (5, 6, 7, 7, 7):
        w = out[i].split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [" ".join(words(20)) + " " + passage + " " + " ".join(words(9)) for _ in range(4)]
    out += ["ab " * 3000, "x" * 5000, " ".join(words(20_000)), "ÀÉ Tail\tof\x0btext\x00 end"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", None, "r", i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
