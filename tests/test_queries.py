"""Every registered query of the reference's operators against its SQL."""

import pandas as pd
import pytest

from tessera.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted("|".join("~" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        for c in want.columns:  # a nullable integer column becomes float in one of the two
            kinds = {got[c].dtype.kind, want[c].dtype.kind}
            if kinds == {"i", "f"}:
                got[c], want[c] = got[c].astype(float), want[c].astype(float)
        assert rows(got) == rows(want)


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and set(ORACLE_SQL) <= set(QUERIES)
