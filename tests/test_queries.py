"""Every registered query of the reconciliation against its SQL on the two smaller sets of tables."""

import duckdb
import pytest

from tallyspark.plans import queries as q

FOLDERS = {sf: f"/root/testdata/{sf}" for sf in ("sf0.001", "sf0.01")}


@pytest.fixture(scope="module")
def engines():
    out = {}
    for sf, folder in FOLDERS.items():
        out[sf] = duckdb.connect()
        for t in ("orders", "lineitem"):
            out[sf].execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return out


def rows(df):
    cell = lambda v: "null" if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v)
    names = sorted(df.columns)
    return names, sorted(tuple(cell(v) for v in r) for r in df[names].astype(object).where(df[names].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.QUERIES))
@pytest.mark.parametrize("sf", FOLDERS)
def test_query(spark, engines, name, sf):
    got = q.QUERIES[name](spark, FOLDERS[sf])
    if name not in q.ORACLES:
        assert got.count() > 0
        return
    have, want = rows(got.toPandas()), rows(engines[sf].execute(q.ORACLES[name]).df())
    assert have[0] == want[0]
    plain = lambda table: [tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in table]
    assert plain(have[1]) == plain(want[1])
