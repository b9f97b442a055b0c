"""Every query against its SQL in DuckDB, or at least to its end."""

import math
from pathlib import Path

import duckdb
import pytest

from tessitura.queries import ORACLE_SQL, QUERIES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).iterdir():
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(row):
    return tuple(None if isinstance(v, float) and math.isnan(v) else v for v in row)


def same(a, b):
    return len(a) == len(b) and all(
        (x is None and y is None) or x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)) for x, y in zip(a, b, strict=True)
    )


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((plain(r) for r in df.select(*columns).collect()), key=repr)
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    assert {c: str(t) for c, t in zip(rel.columns, rel.types, strict=True)} == {c: TYPES.get(t, t) for c, t in df.dtypes}
    at = [rel.columns.index(c) for c in columns]
    want = sorted((plain(tuple(r[i] for i in at)) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(same(a, b) for a, b in zip(got, want, strict=True)), next((a, b) for a, b in zip(got, want, strict=True) if not same(a, b))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_and_reruns_agree(name, spark, sf_dir):
    first = QUERIES[name](spark, sf_dir)
    assert first.columns
    if name in ("rf_predictions", "lr_predictions", "permutation_importance", "dummy_predictions"):
        assert first.count() > 0
        return
    again = QUERIES[name](spark, sf_dir)
    assert sorted(map(repr, first.collect())) == sorted(map(repr, again.collect()))
