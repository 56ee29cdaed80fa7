"""Every query with an SQL twin gives the rows DuckDB gives at the smallest scale."""

from pathlib import Path

import pytest

from spanlab.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def shown(v):
    if v is None or v != v:
        return ""
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    relation = duck.execute(ORACLES[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    expected = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in relation.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == expected


def test_every_query_has_its_sql():
    assert set(QUERIES) - set(ORACLES) == {"q_split_search"}  # an iterative search, see test_operators
