"""Every camera query against its SQL, on the small tables."""

import math

import duckdb
import pyarrow as pa
import pytest

from frameloom.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(table: pa.Table) -> list[tuple]:
    """Rows by column name, in an order to which floats only add what rounding leaves of them; what is compared are the values."""
    found = list(zip(*(table.column(c).to_pylist() for c in sorted(table.column_names))))
    place = lambda r: (str([x for x in r if not isinstance(x, float)]), str([round(x, 3) + 0.0 for x in r if isinstance(x, float)]))
    return sorted(found, key=place)


def same(x, y) -> bool:
    return math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) and isinstance(y, float) else x == y


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toArrow()
    assert got.num_rows
    if name in queries.SQL:
        want = duck.execute(queries.SQL[name]).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        a, b = rows(got), rows(want)
        assert len(a) == len(b), (len(a), len(b), a[:3], b[:3])
        different = [(x, y) for x, y in zip(a, b) if not all(map(same, x, y))]
        assert not different, (len(different), different[:3])


def test_comparison_sees_the_sixth_decimal():
    assert not same(0.520313, 0.520312) and same(0.1 + 0.2, 0.3)
