import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fairline.session import local_session

    return local_session(cores=4, shuffle_partitions=4)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain_rows(columns, rows):
    """Rows as sorted tuples of text, columns by name, floats to six places."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        return f"{x + 0:.6f}" if isinstance(x, float) else str(x)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Asserts that a query and its SQL give the same rows."""

    def check(query, sql):
        df = query(spark, SF)
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names)
        assert plain_rows(df.columns, df.collect()) == plain_rows(names, found.fetchall())

    return check
