import math
import os
from pathlib import Path

import pytest

DATA = Path(os.environ.get("SF_DIR", "/root/testdata/sf0.001"))


def rows_of(frame):
    frame = frame[sorted(frame.columns)]

    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
            return ""
        try:
            return str(round(float(v), 6)) if not isinstance(v, (str, bool)) else str(v)
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(map(value, r)) for r in frame.itertuples(index=False))


def catalogue():
    import __spark_entry__ as e

    return e.queries(), e.oracle_sql()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_all_queries_match_their_sql(spark):
    import duckdb

    queries, oracles = catalogue()
    assert set(oracles) <= set(queries)
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name, sql in oracles.items():
        got, want = queries[name](spark, str(DATA)).toPandas(), db.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns), name
        assert rows_of(got) == rows_of(want), name
        assert len(got), name
