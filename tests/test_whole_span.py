"""Queries over the whole table against their registered SQL."""

from pathlib import Path

import duckdb
import pytest

from catalog import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["complete_rectangle", "dynamic_effect", "forecast_actual_join", "validation_summary"])
def test_every_row_counts(spark, name):
    registry.load_all()
    sql = registry.oracle(name)
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    found = registry.QUERIES[name](spark, SF)
    want = db.execute(f"SELECT {', '.join(found.columns)} FROM ({sql})").fetchall()
    order = lambda rows: sorted((tuple(float(v) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    got, want = order(map(tuple, found.collect())), order(want)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == pytest.approx(y, abs=2e-4) if isinstance(x, float) else x == y for x, y in zip(a, b)), (a, b)
