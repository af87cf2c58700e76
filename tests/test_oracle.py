"""Every registered query against its DuckDB oracle on sf0.01 (the driver's gate)."""

import pytest

from conftest import SF_CHECK
from eoframe.plans import load_all
import oracle_check
from oracle_check import rows

QUERIES = load_all()
oracle_check.STRICT = True  # exact float values, as a strict value-hash would compare them


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.oracle))
def test_matches_oracle(spark, duck, name):
    q = QUERIES[name]
    got = q.build(spark, SF_CHECK).toPandas()
    want = duck.execute(q.oracle).df()
    c1, r1 = rows(got)
    c2, r2 = rows(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.oracle))
def test_runs_without_oracle(spark, name):
    df = QUERIES[name].build(spark, SF_CHECK)
    assert df.count() >= 0


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert len(df.columns) > 0
    assert df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
