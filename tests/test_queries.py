"""Every query with SQL gives the rows that the SQL gives; the others give rows."""

import pandas as pd
import pytest

from cairn.plans import queries as plans


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = plans.QUERIES[name](spark, sf_dir).toPandas()
    if name not in plans.SQL:
        assert len(got)
        return
    want = duck.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    got, want = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=1e-9)


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
