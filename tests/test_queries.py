"""Every registered query of the document operators against its SQL, or that it runs where it has none."""

import math
from collections import Counter

import pandas as pd
import pytest

from quire.plans import catalog

SF = "/root/testdata/sf0.001"


def value(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        return value(v.item())
    return round(v, 7) if isinstance(v, float) else v


def bag(frame, columns):
    return Counter(tuple(map(value, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, duck, name):
    mine, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE[name]).fetchdf()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert bag(mine, columns) == bag(theirs, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
