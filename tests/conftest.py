import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

import pytest  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from wayfold.session import local_session

    return local_session("tests", 8, 8, "6g")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    import numbers

    import numpy as np
    import pandas as pd

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        if isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_)):
            return repr(round(float(v), 6))
        return str(v)

    def rows(df):
        return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))

    def check(query, sql):
        a, b = query(spark, "/root/testdata/sf0.001").toPandas(), duck.execute(sql).fetch_df()
        assert sorted(a.columns) == sorted(b.columns)
        assert rows(a) == rows(b)

    return check
