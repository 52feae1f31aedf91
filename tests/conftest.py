import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from lakeshift.session import get_session
    s = get_session("local[4]", shuffle_partitions=4,
                    extra={"spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb
    def connect(sf_dir):
        con = duckdb.connect()
        for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
                  "benchmark labels conversations").split():
            p = f"{sf_dir}/{t}.parquet"
            if os.path.exists(p):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
        return con
    return connect


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]
