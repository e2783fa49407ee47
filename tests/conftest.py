import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from barloom.session import build_session

    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    return d


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def rows_of(frame, columns):
    """Rows of a pandas frame in one form, sorted."""
    f = frame[columns].astype(object)
    return sorted(map(repr, f.where(f.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="session")
def same():
    def check(df, rel):
        a, b = df.toPandas(), rel.df()
        assert sorted(a.columns) == sorted(b.columns)
        columns = sorted(a.columns)
        assert rows_of(a, columns) == rows_of(b, columns)

    return check
