import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def connect(sf: str):
        con = duckdb.connect()
        for path in sorted(Path(DATA, sf).glob("*.parquet")):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        return con

    return connect


def rows_of(frame) -> list:
    """Rows of a pandas frame as comparable tuples, columns and rows in order."""
    import numpy as np

    def plain(x):
        if x is None or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, np.generic):
            x = x.item()
        if isinstance(x, np.ndarray):
            x = x.tolist()
        return float(x) if isinstance(x, int) and not isinstance(x, bool) else x

    frame = frame.astype(object).where(frame.notna(), None)
    return sorted((tuple(plain(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)
