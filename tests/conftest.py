import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def duck(sf: str):
    """A DuckDB connection with the tables of one size as views."""
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(f"{DATA}/{sf}").glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def normal(df):
    """Rows as sorted tuples of text, floats rounded."""

    import pandas as pd

    def text(v):
        if hasattr(v, "__len__") and not isinstance(v, str | bytes):
            return str(list(v))
        if v is None or pd.isna(v):
            return "NULL"
        if isinstance(v, float):
            return str(int(v)) if float(v).is_integer() else repr(round(float(v), 6))
        return str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(text(v) for v in row) for row in df.itertuples(index=False))
