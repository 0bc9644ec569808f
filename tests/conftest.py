import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    shared = tempfile.mkdtemp(prefix="spark-")
    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.default.parallelism", "2").config("spark.sql.codegen.wholeStage", "false").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", f"file://{shared}").config("spark.driver.memory", "4g").config("spark.local.dir", shared).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows_of(df):
    """Rows of a pandas frame by sorted column name, comparable across engines."""
    import math

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v) or type(v).__name__ in ("NAType", "NaTType"):
            return None
        if hasattr(v, "item"):
            v = v.item()
            if isinstance(v, float) and math.isnan(v):
                return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(repr(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False))
