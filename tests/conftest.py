import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark():
    from lexforge.session import session

    s = session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Evaluate a function of columns over rows of values."""
    from pyspark.sql import functions as F

    def run(f, *rows, types="string"):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        kinds = types if isinstance(types, (list, tuple)) else [types] * len(rows[0])
        schema = ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)) + ", n int"
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)
        out = df.select("n", f(*[F.col(f"c{i}") for i in range(len(kinds))]).alias("v")).orderBy("n").collect()
        return [r.v for r in out]

    return run
