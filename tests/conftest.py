import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from widestat.session import _LOCAL_CONF  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = (SparkSession.builder.master("local[*]").appName("widestat-tests")
               .config("spark.sql.shuffle.partitions", "8"))
    for k, v in _LOCAL_CONF.items():
        builder = builder.config(k, v)
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    # Tests set their own shared folder only because none is configured.
    if not (s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()):
        root = tempfile.mkdtemp(prefix="widestat-tests-")
        s.sparkContext.setCheckpointDir(root)
        s.conf.set("spark.checkpoint.dir", root)
    yield s
    s.stop()


@pytest.fixture
def workdir(tmp_path):
    return str(tmp_path)


def rows(df, *cols):
    """Rows as sorted tuples (order-insensitive comparisons)."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
