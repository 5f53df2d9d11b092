import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

import atomloom  # noqa: E402

cloudpickle.register_pickle_by_value(atomloom)


@pytest.fixture(scope="session")
def spark():
    # Python workers get neither the repository's folder nor a path to it: all that a task needs must travel with it.
    os.environ.pop("PYTHONPATH", None)
    os.chdir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")

    def can_import(batches):
        import importlib.util

        import pyarrow as pa

        for _ in batches:
            yield pa.record_batch([pa.array([importlib.util.find_spec("atomloom") is not None])], names=["found"])

    assert not session.range(1).mapInArrow(can_import, "found boolean").first()["found"]
    yield session
    session.stop()
