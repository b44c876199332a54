import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from hostlens.session import ENGINE_CONF, ensure_checkpoint_dir

    scratch = tempfile.mkdtemp(prefix="hostlens-test-")
    b = (SparkSession.builder.master("local[4]").appName("hostlens-tests")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse")))
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture()
def scratch_dir():
    return tempfile.mkdtemp(prefix="hostlens-case-")
