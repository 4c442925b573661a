import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("auditspan-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.codegen.cache.maxEntries", "1000")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows(spark):
    """Rows of dicts under an explicit schema, missing keys NULL."""
    def make(schema, *dicts):
        from pyspark.sql.types import StructType
        st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        return spark.createDataFrame([tuple(d.get(f.name) for f in st) for d in dicts], st)
    return make
