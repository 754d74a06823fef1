"""Helpers that run inside tasks travel with the job: an executor has no copy of the package."""

import importlib
import pickletools
import pkgutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle

import siftline

#: All but the one that runs on the driver only.
MODULES = sorted(m.name for m in pkgutil.walk_packages(siftline.__path__, "siftline.") if m.name != "siftline.tables")
ELSEWHERE = """
import sys
sys.path.append(sys.argv[1])
from pyspark.sql import SparkSession
from siftline.plans import record_queries, text_queries
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
assert text_queries.t6_known_redactions(spark, sys.argv[2]).where("redacted LIKE '%[REDACTED:%'").count() > 0
assert record_queries.t11_long_feed(spark, sys.argv[2]).count() > 0
"""


@pytest.mark.parametrize("name", MODULES)
def test_helpers_are_pickled_by_value(name):
    module = importlib.import_module(name)
    for helper in [f for f in vars(module).values() if callable(f) and getattr(f, "__module__", None) == name]:
        told = []
        for op, arg, _ in pickletools.genops(cloudpickle.dumps(getattr(helper, "func", helper))):
            if "UNICODE" in op.name:
                told.append(arg)
            assert op.name != "STACK_GLOBAL" or not told[-2].startswith("siftline"), f"{helper}: {told[-2:]}"


def test_workers_do_not_import_the_package(tmp_path, sf):
    """Run from a folder that holds no copy, as workers look into the folder that Spark was started in."""
    subprocess.run([sys.executable, "-c", ELSEWHERE, str(Path(siftline.__file__).parents[1]), sf], cwd=tmp_path, check=True, timeout=300)
