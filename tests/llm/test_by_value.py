"""Executors need not have the package: all queries from another folder, with the path set in the driver alone."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
for name, query in entry.queries().items():
    if name.startswith("op") or name in ("pipeline", "rate_limit_default", "kmv_blake2b_estimate", "laplace_release_parity"):
        print(name, query(spark, "/root/testdata/sf0.001").count())
"""


def test_queries_without_the_package_on_the_executors(tmp_path):
    (tmp_path / "run.py").write_text(SCRIPT)
    done = subprocess.run([sys.executable, "run.py", str(Path(__file__).resolve().parents[2])], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len([line for line in done.stdout.splitlines() if line.split()[-1].isdigit()]) == 14
