"""Runs queries in a process of its own whose Python workers can't import the package: only the driver's path has it."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import importlib
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", "file://" + sys.argv[4]).config("spark.sql.session.timeZone", "UTC").getOrCreate()

def seen(frames):
    import importlib.util
    import pandas as pd
    for f in frames:
        yield pd.DataFrame({"has": [importlib.util.find_spec("symbolake") is not None]})

assert not spark.range(1).mapInPandas(seen, "has boolean").first().has, "workers have the package"
queries = importlib.import_module(sys.argv[2]).QUERIES
for name in sys.argv[5:]:
    print(name, queries[name](spark, sys.argv[3]).count())
"""


def run(module: str, names: list[str], data: str, folder: Path) -> None:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = Path(__file__).resolve().parent.parent
    got = subprocess.run([sys.executable, "-c", SCRIPT, str(root), module, data, str(folder), *names], cwd=folder, env=env, capture_output=True, text=True, timeout=900, check=False)
    assert got.returncode == 0, got.stdout[-500:] + got.stderr[-3000:]
