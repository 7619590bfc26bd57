import importlib.util
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

RELEASE = """
import time
from pyspark.sql import SparkSession
from orrery.checkpoints import released

spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "512m").config("spark.ui.enabled", "false").getOrCreate()
sc = spark.sparkContext._jsc.sc()
while sc.getExecutorMemoryStatus().size() < 3:
    time.sleep(0.2)
released(spark)
sc.listenerBus().waitUntilEmpty()
found = sc.statusStore().executorList(True)
print("COLLECTED", *sorted(found.apply(i).totalGCTime() > 0 for i in range(found.size()) if found.apply(i).id() != "driver"))
"""


def test_release_reaches_every_executor(tmp_path):
    """Their heaps stayed as large as the largest step had made them."""
    (tmp_path / "home" / "work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # workers keep their logs in Spark's home
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(tmp_path / "home"), "SPARK_LOCAL_DIRS": str(tmp_path), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable}
    ran = subprocess.run([sys.executable, "-c", RELEASE], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "COLLECTED True True" in ran.stdout, ran.stderr[-2000:]
