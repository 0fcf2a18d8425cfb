"""Let Python workers import this package when the driver found it through ``sys.path`` alone."""

import os

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
