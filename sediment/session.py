"""Spark sessions with the settings the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "sediment", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; master and sizes come from the cluster's own settings or `conf`."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if not os.environ.get("SPARK_MASTER") and "spark.master" not in conf:
        builder = builder.master("local[*]")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from its checkout; elsewhere install it or use --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
