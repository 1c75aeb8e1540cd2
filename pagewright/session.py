"""What a session needs before queries run in it: the package in Python workers, and unions that lose no rows."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def reachable(spark: SparkSession) -> None:
    """Name the package's folder in the workers' module path; on a cluster the package is installed there or alike."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    sound_unions(spark)


def sound_unions(spark: SparkSession) -> None:
    """Unions are dealt anew before they are grouped or joined.

    This version of Spark takes a union of tables that are dealt by the same key as dealt by it, and leaves out the exchange;
    where adaptive execution then reads one of them in other parts, rows of a key do not meet (seen with a difference of two
    lists: equal addresses on both sides were reported on one).
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
