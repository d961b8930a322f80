"""Sextant: retrieval and analytics over collections, expressed as Spark DataFrame plans."""

import os


def prepare(spark):
    """Let Spark's Python workers import this package from where the driver has it; returns ``spark``.

    On a cluster whose executors don't share the driver's folders, install the
    package there or pass it with ``--py-files``; this is then without effect.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    path = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in path:
        env["PYTHONPATH"] = os.pathsep.join([root, *path])
    return spark
