"""Session builder and the settings the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str | None = None, app: str = "tessera", **extra: str) -> SparkSession:
    """A session with the defaults above; ``extra`` overrides them (dots written as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench; shuffle partitions follow the cores."""
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", f"--driver-memory {memory} pyspark-shell")
    return build(f"local[{cpus}]", spark__sql__shuffle__partitions=str(cpus), spark__ui__showConsoleProgress="false")
