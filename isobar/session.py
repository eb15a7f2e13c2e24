"""Spark sessions and scoped settings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g", warehouse: str | None = None) -> SparkSession:
    """A session on one machine, for tests and benchmarks; on a cluster, bring your own."""
    conf = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if warehouse:
        conf["spark.sql.warehouse.dir"] = warehouse
    return SparkSession.builder.config(map=conf).getOrCreate()


_local: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share (``spark.checkpoint.dir``).

    A session on one machine that has none, as in tests, gets a temporary folder; on a cluster
    without it this is an error, for no machine's own folder is seen by the others.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set")
        found = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="isobar-"))
    return f"{found.rstrip('/')}/isobar/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values) -> Iterator[None]:
    """Set Spark SQL settings inside a ``with`` block; ``_`` in a name stands for ``.``.

    The former values come back at its end, the last one set first.
    """
    before: list[tuple[str, str | None]] = []
    try:
        for name, value in values.items():
            key = name.replace("_", ".")
            before.append((key, spark.conf.get(key, None)))
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in reversed(before):
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
