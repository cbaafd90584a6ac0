"""Session defaults: UTC, adaptive execution, Arrow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(name: str = "kinelake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Folders of our own, by application, where the session names none.
_OWN: dict[str, str] = {}


def is_local(master: str) -> bool:
    """Driver and executors are one process, with one file system."""
    return master == "local" or master.startswith("local[")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Unset, it is a folder of this application's own in local mode, and an error on a cluster, where executors would write to their own disks."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = spark.sparkContext.applicationId
        if name not in _OWN:
            _OWN[name] = "file://" + tempfile.mkdtemp(prefix="kinelake-")
        root = _OWN[name]
    return f"{root.rstrip('/')}/kinelake/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
