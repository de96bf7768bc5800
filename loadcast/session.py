"""Session settings and the shared folder for tables written between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """All clock features and hour labels are in UTC, so the session zone must be UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table, below the session's ``spark.checkpoint.dir``.

    A machine-local folder is used only on a local master; on a cluster executors could not
    read each other's files there, so an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="loadcast-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
