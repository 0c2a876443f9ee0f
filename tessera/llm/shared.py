"""Working storage that every executor sees, and small Spark helpers.

All intermediate tables and memory-mapped arrays live below the folder named by
``spark.checkpoint.dir``. Where that setting is absent, a local folder is made
and set on a local master (tests); on a cluster that is an error. Lineage is cut by writing a table there and reading it back, so losing an
executor never loses an intermediate result.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(root)
        atexit.register(shutil.rmtree, root[7:], ignore_errors=True)
    return root


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for one run of an operator; it is removed when the driver ends."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if path.startswith(("file:", "/")):
        atexit.register(shutil.rmtree, posix(path), ignore_errors=True)
    return path


def posix(uri: str) -> str:
    """The path under which executors open a file of the shared folder directly.

    Memory-mapped arrays need a file system that is mounted on every executor.
    """
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return uri
    raise ValueError(f"memory-mapped arrays need a mounted shared folder, not {uri!r}")


def save(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a table below the shared folder and return a reader of it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until ``df`` has no such column, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def put(path: str, data: bytes | memoryview) -> None:
    """Write one file so that it appears whole or not at all; task retries may repeat it."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)
