"""Tables that are written once below the folder of ``spark.checkpoint.dir`` and read many times."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it.

    What feeds several branches of a plan is computed once, lineage ends there, and a lost executor loses nothing.
    Where no folder is set, a local one is made on a local master (tests); on a cluster that is an error. It is removed when the driver ends.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(root)
        atexit.register(shutil.rmtree, root[7:], ignore_errors=True)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if path.startswith(("file:", "/")):
        atexit.register(shutil.rmtree, "/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
