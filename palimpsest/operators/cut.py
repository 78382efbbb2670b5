"""Cutting a plan where its result is used more than once."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, deleted when the driver's Python ends.

    On a cluster that folder must be set: a folder of the driver's machine would be another one on each executor. Only a
    session that runs wholly on one machine gets one of its own where it is unset.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        own = sc._jsc.sc().getCheckpointDir()
        if own.isDefined():
            folder = own.get()
        elif sc.master.startswith("local"):
            import tempfile

            folder = tempfile.mkdtemp(prefix="palimpsest-")
        else:
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    path = f"{folder.rstrip('/')}/palimpsest-{name}-{uuid.uuid4().hex}"
    atexit.register(delete, sc, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The table as written into a shared folder.

    A table is columnar and compressed, survives the loss of executors, and unlike checkpoint()
    computes its input once.
    """
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(sc, path: str) -> None:
    try:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone before us
        pass
