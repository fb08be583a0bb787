"""Tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of applications that have no shared one.
_own: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset and all runs on one machine, as in tests, a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        _own[app] = root = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="quillscan-")
    return root.rstrip("/")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly to all tasks: few bytes that are much work lie in one file or partition otherwise."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
