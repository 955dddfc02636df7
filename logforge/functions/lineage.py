"""Cutting lineage through the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a folder of this machine if all of Spark runs in
    it; on a cluster, where executors would not see each other's files, that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="logforge-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def own_dir(spark: SparkSession) -> str:
    """The folder in it of what this application writes for itself; clear() removes it."""
    return f"{scratch_dir(spark)}/logforge-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, so that what follows recomputes nothing. The files
    stay while results that read them may be wanted; clear() removes them."""
    path = f"{own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes what materialise() wrote in this application. DataFrames that came from it can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
