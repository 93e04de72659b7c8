"""Tables between the stages of a long plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see. Where the session names none, one of this machine, if it is the only one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='wayline-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def tabled(df: DataFrame) -> DataFrame:
    """The same, as a table of its own with a true size: the sizes that Spark guesses for joins of checkpoints multiply in a loop."""
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``tabled`` wrote for these; nothing may be read from them any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {path.rpartition("/")[0] for path in df.inputFiles()}:
            at = context._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the folder that all machines share, without the plan that led to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
