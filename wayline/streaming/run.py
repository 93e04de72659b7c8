"""Sources and sinks of streams over files, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.operators.stages import shared_folder


def stream_folder(spark: SparkSession) -> str:
    """A new folder that all machines see."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The parquet table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return reader.parquet(sf_dir)


def json_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON drops in a folder, as they come."""
    return spark.readStream.schema(schema).json(folder)


def appended(stream: DataFrame) -> DataFrame:
    """All that an append-only stream gives until its input is used up, from a table in the shared folder."""
    spark = stream.sparkSession
    folder = stream_folder(spark)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def upserted(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each key that an updating stream gives until its input is used up."""
    spark = stream.sparkSession
    folder = stream_folder(spark)

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number:08d}")

    query = stream.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    every = spark.read.parquet(f"{folder}/out/*")
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_batch").desc()))
    return every.withColumn("_n", newest).where("_n = 1").drop("_n", "_batch")
