"""Mission documents: one JSON file per mission folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """id string, name string, status string, createdAt string, video struct<filename:string,size:long,duration:double>,
location struct<center:struct<lat:double,lng:double>,altitude:double,coordinateSystem:string>,
flight struct<path:struct<type:string,coordinates:array<array<double>>>,points:array<struct<lat:double,lng:double,altitude:double>>,altitude:double,duration:double>,
processing struct<jobId:string,stage:string,progress:double,message:string>,
reconstruction struct<status:string,footprint:struct<type:string,coordinates:array<array<array<double>>>>,modelId:string,viewerUrl:string,modelUrl:string>, error string"""


def parse_missions(docs: DataFrame) -> DataFrame:
    """Mission rows of JSON texts (column value); unreadable ones are skipped."""
    d = docs.select(F.from_json("value", SCHEMA).alias("m")).select("m.*").filter(F.col("id").isNotNull())
    return d.select("*", F.col("processing.stage").alias("stage"), F.col("processing.progress").alias("progress"), F.col("reconstruction.modelId").alias("model_id"),
                    F.col("reconstruction.viewerUrl").alias("viewer_url"), F.col("reconstruction.modelUrl").alias("model_url"))


def read_missions(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "mission.json").text(path, wholetext=True)
    return parse_missions(docs.select("value"))
