"""Names and small texts in the shared folders, written and read by the driver alone."""

from __future__ import annotations

from pyspark.sql import SparkSession


def files_of(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    place, files = files_of(spark, path)
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    place, files = files_of(spark, path)
    out = files.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    place, files = files_of(spark, path)
    opened = files.open(place)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
    opened.close()
    return text


def delete(spark: SparkSession, path: str) -> None:
    place, files = files_of(spark, path)
    files.delete(place, True)
