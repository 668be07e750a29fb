"""Readers for the source formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {".parquet": "parquet", ".json": "json", ".jsonl": "json", ".csv": "csv", ".orc": "orc", ".txt": "text"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder, recursively: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def read(spark: SparkSession, path: str, kind: str | None = None, schema=None) -> DataFrame:
    """A table of any known format, named by kind or by the path's extension; csv files have a header."""
    found = kind or next((f for end, f in FORMATS.items() if path.rstrip("/").endswith(end)), None)
    if found is None:
        raise ValueError(f"no reader for {path}")
    reader = spark.read.format(found)
    if schema is not None:
        reader = reader.schema(schema)
    return (reader.option("header", True) if found == "csv" else reader).load(path)


def inventory(spark: SparkSession, folder: str, most_bytes: int = 1 << 30, most_opened: int = 256 << 20) -> DataFrame:
    """Every file with its path below the folder, size, sha256 and kind; one beyond most_bytes has no hash and says so.

    Of those, files beyond most_opened are not even opened for their kind, which is null then.
    """
    found = files(spark, folder)
    root = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    below = F.substring_index(root, "/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    magic = F.hex(F.substring("content", 1, 4))
    kind = F.when(magic == "504B0304", "zip").when(magic == "7F454C46", "elf").when(F.startswith(magic, F.lit("4D5A")), "pe").when(magic == "89504E47", "png").when(magic == "50415231", "parquet").otherwise("other")
    own = [below.alias("path"), F.col("length").alias("size")]
    # the filters on length reach the scan, so that it opens no file that a branch does not hash or name
    hashed = found.where(F.col("length") <= most_bytes).select(*own, F.sha2("content", 256).alias("sha256"), F.lit("hashed").alias("hash_status"), kind.alias("kind"))
    large = found.where(F.col("length") > most_bytes)
    none = F.lit(None).cast("string")
    named = large.where(F.col("length") <= most_opened).select(*own, none.alias("sha256"), F.lit("too_large").alias("hash_status"), kind.alias("kind"))
    unread = large.where(F.col("length") > most_opened).select(*own, none.alias("sha256"), F.lit("too_large").alias("hash_status"), none.alias("kind"))
    return hashed.unionByName(named).unionByName(unread)
