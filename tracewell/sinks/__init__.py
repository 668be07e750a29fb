"""Writers: evidence bundles, snapshots, extracted files and bounded text.

All write through Spark to the folder that is given, which driver and
executors share; what commits a bundle or a snapshot is a last small file.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _note(spark: SparkSession, name: str, value: dict) -> None:
    """A small file, which must not be there yet."""
    path, fs = _path(spark, name)
    out = fs.create(path, False)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()


def _noted(spark: SparkSession, name: str) -> dict | None:
    _, fs = _path(spark, name)
    if not fs.exists(_path(spark, name)[0]):
        return None
    return json.loads("".join(r[0] for r in spark.read.text(name).collect()))  # one line


def commitment(df: DataFrame) -> dict:
    """Rows and an order-free digest of a table: the sum of its rows' hashes, in two halves."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, i, 15), 16, 10).cast("decimal(38,0)"))
    n, a, b = df.agg(F.count("*"), part(1), part(16)).first()
    return {"rows": n, "digest": f"{int(a or 0):x}-{int(b or 0):x}"}


def write_bundle(records: DataFrame, folder: str) -> dict:
    """Records as JSON lines, and their commitment beside them."""
    records.write.json(f"{folder}/records")
    told = commitment(records)
    _note(records.sparkSession, f"{folder}/manifest.json", told | {"schema": records.schema.json()})
    return told


def read_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a bundle; one whose content does not match its commitment is refused."""
    from pyspark.sql import types as T

    told = _noted(spark, f"{folder}/manifest.json")
    if told is None:
        raise ValueError("the bundle was not finished")
    records = spark.read.schema(T.StructType.fromJson(json.loads(told["schema"]))).json(f"{folder}/records")
    if commitment(records) != {k: told[k] for k in ("rows", "digest")}:
        raise ValueError("the bundle's content does not match its commitment")
    return records


def write_snapshot(df: DataFrame, folder: str, expected: int | None) -> int:
    """The next snapshot of a table, if the last one is `expected` (None: there is none); else it is refused and nothing changes."""
    spark = df.sparkSession
    if head(spark, folder) != expected:
        raise ValueError("the table has moved on")
    n = (expected or 0) + 1
    own = f"data-{uuid.uuid4().hex}"  # no other writer's; the note names it
    df.write.parquet(f"{folder}/{n:08d}/{own}")
    try:
        _note(spark, f"{folder}/{n:08d}/done.json", {"snapshot": n, "data": own})
    except Py4JJavaError as e:
        path, fs = _path(spark, f"{folder}/{n:08d}/{own}")
        fs.delete(path, True)
        raise ValueError("another writer made this snapshot") from e
    return n


def _snapshots(spark: SparkSession, folder: str) -> list[int]:
    path, fs = _path(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(x) for x in names if x.isdigit() and fs.exists(_path(spark, f"{folder}/{x}/done.json")[0]))


def head(spark: SparkSession, folder: str) -> int | None:
    """The last finished snapshot."""
    return max(_snapshots(spark, folder), default=None)


def read_snapshot(spark: SparkSession, folder: str, snapshot: int | None = None) -> DataFrame:
    n = head(spark, folder) if snapshot is None else snapshot
    if n is None or n not in _snapshots(spark, folder):
        raise ValueError("there is no such snapshot")
    return spark.read.parquet(f"{folder}/{n:08d}/{_noted(spark, f'{folder}/{n:08d}/done.json')['data']}")


def retain(spark: SparkSession, folder: str, keep: int) -> list[int]:
    """Delete all but the last `keep` snapshots; which ones went."""
    gone = _snapshots(spark, folder)[: -keep or None]
    for n in gone:
        path, fs = _path(spark, f"{folder}/{n:08d}")
        fs.delete(path, True)
    return gone


def write_text(df: DataFrame, column: str, folder: str, most_chars: int) -> DataFrame:
    """Texts of at most most_chars characters, one a row, as JSON lines; returns the rows that were too long for it."""
    fits = F.length(column) <= most_chars
    df.where(fits).select(column).write.json(folder)
    return df.where(~fits)


def extract(entries: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """Write the wanted entries of archives as files below folder/tree, which must not be there; returns path, sha256 and size of each.

    entries: as `zip_entries` with their content; wanted: archive, entry, sha256
    (that of the inventory it was chosen from) and path, where it goes below the
    tree.  Each task writes to a name of its own and then moves the file to its
    path, so a task that runs twice leaves one copy.  All goes to a folder beside
    the target, which gets its name by one rename after every file is verified.
    If an entry is not there, was not readable, has another digest, or a path
    leaves the tree or meets another (in any case of letters, or as a folder of
    it), nothing is left and a ValueError says how many had which problem.
    """
    spark = entries.sparkSession
    target, fs = _path(spark, folder)
    if fs.exists(target):
        raise ValueError("the folder is there already")
    staging = f"{folder}.{uuid.uuid4().hex}"
    low = F.lower("path")
    parts = F.split(low, "/")
    unsafe = F.col("path").isNull() | F.rlike("path", F.lit(r"^[A-Za-z]:|[\\\x00]")) | F.exists(parts, lambda x: x.isin("", ".", ".."))
    above = wanted.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("__low"), low.alias("__of"))
    taken = above.groupBy("__low").agg((F.bool_or(F.col("__low") == F.col("__of")) & (F.count("*") > 1)).alias("__taken")).where("__taken")
    chosen = wanted.withColumn("__low", low).join(taken, "__low", "left").join(entries.select("archive", "entry", "status", "content", F.col("sha256").alias("__found")), ["archive", "entry"], "left")
    problem = (
        F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "ok", F.col("status")).when(unsafe, "unsafe_path").when(F.col("__taken"), "path_taken")
        .when(~F.col("__found").eqNullSafe(F.col("sha256")), "other_digest")
    )

    def write(frames):
        import hashlib

        import pandas as pd
        from pyarrow import fs as arrow_fs

        there, root = arrow_fs.FileSystem.from_uri(staging if "://" in staging else "file://" + staging)
        for frame in frames:
            told = []
            for path, digest, trouble, data in frame.itertuples(index=False, name=None):
                if trouble is None and hashlib.sha256(data).hexdigest() != digest:
                    trouble = "other_digest"
                if trouble is None:
                    own, final = f"{root}/parts/{uuid.uuid4().hex}", f"{root}/tree/{path}"
                    there.create_dir(f"{root}/parts", recursive=True)
                    with there.open_output_stream(own) as out:
                        out.write(data)
                    there.create_dir(final.rsplit("/", 1)[0], recursive=True)
                    there.move(own, final)
                told.append((path, digest, len(data) if data is not None else None, trouble))
            yield pd.DataFrame(told, columns=["path", "sha256", "size", "problem"]).astype({"size": "Int64"})

    rows = chosen.select("path", "sha256", problem.alias("problem"), "content").mapInPandas(write, "path string, sha256 string, size long, problem string")
    own, _ = _path(spark, staging)
    try:
        rows.write.parquet(f"{staging}/extracted")
        bad = spark.read.parquet(f"{staging}/extracted").where("problem IS NOT NULL").groupBy("problem").count().collect()  # at most one row for each kind of problem
        if bad:
            raise ValueError("not extracted: " + ", ".join(f"{r['count']} {r['problem']}" for r in sorted(bad, key=lambda r: r["problem"])))
        fs.delete(_path(spark, f"{staging}/parts")[0], True)
        jvm = spark.sparkContext._jvm
        none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(own, target, none)  # refuses a target that is there
    except Exception:
        fs.delete(own, True)
        raise
    return spark.read.parquet(f"{folder}/extracted").select("path", "sha256", "size")
