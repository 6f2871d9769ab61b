"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none and runs in one JVM, as in tests, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def slices(batches, rows: int = 64, most: int = 2 << 20):
    """Arrow batches in slices of at most `rows` rows, and of about `most` bytes where it is more than a row: what Python makes of a
    slice doesn't grow with the session's batches, nor with long texts."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > most:
                n //= 2
            yield b.slice(at, n)
            at += n


def kept(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, label: str) -> DataFrame:
    """As kept, in buckets of `key`, as many as a shuffle has partitions: joins on the key leave these rows where they lie.  df should
    be dealt by the key into as many partitions.  The table's name leaves the catalogue at once, its files stay."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, key).format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out
