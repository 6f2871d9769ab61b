"""Ranks of whole lists, of any length, without a task for each list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import kept


def ranked_by_range(rows: DataFrame, key: str, *order: Column | str, parts: int | None = None, name: str = "rank") -> DataFrame:
    """rows with their place from 1 within `key` in the given order.

    Rows are sorted in ranges of (key, order); each range numbers its own rows of a key, and what earlier ranges hold of the
    key is added.  A list that fills many ranges is spread over as many tasks.  Equal rows of an order share a range.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(rows.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    held = dealt.groupBy(key, "_part").agg(F.count("*").alias("_n")).select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part", key).orderBy(*order)))
    out = own.alias("o").join(held.alias("h"), (F.col("o._part") == F.col("h._part")) & F.col(f"o.{key}").eqNullSafe(F.col(f"h.{key}")))
    return out.select(*[F.col(f"o.{c}") for c in rows.columns], (F.col("h._before") + F.col("o._own")).alias(name))
