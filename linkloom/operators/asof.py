"""As-of join: for each row the version of its key that held at its time.

Both sides are sorted together, by key and time, in ranges over all tasks, and the last version is carried on to the rows after it.  A range
may begin within a key; it then takes the version that the ranges before it left, of which there is one row each.  So a key with
a third of all rows is split by time like any other, and nothing is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.session import cut


def asof_join(rows: DataFrame, versions: DataFrame, key: str, time: str, since: str, out: str = "version") -> DataFrame:
    """rows (with key and time) and, as the struct out, the row of versions (with key and since) with the greatest since up to their time.

    Of versions with one key and since the one with the greatest values counts.  Rows without a key or time, and those before the first version,
    have a null; versions without either never hold.  Columns of versions must have an order.
    """
    timed = F.col(key).isNotNull() & F.col(time).isNotNull()
    kept = F.struct(*[F.col(c) for c in versions.columns])
    left = rows.where(timed).select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in rows.columns]).alias("_row"))
    right = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("_k"), F.col(since).alias("_t"), F.lit(0).alias("_side"), kept.alias("_version"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = ["_k", "_t", "_side", "_version"]
    ranged = cut(both.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_part", F.spark_partition_id())
    last = F.last("_version", ignorenulls=True)
    running = Window.partitionBy("_part", "_k").orderBy("_t", "_side", "_version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = ranged.withColumn("_held", last.over(running)).where("_side = 1").join(F.broadcast(_begins(ranged)), ["_part", "_k"], "left")
    version = F.coalesce("_held", "_before").alias(out)
    untimed = rows.where(~timed).select("*", F.lit(None).cast(right.schema["_version"].dataType).alias(out))
    return carried.select("_row.*", version).unionByName(untimed)


def _begins(ranged: DataFrame) -> DataFrame:
    """For each range that begins within a key, that key and its version before the range."""
    ends = ranged.groupBy("_part").agg(F.min("_k").alias("first"), F.max("_k").alias("last"))
    newest = ranged.where("_side = 0").groupBy("_part", "_k").agg(F.max(F.struct("_t", "_version")).alias("n"))
    told = ends.join(newest, (newest["_part"] == ends["_part"]) & (F.col("_k") == F.col("last")), "left").select(ends["_part"], "first", "last", "n._version")
    out, key, version = [], None, None
    for r in sorted(told.collect(), key=lambda r: r[0]):  # a row for each range
        if r["first"] == key and version is not None:
            out.append((r[0], key, version))
        if r["last"] != key:
            key, version = r["last"], None
        version = r["_version"] if r["_version"] is not None else version
    return ranged.sparkSession.createDataFrame(out, ranged.select("_part", "_k", F.col("_version").alias("_before")).schema)
