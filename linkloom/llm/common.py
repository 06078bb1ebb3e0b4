"""Paths, checkpoints and small helpers that the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.session import cut, shared_dir

_tables: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """As cut(), as a compressed Parquet table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linkloom-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> int:
    """Deletes the tables that written() has made in this session; results that still read them must be done."""
    gone = 0
    while _tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def forget(df: DataFrame) -> None:
    """Deletes the table of written() that df is; nothing may read it any more."""
    spark, names = df.sparkSession, {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    for at in [t for t in _tables if t.rpartition("/")[2] in names]:
        _tables.remove(at)
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with each row's place, from 0, in an order of all rows."""
    rows = cut(df.orderBy(*order)).withColumns({"_part": F.spark_partition_id(), name: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    start, starts = 0, []
    for part, n in sorted(tuple(r) for r in rows.groupBy("_part").count().collect()):  # a row for each partition
        starts.append((part, start))
        start += n
    starts = df.sparkSession.createDataFrame(starts, "_of int, _start long")
    return cut(rows.join(F.broadcast(starts), F.col("_part") == F.col("_of")).withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_of", "_start"))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further ones can't clash with what an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "UTF-8")) % n
