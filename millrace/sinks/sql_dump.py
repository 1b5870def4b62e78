"""Tables as SQL: statements of rows, batches of rows, and column types of another dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sql_literal
from ..streaming.changes import shared_folder

#: Spark's types in MySQL; anything else is a text.
MYSQL = {T.LongType: "BIGINT", T.IntegerType: "BIGINT", T.DoubleType: "DOUBLE", T.FloatType: "DOUBLE", T.BooleanType: "TINYINT(1)", T.TimestampType: "DATETIME", T.DateType: "DATE", T.BinaryType: "LONGBLOB"}


def values(df: DataFrame):
    """One row as SQL literals between brackets."""
    parts = [sql_literal(F.col(f.name), isinstance(f.dataType, T.NumericType)) for f in df.schema]
    return F.concat(F.lit("("), F.array_join(F.array(*parts), ", "), F.lit(")"))


def statements(df: DataFrame, table: str, keep: list[str] = ()) -> DataFrame:
    """One INSERT a row: the kept columns and `statement`."""
    return df.select(*keep, F.concat(F.lit(f"INSERT INTO {table} VALUES "), values(df), F.lit(";")).alias("statement"))


def batched_statements(df: DataFrame, table: str, order: str, size: int = 500) -> DataFrame:
    """One INSERT for `size` rows of each partition's key range: `statement`. A range of rows is one batch's group.

    Rows are checkpointed first: their partitions are read twice and must be the same both times.
    """
    shared_folder(df.sparkSession)
    rows = df.withColumn("_v", values(df)).repartitionByRange(order).sortWithinPartitions(order).checkpoint().withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    least = rows.groupBy("_p").agg(F.min("_m").alias("_first"))
    batch = F.floor((F.col("_m") - F.col("_first")) / size)
    grouped = rows.join(F.broadcast(least), "_p").groupBy("_p", batch.alias("_b")).agg(F.array_sort(F.collect_list(F.struct(order, "_v"))).alias("_r"))
    return grouped.select(F.concat(F.lit(f"INSERT INTO {table} VALUES "), F.array_join(F.transform("_r", lambda r: r["_v"]), ", "), F.lit(";")).alias("statement"))


def create_table(schema: T.StructType, table: str) -> str:
    """CREATE TABLE in MySQL for a schema."""
    columns = ", ".join(f"`{f.name}` {MYSQL.get(type(f.dataType)) or (f.dataType.simpleString().upper() if isinstance(f.dataType, T.DecimalType) else 'LONGTEXT')}{'' if f.nullable else ' NOT NULL'}" for f in schema)
    return f"CREATE TABLE `{table}` ({columns});"
