"""SQL dumps as a source: rows of INSERT statements, with quotes, escapes and statement ends respected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A text in quotes, with backslashes as escapes or as they are; then a quoted name, a comment, a mark, or any other word.
TEXTS = {True: r"'[^'\\]*+(?:(?:''|\\.)[^'\\]*+)*+'", False: r"'[^']*+(?:''[^']*+)*+'"}
REST = r"""`[^`]*+`|"[^"]*+"|--[^\n]*+|/\*.*?\*/|[(),;]|[^\s'`"(),;]++"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """Dump files as path and text; an export in parts gives a row for each part."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def unquoted(token: Column, escapes: bool) -> Column:
    """A literal's value as text: quotes go, doubled quotes and escapes are undone; NULL is null."""
    inner = F.replace(F.substring(token, F.lit(2), F.length(token) - 2), F.lit("''"), F.lit("'"))
    if escapes:
        parts = F.regexp_extract_all(inner, F.lit(r"(?s)\\.|[^\\]+"), F.lit(0))
        plain = F.create_map(*[F.lit(x) for pair in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\0", "\0")) for x in pair])
        undone = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("\\"), F.coalesce(F.try_element_at(plain, p), F.substring(p, 2, 1))).otherwise(p)), "")
        inner = F.when(F.contains(inner, F.lit("\\")), undone).otherwise(inner)
    return F.when(token.startswith("'"), inner).when(F.upper(token) != "NULL", token)


def rows(dumps: DataFrame, key: str = "path", text: str = "text", escapes: bool = True) -> DataFrame:
    """The rows of all INSERT statements of dumps: key, table, columns (names, null if the statement has none), statement and row (numbers), cells (texts).

    A file is cut into tokens, so that a semicolon or a bracket inside a text ends nothing. Statements are counted by the
    semicolons before them, rows by the brackets that open after VALUES. escapes: whether a backslash escapes inside texts
    (MySQL) or stands for itself (the standard, and `sinks.sql_dump`). One file is one task's work; exports come in parts.
    """
    found = dumps.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(f"(?s){TEXTS[escapes]}|{REST}"), F.lit(0))).alias("n", "token")).where("not startswith(token, '--') and not startswith(token, '/*')")
    order = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    cut = found.withColumn("statement", F.count(F.when(F.col("token") == ";", 1)).over(order) - F.when(F.col("token") == ";", 1).otherwise(0))
    own = Window.partitionBy(key, "statement").orderBy("n")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    word = F.upper("token")
    typed = cut.withColumn("at", F.row_number().over(own)).withColumn("values_at", F.min(F.when(word == "VALUES", F.col("n"))).over(Window.partitionBy(key, "statement")))
    insert = F.max(F.when((F.col("at") == 1) & word.isin("INSERT", "REPLACE"), True)).over(Window.partitionBy(key, "statement"))
    typed = typed.withColumn("into", F.lag(word).over(own) == "INTO")
    name = F.max(F.when(F.col("into"), F.translate("token", '`"', ""))).over(Window.partitionBy(key, "statement"))
    depth = F.sum(F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)).over(so_far)
    typed = typed.withColumns({"insert": insert, "table": name, "depth": depth}).where("insert and values_at is not null")
    typed = typed.withColumn("row", F.when(F.col("n") > F.col("values_at"), F.count(F.when((F.col("n") > F.col("values_at")) & (F.col("token") == "(") & (F.col("depth") == 1), 1)).over(so_far)).otherwise(0))
    inside = typed.where("depth > 0 and not token in ('(', ')', ',')")
    parts = inside.groupBy(key, "statement", "table", "row").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("parts"))
    columns = parts.where("row = 0").select(key, "statement", F.transform("parts", lambda p: F.translate(p["token"], '`"', "")).alias("columns"))
    body = parts.where("row > 0").select(key, "statement", "table", "row", F.transform("parts", lambda p: unquoted(p["token"], escapes)).alias("cells"))
    return body.join(columns, [key, "statement"], "left").select(key, "table", "columns", "statement", "row", "cells")


def typed(found: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """The rows of one table as columns: by the statement's names where it has them, else in the schema's order; what doesn't fit a type is null."""
    where = {f.name.lower(): k for k, f in enumerate(schema)}
    names = F.transform("columns", lambda c: F.lower(c))

    def cell(f: T.StructField) -> Column:
        at = F.when(F.col("columns").isNull(), F.lit(where[f.name.lower()])).otherwise(F.array_position(names, f.name.lower()) - 1)
        return F.get("cells", F.when(at >= 0, at).cast("int")).try_cast(f.dataType).alias(f.name)

    return found.where(F.lower("table") == table.lower()).select(*map(cell, schema))
