"""Rows in order: runs, batches, first occurrences, lines of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_occurrence(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Numbers the runs of equal values within the keys, from 0: adds `run`."""
    over = Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(over))).cast("int"), F.lit(1))
    return df.withColumn("_c", F.when(F.row_number().over(over) == 1, 0).otherwise(changed)).withColumn("run", F.sum("_c").over(over.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def batches(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Adds `batch`: rows of a key in order, `size` at a time, from 0."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size))


def after_header(df: DataFrame, keys: list[str], order: str, is_header: Column, is_stop: Column) -> DataFrame:
    """Rows after the first header of a document up to the first stop behind it."""
    doc = Window.partitionBy(*keys)
    with_header = df.withColumn("_h", F.min(F.when(is_header, F.col(order))).over(doc))
    stop = F.min(F.when(is_stop & (F.col(order) > F.col("_h")), F.col(order))).over(doc)
    return with_header.withColumn("_s", stop).where((F.col(order) > F.col("_h")) & (F.col("_s").isNull() | (F.col(order) < F.col("_s")))).drop("_h", "_s")


def continued(df: DataFrame, keys: list[str], order: str, starts: Column, text: str) -> DataFrame:
    """Joins rows that don't start anything to the row before that does: keys, item (from 1), text."""
    over = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    items = df.withColumn("item", F.count(F.when(starts, 1)).over(over)).where("item > 0")
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return items.groupBy(*keys, "item").agg(F.array_join(F.transform(parts, lambda p: p[text]), " ").alias(text))


def anchored_lines(words: DataFrame, keys: list[str], top: str, gap: float) -> DataFrame:
    """Lines of words: a new one starts where a word is over `gap` from the top of the line's first word. Adds `line`.

    The first word of a line decides, which no window frame can say; each page is one bounded group.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema) + ", line int"

    def cluster(pdf):
        pdf = pdf.sort_values([top, "x0"]) if "x0" in pdf else pdf.sort_values(top)
        line, first, out = -1, None, []
        for t in pdf[top]:
            if first is None or abs(t - first) > gap:
                line, first = line + 1, t
            out.append(line)
        return pdf.assign(line=out)

    return words.groupBy(*keys).applyInPandas(cluster, schema)


def bucketed(value: Column, size: float) -> Column:
    """The nearest multiple of a size, halves to the even one."""
    return F.bround(value / size) * size


def positioned(df: DataFrame, groups: list[str], order: list[str], keys: list[str]) -> DataFrame:
    """Adds `position`: rows of a key numbered from 0 over all their groups in order, then within each group."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*groups, *order)) - 1)


def bounding_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The least box around all boxes (x0, y0, x1, y1) of a key."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def column_of(x0: Column, anchors: Column, slack: float = 15.0) -> Column:
    """The number of the rightmost anchor at or before x0 + slack; the first if none is."""
    return F.greatest(F.size(F.filter(anchors, lambda a: a <= x0 + slack)) - 1, F.lit(0))
