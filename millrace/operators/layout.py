"""Lines of tables from the places of words on pages: rows by height, a header by vote, columns by gaps.

Words of a row are grouped once, and a page's rows see its header by windows over the page; words that come dealt by pages
are not dealt again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import once

# Words of table headers, English and Arabic; points of a page.
HEADER_WORDS = ["product", "description", "desc", "item", "name", "qty", "quantity", "unit", "uom", "price", "rate", "amount", "total", "sl#", "discount", "vat", "tax", "اسم", "كمية", "سعر", "الوحدة", "اجمالي"]
ROW_HEIGHT, CELL_GAP, SLACK, TOP_SHARE, LEAST_HITS = 4, 5.0, 15.0, 0.12, 2


def word_rows(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words (keys, text, x0, x1, top) by rows: keys, y (the height, rounded to ROW_HEIGHT points), words (array, left to right), top (the row's lowest).

    Words of one place are ordered by their right edge and text.
    """
    y = (F.bround(F.col("top") / ROW_HEIGHT) * ROW_HEIGHT).cast("long")
    parts = F.sort_array(F.collect_list(F.struct(F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), F.col("text").cast("string").alias("text"))))
    return words.where("text is not null and x0 is not null and top is not null").groupBy(*keys, y.alias("y")).agg(parts.alias("words"), F.max("top").alias("top"))


def line_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def header_hits(words: Column) -> Column:
    """How many header words the row holds, anywhere in its text."""
    return _hits(F.lower(line_text(words)))


def _hits(lower: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.contains(lower, F.lit(k)), 1).otherwise(0) for k in HEADER_WORDS])


def anchors(words: Column) -> Column:
    """The left edges of a row's cells: a word begins one if it stands CELL_GAP or more behind the word before it."""
    begins = F.filter(F.transform(words, lambda w, i: F.struct(w["x0"].alias("x0"), ((i == 0) | (w["x0"] - F.get(words, i - 1)["x1"] >= CELL_GAP)).alias("first"))), lambda w: w["first"])
    return F.transform(begins, lambda w: w["x0"])


def cells(words: Column, edges: Column) -> Column:
    """A row's words dealt to columns: each to the last edge that isn't over SLACK to its right, or to the first column; `-` where none is."""
    of = F.transform(words, lambda w: F.struct(F.greatest(F.size(F.filter(edges, lambda e: e <= w["x0"] + SLACK)) - 1, F.lit(0)).alias("column"), w["text"].alias("text")))
    filled = once(of, lambda dealt: F.transform(F.sequence(F.lit(0), F.size(edges) - 1), lambda k: F.array_join(F.transform(F.filter(dealt, lambda w: w["column"] == k), lambda w: w["text"]), " ")))
    return F.transform(filled, lambda c: F.when(c == "", "-").otherwise(c))


def table_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of pages (keys) from their words: keys, y, line.

    A page's header is the row with most header words, at least LEAST_HITS, the upper of equals, below the top TOP_SHARE of
    the page, where letterheads stand. Where there is one, each line is the cells under its columns between bars, the lines
    above it included; else the words of a row with blanks between them.
    """
    page, known = Window.partitionBy(*keys), reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rows = word_rows(words, keys).withColumn("text", line_text(F.col("words"))).withColumn("lower", F.lower("text"))
    scored = rows.select(*keys, "y", "top", "words", "text", _hits(F.col("lower")).alias("hits")).withColumn("from_y", F.max("top").over(page) * TOP_SHARE)
    named = known & (F.col("hits") >= LEAST_HITS) & (F.col("y") >= F.col("from_y"))
    head = F.max_by(F.when(named, anchors(F.col("words"))), F.when(named, F.struct("hits", -F.col("y"))))
    told = scored.withColumn("edges", head.over(page))
    return told.select(*keys, "y", F.when(F.col("edges").isNotNull(), F.array_join(cells(F.col("words"), F.col("edges")), "|")).otherwise(F.col("text")).alias("line"))
