"""From tables and text blocks of documents to products in one plan: detection, regions, rows, fields, checks.

Documents take their own way through the plan: those without products leave after detection, those whose regions hold none
fall back on their first region. What is asked of a table looks at its header and first rows alone, and what is asked of a
document at counts, so that neither is ever put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .documents import REGIONS, SIGNALS_AR, SIGNALS_EN, hits, is_numeric_table, is_product_table, products_in, words
from .sequences import runs

PATTERNS = dict(REGIONS)
#: What an unproductive table or block is, the first that applies.
TABLE_TYPES = [("totals_block", PATTERNS["totals"]), ("bank_info", PATTERNS["bank_info"]), ("payment_info", PATTERNS["payment"])]
BLOCK_TYPES = [("bank_info", PATTERNS["bank_info"]), ("payment_info", PATTERNS["payment"]), ("totals_block", PATTERNS["totals"]), ("notes", PATTERNS["notes"])]
PRODUCT_REGIONS = ["product_table", "product_list"]
FIRST_ROWS = 20


def table_heads(tables: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each table (keys, table_no, row_no, is_header, cells): its header and its first FIRST_ROWS rows."""
    body = F.array_sort(F.collect_list(F.when(~F.col("is_header"), F.struct("row_no", "cells"))))
    few = tables.where(F.col("is_header") | (F.col("row_no") <= FIRST_ROWS + 1)).groupBy(*keys, "table_no").agg(F.max(F.when(F.col("is_header"), F.col("cells"))).alias("header"), body.alias("_rows"))
    return few.select(*keys, "table_no", F.coalesce("header", F.array().cast("array<string>")).alias("header"), F.slice(F.transform("_rows", lambda r: r["cells"]), 1, FIRST_ROWS).alias("rows"))


def text_lines(blocks: DataFrame, keys: list[str]) -> DataFrame:
    return blocks.where(F.trim("text") != "").select(*keys, "block_no", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line")).withColumn("line", F.trim("line")).where("line <> ''")


def table_rows(tables: DataFrame, keys: list[str]) -> DataFrame:
    return tables.select(*keys, "table_no", "row_no", F.array_join(F.filter("cells", lambda c: F.trim(c) != ""), " | ").alias("line")).where("line <> ''")


def detected(tables: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """What documents hold: keys, score, contains_products, confidence.

    The score is five times the greater share of product words, English or Arabic, among all words, and one more for a
    numeric table; above 0.3 there are products. Words are counted line by line and summed up.
    """
    lines = text_lines(blocks, keys).select(*keys, "line").unionByName(table_rows(tables, keys).select(*keys, "line"))
    found = lines.withColumn("w", words(F.col("line"))).groupBy(*keys).agg(F.sum(F.size("w")).alias("n"), F.sum(hits(F.col("w"), SIGNALS_EN)).alias("en"), F.sum(hits(F.col("w"), SIGNALS_AR)).alias("ar"))
    numeric = table_heads(tables, keys).groupBy(*keys).agg(F.max(is_numeric_table(F.col("header"), F.col("rows"))).alias("numeric"))
    score = 5 * F.coalesce(F.try_divide(F.greatest("en", "ar").cast("double"), F.col("n")), F.lit(0.0)) + F.when(F.col("numeric"), 1.0).otherwise(0.0)
    told = found.join(numeric, keys, "full").withColumn("score", score)
    return told.select(*keys, "score", (F.col("score") > 0.3).alias("contains_products"), F.least(F.lit(0.70), 0.3 + 0.15 * F.col("score")).alias("confidence"))


def table_region(header: Column, rows: Column) -> Column:
    """product_table, else what the header and the first three rows speak of, else metadata."""
    said = F.concat_ws(" ", F.array_join(header, " | "), F.array_join(F.transform(F.slice(rows, 1, 3), lambda r: F.array_join(r, " | ")), " "))
    return F.when(is_product_table(header, rows), "product_table").otherwise(F.coalesce(*[F.when(said.rlike(p), name) for name, p in TABLE_TYPES], F.lit("metadata")))


def block_region(place: Column, text: Column) -> Column:
    """The kind of a block at a place from 0: the first block is the document's header, and so are the next two that name a kind of document."""
    head = (place == 0) | (place < 3) & text.rlike(PATTERNS["header"])
    return F.when(head, "document_header").otherwise(F.coalesce(*[F.when(text.rlike(p), name) for name, p in BLOCK_TYPES], F.lit("product_list")))


def regions(tables: DataFrame, blocks: DataFrame, keys: list[str], documents: DataFrame) -> DataFrame:
    """Regions of the documents (keys, contains_products) that hold products: keys, table_no or first_block and last_block, region_type, region (from 0).

    Tables come first, then runs of blocks of one kind; blank blocks are none. A document whose regions hold no products has
    its first region taken for a list of them.
    """
    wanted = documents.where("contains_products").select(*keys)
    of_tables = table_heads(tables.join(wanted, keys, "left_semi"), keys).select(*keys, F.lit(0).alias("_kind"), "table_no", F.lit(None).cast("int").alias("first_block"), F.lit(None).cast("int").alias("last_block"), table_region(F.col("header"), F.col("rows")).alias("region_type"))
    placed = blocks.join(wanted, keys, "left_semi").withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("block_no")) - 1).where(F.trim("text") != "")
    typed = placed.select(*keys, "block_no", block_region(F.col("place"), F.trim("text")).alias("region_type"))
    of_blocks = runs(typed, keys, ["block_no"], "region_type").groupBy(*keys, "run", "region_type").agg(F.min("block_no").cast("int").alias("first_block"), F.max("block_no").cast("int").alias("last_block"))
    every = of_tables.unionByName(of_blocks.select(*keys, F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("table_no"), "first_block", "last_block", "region_type"))
    order = Window.partitionBy(*keys).orderBy("_kind", "table_no", "first_block")
    numbered = every.withColumn("region", F.row_number().over(order) - 1).withColumn("_any", F.max(F.col("region_type").isin(PRODUCT_REGIONS)).over(Window.partitionBy(*keys)))
    kind = F.when(~F.col("_any") & (F.col("region") == 0), "product_list").otherwise(F.col("region_type"))
    return numbered.withColumn("region_type", kind).select(*keys, "region", "table_no", "first_block", "last_block", "region_type")


def extracted_products(tables: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Products of documents from their tables (keys, table_no, row_no, is_header, cells) and blocks (keys, block_no, text).

    Lines are those of regions that hold products, in the order of regions; labels, fields, descriptions and flags are
    those of `documents.products_in`. Documents without products, and those with neither tables nor text, give nothing.
    """
    found = regions(tables, blocks, keys, detected(tables, blocks, keys)).where(F.col("region_type").isin(PRODUCT_REGIONS))
    rows = table_rows(tables, keys).join(found.where("table_no is not null").select(*keys, "table_no", "region", "region_type"), [*keys, "table_no"]).select(*keys, "region", "region_type", F.lit(0).alias("_a"), F.col("row_no").cast("long").alias("_b"), "line")
    spans = found.where("first_block is not null").select(*[F.col(k).alias(f"_{k}") for k in keys], "first_block", "last_block", "region", "region_type")
    inside = [*[F.col(k) == F.col(f"_{k}") for k in keys], F.col("block_no").between(F.col("first_block"), F.col("last_block"))]
    lines = text_lines(blocks, keys).join(spans, inside).select(*keys, "region", "region_type", F.col("block_no").cast("int").alias("_a"), F.col("at").cast("long").alias("_b"), "line")
    order = Window.partitionBy(*keys).orderBy("region", "_a", "_b")
    return products_in(rows.unionByName(lines).withColumn("line_no", F.row_number().over(order) - 1).select(*keys, "line_no", "line", "region_type"), keys)
