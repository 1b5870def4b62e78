"""Rows of CSV files and sheets to product candidates, each table by its own header.

A table's header row is resolved once, to the columns of each field; its rows then meet that one row by a join, so that many
unlike tables, in Arabic and English, go through one plan, and a table of any length is dealt over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import inferred_quantity, number_plain, number_smart, quantity
from ..functions.text import filled, model_code, squeezed
from ..functions.units import unit
from .documents import validated
from .strategies import product_category

# For each field, the column names that hold it, the preferred first; English and Arabic.
FIELD_COLUMNS = {
    "product_name": ["product_name", "product", "item", "description", "name", "model", "اسم المنتج", "اسم الصنف", "الصنف", "الوصف", "البيان"],
    "category": ["category", "cat", "classification", "تصنيف", "فئة"],
    "brand": ["brand", "maker", "manufacturer", "ماركة", "العلامة التجارية"],
    "quantity": ["quantity", "qty", "qnty", "الكمية", "كمية"],
    "unit": ["unit", "uom", "وحدة", "unit_of_measure"],
    "price": ["price", "unit_price", "rate", "سعر", "سعر الوحدة", "الافرادي", "الافرادى"],
    "total": ["total", "amount", "الإجمالي", "الاجمالي", "المجموع"],
    "model_code": ["model", "model_no", "sku", "code", "item_code", "كود"],
}
#: What a row of a table is worth, and below what a candidate is reviewed.
ROW_CONFIDENCE, REVIEW_BELOW = 0.92, 0.75


def column_name(cell: Column) -> Column:
    """A header cell as a name: lower case, trimmed, runs of white space as one underscore."""
    return F.regexp_replace(F.lower(F.trim(cell)), r"\s+", "_")


def places(header: Column, fields: dict[str, list[str]] = FIELD_COLUMNS) -> Column:
    """For each field, the columns (from 0) that hold it in a header (array of cells), the preferred first.

    Of columns of one name the last counts.
    """
    names = F.transform(header, column_name)

    def of(known: list[str]) -> Column:
        wanted = F.array(*[F.lit(k.replace(" ", "_")) for k in known])
        return F.filter(F.transform(wanted, lambda k: F.size(header) - F.array_position(F.reverse(names), k)), lambda at: at < F.size(header))

    return F.struct(*[of(known).alias(f) for f, known in fields.items()])


def headers(rows: DataFrame, keys: list[str], table: str = "table_no", row: str = "row_no", order: str = "row_no") -> DataFrame:
    """A row for each table: keys, table, head_no (of its first row), columns (array), places, offset.

    offset: rows of the file's tables before this one, headers aside. The tables of a file are few; their rows aren't gathered.
    """
    first = rows.groupBy(*keys, table).agg(F.min(row).alias("head_no"), F.min_by("cells", row).alias("columns"), (F.count("*") - 1).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(table).rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("places", places(F.col("columns"))).drop("_n")


def candidates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Product candidates of tables (keys: the file; table_no, row_no, cells): one for each row that names a product.

    The first row of a table is its header, whatever it holds. The first filled column of a field counts. A missing
    quantity is inferred from total and price, else read from the name, and then gives a missing unit. position counts the rows
    of a file from 0, its tables one after the other. Of rows of one name (whatever the case), quantity and price in a file
    the first stays. Rows shorter than the header lack its last fields; cells beyond the header are left out.
    """
    told = rows.join(headers(rows, keys), [*keys, "table_no"]).where(F.col("row_no") > F.col("head_no"))

    def cell(field: str) -> Column:
        values = F.transform(F.col(f"places.{field}"), lambda at: F.trim(F.get("cells", at)))
        return F.get(F.filter(values, lambda v: v != ""), F.lit(0))

    read = told.select(*keys, (F.col("offset") + F.col("row_no") - F.col("head_no") - 1).alias("position"), "cells", *[cell(f).alias(f"_{f}") for f in FIELD_COLUMNS]).where("_product_name is not null")
    price, total = number_plain(F.col("_price")), number_plain(F.col("_total"))
    numbers = read.withColumns({"price": price, "total": total}).withColumn("_known", F.coalesce(number_smart(F.col("_quantity")), inferred_quantity(F.col("total"), F.col("price"))))
    spoken = F.when(F.col("_known").isNull(), quantity(F.col("_product_name")))
    numbers = numbers.withColumn("_spoken", spoken)
    raw = F.coalesce(F.col("_unit"), F.when(F.col("_known").isNull() & F.col("_spoken.quantity").isNotNull(), F.col("_spoken.unit")))
    named = numbers.withColumn("raw_unit", raw).withColumn("normalized_unit", unit(F.col("raw_unit"))["unit"])
    text = F.array_join(F.transform("cells", lambda c: F.trim(c)), " ", "")
    found = named.select(
        *keys, "position", F.lit("product").alias("predicted_label"), F.col("_product_name").alias("product_name"), F.coalesce("_category", product_category(F.col("_product_name"))).alias("category"), F.col("_brand").alias("brand"),
        F.coalesce("_known", "_spoken.quantity").alias("quantity"), "raw_unit", "normalized_unit", F.coalesce("normalized_unit", "raw_unit").alias("unit"), "price", "total", F.coalesce("_model_code", model_code(text)).alias("model_code"),
        filled(text).alias("raw_text"), F.lit(ROW_CONFIDENCE).alias("confidence"), F.lit(ROW_CONFIDENCE < REVIEW_BELOW).alias("needs_review"),
    )
    once = found.groupBy(*keys, squeezed(F.col("product_name")).alias("_name"), F.col("quantity").alias("_q"), F.col("price").alias("_p")).agg(F.min_by(F.struct(*[c for c in found.columns if c not in keys]), "position").alias("_row"))
    return validated(once.select(*keys, "_row.*"))
