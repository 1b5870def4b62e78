"""Reads of the catalog: filters, pages, latest rows, children, effective values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(df: DataFrame, tenant: str | None = None) -> DataFrame:
    """Rows that aren't deleted (where the table can say so), of one tenant if one is given."""
    if "deleted_at" in df.columns:
        df = df.where(F.col("deleted_at").isNull())
    return df.where(F.col("org_id") == tenant) if tenant is not None else df


def where_equal(df: DataFrame, wanted: dict) -> DataFrame:
    """Equality on known columns; unknown columns and None values are no filter."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in wanted.items() if k in df.columns and v is not None), df)


def by_id(df: DataFrame, value, tenant: str | None = None, key: str = "id") -> DataFrame:
    return visible(df, tenant).where(F.col(key) == F.lit(value))


def exists(df: DataFrame) -> bool:
    return not df.isEmpty()


def search(df: DataFrame, column: str, query: str, order: list[Column], most: int | None = 20) -> DataFrame:
    """Rows whose column holds the query, whatever the case; % and _ in it stay wild."""
    found = df.where(F.col(column).ilike(f"%{query}%")).orderBy(*order)
    return found.limit(most) if most else found


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isin(values))


def in_list_where(df: DataFrame, column: str, values: list, corrected: str, predicted: str, wanted: str) -> DataFrame:
    """Rows whose column is one of the values and whose effective text is the wanted one."""
    return in_list(df, column, values).where(effective(corrected, predicted, True) == wanted)


def approved_products(candidates: DataFrame, session: str | None = None) -> DataFrame:
    """Approved and corrected candidates whose effective label is product, in a session's order of positions."""
    rows = candidates if session is None else candidates.where(F.col("session_id") == session)
    return in_list_where(rows, "status", ["approved", "corrected"], "corrected_label", "predicted_label", "product").orderBy("session_id", "position")


def unmatched(items: DataFrame, products: DataFrame, key: str, product_key: str) -> DataFrame:
    """Items that no product has the key of; items without a key are unmatched, too."""
    known = products.select(F.col(product_key).alias("_k")).where(F.col("_k").isNotNull())
    return items.join(known, F.col(key) == F.col("_k"), "left_anti")


def suspicious_name(name: Column) -> Column:
    """Names that hold a host's ending: the page was likely blocked. A null name isn't suspicious."""
    return F.coalesce(name.contains(".com") | name.contains(".sa"), F.lit(False))


def missing_value(df: DataFrame, column: str) -> DataFrame:
    """Null or zero."""
    return df.where(F.col(column).isNull() | (F.col(column) == 0))


def effective(corrected: str, predicted: str, text: bool) -> Column:
    """The correction if there is one; an empty text is none, a zero is one."""
    c = F.col(corrected)
    return F.coalesce(F.nullif(c, F.lit("")) if text else c, F.col(predicted))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 15) -> DataFrame:
    """One page in a total order; the number starts at 1 and the size is between 1 and 100."""
    number, size = max(1, number), min(100, max(1, size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_meta(df: DataFrame, number: int = 1, size: int = 15) -> DataFrame:
    """total, current_page, last_page, from_row, to_row, has_next and has_prev of a page."""
    total = F.count("*")
    last = F.greatest(F.lit(1), F.ceil(total / size)).cast("long")
    return df.agg(total.alias("total"), F.lit(number).cast("long").alias("current_page"), last.alias("last_page"), F.lit((number - 1) * size + 1).cast("long").alias("from_row"), F.least(F.lit(number * size).cast("long"), total).alias("to_row"), (F.lit(number) < last).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def top_by(df: DataFrame, keys: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first rows of each key; Spark limits each partition before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def with_children(parents: DataFrame, children: DataFrame, on: Column, key: str, name: str, order: str, fields: list[str]) -> DataFrame:
    """Parents with an ordered array of their children, empty where there are none."""
    grouped = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias(name))
    return parents.join(grouped, on, "left").drop(key).withColumn(name, F.coalesce(name, F.array()))


def grid(df: DataFrame, text: str | None = None, category: str | None = None, priced: bool | None = None, columns: tuple[str, ...] = ("name", "sku", "brand", "category", "source")) -> DataFrame:
    """What a grid shows: a text anywhere in the named columns, one category, with or without a price."""
    if text:
        df = df.where(F.lower(F.concat_ws(" ", *columns)).contains(text.lower()))
    if category is not None:
        df = df.where(F.col("category") == category)
    if priced is not None:
        has = F.coalesce(F.col("price") > 0, F.lit(False))
        df = df.where(has if priced else ~has)
    return df


def integrity(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose parent is missing; a null key refers to nothing."""
    return children.where(F.col(key).isNotNull()).join(parents, F.col(key) == F.col(parent_key), "left_anti")


def approved_view(candidates: DataFrame, session: str | None = None) -> DataFrame:
    """Approved products in nine columns: corrections win, and a product without a name has the first 120 characters of its raw text."""
    rows = approved_products(candidates, session)
    named = F.coalesce(F.nullif(effective("corrected_name", "product_name", True), F.lit("")), F.substring("raw_text", 1, 120))
    texts = [effective(f"corrected_{f}", f, True).alias(f) for f in ("category", "brand", "unit", "description")]
    numbers = [effective(f"corrected_{f}", f, False).alias(f) for f in ("quantity", "price")]
    return rows.select(F.col("id").alias("candidate_id"), named.alias("product_name"), *texts, *numbers, F.col("raw_text").alias("source_line"))


def rules(df: DataFrame, kind: str | None = None) -> DataFrame:
    """Active rules (rule_type, rule_value, weight, is_active), of one type if one is given, the heaviest first."""
    active = df.where(F.col("is_active"))
    return (active if kind is None else active.where(F.col("rule_type") == kind)).orderBy(F.desc_nulls_last("weight"), "rule_type", "rule_value")


def product_export(products: DataFrame, brands: DataFrame, categories: DataFrame, sources: DataFrame) -> DataFrame:
    """Products with the names of their brand, category and source, null where there is none: thirteen columns in the order of ids."""
    out = products
    for name, dimension, key in (("brand", brands, "scraper_brand_id"), ("category", categories, "scraper_category_id"), ("source", sources, "source_id")):
        out = out.join(dimension.select(F.col("id").alias(f"_{name}"), F.col("name").alias(name)), F.col(key) == F.col(f"_{name}"), "left")
    return out.select("id", "external_id", "sku", "name", "price", "source_url", "is_synced", "last_scraped_at", "description", "specifications", "brand", "category", "source").orderBy("id")
