"""Joins: stars, anti joins, nearest preceding rows, similar texts, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_set


def star(fact: DataFrame, dimensions: list[tuple[DataFrame, Column]]) -> DataFrame:
    """A fact table with its dimensions by left joins; Spark broadcasts those of a known small size by itself."""
    for dimension, on in dimensions:
        fact = fact.join(dimension, on, "left")
    return fact


def not_yet(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return incoming.join(known.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def nearest_preceding(rows: DataFrame, keys: list[str], order: list[str], is_anchor: Column, value: Column, name: str) -> DataFrame:
    """Each row with the value of the last anchor at or before it; one window, no join."""
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.when(is_anchor, value), ignorenulls=True).over(over))


def similar(left: DataFrame, right: DataFrame, threshold: float, most: int = 1, least_letters: int = 3, prefer: str | None = None) -> DataFrame:
    """Pairs (left_id, right_id, jaccard, rank) of texts whose word sets are alike, the best `most` of each left row.

    left(id, text) and right(id, text). For a Jaccard similarity of s, two sets of sizes a and b share a word among the
    first a - ceil(s a) + 1 of the rarer-first order; only those prefixes meet, in an equi-join, where the sizes and the places of
    the shared word still leave room for s; what is left is verified. Ties go to the higher `prefer` of the right side (a
    column, for example how often a row was used), then to the smaller id.
    """
    def sets(df: DataFrame, side: str, more: list = ()) -> DataFrame:
        return df.select(F.col("id").alias(f"{side}_id"), word_set(F.col("text"), least_letters).alias(f"{side}_words"), *more).where(F.size(f"{side}_words") > 0)

    a, b = sets(left, "left"), sets(right, "right", [(F.col(prefer) if prefer else F.lit(0)).alias("preferred")])
    rarity = a.select(F.explode("left_words").alias("w")).unionByName(b.select(F.explode("right_words").alias("w"))).groupBy("w").agg(F.count("*").alias("n"))

    def prefixes(df: DataFrame, side: str) -> DataFrame:
        ranked = df.select(f"{side}_id", F.size(f"{side}_words").alias(f"{side}_size"), F.explode(f"{side}_words").alias("w")).join(rarity, "w")
        ranked = ranked.withColumn(f"{side}_k", F.row_number().over(Window.partitionBy(f"{side}_id").orderBy("n", "w")))
        return ranked.where(F.col(f"{side}_k") <= F.col(f"{side}_size") - F.ceil(F.col(f"{side}_size") * threshold) + 1).select("w", f"{side}_id", f"{side}_size", f"{side}_k")

    most_shared = 1 + F.least(F.col("left_size") - F.col("left_k"), F.col("right_size") - F.col("right_k"))
    room = (most_shared + 1e-9) * (1 + threshold) >= threshold * (F.col("left_size") + F.col("right_size"))
    alike = (F.least("left_size", "right_size") + 1e-9 >= threshold * F.greatest("left_size", "right_size")) & room
    pairs = prefixes(a, "left").join(prefixes(b, "right"), "w").where(alike).select("left_id", "right_id").distinct()
    both = pairs.join(b, "right_id").join(a, "left_id")
    shared = F.size(F.array_intersect("left_words", "right_words"))
    scored = both.select("left_id", "right_id", "preferred", shared.alias("k"), (F.size("left_words") + F.size("right_words")).alias("n")).withColumn("jaccard", F.col("k") / (F.col("n") - F.col("k"))).where(F.col("jaccard") >= threshold)
    best = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("jaccard"), F.desc("preferred"), "right_id"))
    return scored.withColumn("rank", best).where(F.col("rank") <= most).select("left_id", "right_id", "jaccard", "rank")


def corrected(candidates: DataFrame, examples: DataFrame, threshold: float = 0.60, fields: tuple[str, ...] = ("product_name", "unit", "brand", "category")) -> DataFrame:
    """Candidates (id, text and the fields) with the fields of the most similar correction example (id, text, use_count, corrected_<field>), where it has them.

    Examples below the threshold correct nothing; of equally similar ones the one that was used more counts. Adds example_id and
    similarity, null where none applied.
    """
    best = similar(candidates.select("id", "text"), examples.select("id", "text", "use_count"), threshold, prefer="use_count").select(F.col("left_id").alias("id"), F.col("right_id").alias("example_id"), F.col("jaccard").alias("similarity"))
    said = examples.select(F.col("id").alias("example_id"), *[F.nullif(F.trim(f"corrected_{f}"), F.lit("")).alias(f"_{f}") for f in fields])
    joined = candidates.join(best.join(said, "example_id", "left"), "id", "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in candidates.columns], "example_id", "similarity")


def zipped(left: DataFrame, right: DataFrame, position: str) -> DataFrame:
    """Rows at the same position; the longer side's tail stays, with nulls on the other."""
    return left.join(right, position, "full_outer")


def outside(points: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Points (x, y) that no box (x0, x1, y0, y1) of the same keys holds."""
    b = boxes.select(*[F.col(k).alias(f"_{k}") for k in keys], "x0", "x1", "y0", "y1")
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return points.join(b, [*same, inside], "left_anti")


def boxes_by_text(rows: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, text) with the box of the block (keys, block_no, text, bbox) that says the same, but for outer blanks; of several the last block's.

    Blank texts mean no block.
    """
    said = F.trim("text")
    known = blocks.where(said != "").groupBy(*[F.col(k).alias(f"_{k}") for k in keys], said.alias("_text")).agg(F.max_by("bbox", "block_no").alias("bbox"))
    return rows.join(known, [*[F.col(k) == F.col(f"_{k}") for k in keys], said == F.col("_text")], "left").drop("_text", *[f"_{k}" for k in keys])


def with_url_keys(products: DataFrame, keys: DataFrame) -> DataFrame:
    """Products (url_key, sku) with the sku that a key list (url_key, sku) states, where it isn't blank; of several the greatest."""
    stated = keys.where(F.trim("sku") != "").groupBy("url_key").agg(F.max("sku").alias("_sku"))
    return products.join(stated, "url_key", "left").withColumn("sku", F.coalesce("_sku", "sku")).drop("_sku").select(products.columns)


def with_sku_prices(products: DataFrame, prices: DataFrame) -> DataFrame:
    """Products (sku, price) with the prices of a list (sku, special_price, orig_price), whatever the case of the sku.

    A special price wins and the original one becomes original_price; else the original one is the price; else what the page
    said stays. Prices of 0 and below are none. Of several entries of a sku the lowest prices count.
    """
    def real(c: str):
        return F.when(F.col(c) > 0, F.col(c))

    stated = prices.where(F.trim("sku") != "").groupBy(F.upper(F.trim("sku")).alias("_sku")).agg(F.min(real("special_price")).alias("_special"), F.min(real("orig_price")).alias("_orig"))
    joined = products.join(stated, F.upper(F.trim(products["sku"])) == F.col("_sku"), "left")
    return joined.select(*[F.coalesce("_special", "_orig", "price").alias(c) if c == "price" else F.col(c) for c in products.columns], F.when(F.col("_special").isNotNull(), F.col("_orig")).alias("original_price"))
