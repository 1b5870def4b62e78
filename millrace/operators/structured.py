"""Products in JSON that pages carry: JSON-LD blocks of any nesting, and lists assigned inside scripts, as VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import price_text
from ..functions.text import filled

# Where JSON-LD and scripts keep their lists.
CONTAINERS = ['$["@graph"]', "$.itemListElement", "$.mainEntity", "$.item", "$.itemOffered", "$.hasVariant"]
LIST_MARKERS = [r"window\.__products\s*=\s*", r'"products"\s*:\s*', r"salla\.product\.list\s*=\s*", r"productsData\s*=\s*"]
PRICE_PLACES = ["$.offers.price", "$.offers[0].price", "$.offers.lowPrice", "$.offers[0].lowPrice", "$.offers.priceSpecification.price", "$.offers[0].priceSpecification.price"]


def json_ld_blocks(html: Column) -> Column:
    """The JSON-LD blocks of a page, as texts in order; each ends at its own closing tag."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))


def text_at(v: Column, path: str) -> Column:
    """A text or number at a path of a VARIANT, as text; null where there is none or a blank one."""
    return filled(F.trim(F.try_variant_get(v, path, "string")))


def objects_in(v: Column, depth: int = 6) -> Column:
    """The value and all that its arrays and containers hold, level by level, as an array of VARIANT.

    A container holds an array or one object. Levels deeper than `depth` are left out.
    """
    def below(x: Column) -> Column:
        held = [F.coalesce(F.try_variant_get(x, p, "array<variant>"), F.array(F.try_variant_get(x, p, "variant"))) for p in CONTAINERS]
        return F.filter(F.concat(F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>")), *held), lambda y: y.isNotNull())

    level, out = F.array(v), [F.array(v)]
    for _ in range(depth):
        level = F.flatten(F.transform(level, below))
        out.append(level)
    return F.concat(*out)


def is_product(v: Column) -> Column:
    """Whether the object's @type is Product or holds it."""
    kinds = F.coalesce(F.try_variant_get(v, '$["@type"]', "array<string>"), F.array(F.try_variant_get(v, '$["@type"]', "string")))
    return F.coalesce(F.array_contains(kinds, "Product"), F.lit(False))


def product_fields(v: Column) -> list[Column]:
    """name, sku, url, description, brand (a text, or the name of an object or of the first of some), price (above 0) and currency of a product."""
    brand = F.coalesce(*[text_at(v, p) for p in ("$.brand.name", "$.brand[0].name", "$.brand[0]")], F.when(F.try_variant_get(v, "$.brand.name", "string").isNull() & ~F.coalesce(F.try_variant_get(v, "$.brand", "string"), F.lit("{")).startswith("{"), text_at(v, "$.brand")))
    return [
        *[text_at(v, f"$.{k}").alias(k) for k in ("name", "sku", "url", "description")], brand.alias("brand"), F.coalesce(*[price_text(text_at(v, p)) for p in PRICE_PLACES]).alias("price"),
        F.coalesce(*[text_at(v, p) for p in ("$.offers.priceCurrency", "$.offers[0].priceCurrency")]).alias("currency"),
    ]


def json_ld_products(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Products of JSON-LD blocks: keys, block, n (within the block), and product_fields.

    A block is a product, a list of things, a graph, or a list of items, nested at will. What stands inside a product (its
    variants) counts as products too if it says so. Blocks that aren't JSON give nothing.
    """
    blocks = pages.select(*keys, F.posexplode(json_ld_blocks(F.col(html))).alias("block", "json")).select(*keys, "block", F.try_parse_json("json").alias("v")).where("v is not null")
    found = blocks.select(*keys, "block", F.posexplode(F.filter(objects_in(F.col("v")), is_product)).alias("n", "v"))
    return found.select(*keys, "block", "n", *product_fields(F.col("v")))


def script_lists(pages: DataFrame, keys: list[str], html: str = "html", markers: list[str] = LIST_MARKERS) -> DataFrame:
    """Lists that scripts assign to known names: keys, marker (number of the name), at (of its uses, from 0), json (the list's text).

    A list ends at the bracket that closes its first one: the text behind the name is cut into strings, brackets and the rest, and
    brackets outside of strings are counted by a running sum. Lists that never close are left out.
    """
    part = r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]]|[^"\[\]]++|\""""
    named = F.array(*[F.struct(F.lit(k).alias("marker"), F.split(html, m + r"(?=\[)").alias("rest")) for k, m in enumerate(markers)])
    uses = pages.select(*keys, F.explode(named).alias("m")).where("size(m.rest) > 1").select(*keys, "m.marker", F.posexplode(F.slice("m.rest", 2, F.size("m.rest") - 1)).alias("at", "rest"))
    cut = uses.select(*keys, "marker", "at", F.regexp_extract_all("rest", F.lit(part), F.lit(0)).alias("parts"))
    each = cut.select(*keys, "marker", "at", F.posexplode(F.transform("parts", lambda p: F.when(p == "[", 1).when(p == "]", -1).otherwise(0))).alias("_part", "step")).where("step <> 0")
    own = [*keys, "marker", "at"]
    depth = F.sum("step").over(Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    ends = each.withColumn("depth", depth).where("depth = 0").groupBy(*own).agg(F.min("_part").alias("stop"))
    return cut.join(ends, own).select(*own, F.array_join(F.slice("parts", F.lit(1), F.col("stop") + 1), "").alias("json"))


def script_products(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Products of the lists inside scripts: keys, marker, at, n (within the list), and product_fields with a price of the item's own if it has no offer.

    Lists that aren't JSON give nothing, and so do items that aren't objects with a name.
    """
    lists = script_lists(pages, keys, html).select(*keys, "marker", "at", F.try_variant_get(F.try_parse_json("json"), "$", "array<variant>").alias("items"))
    found = lists.select(*keys, "marker", "at", F.posexplode("items").alias("n", "v"))
    own = F.coalesce(*[price_text(text_at(F.col("v"), p)) for p in ("$.price.amount", "$.price.value", "$.price")])
    fields = found.select(*keys, "marker", "at", "n", *product_fields(F.col("v")), own.alias("_own"))
    return fields.withColumn("price", F.coalesce("price", "_own")).drop("_own").where("name is not null")
