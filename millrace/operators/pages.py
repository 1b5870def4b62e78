"""Product data in HTML pages: prices by a cascade, structured data, titles and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import price_text

#: Where a page states its price, surest first; the first group holds it. The first pattern is for JSON-LD blocks, the others for the page.
PRICE_PATTERNS = [
    ("json_ld", r'(?i)"price"\s*:\s*"?([\d.,]+)'),
    ("meta", r'(?is)<meta[^>]*(?:product:price:amount|og:price:amount)[^>]*content\s*=\s*["\']([^"\']+)'),
    ("itemprop", r'(?is)<[^>]*itemprop\s*=\s*["\']price["\'][^>]*content\s*=\s*["\']([^"\']+)'),
    ("itemprop_text", r'(?is)<[^>]*itemprop\s*=\s*["\']price["\'][^>]*>\s*([^<]+)'),
    ("data", r'(?is)data-(?:product-)?price(?:-amount)?\s*=\s*["\']([^"\']+)'),
    ("class", r'(?is)<[^>]*class\s*=\s*["\'][^"\']*\bprice\b[^"\']*["\'][^>]*>\s*(?:<[^>]+>\s*)*([^<]*\d[^<]*)'),
    ("currency", r"(?is)((?:SAR|ر\.س|ريال)\s*[\d.,]+|[\d.,]+\s*(?:SAR|ر\.س|ريال))"),
    ("script", r'(?is)["\']?price["\']?\s*[:=]\s*["\']?([\d.,]+)'),
]


def page_price(html: Column) -> Column:
    """Struct of price and the level that gave it; the first level with a number above 0."""
    tried = []
    for name, pattern in PRICE_PATTERNS:
        if name == "json_ld":
            found = F.get(F.filter(F.transform(json_ld(html), lambda block: F.regexp_extract(block, PRICE_PATTERNS[0][1], 1)), lambda x: x != ""), F.lit(0))
        else:
            found = F.regexp_extract(html, pattern, 1)
        value = price_text(F.regexp_replace(found, r"ر\.س", " "))
        tried.append(F.when(value > 0, F.struct(value.alias("price"), F.lit(name).alias("level"))))
    return F.coalesce(*tried)


def json_ld(html: Column) -> Column:
    """All JSON-LD blocks of a page, as texts."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))


def heading(html: Column) -> Column:
    """Text of the first h1, without tags; null if there is none."""
    inner = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return F.nullif(F.trim(F.regexp_replace(inner, "<[^>]+>", "")), F.lit(""))


def links(html: Column) -> Column:
    """Distinct targets of anchors, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"'), F.lit(1)))


def page_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, white space collapsed; entities stay as they are."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " "))


def breadcrumb(crumbs: Column, from_end: int = 1) -> Column:
    """The last (or an earlier) crumb that is not the home page."""
    real = F.filter(crumbs, lambda c: ~F.lower(F.trim(c)).isin("home", "الرئيسية", ""))
    return F.try_element_at(real, F.lit(-from_end))


def sitemap_urls(xml: Column, holds: str = "") -> Column:
    """Addresses of a sitemap that hold a text, in order, each once."""
    return F.array_distinct(F.filter(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)), lambda u: u.contains(holds)))


#: Where a listing says how many pages it has; the first group holds the number.
PAGE_COUNTS = [r'data-(?:last-page|total-pages|pages)\s*=\s*["\']?(\d+)', r'href\s*=\s*["\'][^"\']*page=(\d+)', r'"(?:totalPages|last_page|total_pages)"\s*:\s*(\d+)']


def page_count(html: Column) -> Column:
    """The most pages that a listing speaks of, in attributes, links or scripts; 1 if it doesn't."""
    found = F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in PAGE_COUNTS])
    return F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(found, lambda n: n.try_cast("int"))), F.lit(1)))
