"""The library's functions under names that SQL can call: expressions as SQL functions, the line machine as a table function.

The scalar functions are SQL bodies, so that a query that calls them keeps one plan of built-in expressions. Their patterns and
tables are those of the modules that hold the DataFrame versions; tests compare the two.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import STOP_WORDS
from .units import ALIASES


def literal(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _table(which: int) -> str:
    return f"map({', '.join(literal(x) for a, u in ALIASES.items() for x in (a, u[which]))})"


def _unit(which: int) -> str:
    spelled = rf"trim(regexp_replace(lower(raw), {literal(r'\s+')}, ' '))"
    bare = rf"regexp_replace({spelled}, {literal(r'\.+$')}, '')"
    return f"coalesce(try_element_at({_table(which)}, {spelled}), try_element_at({_table(which)}, {bare}))"


_KEPT = rf"regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), {literal(r'(?U)[^\w\s-]')}, ''), {literal(r'[\s_]+')}, '-'), '-+', '-')"
_SLUG = f"substring(regexp_replace({_KEPT}, '^-+|-+$', ''), 1, 500)"
_PRICE = rf"try_cast(replace(regexp_extract(translate(value, '،', ','), {literal(r'\d[\d,]*(?:\.\d+)?')}, 0), ',', '') AS DOUBLE)"

#: name: parameters, type, body
FUNCTIONS = {
    "slugify": ("name STRING", "STRING", f"CASE WHEN {_SLUG} = '' THEN 'product' ELSE {_SLUG} END"),
    "squeezed": ("value STRING", "STRING", f"trim(regexp_replace(lower(value), {literal(r'\s+')}, ' '))"),
    "external_id": ("label STRING", "STRING", f"substring(regexp_replace(lower(trim(label)), {literal(r'(?U)\W+')}, '_'), 1, 80)"),
    "content_hash": ("name STRING, price STRING, sku STRING", "STRING", "sha2(concat_ws('|', coalesce(name, ''), coalesce(price, ''), coalesce(sku, '')), 256)"),
    "word_set": ("value STRING", "ARRAY<STRING>", f"array_distinct(regexp_extract_all(lower(value), {literal(r'(?U)\b\w{3,}\b')}, 0))"),
    "keywords": ("value STRING", "ARRAY<STRING>", f"array_except(regexp_extract_all(lower(value), '[a-zء-ي]{{4,}}', 0), array({', '.join(map(literal, STOP_WORDS))}))"),
    "model_code": ("value STRING", "STRING", rf"nullif(regexp_extract(value, {literal(r'\b[A-Z0-9]{3,}(?:[-/][A-Z0-9]+)*\b')}, 0), '')"),
    "number_plain": ("value STRING", "DOUBLE", "try_cast(replace(value, ',', '') AS DOUBLE)"),
    "number_smart": ("value STRING", "DOUBLE", "try_cast(replace(value, ',', CASE WHEN length(value) - length(replace(value, ',', '')) = 1 AND NOT contains(value, '.') THEN '.' ELSE '' END) AS DOUBLE)"),
    "price_text": ("value STRING", "DOUBLE", f"CASE WHEN {_PRICE} > 0 THEN {_PRICE} END"),
    "inferred_quantity": ("total DOUBLE, price DOUBLE", "DOUBLE", "CASE WHEN price > 0 AND abs(try_divide(total, price) - bround(try_divide(total, price))) <= 0.05 THEN bround(try_divide(total, price)) END"),
    "unit": ("raw STRING", "STRING", _unit(0)),
    "unit_category": ("raw STRING", "STRING", _unit(1)),
}


def line_items():
    """The table function line_items(TABLE(rows) PARTITION BY document ORDER BY line): doc, item, name, quantity, price.

    Its table has the document in the first column, of any type, and a column `line`; others are ignored. A line of two numbers
    and more with at most two words ends an item, with the first number as quantity and the second as price; the lines before
    it are its name. Lines behind the last such line give nothing. One document's rows come in one call, one after the other.
    """
    from pyspark.sql.functions import udtf
    from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    class LineItems:
        def __init__(self):
            self.name, self.item = [], 0

        @staticmethod
        def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
            if not lines.isTable or "line" not in lines.dataType.fieldNames():
                raise ValueError("line_items takes a table with the document first and a column `line`")
            return AnalyzeResult(StructType().add("doc", lines.dataType.fields[0].dataType).add("item", IntegerType()).add("name", StringType()).add("quantity", DoubleType()).add("price", DoubleType()))

        def eval(self, row):
            import re

            line = row["line"] or ""
            found = re.findall(r"\d[\d,]*(?:\.\d+)?", line)
            words = re.findall(r"[A-Za-z؀-ۿ]+", line)
            if len(found) >= 2 and len(words) <= 2:
                if self.name:
                    self.item += 1
                    quantity, price = (float(x.replace(",", "")) for x in found[:2])
                    yield row[0], self.item, " ".join(self.name), quantity, price
                self.name = []
            elif line.strip():
                self.name.append(line.strip())

    return udtf(LineItems)


def register(spark: SparkSession) -> list[str]:
    """Makes FUNCTIONS and line_items callable from the session's SQL; names of built-in functions are never taken. Returns the names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("line_items", line_items())
    return [*FUNCTIONS, "line_items"]
