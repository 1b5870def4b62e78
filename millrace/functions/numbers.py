"""Numbers, quantities and prices in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_smart(text: Column) -> Column:
    """A single comma without a point is a decimal comma; else commas go."""
    one = (F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) == 1) & ~text.contains(".")
    return F.when(one, F.replace(text, F.lit(","), F.lit("."))).otherwise(F.replace(text, F.lit(","), F.lit(""))).try_cast("double")


def number_plain(text: Column) -> Column:
    """Commas go."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def numbers(text: Column) -> Column:
    """All numbers of a text, as doubles, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), number_plain)


def integerish(value: Column, within: float = 0.05) -> Column:
    return F.abs(value - F.bround(value)) <= within


#: Unit words as they stand behind a quantity, English and Arabic, in their order of precedence.
UNIT_WORDS = (
    r"pcs?|pieces?|units?|nos?\.?|sets?|kits?|bags?|rolls?|cartons?|ctns?|boxes?|pairs?|lots?|jobs?|visits?|"
    r"kgs?|kilogram|grams?|g\b|gr\b|tons?|tonnes?|mt\b|lbs?|pounds?|m\b|mtrs?|meters?|metres?|cm|mm|ft|feet|foot|inches?|in\b|"
    r"m2|sqm|m3|cbm|litr?e?s?|ltrs?|l\b|ml\b|btu|hp|kw|"
    r"عدد|قطعة|قطعه|قطع|حبة|حبه|حبات|وحدة|وحده|كيلو|كيلوغرام|كلغ|غرام|جرام|طن|أطنان|متر|أمتار|متر\s*مربع|متر\s*مكعب|م2|"
    r"لتر|كيس|أكياس|كرتون|كرتونة|لفة|زوج|طقم|يوم|أيام|شهر|سنة"
)


def once(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _found(quantity: Column, unit: Column, method: str, confidence: float, when: Column) -> Column:
    return F.when(when, F.struct(quantity.alias("quantity"), F.nullif(unit, F.lit("")).alias("unit"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence")))


def quantity(text: Column) -> Column:
    """Struct of quantity, unit, method and confidence.

    The first that applies: number and unit (a lone comma is a decimal one), fraction, middle of a range, the quantity of a triple
    (quantity, price, total that agree), an integer from 1 to 10000 at the end; else nothing, with confidence 0. Each
    pattern runs once, and only over texts that hold a digit.
    """
    none, amount = F.lit(""), r"\d+(?:[.,]\d+)?"
    explicit = rf"(?iuU)(?<!\d){amount}\s*(?:{UNIT_WORDS})(?!\w)"
    fraction = rf"(?iuU)\d+\s*/\s*\d+\s*(?:{UNIT_WORDS})?"
    span = rf"(?iuU){amount}\s*[-–]\s*{amount}\s*(?:{UNIT_WORDS})?"

    def with_unit(m: Column) -> Column:
        return _found(number_smart(F.regexp_extract(m, "(?U)^" + amount, 0)), F.regexp_replace(m, rf"(?U)^{amount}\s*", ""), "explicit_unit", 0.95, m != "")

    def divided(m: Column) -> Column:
        top, bottom = (F.regexp_extract(m, r"(?U)^(\d+)\s*/\s*(\d+)", k).try_cast("double") for k in (1, 2))
        return _found(F.try_divide(top, bottom), F.regexp_replace(m, r"(?U)^\d+\s*/\s*\d+\s*", ""), "fraction", 0.85, bottom > 0)

    def middle(m: Column) -> Column:
        low, high = (number_plain(F.regexp_extract(m, rf"(?U)^({amount})\s*[-–]\s*({amount})", k)) for k in (1, 2))
        return _found((low + high) / 2, F.regexp_replace(m, rf"(?U)^{amount}\s*[-–]\s*{amount}\s*", ""), "range_midpoint", 0.70, high >= low)

    def agreeing(all_: Column) -> Column:
        triples = F.transform(F.sequence(F.lit(1), F.greatest(F.size(all_) - 2, F.lit(1))), lambda k: F.slice(all_, k, 3))
        agree = F.filter(triples, lambda t: (F.size(t) == 3) & (t[1] > 0) & (t[2] > t[1]) & integerish(F.try_divide(t[2], t[1])) & (F.abs(F.try_divide(t[2], t[1]) - t[0]) < 0.01))
        return once(F.try_element_at(agree, F.lit(1)), lambda t: _found(F.bround(F.try_divide(t[2], t[1])), none, "reverse_calc", 0.80, t.isNotNull()))

    trailing = once(F.regexp_extract(text, r"(?<!\d)(\d{1,5})(?!\d|[.,]\d)\s*$", 1).try_cast("double"), lambda n: _found(n, none, "trailing_integer", 0.45, n.between(1, 10000)))
    found = F.coalesce(
        once(F.regexp_extract(text, explicit, 0), with_unit), F.when(text.contains("/"), once(F.regexp_extract(text, fraction, 0), divided)), F.when(text.rlike("[-–]"), once(F.regexp_extract(text, span, 0), middle)),
        once(numbers(text), agreeing), trailing,
    )
    return F.coalesce(F.when(text.rlike(r"(?U)\d"), found), _found(F.lit(None).cast("double"), none, "none", 0.0, F.lit(True)))


def price_text(text: Column) -> Column:
    """First number above 0 of a price text; Arabic and Latin thousands commas go."""
    number = number_plain(F.regexp_extract(F.translate(text, "،", ","), r"\d[\d,]*(?:\.\d+)?", 0))
    return F.when(number > 0, number)


def price_range(text: Column) -> Column:
    """The lower end of a price or range of prices, whatever the currency sign; a lone decimal comma counts."""
    lower = F.regexp_extract(F.translate(text, "٫", "."), r"\d+(?:[.,]\d{3})*(?:[.,]\d{1,2})?", 0)
    plain = F.when(lower.rlike(r"[.,]\d{1,2}$"), F.concat(F.regexp_replace(F.regexp_replace(lower, r"[.,]\d{1,2}$", ""), "[.,]", ""), F.lit("."), F.regexp_extract(lower, r"(\d{1,2})$", 1))).otherwise(F.regexp_replace(lower, "[.,]", ""))
    number = plain.try_cast("double")
    return F.when(number > 0, number)


def currency_price(text: Column) -> Column:
    """The number behind a currency name, else the last number."""
    named = number_plain(F.regexp_extract(text, r"(?i)(?:sar|usd|aed|eur|ريال)\s*(\d[\d,]*(?:\.\d+)?)", 1))
    return F.coalesce(named, F.try_element_at(numbers(text), F.lit(-1)))


def json_price(payload: Column, key: str = "price") -> Column:
    """A price above 0 that is a number, a text, or an object with amount, price, value or regular."""
    tried = [F.get_json_object(payload, f"$.{key}.{k}") for k in ("amount", "price", "value", "regular")] + [F.get_json_object(payload, f"$.{key}")]
    return F.coalesce(*[F.when(~t.startswith("{"), price_text(t)) for t in tried])


def inferred_quantity(total: Column, price: Column) -> Column:
    ratio = F.try_divide(total, price)
    return F.when((price > 0) & integerish(ratio), F.bround(ratio))


def line_total(quantity: Column, price: Column) -> Column:
    return F.bround(quantity * price, 4)


def score_confidence(score: Column) -> Column:
    """Confidence of a row's score: 0.55 and 0.08 a point, at most 0.99."""
    return F.least(F.lit(0.99), F.lit(0.55) + score * 0.08)


def price_digits(text: Column) -> Column:
    """A price above 0 of the digits and points of a text, all else dropped; null where that isn't a number."""
    number = F.regexp_replace(text, r"[^0-9.]", "").try_cast("double")
    return F.when(number > 0, number)


def utc(moment: Column, zone: Column | None = None) -> Column:
    """A moment as UTC: a text with an offset by its offset, one without in `zone` or else in UTC; null where it is no moment."""
    text = F.trim(moment.cast("string"))
    marked = text.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$") & text.rlike(r"\d:\d")
    naive = F.try_to_timestamp(F.regexp_replace(text, "T", " "))
    return F.when(marked, F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone())).otherwise(naive if zone is None else F.to_utc_timestamp(naive, zone))
