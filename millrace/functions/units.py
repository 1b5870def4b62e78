"""Units of measure: spellings to a canonical unit and its category."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For each category and canonical unit, its spellings in lower case.
SPELLINGS = {
    "quantity": {
        "pc": ["pc", "pcs", "piece", "pieces", "unit", "units", "no", "nos", "no.", "nos.", "number", "item", "items", "عدد", "قطعة", "قطعه", "قطع", "حبة", "حبه", "حبات", "وحدة", "وحده"],
        "set": ["set", "sets", "kit", "kits", "طقم", "طقمات"],
        "box": ["box", "boxes", "carton", "cartons", "ctn", "ctns", "علبة", "علبه", "كرتون", "كرتونة"],
        "bag": ["bag", "bags", "sack", "sacks", "كيس", "أكياس"],
        "roll": ["roll", "rolls", "لفة", "لفات"],
        "pair": ["pair", "pairs", "زوج"],
        "lot": ["lot", "lots", "bulk"],
        "ls": ["lump sum", "ls", "l.s", "l.s.", "مبلغ مقطوع"],
    },
    "weight": {
        "kg": ["kg", "kgs", "kilogram", "kilograms", "كيلو", "كيلوغرام", "كلغ"],
        "g": ["g", "gr", "gram", "grams", "غرام", "جرام"],
        "ton": ["ton", "tons", "tonne", "tonnes", "mt", "طن", "أطنان"],
        "lb": ["lb", "lbs", "pound", "pounds"],
    },
    "length": {
        "m": ["m", "mtr", "mtrs", "meter", "meters", "metre", "metres", "متر", "أمتار"],
        "cm": ["cm", "centimeter", "centimetre"],
        "mm": ["mm", "millimeter", "millimetre"],
        "ft": ["ft", "feet", "foot", "قدم"],
        "in": ["inch", "inches", "in", "بوصة"],
    },
    "area": {
        "m2": ["m2", "sqm", "sq.m", "sq m", "square meter", "square metre", "square meters", "متر مربع", "م2"],
        "ft2": ["sqft", "sq.ft", "square foot", "square feet"],
    },
    "volume": {
        "l": ["l", "ltr", "ltrs", "liter", "liters", "litre", "litres", "لتر"],
        "ml": ["ml", "milliliter", "millilitre"],
        "m3": ["m3", "cbm", "cubic meter", "cubic metre", "متر مكعب"],
    },
    "energy": {
        "btu": ["btu", "btu/hr"],
        "kw": ["kw", "kilowatt"],
        "hp": ["hp", "horsepower", "حصان"],
    },
    "time": {
        "day": ["day", "days", "يوم", "أيام"],
        "month": ["month", "months", "شهر"],
        "year": ["year", "years", "سنة"],
    },
    "other": {
        "job": ["job", "service", "visit", "visit(s)", "trip"],
    },
}
ALIASES = {spelling: (unit, category) for category, units in SPELLINGS.items() for unit, spellings in units.items() for spelling in spellings}


def _lookup(which: int) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable((a, u[which]) for a, u in ALIASES.items())])


def unit(raw: Column) -> Column:
    """Struct of canonical unit and category; null fields where the spelling is unknown. Trailing points are tried without."""
    text = F.trim(F.regexp_replace(F.lower(raw), r"\s+", " "))
    bare = F.regexp_replace(text, r"\.+$", "")
    return F.struct(*[F.coalesce(F.try_element_at(_lookup(k), text), F.try_element_at(_lookup(k), bare)).alias(n) for k, n in enumerate(("unit", "category"))])
