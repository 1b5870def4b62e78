"""Text functions on columns. Where results must follow Unicode word characters, patterns carry (?U)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    """Trimmed, lower case, runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def filled(text: Column) -> Column:
    """Null where blank."""
    return F.when(F.trim(text) != "", text)


def first_filled(*texts: Column) -> Column:
    return F.coalesce(*[F.trim(filled(t)) for t in texts])


def slugify(name: Column, default: str = "product", most: int = 500) -> Column:
    """Unicode slug: lower case, word characters and hyphens only, cut to `most`, `default` if nothing is left."""
    kept = F.regexp_replace(F.lower(F.trim(name)), r"(?U)[^\w\s-]", "")
    slug = F.regexp_replace(F.regexp_replace(kept, r"[\s_]+", "-"), "-+", "-")
    slug = F.substring(F.regexp_replace(slug, "^-+|-+$", ""), 1, most)
    return F.when(slug == "", default).otherwise(slug)


#: Letters that become several: Arabic ones, and Latin ones that don't decompose. Then single Arabic letters, marks (which go) and digits.
SEVERAL = {"ث": "th", "خ": "kh", "ذ": "dh", "ش": "sh", "غ": "gh", "ؤ": "w", "ئ": "y", "چ": "ch", "ژ": "zh", "ﻻ": "la", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ø": "o", "ł": "l", "đ": "d"}
ARABIC_LETTERS = ("اأإآٱبتجحدرزسصضطظعفقكلمنهويىةءپگکی", "aaaaabtjhdrzssdtzafqklmnhwyah" + "'" + "pgky")
ARABIC_MARKS = "".join(map(chr, [*range(0x064B, 0x0660), 0x0640, 0x0670]))
ARABIC_DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def _decomposed() -> tuple[str, str]:
    """Letters and signs whose compatibility form is one plain letter or digit under marks, and what it is: a table by rule."""
    import unicodedata

    found = [(chr(c), plain[0]) for c in [*range(0xA0, 0x0250), *range(0x1E00, 0x1F00), *range(0x2070, 0x2190), *range(0xFF01, 0xFF5F)] if (plain := [x for x in unicodedata.normalize("NFKD", chr(c)).lower() if x.isascii() and x.isalnum()]) and len(plain) == 1 and not unicodedata.combining(chr(c))]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def ascii_slug(name: Column) -> Column:
    """Slug of ASCII letters and digits: accents are dropped, Arabic is written in Latin letters, letters of other scripts go.

    Letters that become several come first, then tables of single ones; vowel marks and the lengthening stroke go.
    """
    out = F.lower(name)
    for letter, plain in SEVERAL.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    letters, plain = _decomposed()
    out = F.translate(out, ARABIC_LETTERS[0] + ARABIC_DIGITS[0] + letters + ARABIC_MARKS, ARABIC_LETTERS[1] + ARABIC_DIGITS[1] + plain)
    return F.regexp_replace(F.regexp_replace(F.replace(out, F.lit("'"), F.lit("")), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def nfkc(text: Column) -> Column:
    """Compatibility composition with white space collapsed; Spark has no built-in normal form."""
    @F.pandas_udf("string")
    def compose(texts):
        import unicodedata

        return texts.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).split()))

    return compose(text)


def url_slug(url: Column, drop_extension: bool = True) -> Column:
    """Last path segment without query and fragment."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")
    last = F.substring_index(path, "/", -1)
    return F.regexp_replace(last, r"\.[A-Za-z0-9]+$", "") if drop_extension else last


def url_id(url: Column, patterns: list[str]) -> Column:
    """First group of the first pattern that matches; null where none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in patterns])


#: Where shops keep a product's id in its address, most specific first.
URL_ID_PATTERNS = [r"product_id=(\d+)", r"/p(\d+)", r"/(\d{10,})", r"/product/([^/?]+)"]


def absolute_url(url: Column, base: str) -> Column:
    return F.when(url.isNull() | (F.trim(url) == ""), F.lit(None)).when(url.startswith("http"), url).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(url, "^/+", "")))


def json_name(payload: Column, keys: tuple[str, ...] = ("name", "title")) -> Column:
    """A name that is a text, or an object with ar or en; the first key that has one."""
    found = []
    for k in keys:
        value = F.get_json_object(payload, f"$.{k}")
        found += [F.get_json_object(payload, f"$.{k}.ar"), F.get_json_object(payload, f"$.{k}.en"), F.when(~value.startswith("{"), value)]
    return first_filled(*found)


def json_label(payload: Column, keys: list[str]) -> Column:
    """The first non-blank of some keys, each a text or an object with a name."""
    found = []
    for k in keys:
        value = F.get_json_object(payload, f"$.{k}")
        found += [F.get_json_object(payload, f"$.{k}.name"), F.when(~value.startswith("{"), value)]
    return first_filled(*found)


def prefix_brand(name: Column, default: str | None = None) -> Column:
    """What stands before ` - `, in title case."""
    return F.when(F.instr(name, " - ") > 0, F.initcap(F.trim(F.substring_index(name, " - ", 1)))).otherwise(F.lit(default))


def arabic_brand(phrase: Column) -> Column:
    """The maker in a phrase that ends in `من <maker>`, without a code behind it."""
    return F.nullif(F.trim(F.regexp_extract(phrase, r"من (.+?)(?:\s*-\s*[A-Za-z0-9/.-]+)?$", 1)), F.lit(""))


def name_and_sku(text: Column) -> Column:
    """Struct of name and sku: a last line of five digits or more is the sku."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    last = F.try_element_at(lines, F.lit(-1))
    is_sku = (F.size(lines) > 1) & last.rlike(r"^\d{5,}$")
    names = F.when(is_sku, F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(1)))).otherwise(lines)
    return F.struct(F.array_join(names, " ").alias("name"), F.when(is_sku, last).alias("sku"))


def sane_sku(sku: Column, most: int = 191) -> Column:
    """A sku as it is if it is short and not a sentence; else the code inside it, cut at `most`."""
    short = (F.length(sku) <= 100) & (F.length(sku) - F.length(F.replace(sku, F.lit(" "), F.lit(""))) <= 4)
    return F.substring(F.when(short, F.trim(sku)).otherwise(F.nullif(F.regexp_extract(sku, r"[A-Za-z0-9][A-Za-z0-9._/-]{2,}", 0), F.lit(""))), 1, most)


def external_id(label: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.trim(label)), r"(?U)\W+", "_"), 1, most)


def word_set(text: Column, least: int = 3) -> Column:
    """Distinct lower-case words of at least `least` characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\b\w{{{least},}}\b"), F.lit(0)))


#: Words that keyword extraction leaves out.
STOP_WORDS = ["with", "from", "this", "that", "have", "will", "your", "been", "were", "they", "their", "which", "than", "then", "also", "into", "only", "each", "more"]


def keywords(text: Column) -> Column:
    """Distinct words of four Latin or Arabic letters or more, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-zء-ي]{4,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(STOP_WORDS)))


def clean_lines(text: Column) -> Column:
    """Lines with white space collapsed and | - _ stripped from both ends, of two characters or more."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[\s|_-]+|[\s|_-]+$", ""))
    return F.filter(lines, lambda x: F.length(x) >= 2)


def split_cells(line: Column) -> Column:
    """Cells between two blanks or more, tabs or bars."""
    return F.filter(F.transform(F.split(line, r"\s{2,}|\t|\|"), lambda x: F.trim(x)), lambda x: x != "")


def language(text: Column) -> Column:
    """ar, mixed or en by the share of Arabic among Arabic and Latin letters: above 0.70, above 0.20, else."""
    arabic = F.length(F.regexp_replace(text, r"[^؀-ۿ]", ""))
    latin = F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    share = F.try_divide(arabic, arabic + latin)
    return F.when(share > 0.70, "ar").when(share > 0.20, "mixed").otherwise("en")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sql_literal(value: Column, numeric: bool) -> Column:
    text = value.cast("string")
    return F.coalesce(text if numeric else F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts as texts between bars; null parts count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def model_code(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b[A-Z0-9]{3,}(?:[-/][A-Z0-9]+)*\b", 0), F.lit(""))


def labelled(text: Column, names: list[str]) -> Column:
    """What follows `name:` up to the end of the line or a bar, for any of the names."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?i)(?:{'|'.join(names)})\s*[:：]\s*([^\n|,]+)", 1)), F.lit(""))


def shortened(text: Column, most: int = 255) -> Column:
    """A text of at most `most` characters; a longer one ends in three points."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_.\-]", "_")
