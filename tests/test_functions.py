"""Text, number and unit functions on the cases that define them."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import numbers, text, units
from millrace.operators import documents


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first().r


UNITS = [("pcs", "pc"), ("Pieces", "pc"), ("PC", "pc"), ("قطعة", "pc"), ("حبة", "pc"), ("عدد", "pc"), ("kg", "kg"), ("KGS", "kg"), ("كيلو", "kg"), ("طن", "ton"), ("mtr", "m"), ("Meter", "m"), ("متر", "m"), ("ft", "ft"), ("ltr", "l"), ("liters", "l"), ("لتر", "l"), ("sqm", "m2"), ("m2", "m2"), ("set", "set"), ("طقم", "set"), ("carton", "box"), ("CTN", "box"), ("كرتون", "box"), ("pcs.", "pc"), ("kw", "kw"), ("سنة", "year"), ("furlong", None), ("", None), (None, None)]


def test_units(spark):
    rows = spark.createDataFrame([(u,) for u, _ in UNITS], "v string").select("v", units.unit(F.col("v")).alias("u")).collect()
    assert [(r.v, r.u.unit) for r in rows] == UNITS
    assert one(spark, "kg", units.unit).category == "weight" and one(spark, "mtr", units.unit).category == "length"


QUANTITIES = [
    ("100 pcs of material", 100, "pcs", "explicit_unit"), ("مكيف ترين 5 طن حار", 5, "طن", "explicit_unit"), ("50 kg steel pipe", 50, "kg", "explicit_unit"), ("12.5 mtr pipe", 12.5, "mtr", "explicit_unit"),
    ("item 3/4 of stock", 0.75, None, "fraction"), ("order 2-4 of pipe", 3, None, "range_midpoint"), ("مكيف ترين مخفي المنتج 2 13350 26700", 2, None, "reverse_calc"),
    ("product name 3.00 4630.00 13890.00", 3, None, "reverse_calc"), ("some random product text 4", 4, None, "trailing_integer"), ("project header — grand total", None, None, "none"), ("2,5 kg cement", 2.5, "kg", "explicit_unit"), ("", None, None, "none"),
]


@pytest.mark.parametrize("line, quantity, unit, method", QUANTITIES)
def test_quantity(spark, line, quantity, unit, method):
    r = one(spark, line, numbers.quantity)
    assert (r.quantity, r.unit, r.method) == (quantity, unit, method)


def test_quantity_of_null(spark):
    assert one(spark, None, numbers.quantity).method == "none"


@pytest.mark.parametrize("value, f, want", [
    ("2,5", numbers.number_smart, 2.5), ("1,234.5", numbers.number_smart, 1234.5), ("2,5", numbers.number_plain, 25.0), ("x", numbers.number_plain, None), (None, numbers.number_plain, None),
    ("SAR 1,250.75", numbers.price_text, 1250.75), ("free", numbers.price_text, None), ("0", numbers.price_text, None), ("﷼ 1,234", numbers.price_range, 1234.0), ("12,50 - 20,00", numbers.price_range, 12.5), ("ر.س 12", numbers.price_range, 12.0),
    ("3 boxes USD 40", numbers.currency_price, 40.0), ("3 boxes 41", numbers.currency_price, 41.0), ('{"price": {"amount": "1,5"}}', numbers.json_price, 15.0), ('{"price": 7}', numbers.json_price, 7.0), ('{"price": 0}', numbers.json_price, None),
])
def test_numbers(spark, value, f, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize("value, f, want", [
    ("  Blue Pump -- 5_HP! ", text.slugify, "blue-pump-5-hp"), ("مضخة ماء", text.slugify, "مضخة-ماء"), ("!!", text.slugify, "product"), ("مضخة المياه ٣٤", text.ascii_slug, "mdkhh-almyah-34"), ("شُغْل Straße Œuvre ﬁ ½x", text.ascii_slug, "shghl-strasse-oeuvre-x"), (" -- ", text.ascii_slug, ""), ("Café Noir", text.ascii_slug, "cafe-noir"), ("ﬁne  x", text.nfkc, "fine x"),
    ("https://a.b/c/d-e.html?x=1#y", text.url_slug, "d-e"), ("https://a.b/p123", lambda c: text.url_id(c, text.URL_ID_PATTERNS), "123"), ("p/q", lambda c: text.absolute_url(c, "https://x.y/"), "https://x.y/p/q"), ("", lambda c: text.absolute_url(c, "https://x.y"), None),
    ('{"name": {"ar": "", "en": "Pump"}}', text.json_name, "Pump"), ('{"title": "T"}', text.json_name, "T"), ('{"brand": {"name": "B"}}', lambda c: text.json_label(c, ["brand"]), "B"), ("acme - pump", text.prefix_brand, "Acme"),
    ("a <b> & c", text.html_escape, "a &lt;b&gt; &amp; c"), ("it's", lambda c: text.sql_literal(c, False), "'it''s'"), (None, lambda c: text.sql_literal(c, False), "NULL"), ("valve ABC-12/X3 brass", text.model_code, "ABC-12/X3"), ("Brand: Acme, x", lambda c: text.labelled(c, ["brand"]), "Acme"),
    ("مضخة", text.language, "ar"), ("pump مضخة", text.language, "mixed"), ("pump", text.language, "en"), ("", text.language, "en"), ("a b.pdf", text.safe_filename, "a_b.pdf"), ("Hand Tools!", text.external_id, "hand_tools_"),
])
def test_text(spark, value, f, want):
    assert one(spark, value, f) == want


def test_lists(spark):
    assert one(spark, "The the cat مضخة of", text.word_set) == ["the", "cat", "مضخة"]
    assert one(spark, "steel pipe with Valve", text.keywords) == ["steel", "pipe", "valve"]
    assert one(spark, "| a  b |\n-\nc\nde", text.clean_lines) == ["a b", "de"]
    assert one(spark, "a  b\tc|d", text.split_cells) == ["a", "b", "c", "d"]
    assert tuple(one(spark, "Pump\nblue\n123456", text.name_and_sku)) == ("Pump blue", "123456") and tuple(one(spark, "Pump", text.name_and_sku)) == ("Pump", None)


@pytest.mark.parametrize("line, label, confidence", [
    ("", "ignore", 1.0), ("Item Description Qty Price", "table_header", 0.85), ("Grand Total 500", "total", 0.85), ("IBAN SA123", "bank_info", 0.88), ("Payment terms: 30 days", "payment_info", 0.82),
    ("Remarks: fragile", "notes", 0.78), ("17 steel pipe valve 3", "product_row", 0.99), ("hello", "metadata", 0.60), ("a plain line of words", "ignore", 0.60),
])
def test_row_labels(spark, line, label, confidence):
    r = one(spark, line, documents.row_label)
    assert (r.label, round(r.confidence, 4)) == (label, confidence)


def test_category_and_type(spark):
    assert one(spark, "brass pump", documents.category) == "Mechanical" and one(spark, "nothing", documents.category) is None
    assert one(spark, "Tax Invoice no 5", documents.document_type) == "invoice" and one(spark, "x", documents.document_type) is None
