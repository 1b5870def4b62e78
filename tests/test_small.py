"""Operators and functions that no registered query calls, on cases that can be read off."""

import json

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import documents, feedback, pages, upserts
from millrace.sinks import files
from millrace.sources import readers


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_candidates_once_and_normalized(spark):
    rows = [(2, "Pipe ", 1.0, 2.0, "PCS", None), (0, "pipe", 1.0, 2.0, "pcs", None), (1, "pipe", 1.0, None, None, 9.0), (3, "tee", None, 3.0, "kgs.", 12.0)]
    table = spark.createDataFrame(rows, "position int, product_name string, quantity double, price double, unit string, total double")
    assert sorted(r.position for r in documents.distinct_candidates(table).collect()) == [0, 1, 3]
    assert {(r.position, r.normalized_unit, r.quantity) for r in documents.normalized(table).collect()} == {(2, "pc", 1.0), (0, "pc", 1.0), (1, None, 1.0), (3, "kg", 4.0)}


def test_last_of_batch(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, n int, v string")
    assert sorted((r.k, r.v) for r in upserts.last_of_batch(rows, ["k"], "n").collect()) == [("a", "y"), ("b", "z")]


def test_learned_from_reviews(spark):
    events = spark.createDataFrame([("Steel pipe", "approve", 1), ("steel valve", "correct", 2), ("pipe", "reject", 3), ("this only", "approve", 4), (None, "approve", 5)], "name string, action string, seq int")
    got = {r.keyword: (round(r.weight, 4), r.is_active) for r in feedback.learned(events).collect()}
    assert got == {"steel": (1.0, True), "pipe": (0.2, True), "valve": (0.5, True)}


def test_labelled_rows_and_split_export(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"label": "product", "quantity": "1,200", "price": " "}, {"label": "other", "quantity": None, "price": "2.5"}]))
    (tmp_path / "t.csv").write_text('label,quantity,price\nproduct,"1,200",\n')
    assert sorted((r.label, r.quantity, r.price) for r in readers.labelled_rows(spark, str(tmp_path / "t.json"), "json").collect()) == [("other", None, 2.5), ("product", 1200.0, None)]
    assert [(r.label, r.quantity, r.price) for r in readers.labelled_rows(spark, str(tmp_path / "t.csv"), "csv").collect()] == [("product", 1200.0, None)]
    files.split_export(spark.range(25).coalesce(1), str(tmp_path / "out"), 10)
    assert spark.read.json(str(tmp_path / "out")).count() == 25 and len(list((tmp_path / "out").glob("*.json"))) == 3


def test_coalesced_columns(spark):
    table = spark.createDataFrame([("", "b", 3), ("a", "c", None)], "` Name ` string, `اسم` string, n int")
    got = [r.v for r in table.select(readers.coalesced(table, ["name", "اسم", "none"]).alias("v")).collect()]
    assert got == ["b", "a"] and table.select(readers.coalesced(table, ["none"]).alias("v")).first().v is None


def test_pages_and_texts(spark):
    xml = "<urlset><url><loc> https://a/p1 </loc></url><loc>https://a/x</loc><loc>https://a/p1</loc></urlset>"
    assert value(spark, pages.sitemap_urls(F.lit(xml), "/p")) == ["https://a/p1"] and len(value(spark, pages.sitemap_urls(F.lit(xml)))) == 2
    crumbs = F.array(*map(F.lit, ["Home", "Pipes", "", "PVC", "الرئيسية"]))
    assert [value(spark, pages.breadcrumb(crumbs, k)) for k in (1, 2, 3)] == ["PVC", "Pipes", None]
    assert [value(spark, text.arabic_brand(F.lit(x))) for x in ("سبوت لايت من هيونداي - HLFL", "سبوت من دايسون", "سبوت لايت", None)] == ["هيونداي", "دايسون", None, None]
    assert [value(spark, text.sane_sku(F.lit(x))) for x in (" AB-1 ", "a long sentence that holds the code QX-99 in it", "x" * 300, None)] == ["AB-1", "long", "x" * 191, None]
