"""Operators on small tables whose results can be read off."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates, catalog, documents, feedback, joins, pages, sequences, upserts
from millrace.sinks import files, sql_dump
from millrace.sources import readers
from millrace.streaming import changes

CANDIDATE = "id long, predicted_label string, quantity double, price double, total double, unit string, confidence double, needs_review boolean"


def test_validation(spark):
    rows = [(1, "product", 2.0, 5.0, 10.0, "pc", 0.9, False), (2, "product", 2.0, 5.0, 99.0, "pc", 0.9, False), (3, "product", 500.0, 0.5, None, "pc", 0.9, False), (4, "product", 50_000.0, 2.0, None, None, 0.9, False), (5, "product", None, 2.0, None, "pc", 0.9, False), (6, "note", -1.0, -1.0, None, None, 0.9, False), (7, "product", -1.0, -2.0, None, None, 0.9, False), (8, "product", 1.0, None, None, None, 0.9, False)]
    r = {x.id: (x.validation_flags, round(x.confidence, 4), x.needs_review) for x in documents.validated(spark.createDataFrame(rows, CANDIDATE)).collect()}
    assert r[1] == ([], 0.95, False) and r[2] == (["total_mismatch"], 0.9, True) and r[3] == (["possible_qty_price_swap"], 0.9, True) and r[4] == (["qty_very_large"], 0.9, True)
    assert r[5] == (["unit_without_qty"], 0.9, True) and r[6] == ([], 0.9, False) and r[7] == (["negative_qty", "negative_price"], 0.8, True) and r[8] == ([], 0.9, False)


def test_visible_and_pages(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", datetime(2024, 1, 1)), (3, "b", None)], "id long, org_id string, deleted_at timestamp")
    assert [r.id for r in catalog.visible(df, "a").collect()] == [1] and catalog.by_id(df, 3, "a").isEmpty() and catalog.exists(catalog.by_id(df, 3))
    assert [r.id for r in catalog.page(df, [F.desc("id")], 2, 2).collect()] == [1] and catalog.where_equal(df, {"id": 3, "nope": 1, "org_id": None}).count() == 1
    m = catalog.page_meta(df, 2, 2).first()
    assert (m.total, m.last_page, m.from_row, m.to_row, m.has_next, m.has_prev) == (3, 2, 3, 3, False, True) and catalog.page_meta(df.where("id < 0")).first().last_page == 1


def test_effective_values(spark):
    df = spark.createDataFrame([("", "p", 0.0, 5.0), ("c", "p", None, 5.0)], "cn string, pn string, cq double, pq double")
    assert [tuple(r) for r in df.select(catalog.effective("cn", "pn", True), catalog.effective("cq", "pq", False)).collect()] == [("p", 0.0), ("c", 5.0)]


def test_coverage_keeps_the_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 0.0), (None, 3.0)], "s string, p double")
    r = {x.s: (x.total, x.priced, x.missing, float(x.pct), x.min_price) for x in aggregates.coverage(df, "s", F.col("p")).collect()}
    assert r == {"a": (3, 1, 2, 33.3, 1.0), None: (1, 1, 0, 100.0, 3.0)}


def test_sequences(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate("xxyyyx")], "d long, k long, v string")
    assert [r.run for r in sequences.runs(df, ["d"], ["k"], "v").orderBy("k").collect()] == [0, 0, 1, 1, 1, 2]
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(["intro", "HEAD", "p1", "more", "p2", "STOP", "p3"])], "d long, k long, t string")
    body = sequences.after_header(lines, ["d"], "k", F.col("t") == "HEAD", F.col("t") == "STOP")
    assert [r.t for r in sequences.continued(body, ["d"], "k", F.col("t").startswith("p"), "t").orderBy("item").collect()] == ["p1 more", "p2"]
    words = spark.createDataFrame([(1, 0.0, 0.0), (1, 6.0, 1.0), (1, 9.0, 0.0), (1, 16.0, 0.0)], "p long, top double, x0 double")
    assert [r.line for r in sequences.anchored_lines(words, ["p"], "top", 8.0).orderBy("top").collect()] == [0, 0, 1, 1]
    assert spark.range(1).select(sequences.column_of(F.lit(30.0), F.array(F.lit(10.0), F.lit(44.0), F.lit(90.0)))).first()[0] == 1


def test_similar_loses_no_pair(spark):
    import itertools
    import random

    r = random.Random(1)
    a = [(i, " ".join(r.sample([f"word{k}" for k in range(30)], r.randrange(1, 12)))) for i in range(80)]
    for s in (0.3, 0.6, 1.0):
        found = {(x.left_id, x.right_id) for x in joins.similar(spark.createDataFrame(a, "id long, text string"), spark.createDataFrame(a, "id long, text string"), s, 100).collect()}
        sets = {i: set(t.split()) for i, t in a}
        assert found == {(i, j) for i, j in itertools.product(sets, sets) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= s}


def test_upsert(spark):
    cur = spark.createDataFrame([(1, 1, "e1", "u1", "s1", "old", True), (2, 1, None, "u2", "s2", "old", True)], "id long, source_id int, external_id string, url string, sku string, name string, is_synced boolean")
    inc = spark.createDataFrame([(1, "e1", "u2", "s9", "a"), (1, "e9", "u2", "", ""), (1, "e8", "u8", "s8", "new"), (2, "e1", "u1", "s1", "other source")], "source_id int, external_id string, url string, sku string, name string")
    plan = upserts.matched(cur, inc, "source_id", ["external_id", "url", "sku"], "id")
    assert {(r.external_id, r.source_id): (r.action, r.matched_id, r.matched_by) for r in plan.collect()} == {("e1", 1): ("update", 1, "external_id"), ("e9", 1): ("update", 2, "url"), ("e8", 1): ("insert", None, None), ("e1", 2): ("insert", None, None)}
    out = {r.id: r for r in upserts.applied(cur, plan, "id", ["name"], ["source_id", "external_id", "url", "sku", "name"], ("name",), {"is_synced": F.lit(False)}).collect()}
    assert sorted(out) == [1, 2, 3, 4] and (out[1].name, out[1].is_synced, out[2].name) == ("a", False, "old") and {out[3].name, out[4].name} == {"new", "other source"}


def test_weights(spark):
    events = spark.createDataFrame([("k", i, s) for i, s in enumerate([0.5, -0.3, -0.3, 0.5] + [0.5] * 9)] + [("z", 0, -0.3)], "key string, n long, step double")
    r = {x.key: (round(x.weight, 4), x.is_active) for x in upserts.folded(events, "key", "n").collect()}
    assert r == {"k": (3.0, True), "z": (0.0, False)}


def test_weights_of_a_frequent_key_are_folded_in_ranges(spark):
    steps = [(0.5, -0.25, -0.75, 0.25)[i * i % 7 % 4] for i in range(20_000)]
    events = spark.createDataFrame([("k", i, s) for i, s in enumerate(steps)] + [(None, 0, 0.5), ("n", 0, 0.5), ("n", 1, None), ("n", 2, 0.25)], "key string, n long, step double").repartition(8)
    w = 0.0
    for s in steps:
        w = min(3.0, max(0.0, w + s))
    found = upserts.folded(events, "key", "n")
    assert {x.key: x.weight for x in found.collect()} == {"k": w, None: 0.5, "n": 0.25}
    assert "rangepartitioning" in found._jdf.queryExecution().executedPlan().toString()


def test_dimension(spark):
    cur, inc = spark.createDataFrame([(5, "a")], "id long, name string"), spark.createDataFrame([("b",), ("a",), ("c",), ("b",), (None,)], "name string")
    assert sorted(map(tuple, upserts.dimension(cur, inc, ["name"], "id").collect())) == [(5, "a"), (6, "b"), (7, "c")]


def test_patch_and_delete(spark):
    cur = spark.createDataFrame([(1, "a", 2.0, None), (2, "b", 3.0, None)], "id long, name string, price double, deleted_at timestamp")
    patch = spark.createDataFrame([(1, None, 9.0)], "id long, name string, price double")
    assert sorted((r.name, r.price) for r in upserts.patched(cur, patch, "id", ["name", "price"]).collect()) == [("a", 9.0), ("b", 3.0)]
    assert upserts.soft_deleted(cur, patch, "id", F.lit("2024-01-01").cast("timestamp")).where("deleted_at is null").count() == 1


PAGES = [
    ('<script type="application/ld+json">{"price":"1,200.5"}</script>', 1200.5, "json_ld"), ('<meta property="product:price:amount" content="12.5">', 12.5, "meta"), ('<span itemprop="price" content="9"></span>', 9.0, "itemprop"), ('<i data-price="8.5">', 8.5, "data"),
    ('<div class="big price"><b>SAR 77</b></div>', 77.0, "class"), ("<p>only 55 SAR</p>", 55.0, "currency"), ("<script>var price = 41;</script>", 41.0, "script"), ('<meta property="og:price:amount" content="0"><i data-price="3">', 3.0, "data"), ("<p>no</p>", None, None), (None, None, None),
]


@pytest.mark.parametrize("html, price, level", PAGES)
def test_page_price(spark, html, price, level):
    r = spark.createDataFrame([(html,)], "h string").select(pages.page_price(F.col("h")).alias("p")).first().p
    assert (r.price, r.level) == (price, level) if r else price is None


def test_feedback(spark):
    schema = "id string, session_id string, status string, predicted_label string, corrected_label string, corrected_name string, corrected_quantity double, corrected_price double"
    cands = spark.createDataFrame([(c, "s", "pending", "product", None, None, None, None) for c in "abc"], schema)
    items = spark.createDataFrame([("a", "s", "approve", None, None, None, None, 1), ("b", "s", "reject", None, None, None, None, 1), ("b", "s", "correct", None, "new", 2.0, None, 2), ("c", "other", "approve", None, None, None, None, 1), ("zz", "s", "approve", None, None, None, None, 1)], "candidate_id string, session_id string, action string, corrected_label string, corrected_name string, corrected_quantity double, corrected_price double, seq int")
    r = {x.id: (x.status, x.corrected_name, x.corrected_quantity) for x in feedback.reviewed(cands, items).collect()}
    assert r == {"a": ("approved", None, None), "b": ("corrected", "new", 2.0), "c": ("pending", None, None)}
    assert feedback.approve_all(cands).where("status = 'approved'").count() == 3


def test_evaluation(spark):
    said, truth = (spark.createDataFrame(list(enumerate(x)), "n long, label string") for x in (["product", "product", "other", "product"], ["product", "other", "product"]))
    r = feedback.evaluated(said, truth, "n").first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.f1) == (1, 2, 1, 0, 0.3333, 0.5, 0.4)
    r = feedback.evaluated(said.where("n < 0"), truth.where("n < 0"), "n").first()
    assert (r.tp, r.precision, r.f1) == (0, 0.0, 0.0)
    assert [x[0] for x in spark.createDataFrame([("red pump", "pump big"), ("x", ""), (None, "a")], "s string, t string").select(feedback.name_match(F.col("s"), F.col("t"))).collect()] == [True, False, False]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name;qty\n\nPump;5\n".encode())
    rows = readers.csv_documents(readers.files(spark, str(tmp_path / "a.csv"))).orderBy("row_no").collect()
    assert [(r.is_header, r.cells) for r in rows] == [(True, ["name", "qty"]), (False, ["Pump", "5"])] and readers.files(spark, str(tmp_path / "a.csv")).first().kind == "csv"
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "1.json").write_text('{"products": [{"id": 1, "name": {"ar": "", "en": "Pump"}, "url": "/p/1", "price": {"amount": "1,000"}, "brand": {"name": "B"}}, {"id": 2}]}')
    (tmp_path / "feed" / "2.json").write_text('[{"external_id": "x", "title": "T", "link": "https://z/1", "price": 5, "category": "C"}]')
    (tmp_path / "feed" / "3.json").write_text("[]")
    r = sorted(map(tuple, readers.feed_products(readers.feed_items(spark, str(tmp_path / "feed")), "https://shop").drop("raw_data").collect()))
    assert r == [("1", "Pump", "https://shop/p/1", None, 1000.0, "B", None), ("x", "T", "https://z/1", None, 5.0, None, "C")]


def test_xlsx(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>qty</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1"><v>1</v></c></row><row><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    rows = readers.xlsx_documents(readers.files(spark, str(tmp_path / "a.xlsx"))).orderBy("row_no").collect()
    assert [(r.is_header, r.cells) for r in rows] == [(False, ["1"]), (True, ["name", "", "qty"])]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"it's {i}", None) for i in range(7)], "id long, name string, price double")
    assert sql_dump.statements(df, "t", ["id"]).where("id = 1").first().statement == "INSERT INTO t VALUES (1, 'it''s 1', NULL);"
    assert sum(r.statement.count("it''s") for r in sql_dump.batched_statements(df, "t", "id", 2).collect()) == 7
    assert "`id` BIGINT" in sql_dump.create_table(df.schema, "t")
    with pytest.raises(ValueError):
        files.training_export(df, str(tmp_path / "x"), "xml", "id")
    log = files.pushed(files.sync_payload(df, ["name", "price"]), lambda payloads: ((True, p * 2) for p in payloads), most=5)
    assert log.where("ok").count() == 7 and {len(r.response) for r in log.collect()} == {5}


def test_stream(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 as k").repartition(4).write.parquet(str(tmp_path / "in"))
    assert changes.drained(spark, str(tmp_path / "in"), ["id", "k"]).groupBy("k").count().count() == 3


def test_points_outside_boxes(spark):
    points, boxes = spark.createDataFrame([(1, 1.0, 1.0), (1, 9.0, 9.0), (2, 1.0, 1.0)], "p long, x double, y double"), spark.createDataFrame([(1, 0.0, 2.0, 0.0, 2.0)], "p long, x0 double, x1 double, y0 double, y1 double")
    assert sorted(map(tuple, joins.outside(points, boxes, ["p"]).collect())) == [(1, 9.0, 9.0), (2, 1.0, 1.0)]
