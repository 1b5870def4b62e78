"""Dumps, paged listings, states over streams, functions in SQL, and small catalog operators on cases that can be read off."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import numbers, registry, text, units
from millrace.operators import catalog, documents, joins, pages, upserts
from millrace.sinks import files
from millrace.sources import dumps, paged
from millrace.streaming import states

DUMP = r"""-- a comment; with 'marks
CREATE TABLE t (id int); INSERT INTO `brands` (`id`, `name`, `note`) VALUES (1, 'it''s; (x, y)', NULL),
 (2, 'back\\slash \'quoted\' \n end', -3.5), (3, '', 'NULL');
/* INSERT INTO brands VALUES (9); */ UPDATE brands SET id = 2; insert into sources values (7, 'س,ص'); INSERT INTO brands (note, ID) VALUES ('only', 4)"""


def test_dump_rows(spark, tmp_path):
    (tmp_path / "part01.sql").write_text(DUMP, encoding="utf-8")
    found = dumps.rows(dumps.read(spark, str(tmp_path))).cache()
    assert sorted((r.table, r.row, r.cells) for r in found.collect()) == [
        ("brands", 1, ["1", "it's; (x, y)", None]), ("brands", 1, ["only", "4"]), ("brands", 2, ["2", "back\\slash 'quoted' \n end", "-3.5"]), ("brands", 3, ["3", "", "NULL"]), ("sources", 1, ["7", "س,ص"]),
    ]
    schema = T.StructType().add("id", "integer").add("note", "string").add("name", "string")
    assert sorted((r.id, r.note, r.name) for r in dumps.typed(found, schema, "BRANDS").collect()) == [(1, None, "it's; (x, y)"), (2, "-3.5", "back\\slash 'quoted' \n end"), (3, "NULL", ""), (4, "only", None)]
    assert [tuple(r) for r in dumps.typed(found, T.StructType().add("a", "integer").add("b", "integer"), "sources").collect()] == [(7, None)]
    plain = spark.createDataFrame([("x", "INSERT INTO t VALUES ('a\\', 'b');"), ("y", None), ("z", "")], "path string, text string")
    assert [r.cells for r in dumps.rows(plain, escapes=False).collect()] == [["a\\", "b"]]


def test_paged_listing_and_its_stop(spark, tmp_path):
    pages_of = {"a": [["1", "2"], ["3", "1"], ["2", "1"], ["9", "8"]], "b": [["1", "2"], ["5"], ["6", "7"]], "c": [["1", "2"], None, ["3", "4"]], "d": [["1", "1"], ["2", "2"]]}
    for name, listing in pages_of.items():
        (tmp_path / name).mkdir()
        for k, ids in enumerate(listing):
            if ids is not None:
                (tmp_path / name / f"page-{k + 1}.json").write_text(json.dumps([{"id": i, "price": 2.5} for i in ids]))
    spark.dataSource.register(paged.PagedListing)
    table = spark.read.format("paged_listing").option("path", str(tmp_path)).load()
    assert table.count() == 11 and table.where("category = 'b'").count() == 3
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        pushing = spark.read.format("paged_listing").option("path", str(tmp_path)).option("pushdown", "true").load()
        assert pushing.count() == 11 and pushing.where("category = 'b'").count() == 3 and pushing.where("category = 'b'").rdd.getNumPartitions() == 3 and pushing.where("category = 'zz'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    items = table.select("category", "page", F.explode("items").alias("i")).select("category", "page", "i.*")
    kept = paged.until_stop(items, "category", "page", "id", full_page=2)
    found = {}
    for r in kept.collect():
        found.setdefault(r.category, []).append((r.page, r.id))
    assert {k: sorted(v) for k, v in found.items()} == {"a": [(1, "1"), (1, "2"), (2, "3")], "b": [(1, "1"), (1, "2"), (2, "5")], "c": [(1, "1"), (1, "2")], "d": [(1, "1"), (2, "2")]}
    assert paged.until_stop(items, "category", "page", "id", 2, most_pages=1).where("page > 1").count() == 0
    assert paged.until_stop(items.where("false"), "category", "page", "id", 2).count() == 0


def test_review_states_over_batches(spark, tmp_path):
    """Late and repeated items change nothing, across batches and when the stream is drained again."""
    schema = "candidate_id long, seq long, action string"
    batches = [[(1, 5, "approve"), (1, 3, "reject"), (2, 1, "none"), (None, 1, "approve")], [(1, 4, "reject"), (1, 5, "reject"), (2, 2, "correct"), (2, None, "reject")], [(2, 2, "correct"), (3, 1, "reject")]]
    log = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        with states.state_store(spark):
            log = states.drain(states.review_states(stream), folder=str(tmp_path / "out"), mode="update")
        if k == 0:
            assert [(r.candidate_id, r.seq, r.status) for r in log.collect()] == [(1, 5, "approved")]
    assert sorted((r.candidate_id, r.seq, r.status) for r in states.latest(log, "candidate_id").collect()) == [(1, 5, "approved"), (2, 2, "corrected"), (3, 1, "rejected")]
    assert log.count() == 3 and "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "")


def test_a_replayed_batch_is_kept_once(spark, tmp_path):
    keep = states.keep_batch(str(tmp_path))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for _ in range(2):
        keep(rows, 0)
    keep(rows.where("id = 1"), 1)
    assert sorted((r.id, r.batch) for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [(1, 0), (1, 1), (2, 0)]


VALUES = ["A  Fine_Name! ", "كابل نحاس", "", None, "pcs.", "1,234.5", "2,5", "--", "SAR 12,000 only", "ABC-123/X with from cable", "Sq.M", "lump  sum"]


def test_functions_in_sql_are_those_of_columns(spark):
    registry.register(spark)
    spark.createDataFrame([(v,) for v in VALUES], "v string").createOrReplaceTempView("registry_values")
    table, v = spark.table("registry_values"), F.col("v")
    pairs = {"slugify": text.slugify(v), "squeezed": text.squeezed(v), "external_id": text.external_id(v), "word_set": text.word_set(v), "keywords": text.keywords(v), "model_code": text.model_code(v), "number_plain": numbers.number_plain(v), "number_smart": numbers.number_smart(v), "price_text": numbers.price_text(v), "unit": units.unit(v)["unit"], "unit_category": units.unit(v)["category"]}
    got = spark.sql("SELECT " + ", ".join(f"{n}(v) AS {n}" for n in pairs) + " FROM registry_values").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in table.select(*pairs.values()).collect()]
    assert spark.sql("SELECT inferred_quantity(125, 25) AS a, inferred_quantity(1, 0) AS b, content_hash('a', NULL, 'c') AS c").first().a == 5.0
    lines = [("d1", 2, "3.00 4,630.00 13,890.00"), ("d1", 1, "pipe"), ("d1", 3, "tail"), ("d2", 1, "5 6"), ("d2", 2, None)]
    spark.createDataFrame(lines, "doc string, n int, line string").createOrReplaceTempView("registry_rows")
    items = spark.sql("SELECT * FROM line_items(TABLE(registry_rows) PARTITION BY doc ORDER BY n)").collect()
    assert [tuple(r) for r in items] == [("d1", 1, "pipe", 3.0, 4630.0)]


def test_views_and_lists(spark):
    rows = [(1, 9, 2, "approved", None, "product", "", None, "raw " * 50), (2, 9, 1, "corrected", "product", "other", "fixed", "old", "r"), (3, 9, 3, "approved", "other", "product", "x", "y", "r"), (4, 8, 1, "pending", None, "product", "x", "y", "r")]
    table = spark.createDataFrame(rows, "id int, session_id int, position int, status string, corrected_label string, predicted_label string, corrected_name string, product_name string, raw_text string")
    for c in ("category", "brand", "unit", "description"):
        table = table.withColumn(c, F.lit(c)).withColumn(f"corrected_{c}", F.lit(""))
    for c in ("quantity", "price"):
        table = table.withColumn(c, F.lit(1.0)).withColumn(f"corrected_{c}", F.lit(0.0))
    got = catalog.approved_view(table, 9).collect()
    assert [(r.candidate_id, r.product_name, r.category, r.quantity) for r in got] == [(2, "fixed", "category", 0.0), (1, ("raw " * 50)[:120], "category", 0.0)]
    ruled = spark.createDataFrame([("k", "a", 1.0, True), ("k", "b", 3.0, True), ("k", "c", 9.0, False), ("x", "d", None, True)], "rule_type string, rule_value string, weight double, is_active boolean")
    assert [r.rule_value for r in catalog.rules(ruled, "k").collect()] == ["b", "a"] and [r.rule_value for r in catalog.rules(ruled).collect()] == ["b", "a", "d"]


def test_lookups(spark):
    blocks = spark.createDataFrame([(1, 0, " pipe ", (1.0,)), (1, 1, "pipe", (2.0,)), (2, 0, "pipe", (3.0,)), (1, 2, " ", (4.0,))], "doc int, block_no int, text string, bbox struct<x0: double>")
    rows = spark.createDataFrame([(1, "pipe"), (2, "pipe "), (1, ""), (3, "pipe"), (1, None)], "doc int, text string")
    assert sorted(((r.doc, r.text, r.bbox and r.bbox.x0) for r in joins.boxes_by_text(rows, blocks, ["doc"]).collect()), key=str) == sorted([(1, "pipe", 2.0), (2, "pipe ", 3.0), (1, "", None), (3, "pipe", None), (1, None, None)], key=str)
    products = spark.createDataFrame([("u", "old", 5.0), ("v", "old", 5.0), (None, "Ab ", None)], "url_key string, sku string, price double")
    keyed = joins.with_url_keys(products, spark.createDataFrame([("u", "new"), ("v", " "), (None, "x")], "url_key string, sku string"))
    assert sorted((r.sku for r in keyed.collect()), key=str) == ["Ab ", "new", "old"]
    prices = spark.createDataFrame([("aB", 3.0, 4.0), ("NEW", 0.0, 6.0), ("old", None, None)], "sku string, special_price double, orig_price double")
    assert sorted((r.sku, r.price, r.original_price) for r in joins.with_sku_prices(keyed, prices).collect()) == [("Ab ", 3.0, 4.0), ("new", 6.0, None), ("old", 5.0, None)]


def test_small_functions(spark):
    def value(c):
        return spark.range(1).select(c.alias("v")).first().v

    assert [value(numbers.price_digits(F.lit(x))) for x in ("ر.س 12", "1,200.50 SAR", "none", "0", "1.2.3", None)] == [0.12, 1200.5, None, None, None, None]
    assert [str(value(numbers.utc(F.lit(x)))) for x in ("2024-01-01 10:00:00", "2024-01-01T10:00:00+03:00", "2024-01-01T10:00:00Z", "soon")] == ["2024-01-01 10:00:00", "2024-01-01 07:00:00", "2024-01-01 10:00:00", "None"]
    assert str(value(numbers.utc(F.lit("2024-01-01 10:00:00"), F.lit("Asia/Riyadh")))) == "2024-01-01 07:00:00"
    assert [value(pages.page_count(F.lit(h))) for h in ('<ul data-pages=4>', '<a href="?page=3&x=9"><a href="/?page=12">', '{"last_page":7}', "", "page=5")] == [4, 12, 7, 1, 1]
    q = [value(numbers.quantity(F.lit(x))) for x in ("2,5 kg cement", "50 kg steel", "3/4 of stock", "order 2-4 of pipe", "x 2 13350 26700", "text 4", "none", "1,250 pcs")]
    assert [(r.quantity, r.method) for r in q] == [(2.5, "explicit_unit"), (50.0, "explicit_unit"), (0.75, "fraction"), (3.0, "range_midpoint"), (2.0, "reverse_calc"), (4.0, "trailing_integer"), (None, "none"), (1.25, "explicit_unit")]
    snippet = value(documents.context_snippet(F.lit("p" * 5000), F.array(F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>"))))
    assert snippet == "[First page / beginning]\n" + "p" * 2000 + "\n\n[Table headers]\nTable 0: [a, b]"
    numeric = F.array(F.array(F.lit("x"), F.lit("1,000")), F.array(F.lit("y"), F.lit("")), F.array(F.lit("z"), F.lit("n")))
    header = F.array(F.lit("a"), F.lit("b"))
    assert not value(documents.is_product_table(header, numeric)) and value(documents.is_product_table(header, F.slice(numeric, 1, 2))) and not value(documents.is_product_table(header))


def test_ensured_rows(spark):
    current = spark.createDataFrame([(1, "o", "a", "A", None, None), (2, "o", "b", "B", None, "2024")], "id long, org string, slug string, name string, website string, deleted_at string")
    wanted = spark.createDataFrame([("o", "a", "again"), ("o", "b", "B2"), ("o", "b", "B1"), ("p", "a", "other"), ("o", " ", "x"), (None, "a", "y")], "org string, slug string, name string")
    got = upserts.ensured(current, wanted, "org", "slug").orderBy("id").collect()
    assert [(r.id, r.org, r.slug, r.name, r.website) for r in got] == [(1, "o", "a", "A", None), (2, "o", "b", "B", None), (3, "o", "b", "B1", None), (4, "p", "a", "other", None)]


def test_evaluation_report(spark, tmp_path):
    summary = spark.createDataFrame([(0.5, 3)], "precision double, tp int")
    fields = spark.createDataFrame([("name", 0.25)], "field string, accuracy double")
    details = spark.createDataFrame([(2, 'say "x"'), (1, "a,b"), (3, None)], "row int, said string")
    lines = [(r.n, r.line) for r in files.evaluation_report(summary, fields, details, "row").orderBy("n").collect()]
    assert lines == list(enumerate(["metric,value", "precision,0.5", "tp,3", "field_name,0.25", "", "row,said", '1,"a,b"', '2,"say ""x"""', "3,"], 1))
    files.write_report(files.evaluation_report(summary, fields, details, "row"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 9


@pytest.mark.parametrize("threshold, used", [(0.6, [(1, 11, "box"), (2, 12, "own"), (3, None, "own")])])
def test_corrections_by_examples(spark, threshold, used):
    examples = spark.createDataFrame([(10, "steel pipe round long", 1, "bag"), (11, "steel pipe round long", 5, "box"), (12, "brass valve", 0, " ")], "id int, text string, use_count int, corrected_unit string")
    rows = spark.createDataFrame([(1, "steel pipe round", "own"), (2, "brass valve new", "own"), (3, "nothing alike here", "own")], "id int, text string, unit string")
    assert sorted((r.id, r.example_id, r.unit) for r in joins.corrected(rows, examples, threshold, ("unit",)).collect()) == used
