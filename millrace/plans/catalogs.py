"""Registered queries over catalog rows: views, exports, reports, lookups by text, key and price list, page counts, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import catalog, documents, feedback, joins, pages, upserts
from ..sinks import files
from .feeds import LINES, numbered_lines, text
from .queries import query, read

VIEW = """(SELECT o_orderkey AS id, o_custkey AS session_id, o_orderkey AS position, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'corrected' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'other' WHEN o_orderkey % 7 = 1 THEN '' END AS corrected_label, 'product' AS predicted_label,
CASE WHEN o_orderkey % 5 = 0 THEN 'fixed ' || o_orderkey WHEN o_orderkey % 5 = 1 THEN '' END AS corrected_name, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS product_name, repeat(o_orderpriority || ' ', 20) AS raw_text,
CASE WHEN o_orderkey % 4 = 0 THEN 'c' ELSE '' END AS corrected_category, o_orderstatus AS category, CAST(NULL AS STRING) AS corrected_brand, o_orderpriority AS brand, '' AS corrected_unit, 'pc' AS unit, CASE WHEN o_orderkey % 2 = 0 THEN 'd' END AS corrected_description, CAST(NULL AS STRING) AS description,
CASE WHEN o_orderkey % 6 = 0 THEN 0.0 END AS corrected_quantity, 1.5 AS quantity, CASE WHEN o_orderkey % 9 = 0 THEN 2.5 END AS corrected_price, CASE WHEN o_orderkey % 8 <> 0 THEN 3.5 END AS price FROM orders)"""


@query(f"""SELECT id AS candidate_id, coalesce(nullif(corrected_name, ''), product_name, substr(raw_text, 1, 120)) AS product_name, coalesce(nullif(corrected_category, ''), category) AS category, brand, unit, coalesce(corrected_description, description) AS description,
coalesce(corrected_quantity, quantity)::DOUBLE AS quantity, coalesce(corrected_price, price)::DOUBLE AS price, raw_text AS source_line FROM {VIEW.replace("AS STRING", "AS VARCHAR")} WHERE status <> 'pending' AND (corrected_label IS NULL OR corrected_label = '')""")
def approved_view(spark, sf_dir):
    """Approved products in nine columns, corrections first."""
    rows = spark.sql("SELECT * FROM " + VIEW.replace("FROM orders", "FROM {orders}"), orders=read(spark, sf_dir, "orders"))
    return catalog.approved_view(rows).withColumns({k: F.col(k).cast("double") for k in ("quantity", "price")})


@query("""SELECT o_orderkey AS id, 'E' || o_orderkey AS external_id, NULL::VARCHAR AS sku, o_orderpriority AS name, o_totalprice AS price, NULL::VARCHAR AS source_url, o_orderstatus = 'F' AS is_synced, o_orderdate AS last_scraped_at, NULL::VARCHAR AS description, NULL::VARCHAR AS specifications,
c_name AS brand, n_name AS category, r_name AS source FROM orders LEFT JOIN customer ON CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END = c_custkey LEFT JOIN nation ON o_custkey % 30 = n_nationkey LEFT JOIN region ON o_custkey % 5 = r_regionkey ORDER BY id""")
def product_export(spark, sf_dir):
    """Orders as products, with the names of their dimensions."""
    none = F.lit(None).cast("string")
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), text("E", F.col("o_orderkey")).alias("external_id"), none.alias("sku"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("price"), none.alias("source_url"), (F.col("o_orderstatus") == "F").alias("is_synced"),
        F.col("o_orderdate").alias("last_scraped_at"), none.alias("description"), none.alias("specifications"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("scraper_brand_id"), (F.col("o_custkey") % 30).alias("scraper_category_id"), (F.col("o_custkey") % 5).alias("source_id"),
    )
    named = [read(spark, sf_dir, t).select(F.col(k).alias("id"), F.col(n).alias("name")) for t, k, n in (("customer", "c_custkey", "c_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))]
    return catalog.product_export(orders, *named)


@query("""WITH e AS (SELECT o_orderkey AS k, o_orderstatus AS said, CASE WHEN o_orderkey % 4 = 0 THEN 'F' ELSE o_orderstatus END AS truth FROM orders),
c AS (SELECT count(*) FILTER (said = 'F' AND truth = 'F') AS tp, count(*) FILTER (said = 'F' AND truth <> 'F') AS fp, count(*) FILTER (said <> 'F' AND truth = 'F') AS fn, count(*) FILTER (said <> 'F' AND truth <> 'F') AS tn FROM e),
d AS (SELECT row_number() OVER (ORDER BY k) AS i, k || ',"a ""' || said || '"", ' || truth || '",' || CASE WHEN said = truth THEN 'true' ELSE 'false' END AS line FROM e)
SELECT 1 AS n, 'metric,value' AS line UNION ALL SELECT 2, 'tp,' || tp FROM c UNION ALL SELECT 3, 'fp,' || fp FROM c UNION ALL SELECT 4, 'fn,' || fn FROM c UNION ALL SELECT 5, 'tn,' || tn FROM c UNION ALL SELECT 6, 'field_status,' || round((tp + tn) / (tp + fp + fn + tn), 4) FROM c
UNION ALL SELECT 7, '' UNION ALL SELECT 8, 'k,labels,ok' UNION ALL SELECT 8 + i, line FROM d""")
def evaluation_lines(spark, sf_dir):
    """An evaluation of orders' states as the lines of its report: metrics, fields, details in order."""
    e = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("said"), F.when(F.col("o_orderkey") % 4 == 0, "F").otherwise(F.col("o_orderstatus")).alias("truth"))
    said, truth = (e.select("k", F.col(c).alias("label")) for c in ("said", "truth"))
    summary = feedback.evaluated(said, truth, "k", "F").select("tp", "fp", "fn", "tn")
    fields = summary.select(F.lit("status").alias("field"), F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 4).alias("accuracy"))
    details = e.select("k", text('a "', F.col("said"), '", ', F.col("truth")).alias("labels"), (F.col("said") == F.col("truth")).alias("ok"))
    return files.evaluation_report(summary, fields, details, "k")


@query("""WITH s AS (SELECT s_suppkey AS id, s_nationkey AS org, 'slug-' || s_suppkey % 40 AS slug, s_name AS name, s_suppkey % 6 = 0 AS gone FROM supplier), live AS (SELECT DISTINCT org, slug FROM s WHERE NOT gone),
w AS (SELECT DISTINCT c_nationkey AS org, 'slug-' || c_custkey % 45 AS slug FROM customer), n AS (SELECT w.org, w.slug, min(c_name) AS name FROM w ANTI JOIN live USING (org, slug) JOIN customer ON c_nationkey = w.org AND 'slug-' || c_custkey % 45 = w.slug GROUP BY 1, 2)
SELECT id, org, slug, name, gone FROM s UNION ALL SELECT (SELECT max(id) FROM s) + row_number() OVER (ORDER BY org, slug), org, slug, name, NULL FROM n""")
def ensured_suppliers(spark, sf_dir):
    """Suppliers, and a new one for each organisation and slug that customers ask for and no live supplier has."""
    current = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("org"), text("slug-", F.col("s_suppkey") % 40).alias("slug"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 6 == 0, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"))
    wanted = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("org"), text("slug-", F.col("c_custkey") % 45).alias("slug"), F.col("c_name").alias("name"))
    out = upserts.ensured(current, wanted, "org", "slug")
    new = F.col("id") > F.lit(current.agg(F.max("id")).first()[0])  # one number
    return out.select("id", "org", "slug", "name", F.when(~new, F.col("deleted_at").isNotNull()).alias("gone"))


@query(f"""WITH b AS (SELECT k, 'pipe ' || part % 7 AS text, max(rn) AS rn FROM {LINES} WHERE rn % 4 <> 0 GROUP BY 1, 2)
SELECT r.k, r.rn, coalesce(b.rn * 10.0, NULL)::DOUBLE AS x0 FROM {LINES} r LEFT JOIN b ON r.k = b.k AND 'pipe ' || r.part % 7 = b.text""")
def boxes_by_text(spark, sf_dir):
    """Lines with the box of the last block of their order that says the same."""
    r = numbered_lines(spark, sf_dir)
    said = text(" pipe ", F.col("part") % 7, " ")
    blocks = r.where("rn % 4 <> 0").select("k", F.col("rn").alias("block_no"), said.alias("text"), F.struct((F.col("rn") * 10.0).cast("double").alias("x0")).alias("bbox"))
    return joins.boxes_by_text(r.select("k", "rn", text("pipe ", F.col("part") % 7).alias("text")), blocks, ["k"]).select("k", "rn", "bbox.x0")


@query("""WITH u AS (SELECT p_partkey % 50 AS url_key, max(p_brand) AS sku FROM part WHERE p_size % 3 = 0 GROUP BY 1), s AS (SELECT lower(p_brand) AS sku, min(p_retailprice) FILTER (p_size < 5) AS special, min(p_retailprice + 1) AS orig FROM part WHERE p_size < 40 GROUP BY 1)
SELECT p_partkey, coalesce(u.sku, 'old') AS sku, coalesce(special, orig, 7.0)::DOUBLE AS price, CASE WHEN special IS NOT NULL THEN orig END AS original_price FROM part LEFT JOIN u ON p_partkey % 60 = u.url_key LEFT JOIN s ON lower(coalesce(u.sku, 'old')) = s.sku""")
def listed_skus_and_prices(spark, sf_dir):
    """Parts with the sku of a key list, and then with the prices of a price list by that sku."""
    part = read(spark, sf_dir, "part")
    keys = part.select((F.col("p_partkey") % 50).alias("url_key"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(" ").alias("sku"))
    prices = part.where("p_size < 40").select(F.lower("p_brand").alias("sku"), F.when(F.col("p_size") < 5, F.col("p_retailprice")).otherwise(0.0).alias("special_price"), (F.col("p_retailprice") + 1).alias("orig_price"))
    products = part.select("p_partkey", (F.col("p_partkey") % 60).alias("url_key"), F.lit("old").alias("sku"), F.lit(7.0).alias("price"))
    return joins.with_sku_prices(joins.with_url_keys(products, keys), prices).select("p_partkey", "sku", "price", "original_price")


@query("SELECT o_orderkey, greatest(1, CASE o_orderkey % 4 WHEN 0 THEN o_custkey % 90 WHEN 1 THEN greatest(o_custkey % 90, o_custkey % 70) WHEN 2 THEN o_custkey % 50 ELSE 1 END)::INTEGER AS pages FROM orders")
def listing_page_counts(spark, sf_dir):
    """How many pages listings speak of: in an attribute, in links, in a script, nowhere."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    html = F.when(k == 0, text('<ul data-last-page="', c % 90, '" data-pagesize="99999"><li>')).when(k == 1, text('<a href="?page=', c % 90, "\">n</a><a class=x href='/l?a=1&page=", c % 70, "&b=2'>")).when(k == 2, text('<script>{"total_pages" : ', c % 50, "}</script>")).otherwise("page=77")
    return read(spark, sf_dir, "orders").select("o_orderkey", pages.page_count(html).alias("pages"))


@query("SELECT doc_id, md5('[First page / beginning]' || chr(10) || substr(text, 1, 2000) || chr(10) || chr(10) || '[Table headers]' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Table 0: [' || lang || ', ' || source || ']' ELSE '(no structured tables detected)' END) AS snippet_md5 FROM documents")
def context_snippets(spark, sf_dir):
    """Samples of documents: the feature takes 2000 characters of a first page."""
    headers = F.when(F.col("doc_id") % 2 == 0, F.array(F.array("lang", "source"))).otherwise(F.array(F.array().cast("array<string>")))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(documents.context_snippet(F.col("text"), headers)).alias("snippet_md5"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 3 HOUR WHEN 2 THEN ts - INTERVAL 150 MINUTE END AS moment, CASE WHEN value > 0.005 THEN round(value, 2) END AS price FROM events""")
def moments_and_digit_prices(spark, sf_dir):
    """Moments written with zones and without as UTC, and prices read from the digits and points of texts."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id") % 4
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    said = F.when(k == 0, plain).when(k == 1, F.concat(iso, F.lit("+03:00"))).when(k == 2, F.concat(iso, F.lit("+0230"))).otherwise("soon")
    price = F.concat(F.lit("ر.س "), F.regexp_replace(F.format_string("%.2f", "value"), "^-.*", ""), F.lit(" / kg"))
    return e.select("event_id", numbers.utc(said).alias("moment"), numbers.price_digits(F.regexp_replace(price, r"^ر\.س", "")).alias("price"))


@query("""WITH r AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'product_keyword' ELSE 'other' END AS rule_type, p_name AS rule_value, sum(p_size) % 17 AS weight, min(p_size) > 1 AS is_active FROM part GROUP BY 1, 2)
SELECT rule_type, rule_value, weight::DOUBLE AS weight, row_number() OVER (ORDER BY weight DESC, rule_value) AS n FROM r WHERE is_active AND rule_type = 'product_keyword'""")
def rules_by_weight(spark, sf_dir):
    """The active keyword rules, the heaviest first, with their place."""
    made = read(spark, sf_dir, "part").groupBy(F.when(F.col("p_size") % 2 == 0, "product_keyword").otherwise("other").alias("rule_type"), F.col("p_name").alias("rule_value")).agg((F.sum("p_size") % 17).cast("double").alias("weight"), (F.min("p_size") > 1).alias("is_active"))
    return upserts.numbered(catalog.rules(made, "product_keyword").select("rule_type", "rule_value", "weight"), "n")


@query("""SELECT o_orderkey, o_orderkey % 4 IN (0, 1) AS product_table FROM orders""")
def product_tables(spark, sf_dir):
    """Tables by header words, by a column of numbers among the first rows, with half of it numbers, with none."""
    k = F.col("o_orderkey") % 4
    header = F.when(k == 0, F.array(F.lit("Item"), F.lit("Unit Price"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    row = lambda *cells: F.array(*[F.col(c).cast("string") if c.startswith("o_") else F.lit(c) for c in cells])
    rows = F.when(k == 1, F.array(row("x", "o_custkey"), row("y", "1,000"), row("z", "-"))).when(k == 2, F.array(row("x", "o_custkey"), row("y", "none"))).otherwise(F.array(row("x", "o_orderpriority")))
    return read(spark, sf_dir, "orders").select("o_orderkey", documents.is_product_table(header, rows).alias("product_table"))


@query(f"""WITH e AS (SELECT item_id AS id, text, item_id % 5 AS use_count FROM benchmark), c AS (SELECT item_id AS id, text || CASE WHEN item_id % 3 = 0 THEN ' extra words here' ELSE '' END AS text FROM benchmark),
w AS (SELECT id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{3,}}')) AS ws FROM c), v AS (SELECT id, use_count, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{3,}}')) AS ws FROM e),
s AS (SELECT w.id, v.id AS example_id, use_count, len(list_intersect(w.ws, v.ws)) / len(list_distinct(list_concat(w.ws, v.ws))) AS j FROM w, v WHERE len(w.ws) > 0 AND len(v.ws) > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY j DESC, use_count DESC, example_id) AS r FROM s WHERE j >= 0.6)
SELECT c.id, b.example_id, round(j, 6) AS similarity, CASE WHEN b.example_id % 2 = 0 THEN 'unit ' || b.example_id ELSE 'pc' END AS unit FROM c LEFT JOIN b ON c.id = b.id AND r = 1""")
def corrected_by_examples(spark, sf_dir):
    """Candidates whose fields follow the most similar correction example, from 0.60 on, the more used of equals."""
    items = read(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    examples = items.select(i.alias("id"), "text", (i % 5).alias("use_count"), F.when(i % 2 == 0, text("unit ", i)).otherwise(" ").alias("corrected_unit"))
    found = items.select(i.alias("id"), F.concat("text", F.when(i % 3 == 0, " extra words here").otherwise("")).alias("text"), F.lit("pc").alias("unit"))
    return joins.corrected(found, examples, 0.60, ("unit",)).select("id", "example_id", F.round("similarity", 6).alias("similarity"), "unit")
