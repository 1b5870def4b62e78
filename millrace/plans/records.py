"""Registered queries over records: snapshots and upserts, reviews, rows in order, lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, documents, feedback, sequences, strategies, upserts
from ..streaming import changes
from .queries import UPSERT_SQL, _upsert, query, read

REVIEWED = """(SELECT o_orderkey AS position, o_custkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'corrected' ELSE 'pending' END AS status,
CASE WHEN o_orderkey % 7 = 0 THEN 'product' WHEN o_orderkey % 7 = 1 THEN 'other' WHEN o_orderkey % 7 = 2 THEN '' END AS corrected_label, CASE WHEN o_orderkey % 3 = 0 THEN 'product' ELSE 'other' END AS predicted_label FROM orders)"""


def _expressed(df, sql: str):
    """The columns of the inner SELECT of `sql` over a DataFrame."""
    return df.sparkSession.sql(sql.replace("FROM orders", "FROM {orders}"), orders=df)


@query(f"SELECT session_id, position FROM {REVIEWED} WHERE status IN ('approved', 'corrected') AND coalesce(nullif(corrected_label, ''), predicted_label) = 'product'")
def approved_products(spark, sf_dir):
    rows = _expressed(read(spark, sf_dir, "orders"), REVIEWED.strip("()"))
    return catalog.approved_products(rows).select("session_id", "position")


@query("SELECT event_id FROM events WHERE user_id IS NULL OR user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def unmatched_items(spark, sf_dir):
    known = read(spark, sf_dir, "customer").where("c_acctbal > 0")
    return catalog.unmatched(read(spark, sf_dir, "events").select("event_id", "user_id"), known, "user_id", "c_custkey").select("event_id")


@query("SELECT page_id, contains(url, '.com') OR contains(url, '.sa') AS suspicious FROM pages")
def suspicious_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", catalog.suspicious_name(F.col("url")).alias("suspicious"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def hard_delete(spark, sf_dir):
    gone = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return upserts.hard_deleted(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), gone, "o_orderkey")


@query("SELECT o_orderkey, o_orderkey % 9 = 0 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS deleted, CASE WHEN o_orderkey % 9 = 0 THEN 2020 WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 2024 END AS year FROM orders")
def soft_delete(spark, sf_dir):
    """Orders with a returned line are deleted now; those deleted before keep their time."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, F.lit("2020-01-01").cast("timestamp")).alias("deleted_at"))
    gone = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    after = upserts.soft_deleted(orders, gone, "o_orderkey", F.lit("2024-01-01").cast("timestamp"))
    return after.select("o_orderkey", F.col("deleted_at").isNotNull().alias("deleted"), F.year("deleted_at").alias("year"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'new' ELSE p_name END AS p_name, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part")
def partial_update(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    patch = part.where("p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "new").alias("p_name"), (F.col("p_retailprice") + 1).alias("p_retailprice"))
    return upserts.patched(part, patch, "p_partkey", ["p_name", "p_retailprice"])


PLAN_SQL = UPSERT_SQL + """, plan AS (SELECT inc.*, coalesce(e.id, u.id, s.id) AS matched_id, CASE WHEN e.id IS NOT NULL THEN 'external_id' WHEN u.id IS NOT NULL THEN 'url' WHEN s.id IS NOT NULL THEN 'sku' END AS matched_by FROM inc
LEFT JOIN (SELECT source_id, external_id, min(id) AS id FROM cur WHERE external_id <> '' GROUP BY 1, 2) e ON inc.source_id = e.source_id AND inc.external_id = e.external_id
LEFT JOIN (SELECT source_id, url, min(id) AS id FROM cur WHERE url <> '' GROUP BY 1, 2) u ON inc.source_id = u.source_id AND inc.url = u.url
LEFT JOIN (SELECT source_id, sku, min(id) AS id FROM cur WHERE sku <> '' GROUP BY 1, 2) s ON inc.source_id = s.source_id AND inc.sku = s.sku)"""


@query(PLAN_SQL + """ SELECT cur.id, cur.external_id, coalesce(nullif(l.url, ''), cur.url) AS url, l.n IS NOT NULL AS hit FROM cur LEFT JOIN (SELECT * FROM plan WHERE matched_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY matched_id ORDER BY n DESC) = 1) l ON cur.id = l.matched_id
UNION ALL SELECT (SELECT max(id) FROM cur) + row_number() OVER (ORDER BY n), external_id, url, false FROM plan WHERE matched_id IS NULL""")
def upsert_snapshot(spark, sf_dir):
    """The next snapshot: the last incoming row of each current one counts, blank urls keep the old ones, new rows get the next ids."""
    cur, inc = _upsert(spark, sf_dir)
    plan = upserts.matched(cur, inc, "source_id", ["external_id", "url", "sku"], "id").repartitionByRange("n").sortWithinPartitions("n")
    after = upserts.applied(cur.withColumn("hit", F.lit(False)), plan, "id", ["url"], ["source_id", "external_id", "url", "sku"], ("url",), {"hit": F.lit(True)}, "n")
    return after.select("id", "external_id", "url", F.coalesce("hit", F.lit(False)).alias("hit"))


@query(PLAN_SQL + " SELECT count(*) AS total, count(*) FILTER (matched_id IS NULL) AS inserted, count(matched_id) AS updated, count(*) FILTER (matched_by = 'external_id') AS by_external_id, count(*) FILTER (matched_by = 'url') AS by_url, count(*) FILTER (matched_by = 'sku') AS by_sku FROM plan")
def upsert_summary(spark, sf_dir):
    cur, inc = _upsert(spark, sf_dir)
    keys = ["external_id", "url", "sku"]
    counts = upserts.plan_counts(upserts.matched(cur, inc, "source_id", keys, "id"))
    return counts.select("total", "inserted", "updated", *[F.coalesce(F.try_element_at("updated_by", F.lit(k)), F.lit(0)).alias(f"by_{k}") for k in keys])


@query("""WITH p AS (SELECT p_size % 3 AS scope, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand || '-' || p_size END AS external_id, p_name || ' ' || p_type AS name, p_size, p_partkey FROM part),
cur AS (SELECT min(p_partkey) AS id, scope, external_id, name FROM p WHERE p_size <= 2 GROUP BY scope, external_id, name),
u AS (SELECT DISTINCT scope, external_id, name FROM p WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.scope = p.scope AND p.external_id <> '' AND cur.external_id = p.external_id) AND NOT EXISTS (SELECT 1 FROM cur WHERE cur.scope = p.scope AND cur.name = p.name)),
n AS (SELECT scope, external_id = '' AS k, CASE WHEN external_id <> '' THEN external_id ELSE name END AS v, min(external_id) AS external_id, min(name) AS name FROM u GROUP BY 1, 2, 3)
SELECT id, scope, external_id, name FROM cur UNION ALL SELECT (SELECT max(id) FROM cur) + row_number() OVER (ORDER BY scope, k, v), scope, external_id, name FROM n""")
def two_key_get_or_create(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    found = part.select((F.col("p_size") % 3).alias("scope"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat_ws("-", "p_brand", "p_size")).alias("external_id"), F.concat_ws(" ", "p_name", "p_type").alias("name"), "p_size", "p_partkey")
    cur = found.where("p_size <= 2").groupBy("scope", "external_id", "name").agg(F.min("p_partkey").alias("id"))
    return upserts.get_or_create(cur, found, "scope", ["external_id", "name"], "id")


@query("WITH c AS (SELECT p_partkey AS id, p_size AS scope, replace(p_name, ' ', '-') AS slug FROM part), i AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS id, p_size AS scope, replace(p_name, ' ', '-') AS slug FROM part) SELECT n FROM i WHERE EXISTS (SELECT 1 FROM c WHERE c.scope = i.scope AND c.slug = i.slug AND c.id IS DISTINCT FROM i.id)")
def slug_conflicts(spark, sf_dir):
    """Renames (even keys) and new products (odd keys, which the table holds already) whose slug is taken."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.col("p_size").alias("scope"), text.slugify(F.col("p_name")).alias("slug"))
    incoming = part.withColumn("id", F.when(F.col("n") % 2 == 0, F.col("n")))
    return upserts.slug_conflicts(part.withColumnRenamed("n", "id"), incoming, "scope", "slug", "id").select("n")


@query("""WITH s AS (SELECT l_orderkey, l_returnflag <> 'R' AS ok FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_returnflag DESC) = 1)
SELECT o_orderkey, coalesce(ok, false) OR o_orderstatus = 'F' AS is_synced, CASE WHEN ok THEN 2024 END AS year FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""")
def mark_synced(spark, sf_dir):
    sent = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") != "R").alias("ok"), F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("seq"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("is_synced"), F.lit(None).cast("timestamp").alias("synced_at"))
    return upserts.marked_synced(orders, sent, "o_orderkey", F.lit("2024-01-01").cast("timestamp")).select("o_orderkey", "is_synced", F.year("synced_at").alias("year"))


@query("""WITH c AS (SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'running' ELSE 'queued' END AS status FROM events)
SELECT user_id, arg_max(status, {'a': ts, 'b': status}) AS status, min(ts) FILTER (status = 'running') AS started_at, max(ts) FILTER (status = 'done') AS ended_at, count(*) FILTER (status = 'running') AS runs FROM c GROUP BY user_id""")
def job_states(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "running").otherwise("queued")
    return upserts.job_states(read(spark, sf_dir, "events").select("user_id", "ts", status.alias("status")), "user_id", "ts")


@query("SELECT round_even(l_extendedprice / 100, 0) * 100 AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def price_buckets(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(sequences.bucketed(F.col("l_extendedprice"), 100.0).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS INTEGER) AS position FROM lineitem")
def global_position(spark, sf_dir):
    return sequences.positioned(read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], ["l_linenumber", "l_partkey"], ["l_suppkey"])


@query("SELECT l_orderkey, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity + l_linenumber) AS x1, max(l_extendedprice + 10) AS y1 FROM lineitem GROUP BY l_orderkey")
def bounding_boxes(spark, sf_dir):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return sequences.bounding_boxes(read(spark, sf_dir, "lineitem").select("l_orderkey", q.alias("x0"), p.alias("y0"), (q + F.col("l_linenumber")).alias("x1"), (p + 10).alias("y1")), ["l_orderkey"])


@query("""WITH h AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS h FROM events), s AS (SELECT *, min(CASE WHEN event_type = 'click' AND event_id > h THEN event_id END) OVER (PARTITION BY user_id) AS s FROM h)
SELECT event_id, user_id FROM s WHERE event_id > h AND (s IS NULL OR event_id < s)""")
def header_until_stop(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return sequences.after_header(events, ["user_id"], "event_id", F.col("event_type") == "purchase", F.col("event_type") == "click").select("event_id", "user_id")


@query("""WITH i AS (SELECT *, count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS item FROM events)
SELECT user_id, item, string_agg(event_type, ' ' ORDER BY event_id) AS event_type FROM i WHERE item > 0 GROUP BY user_id, item""")
def continuation_merge(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return sequences.continued(events, ["user_id"], "event_id", F.col("event_type") == "purchase", "event_type")


@query("SELECT doc_id, md5(CASE WHEN length(text) > 255 THEN substr(text, 1, 252) || '...' ELSE text END) AS name_md5 FROM documents")
def shortened_names(spark, sf_dir):
    """Names of at most 255 characters, which is what the feature makes of a text."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.shortened(F.col("text"))).alias("name_md5"))


@query("SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS html_md5 FROM pages")
def html_escaped(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.html_escape(F.col("html"))).alias("html_md5"))


@query(f"SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-zء-ي]{{4,}}')), lambda w: NOT list_contains({text.STOP_WORDS}, w))) AS n_keywords FROM documents")
def keyword_extraction(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(text.keywords(F.col("text"))).cast("long").alias("n_keywords"))


@query("SELECT p_partkey, substr(regexp_replace(lower(trim(p_name || ' / ' || p_brand)), '[^\\p{L}\\p{N}_]+', '_', 'g'), 1, 80) AS external_id FROM part")
def category_external_id(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.external_id(F.concat_ws(" / ", "p_name", "p_brand")).alias("external_id"))


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN contains(t, '{k}') THEN '{c}'" for k, c in strategies.CATEGORY_OF.items()) + " END AS category FROM (SELECT p_partkey, lower(p_name || ' ' || " + f"{list(strategies.CATEGORY_OF)}[1 + p_partkey % {len(strategies.CATEGORY_OF)}]" + ") AS t FROM part)")
def product_categories(spark, sf_dir):
    """Categories of part names with each keyword behind them in turn."""
    word = F.element_at(F.array(*map(F.lit, strategies.CATEGORY_OF)), (F.col("p_partkey") % len(strategies.CATEGORY_OF) + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", strategies.product_category(F.concat_ws(" ", "p_name", word)).alias("category"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    return changes.windowed_counts(read(spark, sf_dir, "events")).select("window.start", "event_type", "n")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderkey LIMIT 100")
def queue_head(spark, sf_dir):
    """The hundred oldest rows that wait: the limit is the feature."""
    return changes.queue_head(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("is_synced")), 100).select("id")


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS off FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0)
SELECT 'name' AS field, count(*) AS total, count(*) FILTER (k % 4 <> 1) AS hits, round(count(*) FILTER (k % 4 <> 1) / count(*), 4) AS accuracy FROM b
UNION ALL SELECT 'status', count(*), count(*) FILTER (k % 2 = 0), round(count(*) FILTER (k % 2 = 0) / count(*), 4) FROM b UNION ALL SELECT 'price', count(*), count(*) FILTER (NOT off), round(count(*) FILTER (NOT off) / count(*), 4) FROM b WHERE k % 8 <> 0""")
def field_accuracy(spark, sf_dir):
    """Extracted orders against the true ones: half of a name's words are enough, and 1 % off is near enough for a price."""
    k, price, name = F.col("o_orderkey"), F.col("o_totalprice"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))
    orders = read(spark, sf_dir, "orders")
    truth = orders.select("o_orderkey", F.when(k % 5 != 0, "product").otherwise("note").alias("label"), name.alias("name"), F.lit(" Open").alias("status"), F.when(k % 8 != 0, price).alias("price"))
    said = orders.select("o_orderkey", F.when(k % 11 != 0, "product").otherwise("note").alias("label"), F.when(k % 4 == 0, "ORDER").when(k % 4 == 1, "none").otherwise(name).alias("name"), F.when(k % 2 == 0, "open").otherwise("shut").alias("status"), F.when(k % 3 == 0, price * 1.1).otherwise(price * 1.01).alias("price"))
    return feedback.field_accuracy(said, truth, "o_orderkey", ["name"], ["status"], ["price"])


@query("SELECT o_orderkey, o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS numeric_table, o_orderkey % 3 = 0 AS product_table FROM orders")
def table_kinds(spark, sf_dir):
    """Tables of an order's lines: with price headers, with a column of numbers, with words alone."""
    k = F.col("o_orderkey")
    cells = F.array(F.when(F.col("l_orderkey") % 3 == 2, F.col("l_returnflag")).otherwise(F.format_number("l_extendedprice", 2)), F.col("l_linestatus"))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(cells).alias("rows"))
    tables = read(spark, sf_dir, "orders").select("o_orderkey").join(rows, k == F.col("l_orderkey"), "left")
    header = F.when(k % 3 == 0, F.array(F.lit("Item"), F.lit("Unit Price"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return tables.select("o_orderkey", documents.is_numeric_table(header, F.coalesce("rows", F.array())).alias("numeric_table"), documents.is_product_table(header).alias("product_table"))


@query("SELECT DISTINCT l_orderkey, 'steel pipe ' || l_partkey AS product_name, CASE WHEN l_orderkey % 3 < 2 THEN l_quantity END AS quantity, CASE WHEN l_orderkey % 3 < 2 THEN l_extendedprice END AS price, CASE l_orderkey % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'pair' ELSE 'lines' END AS strategy, 'Building Materials' AS category FROM lineitem")
def line_candidates(spark, sf_dir):
    """Candidates from the lines of one document an order, which is a table, names above rows of numbers, or names alone."""
    lines = read(spark, sf_dir, "lineitem")
    key, q, x = F.col("l_orderkey"), F.col("l_quantity").cast("int").cast("string"), F.col("l_extendedprice")
    name, price, total = F.concat(F.lit("steel pipe "), F.col("l_partkey").cast("string")), F.format_number(x, 2), F.format_number(x * F.col("l_quantity"), 2)
    shape = F.when(key % 3 == 0, F.array(F.concat_ws("  ", name, q, price, total))).when(key % 3 == 1, F.array(name, F.concat_ws(" ", q, price, total))).otherwise(F.array(name))
    body = lines.select("l_orderkey", F.posexplode(shape).alias("_k", "line"), F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("_at"))
    head = lines.where(key % 3 == 0).select("l_orderkey").distinct().select("l_orderkey", F.lit(-1).alias("_k"), F.lit("Description  Qty  Price  Total").alias("line"), F.lit(None).cast(body.schema["_at"].dataType).alias("_at"))
    numbered = sequences.positioned(body.unionByName(head), ["_at"], ["_k"], ["l_orderkey"]).select("l_orderkey", F.col("position").alias("line_no"), "line")
    return strategies.candidates(numbered, ["l_orderkey"]).select("l_orderkey", "product_name", "quantity", "price", "strategy", "category")


@query("""SELECT DISTINCT l_orderkey, l_quantity::INTEGER || ' pcs steel pipe P' || l_partkey || ' ' || floor(l_extendedprice)::BIGINT || ' 9' AS product_name, l_quantity AS quantity, 'pc' AS unit, floor(l_extendedprice) AS price, 'Plumbing' AS category, '' AS flags FROM lineitem""")
def document_products(spark, sf_dir):
    """Products of one document an order: a title, its lines, and a grand total, which is none."""
    lines = read(spark, sf_dir, "lineitem")
    line = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" pcs steel pipe P"), F.col("l_partkey").cast("string"), F.lit(" "), F.floor("l_extendedprice").cast("string"), F.lit(" 9"))
    body = lines.select("l_orderkey", F.lit(1).alias("_k"), F.col("l_linenumber").cast("long").alias("_n"), line.alias("line"))
    ends = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").cast("int").alias("q"))
    title = ends.select("l_orderkey", F.lit(0).alias("_k"), F.lit(0).cast("long").alias("_n"), F.lit("Quotation").alias("line"))
    total = ends.select("l_orderkey", F.lit(2).alias("_k"), F.lit(0).cast("long").alias("_n"), F.concat(F.lit("Grand total 12 pcs pipe "), F.col("q").cast("string")).alias("line"))
    every = sequences.positioned(body.unionByName(title).unionByName(total), ["_k"], ["_n", "line"], ["l_orderkey"])
    found = documents.products_of(every.select("l_orderkey", F.col("position").alias("line_no"), "line"), ["l_orderkey"])
    return found.select("l_orderkey", "product_name", "quantity", F.col("unit"), "price", "category", F.array_join("validation_flags", ",").alias("flags"))
