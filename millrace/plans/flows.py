"""Registered queries over sources and streams: dumps read back, paged listings, states and pushes, functions in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry
from ..sinks import sql_dump
from ..sources import dumps, paged
from ..streaming import changes, states
from .feeds import LINES, numbered_lines, text
from .queries import query, read


@query("SELECT p_partkey, p_name || ' it''s; (' || p_brand || ', NULL)' AS p_name, CASE WHEN p_size % 7 <> 0 THEN p_size END AS p_size, p_retailprice FROM part")
def sql_dump_source(spark, sf_dir):
    """Parts written as a dump of INSERTs of many rows, whose texts hold quotes, semicolons and brackets, and read back from it."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" it's; ("), "p_brand", F.lit(", NULL)")).alias("p_name"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("p_size"), "p_retailprice")
    written = sql_dump.batched_statements(part, "part", "p_partkey", size=100).select(F.xxhash64("statement").alias("path"), F.concat(F.lit("-- part; of\n"), "statement", F.lit("\nCOMMIT;")).alias("text"))
    return dumps.typed(dumps.rows(written, escapes=False), part.schema, "part")


@query(f"""WITH i AS (SELECT part % 40 AS category, CAST(1 + (k % 30) AS INTEGER) AS page, 'p' || (part * 7 % 1500) AS id FROM {LINES}),
f AS (SELECT category, id, min(page) AS first FROM i GROUP BY 1, 2), n AS (SELECT category, page, count(*) AS items FROM i GROUP BY 1, 2), w AS (SELECT category, first AS page, count(*) AS new FROM f GROUP BY 1, 2),
b AS (SELECT n.category, n.page, items, coalesce(new, 0) = 0 OR row_number() OVER (PARTITION BY n.category ORDER BY n.page) <> n.page AS bad FROM n LEFT JOIN w USING (category, page)),
e AS (SELECT category, page, bool_or(bad) OVER (PARTITION BY category ORDER BY page) OR coalesce(bool_or(items < 3) OVER (PARTITION BY category ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stop FROM b)
SELECT f.category, f.id, f.first AS page FROM f JOIN e ON f.category = e.category AND f.first = e.page WHERE NOT stop""")
def paged_until_stop(spark, sf_dir):
    """Listings of parts in pages, as far as a crawl goes that stops at a page without new ids, a missing one or a short one."""
    r = numbered_lines(spark, sf_dir)
    items = r.select((F.col("part") % 40).alias("category"), (F.col("k") % 30 + 1).cast("int").alias("page"), text("p", F.col("part") * 7 % 1500).alias("id"))
    return paged.until_stop(items, "category", "page", "id", full_page=3)


ACTION = "CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'click' THEN 'reject' WHEN 'view' THEN 'correct' ELSE 'none' END"


@query(f"SELECT user_id, max(event_id) AS seq, CASE arg_max({ACTION}, event_id) WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'corrected' END AS status FROM events WHERE {ACTION} <> 'none' GROUP BY user_id")
def stream_review_states(spark, sf_dir):
    """The last review of each user's candidate, kept as state over the stream of events."""
    items = changes.source(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", F.expr(ACTION).alias("action"))
    with states.state_store(spark):
        log = states.drain(states.review_states(items, "user_id", "event_id", "action"), mode="update")
    return states.latest(log, "user_id", "event_id").select("user_id", F.col("event_id").alias("seq"), "status")


@query("SELECT event_id % 10 <> 0 AS ok, count(*) AS n, count(DISTINCT event_id) AS sent, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def stream_push_log(spark, sf_dir):
    """Events pushed batch by batch to a receiver that refuses each tenth; the log has each attempt once."""
    def send(payloads):
        import json

        for p in payloads:
            yield json.loads(p)["event_id"] % 10 != 0, "done"

    rows = changes.source(spark, f"{sf_dir}/events.parquet").select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("payload"))
    return states.push(rows, send, "event_id").groupBy("ok").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("sent"), F.sum("event_id").alias("ids"))


@query("SELECT p_partkey, lower(regexp_replace(trim(p_name), '\\s+', '-', 'g')) AS slug, CASE p_size % 4 WHEN 0 THEN 'pc' WHEN 1 THEN 'kg' WHEN 2 THEN 'm2' END AS unit, CASE WHEN p_size % 4 < 2 THEN 'quantity' ELSE 'area' END AS category, p_size + 0.5 AS n, CASE WHEN p_size % 2 = 0 THEN round(p_retailprice, 2) END::DOUBLE AS price FROM part"
       .replace("CASE WHEN p_size % 4 < 2 THEN 'quantity' ELSE 'area' END", "CASE p_size % 4 WHEN 0 THEN 'quantity' WHEN 1 THEN 'weight' WHEN 2 THEN 'area' END"))
def sql_functions(spark, sf_dir):
    """The library's functions called by their names from SQL."""
    registry.register(spark)
    read(spark, sf_dir, "part").createOrReplaceTempView("registry_part")
    return spark.sql("""SELECT p_partkey, slugify(p_name) AS slug, unit(u) AS unit, unit_category(u) AS category, number_smart(concat(p_size, ',5')) AS n, price_text(t) AS price
        FROM (SELECT *, element_at(array('Pcs.', ' KGS ', 'sq  m', 'parsec'), CAST(p_size % 4 + 1 AS INT)) AS u, CASE WHEN p_size % 2 = 0 THEN concat('SAR ', format_number(p_retailprice, 2)) ELSE 'ask' END AS t FROM registry_part)""")


@query(f"SELECT k, rn::INTEGER AS item, 'pipe ' || part || CASE WHEN rn % 2 = 0 THEN ' in grey' ELSE '' END AS name, q::DOUBLE AS quantity, p AS price FROM {LINES}")
def sql_line_items(spark, sf_dir):
    """Lines of orders to items by a table function over partitions in order, from SQL."""
    registry.register(spark)
    r = numbered_lines(spark, sf_dir)
    parts = F.array(text("pipe ", F.col("part")), F.when(F.col("rn") % 2 == 0, F.lit("in grey")), F.concat_ws(" ", F.col("q").cast("string"), F.format_number("p", 2), F.format_number("t", 2)))
    lines = r.select("k", "rn", F.posexplode(F.array_compact(parts)).alias("at", "line")).select("k", (F.col("rn") * 10 + F.col("at")).alias("line_no"), "line")
    lines.createOrReplaceTempView("registry_lines")
    return spark.sql("SELECT doc AS k, item, name, quantity, price FROM line_items(TABLE(SELECT k, line_no, line FROM registry_lines) PARTITION BY k ORDER BY line_no)")
