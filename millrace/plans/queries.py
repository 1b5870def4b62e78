"""Registered queries: each applies an operator to whole tables; SQL maps hold the same question for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text, units
from ..operators import aggregates, catalog, documents, feedback, joins, pages, sequences, upserts
from ..sinks import sql_dump
from ..streaming.changes import drained

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, and its SQL."""
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PRICED = "CASE WHEN l_linenumber % 7 <> 0 THEN l_extendedprice END"
COVERAGE = f"""count(*) AS total, count(CASE WHEN price > 0 THEN 1 END) AS priced, count(*) - count(CASE WHEN price > 0 THEN 1 END) AS missing,
    round(100.0 * count(CASE WHEN price > 0 THEN 1 END) / count(*), 1) AS pct"""


def _sourced(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", F.expr(PRICED).alias("price"))
    return lines.join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"), how)


@query(f"SELECT s_name, {COVERAGE}, round(min(CASE WHEN price > 0 THEN price END), 2) AS min_price, round(max(CASE WHEN price > 0 THEN price END), 2) AS max_price, round(avg(CASE WHEN price > 0 THEN price END), 2) AS avg_price FROM (SELECT l_suppkey, {PRICED} AS price FROM lineitem) LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name")
def price_coverage_by_source(spark, sf_dir):
    return aggregates.coverage(_sourced(spark, sf_dir, "left"), "s_name", F.col("price")).orderBy(F.desc("total"), "s_name")


@query(f"SELECT s_name, {COVERAGE}, round(avg(CASE WHEN price > 0 THEN price END), 2) AS avg_price FROM (SELECT l_suppkey, {PRICED} AS price FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name")
def price_coverage_inner(spark, sf_dir):
    return aggregates.coverage(_sourced(spark, sf_dir, "inner"), "s_name", F.col("price"), spread=False)


@query(f"SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(priced) AS BIGINT) AS priced, round(100.0 * sum(priced) / sum(total), 1) AS pct FROM (SELECT s_name, {COVERAGE} FROM (SELECT l_suppkey, {PRICED} AS price FROM lineitem) LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name)")
def overall_coverage(spark, sf_dir):
    return aggregates.overall_coverage(price_coverage_by_source(spark, sf_dir))


@query("SELECT count(*) AS total, count(CASE WHEN l_extendedprice > 0 THEN 1 END) AS priced, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS synced, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def catalog_overall_stats(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").agg(F.count("*").alias("total"), F.count_if(F.col("l_extendedprice") > 0).alias("priced"), F.count_if(F.col("l_linestatus") == "F").alias("synced"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def category_histogram(spark, sf_dir):
    return aggregates.histogram(read(spark, sf_dir, "part"), "p_type")


@query("SELECT brand, count(*) AS n FROM (SELECT p_brand || ' ' || p_type AS brand FROM part) WHERE brand IS NOT NULL GROUP BY brand ORDER BY n DESC, brand LIMIT 30")
def top_brands_30(spark, sf_dir):
    """The thirty most frequent of some 150 lines of brands: the limit is the feature."""
    return aggregates.histogram(read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("brand")), "brand", 30, nulls=False)


@query("SELECT l_orderkey, l_linenumber, p_name, s_name, o_orderstatus FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN orders ON l_orderkey = o_orderkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey, l_suppkey LIMIT 500")
def star_left_join_latest_500(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    newest = lines.orderBy(F.desc("l_orderkey"), F.desc("l_linenumber"), "l_partkey", "l_suppkey").limit(500)  # unique keys on the right: the limit may go first
    dims = [(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")), (read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")), (read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))]
    return joins.star(newest, dims).select("l_orderkey", "l_linenumber", "p_name", "s_name", "o_orderstatus")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def resume_anti_join(spark, sf_dir):
    seen = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return joins.not_yet(read(spark, sf_dir, "part"), seen, "p_partkey").select("p_partkey", "p_name")


@query("SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS children FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def eager_load_children(spark, sf_dir):
    parents = read(spark, sf_dir, "orders").select("o_orderkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    loaded = catalog.with_children(parents, lines, F.col("o_orderkey") == F.col("l_orderkey"), "l_orderkey", "lines", "l_linenumber", ["l_linenumber", "l_partkey"])
    return loaded.select("o_orderkey", F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("children"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_key(spark, sf_dir):
    return catalog.top_by(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC, l_extendedprice) AS n FROM lineitem WHERE l_returnflag <> 'R') WHERE n = 1")
def active_price(spark, sf_dir):
    active = read(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    return catalog.top_by(active, ["l_suppkey", "l_partkey"], [F.desc_nulls_last("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.col("l_extendedprice")]).drop("l_shipdate")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_occurrence_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return sequences.first_occurrence(docs, [F.col("h")], ["doc_id"]).select("doc_id")


@query("""WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT NULL AND lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, min(event_id) AS first_event FROM r GROUP BY user_id, run, event_type""")
def run_grouping(spark, sf_dir):
    found = sequences.runs(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return found.groupBy("user_id", F.col("run").cast("long").alias("run"), "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS purchase_id FROM events")
def nearest_preceding_merge(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return joins.nearest_preceding(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id"), "purchase_id").select("event_id", "purchase_id")


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15 OFFSET 30")
def paginate(spark, sf_dir):
    return catalog.page(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], 3, 15)


@query("SELECT count(*) AS total, CAST(3 AS BIGINT) AS current_page, CAST(greatest(1, ceil(count(*) / 15)) AS BIGINT) AS last_page, CAST(31 AS BIGINT) AS from_row, least(45, count(*)) AS to_row, 3 < greatest(1, ceil(count(*) / 15)) AS has_next, true AS has_prev FROM part")
def page_meta(spark, sf_dir):
    return catalog.page_meta(read(spark, sf_dir, "part"), 3, 15)


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%an%' ORDER BY p_name, p_partkey LIMIT 20")
def search_ilike(spark, sf_dir):
    return catalog.search(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "AN", [F.col("p_name"), F.col("p_partkey")])


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def in_list(spark, sf_dir):
    return catalog.in_list(read(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "c_name")


@query(f"SELECT l_orderkey, l_linenumber FROM (SELECT *, {PRICED} AS price FROM lineitem) WHERE price IS NULL OR price = 0")
def missing_value(spark, sf_dir):
    return catalog.missing_value(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(PRICED).alias("price")), "price").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1') AND p_size = 7 AND p_retailprice > 0")
def grid_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").alias("category"), F.col("p_retailprice").alias("price"))
    return catalog.grid(rows, "BRAND#1", 7, True, ("p_name", "p_brand", "p_type")).select("p_partkey")


@query("""SELECT o_custkey, count(*) AS total, count(CASE WHEN s <> 'pending' THEN 1 END) AS reviewed, count(CASE WHEN s IN ('approved', 'corrected') THEN 1 END) AS approved, count(CASE WHEN s = 'rejected' THEN 1 END) AS rejected,
CASE WHEN count(CASE WHEN s <> 'pending' THEN 1 END) = count(*) THEN 'completed' ELSE 'reviewing' END AS status
FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' ELSE 'pending' END AS s FROM orders) GROUP BY o_custkey""")
def group_status_counters(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "rejected").otherwise("pending")
    return aggregates.session_counters(read(spark, sf_dir, "orders").select("o_custkey", status.alias("s")), "o_custkey", "s")


@query("SELECT lang, round(coalesce(avg(quality), 0.0), 6) AS mean_confidence FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def mean_confidence(spark, sf_dir):
    both = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return both.groupBy("lang").agg(F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 6).alias("mean_confidence"))


WORDS_SQL = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{3,}}'))"


@query(f"""WITH d AS (SELECT doc_id, unnest({WORDS_SQL.format('text')}) AS w FROM documents), b AS (SELECT item_id, unnest({WORDS_SQL.format('text')}) AS w FROM benchmark),
dn AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), bn AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1),
s AS (SELECT doc_id, item_id, count(*) AS k FROM d JOIN b USING (w) GROUP BY 1, 2),
j AS (SELECT doc_id, item_id, k / (dn.n + bn.n - k) AS jaccard FROM s JOIN dn USING (doc_id) JOIN bn USING (item_id))
SELECT doc_id AS left_id, item_id AS right_id, round(jaccard, 6) AS jaccard, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY jaccard DESC, item_id) AS INTEGER) AS rank FROM j WHERE jaccard >= 0.2) WHERE rank <= 3""")
def similarity_best_match(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return joins.similar(docs, items, 0.2, 3).withColumn("jaccard", F.round("jaccard", 6))


@query(f"""SELECT doc_id, len(a) AS n_first, len(b) AS n_rest, len(list_intersect(a, b)) AS n_both, len(list_distinct(list_concat(a, b))) AS n_all
FROM (SELECT doc_id, {WORDS_SQL.format("split_part(text, chr(10), 1)")} AS a, {WORDS_SQL.format("substr(text, length(split_part(text, chr(10), 1)) + 1)")} AS b FROM documents)""")
def token_set_ops(spark, sf_dir):
    line = F.substring_index("text", "\n", 1)
    rest = F.substr(F.col("text"), F.length(line) + 1)
    sets = read(spark, sf_dir, "documents").select("doc_id", text.word_set(line).alias("a"), text.word_set(rest).alias("b"))
    return sets.select("doc_id", *[F.size(x).cast("long").alias(n) for n, x in (("n_first", F.col("a")), ("n_rest", F.col("b")), ("n_both", F.array_intersect("a", "b")), ("n_all", F.array_union("a", "b")))])


COMMON = ["the", "and", "of", "to", "in", "die", "der", "und", "de", "la", "que", "les"]


@query(f"SELECT doc_id, round(coalesce(len(list_filter(w, lambda x: list_contains({COMMON}, x))) / nullif(len(w), 0), 0.0), 6) AS density FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents)")
def keyword_density(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.round(documents.density(F.col("text"), COMMON), 6).alias("density"))


def _vote_sql() -> str:
    votes = ", ".join("{'n': " + " + ".join(f"CAST(contains(t, '{s}') AS INTEGER)" for s in signals) + f", 'k': {-k}, 'name': '{name}'" + "}" for k, (name, signals) in enumerate(documents.DOCUMENT_TYPES.items()))
    return f"SELECT page_id, CASE WHEN b.n > 0 THEN b.name END AS doc_type FROM (SELECT page_id, list_max([{votes}]) AS b FROM (SELECT page_id, lower(substr(html, 1, 3000)) AS t FROM pages))"


@query(_vote_sql())
def doc_type_vote(spark, sf_dir):
    """The type of each page by its first 3000 characters, which is where the feature looks."""
    return read(spark, sf_dir, "pages").select("page_id", documents.document_type(F.col("html")).alias("doc_type"))


def _labels_sql() -> str:
    d = documents
    units = "(mm|cm|m|kg|g|pcs|units?|pc|nos?|مل|سم|كج|قطعة)?"
    bare = d.NOTES.replace("(?iU)", "").removesuffix(r"\b")
    return f"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM l),
f AS (SELECT *, len(ws) AS n, len(list_filter(ws, lambda x: list_contains({d.HEADER_WORDS}, x))) AS heads, len(list_filter(ws, lambda x: regexp_full_match(x, '[0-9]+'))) AS digits, len(list_filter(ws, lambda x: list_contains({d.PRODUCT_WORDS}, x))) AS known,
    len(list_filter(ws, lambda x: regexp_full_match(x, '[0-9]+{units}'))) > 0 AS number, regexp_matches(t, '[0-9]') AS digit FROM w),
s AS (SELECT *, CASE WHEN regexp_matches(t, '^[0-9]+\\s+[\\p{{L}}\\p{{N}}_]') THEN 3 ELSE 0 END + CASE WHEN known >= 2 THEN 3 WHEN known = 1 THEN 1 ELSE 0 END + CASE WHEN number THEN 2 ELSE 0 END + CASE WHEN digit THEN 1 ELSE 0 END AS score FROM f),
r AS (SELECT doc_id, CASE WHEN t = '' THEN 'ignore:1.0' WHEN heads >= 2 AND digits <= 1 AND n <= 12 THEN 'table_header:0.85' WHEN regexp_matches(t, '{d.TOTAL}') THEN 'total:0.85' WHEN regexp_matches(t, '{d.BANK}') THEN 'bank_info:0.88' WHEN regexp_matches(t, '{d.PAYMENT}') THEN 'payment_info:0.82'
    WHEN regexp_matches(t, '(?i){bare}([^\\p{{L}}\\p{{N}}_]|$)') THEN 'notes:0.78' WHEN n < 3 AND NOT digit THEN 'metadata:0.60' WHEN score >= 3 THEN 'product_row:' || least(0.99, 0.55 + 0.08 * score) ELSE 'ignore:0.60' END AS x FROM s),
c AS (SELECT doc_id, split_part(x, ':', 1) AS label, split_part(x, ':', 2)::DOUBLE AS confidence FROM r)
SELECT doc_id, label, count(*) AS n, count(*) FILTER (confidence < {d.REVIEW_BELOW}) AS to_review, round(max(confidence), 4) AS best FROM c GROUP BY 1, 2"""


@query(_labels_sql())
def row_classify(spark, sf_dir):
    rows = documents.lines_of(read(spark, sf_dir, "documents"), "doc_id", "text")
    found = rows.select("doc_id", documents.row_label(F.col("line")).alias("r"))
    return found.groupBy("doc_id", F.col("r.label").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("r.confidence") < documents.REVIEW_BELOW).alias("to_review"), F.round(F.max("r.confidence"), 4).alias("best"))


def _regions_sql() -> str:
    kinds = " ".join(f"WHEN regexp_matches(line, '{pattern}') THEN '{name}'" for name, pattern in documents.REGIONS)
    return f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
t AS (SELECT doc_id, line_no, CASE {kinds} ELSE 'product_list' END AS region_type FROM l),
c AS (SELECT *, CASE WHEN lag(region_type) OVER w <> region_type THEN 1 ELSE 0 END AS c FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
r AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM c)
SELECT doc_id, CAST(run AS BIGINT) AS run, region_type, CAST(min(line_no) AS INTEGER) AS first_block, CAST(max(line_no) AS INTEGER) AS last_block, count(*) AS n_blocks FROM r GROUP BY doc_id, run, region_type"""


@query(_regions_sql())
def region_detect(spark, sf_dir):
    rows = documents.lines_of(read(spark, sf_dir, "documents"), "doc_id", "text")
    return documents.regions(rows, ["doc_id"], "line_no", "line")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q, l_partkey % 1997 + 1 AS p, l_linenumber % 6 AS style FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN style = 0 THEN q + 0.5 WHEN style = 1 THEN q / 4 WHEN style = 2 THEN q + 1 WHEN style = 3 THEN q WHEN style = 4 AND q > 1 THEN q WHEN style = 4 THEN p END::DOUBLE AS quantity, CASE style WHEN 0 THEN 'pcs' END AS unit,
CASE WHEN style = 0 THEN 'explicit_unit' WHEN style = 1 THEN 'fraction' WHEN style = 2 THEN 'range_midpoint' WHEN style = 3 THEN 'trailing_integer' WHEN style = 4 AND q > 1 THEN 'reverse_calc' WHEN style = 4 THEN 'trailing_integer' ELSE 'none' END AS method FROM l""")
def quantity_parse(spark, sf_dir):
    """Quantities read back from lines that are written from lineitem in six styles, one a branch."""
    q, p = F.col("l_quantity").cast("int"), F.col("l_partkey") % 1997 + 1
    parts = [(q, ",5 pcs of material"), ("item ", q, "/4 of stock"), ("order ", q, "-", q + 2, " of pipe"), ("some text ", q), ("مضخة ", q, " ", p, " ", q * p), ("no number here",)]
    lines = [F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in part]) for part in parts]
    line = F.coalesce(*[F.when(F.col("l_linenumber") % 6 == k, x) for k, x in enumerate(lines)])
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.quantity(line).alias("q")).select("l_orderkey", "l_linenumber", "q.quantity", "q.unit", "q.method")


#: Every known spelling, some in capitals, some with blanks and points about them, and two unknown ones.
RAW_UNITS = [(f" {a.upper()} " if k % 3 == 0 else f"{a}." if k % 3 == 1 else a.replace(" ", "  "), *units.ALIASES[a]) for k, a in enumerate(units.ALIASES)] + [("furlong", None, None), ("", None, None)]


@query("SELECT l_orderkey, l_linenumber, u.unit, u.category FROM lineitem JOIN (VALUES " + ", ".join(f"({k}, {'NULL' if u is None else repr(u)}, {'NULL' if c is None else repr(c)})" for k, (_, u, c) in enumerate(RAW_UNITS)) + f") u(k, unit, category) ON (l_partkey + l_linenumber) % {len(RAW_UNITS)} = u.k")
def unit_normalize(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(r[0]) for r in RAW_UNITS]), ((F.col("l_partkey") + F.col("l_linenumber")) % len(RAW_UNITS) + 1).cast("int"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", units.unit(raw).alias("u")).select("l_orderkey", "l_linenumber", "u.unit", "u.category")


KEYWORDS = [k for known in documents.CATEGORIES.values() for k in known]


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(t, '{'|'.join(known)}') THEN '{name}'" for name, known in documents.CATEGORIES.items()) + f" END AS category FROM (SELECT p_partkey, lower(p_name || ' ' || {KEYWORDS}[1 + p_partkey % {len(KEYWORDS)}]) AS t FROM part)")
def category_infer(spark, sf_dir):
    """Categories of part names with each keyword behind them in turn."""
    word = F.element_at(F.array(*map(F.lit, KEYWORDS)), (F.col("p_partkey") % len(KEYWORDS) + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", documents.category(F.concat_ws(" ", "p_name", word)).alias("category"))


SLUG = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT doc_id, CASE WHEN s = '' THEN 'product' ELSE s END AS slug FROM (SELECT doc_id, substr({SLUG}, 1, 500) AS s FROM documents)")
def slugify_unicode(spark, sf_dir):
    """Slugs of whole texts; the feature keeps 500 characters of a slug."""
    return read(spark, sf_dir, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(replace(lower(strip_accents(replace(text, 'ß', 'ss'))), 'مضخة', 'mdkhh'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug_md5 FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'مضخة ' ELSE '' END || text AS text FROM documents)")
def slugify_ascii(spark, sf_dir):
    """Slugs in ASCII of whole texts in four languages, some with a word of Arabic."""
    said = F.concat(F.when(F.col("doc_id") % 2 == 0, "مضخة ").otherwise(""), "text")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.ascii_slug(said)).alias("slug_md5"))


@query("SELECT page_id, regexp_replace(list_last(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/')), '\\.[A-Za-z0-9]+$', '') AS slug, nullif(regexp_extract(url, '/[a-z][a-z]/([0-9]+)', 1), '') AS id FROM pages")
def url_slug(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", text.url_slug(url).alias("slug"), text.url_id(url, ["/[a-z][a-z]/([0-9]+)"]).alias("id"))


@query("""SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), '') AS title, len(list_distinct(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1))) AS n_links FROM pages""")
def html_h1_links(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", pages.heading(F.col("html")).alias("title"), F.size(pages.links(F.col("html"))).cast("long").alias("n_links"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g'))) AS text_md5 FROM pages")
def page_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(pages.page_text(F.col("html"))).alias("text_md5"))


@query()
def page_price(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", pages.page_price(F.col("html")).alias("p")).select("page_id", "p.price", "p.level")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_dig(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("SELECT p_partkey, sha256(p_name || '|' || p_brand || '|' || p_size) AS hash FROM part")
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.content_hash(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("hash"))


UPSERT_SQL = """WITH cur AS (SELECT p_partkey AS id, p_size AS source_id, CASE WHEN p_partkey % 3 = 0 THEN 'x' || p_partkey END AS external_id, 'u' || p_partkey AS url, 's' || (p_partkey % 500) AS sku FROM part WHERE p_partkey % 2 = 0),
inc AS (SELECT p_partkey AS n, p_size AS source_id, 'x' || p_partkey AS external_id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'u' || p_partkey END AS url, 's' || (p_partkey % 500) AS sku FROM part)"""


def _upsert(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    sku = F.concat(F.lit("s"), (F.col("p_partkey") % 500).cast("string")).alias("sku")
    cur = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("source_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x"), key)).alias("external_id"), F.concat(F.lit("u"), key).alias("url"), sku)
    inc = part.select(F.col("p_partkey").alias("n"), F.col("p_size").alias("source_id"), F.concat(F.lit("x"), key).alias("external_id"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("u"), key)).alias("url"), sku)
    return cur, inc


@query(UPSERT_SQL + """ SELECT n, coalesce(e.id, u.id, s.id) AS matched_id, CASE WHEN e.id IS NOT NULL THEN 'external_id' WHEN u.id IS NOT NULL THEN 'url' WHEN s.id IS NOT NULL THEN 'sku' END AS matched_by,
CASE WHEN coalesce(e.id, u.id, s.id) IS NULL THEN 'insert' ELSE 'update' END AS action FROM inc
LEFT JOIN (SELECT source_id, external_id, min(id) AS id FROM cur WHERE external_id <> '' GROUP BY 1, 2) e ON inc.source_id = e.source_id AND inc.external_id = e.external_id
LEFT JOIN (SELECT source_id, url, min(id) AS id FROM cur WHERE url <> '' GROUP BY 1, 2) u ON inc.source_id = u.source_id AND inc.url = u.url
LEFT JOIN (SELECT source_id, sku, min(id) AS id FROM cur WHERE sku <> '' GROUP BY 1, 2) s ON inc.source_id = s.source_id AND inc.sku = s.sku""")
def priority_upsert_plan(spark, sf_dir):
    cur, inc = _upsert(spark, sf_dir)
    return upserts.matched(cur, inc, "source_id", ["external_id", "url", "sku"], "id").select("n", "matched_id", "matched_by", "action")


@query("WITH cur AS (SELECT DISTINCT p_brand FROM part WHERE p_size <= 3), ids AS (SELECT row_number() OVER (ORDER BY p_brand) AS id, p_brand FROM cur), new AS (SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM cur)) SELECT id, p_brand FROM ids UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM ids) + row_number() OVER (ORDER BY p_brand), p_brand FROM new")
def dimension_get_or_create(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    cur = upserts.numbered(part.where("p_size <= 3").select("p_brand").distinct().repartitionByRange("p_brand").sortWithinPartitions("p_brand"), "id")
    return upserts.dimension(cur, part, ["p_brand"], "id")


@query("""WITH h AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) AS keyword, doc_id FROM documents), c AS (SELECT keyword, count(*) AS n FROM h WHERE doc_id % 2 = 1 GROUP BY 1), r AS (SELECT DISTINCT keyword FROM h WHERE doc_id % 2 = 0)
SELECT keyword, least(3.0, coalesce(CASE WHEN r.keyword IS NOT NULL THEN 0.5 END, 0) + 0.5 * coalesce(n, 0))::DOUBLE AS weight, CAST(coalesce(CASE WHEN r.keyword IS NOT NULL THEN 1 END, 0) + coalesce(n, 0) AS BIGINT) AS examples_count FROM r FULL JOIN c USING (keyword)""")
def rule_weight_upsert(spark, sf_dir):
    """Rules from the even documents' words, promoted by the odd ones: every document takes part."""
    docs = read(spark, sf_dir, "documents")
    hits = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("keyword"))
    rules = hits.where("doc_id % 2 = 0").select("keyword").distinct().select("keyword", F.lit(0.5).alias("weight"), F.lit(1).cast("long").alias("examples_count"))
    return upserts.promoted(rules, hits.where("doc_id % 2 = 1"), "keyword")


@query("SELECT p_partkey, new AS price, old AS old_price FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS old, CASE WHEN p_partkey % 7 = 0 THEN p_retailprice + 1 WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS new FROM part) WHERE new IS DISTINCT FROM old")
def null_safe_price_change(spark, sf_dir):
    part, key, price = read(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_retailprice")
    old = part.select("p_partkey", F.when(key % 11 != 0, price).alias("price"))
    new = part.select("p_partkey", F.when(key % 7 == 0, price + 1).when(key % 13 != 0, price).alias("price"))
    return upserts.changed_prices(old, new, ["p_partkey"])


@query("SELECT p_partkey, p_brand AS brand, CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) END AS size FROM part")
def push_metadata_json(spark, sf_dir):
    payload = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).alias("size")))
    return read(spark, sf_dir, "part").select("p_partkey", payload.alias("metadata")).select("p_partkey", F.get_json_object("metadata", "$.brand").alias("brand"), F.get_json_object("metadata", "$.size").alias("size"))


@query("""WITH t AS (SELECT doc_id, toxic = 1 AS t FROM labels), s AS (SELECT doc_id, n_chars > 1000 AS s FROM documents), b AS (SELECT coalesce(s, false) AS s, coalesce(t, false) AS t FROM s FULL JOIN t USING (doc_id)),
c AS (SELECT count(*) FILTER (s AND t) AS tp, count(*) FILTER (s AND NOT t) AS fp, count(*) FILTER (NOT s AND t) AS fn, count(*) FILTER (NOT s AND NOT t) AS tn FROM b)
SELECT *, round_even(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round_even(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round_even(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM c""")
def positional_eval(spark, sf_dir):
    said = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, "product").otherwise("other").alias("label"))
    truth = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "product").otherwise("other").alias("label"))
    return feedback.evaluated(said, truth, "doc_id")


@query("SELECT o_orderkey, CASE WHEN a AND b THEN 'o_orderstatus,o_totalprice' WHEN a THEN 'o_orderstatus' ELSE 'o_totalprice' END AS changed, CASE WHEN a THEN o_orderstatus END AS old_status FROM (SELECT *, o_orderkey % 3 = 0 AND o_orderstatus <> 'X' AS a, o_orderkey % 5 = 0 AS b FROM orders) WHERE a OR b")
def audit_diff(spark, sf_dir):
    old = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    found = feedback.differences(old, new, "o_orderkey", ["o_orderstatus", "o_totalprice"])
    return found.select("o_orderkey", F.array_join("changed_fields", ",").alias("changed"), F.try_element_at("old_values", F.lit("o_orderstatus")).alias("old_status"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 5 THEN -l_quantity ELSE l_quantity END AS q, CASE WHEN l_linenumber = 5 THEN -l_extendedprice ELSE l_extendedprice / l_quantity END AS p, CASE WHEN l_linenumber = 2 THEN l_extendedprice * 1.1 ELSE l_extendedprice END AS t FROM lineitem),
f AS (SELECT *, coalesce(q * p > 0 AND abs(q * p - t) / (q * p) <= 0.02, false) AS fits, list_filter([CASE WHEN q * p > 0 AND abs(q * p - t) / (q * p) > 0.02 THEN 'total_mismatch' END, CASE WHEN p < 1 AND q > 100 THEN 'possible_qty_price_swap' END, CASE WHEN q > 0 AND p > 0 AND abs(q - p) <= 0.001 * greatest(abs(q), abs(p)) THEN 'qty_equals_price' END, CASE WHEN q > 10000 THEN 'qty_very_large' END, CASE WHEN q IS NULL THEN 'unit_without_qty' END, CASE WHEN q < 0 THEN 'negative_qty' END, CASE WHEN p < 0 THEN 'negative_price' END], lambda x: x IS NOT NULL) AS flags FROM c)
SELECT l_orderkey, l_linenumber, array_to_string(flags, ',') AS flags, round(CASE WHEN len(flags) >= 2 THEN greatest(0.0, (CASE WHEN fits THEN 0.95 ELSE 0.9 END) - 0.1) ELSE (CASE WHEN fits THEN 0.95 ELSE 0.9 END) END, 4)::DOUBLE AS confidence, len(flags) >= 1 AS needs_review FROM f""")
def validate_candidates(spark, sf_dir):
    n, q, x = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_extendedprice")
    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit("product").alias("predicted_label"), F.when(n == 5, -q).when(n != 3, q).alias("quantity"), F.when(n == 5, -x).otherwise(x / q).alias("price"),
        F.when(n == 2, x * 1.1).otherwise(x).alias("total"), F.lit("pc").alias("unit"), F.lit(0.9).alias("confidence"), F.lit(False).alias("needs_review"))
    return documents.validated(rows).select("l_orderkey", "l_linenumber", F.array_join("validation_flags", ",").alias("flags"), F.round("confidence", 4).alias("confidence"), "needs_review")


@query("SELECT l_suppkey, CAST(floor((n - 1) / 50) AS BIGINT) AS batch, count(*) AS n FROM (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) GROUP BY 1, 2")
def batch_number(spark, sf_dir):
    found = sequences.batches(read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"], ["l_orderkey", "l_linenumber"], 50)
    return found.groupBy("l_suppkey", "batch").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN a > 0.70 * (a + l) THEN 'ar' WHEN a > 0.20 * (a + l) THEN 'mixed' ELSE 'en' END AS language FROM (SELECT doc_id, length(regexp_replace(text, '[^\\x{0600}-\\x{06FF}]', '', 'g')) AS a, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM (SELECT doc_id, text || repeat(' مضخة', CASE doc_id % 3 WHEN 0 THEN n_chars WHEN 1 THEN n_chars // 8 ELSE 0 END) AS text FROM documents))")
def language_detect(spark, sf_dir):
    """Texts with much, some or no Arabic behind them."""
    arabic = F.expr("repeat(' مضخة', CAST(CASE doc_id % 3 WHEN 0 THEN n_chars WHEN 1 THEN n_chars DIV 8 ELSE 0 END AS INT))")
    return read(spark, sf_dir, "documents").select("doc_id", text.language(F.concat("text", arabic)).alias("language"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS price, CASE WHEN l_quantity > 0 THEN round_even(l_extendedprice / (l_extendedprice / l_quantity), 0) END AS quantity FROM lineitem")
def price_and_quantity(spark, sf_dir):
    """Prices read back from formatted texts, quantities inferred from total and price."""
    x, q = F.col("l_extendedprice"), F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.currency_price(F.concat(F.lit("about 2 boxes, SAR "), F.format_number(x, 2))).alias("price"), numbers.inferred_quantity(x, x / q).alias("quantity"))


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey IS NOT NULL GROUP BY 1")
def foreign_keys(spark, sf_dir):
    """Lines by flag, after the check that none refers to a missing part."""
    lines, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part").select("p_partkey")
    orphans = catalog.integrity(lines, part, "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber")
    return lines.join(orphans, ["l_orderkey", "l_linenumber"], "left_anti").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("keys"))


STEP = "CASE WHEN (conv_id + turn) % 3 = 0 OR conv_id % 7 < 2 THEN -0.3 ELSE 0.5 END"


@query(f"""WITH w AS (SELECT turn % 2 AS side, list_reduce(list_prepend(0.0::DOUBLE, list(({STEP})::DOUBLE ORDER BY conv_id, turn)), lambda w, s: greatest(0.0, least(3.0, w + s))) AS weight FROM conversations GROUP BY 1)
SELECT side, round(weight, 4) AS weight, weight > 1e-9 AS is_active FROM w""")
def clamped_weights(spark, sf_dir):
    """Promotions and demotions of two keys in order, clamped after each."""
    events = read(spark, sf_dir, "conversations").select((F.col("turn") % 2).alias("side"), F.struct("conv_id", "turn").alias("seq"), F.expr(STEP).cast("double").alias("step"))
    return upserts.folded(events, "side", "seq").select("side", F.round("weight", 4).alias("weight"), (F.col("weight") > 1e-9).alias("is_active"))


@query("SELECT n_nationkey, 'INSERT INTO nation VALUES (' || n_nationkey || ', ' || '''' || replace(n_name, '''', '''''') || '''' || ');' AS statement FROM nation")
def sql_dump_rows(spark, sf_dir):
    return sql_dump.statements(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "nation", keep=["n_nationkey"])


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type")
def stream_changes(spark, sf_dir):
    """The events drained as a stream in one availableNow run, then counted."""
    found = drained(spark, f"{sf_dir}/events.parquet", ["event_id", "event_type"])
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
