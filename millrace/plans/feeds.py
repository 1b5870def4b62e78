"""Registered queries over tables, pages and layouts that are written from the given tables in many forms, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import layout, markup, orchestration, pages, sheets, structured
from ..streaming.changes import shared_folder
from .queries import query, read


def numbered_lines(spark, sf_dir) -> DataFrame:
    """Lineitem with k (order), rn (from 1 in the order), part, q, and price and total in quarters, which are exact."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("int").alias("q"), F.col("l_linestatus").alias("status"))
    over = Window.partitionBy("k").orderBy("l_linenumber", "part", "supp", "q")  # by k under its final name, so that what follows by k isn't dealt again
    price = (F.col("part") % 1997 + 0.25).cast("double")
    return rows.select("k", F.row_number().over(over).alias("rn"), "part", "supp", "q", "status", price.alias("p"), (price * F.col("q")).alias("t"))


LINES = """(SELECT l_orderkey AS k, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS INTEGER) AS rn, l_partkey AS part, l_suppkey AS supp, CAST(l_quantity AS INTEGER) AS q, l_linestatus AS status,
    CAST(l_partkey % 1997 + 0.25 AS DOUBLE) AS p, CAST(l_partkey % 1997 + 0.25 AS DOUBLE) * CAST(l_quantity AS INTEGER) AS t FROM lineitem)"""


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


HEADERS = [
    ["Product_Name", "Quantity", "Unit", "Price", "Brand"], ["S.No", "ITEM", "Qty", " UOM ", "Unit  Price", "Total"], ["اسم الصنف", "الكمية", "وحدة", "سعر الوحدة", "المجموع"],
    ["SKU", "Description", "Rate", "Amount", "Classification"], ["Code", "Name", "Maker", "Price"],
]


@query(f"""WITH r AS (SELECT *, k % 5 AS form FROM {LINES}),
c AS (SELECT k, rn - 1 AS position, form,
    CASE form WHEN 0 THEN 'steel pipe ' || part WHEN 1 THEN CASE WHEN rn % 4 <> 0 THEN 'elbow ' || part END WHEN 2 THEN 'مضخة ' || part WHEN 3 THEN 'Copper rod ' || part ELSE q || ' kg cement ' || part END AS product_name,
    CASE form WHEN 0 THEN 'Building Materials' WHEN 1 THEN 'Plumbing' WHEN 2 THEN 'Mechanical' WHEN 3 THEN CASE WHEN status = 'O' THEN 'Class ' || status ELSE 'Hardware' END ELSE 'Building Materials' END AS category,
    CASE form WHEN 0 THEN 'Brand ' || supp WHEN 4 THEN 'Maker ' || supp END AS brand, CASE form WHEN 0 THEN q + 0.5 ELSE q END::DOUBLE AS quantity,
    CASE form WHEN 0 THEN 'pc' WHEN 1 THEN 'm' WHEN 2 THEN 'pc' WHEN 4 THEN 'kg' END AS unit, p AS price, CASE WHEN form IN (1, 2, 3) THEN t END AS total, CASE form WHEN 3 THEN 'SK-' || part WHEN 4 THEN 'C' || part END AS model_code,
    CASE WHEN form IN (1, 2, 3) THEN 0.97 ELSE 0.92 END::DOUBLE AS confidence FROM r)
SELECT * EXCLUDE (form) FROM c WHERE product_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k, lower(product_name), quantity, price ORDER BY position) = 1""")
def sheet_candidates(spark, sf_dir):
    """Candidates of one file an order, in five layouts, Arabic and English, each read by its own header."""
    r = numbered_lines(spark, sf_dir).withColumn("form", F.col("k") % 5)
    part, q, price, total = F.col("part"), F.col("q"), F.format_number("p", 2), F.format_number("t", 2)
    bodies = [
        F.array(text("steel pipe ", part), text(q, ",5"), F.lit("PCS"), price, text("Brand ", F.col("supp"))),
        F.array(F.col("rn").cast("string"), F.when(F.col("rn") % 4 != 0, text("elbow ", part)).otherwise("  "), F.when(F.col("rn") % 3 != 2, q.cast("string")).otherwise(""), F.lit("mtr"), price, total),
        F.array(text(" مضخة ", part), q.cast("string"), F.lit("قطعة"), price, total),
        F.array(text("SK-", part), text("Copper rod ", part), price, total, F.when(F.col("status") == "O", text("Class ", F.col("status"))).otherwise("")),
        F.array(text("C", part), text(q, " kg cement ", part), text("Maker ", F.col("supp")), price),
    ]
    body, head = F.when(F.lit(False), F.array(F.lit(""))), F.when(F.lit(False), F.array(F.lit("")))
    for form, cells in enumerate(bodies):
        body, head = body.when(F.col("form") == form, cells), head.when(F.col("form") == form, F.array(*map(F.lit, HEADERS[form])))
    rows = r.select("k", F.lit(0).alias("table_no"), F.col("rn").alias("row_no"), body.alias("cells")).unionByName(r.select("k", "form").distinct().select("k", F.lit(0).alias("table_no"), F.lit(0).alias("row_no"), head.alias("cells")))
    found = sheets.candidates(rows, ["k"])
    code = F.when(F.col("k") % 5 >= 3, F.col("model_code"))
    return found.select("k", "position", "product_name", "category", "brand", "quantity", "unit", "price", "total", code.alias("model_code"), F.round("confidence", 4).alias("confidence"))


@query(f"""WITH r AS (SELECT * FROM {LINES}), o AS (SELECT DISTINCT k FROM r)
SELECT k, 20 AS y, CASE WHEN k % 6 = 0 THEN 'Total quality item' ELSE 'Total quality|item|-|-' END AS line FROM o
UNION ALL SELECT k, 180, CASE WHEN k % 6 = 0 THEN 'Particulars Count' ELSE 'Description of Goods|Qty|Unit Price|Total' END FROM o
UNION ALL SELECT k, 200 + 12 * rn, CASE WHEN k % 6 = 0 THEN 'steel pipe ' || part || ' ' || q ELSE 'steel pipe ' || part || '|' || CASE WHEN rn % 4 = 0 THEN '-' ELSE q::VARCHAR END || '|' || printf('%.2f', p) || '|' || printf('%.2f', t) END FROM r""")
def layout_lines(spark, sf_dir):
    """Tables of orders as words with places on a page, some pages without a header, read back as lines."""
    r = numbered_lines(spark, sf_dir)

    def word(text_, x0, x1, top) -> Column:
        return F.struct((F.lit(text_) if isinstance(text_, str) else text_.cast("string")).alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), (F.lit(float(top)) if isinstance(top, float) else top).cast("double").alias("top"))

    plain = F.col("k") % 6 == 0
    top = 200 + 12 * F.col("rn") + 0.4 * (F.col("rn") % 3)
    name = [word("steel", 50, 75, top), word("pipe", 80, 100, top + 0.3), word(F.col("part"), 104, 130, top)]
    amounts = [word(F.when(F.col("rn") % 4 != 0, F.col("q")), 240, 255, top), word(F.format_string("%.2f", "p"), 322, 350, top), word(F.format_string("%.2f", "t"), 410, 450, top)]
    body = F.when(plain, F.array(*name, word(F.col("q"), 240, 255, top))).otherwise(F.array(*name, *amounts))
    logo = [word("Total", 50, 80, 20.0), word("quality", 100, 140, 20.0), word("item", 300, 330, 20.0)]
    head = [word("Description", 50, 110, 180.0), word("of", 112, 120, 180.0), word("Goods", 123, 150, 180.2), word("Qty", 250, 270, 180.0), word("Unit", 320, 340, 180.0), word("Price", 343, 370, 180.4), word("Total", 420, 450, 180.0)]
    other = [word("Particulars", 50, 110, 180.0), word("Count", 240, 270, 180.0)]
    upper = F.when(plain, F.array(*logo, *other)).otherwise(F.array(*logo, *head))  # once a page, with its first line
    words = r.select("k", F.explode(F.when(F.col("rn") == 1, F.concat(upper, body)).otherwise(body)).alias("w")).select("k", "w.*")
    return layout.table_lines(words, ["k"]).select("k", F.col("y").cast("int").alias("y"), "line")


def listing_pages(spark, sf_dir) -> DataFrame:
    """One page an order (k, html): a card a line, within lists, boxes and tags left open; every third card states no price."""
    lines = numbered_lines(spark, sf_dir).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("rn", "part", "p"))).alias("lines"))

    def card(r: Column) -> Column:
        part = r["part"]
        price = F.when(r["rn"] % 3 != 0, text("<p>Was</p><span>", F.format_string("%.2f", r["p"]), "</span>")).otherwise("<p>ask</p>")
        return text('<div class="product card" data-id="', part, '"><a href=/ar/pipe/p', part, '><img src="a>b.png"><h3 class=\'name big\'>steel <b>pipe</b>\n ', part, '</h3></a><div class="meta"><i class=sku>SK-', part, '</i></div><div class="box">', price, "</div></div>")

    cards = lines.select("k", F.array_join(F.transform("lines", card), "\n").alias("cards"))
    html = text('<!DOCTYPE html><html><body><!-- <div class="card"> --><h1>Order ', F.col("k"), '</h1><ul class="nav"><li>a<li>b</ul><div class="grid">', F.col("cards"), '</div><script>var a = "<div class=card>";</script><p>9.99</p><p>no card</p></body></html>')
    return cards.select("k", html.alias("html"))


@query(f"""WITH r AS (SELECT *, CASE WHEN rn % 3 <> 0 THEN p END AS own FROM {LINES})
SELECT k, part::VARCHAR AS data_id, '/ar/pipe/p' || part AS href, 'steel pipe ' || part AS name, 'SK-' || part AS sku, coalesce(own, first_value(p) OVER (PARTITION BY k ORDER BY rn)) AS price FROM r""")
def listing_cards(spark, sf_dir):
    """Cards of listing pages with what stands inside them, and the strict price of the nearest of four ancestors that has one."""
    div, link = (lambda x: markup.selector("div", ("card",), of=x)), (lambda x: markup.selector("a", (), {"href": None}, of=x))
    pages_ = markup.nested(listing_pages(spark, sf_dir), "k", div, link)
    found = markup.held(pages_, "k", {"name": lambda x: markup.selector("h3", ("name",), of=x), "sku": lambda x: markup.selector(classes=("sku",), of=x)})
    return found.select("k", markup.attribute(F.col("card"), "data-id").alias("data_id"), markup.attribute(F.col("anchor"), "href").alias("href"), "name", "sku", F.col("value").try_cast("double").alias("price"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z]')) AS n_elements, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), '') AS heading,
    len(regexp_extract_all(regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1), '(?i)<a\\s[^>]*href')) AS n_links FROM pages""")
def page_elements(spark, sf_dir):
    """The given pages as trees: elements, the first heading, links inside the body."""
    shared_folder(spark)
    rows = markup.tokens(read(spark, sf_dir, "pages"), "page_id").checkpoint()
    tree = markup.elements(rows, "page_id").checkpoint()
    first = tree.where(markup.selector("h1")).groupBy("page_id").agg(F.min(F.struct("n", "stop")).alias("e")).select("page_id", "e.*")
    links = markup.inside(tree.where(markup.selector("a", (), {"href": None})).select("page_id", "n", "stop"), tree.where(markup.selector("body")), "page_id")
    out = tree.groupBy("page_id").agg(F.count("*").alias("n_elements")).join(markup.texts(first, rows, "page_id").select("page_id", F.nullif("text", F.lit("")).alias("heading")), "page_id", "left").join(links.groupBy("page_id").agg(F.count("*").alias("n_links")), "page_id", "left")
    every = read(spark, sf_dir, "pages").select("page_id").join(out, "page_id", "left")
    return every.select("page_id", F.coalesce("n_elements", F.lit(0)).alias("n_elements"), "heading", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def part_pages(spark, sf_dir) -> DataFrame:
    """One page a part (id, html) whose JSON-LD says the part in one of six nestings; a later script states another price."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", F.format_number("p_retailprice", 2).alias("price"))
    i, name, brand, price = F.col("id"), F.col("p_name"), F.col("p_brand"), F.col("price")
    product = lambda offers: text('{"@type":"Product","name":"', name, " ", i, '","sku":"S', i, '","brand":{"name":"', brand, '"},"offers":', *offers, "}")
    one, first = ['{"price":"', price, '","priceCurrency":"SAR"}'], ['[{"price":', i, '.5,"priceCurrency":"USD"},{"price":99}]']
    blocks = [
        product(one), text('{"@context":"x","@graph":[{"@type":"WebSite","name":"site"},{"@type":["Thing","Product"],"name":"', name, '","offers":', *first, "}]}"), text('{"@type":"ItemList","itemListElement":[{"item":', product(one), '},{"item":{"@type":"Product","name":"second ', i, '"}}]}'),
        text('[{"@type":"Product","name":" ', name, ' ","brand":"', brand, '"},{"@type":"Organization","name":"org"}]'), text('{"@type":"Product",</script><script type="application/ld+json">', product(first)), text('{"@type":"WebPage","mainEntity":{"@type":"ItemList","itemListElement":[{"item":{"@graph":[', product(one), "]}}]}}"),
    ]
    block = F.coalesce(*[F.when(i % 6 == k, b) for k, b in enumerate(blocks)])
    return part.select("id", text('<html><SCRIPT id="x" type=\'application/ld+json\'>', block, '</SCRIPT><script>var x = {"price": 7};</script></html>').alias("html"))


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 6 AS form, p_name, p_brand, p_retailprice AS price FROM part)
SELECT id, CASE form WHEN 4 THEN 1 ELSE 0 END AS block, CASE WHEN form IN (1, 3) THEN p_name ELSE p_name || ' ' || id END AS name, CASE WHEN form NOT IN (1, 3) THEN 'S' || id END AS sku, CASE WHEN form <> 1 THEN p_brand END AS brand,
    CASE WHEN form IN (0, 2, 5) THEN round(price, 2) WHEN form IN (1, 4) THEN id + 0.5 END::DOUBLE AS price, CASE WHEN form IN (0, 2, 5) THEN 'SAR' WHEN form IN (1, 4) THEN 'USD' END AS currency FROM p
UNION ALL SELECT id, 0, 'second ' || id, NULL, NULL, NULL, NULL FROM p WHERE form = 2""")
def json_ld_products(spark, sf_dir):
    """Products of JSON-LD blocks in six nestings: alone, in a graph, in lists, behind a broken block, five levels deep."""
    return structured.json_ld_products(part_pages(spark, sf_dir), ["id"]).select("id", "block", "name", "sku", "brand", F.round("price", 2).alias("price"), "currency")


@query(f"""SELECT k, rn - 1 AS n, 'pipe [' || part || ' "x" ]' AS name, 'S' || part AS sku, p AS price, CASE WHEN k % 2 = 0 THEN 0 ELSE 3 END AS marker FROM {LINES}""")
def script_products(spark, sf_dir):
    """Lists of products inside scripts, with brackets in their texts and inner lists; a list that never ends gives nothing."""
    r = numbered_lines(spark, sf_dir)
    item = text('{"name":"pipe [', F.col("part"), ' \\"x\\" ]","tags":["a]",["b"]],"sku":"S', F.col("part"), '","price":', F.when(F.col("rn") % 2 == 0, text('{"amount":"', F.format_number("p", 2), '"}')).otherwise(text(F.format_string("%.2f", "p"))), "}")
    items = r.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", item.alias("i")))), lambda x: x["i"]), ",").alias("items"))
    name = F.when(F.col("k") % 2 == 0, "window.__products = ").otherwise("var productsData=")
    html = text("<p>[</p><script>", name, "[", F.col("items"), '];</script><script>var z = [1, [2]]; salla.product.list = [{"name": "open"</script>')
    return structured.script_products(items.select("k", html.alias("html")), ["k"]).select("k", "n", "name", "sku", "price", "marker")


@query("""SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 8 THEN NULL ELSE round(p_retailprice, 2) END AS price, CASE p_partkey % 9 WHEN 0 THEN 'json_ld' WHEN 1 THEN 'meta' WHEN 2 THEN 'itemprop' WHEN 3 THEN 'itemprop_text' WHEN 4 THEN 'data' WHEN 5 THEN 'class' WHEN 6 THEN 'currency' WHEN 7 THEN 'script' END AS level FROM part""")
def page_price_levels(spark, sf_dir):
    """Prices of pages that state them on one level of the cascade each, beside decoys of the level and lower ones; some state none."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.format_number("p_retailprice", 2).alias("x"), F.format_string("%.2f", "p_retailprice").alias("y"))
    x, y = F.col("x"), F.col("y")
    forms = [
        text('<script type="application/ld+json">{"@type":"Product","offers":{"price":"', y, '"}}</script><script>{"price": 3}</script>'), text('<script type="application/ld+json">{"name":"n"}</script><script>{"price": 3}</script><meta property="og:price:currency" content="5"><meta property="product:price:amount" content="', x, '">'),
        text('<b itemprop="priceCurrency" content="4"></b><b itemprop="price" content="', x, '"></b><i class="price">6</i>'), text('<b itemprop="price"> ', x, ' </b><i data-price="8"></i>'), text('<i data-prices="2" data-price="', x, '"></i><i class="price">6</i>'),
        text('<i class="prices">2</i><div class="big price"><b>', x, "</b></div>SAR 8"), text("<p>2 SUR</p><p>for SAR ", x, " only</p><script>price = 3</script>"), text("<script>var prices = 2, price = ", y, ";</script>"), text('<p>ask</p><meta property="product:price:amount" content="none"><i data-price="0"></i>'),
    ]
    found = part.select("id", pages.page_price(F.coalesce(*[F.when(F.col("id") % 9 == k, f) for k, f in enumerate(forms)])).alias("f"))
    return found.select("id", F.round("f.price", 2).alias("price"), F.col("f.level").alias("level"))


def order_documents(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Tables and blocks of one document an order: a table of products, a list behind a table of banks, a letter, a lone block, totals alone."""
    r = numbered_lines(spark, sf_dir).withColumn("form", F.col("k") % 5)
    line = text(F.col("q"), " pcs steel pipe P", F.col("part"))
    amount = F.floor("p").cast("string")
    body = r.where("form = 0").select("k", F.lit(0).alias("table_no"), F.col("rn").alias("row_no"), F.lit(False).alias("is_header"), F.array(line, F.lit(""), amount, F.lit("9")).alias("cells"))
    one = r.select("k", "form").distinct()
    heads = one.where("form in (0, 1)").select("k", F.lit(0).alias("table_no"), F.lit(0).alias("row_no"), F.lit(True).alias("is_header"), F.when(F.col("form") == 0, F.array(F.lit("Item"), F.lit("x"), F.lit("Unit Price"))).otherwise(F.array(F.lit("Terms"), F.lit("y"))).alias("cells"))
    banks = one.where("form = 1").select("k", F.lit(0).alias("table_no"), F.lit(1).alias("row_no"), F.lit(False).alias("is_header"), F.array(F.lit("iban"), F.lit("ours")).alias("cells"))
    listed = r.where("form in (1, 3)").groupBy("k", "form").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.concat_ws(" ", line, amount, F.lit("9")).alias("l")))), lambda x: x["l"]), "\n").alias("list"))
    blocks = listed.where("form = 1").select("k", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("Invoice").alias("t")), F.struct(F.lit(1).alias("n"), F.lit(" ").alias("t")), F.struct(F.lit(5).alias("n"), F.col("list").alias("t")), F.struct(F.lit(6).alias("n"), F.lit("payment terms 5 pcs pipe").alias("t")))).alias("b"))
    lone = listed.where("form = 3").select("k", F.struct(F.lit(0).alias("n"), F.concat(F.lit("qty unit price item\n"), F.col("list")).alias("t")).alias("b"))
    letters = one.where("form = 2").select("k", F.struct(F.lit(0).alias("n"), F.lit("Dear friend, 12 kg steel pipe went by road").alias("t")).alias("b"))
    totals = one.where("form = 4").select("k", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("qty price item").alias("t")), F.struct(F.lit(1).alias("n"), F.lit("grand total 5 pcs pipe 9 9").alias("t")))).alias("b"))
    every = blocks.unionByName(lone).unionByName(letters).unionByName(totals).select("k", F.col("b.n").alias("block_no"), F.col("b.t").alias("text"))
    shared_folder(spark)
    return body.unionByName(heads).unionByName(banks).checkpoint(), every.checkpoint()  # read by detection, regions and rows


@query(f"SELECT DISTINCT k, q || ' pcs steel pipe P' || part || CASE WHEN k % 5 = 0 THEN ' | ' || floor(p)::BIGINT || ' | 9' ELSE ' ' || floor(p)::BIGINT || ' 9' END AS product_name, q::DOUBLE AS quantity, 'pc' AS unit, floor(p) AS price FROM {LINES} WHERE k % 5 IN (0, 1, 3)")
def orchestrated_products(spark, sf_dir):
    """Products of documents by detection, regions and rows; letters leave early, and a lone block is the fallback."""
    return orchestration.extracted_products(*order_documents(spark, sf_dir), ["k"]).select("k", "product_name", "quantity", "unit", "price")


@query("SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 0 END AS region, CASE o_orderkey % 5 WHEN 0 THEN 'product_table' ELSE 'product_list' END AS region_type FROM orders WHERE o_orderkey % 5 <> 2 AND o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey % 5 <> 1 UNION ALL SELECT o_orderkey, 2, 'product_list' FROM orders WHERE o_orderkey % 5 = 1 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def product_regions(spark, sf_dir):
    """The regions of documents that hold products, tables before blocks, with the fallback."""
    tables, blocks = order_documents(spark, sf_dir)
    found = orchestration.regions(tables, blocks, ["k"], orchestration.detected(tables, blocks, ["k"]))
    return found.where(F.col("region_type").isin(orchestration.PRODUCT_REGIONS)).select("k", "region", "region_type")
