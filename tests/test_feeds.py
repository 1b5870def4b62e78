"""Tables by their headers, lines from layout, element trees and structured data, on small cases."""

import zipfile

from pyspark.sql import functions as F

from millrace.operators import layout, markup, pages, sheets, structured
from millrace.sources import readers


def csv_candidates(spark, tmp_path, **files):
    for name, content in files.items():
        (tmp_path / f"{name}.csv").write_bytes(content.encode() if isinstance(content, str) else content)
    rows = readers.csv_documents(readers.files(spark, str(tmp_path)))
    return sheets.candidates(rows.withColumn("path", F.regexp_extract("path", r"([^/]+)\.csv$", 1)), ["path"]).orderBy("path", "position").collect()


def test_csv_candidates(spark, tmp_path):
    found = csv_candidates(
        spark, tmp_path, basic="product_name,quantity,unit,price\nCopper Pipe 1 inch,10,pcs,45.00\nBall Valve 2 inch,5,pcs,120.00\n", arabic="product_name,quantity,unit,price\nمكيف ترين مخفي,2,طن,13350\n",
        unit="product_name,qty,unit\nSteel Rod,5,pcs\n", infer="product_name,price,total\nCement Bag,25.00,125.00\n", twice="product_name,quantity,price\nPipe,10,50\nPIPE ,10,50\n", blank="product_name,quantity\n,\n  ,\nActual Product,3\n",
    )
    by = {}
    for r in found:
        by.setdefault(r.path, []).append(r)
    assert [(r.product_name, r.quantity, r.unit, r.price) for r in by["basic"]] == [("Copper Pipe 1 inch", 10.0, "pc", 45.0), ("Ball Valve 2 inch", 5.0, "pc", 120.0)]
    assert [(r.product_name, r.quantity, r.normalized_unit, r.category) for r in by["arabic"]] == [("مكيف ترين مخفي", 2.0, "ton", "HVAC")]
    assert [(r.unit, r.raw_unit, r.normalized_unit) for r in by["unit"]] == [("pc", "pcs", "pc")]
    assert by["infer"][0].quantity == 5.0 and by["infer"][0].confidence > 0.92
    assert [(r.product_name, r.position) for r in by["twice"]] == [("Pipe", 0)]
    assert [(r.product_name, r.quantity) for r in by["blank"]] == [("Actual Product", 3.0)]


def test_candidates_of_awkward_tables(spark):
    rows = [
        ("a", 0, 0, ["Name", "Name", "QTY"]), ("a", 0, 1, ["first", "second", "1,5"]), ("a", 0, 2, ["only"]), ("a", 0, 3, [None, None, "4"]), ("a", 0, 4, ["x", "y", "1", "beyond"]),  # of two columns of one name the last counts
        ("a", 1, 0, ["الصنف", "الكمية"]), ("a", 1, 1, ["صمام", "abc"]), ("b", 0, 0, ["nothing", "known"]), ("b", 0, 1, ["1", "2"]), ("c", 0, 0, ["description", "amount", "rate"]), ("c", 0, 1, ["3 bags cement", "10", "3"]),
    ]
    table = spark.createDataFrame(rows, "path string, table_no int, row_no int, cells array<string>")
    got = [(r.path, r.position, r.product_name, r.quantity, r.unit) for r in sheets.candidates(table, ["path"]).orderBy("path", "position").collect()]
    assert got == [("a", 0, "second", 1.5, None), ("a", 3, "y", 1.0, None), ("a", 4, "صمام", None, None), ("c", 0, "3 bags cement", 3.0, "bag")]
    assert sheets.candidates(table.where("false"), ["path"]).count() == 0


def test_xlsx_candidates(spark, tmp_path):
    """Sheets of a book follow one another in their positions."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def sheet(rows):
        cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in r) + "</row>" for r in rows)
        return f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>"

    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet([["Item", "Qty", "Rate"], ["Pipe", "2", "5"], ["Tee", "1", "7"]]))
        z.writestr("xl/worksheets/sheet2.xml", sheet([["البيان", "كمية"], ["محبس", "9"]]))
    rows = readers.xlsx_documents(readers.files(spark, str(tmp_path)))
    assert [(r.position, r.product_name, r.quantity) for r in sheets.candidates(rows, ["path"]).orderBy("position").collect()] == [(0, "Pipe", 2.0), (1, "Tee", 1.0), (2, "محبس", 9.0)]


def test_table_lines(spark):
    words = [("p", *w) for w in [("Logo", 10.0, 40.0, 2.0), ("Qty", 200.0, 220.0, 100.0), ("Product", 20.0, 60.0, 101.0), ("Total", 300.0, 330.0, 99.5), ("price", 332.0, 350.0, 100.0), ("pipe", 21.0, 40.0, 120.0), ("7", 190.0, 196.0, 121.0), ("big", 42.0, 60.0, 119.0), ("9.5", 310.0, 320.0, 120.0), ("7", 5.0, 9.0, 140.0)]]
    words += [("q", "just", 10.0, 20.0, 50.0), ("q", "words", 30.0, 40.0, 50.0), ("q", "Qty", 10.0, 20.0, 90.0), (None, None, 1.0, 2.0, 3.0), ("q", None, 1.0, 2.0, 3.0)]
    table = spark.createDataFrame(words, "page string, text string, x0 double, x1 double, top double")
    got = [(r.page, r.line) for r in layout.table_lines(table, ["page"]).where("page is not null").orderBy("page", "y").collect()]
    assert got == [("p", "Logo|-|-"), ("p", "Product|Qty|Total price"), ("p", "pipe big|7|9.5"), ("p", "7|-|-"), ("q", "just words"), ("q", "Qty")]


def test_words_of_dealt_pages_are_grouped_once(spark):
    """Pages that come by their key are neither dealt again nor read twice for their header (before: six shuffles, three reads, two joins)."""
    from millrace.plans import feeds

    plan = feeds.layout_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("FileScan") == 1 and "Join" not in plan
    words = [(None, "Qty price", 10.0, 20.0, 90.0), (None, "total", 50.0, 60.0, 90.0), (None, "pipe", 10.0, 20.0, 120.0), ("a", "price", 1.0, 2.0, 50.0), ("a", "Qty", 9.0, 12.0, 50.0), ("a", "Unit price item", 1.0, 2.0, 50.0 + 40), ("a", "total qty item", 7.0, 9.0, 98.0), ("b", "Qty price total", 5.0, 6.0, 1.0), ("b", "low", 1.0, 2.0, 99.0)]
    table = spark.createDataFrame(words, "page string, text string, x0 double, x1 double, top double")
    got = [(r.page, r.line) for r in layout.table_lines(table, ["page"]).orderBy("page", "y").collect()]
    assert got == [(None, "Qty price total"), (None, "pipe"), ("a", "price Qty"), ("a", "Unit price item"), ("a", "total qty item"), ("b", "Qty price total"), ("b", "low")]


HTML = """<!DOCTYPE html><HTML><body class="x"><!-- <p class='card'> --><div class="card a" id=one><p>Was<p>4 SAR<span data-x='>'>12.50</span><br/></div>
<div class="card"><div class="card inner"><b>deep</b> text</div></div><script>if (a < b) { "<div class='card'>" }</script><img src=y><p>7</p></body></html>"""


def test_elements(spark):
    rows = markup.tokens(spark.createDataFrame([("a", HTML), ("b", ""), ("c", None), ("d", "no tags < at > all"), (None, HTML)], "id string, html string"), "id").cache()
    assert "".join(r.token for r in rows.where("id = 'a'").orderBy("n").collect()) == HTML
    tree = markup.elements(rows, "id").cache()
    assert {r.tag for r in tree.collect()} == {"html", "body", "div", "p", "span", "br", "b", "script", "img"} and tree.where("id <> 'a'").count() == 0
    cards = tree.where(markup.selector("div", ("card",)))
    assert [r.text for r in markup.texts(cards, rows, "id").orderBy("n").collect()] == ["Was 4 SAR 12.50", "deep text", "deep text"]
    assert tree.where(markup.selector(attributes={"id": "one"})).count() == 1 and tree.where(markup.selector("img", attributes={"src": None})).count() == 1
    inner = markup.first_inside(cards, tree, rows, "id", {"bold": markup.selector("b"), "said": markup.selector("span")}).orderBy("n").collect()
    assert [(r.bold, r.said) for r in inner] == [(None, "12.50"), (None, None), ("deep", None)]
    bold = tree.where(markup.selector("b"))
    assert [r.value for r in markup.nearest_match(bold, tree, rows, "id").collect()] == ["12.50"]  # the first within the body
    assert [r.value for r in markup.nearest_match(bold, tree, rows, "id", levels=2).collect()] == [None]


def test_held_as_by_joins(spark):
    """Pages of tags in any order, left open, crossing, closed twice: what cards hold is what the joins of tokens find."""
    import random

    rnd = random.Random(5)
    parts = ['<div class="card">', "<div>", "</div>", '<p class=card>', "</p>", "<b>", "</b>", "</b>", "<a href=x>", "</a>", "<br>", "<div class=card/>", "<i class='s t'>", "</i>", " 5 ", "7.25", "word", "<!-- 3 -->", "<script>1</script>", "<", "<a name=y>", "</BR>"]
    soup = [(str(i), "".join(rnd.choice(parts) for _ in range(rnd.randrange(120)))) for i in range(60)] + [("h", HTML), ("e", ""), ("n", None), (None, HTML)]
    table = spark.createDataFrame(soup, "id string, html string")
    rows = markup.tokens(table, "id").cache()
    tree = markup.elements(rows, "id").cache()
    card, link = (lambda x=None: markup.selector(None, ("card",), of=x)), (lambda x=None: markup.selector("a", (), {"href": None}, of=x))
    fields = {"bold": lambda x=None: markup.selector("b", of=x), "said": lambda x=None: markup.selector(classes=("s",), of=x)}
    cards = tree.where(card())
    for levels in (4, 1):
        anchors = markup.inside(tree.where(link()), cards, "id")
        by_joins = markup.first_inside(cards, tree, rows, "id", {k: f() for k, f in fields.items()}).join(markup.nearest_match(anchors, tree, rows, "id", levels=levels).join(anchors, ["id", "n"]).select("id", F.col("outer_n").alias("n"), F.col("token").alias("anchor"), "value"), ["id", "n"])
        want = sorted(map(str, by_joins.select("id", "n", "bold", "said", "anchor", "value").collect()))
        got = markup.held(markup.nested(table, "id", card, link, levels=levels), "id", fields)
        assert sorted(map(str, got.select("id", "n", "bold", "said", "anchor", "value").collect())) == want and len(want) > 50


def test_listing_cards_deals_lines_once(spark):
    """Cards are read where their page is: lines are shuffled once, and no tokens are shuffled or written (before: 884 MB of disk at sf0.1)."""
    from millrace.plans import feeds

    plan = feeds.listing_cards(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan and "ExistingRDD" not in plan


def test_json_ld(spark):
    html = """<script type="application/ld+json">[1, "x", null, {"@type": ["Product"], "name": "a", "brand": ["z"], "offers": [{"lowPrice": "1,200.5"}], "hasVariant": [{"@type": "Product", "name": "v", "brand": [{"name": "w"}]}]}]</script>
<script type='application/ld+json'>{broken</script><script type="application/ld+json">{"@graph": {"@type": "Product", "name": 5, "offers": {"priceSpecification": {"price": 3}}}}</script><script>{"@type": "Product", "name": "no"}</script>"""
    table = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    got = structured.json_ld_products(table, ["id"]).orderBy("block", "n").collect()
    assert [(r.id, r.block, r.name, r.brand, r.price) for r in got] == [(1, 0, "a", "z", 1200.5), (1, 0, "v", "w", None), (1, 2, "5", None, 3.0)]


def test_script_lists(spark):
    html = r"""<script>var productsData = [{"name": "x ] \" [", "price": "12"}, {"name": ""}, 5]; x = {"products" : [[1], []], "products": []}; window.__products=[ "open </script>"""
    table = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    assert sorted((r.marker, r.at, r.json) for r in structured.script_lists(table, ["id"]).collect()) == [(1, 0, "[[1], []]"), (1, 1, "[]"), (3, 0, r'[{"name": "x ] \" [", "price": "12"}, {"name": ""}, 5]')]
    assert [(r.n, r.name, r.price) for r in structured.script_products(table, ["id"]).collect()] == [(0, 'x ] " [', 12.0)]


def test_price_of_a_later_script_is_not_json_ld(spark):
    page = '<script type="application/ld+json">{"name": "n"}</script><script>{"price": 3}</script>'
    assert spark.createDataFrame([(page,)], "html string").select(pages.page_price(F.col("html")).alias("p")).first().p.level == "script"


def test_orchestration(spark):
    """Detection, regions with their fallback, and products, for tables and blocks together."""
    from millrace.operators import orchestration

    tables = [
        ("a", 0, 0, True, ["Item", "Qty", "Price"]), ("a", 0, 1, False, ["4 pcs steel pipe", "", "25 100"]), ("a", 0, 2, False, ["", " ", ""]), ("a", 1, 0, True, ["x", "y"]), ("a", 1, 1, False, ["iban", "5 pcs valve"]),
        ("b", 0, 0, False, ["n", "1"]), ("b", 0, 1, False, ["m", "2"]), ("e", 0, 0, True, ["Terms", "z"]),
    ]
    blocks = [("a", 0, "Quotation qty price"), ("a", 1, ""), ("a", 2, "5 pcs brass valve 9 45\nwith handle inside"), ("a", 3, "7 pcs pump 9 9"), ("a", 4, "Note: 3 pcs pipe"), ("c", 0, "a letter without any"), ("d", 0, "qty unit price\n2 pcs steel rod 3 6"), ("e", 0, None), (None, 0, "qty price 5 pcs pipe")]
    t = spark.createDataFrame(tables, "doc string, table_no int, row_no int, is_header boolean, cells array<string>")
    b = spark.createDataFrame(blocks, "doc string, block_no int, text string")
    told = {r.doc: r.contains_products for r in orchestration.detected(t, b, ["doc"]).collect()}
    assert told == {"a": True, "b": True, "c": False, "d": True, "e": False, None: True}
    found = [(r.doc, r.region, r.table_no, r.first_block, r.last_block, r.region_type) for r in orchestration.regions(t, b, ["doc"], orchestration.detected(t, b, ["doc"])).where("doc is not null").orderBy("doc", "region").collect()]
    assert found == [("a", 0, 0, None, None, "product_table"), ("a", 1, 1, None, None, "bank_info"), ("a", 2, None, 0, 0, "document_header"), ("a", 3, None, 2, 3, "product_list"), ("a", 4, None, 4, 4, "notes"), ("b", 0, 0, None, None, "product_table"), ("d", 0, None, 0, 0, "product_list")]
    products = sorted((r.doc, r.product_name, r.quantity, r.price, r.description) for r in orchestration.extracted_products(t, b, ["doc"]).collect())
    assert products == [("a", "4 pcs steel pipe | 25 100", 4.0, 25.0, None), ("a", "5 pcs brass valve 9 45", 5.0, 9.0, "with handle inside"), ("a", "7 pcs pump 9 9", 7.0, 9.0, None), ("d", "2 pcs steel rod 3 6", 2.0, 3.0, None)]
    assert orchestration.extracted_products(t.where("false"), b.where("false"), ["doc"]).count() == 0
