"""Tables, lines and snapshots on small rows whose results can be read off."""

from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators import documents, upserts


def test_tables(spark):
    rows = [(1, ["Item", "Unit Price"], None), (2, ["a", "b"], [["x", "1,000"], ["y", "2.5"], ["z", ""]]), (3, ["a"], [["x"], ["1"]]), (4, [], [["1"]]), (5, None, None), (6, ["a", "b"], [["x"], ["y"]])]
    df = spark.createDataFrame(rows, "id int, header array<string>, rows array<array<string>>")
    r = {x.id: (x.n, x.p) for x in df.select("id", documents.is_numeric_table(F.col("header"), F.col("rows")).alias("n"), documents.is_product_table(F.col("header")).alias("p")).collect()}
    assert r == {1: (True, True), 2: (True, False), 3: (False, False), 4: (False, False), 5: (False, False), 6: (False, False)}


def test_lines_to_products(spark):
    tables = spark.createDataFrame([(1, 0, 0, ["Description", "Qty"]), (1, 0, 1, ["", ""]), (1, 0, 2, ["10 pcs steel pipe", None, "5.00", "50.00"])], "doc int, table_no int, row_no int, cells array<string>")
    blocks = spark.createDataFrame([(1, 0, "galvanized finish inside\n\n  Grand total 50 pcs pipe"), (2, 0, None)], "doc int, block_no int, text string")
    lines = documents.flattened(tables, blocks, ["doc"])
    assert [(r.line_no, r.line) for r in lines.orderBy("line_no").collect()] == [(0, "Description | Qty"), (1, "10 pcs steel pipe | 5.00 | 50.00"), (2, "galvanized finish inside"), (3, "Grand total 50 pcs pipe")]
    found = documents.products_of(lines.unionByName(lines.withColumn("line_no", F.col("line_no") + 4)), ["doc"]).collect()
    assert [(r.position, r.quantity, r.unit, r.price, r.total, r.description, r.validation_flags) for r in found] == [(1, 10.0, "pc", 5.0, 50.0, "galvanized finish inside", [])]
    assert documents.products_of(lines.limit(0), ["doc"]).isEmpty()


def test_last_of_a_batch_and_ids(spark):
    cur = spark.createDataFrame([(5, 1, "a", "n")], "id long, scope int, code string, name string")
    plan = spark.createDataFrame([(5, "update", "x", 1), (5, "update", "b", 2), (None, "insert", "c", 3)], "matched_id long, action string, name string, n int").withColumns({"scope": F.lit(1), "code": F.lit("z")})
    assert sorted((r.id, r.name) for r in upserts.applied(cur, plan, "id", ["name"], ["scope", "code", "name"], order="n").collect()) == [(5, "b"), (6, "c")]
    inc = spark.createDataFrame([(1, "a", "other"), (1, "", "n"), (1, "q", "m"), (1, "q", "k"), (1, None, "v"), (1, "", None), (None, "w", "w"), (2, "a", "n")], "scope int, code string, name string")
    made = upserts.get_or_create(cur, inc, "scope", ["code", "name"], "id")
    assert sorted((r.id, r.scope, r.code, r.name) for r in made.where("id > 5").select("id", "scope", F.coalesce("code", F.lit("-")).alias("code"), "name").collect()) == [(6, 1, "q", "k"), (7, 1, "-", "v"), (8, 2, "a", "n")]


def test_jobs_and_marks(spark):
    day = [datetime(2024, 1, d) for d in range(1, 5)]
    changes = spark.createDataFrame([(1, "queued", day[0]), (1, "running", day[1]), (1, "failed", day[2]), (1, "running", day[3]), (2, "queued", day[0])], "job int, status string, at timestamp")
    assert {tuple(r) for r in upserts.job_states(changes, "job", "at").collect()} == {(1, "running", day[1], day[2], 2), (2, "queued", None, None, 0)}
    sent = spark.createDataFrame([(1, True, 1), (1, False, 2), (2, False, 1), (2, True, 2)], "id int, ok boolean, seq int")
    rows = spark.createDataFrame([(1, False, None), (2, False, None), (3, True, day[0])], "id int, is_synced boolean, synced_at timestamp")
    assert sorted((r.id, r.is_synced, r.synced_at) for r in upserts.marked_synced(rows, sent, "id", F.lit(day[3])).collect()) == [(1, False, None), (2, True, day[3]), (3, True, day[0])]
