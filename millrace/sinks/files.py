"""Reports, exports and pushes as files or partition-wise calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.upserts import numbered


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def training_export(examples: DataFrame, path: str, kind: str, order: str = "created_at") -> None:
    """Correction examples in order, as json or csv files; other kinds are an error."""
    if kind not in ("json", "csv"):
        raise ValueError(f"unknown export format {kind}")
    rows = examples.orderBy(order)
    rows.write.mode("overwrite").json(path) if kind == "json" else rows.write.mode("overwrite").option("header", True).csv(path)


def split_export(df: DataFrame, path: str, rows: int = 5000) -> None:
    """Files of at most so many rows each."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).json(path)


def sync_payload(products: DataFrame, fields: list[str]) -> DataFrame:
    """Adds `payload`: the fields that have a value as JSON, prices as texts."""
    values = [F.col(f).cast("string").alias(f) if f == "price" else F.col(f) for f in fields]
    return products.withColumn("payload", F.to_json(F.struct(*values)))


def pushed(products: DataFrame, send: Callable[[Iterator[str]], Iterator[tuple[bool, str]]], key: str = "id", most: int = 10_000) -> DataFrame:
    """Sends each payload from its partition and gives the attempt log: key, ok, response (cut at `most` characters)."""
    kind = products.schema[key].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            results = list(send(iter(pdf["payload"])))
            yield pd.DataFrame({key: pdf[key], "ok": [r[0] for r in results], "response": [r[1][:most] for r in results]})

    return products.select(key, "payload").mapInPandas(run, f"{key} {kind}, ok boolean, response string")


def evaluation_report(summary: DataFrame, fields: DataFrame, details: DataFrame, order: str) -> DataFrame:
    """An evaluation as lines of CSV, in order: n, line. The metrics, a blank line, a line of column names, the details.

    summary is one row of metrics, fields has a row (field, accuracy) for each field, details any rows in the order of a column.
    Details are numbered by ranges of it, so that no task sees them all. Cells are quoted where they must be.
    """
    def cell(value):
        text = F.coalesce(value.cast("string"), F.lit(""))
        return F.when(text.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    def line(*cells):
        return F.concat_ws(",", *cells)

    metrics = summary.select(F.posexplode(F.array(*[line(F.lit(c), cell(F.col(c))) for c in summary.columns])).alias("n", "line"))
    by_field = fields.select(line(F.concat(F.lit("field_"), "field"), cell(F.col("accuracy"))).alias("line")).select(F.lit(len(summary.columns)).alias("n"), "line")
    heads = details.sparkSession.createDataFrame([(-1, "metric,value"), (1 << 20, ""), ((1 << 20) + 1, ",".join(details.columns))], "n int, line string")
    first = metrics.unionByName(by_field).unionByName(heads).select(F.struct(F.col("n").cast("long"), "line").alias("_at"), "line")
    body = details.select(F.col(order).alias("_order"), line(*[cell(F.col(c)) for c in details.columns]).alias("line")).repartitionByRange("_order", "line").sortWithinPartitions("_order", "line")
    top = first.orderBy("_at").select("line").coalesce(1)
    return numbered(top.unionByName(body.select("line")), "n").select("n", "line")


def write_report(report: DataFrame, path: str) -> None:
    """The lines of an evaluation as text files, in the order of their names."""
    report.orderBy("n").select("line").write.mode("overwrite").text(path)
