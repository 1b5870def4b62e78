"""Files as DataFrames: routed by name and first bytes, CSV documents with sniffed dialects, JSON feeds, xlsx, sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers, text

#: File kinds by extension, and by the first bytes.
EXTENSIONS = {"pdf": "pdf", "xlsx": "excel", "xls": "excel", "csv": "csv", "txt": "csv", "json": "json", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image", "webp": "image"}
MAGIC = {"25504446": "pdf", "504B0304": "excel", "D0CF11E0": "excel"}
CELLS = "path string, table_no int, row_no int, is_header boolean, cells array<string>"


def files(spark: SparkSession, path: str) -> DataFrame:
    """Binary files with `kind`: by extension first, by first bytes second; null where neither tells."""
    df = spark.read.format("binaryFile").load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    by_name = F.coalesce(*[F.when(extension == e, k) for e, k in EXTENSIONS.items()])
    first = F.hex(F.substring("content", 1, 4))
    return df.withColumn("kind", F.coalesce(by_name, *[F.when(first == m, k) for m, k in MAGIC.items()]))


def is_header(cells: list[str]) -> bool:
    """Two cells or more that hold something, and fewer than half of them numbers."""
    full = [c for c in cells if c]
    return len(full) >= 2 and sum(c.replace(",", "").replace(".", "", 1).lstrip("-").isdigit() for c in full) < len(full) / 2


def csv_documents(df: DataFrame) -> DataFrame:
    """Rows of CSV files (path, content): encodings tried in turn, the delimiter sniffed on the first 4096 characters, cells
    in compatibility form; empty rows go, and the first row is the header if it looks like one."""
    def parse(batches):
        import csv
        import io
        import unicodedata

        import pandas as pd

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                for encoding in ("utf-8-sig", "latin-1"):  # the second reads anything
                    try:
                        body = content.decode(encoding)
                        break
                    except UnicodeDecodeError:
                        continue
                try:
                    dialect = csv.Sniffer().sniff(body[:4096], ",;\t|")
                except csv.Error:
                    dialect = csv.excel
                rows = [[unicodedata.normalize("NFKC", c).strip() for c in r] for r in csv.reader(io.StringIO(body), dialect)]
                rows = [r for r in rows if any(r)]
                out += [(path, 0, k, k == 0 and is_header(r), r) for k, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["path", "table_no", "row_no", "is_header", "cells"])

    return df.select("path", "content").mapInPandas(parse, CELLS)


def xlsx_documents(df: DataFrame) -> DataFrame:
    """Rows of xlsx files (path, content), a table for each sheet; the first row that looks like a header is the header."""
    def parse(batches):
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                book = zipfile.ZipFile(io.BytesIO(content))
                names = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
                shared = ["".join(t.text or "" for t in s.iter(f"{ns}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{ns}si")] if "xl/sharedStrings.xml" in book.namelist() else []
                for k, name in enumerate(names):
                    found, seen = 0, False
                    for row in ElementTree.fromstring(book.read(name)).iter(f"{ns}row"):
                        cells: dict[int, str] = {}
                        for at, c in enumerate(row.iter(f"{ns}c")):
                            letters = re.match("[A-Z]*", c.get("r", ""))[0]
                            column = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else at
                            v = c.find(f"{ns}v")
                            inline = "".join(t.text or "" for t in c.iter(f"{ns}t"))
                            cells[column] = shared[int(v.text)] if c.get("t") == "s" and v is not None else inline or (v.text if v is not None else "")
                        line = [(cells.get(i) or "").strip() for i in range(max(cells, default=-1) + 1)]
                        if any(line):
                            head = not seen and is_header(line)
                            seen |= head
                            out.append((path, k, found, head, line))
                            found += 1
            yield pd.DataFrame(out, columns=["path", "table_no", "row_no", "is_header", "cells"])

    return df.select("path", "content").mapInPandas(parse, CELLS)


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Products of JSON feeds as texts (path, item): a list, or an object with a list under products, items, data or results."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("body"))
    lists = [F.get_json_object("body", f"$.{k}") for k in ("products", "items", "data", "results")]
    body = F.coalesce(F.when(F.col("body").startswith("["), F.col("body")), *[F.when(x.startswith("["), x) for x in lists], F.lit("[]"))
    items = F.from_json(body, T.ArrayType(T.VariantType()))
    return whole.select("path", F.explode(items).alias("v")).select("path", F.to_json("v").alias("item"))


def feed_products(items: DataFrame, base_url: str = "") -> DataFrame:
    """Feed items (item) as products: external_id, name, url, sku, price, brand, category; rows without a name go."""
    item = F.col("item")
    url = text.first_filled(*[F.get_json_object(item, f"$.{k}") for k in ("url", "link", "share_link")])
    found = items.select(
        text.first_filled(F.get_json_object(item, "$.external_id"), F.get_json_object(item, "$.id")).alias("external_id"), text.json_name(item).alias("name"), text.absolute_url(url, base_url).alias("url"),
        F.get_json_object(item, "$.sku").alias("sku"), numbers.json_price(item).alias("price"), text.json_label(item, ["brand"]).alias("brand"),
        text.json_label(item, ["category", "category_name", "main_category", "type"]).alias("category"), item.alias("raw_data"))
    return found.where(F.col("name").isNotNull())


def labelled_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Ground truth from json or csv; numbers may hold commas, blanks are null."""
    df = spark.read.option("multiLine", True).json(path) if kind == "json" else spark.read.option("header", True).csv(path)
    return df.select(*[numbers.number_plain(text.filled(F.col(c).cast("string"))).alias(c) if c in ("quantity", "price") else F.col(c) for c in df.columns])


def coalesced(df: DataFrame, names: list[str]) -> Column:
    """The first filled of the named columns that the table has, in any language."""
    have = {c.strip().lower(): c for c in df.columns}
    return F.coalesce(*[text.filled(F.col(f"`{have[n]}`").cast("string")) for n in names if n in have], F.lit(None).cast("string"))
