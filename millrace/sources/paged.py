"""Paged listings as a source, and the rule that says where a crawl of them would have stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

PAGE_SCHEMA = "category string, page int, items array<struct<id:string,name:string,price:string>>"


class Page(InputPartition):
    def __init__(self, category: str, page: int, path: str):
        self.category, self.page, self.path = category, page, path


class PagedReader(DataSourceReader):
    """One partition a page file."""

    def __init__(self, options):
        self.root, self.category = options["path"], None

    def partitions(self):
        from pathlib import Path

        found = []
        for folder in sorted(Path(self.root).iterdir()):
            if folder.is_dir() and self.category in (None, folder.name):
                found += [Page(folder.name, int(f.stem.removeprefix("page-")), str(f)) for f in folder.glob("page-*.json")]
        return sorted(found, key=lambda p: (p.category, p.page)) or [Page("", 0, "")]

    def read(self, page):
        import json

        if page.path:
            with open(page.path, encoding="utf-8") as f:
                items = json.load(f)
            yield page.category, page.page, [tuple(None if i.get(k) is None else str(i[k]) for k in ("id", "name", "price")) for i in items]


class PushingReader(PagedReader):
    """A reader that takes an asked category, so that the pages of others aren't opened."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("category",):
                self.category = f.value
            else:
                yield f


class PagedListing(DataSource):
    """`spark.read.format("paged_listing").load(folder)`: a folder for each category, in it page-<n>.json, each a list of items (id, name, price).

    Partitions are pages, read where the tasks run, so that the folder must be one that all executors share. With the option
    pushdown=true (in sessions that allow it: spark.sql.python.filterPushdown.enabled) a category asked for is pushed down.
    """

    @classmethod
    def name(cls):
        return "paged_listing"

    def schema(self):
        return PAGE_SCHEMA

    def reader(self, schema):
        return (PushingReader if self.options.get("pushdown") == "true" else PagedReader)(self.options)


def until_stop(items: DataFrame, key: str, page: str, id_: str, full_page: int, most_pages: int = 50) -> DataFrame:
    """Items of the pages (from 1) that a crawl of each key would have kept: columns as given, each id once, on its first page.

    A crawl stops before the first page that has no new id or is missing, and behind the first one that holds fewer than
    `full_page` items, or `most_pages`. Whether an id is new is said by its first page; a page's counts and the windows over
    them are small, however many items there are. Of rows of one id on its page one stays.
    """
    first = items.groupBy(key, id_).agg(F.min(page).alias("_first"))
    pages = items.groupBy(key, page).agg(F.count("*").alias("_items"))
    new = first.groupBy(key, F.col("_first").alias(page)).agg(F.count("*").alias("_new"))
    order = Window.partitionBy(key).orderBy(page)
    gone = F.coalesce("_new", F.lit(0)) == 0
    known = pages.join(new, [key, page], "left").withColumn("_bad", gone | (F.row_number().over(order) != F.col(page)) | (F.col(page) > most_pages))
    ends = known.withColumn("_stop", F.max(F.col("_bad").cast("int")).over(order) + F.coalesce(F.max((F.col("_items") < full_page).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = ends.where("_stop = 0").select(key, page)
    rows = items.join(kept, [key, page], "left_semi").join(first, [key, id_]).where(F.col(page) == F.col("_first"))
    return rows.drop("_first").dropDuplicates([key, id_])
