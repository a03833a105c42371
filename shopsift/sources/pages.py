"""A Python data source of recorded store pages: JSON files of one page each.

``spark.dataSource.register(RecordedPages)``, then
``spark.read.format("recorded_pages").load(folder)``. A page file is
``<site>-<page>.json``; a site is one partition, since a store's pages follow
one another: reading ends at the first page that is missing, empty or not JSON,
and what was read before is kept. The folder is one that driver and executors
mount alike; :func:`recorded_pages` reads the same files from any path that
Spark reads.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import listing

PRODUCT = "title string, handle string, product_type string, tags string, body_html string, images array<struct<src:string>>, variants array<struct<price:string, sku:string>>"


class Site(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class PageReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        names = {f.rpartition("-")[0] for f in os.listdir(self.folder) if f.endswith(".json")}
        return [Site(n) for n in sorted(names)]

    def read(self, partition: Site) -> Iterator[tuple]:
        page = 1
        while True:
            path = os.path.join(self.folder, f"{partition.name}-{page}.json")
            try:
                with open(path, encoding="utf-8") as f:
                    products = json.load(f)["products"]
            except (FileNotFoundError, ValueError, KeyError):
                return
            if not products:
                return
            for seq, product in enumerate(products):
                yield partition.name, page, seq, json.dumps(product)
            page += 1


class RecordedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return "site string, page int, seq int, product string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options["path"])


def recorded_pages(spark: SparkSession, folder: str) -> DataFrame:
    """site, page, seq, product of the recorded pages, by the same stop rule, as a DataFrame of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    name = lambda i: F.regexp_extract("path", r"([^/]+)-([0-9]+)\.json$", i)
    pages = files.select(name(1).alias("site"), name(2).cast("int").alias("page"), F.from_json(F.decode("content", "utf-8"), "products array<string>")["products"].alias("products"))
    # A page counts if it and all before it have products: it is then as many pages on as its number says.
    place = F.row_number().over(Window.partitionBy("site").orderBy("page"))
    read = pages.filter(F.size(F.coalesce("products", F.array().cast("array<string>"))) > 0).withColumn("__place", place).filter("page = __place")
    return read.select("site", "page", F.posexplode("products").alias("seq", "product"))


def listings(raw: DataFrame, endpoint: str | Column, stored: DataFrame | None = None) -> DataFrame:
    """Jewelry products with an image, in the normalised columns, of raw rows (site, page, seq, product).

    Products that their own site has among ``stored`` (site, url) are left out
    before the classifier is asked; the same URL stored by another site is not.
    """
    endpoint = F.lit(endpoint) if isinstance(endpoint, str) else endpoint
    p = F.from_json("product", PRODUCT)
    rows = raw.select("site", "page", "seq", p.alias("p"))
    rows = rows.withColumn("url", listing.product_url(endpoint, F.col("p.handle"))).filter("url <> ''")
    if stored is not None:
        rows = rows.join(stored.select("site", "url").distinct(), ["site", "url"], "left_anti")
    rows = rows.filter(listing.is_jewelry(F.col("p.product_type"), F.col("p.tags"), F.col("p.title")))
    image = listing.or_else(F.get("p.images", 0)["src"], "")
    variant = F.get("p.variants", 0)
    return rows.filter(image != "").select(
        "site", "page", "seq", listing.or_else(F.col("p.title"), "").alias("product_name"), image.alias("product_image_url"), F.col("url").alias("source_product_url"),
        listing.or_else(variant["price"], "").alias("price"), listing.or_else(variant["sku"], "").alias("sku"), listing.strip_html(F.col("p.body_html")).alias("description"), listing.or_else(F.col("p.product_type"), "").alias("category"),
    )
