"""A library's tables after attachments and parents were made elsewhere: rows to append, each once.

Every function gives new versions of the tables that change.  What is there already, by key, is left as it is,
so a result that is applied twice changes nothing the second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .library import STORAGE, Library
from .sinks import last_number, numbered, upsert_values, value_ids


def type_id(library: Library, name: str):
    """The number of an item type as a scalar subquery."""
    return library["itemTypes"].filter(F.col("typeName") == name).agg(F.max("itemTypeID")).scalar()


def with_items(library: Library, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with those of new keys, and the new ones alone; `rows` holds key, itemTypeID and dateModified."""
    new = rows.dropDuplicates(["key"]).join(library["items"].select("key"), "key", "left_anti")
    made = numbered(new, "key", last_number(library["items"], "itemID"), "itemID").withColumn("version", F.lit(0).cast("long"))
    return library["items"].unionByName(made.select(library["items"].columns)), made


def with_titles(library: Library, titles: DataFrame) -> dict[str, DataFrame]:
    """Value tables with titles set; `titles` holds itemID and title."""
    values = value_ids(titles.select(F.col("title").alias("value")), library["itemDataValues"])
    field = library["fields"].filter("fieldName = 'title'").agg(F.max("fieldID")).scalar()
    cells = titles.join(values, F.col("title") == F.col("value")).select("itemID", field.alias("fieldID"), "valueID")
    return {"itemDataValues": values, "itemData": upsert_values(library["itemData"], cells, ["itemID", "fieldID"])}


def attach(library: Library, rows: DataFrame) -> Library:
    """The library with new attachments: parent_key, key, filename, title, contentType and dateModified.

    Attachments of parents that are not there stand alone.
    """
    items, made = with_items(library, rows.withColumn("itemTypeID", type_id(library, "attachment")))
    parents = library["items"].select(F.col("key").alias("parent_key"), F.col("itemID").alias("parentItemID"))
    links = made.join(parents, "parent_key", "left").select("itemID", "parentItemID", F.lit(0).alias("linkMode"), "contentType", F.concat(F.lit(STORAGE), "filename").alias("path"))
    tables = {"items": items, "itemAttachments": library["itemAttachments"].unionByName(links)}
    return Library({**library.tables, **tables, **with_titles(library, made.select("itemID", "title"))})


def ensure_parents(library: Library, rows: DataFrame) -> Library:
    """The library with parents for attachments that stand alone: key (of the attachment), parent_key, item_type, title, dateModified.

    A parent is made if its key is new, and the attachment points to it; one that has a parent keeps it.
    """
    typed = rows.join(library["itemTypes"].withColumnRenamed("typeName", "item_type"), "item_type")
    items, made = with_items(library, typed.select(F.col("parent_key").alias("key"), "itemTypeID", "title", "dateModified"))
    children = rows.join(items.select("key", "itemID"), "key").join(items.select(F.col("key").alias("parent_key"), F.col("itemID").alias("_parent")), "parent_key").groupBy("itemID").agg(F.min("_parent").alias("_parent"))
    attachments = library["itemAttachments"].join(children, "itemID", "left").withColumn("parentItemID", F.coalesce("parentItemID", "_parent")).select(library["itemAttachments"].columns)
    return Library({**library.tables, "items": items, "itemAttachments": attachments, **with_titles(library, made.select("itemID", "title"))})
