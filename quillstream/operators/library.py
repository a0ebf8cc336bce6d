"""Scans over a bibliographic library kept as entity-attribute-value tables.

A `Library` holds the tables as DataFrames (from Parquet, JDBC or `sources.library`).  What the storage
layer of such a library does one item at a time is done here for all items at once: hydration joins
each value table once and collects ordered arrays and maps.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import media_types
from ..functions.text import blank

STORAGE = "storage:"
PDF_FILE, HTML_FILE = r"\.pdf$", r"\.html?$"


@dataclass
class Library:
    """Tables: items, itemTypes, itemAttachments, deletedItems, itemData, fields, itemDataValues, ..."""

    tables: dict[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def live(items: DataFrame, deleted: DataFrame, key: str = "itemID") -> DataFrame:
    """Rows without a tombstone."""
    return items.join(deleted.select(key), key, "left_anti")


def newest(rows: DataFrame, limit: int | None, *tie: str) -> DataFrame:
    """Newest rows first; 0 and None mean no limit.  The limit comes before any later filter."""
    ordered = rows.orderBy(F.col("dateModified").desc(), *(tie or ("itemID",)))
    return ordered.limit(limit) if limit else ordered


def attachments(library: Library) -> DataFrame:
    """Live attachments with their parents' keys."""
    items = library["items"].select("itemID", "key", "dateModified")
    parents = library["items"].select(F.col("itemID").alias("parentItemID"), F.col("key").alias("parentKey"))
    rows = items.join(library["itemAttachments"], "itemID").join(parents, "parentItemID", "left")
    return live(rows, library["deletedItems"])


def is_html_row() -> Column:
    """The wide prefilter that a scan pushes down: by media type, or `.htm` anywhere in the path."""
    return F.lower(blank(F.col("contentType"))).isin("text/html", "application/xhtml+xml") | F.contains(F.lower(blank(F.col("path"))), F.lit(".htm"))


def pdf_attachments(library: Library, limit: int | None = None) -> DataFrame:
    """Newest PDF attachments; the narrow test follows the limit."""
    wide = (F.lower(blank(F.col("contentType"))) == "application/pdf") | F.contains(F.lower(blank(F.col("path"))), F.lit(".pdf"))
    rows = newest(attachments(library).filter(wide), limit)
    return rows.filter(media_types.is_pdf(F.col("contentType"), F.col("path"), F.lit(None)))


def html_attachments(library: Library, limit: int | None = None, generated_only: bool = False) -> DataFrame:
    rows = newest(attachments(library).filter(is_html_row()), limit)
    rows = rows.filter(media_types.is_html(F.col("contentType"), F.col("path"), F.lit(None)))
    return rows.filter(media_types.is_generated_html(F.col("path"))) if generated_only else rows


def collection_items(library: Library, collection: str) -> DataFrame:
    """Item ids in a collection, by its name or key."""
    chosen = library["collections"].filter((F.col("collectionName") == collection) | (F.col("key") == collection))
    return library["collectionItems"].join(chosen.select("collectionID"), "collectionID", "left_semi").select("itemID").distinct()


def either_join(left: DataFrame, right: DataFrame, left_columns: Sequence[str], key: str) -> DataFrame:
    """Rows of `left` one of whose columns equals a key: hash joins with the distinct keys instead of a nested loop.

    Every row that fits comes once, equal rows as often as they are there.
    """
    keys, rows, hit = right.select(F.col(key).alias("_key")).filter("_key is not null").distinct(), left, F.lit(False)
    for i, c in enumerate(left_columns):
        rows = rows.join(keys.withColumnRenamed("_key", f"_key{i}"), F.col(c) == F.col(f"_key{i}"), "left")
        hit = hit | F.col(f"_key{i}").isNotNull()
    return rows.filter(hit).select(left.columns)


def filename(path: Column) -> Column:
    """The last part of a stored path."""
    return F.substring_index(F.translate(F.regexp_replace(blank(path), "^storage:", ""), "\\", "/"), "/", -1)


def collection_attachments(library: Library, collection: str, kind: Column | None = None, limit: int | None = None, filename_contains: str = "") -> DataFrame:
    """Live attachments that are in a collection themselves or by their parent, the newest first.

    A kind (such as `is_html_row()`) comes before the limit, a part of the file name behind it.
    """
    rows = either_join(attachments(library), collection_items(library, collection), ["itemID", "parentItemID"], "itemID")
    rows = newest(rows.filter(kind) if kind is not None else rows, limit)
    return rows.filter(F.contains(F.lower(filename(F.col("path"))), F.lit(filename_contains.lower()))) if filename_contains else rows


# --- files behind attachments ----------------------------------------------------------------------


def with_files(rows: DataFrame, files: DataFrame, suffix: str, require: bool = True) -> DataFrame:
    """Attachments with file_path: the stored path below their folder, else the newest file there with a suffix.

    `files` lists key (folder), name, path and mtime.  With `require`, attachments without a file are left
    out; otherwise they keep null.
    """
    here = files.filter(F.lower("name").rlike(suffix))
    newest_file = here.groupBy(F.col("key").alias("_key")).agg(F.max_by("path", F.struct("mtime", "path")).alias("_newest"))
    stored = here.select(F.col("key").alias("_k"), F.col("name").alias("_n"), F.col("path").alias("_stored"))
    out = rows.withColumn("_name", F.when(blank(F.col("path")).startswith(STORAGE), filename(F.col("path"))))
    out = out.join(stored, (F.col("key") == F.col("_k")) & (F.col("_name") == F.col("_n")), "left").join(newest_file, F.col("key") == F.col("_key"), "left")
    out = out.withColumn("file_path", F.coalesce("_stored", F.when(F.col("_name").isNull(), F.col("_newest")))).select(*rows.columns, "file_path")
    return out.filter("file_path is not null") if require else out


def stored_file(rows: DataFrame, files: DataFrame, known: DataFrame, suffix: str = PDF_FILE) -> DataFrame:
    """(key, path) of the newest file with a suffix in folders that no attachment names: a fallback behind the tables.

    `rows` holds the wanted keys; keys in `known` are deleted or inactive attachments and give nothing.
    """
    here = files.filter(F.lower("name").rlike(suffix)).join(rows.select("key").distinct(), "key", "left_semi").join(known.select("key"), "key", "left_anti")
    return here.groupBy("key").agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def newest_files(files: DataFrame, suffix: str = PDF_FILE, limit: int | None = None) -> DataFrame:
    """One file of each folder, the newest; of these the newest `limit`."""
    one = files.filter(F.lower("name").rlike(suffix)).groupBy("key").agg(F.max_by(F.struct("path", "name", "mtime"), F.struct("mtime", "path")).alias("f")).select("key", "f.*")
    ordered = one.orderBy(F.col("mtime").desc(), "key")
    return ordered.limit(limit) if limit else ordered


def for_files(paths: DataFrame, rows: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Attachments of given file paths: the first folder below the root is the key; unknown keys keep the path alone.

    Paths that are no PDF, are outside the root or directly in it give nothing.
    """
    clean, base = F.translate(F.col(path), "\\", "/"), root.rstrip("/")
    below = F.when(clean.startswith(f"{base}/"), F.substring(clean, len(base) + 2, 1 << 30))
    wanted = paths.select(F.col(path).alias("file_path"), below.alias("_below")).filter(F.lower("file_path").rlike(PDF_FILE) & F.contains("_below", F.lit("/")))
    return wanted.withColumn("key", F.substring_index("_below", "/", 1)).drop("_below").join(rows, "key", "left")


def find_by_filename(wanted: DataFrame, recorded: DataFrame, stored: DataFrame, known: DataFrame) -> DataFrame:
    """(name, key, origin) of the first attachment with a file name, but for case: recorded ones first, newest first.

    `wanted` holds name and exclude (a key or null); `recorded` name, key and dateModified; `stored` name,
    key and mtime of files in folders, of which those with a known key are left out.
    """
    fold = lambda df, rank, time: df.select(F.lower("name").alias("_name"), "key", F.lit(("library", "storage")[rank]).alias("origin"), F.struct(F.lit(rank).alias("r"), (-F.unix_timestamp(F.col(time).cast("timestamp"))).alias("t"), "key").alias("_order"))
    both = fold(recorded, 0, "dateModified").unionByName(fold(stored.join(known.select("key"), "key", "left_anti"), 1, "mtime"))
    found = wanted.withColumn("_name", F.lower("name")).join(both, "_name").filter(F.col("exclude").isNull() | (F.col("key") != F.col("exclude")))
    return found.groupBy("name").agg(F.min_by(F.struct("key", "origin"), "_order").alias("f")).select("name", "f.key", "f.origin")


# --- parents ---------------------------------------------------------------------------------------


def parent_keys(rows: DataFrame, library: Library) -> DataFrame:
    """Attachments with parent_key: their own, else that of their parent item."""
    parents = library["items"].select(F.col("itemID").alias("_id"), F.col("key").alias("_parent"))
    own = F.col("parentKey") if "parentKey" in rows.columns else F.lit(None).cast("string")
    return rows.join(parents, F.col("parentItemID") == F.col("_id"), "left").withColumn("parent_key", F.coalesce(F.nullif(own, F.lit("")), "_parent")).drop("_id", "_parent")


def parent_items(rows: DataFrame, library: Library, allow_standalone: bool = False) -> DataFrame:
    """(key, item_key) and the hydrated item of each attachment: its live parent, or itself if it stands alone and that is allowed."""
    wanted = parent_keys(rows, library).select("key", F.coalesce("parent_key", F.when(F.lit(allow_standalone), F.col("key"))).alias("item_key")).filter("item_key is not null")
    items = live(library["items"].join(library["itemTypes"], "itemTypeID", "left"), library["deletedItems"]).withColumnRenamed("key", "item_key")
    return wanted.join(hydrated(items, library), "item_key")


def first_collection_keys(rows: DataFrame, library: Library) -> DataFrame:
    """(key, collection_key) of the first collection by name, but for case, that holds an attachment or its parent."""
    members = library["collectionItems"].join(library["collections"].withColumnRenamed("key", "collection_key"), "collectionID")
    members = members.select("itemID", "collection_key", F.struct(F.lower("collectionName"), F.col("collectionID")).alias("_order"))
    ids = rows.select("key", F.explode(F.array_compact(F.array("parentItemID", "itemID"))).alias("itemID"))
    return ids.join(members, "itemID").groupBy("key").agg(F.min_by("collection_key", "_order").alias("collection_key"))


def source_pages(library: Library) -> DataFrame:
    """Attachments that hold a source page, with title and the parent's URL, DOI, archive fields and extra.

    Each field is one pivot of all values and one join, where the storage layer would look up every cell.
    """
    maps = field_maps(library)
    title = maps.select("itemID", F.coalesce(F.element_at("fields", "title"), F.lit("")).alias("title"))
    names = {"url": "parent_url", "DOI": "parent_doi", "archiveID": "parent_archive_id", "archiveLocation": "parent_archive_location", "extra": "parent_extra"}
    of_parent = maps.select(F.col("itemID").alias("parentItemID"), *[F.element_at("fields", f).alias(n) for f, n in names.items()])
    rows = attachments(library).join(title, "itemID", "left").join(of_parent, "parentItemID", "left")
    rows = rows.withColumns({"title": blank(F.col("title")), **{n: blank(F.col(n)) for n in names.values()}})
    html = F.lower(blank(F.col("contentType"))).isin("text/html", "application/xhtml+xml")
    return rows.filter(html & F.contains(F.upper(F.concat_ws(" ", F.col("title"), blank(F.col("path")))), F.lit("SOURCE HTML")))


def data_folders(files: DataFrame, roots: Sequence[str], max_depth: int, database: str, path: str = "path") -> DataFrame:
    """(folder, depth) of the data folders below the roots, up to a depth: those that hold the database, but none inside another one."""
    found = files.filter(F.col(path).endswith(f"/{database}")).select(F.regexp_replace(path, "/[^/]+$", "").alias("folder")).distinct()
    depths = []
    for base in (root.rstrip("/") for root in roots):
        inside = (F.col("folder") == base) | F.col("folder").startswith(base + "/")
        depths.append(F.when(inside, F.size(F.split(F.substring(F.col("folder"), len(base) + 1, 1 << 30), "/")) - 1))
    near = found.withColumn("depth", F.array_min(F.array_compact(F.array(*depths)))).filter(F.col("depth") <= max_depth)
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    nested = near.select("folder", F.explode(above).alias("_above")).join(near.select(F.col("folder").alias("_above")), "_above", "left_semi").select("folder").distinct()
    return near.join(nested, "folder", "left_anti")


def regular_items(library: Library, collection: str | None = None, keys: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Items that are neither attachments nor notes; an empty key list selects nothing."""
    types = library["itemTypes"].filter(~F.col("typeName").isin("attachment", "note", "annotation"))
    rows = live(library["items"].join(types, "itemTypeID"), library["deletedItems"])
    if collection is not None:
        rows = rows.join(collection_items(library, collection), "itemID", "left_semi")
    return newest(rows.filter(key_filter("key", keys)), limit)


def key_filter(column: str, keys: Sequence[str] | None) -> Column:
    """None filters nothing, an empty list everything."""
    if keys is None:
        return F.lit(True)
    return F.col(column).isin(*keys) if keys else F.lit(False)


def field_maps(library: Library) -> DataFrame:
    """(itemID, fields): all values of an item as a map; of repeated fields the smallest value holds."""
    rows = library["itemData"].join(library["fields"], "fieldID").join(library["itemDataValues"], "valueID")
    rows = rows.groupBy("itemID", "fieldName").agg(F.min("value").alias("value"))
    return rows.groupBy("itemID").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fieldName", "value")))).alias("fields"))


def ordered_array(rows: DataFrame, by: str, order: Sequence[Column], columns: Sequence[str], name: str) -> DataFrame:
    """(by, name): rows of each `by` as an array of structs in a given order."""
    kept = [f"_o{i}" for i in range(len(order))]
    packed = F.array_sort(F.collect_list(F.struct(*[c.alias(k) for c, k in zip(order, kept)], F.struct(*columns).alias("_v"))))
    return rows.groupBy(by).agg(F.transform(packed, lambda x: x["_v"]).alias(name))


def creators(library: Library) -> DataFrame:
    rows = library["itemCreators"].join(library["creators"], "creatorID").join(library["creatorTypes"], "creatorTypeID", "left")
    return ordered_array(rows, "itemID", [F.col("orderIndex")], ["firstName", "lastName", "fieldMode", "creatorType", "orderIndex"], "creators")


def tags(library: Library) -> DataFrame:
    rows = library["itemTags"].join(library["tags"], "tagID")
    return rows.groupBy("itemID").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), F.col("name")))), lambda x: x["name"]).alias("tags"))


def collections_of(library: Library) -> DataFrame:
    rows = library["collectionItems"].join(library["collections"], "collectionID")
    return ordered_array(rows, "itemID", [F.lower("collectionName"), F.col("collectionID")], ["collectionID", "key", "collectionName"], "collections")


def relations(library: Library) -> DataFrame:
    rows = library["relations"].withColumnRenamed("subject", "itemID")
    return ordered_array(rows, "itemID", [F.col("predicate"), F.col("object")], ["predicate", "object"], "relations")


def hydrated(items: DataFrame, library: Library) -> DataFrame:
    """Items with fields, creators, tags, collections and relations, each joined once for all items."""
    for part in (field_maps(library), creators(library), tags(library), collections_of(library), relations(library)):
        items = items.join(part, "itemID", "left")
    return items


def with_fallback(primary: DataFrame, secondary: DataFrame, key: str, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Rows of the first source, then those of the second whose keys the first lacks, under one limit."""
    rest = secondary.join(primary.select(key).distinct(), key, "left_anti").select(primary.columns)
    rows = primary.withColumn("source_rank", F.lit(0)).unionByName(rest.withColumn("source_rank", F.lit(1)))
    rows = rows.orderBy("source_rank", *(order or (key,)))
    return rows.limit(limit) if limit else rows


def first_per(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each group under an order."""
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def siblings_by_filename(rows: DataFrame, parent: str, key: str, name: str) -> DataFrame:
    """(key, sibling): rows under one parent whose file names are equal but for case."""
    other = rows.select(F.col(parent), F.lower(name).alias("_name"), F.col(key).alias("sibling"))
    return rows.withColumn("_name", F.lower(name)).join(other, [parent, "_name"]).filter(F.col(key) != F.col("sibling")).select(key, "sibling")


def storage_path(root: Column, key: Column, path: Column) -> Column:
    """A stored path below the library's storage folder; null for paths elsewhere."""
    return F.when(blank(path).startswith(STORAGE), F.concat_ws("/", root, F.lit("storage"), key, F.substring(path, len(STORAGE) + 1, 1 << 30)))


def library_id(label: Column, path: Column) -> Column:
    """A stable id: the label as a name, and a digest of the path."""
    return F.concat_ws("_", F.regexp_replace(label, "[^A-Za-z0-9]+", "_"), F.substring(F.sha1(F.lower(path)), 1, 8))


def source_url_hint(url: Column, doi: Column, *archive: Column) -> Column:
    """A preprint's HTML page where any field names a preprint, else the URL, else the DOI's URL."""
    from ..functions.identifiers import extract_arxiv_id, normalize_arxiv_id

    bare = lambda c: F.when(blank(c).rlike(r"(?i)^(arxiv:)?(\d{4}\.\d{4,5}|[a-z.-]+/\d{7})(v\d+)?$"), normalize_arxiv_id(c))
    found = F.coalesce(*[F.coalesce(bare(c), extract_arxiv_id(c)) for c in (*archive, doi, url)])
    clean, plain = F.trim(blank(url)), F.trim(blank(doi))
    return (
        F.when(found.isNotNull(), F.concat(F.lit("https://arxiv.org/html/"), found)).when(clean.rlike("^https?://"), clean)
        .when(plain.startswith("10."), F.concat(F.lit("https://doi.org/"), plain))
    )
