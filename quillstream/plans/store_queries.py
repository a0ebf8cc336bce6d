"""Library scans, files behind attachments and writes, over a library whose tables come from the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import library as lib
from ..operators import sinks, sync
from ..sources.tables import load
from .registry import query
from .state_queries import pick

TYPES = ((1, "journalArticle"), (2, "note"), (3, "book"), (4, "preprint"), (9, "attachment"))
FIELDS = ((1, "title"), (2, "url"), (3, "DOI"), (4, "extra"), (5, "archiveID"), (6, "archiveLocation"))
MEDIA = ("application/pdf", "text/html", "", "text/plain; x=1")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def attachment_number(k: Column, ln: Column, p: Column) -> Column:
    """The id of a line item as an attachment: no two share one, and order and remainders by 3 and 5 are those of the SQL's id.

    That id gives a line one digit and a part six, so from a million parts on two lines of an order can have the
    same; the millions of the part, in the last places here, tell them apart.  Keys for which the places do not
    suffice are an error.
    """
    serial = F.lit(10**12) + k * 10**7 + ln * 10**6 + p
    outside = ~k.between(0, 6 * 10**8) | ~ln.between(0, 9) | ~p.between(0, 10**8 - 1)
    return F.when(outside, F.raise_error("an order, line or part key is outside the places of an attachment's id").cast("long")).otherwise(serial * 1501 + F.floor(p / 10**6) * 15)


def star_library(spark: SparkSession, sf_dir: str) -> lib.Library:
    """Orders are items, line items their attachments, customers creators, nations tags, regions collections."""
    o, line, c, n, r = (load(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "nation", "region"))
    k, p, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    a = line.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_shipdate").alias("d"))
    number = attachment_number(k, ln, p)
    own = o.select(F.col("o_orderkey").alias("itemID"), (F.col("o_orderkey") % 4 + 1).cast("long").alias("itemTypeID"), F.col("o_orderdate").cast("string").alias("dateModified"), _text("K", F.col("o_orderkey")).alias("key"), F.lit(1).cast("long").alias("version"))
    theirs = a.select(number.alias("itemID"), F.lit(9).cast("long").alias("itemTypeID"), F.col("d").cast("string").alias("dateModified"), _text("A", k, "-", ln, "-", p).alias("key"), F.lit(0).cast("long").alias("version"))
    path = F.when(p % 5 == 0, _text("storage:F", p, ".PDF")).when(p % 5 == 1, "storage:x [Source HTML].html").when(p % 5 == 2, "storage:dir\\y.htm").when(p % 5 == 3, _text("/abs/", p, ".pdf"))
    names = {1: _text("Title ", F.col("o_orderkey"), " &amp; more"), 2: _text("https://x.org/", F.col("o_orderkey")), 3: _text("10.1234/", F.col("o_orderkey")), 4: _text("extra ", F.col("o_orderkey"))}
    values = o.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("fieldID"), F.when((F.col("o_orderkey") % i == 0) | F.lit(i < 3), v).alias("value")) for i, v in names.items()])).alias("v")).filter("v.value is not null")
    values = values.select(F.col("o_orderkey").alias("itemID"), "v.fieldID", (F.col("o_orderkey") * 10 + F.col("v.fieldID")).alias("valueID"), "v.value")
    return lib.Library({
        "items": own.unionByName(theirs), "itemTypes": spark.createDataFrame(list(TYPES), "itemTypeID long, typeName string"), "fields": spark.createDataFrame(list(FIELDS), "fieldID long, fieldName string"),
        "itemAttachments": a.select(number.alias("itemID"), F.when(p % 11 != 0, k).alias("parentItemID"), F.lit(0).alias("linkMode"), pick(MEDIA, p % 4).alias("contentType"), path.alias("path")),
        "deletedItems": o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("itemID")).unionByName(a.filter(p % 13 == 0).select(number.alias("itemID"))),
        "itemData": values.select("itemID", "fieldID", "valueID"), "itemDataValues": values.select("valueID", "value"),
        "creators": c.select(F.col("c_custkey").alias("creatorID"), F.col("c_mktsegment").alias("firstName"), F.col("c_name").alias("lastName"), F.lit(0).alias("fieldMode")), "creatorTypes": spark.createDataFrame([(1, "author")], "creatorTypeID long, creatorType string"),
        "itemCreators": o.select(F.col("o_orderkey").alias("itemID"), F.col("o_custkey").alias("creatorID"), F.lit(1).cast("long").alias("creatorTypeID"), F.lit(0).alias("orderIndex")),
        "tags": n.select(F.col("n_nationkey").cast("long").alias("tagID"), F.col("n_name").alias("name")),
        "itemTags": o.select(F.col("o_orderkey").alias("itemID"), F.explode(F.array(F.col("o_orderkey") % 25, F.col("o_custkey") % 7)).alias("tagID")).distinct(),
        "collections": r.select(F.col("r_regionkey").cast("long").alias("collectionID"), _text("C", F.col("r_regionkey")).alias("key"), F.col("r_name").alias("collectionName")),
        "collectionItems": o.select(F.explode(F.array(F.col("o_orderkey") % 5, F.col("o_custkey") % 5)).alias("collectionID"), F.col("o_orderkey").alias("itemID")).distinct(),
        "relations": o.select(F.col("o_orderkey").alias("subject"), F.lit("dc:relation").alias("predicate"), _text("http://x/", F.col("o_custkey")).alias("object")),
    })


LIBRARY = """
WITH a AS (SELECT l_orderkey AS o, l_linenumber AS ln, l_partkey AS p, max(l_shipdate) AS d FROM lineitem GROUP BY 1, 2, 3),
att AS (SELECT 'A' || o || '-' || ln || '-' || p AS key, o, p, d, CASE WHEN p % 11 <> 0 THEN o END AS parent, ['application/pdf', 'text/html', '', 'text/plain; x=1'][p % 4 + 1] AS mime,
  CASE p % 5 WHEN 0 THEN 'storage:F' || p || '.PDF' WHEN 1 THEN 'storage:x [Source HTML].html' WHEN 2 THEN 'storage:dir\\y.htm' WHEN 3 THEN '/abs/' || p || '.pdf' END AS path, 1000000000000 + o * 10000000 + ln * 1000000 + p AS id FROM a WHERE p % 13 <> 0),
item AS (SELECT *, o_orderkey AS k, 'K' || o_orderkey AS key, ['journalArticle', 'note', 'book', 'preprint'][o_orderkey % 4 + 1] AS type FROM orders WHERE o_orderstatus <> 'P'),
member AS (SELECT DISTINCT o_orderkey AS k, c FROM (SELECT o_orderkey, unnest([o_orderkey % 5, o_custkey % 5]) AS c FROM orders))
"""
IS_PDF = "(mime = 'application/pdf' OR mime <> 'text/html' AND lower(coalesce(path, '')) LIKE '%.pdf')"


@query("library_pdf_attachments", LIBRARY + f"SELECT key, 'K' || parent AS parent_key FROM att WHERE {IS_PDF}")
def library_pdf_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live PDF attachments with their parents' keys; the media type goes before the name."""
    return lib.pdf_attachments(star_library(spark, sf_dir)).select("key", F.col("parentKey").alias("parent_key"))


@query("library_html_attachments", LIBRARY + "SELECT key FROM att WHERE mime = 'text/html' OR mime <> 'application/pdf' AND lower(coalesce(path, '')) SIMILAR TO '.*[.]html?'")
def library_html_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live HTML attachments."""
    return lib.html_attachments(star_library(spark, sf_dir)).select("key")


@query("library_newest_pdfs", LIBRARY + f"SELECT key FROM (SELECT * FROM att WHERE mime = 'application/pdf' OR lower(coalesce(path, '')) LIKE '%.pdf%' ORDER BY CAST(d AS VARCHAR) DESC, id LIMIT 100) WHERE {IS_PDF}")
def library_newest_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred by the wide test, of which the narrow test keeps some: a limit that is the scan's own."""
    return lib.pdf_attachments(star_library(spark, sf_dir), 100).select("key")


@query("library_regular_items", LIBRARY + "SELECT key, type FROM item WHERE type <> 'note' AND k IN (SELECT m.k FROM member m JOIN region ON c = r_regionkey WHERE r_name = 'ASIA')")
def library_regular_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a collection that are neither notes nor attachments."""
    return lib.regular_items(star_library(spark, sf_dir), "ASIA").select("key", F.col("typeName").alias("type"))


@query(
    "library_hydrated_items",
    LIBRARY
    + """, t AS (SELECT k, string_agg(n_name, '|' ORDER BY lower(n_name), n_name) AS tags FROM (SELECT DISTINCT o_orderkey AS k, unnest([o_orderkey % 25, o_custkey % 7]) AS n FROM orders) JOIN nation ON n = n_nationkey GROUP BY 1),
         m AS (SELECT k, string_agg(r_name, '|' ORDER BY lower(r_name), r_regionkey) AS collections FROM member JOIN region ON c = r_regionkey GROUP BY 1)
       SELECT i.key, 'Title ' || i.k || ' &amp; more' AS title, CASE WHEN i.k % 3 = 0 THEN '10.1234/' || i.k END AS doi, c.c_name AS author, t.tags, m.collections, 'http://x/' || i.o_custkey AS relation FROM item i JOIN customer c ON c.c_custkey = i.o_custkey JOIN t USING (k) JOIN m USING (k)""",
)
def library_hydrated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with fields, creators, tags, collections and relations."""
    library = star_library(spark, sf_dir)
    rows = lib.hydrated(lib.live(library["items"].filter("itemTypeID <> 9"), library["deletedItems"]), library)
    return rows.select(
        "key", F.element_at("fields", "title").alias("title"), F.element_at("fields", "DOI").alias("doi"), F.get("creators", F.lit(0))["lastName"].alias("author"), F.array_join("tags", "|").alias("tags"),
        F.array_join(F.transform("collections", lambda c: c["collectionName"]), "|").alias("collections"), F.get("relations", F.lit(0))["object"].alias("relation"),
    )


@query("library_parent_items", LIBRARY + "SELECT a.key, coalesce(i.key, a.key) AS item_key, CASE WHEN i.k IS NOT NULL THEN 'Title ' || i.k || ' &amp; more' END AS title FROM att a LEFT JOIN item i ON a.parent = i.k WHERE a.parent IS NULL OR i.k IS NOT NULL")
def library_parent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live item of each attachment, its own where it stands alone; one whose parent no table holds gives nothing."""
    library = star_library(spark, sf_dir)
    rows = lib.attachments(library).filter("parentItemID is null or parentKey is not null")
    return lib.parent_items(rows, library, allow_standalone=True).select("key", "item_key", F.element_at("fields", "title").alias("title"))


@query("library_first_collections", LIBRARY + "SELECT key, collection_key FROM (SELECT a.key, 'C' || r_regionkey AS collection_key, row_number() OVER (PARTITION BY a.key ORDER BY lower(r_name), r_regionkey) AS n FROM att a JOIN member m ON a.parent = m.k JOIN region ON c = r_regionkey) WHERE n = 1")
def library_first_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first collection by name of each attachment or its parent."""
    library = star_library(spark, sf_dir)
    return lib.first_collection_keys(lib.attachments(library), library).select("key", "collection_key")


@query("library_source_pages", LIBRARY + "SELECT a.key, coalesce('https://x.org/' || parent, '') AS url, CASE WHEN parent % 3 = 0 THEN '10.1234/' || parent ELSE '' END AS doi, CASE WHEN parent % 4 = 0 THEN 'extra ' || parent ELSE '' END AS extra FROM att a WHERE mime = 'text/html' AND p % 5 = 1")
def library_source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source pages with their parents' fields, pivoted once."""
    return lib.source_pages(star_library(spark, sf_dir)).select("key", F.col("parent_url").alias("url"), F.col("parent_doi").alias("doi"), F.col("parent_extra").alias("extra"))


@query("library_collection_attachments", LIBRARY + "SELECT key FROM att WHERE parent IN (SELECT m.k FROM member m JOIN region ON c = r_regionkey WHERE r_name = 'EUROPE') AND p % 5 = 0 AND CAST(p AS VARCHAR) LIKE '1%'")
def library_collection_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of a collection whose file name holds a text, but for case."""
    return lib.collection_attachments(star_library(spark, sf_dir), "EUROPE", filename_contains="f1").select("key")


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the folders of some attachments: the one that the path names, and two others."""
    library = star_library(spark, sf_dir)
    rows = library["items"].join(library["itemAttachments"], "itemID").filter("itemID % 3 <> 0")
    names = F.array(F.struct(lib.filename(F.col("path")).alias("name"), F.lit(1).alias("m")), F.struct(F.lit("old.pdf").alias("name"), F.lit(2).alias("m")), F.struct(F.lit("new.Pdf").alias("name"), (F.col("itemID") % 5).cast("int").alias("m")))
    files = rows.select("key", F.explode(names).alias("f")).select("key", "f.name", F.timestamp_seconds("f.m").alias("mtime")).filter("name <> ''")
    return files.withColumn("path", _text("/data/storage/", F.col("key"), "/", F.col("name")))


@query(
    "attachment_files",
    LIBRARY
    + """, s AS (SELECT *, id % 3 <> 0 AS there, regexp_replace(replace(substr(path, 9), '\\', '/'), '^.*/', '') AS name FROM att)
       SELECT key, '/data/storage/' || key || '/' || CASE WHEN p % 5 = 0 THEN name ELSE CASE WHEN id % 5 > 2 THEN 'new.Pdf' WHEN id % 5 = 2 AND 'old.pdf' < 'new.Pdf' THEN 'new.Pdf' ELSE 'old.pdf' END END AS file_path FROM s WHERE there AND (p % 5 = 0 OR path IS NULL OR path NOT LIKE 'storage:%')""",
)
def attachment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PDF behind each attachment: the stored name, else the newest in its folder; without a file it is left out."""
    return lib.with_files(lib.attachments(star_library(spark, sf_dir)), stored_files(spark, sf_dir), lib.PDF_FILE).select("key", "file_path")


@query("newest_stored_files", LIBRARY + """, b AS (SELECT 'A' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS key, 1000000000000 + l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS id, l_partkey AS p FROM lineitem GROUP BY ALL),
    f AS (SELECT key, id, unnest(['old.pdf', 'new.Pdf', CASE p % 5 WHEN 0 THEN 'F' || p || '.PDF' WHEN 3 THEN p || '.pdf' END]) AS name, unnest([2, id % 5, 1]) AS m FROM b WHERE id % 3 <> 0)
    SELECT key, name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY m DESC, name DESC) AS n FROM f WHERE name IS NOT NULL) WHERE n = 1""")
def newest_stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest PDF of each folder."""
    return lib.newest_files(stored_files(spark, sf_dir)).select("key", "name")


@query("stored_file_fallback", "SELECT 'A' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS key FROM lineitem WHERE (l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey + 1) % 3 <> 0 AND l_returnflag = 'R' GROUP BY 1 HAVING max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = 0")
def stored_file_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted keys whose folder has a PDF and that no table knows."""
    line = load(spark, sf_dir, "lineitem")
    key = _text("A", F.col("l_orderkey"), "-", F.col("l_linenumber"), "-", F.col("l_partkey")).alias("key")
    returned = line.filter("l_returnflag = 'R'")
    return lib.stored_file(returned.select(key), stored_files(spark, sf_dir), returned.filter("l_linestatus = 'O'").select(key).distinct()).select("key")


@query("attachments_for_files", LIBRARY + "SELECT '/data/storage/' || x.key || '/z.PDF' AS file_path, x.key, a.o AS parent FROM (SELECT DISTINCT 'A' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS key FROM lineitem) x LEFT JOIN att a USING (key)")
def attachments_for_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of file paths, read without the orders; deleted ones keep the path alone, paths elsewhere give nothing."""
    library = star_library(spark, sf_dir)
    keys = library["items"].filter("itemTypeID = 9").select("key")
    paths = keys.select(_text("/data/storage/", F.col("key"), "/z.PDF").alias("path")).unionByName(keys.select(_text("/elsewhere/", F.col("key"), "/z.pdf").alias("path"))).unionByName(keys.select(_text("/data/storage/", F.col("key"), ".pdf").alias("path")))
    alone = lib.Library({**library.tables, "items": library["items"].filter("itemTypeID = 9")})
    rows = lib.attachments(alone).select("key", F.regexp_extract("key", "^A([0-9]+)-", 1).cast("long").alias("parent"))
    return lib.for_files(paths, rows, "/data/storage/").select("file_path", "key", "parent")


@query(
    "files_by_name",
    LIBRARY
    + """, l AS (SELECT 'f' || p || '.pdf' AS name, key, d, row_number() OVER (PARTITION BY p ORDER BY epoch(date_trunc('second', d)) DESC, key) AS n FROM att WHERE p % 5 = 0)
       SELECT 'f' || p_partkey || '.Pdf' AS name, CASE WHEN l.key IS NOT NULL THEN l.key ELSE 'S' || p_partkey END AS key, CASE WHEN l.key IS NOT NULL THEN 'library' ELSE 'storage' END AS origin FROM part LEFT JOIN l ON l.name = 'f' || p_partkey || '.pdf' AND l.n = 1
       WHERE l.key IS NOT NULL OR p_partkey % 2 = 0""",
)
def files_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first attachment with each file name: the library's newest, else one in the storage."""
    rows = lib.attachments(star_library(spark, sf_dir)).select(lib.filename(F.col("path")).alias("name"), "key", "dateModified").filter("name like 'F%'")
    k = F.col("p_partkey")
    part = load(spark, sf_dir, "part")
    stored = part.filter(k % 2 == 0).select(_text("F", k, ".pdf").alias("name"), _text("S", k).alias("key"), F.lit("2020-01-01").alias("mtime")).unionByName(part.select(_text("F", k, ".pdf").alias("name"), F.lit("known").alias("key"), F.lit("2021-01-01").alias("mtime")))
    wanted = part.select(_text("f", k, ".Pdf").alias("name"), F.lit(None).cast("string").alias("exclude"))
    return lib.find_by_filename(wanted, rows, stored, spark.createDataFrame([("known",)], "key string"))


@query("data_folders", "SELECT DISTINCT '/r' || c_nationkey % 3 || '/a' || c_nationkey AS folder, 1 AS depth FROM customer WHERE c_nationkey % 3 < 2 UNION ALL SELECT DISTINCT '/r' || c_nationkey % 3 || '/b/' || c_custkey, 2 FROM customer WHERE c_nationkey % 3 < 2")
def data_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data folders below two roots: none deeper than two, none inside another."""
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    paths = F.array(_text("/r", n % 3, "/a", n, "/lib.sqlite"), _text("/r", n % 3, "/a", n, "/in/lib.sqlite"), _text("/r", n % 3, "/b/", k, "/lib.sqlite"), _text("/r", n % 3, "/b/c/d/", k, "/lib.sqlite"), _text("/r", n % 3, "/e/lib.txt"))
    files = load(spark, sf_dir, "customer").select(F.explode(paths).alias("path"))
    return lib.data_folders(files, ["/r0", "/r1/"], 2, "lib.sqlite")


# --- writes ----------------------------------------------------------------------------------------


@query("value_dictionary", "WITH d AS (SELECT p_name AS value, CAST(min(p_partkey) * 3 AS BIGINT) AS valueID FROM part WHERE p_size % 2 = 0 GROUP BY 1), n AS (SELECT DISTINCT p_name AS value FROM part WHERE p_name NOT IN (SELECT value FROM d)) SELECT valueID, value FROM d UNION ALL SELECT (SELECT max(valueID) FROM d) + row_number() OVER (ORDER BY value), value FROM n")
def value_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary with numbers for new values behind the old ones."""
    p = load(spark, sf_dir, "part")
    known = p.filter("p_size % 2 = 0").groupBy(F.col("p_name").alias("value")).agg((F.min("p_partkey") * 3).cast("long").alias("valueID"))
    return sinks.value_ids(p.select(F.col("p_name").alias("value")), known)


@query("tombstones_after_delete", "SELECT o_orderkey AS itemID FROM orders WHERE o_orderstatus = 'P' UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def tombstones_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones with those for newly deleted items, each once."""
    old = load(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("itemID"))
    return sinks.add_tombstones(old, load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("itemID")))


@query("values_after_patch", "SELECT o_orderkey AS itemID, 1 AS fieldID, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE o_orderpriority END AS value FROM orders UNION ALL SELECT o_orderkey, 2, 'new' FROM orders WHERE o_orderstatus = 'F'")
def values_after_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute rows where those of a patch replace their keys."""
    o = load(spark, sf_dir, "orders")
    current = o.select(F.col("o_orderkey").alias("itemID"), F.lit(1).alias("fieldID"), F.col("o_orderpriority").alias("value"))
    patch = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("itemID"), F.explode(F.array(F.lit(1), F.lit(2))).alias("fieldID"), F.lit("new").alias("value"))
    return sinks.upsert_values(current, patch, ["itemID", "fieldID"])


@query("members_after_move", "SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1 ELSE c_custkey END AS itemID, CAST(c_nationkey AS BIGINT) AS collectionID FROM customer")
def members_after_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships where moved items are replaced."""
    c = load(spark, sf_dir, "customer")
    members = c.select(F.col("c_nationkey").cast("long").alias("collectionID"), F.col("c_custkey").alias("itemID"))
    return sinks.move_members(members, c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("itemID"), (F.col("c_custkey") + 1).alias("target")))


@query("rows_after_guarded_update", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 1 THEN 'new' ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 1 THEN s_suppkey + 1 ELSE s_suppkey END AS version FROM supplier")
def rows_after_guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the changes that were made from their version; others are refused."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("version"))
    changes = s.filter("id % 3 > 0").select("id", F.lit("new").alias("name"), F.when(F.col("id") % 3 == 1, F.col("version")).otherwise(F.col("version") - 1).alias("version"))
    return sinks.guarded_update(s, changes, "id", "version", ["name"])


# --- tables after a sync ---------------------------------------------------------------------------


def synced(spark: SparkSession, sf_dir: str) -> lib.Library:
    """The library with an attachment for each customer, of which some are there already, applied twice."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    rows = c.select(
        _text("K", k).alias("parent_key"), _text("N", k % 100).alias("key"), _text("f", k % 100, ".pdf").alias("filename"), _text("Title ", k % 100, " &amp; more").alias("title"), F.lit("application/pdf").alias("contentType"), F.lit("2024").alias("dateModified"),
    ).filter(k < 100)
    once = sync.attach(star_library(spark, sf_dir), rows)
    return sync.attach(once, rows)


@query("library_after_attach", "SELECT 'N' || c_custkey AS key, o_orderkey AS parent, 'storage:f' || c_custkey || '.pdf' AS path, 'Title ' || c_custkey || ' &amp; more' AS title FROM customer LEFT JOIN orders ON o_orderkey = c_custkey WHERE c_custkey < 100")
def library_after_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New attachments after a sync that ran twice, with parents and titles."""
    library = synced(spark, sf_dir)
    rows = library["items"].filter("key like 'N%'").join(library["itemAttachments"], "itemID").join(lib.field_maps(library), "itemID")
    return rows.select("key", F.col("parentItemID").alias("parent"), "path", F.element_at("fields", "title").alias("title"))


@query("library_after_parents", LIBRARY + "SELECT 'A' || o || '-' || ln || '-' || p AS key, CASE WHEN p % 11 <> 0 THEN 'K' || o ELSE 'P' || p END AS parent FROM a")
def library_after_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments after parents were made for those that stood alone; a parent that no table holds is named by its id."""
    library = star_library(spark, sf_dir)
    alone = library["items"].join(library["itemAttachments"].filter("parentItemID is null"), "itemID")
    rows = alone.select("key", F.concat(F.lit("P"), F.regexp_extract("key", "([0-9]+)$", 1)).alias("parent_key"), F.lit("book").alias("item_type"), F.lit("made").alias("title"), F.lit("2024").alias("dateModified"))
    after = sync.ensure_parents(library, rows)
    items = after["items"].select("itemID", "key")
    parents = items.select(F.col("itemID").alias("parentItemID"), F.col("key").alias("_parent"))
    named = F.coalesce("_parent", _text("K", F.col("parentItemID"))).alias("parent")
    return after["itemAttachments"].join(items, "itemID").join(parents, "parentItemID", "left").select("key", named)
