"""Library scans over the star-schema stand-ins: orders are items, line items their attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media_types
from ..operators import inventory as inv
from ..operators import library as lib
from ..sources.tables import load
from .registry import query


def line_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as attachments: key, parent, media type, path, presence, size and time."""
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_returnflag")  # noqa: E741
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    name = (
        F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("storage:p"), F.col("l_partkey"), F.lit(".pdf"))).when(F.col("l_partkey") % 5 == 1, F.lit("storage:a [en html].html"))
        .when(F.col("l_partkey") % 5 == 2, F.lit("storage:b [source html].html")).when(F.col("l_partkey") % 5 == 3, F.lit("storage:snapshot.htm")).otherwise(F.lit("storage:notes.txt"))
    )
    rows = l.select(key.alias("key"), F.col("l_orderkey").alias("parent"), name.alias("path"), F.when(F.col("l_returnflag") == "R", F.lit(False)).when(F.col("l_returnflag") == "A", F.lit(True)).alias("exists"), F.floor("l_extendedprice").alias("size"), F.unix_timestamp("l_shipdate").alias("mtime"))
    none = F.lit(None).cast("string")
    return rows.withColumns(
        {
            "is_pdf": media_types.is_pdf(none, F.col("path"), none), "is_html": media_types.is_html(none, F.col("path"), none),
            "is_source_html": media_types.is_source_html(F.col("path")), "is_generated_html": media_types.is_generated_html(F.col("path")),
        }
    )


#: The same attachments in SQL; names end every oracle that starts with this.
LINE_ATTACHMENTS = """
WITH att AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS key, l_orderkey AS parent,
         CASE l_partkey % 5 WHEN 0 THEN 'storage:p' || l_partkey || '.pdf' WHEN 1 THEN 'storage:a [en html].html' WHEN 2 THEN 'storage:b [source html].html'
                            WHEN 3 THEN 'storage:snapshot.htm' ELSE 'storage:notes.txt' END AS path,
         CASE l_returnflag WHEN 'R' THEN false WHEN 'A' THEN true END AS exists_,
         CAST(floor(l_extendedprice) AS BIGINT) AS size, CAST(epoch(l_shipdate) AS BIGINT) AS mtime,
         l_partkey % 5 = 0 AS is_pdf, l_partkey % 5 IN (1, 2, 3) AS is_html, l_partkey % 5 IN (1, 2) AS is_source_html, l_partkey % 5 = 1 AS is_generated_html
  FROM lineitem
)
"""


@query(
    "live_attachments_scan",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, o.o_custkey, l.l_shipdate FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
       WHERE l.l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AND (l.l_returnflag = 'A' OR l.l_linestatus = 'O')
       ORDER BY l.l_shipdate DESC, l.l_orderkey, l.l_linenumber, l.l_partkey LIMIT 500""",
)
def live_attachments_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments with parents and without tombstones, newest first, top 500."""
    l, o, s = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))  # noqa: E741
    tombstones = s.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    rows = lib.live(l.filter("l_returnflag = 'A' or l_linestatus = 'O'"), tombstones, "l_suppkey")
    rows = rows.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey", "left").withColumnRenamed("l_shipdate", "dateModified")
    return lib.newest(rows, 500, "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", F.col("dateModified").alias("l_shipdate"))


@query("count_live_pdfs", LINE_ATTACHMENTS + "SELECT count(*) AS n FROM att WHERE is_pdf AND exists_ IS DISTINCT FROM false")
def count_live_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many PDF attachments are not missing."""
    return line_attachments(spark, sf_dir).filter(F.col("is_pdf") & inv.present(F.col("exists"))).agg(F.count(F.lit(1)).alias("n"))


@query(
    "collection_or_join",
    """SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem
       WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) OR l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)""",
)
def collection_or_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a collection by themselves or by their parent: an OR of two keys as two hash joins."""
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")  # noqa: E741
    members = load(spark, sf_dir, "supplier").filter("s_nationkey = 3").select("s_suppkey")
    return lib.either_join(l, members, ["l_suppkey", "l_partkey"], "s_suppkey").select("l_orderkey", "l_linenumber", "l_partkey").distinct()


@query("distinct_collection_keys", "SELECT DISTINCT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 7")
def distinct_collection_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of a collection given by name or key."""
    return load(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING' or c_nationkey = 7").select("c_nationkey").distinct()


NAMES = ("name", "brand", "type", "size")


def part_values(spark: SparkSession, sf_dir: str) -> lib.Library:
    """Parts as entity-attribute-value tables."""
    p = load(spark, sf_dir, "part")
    cells = [F.struct(F.lit(i).cast("long").alias("fieldID"), F.col(f"p_{name}").cast("string").alias("value")) for i, name in enumerate(NAMES)]
    rows = p.select(F.col("p_partkey").alias("itemID"), F.explode(F.array(*cells)).alias("c")).select("itemID", "c.fieldID", (F.col("itemID") * 10 + F.col("c.fieldID")).alias("valueID"), "c.value")
    fields = spark.createDataFrame(list(enumerate(NAMES)), "fieldID long, fieldName string")
    return lib.Library({"itemData": rows.select("itemID", "fieldID", "valueID"), "itemDataValues": rows.select("valueID", "value"), "fields": fields})


@query("eav_pivot_map", "SELECT p_partkey, p_name AS name, p_brand AS brand, p_type AS type, CAST(p_size AS VARCHAR) AS size, CAST(4 AS INTEGER) AS n_fields FROM part")
def eav_pivot_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute-value rows back to a map for each entity, and columns out of it."""
    maps = lib.field_maps(part_values(spark, sf_dir))
    return maps.select(F.col("itemID").alias("p_partkey"), *[F.element_at("fields", f).alias(f) for f in NAMES], F.size("fields").alias("n_fields"))


@query("ordered_creators_array", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ', ' ORDER BY l_linenumber, l_partkey) AS creators, count(*) AS n FROM lineitem GROUP BY 1")
def ordered_creators_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of each item as an ordered array, joined."""
    rows = lib.ordered_array(load(spark, sf_dir, "lineitem"), "l_orderkey", [F.col("l_linenumber"), F.col("l_partkey")], ["l_partkey"], "creators")
    return rows.select("l_orderkey", F.array_join(F.transform("creators", lambda c: c["l_partkey"].cast("string")), ", ").alias("creators"), F.size("creators").cast("long").alias("n"))


@query(
    "nocase_tag_arrays",
    """SELECT n_regionkey, string_agg(n_name, '|' ORDER BY lower(n_name), n_name) AS tags, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1""",
)
def nocase_tag_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each group in an order that ignores case."""
    n = load(spark, sf_dir, "nation")
    tagged = lib.Library({"itemTags": n.select(F.col("n_regionkey").alias("itemID"), F.col("n_nationkey").alias("tagID")), "tags": n.select(F.col("n_nationkey").alias("tagID"), F.col("n_name").alias("name"))})
    return lib.tags(tagged).select(F.col("itemID").alias("n_regionkey"), F.array_join("tags", "|").alias("tags"), F.size("tags").cast("long").alias("n"))


@query(
    "source_priority_fallback",
    """WITH a AS (SELECT p_partkey, p_name FROM part WHERE p_size < 10), b AS (SELECT p_partkey, p_name FROM part WHERE p_size < 30),
       u AS (SELECT p_partkey, p_name, 0 AS source_rank FROM a UNION ALL SELECT p_partkey, p_name, 1 FROM b WHERE p_partkey NOT IN (SELECT p_partkey FROM a))
       SELECT * FROM u ORDER BY source_rank, p_partkey LIMIT 700""",
)
def source_priority_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First source, then what only the second one has, under one limit."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return lib.with_fallback(p.filter("p_size < 10").drop("p_size"), p.filter("p_size < 30").drop("p_size"), "p_partkey", 700)


@query("first_per_folder", "SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def first_per_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First file of each folder by name."""
    return lib.first_per(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey"], ["l_partkey", "l_linenumber"])


@query(
    "sibling_by_filename",
    """WITH f AS (SELECT l_orderkey, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS key, min(CASE WHEN l_linenumber % 2 = 0 THEN 'F' ELSE 'f' END || l_partkey % 3) AS name FROM lineitem GROUP BY 1, 2)
       SELECT a.key, b.key AS sibling FROM f a JOIN f b ON a.l_orderkey = b.l_orderkey AND lower(a.name) = lower(b.name) AND a.key <> b.key""",
)
def sibling_by_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs under one parent whose file names are equal but for case."""
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    name = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "F").otherwise("f"), F.col("l_partkey") % 3)
    rows = l.select("l_orderkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("key"), name.alias("name")).groupBy("l_orderkey", "key").agg(F.min("name").alias("name"))
    return lib.siblings_by_filename(rows, "l_orderkey", "key", "name")


@query("in_list_and_contradiction", "SELECT 'list' AS filter, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') UNION ALL SELECT 'empty', 0 UNION ALL SELECT 'none', count(*) FROM orders")
def in_list_and_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key list, an empty key list (nothing) and no key list (everything)."""
    o = load(spark, sf_dir, "orders").select("o_orderstatus")
    parts = [o.filter(lib.key_filter("o_orderstatus", keys)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("filter"), "n") for name, keys in (("list", ["F", "P"]), ("empty", []), ("none", None))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "source_url_precedence",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'https://arxiv.org/html/' || (1000 + p_partkey % 9000) || '.' || (10000 + p_partkey % 90000)
         WHEN p_partkey % 4 = 1 THEN 'https://x.example.com/' || p_partkey WHEN p_partkey % 4 = 2 THEN 'https://doi.org/10.1234/' || p_partkey END AS hint FROM part""",
)
def source_url_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best page for an item by precedence of its fields."""
    k = F.col("p_partkey")
    is_ = lambda r, c: F.when(k % 4 == r, c).otherwise("")
    archive = is_(0, F.concat(F.lit("arXiv:"), (1000 + k % 9000).cast("string"), F.lit("."), (10000 + k % 90000).cast("string"), F.lit("v2")))
    url, doi = is_(1, F.concat(F.lit("https://x.example.com/"), k)), is_(2, F.concat(F.lit("10.1234/"), k))
    return load(spark, sf_dir, "part").select("p_partkey", lib.source_url_hint(url, doi, archive).alias("hint"))


@query(
    "library_ids_and_paths",
    """SELECT c_custkey, regexp_replace(c_mktsegment, '[^A-Za-z0-9]+', '_', 'g') || '_' || substr(sha1(lower('/data/' || c_name)), 1, 8) AS library_id,
       CASE WHEN c_nationkey % 2 = 0 THEN '/data/storage/K' || c_custkey || '/a.pdf' END AS path FROM customer""",
)
def library_ids_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable library ids, and stored paths resolved where they can be."""
    c = load(spark, sf_dir, "customer")
    stored = F.when(F.col("c_nationkey") % 2 == 0, "storage:a.pdf").otherwise("/elsewhere/a.pdf")
    return c.select("c_custkey", lib.library_id(F.col("c_mktsegment"), F.concat(F.lit("/data/"), F.col("c_name"))).alias("library_id"), lib.storage_path(F.lit("/data"), F.concat(F.lit("K"), F.col("c_custkey")), stored).alias("path"))


@query(
    "inventory_counts",
    LINE_ATTACHMENTS
    + """SELECT parent, count(*) FILTER (is_pdf) AS pdf_count, count(*) FILTER (is_html AND exists_ IS DISTINCT FROM false) AS html_count,
       count(*) FILTER (is_source_html AND exists_ IS DISTINCT FROM false) AS source_html_count, count(*) FILTER (is_generated_html AND exists_ IS DISTINCT FROM false) AS generated_html_count,
       count(*) FILTER (is_html AND NOT is_source_html AND NOT is_generated_html AND exists_ IS DISTINCT FROM false) AS unknown_html_count, count(*) FILTER (exists_ = false) AS missing_file_count,
       count(*) FILTER (is_pdf) > 0 AS has_pdf, count(*) FILTER (is_html AND exists_ IS DISTINCT FROM false) > 0 AS has_html, count(*) FILTER (is_source_html AND exists_ IS DISTINCT FROM false) > 0 AS has_source_html
       FROM att GROUP BY 1""",
)
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text inventory of each item."""
    return inv.inventory(line_attachments(spark, sf_dir), "parent")


@query(
    "inventory_skip_and_fingerprint",
    LINE_ATTACHMENTS
    + """, c AS (SELECT parent, count(*) FILTER (is_pdf) AS p, count(*) FILTER (is_html AND exists_ IS DISTINCT FROM false) AS h, count(*) FILTER (is_source_html AND exists_ IS DISTINCT FROM false) AS s FROM att GROUP BY 1)
       SELECT parent, p > 0 AND s > 0 AS skip_scan, CASE WHEN p > 0 THEN 0 ELSE 3 END AS pdf_limit,
       'pdf=' || CAST(p > 0 AS INT) || ':' || p || '|source_html=' || CAST(s > 0 AS INT) || ':' || s || '|html=' || CAST(h > 0 AS INT) || ':' || h AS fingerprint FROM c""",
)
def inventory_skip_and_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an item needs no scan, its download limit and the fingerprint of its counts."""
    return inv.with_scan_decision(inventory_counts(spark, sf_dir)).select("parent", "skip_scan", "pdf_limit", "fingerprint")


@query(
    "keep_best_attachment",
    LINE_ATTACHMENTS
    + """, s AS (SELECT * FROM att WHERE is_source_html), k AS (SELECT parent, key AS keep_key FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY size DESC, mtime DESC, key DESC) AS rn FROM s WHERE exists_ IS DISTINCT FROM false) WHERE rn = 1)
       SELECT s.parent, s.key, k.keep_key, CASE WHEN s.exists_ = false THEN 'missing_file' WHEN k.keep_key IS NOT NULL AND s.key <> k.keep_key THEN 'duplicate_source_html' END AS reason
       FROM s LEFT JOIN k USING (parent)""",
)
def keep_best_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source copy of an item stays, and why the others go."""
    records = line_attachments(spark, sf_dir).filter("is_source_html")
    return inv.cleanup(records, ["parent"]).select("parent", "key", "keep_key", "reason")


@query(
    "duplicate_source_parents",
    """SELECT md5(text) AS digest, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members FROM documents GROUP BY text HAVING count(*) >= 2""",
)
def duplicate_source_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with several records: documents with equal texts, by digest."""
    d = load(spark, sf_dir, "documents").select(F.md5("text").alias("digest"), "doc_id")
    rows = inv.duplicate_parents(d, ["digest"], "doc_id")
    return rows.select("digest", "n", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query(
    "stale_semi_join",
    """SELECT d.doc_id, CASE WHEN d.lang <> 'en' AND EXISTS (SELECT 1 FROM documents s WHERE s.lang = 'en' AND s.source = d.source AND s.n_chars > 9000) THEN 1 ELSE 0 END AS stale FROM documents d""",
)
def stale_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a source record of the same parent makes stale."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    sources = d.filter("lang = 'en' and n_chars > 9000")
    marked = inv.mark_stale(d.filter("lang <> 'en'").withColumn("issues", F.array().cast("array<string>")), sources, ["source"], "stale")
    rest = d.filter("lang = 'en'").select("doc_id", F.lit(0).alias("stale"))
    return marked.select("doc_id", F.array_contains("issues", "stale").cast("int").alias("stale")).unionByName(rest)


@query(
    "audit_full_outer_match",
    """SELECT coalesce(o.o_orderkey, l.k) AS path, CASE WHEN o.o_orderkey IS NULL THEN 'row_only' WHEN l.k IS NULL THEN 'file_only' ELSE 'both' END AS found
       FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) o FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 2 = 0) l ON o.o_orderkey = l.k""",
)
def audit_full_outer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed files against table rows, both ways."""
    files = load(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("path"))
    rows = load(spark, sf_dir, "lineitem").filter("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("path")).distinct()
    return inv.match_files(files, rows).select("path", "found")


ISSUES = "CASE WHEN n_chars < 500 THEN ['short'] ELSE [] END || CASE WHEN text LIKE '%$$$%' THEN ['noise'] ELSE [] END || CASE WHEN lang <> 'en' THEN ['foreign'] ELSE [] END"


def document_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    issues = F.array_compact(F.array(F.when(F.col("n_chars") < 500, "short"), F.when(F.contains("text", F.lit("$$$")), "noise"), F.when(F.col("lang") != "en", "foreign")))
    return d.select("doc_id", issues.alias("issues"))


@query("audit_issue_counts", f"SELECT issue, count(*) AS n FROM (SELECT unnest({ISSUES}) AS issue FROM documents) GROUP BY 1")
def audit_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each issue was found."""
    return inv.issue_counts(document_issues(spark, sf_dir))


@query(
    "cleanup_plan",
    f"""WITH i AS (SELECT doc_id, {ISSUES} AS issues FROM documents)
        SELECT doc_id, CASE WHEN list_contains(issues, 'noise') THEN 'repolish' WHEN list_contains(issues, 'short') OR list_contains(issues, 'foreign') THEN 'review' END AS action FROM i
        WHERE len(issues) > 0""",
)
def cleanup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action that an audit's issues call for."""
    return inv.split_plan(document_issues(spark, sf_dir), {"repolish": ["noise"], "review": ["short", "foreign"]}).select("doc_id", "action")


@query(
    "attachment_type_flags",
    LINE_ATTACHMENTS + "SELECT key, is_pdf, is_html, is_source_html, is_generated_html FROM att",
)
def attachment_type_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each attachment is, by media type and name."""
    return line_attachments(spark, sf_dir).select("key", "is_pdf", "is_html", "is_source_html", "is_generated_html")
