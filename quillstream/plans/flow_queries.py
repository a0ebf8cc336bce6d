"""Flows from scan to queue, from candidates to patches, and from locations to probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batches, pipelines
from ..operators.jobs import dedupe_key
from ..sources.tables import load
from . import metadata_queries as meta
from .registry import query


@query(
    "backlog_scan",
    """WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate, 'ocr:' || o_custkey || ':' || o_orderpriority AS dedupe_key, o_orderstatus <> 'P' AS ok FROM orders),
       k AS (SELECT DISTINCT 'ocr:' || c_custkey || ':1-URGENT' AS dedupe_key FROM customer WHERE c_acctbal < 0),
       r AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY o_orderkey) AS rn FROM s)
       SELECT o_orderkey, CASE WHEN NOT ok THEN 'no_metadata' WHEN dedupe_key IN (SELECT dedupe_key FROM k) OR rn > 1 THEN 'already_known' ELSE 'queued' END AS outcome FROM r""",
)
def backlog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan does with each attachment: queue it, or why not."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    known = load(spark, sf_dir, "customer").filter("c_acctbal < 0").select(dedupe_key("ocr", F.col("c_custkey"), "1-URGENT").alias("dedupe_key"))
    key = dedupe_key("ocr", F.col("o_custkey"), F.col("o_orderpriority"))
    return pipelines.backlog(o, known, key, F.col("o_orderstatus") != "P", order="o_orderkey").select("o_orderkey", "outcome")


@query(
    "enrich_pipeline",
    meta.CANDIDATES
    + """, g AS (SELECT * FROM c WHERE score >= 0.25), f AS (SELECT p_partkey, ordinal, source, priority, score, 'title' AS field, title AS value FROM g UNION ALL SELECT p_partkey, ordinal, source, priority, score, 'volume', volume FROM g),
       m AS (SELECT p_partkey, field, value FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, field ORDER BY score DESC, priority DESC, ordinal) AS rn FROM f WHERE value <> '') WHERE rn = 1),
       a AS (SELECT m.p_partkey, string_agg(m.field, ',' ORDER BY m.field) AS applied FROM m JOIN part p USING (p_partkey) WHERE NOT (m.field = 'title' AND p.p_size % 2 = 0) GROUP BY 1)
       SELECT p.p_partkey, CASE WHEN p.p_partkey NOT IN (SELECT p_partkey FROM g) THEN 'no_candidate' WHEN a.applied IS NULL THEN 'no_patch' ELSE 'patched' END AS reason, coalesce(a.applied, '') AS applied FROM part p LEFT JOIN a USING (p_partkey)""",
)
def enrich_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates over a score gate, merged and compared with each item, to a patch."""
    items = load(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("title"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("")).alias("fields"))
    out = pipelines.enrich(items, meta.part_candidates(spark, sf_dir), "p_partkey", least_score=0.25)
    return out.select("p_partkey", "reason", F.coalesce(F.array_join("applied_fields", ","), F.lit("")).alias("applied"))


@query(
    "expand_identifiers",
    meta.CANDIDATES + """, v AS (SELECT p_partkey, volume FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY ordinal) AS rn FROM c) WHERE rn = 1) SELECT p.p_partkey, CASE WHEN p.p_size % 2 = 0 THEN 'own' ELSE v.volume END AS volume FROM part p JOIN v USING (p_partkey)""",
)
def expand_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing identifiers from the first candidate that has them."""
    items = load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "own").otherwise("").alias("volume"))
    return pipelines.expand_identifiers(items, meta.part_candidates(spark, sf_dir), "p_partkey", {"volume": "volume"}).select("p_partkey", "volume")


@query(
    "discovery_plan",
    """WITH p AS (SELECT p_partkey, p_partkey % 4 AS r FROM part), n AS (SELECT p_partkey, unnest(CASE r WHEN 0 THEN ['probe', 'probe', 'probe'] WHEN 1 THEN ['probe', 'probe'] WHEN 2 THEN ['skipped_pdf'] ELSE ['probe'] END) AS status FROM p)
       SELECT p_partkey, status, count(*) AS n FROM n GROUP BY 1, 2""",
)
def discovery_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many locations of each item are probed."""
    plan = pipelines.discover(meta.part_locations(spark, sf_dir), "p_partkey", 5)
    return plan.groupBy("p_partkey", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "host_throttle_waits",
    "SELECT event_id, greatest(0.0, coalesce(3600.0 - (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))), 0.0)) > 0 AS waits FROM events",
)
def host_throttle_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that come too soon behind the one before to their host."""
    return pipelines.throttle_gaps(load(spark, sf_dir, "events"), "user_id", "ts", 3600).select("event_id", (F.col("wait_seconds") > 0).alias("waits"))


@query(
    "full_text_drain",
    """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 4 = 0 THEN 'succeeded' WHEN o_orderkey % 4 = 1 THEN 'failed_retryable' ELSE 'skipped' END AS status, CASE WHEN o_orderkey % 4 > 0 THEN CASE o_orderkey % 4 WHEN 1 THEN 'sources_unavailable' ELSE 'nothing_found' END END AS last_error,
       1 AS attempts FROM orders""",
)
def full_text_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of a drain: all jobs leased, judged by their downloads, and ended."""
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    k = F.col("o_orderkey")
    none = lambda t: F.lit(None).cast(t)
    o = load(spark, sf_dir, "orders")
    queue = o.select(
        k.alias("job_id"), F.lit("full_text").alias("job_type"), F.lit("queued").alias("status"), F.lit("queued").alias("phase"), F.lit(0).alias("attempts"), F.lit(2).alias("max_attempts"), none("string").alias("lease_owner"), none("timestamp_ntz").alias("leased_until"),
        none("string").alias("last_error"), none("string").alias("result_json"), none("string").alias("output_path"), none("string").alias("relay_status"), none("string").alias("relay_result"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
    )
    downloads = o.filter(k % 4 != 2).select(k.alias("job_id"), F.when(k % 8 == 0, "pdf").otherwise("html").alias("kind"), (k % 4 == 0).alias("accepted"), (k % 4 == 1).alias("retryable"))
    after, _ = batches.drain(queue, now, "w", 900, lambda mine: pipelines.full_text_commands(mine, downloads), count=10**9)
    return after.select("job_id", "status", "last_error", "attempts")


@query("preprint_drain_commands", "SELECT page_id AS job_id, CASE WHEN page_id % 3 = 0 THEN 'succeed' ELSE 'fail' END AS action, CASE page_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'too_little_text' ELSE 'not_fetched' END AS message, page_id % 3 = 2 AS retryable FROM pages")
def preprint_drain_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of preprint jobs by the pages that came."""
    k = F.col("page_id")
    pages = load(spark, sf_dir, "pages")
    leased = pages.select(k.alias("job_id"), F.lit("w").alias("lease_owner"), F.lit(1).alias("attempts"))
    body = F.concat(F.lit("<html>"), F.when(k % 3 == 0, F.concat(F.coalesce("html", F.lit("")), F.repeat(F.lit("word "), 100))).otherwise("few words"))
    return pipelines.preprint_commands(leased, pages.filter(k % 3 < 2).select(k.alias("job_id"), body.alias("html"))).select("job_id", "action", "message", "retryable")


@query("best_preprints", "SELECT p_partkey, 'id' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN 'b' ELSE 'a' END AS preprint_id FROM part WHERE p_partkey % 3 < 2")
def best_preprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preprint of each item, by identifier or by a title that is alike enough."""
    k = F.col("p_partkey")
    p = load(spark, sf_dir, "part")
    hit = lambda i, by_id, name, title: F.struct(F.lit(i).alias("ordinal"), by_id.alias("by_id"), F.concat(F.lit("id"), k, F.lit(name)).alias("preprint_id"), title.alias("title"))
    rows = F.array(hit(0, F.lit(False), "a", F.when(k % 3 < 2, F.upper("p_name")).otherwise("quux zyzzyva")), hit(1, k % 3 == 0, "b", F.lit("other words")))
    hits = p.select("p_partkey", F.explode(rows).alias("h")).select("p_partkey", "h.*")
    return pipelines.best_preprint(p.select("p_partkey", F.col("p_name").alias("title")), hits, "p_partkey").select("p_partkey", "preprint_id")


@query(
    "follow_up_jobs",
    """WITH w AS (SELECT 'source_html:1:' || s_suppkey AS dedupe_key FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'ocr:1:' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) SELECT dedupe_key FROM w WHERE dedupe_key NOT IN (SELECT 'ocr:1:' || n_nationkey FROM nation)""",
)
def follow_up_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that ended full-text jobs call for."""
    k = F.col("s_suppkey")
    done = load(spark, sf_dir, "supplier").select(F.lit("1").alias("library_id"), k.cast("string").alias("key"), (k % 2 == 0).alias("has_html"), (k % 3 == 0).alias("needs_ocr"))
    existing = load(spark, sf_dir, "nation").select(dedupe_key("ocr", F.lit("1"), F.col("n_nationkey")).alias("dedupe_key"))
    return pipelines.follow_ups(done, existing).select("dedupe_key")
