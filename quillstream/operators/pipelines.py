"""Whole flows over the other operators: backlog scans, enrichment, discovery and controller steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank
from . import candidates as cand
from . import inventory as inv
from . import jobs


def backlog(rows: DataFrame, existing: DataFrame, key: Column, has_metadata: Column, scan_limit: int | None = None, queue_limit: int | None = None, order: str = "created_at") -> DataFrame:
    """Rows of a scan with dedupe_key and outcome: queued, already_known, no_metadata or over_limit.

    The scan limit comes first; the queue limit counts queued rows only.
    """
    rows = rows.withColumns({"dedupe_key": key, "_ok": has_metadata})
    rows = rows.orderBy(order, "dedupe_key").limit(scan_limit) if scan_limit else rows
    known = existing.select("dedupe_key").distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, "dedupe_key", "left")
    first = F.row_number().over(Window.partitionBy("dedupe_key").orderBy(order)) == 1
    outcome = F.when(~F.col("_ok"), "no_metadata").when(F.col("_known") | ~F.col("_first"), "already_known").otherwise("queued")
    rows = rows.withColumn("_first", first).withColumn("outcome", outcome).drop("_ok", "_known", "_first")
    if not queue_limit:
        return rows
    chosen = rows.filter("outcome = 'queued'").orderBy(order, "dedupe_key").limit(queue_limit).select("dedupe_key", F.lit(True).alias("_in"))
    late = (F.col("outcome") == "queued") & F.col("_in").isNull()
    return rows.join(chosen, "dedupe_key", "left").withColumn("outcome", F.when(late, "over_limit").otherwise(F.col("outcome"))).drop("_in")


def full_text_backlog(items: DataFrame, attachments: DataFrame, existing: DataFrame, item: str, key: Column, queue_limit: int | None = None) -> DataFrame:
    """Items without PDF and source HTML, as jobs of their parents."""
    counts = inv.with_scan_decision(inv.inventory(attachments, item)).select(item, "skip_scan", "fingerprint")
    open_ = items.join(counts, item, "left").filter(~F.coalesce("skip_scan", F.lit(False)))
    return backlog(open_, existing, key, F.lit(True), queue_limit=queue_limit, order=item)


def enrich(items: DataFrame, candidates: DataFrame, item: str, policy: str = "emptyFieldsOnly", least_score: float = 0.0) -> DataFrame:
    """Items with the patch of their merged candidate: item, source fields, score, patch, applied_fields, reason.

    `items` holds item and the current fields map; candidates under the score gate are left out.
    """
    merged = cand.merge(candidates.filter(F.col("score") >= least_score), item)
    pairs = items.join(merged.select(item, F.col("fields").alias("candidate"), "score", "identifier"), item, "left")
    differences = cand.diff(pairs.filter("candidate is not null"), item, "candidate", "fields", policy)
    applied = cand.patch(differences, item)
    reason = F.when(F.col("candidate").isNull(), "no_candidate").when(F.col("patch").isNull(), "no_patch").otherwise("patched")
    return pairs.join(applied, item, "left").withColumn("reason", reason)


def expand_identifiers(items: DataFrame, candidates: DataFrame, item: str, kinds: dict[str, str]) -> DataFrame:
    """Items whose missing identifiers come from the first candidate that has them.

    `kinds` names the item's column for each candidate field.
    """
    firsts = []
    for column, name in kinds.items():
        value = blank(F.element_at("fields", name))
        firsts.append(F.min_by(value, F.when(value != "", F.col("ordinal"))).alias(f"_{column}"))
    found = candidates.groupBy(item).agg(*firsts)
    out = items.join(found, item, "left")
    fill = {c: F.coalesce(F.nullif(blank(F.col(c)), F.lit("")), F.nullif(blank(F.col(f"_{c}")), F.lit("")), F.lit("")) for c in kinds}
    return out.withColumns(fill).drop(*[f"_{c}" for c in kinds])


def discover(locations: DataFrame, item: str, limit: int) -> DataFrame:
    """Locations of each item, expanded, without repeats, in probing order under a budget."""
    from ..functions import urls

    wide = cand.expanded_locations(locations)
    keys = [F.lower("source"), F.lower("kind"), urls.normalized_probe_url(F.col("url"))]
    unique = cand.first_by(wide, keys, ["ordinal", "sub"], [item])
    unique = unique.withColumn("ordinal", F.col("ordinal") * 4 + F.col("sub"))
    return cand.probe_plan(unique, [item], limit)


def next_action(summaries: DataFrame, queues: dict[str, Column]) -> DataFrame:
    """Ready queues in their fixed order, and the first of them."""
    ready = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in queues.items()]))
    return summaries.withColumn("actions", ready).withColumn("next_action", F.get("actions", F.lit(0)))


def attach_status(html_status: Column, pdf_status: Column) -> Column:
    """One status for the outcomes of HTML and PDF."""
    h, p = blank(html_status), blank(pdf_status)
    return (
        F.when((h == "attached") & (p == "attached"), "html_and_pdf_attached").when(h == "attached", "html_attached").when(p == "attached", "pdf_attached")
        .when((h == "failed") | (p == "failed"), "attach_failed").when((h == "") & (p == ""), "nothing_found").otherwise("skipped")
    )


def throttle_gaps(requests: DataFrame, host: str, at: str, least_seconds: float) -> DataFrame:
    """Requests with the wait that their host's interval asks for behind the request before."""
    before = F.lag(at).over(Window.partitionBy(host).orderBy(at))
    gap = F.col(at).cast("timestamp").cast("double") - before.cast("timestamp").cast("double")
    return requests.withColumn("wait_seconds", F.greatest(F.lit(0.0), F.coalesce(F.lit(float(least_seconds)) - gap, F.lit(0.0))))


def full_text_commands(leased: DataFrame, downloads: DataFrame) -> DataFrame:
    """Commands for leased full-text jobs by what was downloaded for them.

    `downloads` holds job_id, kind (html or pdf), accepted and retryable.  A job with an accepted download
    succeeds; one whose downloads may come later fails for now; one without any is skipped.
    """
    found = downloads.groupBy("job_id").agg(
        F.count_if((F.col("kind") == "html") & F.col("accepted")).alias("html"), F.count_if((F.col("kind") == "pdf") & F.col("accepted")).alias("pdf"), F.bool_or(F.col("retryable") & ~F.col("accepted")).alias("later")
    )
    got = F.coalesce(F.col("html") + F.col("pdf"), F.lit(0)) > 0
    message = F.when((F.col("html") > 0) & (F.col("pdf") > 0), "html_and_pdf_found").when(F.col("html") > 0, "html_found").when(F.col("pdf") > 0, "pdf_found").when(F.col("later"), "sources_unavailable").otherwise("nothing_found")
    action = F.when(got, "succeed").when(F.coalesce("later", F.lit(False)), "fail").otherwise("skip")
    return leased.select("job_id", F.col("lease_owner").alias("owner"), F.col("attempts").alias("attempt")).join(found, "job_id", "left").select("job_id", "owner", "attempt", action.alias("action"), message.alias("message"), F.lit(True).alias("retryable"))


def preprint_commands(leased: DataFrame, pages: DataFrame, least: int = 200) -> DataFrame:
    """Commands for leased preprint jobs: those whose page holds enough text succeed, others fail, for now if no page came."""
    from ..functions.html import valid_preprint_html

    judged = pages.select("job_id", valid_preprint_html(F.col("html"), least).alias("v"))
    rows = leased.select("job_id", F.col("lease_owner").alias("owner"), F.col("attempts").alias("attempt")).join(judged, "job_id", "left")
    ok = F.coalesce("v.ok", F.lit(False))
    return rows.select("job_id", "owner", "attempt", F.when(ok, "succeed").otherwise("fail").alias("action"), F.coalesce("v.reason", F.lit("not_fetched")).alias("message"), F.col("v").isNull().alias("retryable"))


def best_preprint(items: DataFrame, hits: DataFrame, item: str, least_score: float = 0.88) -> DataFrame:
    """The preprint of each item: by its identifier, else the most alike title from a score on, the first of equals.

    `items` holds item and title; `hits` item, ordinal, by_id, preprint_id and title.
    """
    from ..functions.text import title_match_score

    both = hits.join(items.select(item, F.col("title").alias("_own")), item).withColumn("score", title_match_score(F.col("_own"), F.col("title")))
    fits = both.filter(F.col("by_id") | (F.col("score") >= least_score))
    order = Window.partitionBy(item).orderBy(F.col("by_id").desc(), F.col("score").desc(), "ordinal")
    return fits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(item, "preprint_id", "by_id", "score")


def follow_ups(done: DataFrame, existing: DataFrame) -> DataFrame:
    """Jobs that ended full-text jobs call for, those that are there already left out.

    `done` holds library_id, key, has_html and needs_ocr: a page is translated, a PDF without text is read.
    """
    wanted = F.array_compact(F.array(F.when(F.col("has_html"), "source_html"), F.when(F.col("needs_ocr"), "ocr")))
    rows = done.select("library_id", "key", F.explode(wanted).alias("job_type"))
    keyed = rows.withColumn("dedupe_key", jobs.dedupe_key(F.col("job_type"), F.col("library_id"), F.col("key")))
    return jobs.enqueue(keyed, existing, order="key")


__all__ = [
    "attach_status", "backlog", "best_preprint", "discover", "enrich", "expand_identifiers", "follow_ups", "full_text_backlog", "full_text_commands", "jobs", "next_action", "preprint_commands", "throttle_gaps",
]
