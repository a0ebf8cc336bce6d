"""Metadata candidates: ranking, merging, diffs against an item, and full-text locations.

Candidates are rows (item, ordinal, source, identifier, score, fields map).  First-wins rules are kept by
explicit ordinals: no operator depends on the order in which rows arrive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import merge_extra, normalize_space

# Trust in providers, and the fields that a patch may set.
PRIORITY = {"zotero_translation_server_search": 100, "pubmed": 95, "europe_pmc": 90, "arxiv": 88, "crossref": 85, "openalex": 80, "semantic_scholar": 75, "unpaywall": 70, "datacite": 65, "doaj": 60, "core": 55, "openaire": 50}
PATCHED = (
    "title", "abstractNote", "date", "language", "shortTitle", "archive", "archiveLocation", "libraryCatalog", "rights", "extra", "publicationTitle", "journalAbbreviation", "DOI", "ISSN", "PMID", "PMCID",
    "volume", "issue", "pages", "series", "seriesTitle", "publisher", "place", "ISBN", "edition", "numPages", "numberOfVolumes", "bookTitle", "url", "accessDate", "institution", "reportType", "reportNumber",
    "conferenceName", "proceedingsTitle", "websiteTitle", "websiteType", "genre",
)
IDENTIFYING = ("DOI", "PMID", "PMCID", "archiveLocation", "ISBN", "title")


def priority(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    return F.coalesce(F.element_at(table, source), F.lit(0))


def best(candidates: DataFrame, item: str) -> DataFrame:
    """The candidate with the highest score for each item; the first one of equals."""
    order = Window.partitionBy(item).orderBy(F.col("score").desc(), "ordinal")
    return candidates.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def ranked_values(candidates: DataFrame, item: str) -> DataFrame:
    """(item, field, value, source, rank) of all fields that are not blank, best candidate first.

    Equal scores go by the provider's priority, then by ordinal.
    """
    exploded = candidates.select(item, "ordinal", "source", "score", F.explode("fields").alias("field", "raw"))
    valued = exploded.withColumn("value", normalize_space(F.col("raw"))).filter("value <> ''")
    order = Window.partitionBy(item, "field").orderBy(F.col("score").desc(), priority(F.col("source")).desc(), "ordinal")
    return valued.select(item, "field", "value", "source", F.row_number().over(order).alias("rank"))


def merge(candidates: DataFrame, item: str) -> DataFrame:
    """One candidate for each item: every field from the best candidate that has it.

    Values of `extra` are joined in rank order without repeated lines.  Returns item, fields, provenance
    (field to source), score (the highest) and identifier.
    """
    values = ranked_values(candidates, item)
    extras = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"])
    merged = values.groupBy(item, "field").agg(F.min_by("value", "rank").alias("first"), F.min_by("source", "rank").alias("source"), extras.alias("all"))
    joined = F.aggregate("all", F.lit(""), lambda a, b: merge_extra(a, b))
    merged = merged.select(
        item, "field", F.when(F.col("field") == "extra", joined).otherwise(F.col("first")).alias("value"), F.when(F.col("field") == "extra", "merged").otherwise(F.col("source")).alias("source")
    )
    fields = merged.groupBy(item).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "source")))).alias("provenance")
    )
    top = Window.partitionBy(item).orderBy(F.col("score").desc(), priority(F.col("source")).desc(), "ordinal")
    lead = candidates.withColumn("_n", F.row_number().over(top)).filter("_n = 1").select(item, "score", F.col("identifier").alias("own"))
    known = F.coalesce(*[F.element_at("fields", f) for f in IDENTIFYING], F.col("own"))
    return lead.join(fields, item, "left").withColumn("identifier", known).drop("own")


def redundant_extra(line: Column, known: Column) -> Column:
    """Whether a line of `extra` restates an identifier that the item has in its own field.

    `known` is a map of the item's fields, normalised and in lower case.
    """
    has = lambda f: F.coalesce(F.element_at(known, f), F.lit(""))
    got = lambda p: F.lower(F.regexp_extract(line, p, 1))
    same = lambda p, f: (has(f) != "") & (got(p) == has(f))
    pmid = F.regexp_extract(line, r"(?i)^PMID\s*:\s*(\d{1,10})\s*$", 1)
    bare = lambda c: F.regexp_replace(c, "^0+", "")
    return (
        ((pmid != "") & (has("PMID") != "") & (bare(pmid) == bare(has("PMID")))) | same(r"(?i)^PMCID\s*:\s*(PMC\d{5,10})\s*$", "PMCID")
        | same(r"(?i)^DOI\s*:\s*(.+?)\s*$", "DOI") | same(r"(?i)^ISBN(?:-1[03])?\s*:\s*(.+?)\s*$", "ISBN")
        | same(r"(?i)^arXiv\s*:\s*([A-Za-z.-]+/\d{7}|\d{4}\.\d{4,5})(?:v\d+)?(?:\s+\[[^\]]+\])?\s*$", "archiveLocation")
    )


def diff(pairs: DataFrame, item: str, candidate: str = "candidate", current: str = "current", policy: str = "emptyFieldsOnly") -> DataFrame:
    """(item, field, current_text, candidate_text, verdict) for every field of a candidate map.

    verdict is patch, or why the field is skipped: field_not_allowed_by_relay, candidate_empty,
    current_field_not_empty (under emptyFieldsOnly, by the raw value) or unchanged.  Every normalised value
    is a projection of its own, computed once; fields are normalised before they are exploded.
    """
    clean = lambda m: F.transform_values(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: normalize_space(v))
    rows = pairs.select(item, F.col(current).alias("_cur"), clean(F.col(current)).alias("_clean"), clean(F.col(candidate)).alias("_new"))
    rows = rows.select(item, "_cur", "_clean", F.explode("_new").alias("field", "_text"))
    empty = lambda m: F.coalesce(F.element_at(m, F.col("field")), F.lit(""))
    identifiers = F.transform_values(F.map_filter("_clean", lambda k, v: k.isin(*IDENTIFYING)), lambda k, v: F.lower(v))
    rows = rows.withColumns({"_own": empty("_cur"), "current_text": empty("_clean"), "_known": F.when(F.col("field") == "extra", identifiers)})
    text = F.when(F.coalesce(redundant_extra(F.col("_text"), F.col("_known")), F.lit(False)), "").otherwise(F.col("_text"))
    rows = rows.withColumn("_text", F.when(F.col("field") == "extra", text).otherwise(F.col("_text")))
    shown = F.when((F.col("field") == "extra") & (F.col("_text") != ""), merge_extra(F.col("_own"), F.col("_text"))).otherwise(F.col("_text"))
    rows = rows.withColumn("candidate_text", shown)
    verdict = (
        F.when(~F.col("field").isin(*PATCHED), "field_not_allowed_by_relay").when(F.col("_text") == "", "candidate_empty")
        .when(F.lit(policy == "emptyFieldsOnly") & (F.col("_own") != ""), "current_field_not_empty").when(F.col("current_text") == F.col("candidate_text"), "unchanged").otherwise("patch")
    )
    return rows.select(item, "field", "current_text", "candidate_text", verdict.alias("verdict"))


def patch(differences: DataFrame, item: str) -> DataFrame:
    """(item, patch map, applied fields in order) of the differences to apply."""
    applied = differences.filter("verdict = 'patch'").groupBy(item).agg(F.array_sort(F.collect_list(F.struct("field", "candidate_text"))).alias("rows"))
    return applied.select(item, F.map_from_entries("rows").alias("patch"), F.transform("rows", lambda r: r["field"]).alias("applied_fields"))


def drop_illegal(differences: DataFrame, rules: DataFrame, item_type: str = "item_type") -> DataFrame:
    """Differences without those whose field the item's type does not have; rules: (item_type, field)."""
    return differences.join(rules.select(item_type, "field").distinct(), [item_type, "field"], "left_anti").select(differences.columns)


def first_by(rows: DataFrame, keys: Sequence[Column], order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """The first row of each key, by explicit order."""
    window = Window.partitionBy(*within, *keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def expanded_locations(locations: DataFrame) -> DataFrame:
    """Each location behind the HTML pages that its URL lets derive; ordinal becomes (ordinal, sub)."""
    pid, url = urls.preprint_id(F.col("url")), F.col("url")
    make = lambda when, sub, source, u, why: F.when(when, F.struct(F.lit(sub).alias("sub"), source.alias("source"), u.alias("url"), F.lit("html").alias("kind"), F.lit(why).alias("derivation")))
    view = F.lower("kind").isin("landing", "webpage") & urls.is_article_view_url(url)
    rows = F.array(
        make(pid != "", 0, F.lit("arxiv"), F.concat(F.lit("https://arxiv.org/html/"), pid), "arxiv_html"),
        make(pid != "", 1, F.lit("ar5iv"), F.concat(F.lit("https://ar5iv.labs.arxiv.org/html/"), pid), "ar5iv_html"),
        make(view, 2, F.col("source"), url, "ojs_article_view"),
        F.struct(F.lit(3).alias("sub"), F.col("source").alias("source"), url.alias("url"), F.col("kind").alias("kind"), F.lit(None).cast("string").alias("derivation")),
    )
    rest = [c for c in locations.columns if c not in ("source", "url", "kind")]
    return locations.select(*rest, F.explode(F.array_compact(rows)).alias("_r")).select(*rest, "_r.*")


def probe_plan(locations: DataFrame, within: Sequence[str], limit: int) -> DataFrame:
    """Locations in probing order with their status: probe, skipped_limit, skipped_pdf or skipped_kind."""
    kind, content, url = F.col("kind"), F.coalesce("content_type", F.lit("")) if "content_type" in locations.columns else F.lit(""), F.col("url")
    rows = locations.withColumns({"fits": urls.probes_for_html(kind, content, url), "rank": urls.probe_rank(kind, content, url), "is_pdf": urls.is_pdf_location(kind, content, url)})
    order = Window.partitionBy(*within).orderBy("rank", "ordinal")
    place = F.sum(F.col("fits").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    status = F.when(~F.col("fits"), F.when(F.col("is_pdf"), "skipped_pdf").otherwise("skipped_kind"))
    status = status.when(F.lit(limit > 0) & (place > limit), "skipped_limit").otherwise("probe")
    return rows.withColumns({"place": F.row_number().over(order), "status": status}).drop("fits", "rank", "is_pdf")


def pdf_locations(discovered: DataFrame, derived: DataFrame, item: str) -> DataFrame:
    """Locations of an item and those derived from its pages behind them, the first of each kind and URL.

    Both hold item, ordinal, source, url and kind; blank URLs are left out.
    """
    columns = [item, "ordinal", "source", "url", "kind"]
    both = discovered.select(*columns, F.lit(0).alias("_from")).unionByName(derived.select(*columns, F.lit(1).alias("_from")))
    order = Window.partitionBy(item, F.lower("kind"), F.trim("url")).orderBy("_from", "ordinal")
    rows = both.filter(F.trim("url") != "").withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(item).orderBy("_from", "ordinal", "url"))).select(columns)


def browser_fallbacks(locations: DataFrame, complete: DataFrame, item: str, domain: str) -> DataFrame:
    """Locations of one sharing site that only a browser can read, for items without a PDF, the first of each URL.

    `complete` holds the items that have a PDF already or got one.
    """
    own = locations.filter(urls.in_domain(F.col("url"), domain) & (F.trim("url") != "")).join(complete.select(item).distinct(), item, "left_anti")
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy(item, F.trim("url")).orderBy("ordinal"))).filter("_n = 1")
    kind = F.coalesce(F.nullif(F.trim("kind"), F.lit("")), F.lit("landing"))
    return first.select(item, "ordinal", F.trim("url").alias("url"), kind.alias("kind"), F.lit("browser_pdf_fallback_available").alias("status"))


def landing_preprints(downloads: DataFrame, item: str) -> DataFrame:
    """(item, preprint_id) of the preprints whose abstract pages an item's downloads hit, each once but for case."""
    pages = downloads.select(item, "ordinal", F.explode(F.array_compact(F.array("url", "final_url"))).alias("u")).filter(urls.is_preprint_landing(F.col("u")))
    found = pages.select(item, "ordinal", urls.preprint_id(F.col("u")).alias("preprint_id")).filter("preprint_id <> ''")
    return found.groupBy(item, F.lower("preprint_id").alias("_key")).agg(F.min_by("preprint_id", "ordinal").alias("preprint_id")).drop("_key")


def lookup_text(fields: Column, tags: Column, *more: Column) -> Column:
    """All that is known of an item as one text: its field values, tags and further texts, a line each."""
    some = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.array_join(F.concat(some(F.map_values(fields)), some(tags), some(F.array(*more) if more else F.array().cast("array<string>"))), "\n")


def lookup_title(title: Column, filename: Column) -> Column:
    """The title to look an item up by: its own, else its file's name without the suffix."""
    stem = F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(normalize_space(title), F.lit("")), normalize_space(stem))


def queue_key(version: str, providers: Sequence[str], settings: dict[str, object]) -> str:
    """The key of a queue's settings: jobs made under other settings are other jobs."""
    shown = lambda v: str(int(v)) if isinstance(v, bool) else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "|".join([f"v={version}", f"providers={','.join(providers)}", *(f"{k}={shown(v)}" for k, v in settings.items())])


def by_identifier(items: DataFrame, payloads: DataFrame, item: str, least_score: float = 0.0) -> DataFrame:
    """The best candidate of each item among provider answers: those found by identifier before those by title.

    `payloads` holds item, ordinal, by_title, and the candidate's source, identifier, score and fields; an
    answer by title counts from a score on, and only where no identifier found any.
    """
    fits = payloads.filter(~F.col("by_title") | (F.col("score") >= least_score))
    order = Window.partitionBy(item).orderBy("by_title", F.col("score").desc(), "ordinal")
    chosen = fits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "by_title")
    return items.join(chosen, item, "left")
