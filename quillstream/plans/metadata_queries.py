"""Identifiers, titles, candidates, diffs and locations, over text built from key columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers, providers, text, urls
from ..operators import candidates as cand
from ..sources.tables import load
from .registry import query

def k() -> Column:
    return F.col("p_partkey")


def _s(c: Column) -> Column:
    return c.cast("string")


def identifier_text() -> Column:
    """A text that names identifiers of all kinds, by key."""
    return F.concat(
        F.lit("See doi: https://doi.org/10."), _s(1000 + k() % 9000), F.lit("/x."), _s(k()), F.lit("). arXiv:"), _s(1000 + k() % 9000), F.lit("."), _s(10000 + k() % 90000), F.lit("v3; PMID: 00"), _s(100000 + k()),
        F.lit(", PMC"), _s(20000 + k()), F.lit(" ISBN: 978-0-"), _s(100000000 + k() % 899999999), F.when(k() % 3 == 0, "").otherwise(" end"),
    )


IDENTIFIER_TEXT = "'See doi: https://doi.org/10.' || (1000 + p_partkey % 9000) || '/x.' || p_partkey || '). arXiv:' || (1000 + p_partkey % 9000) || '.' || (10000 + p_partkey % 90000) || 'v3; PMID: 00' || (100000 + p_partkey) || ', PMC' || (20000 + p_partkey) || ' ISBN: 978-0-' || (100000000 + p_partkey % 899999999) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' end' END"


@query(
    "identifier_extract",
    f"""WITH t AS (SELECT p_partkey, {IDENTIFIER_TEXT} AS x FROM part)
        SELECT p_partkey, regexp_replace(regexp_extract(x, '(?i)\\b(10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+)\\b', 1), '[.,;:)\\]}}]+$', '') AS doi, regexp_extract(x, '(?i)\\barxiv\\s*:\\s*(\\d{{4}}\\.\\d{{4,5}})', 1) AS arxiv_id,
        ltrim(regexp_extract(x, '(?i)\\bPMID\\s*[:#]?\\s*(\\d{{5,10}})\\b', 1), '0') AS pmid, regexp_extract(x, '\\b(PMC\\d{{5,10}})\\b', 1) AS pmcid,
        regexp_replace(regexp_extract(x, 'ISBN: ([0-9-]+)', 1), '-', '', 'g') AS isbn FROM t""",
)
def identifier_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOI, preprint id, PMID, PMCID and ISBN of a free text."""
    return load(spark, sf_dir, "part").select("p_partkey", identifiers.extract_all(identifier_text()).alias("i")).select("p_partkey", "i.*")


@query(
    "identifier_candidates_ordered",
    f"""WITH t AS (SELECT p_partkey, {IDENTIFIER_TEXT} AS x FROM part), c AS (
        SELECT p_partkey, 0 AS pos, 'doi' AS kind, '10.' || (1000 + p_partkey % 9000) || '/x.' || p_partkey AS value FROM t UNION ALL SELECT p_partkey, 1, 'arxiv', (1000 + p_partkey % 9000) || '.' || (10000 + p_partkey % 90000) FROM t
        UNION ALL SELECT p_partkey, 2, 'pmid', CAST(100000 + p_partkey AS VARCHAR) FROM t) SELECT * FROM c""",
)
def identifier_candidates_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed identifiers in their order, at most three."""
    return load(spark, sf_dir, "part").select("p_partkey", F.posexplode(identifiers.ordered_candidates(identifier_text(), 3)).alias("pos", "c")).select("p_partkey", "pos", "c.kind", "c.value")


@query(
    "identifier_normal_forms",
    """SELECT p_partkey, '10.1000/ab' || p_partkey AS doi, (1000 + p_partkey % 9000) || '.01234' AS arxiv_id, CASE WHEN p_partkey = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS pmid, 'PMC' || (10000 + p_partkey) AS pmcid,
       CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '12345' || (1000 + p_partkey % 9000) || 'X' END AS isbn FROM part""",
)
def identifier_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of identifiers written in several ways."""
    return load(spark, sf_dir, "part").select(
        "p_partkey", identifiers.normalize_doi(F.concat(F.lit(" https://dx.doi.org/10.1000/ab"), _s(k()), F.lit(".),"))).alias("doi"), identifiers.normalize_arxiv_id(F.concat(F.lit("arXiv: "), _s(1000 + k() % 9000), F.lit(".01234v12"))).alias("arxiv_id"),
        identifiers.normalize_pmid(F.concat(F.lit("PMID: 000"), _s(k()), F.lit("."))).alias("pmid"), identifiers.normalize_pmcid(F.concat(F.lit("pmc "), _s(10000 + k()))).alias("pmcid"),
        identifiers.normalize_isbn(F.when(k() % 2 == 0, "ISBN 12-34").otherwise(F.concat(F.lit("ISBN-10: 12345-"), _s(1000 + k() % 9000), F.lit("-x")))).alias("isbn"),
    )


def part_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three candidates for each part, from providers of unlike trust, some fields blank."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"), F.lit(source).alias("source"), (((k() * (i + 3)) % 4) / 4.0).alias("score"), F.concat(F.lit(f"{source}:"), _s(k())).alias("identifier"),
                F.create_map(
                    F.lit("title"), F.when(k() % (i + 2) == 0, "  ").otherwise(F.concat(F.col("p_name"), F.lit(f" &amp;&nbsp; {i}&#8211;"))), F.lit("volume"), _s(k() % 10 + i), F.lit(f"only{i}"), F.lit("x"),
                ).alias("fields"),
            )
            for i, source in enumerate(("crossref", "pubmed", "biorxiv"))
        ]
    )
    return load(spark, sf_dir, "part").select("p_partkey", F.explode(rows).alias("c")).select("p_partkey", "c.*")


CANDIDATES = """
WITH c AS (
  SELECT p_partkey, i.ordinal, i.source, i.priority, ((p_partkey * (i.ordinal + 3)) % 4) / 4.0 AS score, i.source || ':' || p_partkey AS identifier,
         CASE WHEN p_partkey % (i.ordinal + 2) = 0 THEN '' ELSE p_name || ' & ' || i.ordinal || '–' END AS title, CAST(p_partkey % 10 + i.ordinal AS VARCHAR) AS volume
  FROM part, (VALUES (0, 'crossref', 85), (1, 'pubmed', 95), (2, 'biorxiv', 0)) i(ordinal, source, priority)
)
"""


@query("best_candidate", CANDIDATES + "SELECT p_partkey, source, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, ordinal) AS rn FROM c) WHERE rn = 1")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest score of each item; the first of equals."""
    return cand.best(part_candidates(spark, sf_dir), "p_partkey").select("p_partkey", "source", "score")


@query(
    "candidate_merge_fields",
    CANDIDATES
    + """, f AS (SELECT p_partkey, ordinal, source, priority, score, 'title' AS field, title AS value FROM c UNION ALL SELECT p_partkey, ordinal, source, priority, score, 'volume', volume FROM c
         UNION ALL SELECT p_partkey, ordinal, source, priority, score, 'only' || ordinal, 'x' FROM c)
       SELECT p_partkey, field, value, source FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, field ORDER BY score DESC, priority DESC, ordinal) AS rn FROM f WHERE value <> '') WHERE rn = 1""",
)
def candidate_merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field from the best candidate that has it."""
    merged = cand.merge(part_candidates(spark, sf_dir), "p_partkey")
    return merged.select("p_partkey", F.explode("fields").alias("field", "value"), "provenance").select("p_partkey", "field", "value", F.element_at("provenance", F.col("field")).alias("source"))


@query(
    "candidate_merge_identity",
    CANDIDATES
    + """, t AS (SELECT p_partkey, title FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, priority DESC, ordinal) AS rn FROM c WHERE title <> '') WHERE rn = 1),
       o AS (SELECT p_partkey, identifier, score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, priority DESC, ordinal) AS rn FROM c) WHERE rn = 1)
       SELECT o.p_partkey, coalesce(t.title, o.identifier) AS identifier, CAST(o.score AS DOUBLE) AS score FROM o LEFT JOIN t USING (p_partkey)""",
)
def candidate_merge_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier and score of the merged candidate."""
    return cand.merge(part_candidates(spark, sf_dir), "p_partkey").select("p_partkey", "identifier", "score")


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidate = F.create_map(F.lit("title"), F.concat(F.col("p_name"), F.lit(" &lt;&#xe9;&gt;  x&ampy")), F.lit("volume"), _s(F.col("p_size")), F.lit("issue"), F.when(k() % 2 == 0, " ").otherwise("7"), F.lit("secret"), F.lit("s"))
    current = F.create_map(F.lit("title"), F.when(k() % 3 == 0, "").otherwise(F.col("p_name")), F.lit("volume"), F.when(k() % 5 == 0, _s(F.col("p_size"))).otherwise(""))
    return load(spark, sf_dir, "part").select("p_partkey", "p_type", candidate.alias("candidate"), current.alias("current"))


DIFF = """
WITH d AS (SELECT p_partkey, f.field, CASE f.field WHEN 'title' THEN CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END WHEN 'volume' THEN CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END ELSE '' END AS current_text,
  CASE f.field WHEN 'title' THEN p_name || ' <é> x&y' WHEN 'volume' THEN CAST(p_size AS VARCHAR) WHEN 'issue' THEN CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '7' END ELSE 's' END AS candidate_text
  FROM part, (VALUES ('title'), ('volume'), ('issue'), ('secret')) f(field))
"""


def _verdict(policy: str) -> str:
    skip = "WHEN current_text <> '' THEN 'current_field_not_empty' " if policy == "emptyFieldsOnly" else ""
    return DIFF + f"SELECT *, CASE WHEN field = 'secret' THEN 'field_not_allowed_by_relay' WHEN candidate_text = '' THEN 'candidate_empty' {skip}WHEN current_text = candidate_text THEN 'unchanged' ELSE 'patch' END AS verdict FROM d"


@query("metadata_diff_patch", _verdict("emptyFieldsOnly"))
def metadata_diff_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field by field: patched, or why not, where only empty fields are filled."""
    return cand.diff(part_pairs(spark, sf_dir), "p_partkey")


@query("metadata_diff_overwrite", _verdict("allowOverwrite"))
def metadata_diff_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where fields may be overwritten."""
    return cand.diff(part_pairs(spark, sf_dir), "p_partkey", policy="allowOverwrite")


@query("metadata_patch_applied", DIFF + "SELECT p_partkey, string_agg(field, ',' ORDER BY field) AS applied FROM d WHERE field <> 'secret' AND candidate_text <> '' AND current_text = '' GROUP BY 1")
def metadata_patch_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that the patch of each item applies."""
    return cand.patch(metadata_diff_patch(spark, sf_dir), "p_partkey").select("p_partkey", F.array_join("applied_fields", ",").alias("applied"))


@query(
    "item_type_field_filter",
    "WITH x AS (" + _verdict("emptyFieldsOnly") + """) SELECT x.p_partkey, x.field, x.verdict FROM x JOIN part p USING (p_partkey) WHERE NOT (p.p_size % 3 = 0 AND x.field = 'volume') AND NOT (p.p_size % 3 = 1 AND x.field = 'title')""",
)
def item_type_field_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences without fields that the item's type does not have."""
    pairs = part_pairs(spark, sf_dir)
    types = load(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(F.lit("preprint"), F.lit("webpage"), F.lit("other")), (F.col("p_size") % 3 + 1).cast("int")).alias("item_type"))
    rules = spark.createDataFrame([("preprint", "volume"), ("webpage", "title")], "item_type string, field string")
    found = cand.diff(pairs, "p_partkey").join(types, "p_partkey")
    return cand.drop_illegal(found, rules).select("p_partkey", "field", "verdict")


@query(
    "url_normalize_dedup",
    """WITH n AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) ||
         CASE WHEN regexp_extract(url, '[?]([^#]*)', 1) = '' THEN '' ELSE '?' || regexp_extract(url, '[?]([^#]*)', 1) END AS normal FROM pages)
       SELECT normal, page_id FROM (SELECT *, row_number() OVER (PARTITION BY normal ORDER BY page_id) AS rn FROM n) WHERE rn = 1""",
)
def url_normalize_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each normal URL."""
    pages = load(spark, sf_dir, "pages").select("page_id", urls.normalized_probe_url(F.col("url")).alias("normal"))
    return cand.first_by(pages, [F.col("normal")], ["page_id"]).select("normal", "page_id")


@query(
    "url_parts_and_profile",
    """SELECT page_id, split_part(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), ':', 1) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, CASE WHEN page_id % 2 = 0 THEN 'repository' ELSE 'generic' END AS profile,
       CASE WHEN regexp_extract(url, '[?]([^#]*)', 1) = '' THEN split_part(url, '#', 1) ELSE split_part(url, '?', 1) || '?[redacted]' END AS redacted FROM pages""",
)
def url_parts_and_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and host profile of each URL, and its form for logs."""
    u = F.col("url")
    return load(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.profile(F.when(F.col("page_id") % 2 == 0, "core").otherwise("web"), u).alias("profile"), urls.redacted(u).alias("redacted"))


def part_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations of parts: preprint landing pages, journal views, PDFs and plain pages."""
    u = (
        F.when(k() % 4 == 0, F.concat(F.lit("https://arxiv.org/abs/2101."), _s(10000 + k() % 90000), F.lit("v2"))).when(k() % 4 == 1, F.concat(F.lit("https://j.example.org/index.php/article/view/"), _s(k())))
        .when(k() % 4 == 2, F.concat(F.lit("https://x.example.org/"), _s(k()), F.lit(".pdf"))).otherwise(F.concat(F.lit("https://x.example.org/"), _s(k())))
    )
    return load(spark, sf_dir, "part").select("p_partkey", "p_brand", k().alias("ordinal"), F.lit("core").alias("source"), u.alias("url"), F.when(k() % 4 == 3, "html").otherwise("landing").alias("kind"))


@query(
    "alternate_locations_explode",
    """WITH p AS (SELECT p_partkey, p_partkey % 4 AS r, '2101.' || (10000 + p_partkey % 90000) AS pid FROM part)
       SELECT p_partkey, 0 AS sub, 'arxiv' AS source, 'https://arxiv.org/html/' || pid AS url, 'html' AS kind FROM p WHERE r = 0 UNION ALL SELECT p_partkey, 1, 'ar5iv', 'https://ar5iv.labs.arxiv.org/html/' || pid, 'html' FROM p WHERE r = 0
       UNION ALL SELECT p_partkey, 2, 'core', 'https://j.example.org/index.php/article/view/' || p_partkey, 'html' FROM p WHERE r = 1
       UNION ALL SELECT p_partkey, 3, 'core', CASE r WHEN 0 THEN 'https://arxiv.org/abs/' || pid || 'v2' WHEN 1 THEN 'https://j.example.org/index.php/article/view/' || p_partkey WHEN 2 THEN 'https://x.example.org/' || p_partkey || '.pdf' ELSE 'https://x.example.org/' || p_partkey END,
       CASE WHEN r = 3 THEN 'html' ELSE 'landing' END FROM p""",
)
def alternate_locations_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML pages that a location's URL lets derive, and the location itself."""
    return cand.expanded_locations(part_locations(spark, sf_dir)).select("p_partkey", "sub", "source", "url", "kind")


@query(
    "probe_priority_budget",
    """WITH p AS (SELECT p_partkey, p_brand, p_partkey % 4 AS r, CASE p_partkey % 4 WHEN 0 THEN 'https://arxiv.org/abs/2101.' || (10000 + p_partkey % 90000) || 'v2' WHEN 1 THEN 'https://j.example.org/index.php/article/view/' || p_partkey
         WHEN 2 THEN 'https://x.example.org/' || p_partkey || '.pdf' ELSE 'https://x.example.org/' || p_partkey END AS url FROM part),
       k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE r WHEN 2 THEN 3 WHEN 3 THEN 0 ELSE 1 END, CASE r WHEN 2 THEN 9 ELSE 2 END, CASE r WHEN 2 THEN 9 WHEN 3 THEN 0 ELSE 1 END, url, p_partkey) AS place FROM p),
       s AS (SELECT *, sum(CASE WHEN r <> 2 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY place) AS used FROM k)
       SELECT p_partkey, CAST(place AS INTEGER) AS place, CASE WHEN r = 2 THEN 'skipped_pdf' WHEN used > 5 THEN 'skipped_limit' ELSE 'probe' END AS status FROM s""",
)
def probe_priority_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations of each group in probing order, five attempts each."""
    return cand.probe_plan(part_locations(spark, sf_dir), ["p_brand"], 5).select("p_partkey", "place", "status")


@query(
    "location_dedup_ordinal",
    "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1",
)
def location_dedup_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first location of each key, by ordinal and not by arrival."""
    return cand.first_by(load(spark, sf_dir, "part"), [F.col("p_size")], ["p_partkey"], ["p_brand"]).select("p_brand", "p_partkey")


WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))"


@query(
    "token_jaccard",
    f"""WITH b AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark), d AS (SELECT doc_id, doc_id % 40 AS item_id, {WORDS.format("text")} AS w FROM documents)
        SELECT d.doc_id, b.item_id, round(len(list_intersect(b.w, d.w)) / CAST(len(list_distinct(list_concat(b.w, d.w))) AS DOUBLE), 6) AS jaccard FROM d JOIN b USING (item_id)""",
)
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of common words of each document and one benchmark item."""
    b = load(spark, sf_dir, "benchmark").select("item_id", text.normalize_title(F.col("text")).alias("b"))
    d = load(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).alias("item_id"), text.normalize_title(F.col("text")).alias("d"))
    return d.join(b, "item_id").select("doc_id", "item_id", F.round(text.token_jaccard(F.col("b"), F.col("d")), 6).alias("jaccard"))


@query(
    "token_overlap_score",
    f"""WITH b AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark)
        SELECT a.item_id AS a, c.item_id AS b, CAST(floor(len(list_intersect(a.w, c.w)) * 500 / greatest(len(a.w), len(c.w))) AS INTEGER) AS score FROM b a JOIN b c ON a.item_id % 10 = c.item_id % 10 AND a.item_id < c.item_id""",
)
def token_overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap scores of item pairs within blocks."""
    words = F.array_distinct(F.filter(F.split(text.normalize_title(F.col("text")), " "), lambda w: w != ""))
    b = load(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 10).alias("block"), words.alias("w"))
    pairs = b.alias("a").join(b.alias("c"), "block").filter("a.item_id < c.item_id")
    return pairs.select(F.col("a.item_id").alias("a"), F.col("c.item_id").alias("b"), text.token_overlap_score(F.col("a.w"), F.col("c.w")).alias("score"))


@query("title_match_udf")
def title_match_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of a page's title and heading, and of its title and the next item's text."""
    from ..functions.html import page_title

    pages = load(spark, sf_dir, "pages").select("page_id", page_title(F.col("html")).alias("title"), text.strip_tags(F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("heading"))
    return pages.select("page_id", text.title_match_score(F.col("title"), F.col("heading")).alias("score"), text.title_match_score(F.col("heading"), F.concat(F.col("title"), F.lit(" and more"))).alias("longer"))


@query(
    "title_tokens",
    """WITH t AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '([a-z0-9][a-z0-9-]{3,})', 1), lambda x: x NOT IN ('with', 'from', 'into', 'that', 'this', 'using', 'through', 'towards', 'between', 'article')) AS w FROM benchmark),
       e AS (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM t), f AS (SELECT item_id, token, min(pos) AS pos FROM e GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS rn FROM f) SELECT item_id, string_agg(token, ' ' ORDER BY pos) AS tokens FROM r WHERE rn <= 10 GROUP BY 1""",
)
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significant tokens of titles."""
    rows = load(spark, sf_dir, "benchmark").select("item_id", text.title_tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    return rows.select("item_id", F.array_join("t", " ").alias("tokens"))


@query(
    "inverted_index_abstract",
    r"""SELECT doc_id, trim(regexp_replace(text, '[ \x09-\x0D]+', ' ', 'g')) AS abstract FROM documents WHERE regexp_matches(text, '[^ \x09-\x0D]')""",
)
def inverted_index_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to inverted indexes (word to places) and back; texts without words have no index."""
    d = load(spark, sf_dir, "documents")
    words = d.select("doc_id", F.posexplode(F.filter(F.split("text", r"[ \x09-\x0D]+"), lambda w: w != "")).alias("p", "w"))
    index = words.groupBy("doc_id", "w").agg(F.array_sort(F.collect_list("p")).alias("places")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "places"))).alias("index"))
    return index.select("doc_id", providers.inverted_text(F.col("index")).alias("abstract"))


@query(
    "provider_json_mapping",
    """SELECT p_partkey, '10.1234/' || p_partkey AS identifier, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN '20' || (10 + p_size % 80) || '-0' || (1 + p_size % 9) ELSE '20' || (10 + p_size % 80) END AS date,
       CAST(p_size AS VARCHAR) AS volume, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS n_locations, CASE WHEN p_partkey % 2 = 0 THEN 'pdf' ELSE 'landing' END AS first_kind FROM part""",
)
def provider_json_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry payloads as candidates."""
    year, even = _s(2010 + F.col("p_size") % 80), k() % 2 == 0
    parts = F.when(even, F.array(F.array((2010 + F.col("p_size") % 80).cast("int"), (1 + F.col("p_size") % 9).cast("int")))).otherwise(F.array(F.array((2010 + F.col("p_size") % 80).cast("int"))))
    link = F.when(even, F.array(F.struct(F.concat(F.lit("https://x.org/"), _s(k()), F.lit(".pdf")).alias("URL"))))
    work = F.struct(
        F.concat(F.lit("10.1234/"), _s(k())).alias("DOI"), F.array(F.col("p_name")).alias("title"), F.concat(F.lit("https://x.org/"), _s(k())).alias("URL"), _s(F.col("p_size")).alias("volume"),
        F.struct(parts.alias("date-parts")).alias("issued"), link.alias("link"), year.alias("ignored"),
    )
    c = providers.with_candidate(load(spark, sf_dir, "part").select("p_partkey", F.to_json(work).alias("payload")), "crossref", "payload", "c")
    field = lambda f: F.element_at("c.fields", f)
    return c.select("p_partkey", "c.identifier", field("title").alias("title"), field("date").alias("date"), field("volume").alias("volume"), F.size("c.locations").alias("n_locations"), F.get("c.locations", F.lit(0))["kind"].alias("first_kind"))


@query(
    "event_props_mapping",
    "SELECT event_id, json_extract_string(props, '$.' || (json_keys(props)[1])) AS first_value FROM events",
)
def event_props_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value of a JSON object whose keys are not known beforehand."""
    e = load(spark, sf_dir, "events")
    return e.select("event_id", F.get(F.map_values(F.from_json("props", "map<string,string>")), F.lit(0)).alias("first_value"))


@query(
    "partial_date_format",
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders",
)
def partial_date_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of which only the year, or year and month, are known."""
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select("o_orderkey", providers.partial_date(_s(F.year(d)), F.when(k > 0, _s(F.month(d))), F.when(k > 1, _s(F.dayofmonth(d)))).alias("date"))
