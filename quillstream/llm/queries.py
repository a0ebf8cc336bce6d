"""The registered queries opN_<name>: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(function):
    QUERIES[function.__name__] = function
    return function


def model_file() -> str:
    """The vocabulary file of the public 32k piece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@register
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the 32k piece model."""
    from .sentencepiece_bpe import encode_texts

    return encode_texts(load(spark, sf_dir, "documents"), model_file(), with_ids=False)


@register
def op5_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a mix of all sources takes."""
    from .cube_mixing import mix

    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def url_rules():
    """The rules of op7, in the order in which they are given."""
    from .url_automaton import Rule

    return [
        Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
        Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
    ]


@register
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    from .url_automaton import filter_urls

    return filter_urls(load(spark, sf_dir, "pages"), url_rules())


ORACLES["op7_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, rest,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), fits AS (
  SELECT page_id, host, path,
         CASE WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM fits
"""


@register
def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page into archives, read them back with the salvage reader."""
    from . import common
    from .warc import read_warc, resolve_revisits, write_warc

    path = common.new_path(spark, "warc")
    write_warc(load(spark, sf_dir, "pages"), path)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(-?\d*)$", 1), F.lit("")).cast("long")
    found = read_warc(spark, path, with_payload=False).filter("kind = 'record'")
    records = resolve_revisits(common.written(found.drop("headers"), "warc-records"))
    return records.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )


ORACLES["op1_warc_salvage"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM k
"""


@register
def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .html_blocks import extract_text

    return extract_text(load(spark, sf_dir, "pages"))


@register
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    from .language_spans import held_out, identify, train

    docs = load(spark, sf_dir, "documents")
    found = identify(docs, train(docs.filter(~held_out())), with_spans=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@register
def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in the place of personal data."""
    from .surrogates import replace_entities

    return replace_entities(load(spark, sf_dir, "documents"))


@register
def op3_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, five words and similarity 0.75."""
    from .odd_sketch import near_duplicates

    return near_duplicates(load(spark, sf_dir, "documents"))


@register
def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every document and of its edited text."""
    from .imatch import edited_fingerprints

    return edited_fingerprints(load(spark, sf_dir, "documents"))


@register
def op9_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings at a cosine of 0.95."""
    from .rp_forest import near_vectors

    return near_vectors(load(spark, sf_dir, "embeddings"))
