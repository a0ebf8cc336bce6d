"""Fetch policy, retry rules, identity checks, bounded queries and file names."""

import pytest
from pyspark.sql import functions as F

from quillstream.functions import html, results, safety
from quillstream.operators import inventory


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url,want",
    [("", "empty_url"), ("file:///etc", "blocked_scheme"), ("gopher://x", "blocked_scheme"), ("ws://x", "unsupported_scheme"), ("http:///a", "missing_host"), ("http://localhost/", "blocked_host"), ("http://a.localhost", "blocked_host"), ("http://127.0.0.1:8/", "blocked_ip"),
     ("http://[::1]/", "blocked_ip"), ("http://10.1.2.3", "blocked_ip"), ("http://169.254.1.1", "blocked_ip"), ("https://8.8.8.8/", "ok"), ("https://x.org", "ok")],
)
def test_url_verdicts(spark, url, want):
    assert one(spark, safety.url_verdict(F.lit(url))) == want


def test_request_ladder(spark):
    decide = lambda u, o, n: one(spark, safety.request_decision(F.lit(u), F.lit(o), F.lit(n), "r.net"))
    assert decide("http://r.net", "", True) == "https_required" and decide("https://u@r.net", "", True) == "credentials_forbidden" and decide("https://r.net:8443", "", True) == "nonstandard_port"
    assert decide("https://www.r.net/a", "", True) == "navigation" and decide("https://x.org", "https://r.net", True) == "cross_host_navigation_blocked"
    assert decide("https://c.r.net/i.png", "", False) == "own_subresource" and decide("https://x.org/i.png", "", False) == "external_subresource"


def test_retry_rules(spark):
    assert one(spark, safety.pdf_retryable(F.lit("http_error"), F.lit(503))) and not one(spark, safety.pdf_retryable(F.lit("http_error"), F.lit(404))) and not one(spark, safety.pdf_retryable(F.lit("too_large"), F.lit(None).cast("int")))
    assert not one(spark, safety.browser_retryable(F.lit(" item_not_found "))) and one(spark, safety.browser_retryable(F.lit(None).cast("string")))
    assert one(spark, safety.is_final_error(F.lit("no API_KEY set"), ["API_KEY"])) and one(spark, safety.blocked_reason(F.lit(403), F.lit("Just a moment"))) == "metadata_provider_blocked"
    now = F.lit("2020-01-01 00:00:00").cast("timestamp")
    assert [one(spark, safety.retry_seconds(F.lit(v), now)) for v in ("12", "Wed, 01 Jan 2020 00:01:00 GMT", "-5", "soon", "")] == [12.0, 60.0, 0.0, None, None]


def test_assets(spark):
    assert one(spark, F.array(*[safety.asset_rank(F.lit(u)) for u in ("https://x/fig1.png", "https://x/a.png", "https://x/a.css", "https://x/a.js", "https://x/logo.svg")])) == [0, 1, 2, 3, 4]
    attrs = lambda **k: F.create_map(*[F.lit(x) for p in (k or {"a": "b"}).items() for x in p])
    assert one(spark, safety.wanted_image(F.lit("https://x/f1.png"), attrs())) and not one(spark, safety.wanted_image(F.lit("https://x/site-logo.png"), attrs())) and not one(spark, safety.wanted_image(F.lit("https://x/f.png"), attrs(width="16px")))


def test_pdf_identity(spark):
    text = "Graph learning for molecular energy prediction " + "body " * 50
    judge = lambda t, x: one(spark, safety.pdf_identity(F.lit(t), F.lit(x).cast("string")))
    assert [judge("", text), judge("t", None), judge("t", "short"), judge("Graph learning for molecular energy", text), judge("Entirely different subject matter", text)] == ["no_expected_title", "pdf_text_unavailable", "no_text_layer", "title_match", "title_mismatch"]
    assert one(spark, safety.is_pdf_response(F.lit("u"), F.lit("x/y"), F.lit(bytearray(b"%PDF-1"))))


def test_bounded_queries(spark):
    rows = [("doi", "10.1/a b"), ("DOI", "10.1/A B"), ("isbn", "x" * 50), ("pmid", "12")]
    array = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in rows])
    assert one(spark, safety.bounded_query(array, 40)) == "doi:10.1%2Fa%20b,pmid:12" and one(spark, safety.bounded_query(array, 40, 1)) == "doi:10.1%2Fa%20b"


def test_file_names(spark):
    assert [one(spark, safety.safe_filename(F.lit(v), most=12)) for v in ('a/b:"c" . ', "CON.txt", "", "x" * 20)] == ["a b c", "_CON.txt", "document", "x" * 12]


def test_payload_status(spark):
    status = lambda h, r, p, o, e, b: one(spark, safety.payload_status(*[F.lit(x) for x in (h, r, p)], F.lit(o), F.lit(e), F.lit(b), F.lit("")))
    assert [status(1, 0, 1, True, "", 0), status(1, 0, 0, False, "", 0), status(0, 0, 1, False, "", 0), status(0, 1, 0, False, "queued", 1), status(0, 1, 0, False, "", 1), status(0, 1, 0, False, "", 0), status(0, 0, 0, False, "", 0)] == [
        "html_and_pdf_found_needs_ocr", "html_found", "pdf_found", "queued", "browser_pdf_fallback_available", "html_rejected", "unresolved",
    ]


def test_pages_and_json(spark):
    page = '<meta name="citation_pdf_url" content="/a.pdf"><meta name="citation_pdf_url" content="/supplement-1.pdf"><meta name="citation_pdf_url" content="https://y.org/b.pdf">'
    df = spark.createDataFrame([(1, page, "https://x.org/p")], "id int, html string, url string")
    assert df.select(html.citation_pdf_urls(F.col("html"), F.col("url"))).first()[0] == ["https://x.org/a.pdf", "https://y.org/b.pdf"]
    got = spark.range(1).select(*results.project_json(F.lit('{"a": {"b": [1, "x"]}}'), {"x": "$.a.b[1]", "none": "$.q"})).first()
    assert (got["x"], got["none"]) == ("x", None)
    assert one(spark, results.patch_json(F.lit('{"a":"1","b":"2"}'), {"b": F.lit(3)})) == '{"a":"1","b":"3"}' and one(spark, results.patch_json(F.lit("x"), {"b": F.lit(3)})) is None


def test_unique_records(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", 3)], "n int, k string, v int")
    assert [tuple(r) for r in inventory.unique_records(df, ["k"], "n").orderBy("n").collect()] == [(0, "a", 3), (1, "b", 2)]
