"""Scalar functions on small literals: identifiers, titles, types, URLs, provider payloads, pages."""

import difflib
import json

import pytest
from pyspark.sql import functions as F

from quillstream.functions import documents, html, identifiers, media_types, providers, text, urls


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_identifiers_of_one_text(spark):
    raw = "https://doi.org/10.1101/2020.01.01.123v2\nhttps://arxiv.org/abs/hep-th/9901001v3\nPMID: 0012345\nPMC1234567\nISBN 978-0-306-40615-7"
    got = one(spark, identifiers.extract_all(F.lit(raw)))
    assert got.asDict() == {"doi": "10.1101/2020.01.01.123v2", "arxiv_id": "hep-th/9901001", "pmid": "12345", "pmcid": "PMC1234567", "isbn": "9780306406157"}
    assert set(one(spark, identifiers.extract_all(F.lit("nothing here"))).asDict().values()) == {None}
    assert one(spark, identifiers.normalize_pmid(F.lit("0000"))) == "" and one(spark, identifiers.normalize_isbn(F.lit("080442957x"))) == "080442957X"
    assert one(spark, identifiers.doi_url(F.lit("ftp://x"), F.lit("doi:10.1/ab."))) == "https://doi.org/10.1/ab"


def score(a, b):
    x, y = set(a.split()), set(b.split())
    return round(0.65 * difflib.SequenceMatcher(None, a, b).ratio() + 0.35 * len(x & y) / len(x | y), 4)


@pytest.mark.parametrize("a,b", [("same title", "SAME  Title"), ("", "x"), ("one two three", "four five"), ("deep learning for graphs", "graphs and deep learning"), ("abc " * 60, "abc abd " * 40), ("x y", "abcd " * 50)])
def test_title_scores(spark, a, b):
    got = one(spark, text.title_match_score(F.lit(a), F.lit(b)))
    na, nb = " ".join(a.lower().split()), " ".join(b.lower().split())
    assert got == (0.0 if not na or not nb else score(na, nb))


def test_text_functions(spark):
    assert one(spark, text.normalize_space(F.lit(" a&nbsp; &amp;  b\n"))) == "a & b"
    assert one(spark, text.merge_extra(F.lit("a\nB"), F.lit("b\nc"))) == "a\nB\nc"
    assert one(spark, text.fold_distinct(F.array(*map(F.lit, ("A", "b", "a", "B", "c"))))) == ["A", "b", "c"]
    assert one(spark, text.split_identifiers(F.lit(" a ;;b\n c"))) == ["a", "b", "c"]
    assert one(spark, text.join_values(F.array(F.lit(" a"), F.lit(" "), F.lit("b")))) == "a, b"
    assert one(spark, text.safe_part(F.lit("..a b/ü..c.."))) == "a_b_..c"


@pytest.mark.parametrize(
    "mime,path,pdf,web",
    [("application/pdf", "a.html", True, False), ("text/html; charset=x", "a.pdf", False, True), (None, "storage:a.PDF?x#y", True, False), (None, "paper.pdf.html", False, True), ("", "x.mht", False, True), (None, ".pdf", False, False), (None, None, False, False)],
)
def test_media_types(spark, mime, path, pdf, web):
    none = F.lit(None).cast("string")
    m, p = F.lit(mime).cast("string"), F.lit(path).cast("string")
    assert (one(spark, media_types.is_pdf(m, p, none)), one(spark, media_types.is_html(m, p, none))) == (pdf, web)


def test_source_markers(spark):
    got = {n: (one(spark, media_types.is_source_html(F.lit(n))), one(spark, media_types.is_generated_html(F.lit(n)))) for n in ("a.html", "a [ZH HTML].html", "a [RU HTML].html", "a [ARXIV HTML].html", "x [source html].html")}
    assert got == {"a.html": (False, False), "a [ZH HTML].html": (True, True), "a [RU HTML].html": (False, True), "a [ARXIV HTML].html": (False, False), "x [source html].html": (True, False)}


def test_urls(spark):
    full = lambda u: one(spark, urls.is_full_article_url(F.lit(u)))
    assert full("https://pmc.ncbi.nlm.nih.gov/articles/PMC1/") and full("https://j.org/index.php/j/article/view/12") and full("https://www.frontiersin.org/a/full")
    assert not full("https://j.org/article/download/12") and not full("https://link.springer.com/chapter/1")
    assert one(spark, urls.normalized_probe_url(F.lit("HTTPS://Ex.ORG/A;p?q=1#f"))) == "https://ex.org/A?q=1"
    assert one(spark, urls.preprint_id(F.lit("https://arxiv.org/abs/2101.00001v4"))) == "2101.00001" and one(spark, urls.preprint_id(F.lit("https://x.org/abs/1"))) == ""
    assert one(spark, urls.is_pdf_url(F.lit("https://x.org/pdf/1"))) and not one(spark, urls.is_pdf_url(F.lit("https://x.org/pdfs")))
    assert one(spark, urls.redacted(F.lit("https://u:p@x.org/a?k=1#f"))) == "https://x.org/a?[redacted]"
    assert one(spark, urls.profile(F.lit("doaj"), F.lit("https://x.org"))) == "repository"


def test_verdict_ladder(spark):
    body = "word " * 2000
    pages = {
        "challenge_page": "<title>Just a moment</title>", "short_text": "<article>abstract</article>", "article_structure_missing": f"<p>{body}</p>",
        "article_body_missing": f"<article>{body}</article>", "article_html": f"<article>{body} references</article>", "limited_access_preview": f"<article>{body} This is a preview of subscription content</article>",
    }
    df = html.with_features(spark.createDataFrame([(k, v) for k, v in pages.items()], "want string, html string"))
    rows = df.select("want", html.article_reason(F.lit(True), F.lit("generic")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)


def provided(spark, provider, payload):
    return providers.with_candidate(spark.createDataFrame([(json.dumps(payload),)], "p string"), provider, "p").first()["candidate"]


def test_provider_payloads(spark):
    work = {"DOI": "https://doi.org/10.1/X.", "title": [" ", "A  title"], "URL": "https://x.org/a", "published-online": {"date-parts": [[2020, 3]]}, "issued": {"date-parts": [[2019]]}, "ISSN": ["1", "2"], "abstract": "<p>t</p>", "link": [{"URL": "https://x.org/a.pdf"}, {"URL": "https://x.org/a.pdf"}, {"URL": "https://x.org/a"}]}
    got = provided(spark, "crossref", work)
    assert got["identifier"] == "10.1/X" and got["score"] == 1.0 and got["fields"]["date"] == "2020-03" and got["fields"]["ISSN"] == "1, 2" and got["fields"]["abstractNote"] == "t" and "volume" not in got["fields"]
    assert [(x["url"], x["kind"]) for x in got["locations"]] == [("https://x.org/a.pdf", "pdf"), ("https://x.org/a", "landing")]
    assert all(provided(spark, name, {}) is None for name in providers.MAPPERS)
    alex = {"display_name": "T", "abstract_inverted_index": {"b": [1, 3], "a": [0, 2]}, "biblio": {"first_page": "1", "last_page": "9"}, "publication_year": 2001}
    got = provided(spark, "openalex", alex)
    assert got["fields"]["abstractNote"] == "a b a b" and got["fields"]["pages"] == "1-9" and got["fields"]["date"] == "2001" and got["identifier"] == "T"
    assert provided(spark, "unpaywall", {"title": "T"})["score"] == 0.85
    got = provided(spark, "unpaywall", {"doi": "10.1/a", "best_oa_location": {"url": "u", "url_for_pdf": "p"}, "oa_locations": [{"url": "u"}, {"url": "v"}]})
    assert [(x["url"], x["kind"]) for x in got["locations"]] == [("p", "pdf"), ("u", "landing"), ("v", "landing")] and got["score"] == 1.0
    got = provided(spark, "europe_pmc", {"title": "T", "pmcid": "PMC12345", "pmid": "0777", "fullTextUrlList": {"fullTextUrl": [{"url": "z", "documentStyle": "PDF"}]}})
    assert [x["kind"] for x in got["locations"]] == ["html", "xml", "landing", "pdf"] and got["identifier"] == "777"
    got = provided(spark, "datacite", {"id": "10.5/d", "attributes": {"titles": [{"title": "D"}], "descriptions": [{"description": "m", "descriptionType": "Methods"}, {"description": "a", "descriptionType": "Abstract"}], "contentUrl": ["f.pdf"]}})
    assert got["fields"]["abstractNote"] == "a" and got["identifier"] == "10.5/d" and got["locations"][0]["kind"] == "pdf"
    got = provided(spark, "biorxiv", {"doi": "10.1101/1", "title": "B", "server": "medrxiv", "published": "10.9/p"})
    assert got["source"] == "medrxiv" and got["fields"]["extra"] == "Published DOI: 10.9/p" and got["locations"][1]["url"] == "https://www.medrxiv.org/content/10.1101/1.full.pdf"
    got = provided(spark, "semantic_scholar", {"title": "S", "externalIds": {"PubMed": "12"}, "venue": "V", "openAccessPdf": {"url": "p"}})
    assert got["fields"]["publicationTitle"] == "V" and got["fields"]["PMID"] == "12" and got["locations"][0]["kind"] == "pdf"
    got = provided(spark, "doaj", {"title": "J", "identifier": [{"type": "eissn", "id": "1"}, {"type": "DOI", "id": "10.1/j"}], "link": [{"url": "https://x/a.html"}]})
    assert got["identifier"] == "10.1/j" and got["locations"][0]["kind"] == "html"
    assert provided(spark, "core", {"title": "C", "sourceFulltextUrls": ["https://x/a.pdf"]})["fields"]["url"] == "https://x/a.pdf"
    got = provided(spark, "translator", {"title": "Z", "extra": "arXiv:2101.00001v2 PMID: 12345", "url": "https://x.org/1", "attachments": [{"url": "ftp://x"}, {"url": "https://x.org/1.pdf"}]})
    assert got["fields"]["archiveLocation"] == "2101.00001" and got["fields"]["PMID"] == "12345" and [x["kind"] for x in got["locations"]] == ["landing", "pdf"]
    oa = {"response": {"results": {"result": {"metadata": {"oaf:entity": {"oaf:result": {"title": {"$": "O"}, "pid": [{"$": "10.1/o"}], "publisher": {"$": "P"}}}}}}}}
    got = one(spark, providers.openaire(F.lit(json.dumps(oa))))
    assert got["identifier"] == "10.1/o" and got["fields"]["title"] == "O" and got["fields"]["publisher"] == "P"
    article = """<PubmedArticle><MedlineCitation><PMID>00123</PMID><Article><Journal><Title>J</Title><JournalIssue><Volume>2</Volume><PubDate><MedlineDate>1999 Spring</MedlineDate></PubDate></JournalIssue></Journal>
    <ArticleTitle>A title</ArticleTitle><Abstract><AbstractText Label="AIM">one</AbstractText><AbstractText Label="END">two</AbstractText></Abstract><AuthorList><Author><LastName>L</LastName><Initials>I</Initials></Author></AuthorList></Article></MedlineCitation>
    <PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/p</ArticleId><ArticleId IdType="pmc">PMC98765</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""
    got = one(spark, providers.pubmed(F.lit(article)))
    assert got["identifier"] == "123" and got["fields"]["date"] == "1999" and got["fields"]["PMCID"] == "PMC98765" and got["fields"]["abstractNote"] == "AIM: one END: two" and got["fields"]["DOI"] == "10.1/p"
    assert one(spark, providers.pubmed_authors(F.lit(article)))[0]["lastName"] == "L"
    feed = '<feed><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>A b</title><summary>s</summary><published>2021-01-01T00:00:00Z</published></entry></feed>'
    (entry,) = one(spark, providers.atom_entries(F.lit(feed)))
    assert entry["identifier"] == "2101.00001" and entry["fields"]["date"] == "2021-01-01"
    assert [one(spark, providers.month_number(F.lit(m))) for m in ("January", "sep", "7", "13", "")] == ["01", "09", "07", "", ""]
    assert one(spark, providers.partial_date(F.lit("2020"), F.lit(""), F.lit("5"))) == "2020"


PAGE = """<html><head><title>T</title></head><body><nav>n</nav><article><h1>Head</h1><p onclick="x()">One <a href="#s1">ok</a> <a href="#gone">gone</a> <a href="https://x.org/p#s1">self</a> <a href="javascript:x">js</a></p>
<section id="s1"><img data-src="i.png"><img><table></table><figure></figure><video src="v.mp4"></video><script>x</script></section></article></body></html>"""


def test_polish_is_idempotent():
    once = documents.polish(PAGE, "https://x.org/p")
    assert once["title"] == "T" and once["selector"] == "article" and (once["links_rewritten"], once["links_disabled"]) == (1, 1)
    for gone in ("<script", "onclick", "javascript:", "<table", "<figure", "<nav", "<video"):
        assert gone not in once["html"]
    assert 'src="https://x.org/i.png"' in once["html"] and 'href="https://x.org/v.mp4"' in once["html"]
    assert documents.polish(once["html"], "https://x.org/p")["html"] == once["html"]


def test_audit(spark):
    m = documents.metrics(PAGE)
    assert m["dangling_fragments"] == 1 and m["images_without_source"] == 2 and m["tables_without_rows"] == 1 and m["empty_figures"] == 1 and m["scripts"] == 1
    row = documents.audit(spark.createDataFrame([(1, PAGE)], "page_id long, html string")).first()
    assert row["issues"] == ["unresolved_local_fragment_links", "image_missing_src", "script_tags_present", "table_without_rows", "short_text"] and row["warnings"] == ["figure_without_media_warning"]


def test_data_images():
    assert documents.decode_data_image("data:image/gif;base64,R0lGODlhAQABAAAAACw=")[0] == "image/gif"
    assert documents.decode_data_image("data:image/png;base64,R0lGODlh") is None and documents.decode_data_image("https://x") is None
