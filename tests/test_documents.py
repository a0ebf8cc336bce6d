"""Publisher handlers, the canonical contract, result summaries and figure matching."""

import json

import pytest
from pyspark.sql import functions as F

from quillstream.functions import kinds, publishers, results
from quillstream.operators import figures


def test_float_and_data_targets():
    ids = {"Fig2", "tab1", "CIT0001-wrapper"}
    assert publishers.float_target("/articles/PMC1/figure/fig2/", ids) == "Fig2" and publishers.float_target("/a/table/T1", ids) == "tab1" and publishers.float_target("/a/figures", ids) is None
    assert publishers.data_target("#cit0001 x", ids) == "#CIT0001-wrapper" and publishers.data_target(" ", ids) == "#" and publishers.data_target("z", ids) == "#z"
    assert publishers.path_tokens("https://x.org/article/10.1/ABC") == {"abc", "10.1/abc"}


def test_publisher_pages():
    page = '<article><p><a href="https://link.springer.com/article/10.1/x#Sec1">s</a><a href="#Tab1">t</a></p><h2 id="Sec1">S</h2><div id="table-1" data-container-section="table"><b id="Tab1">T</b></div><div class="c-article-recommendations">r</div></article>'
    out = publishers.normalize(page, "springer_nature_article", "https://link.springer.com/article/10.1/x")
    assert 'href="#Sec1"' in out and 'href="#table-1"' in out and ">r<" not in out
    page = '<article><a data-rid="CIT1">1</a><p id="CIT1">ref</p></article>'
    assert 'href="#CIT1"' in publishers.normalize(page, "taylor_francis_article", "")
    page = '<meta name="citation_reference" content="citation_author=A B; citation_title=T; citation_author=C; citation_doi=10.1/z"><article><a href="#iopbib1">1</a></article>'
    assert "A B, C. T. 10.1/z" in publishers.normalize(page, "iop_article", "")
    out = publishers.normalize('<article><p style="color:#000000; margin:1px">x<span class="ltx_ERROR undefined">e</span></p></article>', "arxiv_latexml", "")
    assert "color" not in out and "ltx_ERROR" not in out


def test_page_kinds(spark):
    far = "x" * 600_000
    rows = [
        ("https://arxiv.org/abs/2101.00001v2", "", "arxiv_abs_page"), ("https://x", '<div class="ltx_page_main ltx_bibliography">', "arxiv_latexml"), ("https://arxiv.org/html/2101.00001", '<div class="ltx_page_main">', "arxiv_latexml"), ("https://x", '<div class="ltx_page_main">', "unknown"),
        ("https://pmc.ncbi.nlm.nih.gov/articles/1", "<article>", "pmc_article"), ("https://x", "<ARTICLE>", "generic_article"), ("https://x", "<p>", "unknown"), ("https://x", far + "hlfld-fulltext", "taylor_francis_article"), ("https://x", far + "<article>", "unknown"),
        ("https://x", "c-article-body" + far + "pmc-article", "springer_nature_article"), ("https://iopscience.iop.org/article/1/meta", "<article", "generic_article"), ("https://iopscience.iop.org/article/1", "", "iop_article"), (None, None, "unknown"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, url string, html string, kind string")
    got = [r[0] for r in df.orderBy("i").select(kinds.page_kind(F.col("html"), F.col("url"))).collect()]
    assert got == [r[2] for r in rows]


def test_contract():
    page = '<main id="web-doc"><section id="a"><figure id="f"></figure><a href="#a">x</a></section></main><main id="other" data-article-profile="x">y</main>'
    stamped = publishers.stamp(page, "source", "pmc")
    assert publishers.contract_report(stamped) == {"status": "passed", "failures": [], "warnings": []}
    assert publishers.contract_report(stamped.replace("#a", "#b"))["status"] == "warning"
    assert publishers.contract_report(page.replace('id="f"', 'id="a"'))["failures"] == ["profile_mismatch", "profile_version_mismatch", "document_kind_invalid", "provenance_missing", "duplicate_ids"]
    with pytest.raises(ValueError):
        publishers.stamp("<main>x</main>", "source", "pmc")


def test_results_are_bounded(spark):
    ref = {"classification": "downstream_orchestrator", "stage": "s", "ok": True, "noise": 1}
    big = json.dumps({"a": "x" * 100_000, "b": [1] * 100, "deep": {"1": {"2": {"3": {"4": 5}}}}, "r": ref})
    made = json.loads(results.compact(big))
    assert made["downstream_refs"] == [{"ok": True, "classification": "downstream_orchestrator", "stage": "s"}] and made["summary"]["a"]["chars"] == 100_000
    assert made["summary"]["b"][-1] == {"_omitted_items": 92} and made["summary"]["deep"]["1"]["2"]["3"] == {"_type": "dict", "items": 1}
    assert results.compact("{}") == "{}" and results.compact(None) is None and results.compact(json.dumps(made), 10) == json.dumps(made)
    assert json.loads(results.compact("not json" * 20_000))["_compacted"]["original_type"] == "invalid_json"
    rows = spark.createDataFrame([(1, big), (2, "{}"), (3, None)], "id int, v string").select("id", results.compacted(F.col("v")).alias("v")).collect()
    assert len(rows[0]["v"]) < 5000 and rows[1]["v"] == "{}" and rows[2]["v"] is None
    assert [r[0] for r in spark.createDataFrame([('{"a":1}',), ('{"a":1,"a":2}',), ("x",)], "v string").select(results.is_strict_json(F.col("v"))).collect()] == [True, False, False]


def test_figures_are_matched(spark):
    tex = r"\begin{figure}\begin{tikzpicture}x\end{tikzpicture}\caption{A {nested} plot of energy}\label{fig:one}\end{figure} \begin{figure*}\includegraphics{b}\caption{Other thing}\end{figure*}"
    page = '<figure id="one"><span class="ltx_ERROR">tikzpicture</span><figcaption>A nested plot of energy</figcaption></figure><figure><img src="ok"></figure>'
    sources = figures.source_figures(spark.createDataFrame([(1, tex), (2, None)], "doc int, tex string"), "doc", "tex")
    assert [(r["caption"], r["labels"], r["environments"]) for r in sources.orderBy("ordinal").collect()] == [("A nested plot of energy", ["fig:one"], ["tikzpicture"]), ("Other thing", [], [])]
    broken = figures.broken_figures(spark.createDataFrame([(1, page), (2, "")], "doc int, html string"), "doc", "html")
    (row,) = figures.matched(broken, sources, "doc").collect()
    assert (row["doc"], row["figure"], row["source"], row["score"]) == (1, 0, 0, 1000 + 500 + 200)
