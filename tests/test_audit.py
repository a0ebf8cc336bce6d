"""Counts of the audit, page by page, and the small rules around article packages and locations."""

import pytest
from pyspark.sql import functions as F

from quillstream.functions import audit, html
from quillstream.operators import articles, library


def counts(page, files=None, url=""):
    return {k: v for k, v in audit.audit_page(page, files, url)["counts"].items() if v}


@pytest.mark.parametrize("page, expected", [
    ('<a href="#x">1</a><a href="#y">2</a><p id="y"></p><a href=" ">3</a>', {"links": 2, "local_fragment_unresolved": 1}),
    ('<link rel="canonical" href="https://d/p"><a href="https://d/p#s">1</a><i id="s"></i><a href="https://d/p#t">2</a>', {"links": 2, "absolute_fragment_links": 2, "absolute_fragment_links_resolve_local": 1}),
    ('<img src="data:image/png;base64,AAAA" alt="a"><img src="data:image/png;base64,@@" alt="a"><img src="data:text/html,x" alt="a"><img src="data:nothing" alt="a">', {"images": 4, "image_bad_data_url": 2, "image_data_non_image_mime": 1}),
    ('<img src="//h/x" alt="a"><img src="http://h/x" alt="a"><img src="cid:1" alt="a"><img alt="a">', {"images": 4, "image_remote_src": 2, "image_missing_src": 1}),
    ('<figure></figure><figure><div><img src="a/b.png?x" alt="a"></div></figure><figure><a href="x.pdf">f</a></figure><figure class="ltx_lstlisting"></figure>', {"figures": 4, "figure_without_media_warning": 1, "images": 1, "image_relative_src": 1, "links": 1}),
    ('<figure><span class="ltx_ERROR">e</span></figure><span class="ltx_ERROR">\\rowcolor</span>', {"figures": 1, "figure_without_media_warning": 1, "latexml_figure_render_error": 1, "latexml_rowcolor_artifacts": 1}),
    ('<table><tr><td>1<table></table></td></tr></table>', {"tables": 2, "table_rows": 1, "table_cells": 1, "table_without_rows": 1}),
    ('<script>"<table>"</script><style>.ltx_item{}</style>', {"scripts": 1}),
    ('<button class="ButtonIcon" aria-label="Expand figure"></button><button class="d-button" aria-controls="m"></button><form id="collections-action-dialog-form"></form>', {"frontiers_figure_js_controls": 1, "pmc_dead_ui_controls": 2}),
    ('<span class="ltx_text" style="color:#000">x</span><math display="block" mathcolor="black"></math><a>/tables/3</a>', {"latexml_inline_black_text_styles": 1, "display_math_blocks": 1, "latexml_black_mathcolor_attrs": 1, "springer_table_placeholder_markers": 1}),
    ('<p class="ltx_caption"></p><p class="ltx_transformed_outer"></p><li class="ltx_item"><span class="ltx_tag_item">a</span><div class="ltx_para">x</div></li>', {"latexml_caption_transformed_blocks": 1, "latexml_itemize_marker_blocks": 1}),
    ("", {}), ("<", {}),
])
def test_counts(page, expected):
    assert counts(page) == expected


def test_missing_files_and_marks():
    page = '<style data-z2m-style="web-html-polish">dl.def-list{} table.disp-formula td.label{}</style><main id="web-doc" data-z2m-source-kind=" pmc "><img src="a.png"><img src="b%20c.png#x"><img src="/d.png">text</main>'
    out = audit.audit_page(page, ["a.png", "b c.png"])
    assert out["counts"]["image_relative_missing_file"] == 1 and out["missing"] == ["/d.png"] and out["style_ok"] and out["source_kind"] == "pmc"
    assert out["style_rules"] == ["def_list", "formula"] and out["text_length"] == 4 and audit.audit_page(page)["counts"]["image_relative_missing_file"] == 0


def test_own_urls_by_links():
    page = '<a href="https://d/p#a">1</a><a href="https://d/p#b">2</a><a href="https://e/q#a">3</a><i id="a"></i><i id="b"></i>'
    assert counts(page)["absolute_fragment_links_resolve_local"] == 2 and "absolute_fragment_links_resolve_local" not in counts(page.replace("#b", "#c"))


def test_resource_references(spark):
    page = '<img src="a.png" srcset="b.png 1x, https://h/c.png 2x"><source srcset="d.png"><use xlink:href="#i"/><link href="//h/s.css">'
    row = spark.range(1).select(html.resource_refs(F.lit(page)).alias("r"), html.missing_local(html.resource_refs(F.lit(page)), F.array(F.lit("a.png"))).alias("m"), F.filter(html.resource_refs(F.lit(page)), html.is_remote).alias("x")).first()
    assert row["r"] == ["a.png", "//h/s.css", "#i", "b.png", "https://h/c.png", "d.png"] and row["m"] == ["b.png", "d.png"] and row["x"] == ["//h/s.css", "https://h/c.png"]
    paths = ["a%20b.png?x", "./c.png", "../d.png", "/e.png", "x/../y", "p+q.png", ""]
    assert [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i").select(html.local_path(F.col("p"))).collect()] == ["a b.png", "c.png", None, None, None, "p+q.png", None]


def test_packages_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("f1", "<p>a</p>", "raw", "s.html", "m", "q")], "folder string, html string, raw string, source_name string, manifest string, quality string")
    files = articles.package_files(rows.withColumns({"manifest": F.struct("manifest"), "quality": F.struct("quality")}))
    articles.write_packages(files, f"file://{tmp_path}/out")
    got = {r["path"]: r["content"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {"article.html": "<p>a</p>", "source/s.html": "raw", "manifest.json": '{"manifest":"m"}', "quality.json": '{"quality":"q"}'}


def test_either_join_keeps_equal_rows(spark):
    left = spark.createDataFrame([(1, 9), (1, 9), (9, 2), (3, 3), (None, 1)], "a int, b int")
    right = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    got = sorted(map(tuple, library.either_join(left, right, ["a", "b"], "k").collect()), key=str)
    assert got == sorted([(1, 9), (1, 9), (9, 2), (None, 1)], key=str)
