"""Repairs of single pages, and assets under budgets."""

import base64

import pytest

from quillstream.functions import repairs
from quillstream.functions.documents import parse, render

GIF, PNG = b"GIF89a" + b"x" * 20, b"\x89PNG\r\n\x1a\n" + b"y" * 20


@pytest.mark.parametrize("page, expected", [
    ("<p>a<figure><img src=x></figure></p>", "<p>a</p><figure><img src=\"x\"></figure>"), ("<p><ul><li>1</li></ul></p>", "<ul><li>1</li></ul>"), ("<div><p>a<table></table>b<ol></ol></p></div>", "<div><p>a</p><table></table><p>b</p><ol></ol></div>"),
    ("<p class='c'><img src=x> </p>", "<figure class=\"standalone-media c\"><img src=\"x\"> </figure>"), ("<p>t<img src=x></p>", "<p>t<img src=\"x\"></p>"),
    ("<button class='ArticleReference' data-event='x-articleReference-a-B2x-y'>1</button><i id='b2X'></i>", "<a class=\"ArticleReference citation\" href=\"#b2X\">1</a><i id=\"b2X\"></i>"),
    ("<button class='ArticleReference' id='B7-button'>1</button>", "<button class=\"ArticleReference\" id=\"B7-button\">1</button>"),
    ("<tr class='ltx_equation'><td>a</td><td>b</td></tr>", "<tr class=\"ltx_equation\"><td>a</td><td>b</td></tr>"),
])
def test_repairs(page, expected):
    once = repairs.repair(page)
    assert once == expected and repairs.repair(once) == once


def test_assets_and_budgets():
    page = "<img src='a.gif' srcset='a.gif 1x, b.png 2x'><img src='a.gif'><img src='big.png'><img src='t.txt'>"
    html, n = repairs.embed(page, {"a.gif": GIF, "b.png": PNG, "big.png": PNG * 100, "t.txt": b"text"}, most=100)
    assert n == 4 and html.count("data:image/gif") == 3 and "data:image/png" in html and 'src="big.png"' in html and 'src="t.txt"' in html
    html, n = repairs.embed(page, {"a.gif": GIF, "b.png": PNG}, total=30)  # one fits, whichever comes first
    assert n == 3 and "data:image/png" not in html
    html, n = repairs.embed("<link rel='stylesheet' href='s.css'><style>@import 'i.css';</style>", {"s.css": b"@import url(i.css); a > b{}", "i.css": b"p{background:url( 'a.gif' )}", "a.gif": GIF})
    assert n == 1 and html.count("data:image/gif") == 2 and "a > b{}" in html and "@import" not in html


def test_small_rules():
    url = repairs.data_url(GIF, "image/gif")
    assert repairs.is_same_data(url, GIF) and not repairs.is_same_data(url, PNG) and not repairs.is_same_data(url, GIF, 5) and not repairs.is_same_data("data:text/plain;base64," + base64.b64encode(GIF).decode(), GIF) and not repairs.is_same_data("data:image/gif;base64,@", b"")
    assert repairs.media_type(b"RIFF0000WEBP") == "image/webp" and repairs.media_type(b"RIFF0000WAVE") == "" and repairs.media_type(b" <svg xmlns='x'>") == "image/svg+xml"
    root = parse("<div class='c-article-body'></div><article></article><div class='x'></div>")
    assert [repairs.starts_article(n) for n in root.children] == [True, True, False]
    links = parse("<a href='#x'></a><a href='mailto:/tables/1'></a><a href='/article/1/tables/2#f'></a>")
    assert repairs.table_page(links, "https://h/article/1") == "https://h/article/1/tables/2" and repairs.table_page(parse("<a>x</a>"), "https://h/tables/1") == ""
    named = parse("<img src='a' srcset='a 1x, c 2x'><a href='b'>")
    assert repairs.rename_assets(named, {"a": "assets/1", "b": "assets/2"}) == 3 and render(named) == '<img src="assets/1" srcset="assets/1 1x, c 2x"><a href="assets/2"></a>'
