"""Native decoding of character references against the standard library."""

import html
import random

from pyspark.sql import functions as F

from quillstream.functions.text import normalize_space, unescape

TEXTS = [
    "", "a", "R&amp;D", "R&ampD", "&amp;amp;", "&#8211;&#x2013;&#X2013;", "&#0;&#13;&#128;&#159;&#xD800;&#1114112;&#99999999999999999999;", "&#xFDD0;&#65534;&#11;&#127;", "&#;&#x;&", "&&amp;&", "&notit;&notin;&not", "&lt;b&gt;&quot;&apos;&nbsp;",
    "x &unknown; y", "&copy2024", "&CounterClockwiseContourIntegral;", "&bne;&acE;", "AT&T", "a & b", "&#38;lt;", "&eacuteé&Eacute;", "&averyveryveryveryverylongnamethatisnone;", "&#000065;", "&amp\n&am",
]


def test_unescape_equals_the_library(spark):
    random.seed(1)
    parts = ["&", "amp", ";", "#", "x", "41", "not", "in", "copy", "lt", " ", "é", "nbsp", "0", "yen", "frac12", "<"]
    texts = TEXTS + ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", unescape(F.col("t")).alias("u"), normalize_space(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r["u"] == html.unescape(r["t"]), r["t"]
    by = {r["t"]: r["n"] for r in rows}
    assert by["R&amp;D"] == "R&D" and by["&lt;b&gt;&quot;&apos;&nbsp;"] == "<b>\"'" and spark.range(1).select(unescape(F.lit(None).cast("string"))).first()[0] is None
