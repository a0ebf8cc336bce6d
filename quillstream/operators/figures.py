"""Broken figures of converted TeX matched with the figures of its source."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.documents import parse

# Words that say nothing about a caption.
STOP_WORDS = ("and", "are", "for", "figure", "fig", "into", "the", "this", "with")
_ENV = re.compile(r"\\begin\{(figure\*?)\}.*?\\end\{\1\}", re.DOTALL)
_BEGIN = re.compile(r"\\begin\{([A-Za-z]+)\*?\}")
_LABEL = re.compile(r"\\label\{([^}]*)\}")


def caption_of(tex: str) -> str:
    """Text of the first caption: its balanced argument without commands."""
    start = re.search(r"\\caption(?:\[[^\]]*\])?\{", tex)
    if not start:
        return ""
    depth, at = 1, start.end()
    while at < len(tex) and depth:
        depth += {"{": 1, "}": -1}.get(tex[at], 0) if tex[at - 1] != "\\" else 0
        at += 1
    bare = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?|[{}$~]", " ", tex[start.end() : at - 1])
    return " ".join(bare.split())


def source_figures(texts: DataFrame, doc: str, tex: str) -> DataFrame:
    """(doc, ordinal, tex, caption, labels, environments) of all figure environments of TeX sources."""
    kind = texts.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, m in enumerate(_ENV.finditer(t or "")):
                    envs = sorted({e.lower() for e in _BEGIN.findall(m[0])} - {"figure"})
                    rows.append((d, i, m[0], caption_of(m[0]), _LABEL.findall(m[0]), envs))
            if rows:
                types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=[doc, "ordinal", "tex", "caption", "labels", "environments"])

    return texts.select(doc, tex).mapInArrow(run, f"`{doc}` {kind}, ordinal int, tex string, caption string, labels array<string>, environments array<string>")


def broken_figures(pages: DataFrame, doc: str, html: str) -> DataFrame:
    """(doc, figure, figure_id, caption, error_tokens) of figures with conversion errors."""
    kind = pages.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, figure in enumerate(parse(page or "").find_all("figure")):
                    errors = [n.visible() for n in figure.walk() if "ltx_ERROR" in n.attrs.get("class", "")]
                    if errors:
                        tokens = list(dict.fromkeys(t.lower().rstrip("*") for e in errors for t in re.findall(r"[A-Za-z][A-Za-z0-9_:-]*\*?", e)))
                        caption = next((n.visible() for n in figure.find_all("figcaption")), "")
                        rows.append((d, i, figure.attrs.get("id", ""), caption, tokens))
            if rows:
                types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=[doc, "figure", "figure_id", "caption", "error_tokens"])

    return pages.select(doc, html).mapInArrow(run, f"`{doc}` {kind}, figure int, figure_id string, caption string, error_tokens array<string>")


def meaningful_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]{3,})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*STOP_WORDS)))


def matched(broken: DataFrame, sources: DataFrame, doc: str) -> DataFrame:
    """The best source figure of each broken one, where any scores above 0; the first of equals.

    Pairs are made within a document only.
    """
    s = sources.select(doc, F.col("ordinal").alias("source"), F.col("caption").alias("source_caption"), "labels", "environments", F.lower("tex").alias("_tex"))
    pairs = broken.join(s, doc)
    begins = lambda t: F.contains(F.col("_tex"), F.concat(F.lit("\\begin{"), t, F.lit("}")))
    token = lambda t: F.when(F.array_contains("environments", t), 1000).when(begins(t), 850).when(F.contains(F.col("_tex"), t), 150).otherwise(0)
    errors = F.aggregate(F.transform("error_tokens", token), F.lit(0), lambda a, b: a + b)
    left, right = meaningful_tokens(F.col("caption")), meaningful_tokens(F.col("source_caption"))
    larger = F.greatest(F.size(left), F.size(right), F.lit(1))
    overlap = F.floor(F.size(F.array_intersect(left, right)) * 500 / larger).cast("int")
    label = F.when((F.col("figure_id") != "") & F.exists("labels", lambda x: F.contains(F.lower(x), F.lower(F.col("figure_id")))), 200).otherwise(0)
    score = F.when((F.size("error_tokens") == 0) & (overlap == 0), 0).otherwise(errors + overlap + label)
    order = Window.partitionBy(doc, "figure").orderBy(F.col("score").desc(), "source")
    ranked = pairs.withColumn("score", score).filter("score > 0").withColumn("_n", F.row_number().over(order))
    return ranked.filter("_n = 1").select(doc, "figure", "source", "score")
