"""Text normalisation as native columns; Arrow UDFs where Spark has no builtin.

`lower` stands for case folding, which differs outside ASCII for a few letters (such as the German
sharp s); `casefolded` is the exact form, through Arrow.  Character references are decoded natively.
"""

from __future__ import annotations

import difflib
import functools
import html
import html.entities

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: White space as Unicode defines it; Java's own class holds ASCII only.
SPACE = r"(?U)\s+"

# Words that say nothing about a title.
TITLE_STOP_WORDS = ("with", "from", "into", "that", "this", "using", "through", "towards", "between", "article")


def computed_once(rows: DataFrame) -> DataFrame:
    """The same rows, their columns computed here: a filter on them is not pushed below and so computes nothing twice."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("_row")).select("_row.*")


def blank(value: Column) -> Column:
    """The value, or an empty string for null."""
    return F.coalesce(value.cast("string"), F.lit(""))


def none_if_blank(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


#: Named references that count without a semicolon too; and what HTML5 makes of odd numbers.
_BARE = {name: value for name, value in html.entities.html5.items() if not name.endswith(";")}
_ODD = {str(n): html.unescape(f"&#{n};") for n in range(0xA0) if html.unescape(f"&#{n};") != chr(n)}


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _looked_up(table: dict[str, str], key: str) -> str:
    """SQL for the value of a key, null if there is none.

    The table is one text, which a plan holds as one literal; a map would be built anew wherever it stands.
    """
    text = _quoted("".join(f"\x01{k}\x02{v}" for k, v in table.items()) + "\x01")
    return f"if(contains({text}, concat('\x01', {key}, '\x02')), substring_index(substring_index({text}, concat('\x01', {key}, '\x02'), -1), '\x01', 1), NULL)"


def _unescaping() -> str:
    """SQL of a lambda that decodes the reference at the start of each piece behind an ampersand.

    That is a number, a name with a semicolon, or the longest name that counts without one.  There is one
    lambda and none inside it: nested ones as arguments of a Python function do not get through Spark's planner.
    """
    r = f"regexp_extract(p, {_quoted(r'^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'f <&#;]{1,32};?)')}, 1)"

    def number(digits: str, base: int) -> str:
        bare = f"regexp_replace(regexp_extract({r}, {_quoted(digits)}, 1), '^0+(?=.)', '')"
        code = f"if(length({bare}) > 8, 1114112L, cast(conv({bare}, {base}, 10) AS bigint))"
        char = f"decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32')"
        return (
            f"CASE WHEN {code} >= 55296 AND {code} <= 57343 OR {code} > 1114111 THEN '\ufffd' WHEN {code} < 160 THEN coalesce({_looked_up(_ODD, f'string({code})')}, {char})"
            f" WHEN {code} >= 64976 AND {code} <= 65007 OR {code} & 65534 = 65534 THEN '' ELSE {char} END"
        )

    common = " ".join(f"WHEN {r} = '{n};' THEN {_quoted(html.entities.html5[n + ';'])}" for n in ("amp", "lt", "gt", "quot", "nbsp"))
    longest = ", ".join(f"if(length({r}) > {n}, concat({_looked_up(_BARE, f'left({r}, {n})')}, substring({r}, {n + 1})), NULL)" for n in range(max(map(len, _BARE)), 1, -1))
    named = f"coalesce(if({r} RLIKE '^[A-Za-z0-9]+;?$', {_looked_up(html.entities.html5, r)}, NULL), {longest}, concat('&', {r}))"
    decoded = f"CASE WHEN {r} = '' THEN '&' WHEN {r} RLIKE '^#[0-9]' THEN {number('^#([0-9]+)', 10)} WHEN {r} RLIKE '^#[xX]' THEN {number('^#[xX]([0-9a-fA-F]+)', 16)} {common} ELSE {named} END"
    return f"(p, i) -> CASE WHEN i = 0 THEN p ELSE concat({decoded}, substring(p, length({r}) + 1)) END"


_UNESCAPING = _unescaping()


@functools.lru_cache(maxsize=1)
def _parsed(context: SparkContext) -> Column:
    """The lambda as a column: parsed once for each Spark context."""
    return F.expr(_UNESCAPING)


def unescape(value: Column) -> Column:
    """HTML character references decoded, as HTML5 has them; a text is cut at its ampersands."""
    return F.array_join(F.call_function("transform", F.split(value, "&"), _parsed(SparkContext.getOrCreate())), "")


@pandas_udf(T.StringType())
def casefolded(values: pd.Series) -> pd.Series:
    return values.str.casefold()


def collapse(value: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(blank(value), SPACE, " "))


def normalize_space(value: Column) -> Column:
    """`collapse` behind the decoding of character references."""
    return collapse(unescape(blank(value)))


def strip_tags(value: Column) -> Column:
    """Tags as spaces, white space collapsed; character references stay (see `strip_html`)."""
    return collapse(F.regexp_replace(blank(value), "<[^>]+>", " "))


def strip_html(value: Column) -> Column:
    return normalize_space(F.regexp_replace(blank(value), "<[^>]+>", " "))


def normalize_title(value: Column) -> Column:
    """Lower-cased ASCII letters and digits, anything else as one space."""
    return F.trim(F.regexp_replace(F.lower(normalize_space(value)), "[^a-z0-9]+", " "))


def first_text(values: Column) -> Column:
    """The first value of an array that is not blank; empty if there is none."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), normalize_space), lambda v: v != "")
    return F.coalesce(F.get(clean, F.lit(0)), F.lit(""))


def join_values(values: Column) -> Column:
    """The values of an array that are not blank, joined by a comma and a space."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), normalize_space), lambda v: v != "")
    return F.array_join(clean, ", ")


def split_identifiers(value: Column) -> Column:
    """Parts between semicolons and line ends that are not blank."""
    return F.filter(F.transform(F.split(blank(value), "[;\n]"), normalize_space), lambda v: v != "")


def fold_distinct(values: Column) -> Column:
    """Values of an array without those that repeat an earlier one but for case."""
    keys = F.transform(values, lambda v: F.lower(v))
    return F.filter(values, lambda v, i: F.array_position(keys, F.lower(v)) == i + 1)


def title_tokens(value: Column) -> Column:
    """Significant tokens of a title: four characters or more, no stop words, distinct, ten at most."""
    found = F.regexp_extract_all(F.lower(blank(value)), F.lit("([a-z0-9][a-z0-9-]{3,})"), F.lit(1))
    kept = F.filter(found, lambda t: ~t.isin(*TITLE_STOP_WORDS))
    return F.slice(F.array_distinct(kept), 1, 10)


def token_hits_suffice(tokens: Column, text: Column) -> Column:
    """Whether half of the tokens (two at least, five suffice) stand in a text; true without tokens."""
    hits = F.size(F.filter(tokens, lambda t: F.contains(text, t)))
    needed = F.least(F.greatest(F.lit(2), F.floor(F.size(tokens) / 2)), F.lit(5))
    return (F.size(tokens) == 0) | (hits >= needed)


def token_jaccard(left: Column, right: Column) -> Column:
    """Share of common words of two normalised titles; 0 if either is empty."""
    a, b = (F.filter(F.array_distinct(F.split(x, " ")), lambda t: t != "") for x in (left, right))
    return F.when((left == "") | (right == ""), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def _score(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    left, right = set(a.split()), set(b.split())
    ratio = difflib.SequenceMatcher(None, a, b).ratio()
    return round(0.65 * ratio + 0.35 * len(left & right) / len(left | right), 4)


@pandas_udf(T.DoubleType())
def _title_scores(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([_score(a, b) for a, b in zip(left, right)], dtype="float64")


def title_match_score(left: Column, right: Column) -> Column:
    """Likeness of two titles, 0 to 1: sequence ratio and common words.

    The ratio is not symmetric, and drops frequent characters of a right side of 200 or more; equal
    titles and empty ones never reach Python.
    """
    a, b = normalize_title(left), normalize_title(right)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(_title_scores(a, b))


def token_overlap_score(left: Column, right: Column) -> Column:
    """500 times the common tokens over the larger of two token arrays, cut to an integer."""
    larger = F.greatest(F.size(left), F.size(right))
    return F.when(larger == 0, F.lit(0)).otherwise(F.floor(F.size(F.array_intersect(left, right)) * 500 / larger).cast("int"))


def merge_extra(current: Column, addition: Column) -> Column:
    """Lines of an addition that the current text does not have yet, behind it; case does not count."""
    lines = lambda c: F.filter(F.transform(F.split(F.trim(blank(c)), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    have = F.transform(lines(current), lambda x: F.lower(x))
    new = F.filter(lines(addition), lambda x: ~F.array_contains(have, F.lower(x)))
    base = F.trim(blank(current))
    return F.when(base == "", F.trim(blank(addition))).when(F.size(new) == 0, base).otherwise(F.concat(base, F.lit("\n"), F.array_join(new, "\n")))


def safe_part(value: Column, most: int = 60, default: str = "value") -> Column:
    """A value as a part of a file name."""
    clean = F.regexp_replace(F.trim(blank(value)), "[^A-Za-z0-9._-]+", "_")
    clean = F.substring(F.regexp_replace(clean, "^[._-]+|[._-]+$", ""), 1, most)
    return F.coalesce(none_if_blank(clean), F.lit(default))
