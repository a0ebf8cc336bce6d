"""What only shows on larger tables: plans that repeat work, part keys from a million."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstream.functions import providers
from quillstream.plans.registry import ORACLES, QUERIES
from quillstream.plans.store_queries import attachment_number

ARTICLE = "<PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><AuthorList><Author><LastName>L</LastName></Author></AuthorList></Article></MedlineCitation></PubmedArticle>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_articles_are_parsed_once(spark, sf_dir):
    assert plan(QUERIES["pubmed_articles"](spark, sf_dir)).count("from_xml") == 1
    rows = spark.createDataFrame([(ARTICLE,), (None,), ("<PubmedArticle/>",)], "xml string")
    assert plan(rows.select(providers.pubmed(F.col("xml")).alias("c"))).count("from_xml") == 1
    both = providers.with_pubmed(rows, "xml").collect()
    assert [(r["candidate"] and r["candidate"]["identifier"], r["authors"] and r["authors"][0]["lastName"]) for r in both] == [("7", "L"), (None, None), (None, None)]
    assert [r["c"] for r in rows.select(providers.pubmed(F.col("xml")).alias("c")).collect()] == [r["candidate"] for r in both]


@pytest.fixture(scope="module")
def wide_parts(sf_dir, tmp_path_factory):
    """The smallest tables with lines that differ by the last digit of the order or line and a million or more of the part."""
    folder, con = tmp_path_factory.mktemp("wide"), duckdb.connect()
    lines = "SELECT n AS k, ln, n + 1000000 * m AS p FROM range(143) t(n), (VALUES (1, 2), (2, 1), (3, 0), (7, 4)) v(ln, m) UNION ALL SELECT n + 1, 1, n FROM range(143) t(n)"
    for name in ("customer", "nation", "region", "orders"):
        con.execute(f"COPY (FROM '{sf_dir}/{name}.parquet') TO '{folder}/{name}.parquet'")
    line = f"(FROM '{sf_dir}/lineitem.parquet' LIMIT 1)"
    con.execute(f"COPY (SELECT * EXCLUDE (k, ln, p) REPLACE (k AS l_orderkey, CAST(p AS BIGINT) AS l_partkey, CAST(ln AS INTEGER) AS l_linenumber) FROM {line}, ({lines})) TO '{folder}/lineitem.parquet'")
    return str(folder)


def rows_of_sql(folder, name, columns):
    con = duckdb.connect()
    for table in ("customer", "nation", "region", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    return con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()


@pytest.mark.parametrize("name", ["attachments_for_files", "library_after_parents", "library_html_attachments", "library_parent_items"])
def test_lines_with_part_keys_from_a_million(name, spark, wide_parts):
    df = QUERIES[name](spark, wide_parts)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, rows_of_sql(wide_parts, name, df.columns)))


@pytest.fixture(scope="module")
def missing_orders(sf_dir, tmp_path_factory):
    """The smallest tables without some of the orders that lines name."""
    folder, con = tmp_path_factory.mktemp("missing"), duckdb.connect()
    for name in ("customer", "nation", "region", "lineitem"):
        con.execute(f"COPY (FROM '{sf_dir}/{name}.parquet') TO '{folder}/{name}.parquet'")
    con.execute(f"COPY (FROM '{sf_dir}/orders.parquet' WHERE o_orderkey % 7 <> 3) TO '{folder}/orders.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["library_after_parents", "library_parent_items"])
def test_lines_of_missing_orders(name, spark, missing_orders):
    df = QUERIES[name](spark, missing_orders)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, rows_of_sql(missing_orders, name, df.columns)))


def test_files_of_repeated_orders(spark, sf_dir, tmp_path):
    con = duckdb.connect()
    for name in ("customer", "nation", "region", "lineitem"):
        con.execute(f"COPY (FROM '{sf_dir}/{name}.parquet') TO '{tmp_path}/{name}.parquet'")
    con.execute(f"COPY (FROM '{sf_dir}/orders.parquet' UNION ALL FROM '{sf_dir}/orders.parquet' WHERE o_orderkey % 50 = 7) TO '{tmp_path}/orders.parquet'")
    df = QUERIES["attachments_for_files"](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, rows_of_sql(tmp_path, "attachments_for_files", df.columns)))


def test_numbers_of_attachments(spark):
    lines = spark.createDataFrame([(k, ln, r + 10**6 * m) for k in range(3) for ln in range(10) for m in (0, 1, 2, 9, 10, 99) for r in (0, 1, 999_999)], "k long, ln int, p long")
    rows = lines.select(attachment_number(F.col("k"), F.col("ln"), F.col("p")).alias("id"), F.expr("1000000000000L + k * 10000000L + ln * 1000000L + p").alias("sql")).collect()
    assert len({r["id"] for r in rows}) == len(rows) > len({r["sql"] for r in rows})
    assert [r["sql"] for r in sorted(rows, key=lambda r: r["id"])] == sorted(r["sql"] for r in rows)
    assert all(r["id"] % n == r["sql"] % n for r in rows for n in (3, 5))
    for k, ln, p in ((6 * 10**8 + 1, 1, 1), (1, 10, 1), (1, 1, 10**8)):
        with pytest.raises(Exception, match="outside the places"):
            spark.range(1).select(attachment_number(*[F.lit(x) + F.col("id") for x in (k, ln, p)]).alias("x")).collect()
