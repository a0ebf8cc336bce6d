"""Every dealt operator on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from quillstream.llm.cube_mixing import mix
from quillstream.llm.html_blocks import extract_text
from quillstream.llm.imatch import PARTS, edited_fingerprints
from quillstream.llm.language_spans import Model, identify, train
from quillstream.llm.odd_sketch import near_duplicates
import corpus_pipeline
from quillstream.llm import common
from quillstream.llm.queries import model_file, url_rules
from quillstream.llm.rp_forest import near_vectors
from quillstream.llm.sentencepiece_bpe import encode_texts
from quillstream.llm.surrogates import replace_entities
from quillstream.llm.url_automaton import filter_urls
from quillstream.llm.warc import read_warc, write_warc

LONG = "lorem ipsum dolor sit amet " * 8000
ROWS = [
    (1, "the cat sat on the mat and the dog", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \t\n", "fr", "b"), (5, LONG, "en", "b"),
    (6, "der Hund und die Katze", "de", None), (6, "der Hund und die Katze", "de", None), (7, "one two", "en", "a"), (8, "12345 !!!", "en", "a"), (None, "null id text here now", "en", "c"),
]
EXTRA = ("id", "score", "size", "kept", "group", "component_id", "taken", "parts", "node", "root", "block", "n_tokens", "spans", "source_size")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    for name in EXTRA:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def language(df):
    return identify(df, train(df))


OPERATORS = {
    "encode": lambda df: encode_texts(df, model_file()), "mix": mix, "language": language, "near": near_duplicates,
    "surrogates": replace_entities, "imatch": edited_fingerprints,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_input_row(name, docs):
    rows = by_id(OPERATORS[name](docs).collect())
    assert {k: len(v) for k, v in rows.items()} == {**{k: 1 for k in (1, 2, 3, 4, 5, 7, 8, None)}, 6: 2}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_gives_no_rows(name, empty):
    assert OPERATORS[name](empty).collect() == []


def test_encode_edges(docs):
    rows = by_id(encode_texts(docs, model_file()).collect())
    assert rows[2][0]["ids"] == rows[3][0]["ids"] == [1, 2]
    assert rows[6][0] == rows[6][1]
    assert rows[5][0]["n_tokens"] > 8000 * 5


def test_mix_edges(docs):
    rows = by_id(mix(docs).collect())
    assert rows[2][0]["size"] == rows[3][0]["size"] == rows[4][0]["size"] == 0
    assert rows[2][0]["taken"] == 0
    assert rows[6][0]["taken"] == rows[6][1]["taken"] and rows[6][0]["source_size"] == 10
    assert all(r["taken"] <= 2 * r["size"] for group in rows.values() for r in group)


def test_language_edges(docs):
    rows = by_id(language(docs).collect())
    for k in (2, 3, 4, 8):
        assert (rows[k][0]["lang_pred"], rows[k][0]["score"], rows[k][0]["spans"]) == ("und", 0.0, [])
    assert rows[5][0]["lang_pred"] == "en" and rows[6][0]["lang_pred"] == "de"
    assert rows[1][0]["spans"][0]["start"] == 0


def test_language_without_labels(docs):
    nothing = train(docs.filter("lang = 'xx'"))
    assert isinstance(nothing, Model) and nothing.languages == ()
    assert {r["lang_pred"] for r in identify(docs, nothing).collect()} == {"und"}


def test_near_edges(docs):
    rows = by_id(near_duplicates(docs).collect())
    assert rows[2][0]["n_shingles"] == rows[3][0]["n_shingles"] == rows[4][0]["n_shingles"] == 0
    assert all(rows[k][0]["component_id"] == k and rows[k][0]["kept"] for k in (1, 2, 3, 4, 5, 6, 7, 8))
    assert rows[7][0]["n_shingles"] == 1 and rows[5][0]["n_shingles"] == 5
    assert rows[None][0]["component_id"] is None and rows[None][0]["kept"]


def test_surrogate_edges(docs):
    rows = by_id(replace_entities(docs).collect())
    assert rows[2][0]["text"] is None and rows[3][0]["text"] == "" and rows[5][0]["text"] == LONG
    assert all(r["n_entities"] == 0 for group in rows.values() for r in group)


def test_imatch_edges(docs):
    rows = by_id(edited_fingerprints(docs).collect())
    none = "0" * 8 * PARTS
    assert rows[2][0]["fingerprint"] == rows[3][0]["fingerprint"] == rows[4][0]["fingerprint"] == none
    assert rows[2][0]["n_chars"] == 0 and rows[2][0]["near_edited"] == 1.0 and rows[2][0]["near_next"] == 1.0
    assert rows[6][0]["fingerprint"] == rows[6][1]["fingerprint"] != none
    assert all(0 <= r[c] <= 1 for group in rows.values() for r in group for c in ("near_edited", "near_next"))


PAGES = [(1, "https://a.example.org/en/12", "<p>x</p>"), (2, None, None), (3, "", ""), (3, "", ""), (None, "no scheme", "<article><p>" + LONG + "</p></article>")]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return df.withColumn("text", F.lit("clash")).withColumn("id", F.lit(0)).withColumn("rule", F.lit("clash"))


def test_page_operators(pages):
    text = [r.asDict() for r in extract_text(pages).collect()]
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in text[:4]] == [(1, "x", 1), (2, "", 0), (3, "", 0), (3, "", 0)]
    assert text[4]["n_chars"] == len(LONG.strip())
    urls = [tuple(r) for r in filter_urls(pages, url_rules()).collect()]
    assert urls[0] == (1, "a.example.org", "/en/12", "example.org/en/1", "block")
    assert urls[1] == (2, "", "", None, "allow") and urls[4] == (None, "", "", None, "allow")
    assert extract_text(pages.limit(0)).collect() == filter_urls(pages.limit(0), url_rules()).collect() == []


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [2.0, 0.1]), (1, None), (2, []), (4, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0]), (None, [0.0, -1.0]), (12, [1e-30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("label", F.lit(1))
    got = {}
    for r in near_vectors(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert got[5] == [(4, 3, False)] and got[3] == [(4, 3, True)] * 2 and got[9] == [(4, 3, False)] and got[12] == [(4, 3, False)]
    for k in (1, 2, 4, 6, 7, 8, 10, 11):
        assert got[k] == [(0, k, True)], k
    assert got[None][0][0] == 0
    assert near_vectors(df.limit(0)).collect() == []


def test_warc_edges(spark, pages):
    path = common.new_path(spark, "edge-warc")
    write_warc(pages, path)
    got = sorted((r["record_id"], r["warc_type"], r["payload_bytes"], r["target_uri"]) for r in read_warc(spark, path).collect())
    page = len(PAGES[4][2])
    assert got == [("urn:page:", "response", page, "no scheme"), ("urn:page:1", "response", 8, "https://a.example.org/en/12"), ("urn:page:2", "response", 0, None), ("urn:page:3", "response", 0, ""), ("urn:page:3", "response", 0, "")]
    empty_path = common.new_path(spark, "edge-warc")
    write_warc(pages.limit(0), empty_path)
    assert read_warc(spark, empty_path).collect() == []


def test_long_and_tied_urls(spark):
    long = "https://a.example.org/en/1" + "x" * 200_000
    df = spark.createDataFrame([(1, long), (2, "http://a.com/fr/de/"), (2, "http://a.com/fr/de/"), (3, "://"), (4, "a://?x"), (5, "x://h#/p")], "page_id long, url string")
    rows = [tuple(r) for r in filter_urls(df, url_rules()).collect()]
    assert rows[0][3:] == ("example.org/en/1", "block") and len(rows[0][2]) == len(long) - len("https://a.example.org")
    assert rows[1] == rows[2] == (2, "a.com", "/fr/de/", "com/fr/", "allow")
    assert [r[1:3] for r in rows[3:]] == [("", ""), ("", ""), ("h", "")]


# --- stages of the pipeline ------------------------------------------------------------------------

STAGE_ROWS = [
    (1, "the cat sat on the mat and the dog was with it in the house", "en", "a", 1), (2, None, None, None, 2), (3, "", "en", "a", 3), (4, " \t\n", "fr", "b", 4), (5, LONG, "en", "b", 5),
    (6, "der Hund und die Katze", "de", None, 6), (6, "der Hund und die Katze", "de", None, 6), (6, "quite another text of the same id", "en", "a", 7),
    (7, "the cat sat on the mat and the dog was with it in the house", "en", "a", 8), (8, "12345 !!!", "en", "a", 9), (None, "null id text here now", "en", "c", 10), (None, "null id text here now", "en", "c", 10),
]
CLASHES = ("id", "score", "kept", "kinds", "n_entities", "lang_pred", "component_id", "copies", "taken", "row", "nth", "source_size", "_n", "_kept", "again", "held_out")


@pytest.fixture(scope="module")
def staged(spark):
    df = spark.createDataFrame(STAGE_ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return common.written(df, "staged")


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))


def run_stage(spark, name, df):
    out = dict(corpus_pipeline.STAGES)[name](spark, df, "")
    assert name == "encoding" or out.columns == df.columns
    return out


def test_stages_on_edges(spark, staged):
    assert ids(run_stage(spark, "language", staged)) == [1, 5, 6, 6, 6, 7, None, None]
    assert ids(run_stage(spark, "near_duplicates", staged)) == [1, 2, 3, 4, 5, 6, 6, 8, None, None]
    assert ids(run_stage(spark, "surrogates", staged)) == ids(staged)
    assert run_stage(spark, "surrogates", staged).filter("n_chars > 10 or n_entities <> 'clash'").count() == 0
    mixed = run_stage(spark, "mixing", staged)
    taken = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in mix(staged).collect()}
    got = {}
    for r in mixed.collect():
        key = (r["doc_id"], r["source"], len((r["text"] or "").split()))
        got[key] = got.get(key, 0) + 1
    assert got == {k: n * (2 if k[0] == 6 and k[1] is None or k[0] is None else 1) for k, n in taken.items() if n}
    assert mixed.filter("copies <> 'clash'").count() == 0
    assert ids(run_stage(spark, "encoding", staged)) == ids(staged)


def test_surrogate_stage_follows_the_length(spark, staged):
    df = staged.limit(1).withColumn("text", F.lit("mail bo@x.example.com now"))
    row = run_stage(spark, "surrogates", df).first()
    assert row["text"] != "mail bo@x.example.com now" and row["n_chars"] == len(row["text"])


def test_repeated_ids_agree_between_runs(spark, staged):
    rows = lambda df: sorted(map(str, run_stage(spark, "near_duplicates", df).collect()))
    other = staged.filter("doc_id = 6").withColumn("source", F.lit("z"))
    assert rows(staged.unionByName(other)) == rows(other.unionByName(staged).repartition(5))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, staged, name):
    assert run_stage(spark, name, staged.limit(0)).collect() == []
