"""Corpus pipeline: stages over `documents`, each written and reread before the next.

Language ID drops documents without a language of their own, near-duplicate groups keep one document,
personal data gets surrogates, the sources are mixed to their targets, and the mix is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import common
from quillstream.llm.cube_mixing import mix
from quillstream.llm.language_spans import UNDETERMINED, held_out, identify, train
from quillstream.llm.odd_sketch import near_duplicates
from quillstream.llm.queries import model_file
from quillstream.llm.sentencepiece_bpe import encode_texts
from quillstream.llm.surrogates import replace_entities
from quillstream.sources.tables import load

#: A document in which no language has this share of the letters is rejected as a jumble.
LEAST_SHARE = 0.5


def _rest(docs: DataFrame) -> list[str]:
    """The columns besides id and text, which operators carry along."""
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, and those that are a jumble of languages.

    So null, empty and wordless texts go.  Rows that repeat, null ids and rows without a label are judged
    like others, by their text alone; without any label nothing can be learned, and all documents go.
    """
    found = identify(docs, train(docs.filter(~held_out())), with_spans=False, keep=_rest(docs))
    good = found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SHARE))
    return good.select(*[F.col(c) if c in ("doc_id", "text") else F.col("kept").getField(c).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, that with the smallest id.

    Rows with one id are one document.  If it stays, each of its texts stays once, unlike ones all; of
    rows that repeat id and text the one whose other columns have the smallest hash.  Null and empty texts
    are in no group, and rows with a null id all stay.
    """
    found = common.written(near_duplicates(docs), "near-duplicates")
    ids = common.written(found.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.bool_and("kept").alias("_kept")), "ids")
    # The ids that go are a share of all, so they are merged and not sent to every task, whatever the size.
    stays = docs.join(ids.filter("not _kept").select("doc_id").hint("merge"), "doc_id", "left_anti").select(docs.columns)
    repeated = ids.filter("_n > 1 and _kept").select("doc_id")
    if repeated.isEmpty():
        return stays
    single = stays.join(repeated, "doc_id", "left_anti").select(docs.columns)
    again = stays.join(repeated, "doc_id", "left_semi").select("doc_id", F.struct(*docs.columns).alias("row"))
    text = F.col("row").getField("text")
    keys = [F.col("doc_id").alias("id"), text.isNull().alias("none"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]
    one = again.groupBy(*keys).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return single.unionByName(one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def surrogate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates in the place of personal data; n_chars, if there is one, follows the new text.

    All rows stay, repeated ones and those with null ids or texts too; texts without personal data, and
    all other columns, stay as they are.
    """
    made = replace_entities(docs, keep=_rest(docs))
    kept = {c: F.col("kept").getField(c) for c in _rest(docs)}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.col("n_entities") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(kept["n_chars"])
    return made.select(*[kept.get(c, F.col(c)).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix does: not at all, once or twice.

    Rows that repeat an id, source and size are taken alike, so one row for each id, source and size is
    joined.  Null and empty texts count for no total; they are taken as often as all texts of their source
    are at least.
    """
    keys = {"id": F.col("doc_id"), "source": F.col("source").cast("string"), "size": F.col("size")}
    taken = mix(docs).filter("copies > 0").select(*[c.alias(k) for k, c in keys.items()], "copies").distinct().alias("t")
    sized = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"), common.word_count(F.col("text")).alias("size")).alias("d")
    same = F.col("d.id").eqNullSafe(F.col("t.id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.size") == F.col("t.size"))
    rows = sized.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), F.col("t.copies").cast("int"))).alias("nth"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text of the mix, one row a row; a null text is encoded as an empty one."""
    return encode_texts(docs, model_file())


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("surrogates", surrogate_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: The stages draw, learn and compare texts by hash; SQL cannot express them. tests/llm checks the run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what a stage returns is written before the next reads it.

    Tables of earlier stages, and what they wrote on their way, go as soon as the next table stands.
    """
    docs, start = load(spark, sf_dir, "documents"), common.mark()
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
        common.release(start)
    return STAGES[-1][1](spark, docs, sf_dir)
