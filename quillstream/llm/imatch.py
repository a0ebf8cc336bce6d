"""I-Match fingerprints with randomised lexicon subsets, in DataFrame operations only.

The lexicon holds the terms whose document frequency lies in a band (`low` to `high` as shares of all
distinct texts, that is a band of inverse document frequency; copies do not push their words out of it).
A text keeps its distinct terms of the lexicon, sorted; their hash is its first fingerprint part, and the
hashes of what randomised lexicon subsets leave of them are the other parts, nested from large subsets to
small ones.  Texts with a few differing terms still agree in the subsets without them, so the share of
agreeing parts is their likeness.

A text with fewer than FEWEST terms of the lexicon keeps all of its terms, as so few say too little.

There are at most (mean distinct terms of a text) / low terms in the band, whatever the corpus size.
The lexicon goes to the tasks as a bitmap in a query literal, with at least 32 slots a term; a term is
inside if both of its slots, which lie in one word, are taken: this holds for about one in 200 of the others,
in all texts alike.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import written

LOW, HIGH = 0.002, 0.2
#: A text with fewer terms of the lexicon uses all of its terms.
FEWEST = 4
#: Slots of the lexicon's bitmap, as powers of two: the fewest, the most, and how many a term at least.
FEWEST_BITS, MOST_BITS, SPARE_BITS = 16, 24, 5
#: Each level keeps one term in so many (a power of two) of the level before, in as many subsets as WIDTH; the
#: hash bits that decide this start at FIRST_BIT, above those that the bitmap reads.
LEVELS, WIDTH, FIRST_BIT = (16, 4, 4, 4), 16, 12
PARTS = 1 + WIDTH * len(LEVELS)
#: Document ids in a block, in which the next document is looked up.
BLOCK = 1024


def term_hashes(text: Column) -> Column:
    """Distinct hashed terms of a text: lower-cased words between spaces and U+0009 to U+000D."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def slot(term: Column, bits: int) -> tuple[Column, Column]:
    """The word of a term in a bitmap of 2^bits slots, and the mask of its two slots there."""
    one = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(term, shift).bitwiseAND(F.lit(63)).cast("int"))
    return F.shiftrightunsigned(term, 64 - bits + 6), one(0).bitwiseOR(one(6))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> list[int]:
    """The lexicon's bitmap, in 64-bit words; its size follows the lexicon, and so what comes to the driver.

    Null texts count as empty; a table without texts has an empty lexicon.  Each of n equal texts counts
    for one n-th, so copies together count once; only hashes of texts are shuffled to find them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The constant comes first: behind the text, it would only hash the first key again.
    keys = {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}
    hashes = written(docs.select(*[c.alias(k) for k, c in keys.items()]).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")), "text-hashes")
    total = hashes.count()
    copies = written(hashes.filter("n > 1"), "copies")
    terms = docs.select(*[c.alias(k) for k, c in keys.items()], term_hashes(text).alias("terms")).join(copies, ["k1", "k2"], "left")
    weighed = terms.select(F.explode("terms").alias("term"), (1 / F.coalesce("n", F.lit(1))).alias("w"))
    frequency = weighed.groupBy("term").agg(F.round(F.sum("w")).alias("n"))
    banded = written(frequency.filter((F.col("n") >= max(2.0, low * total)) & (F.col("n") <= high * total)).select("term"), "lexicon")
    bits = min(MOST_BITS, max(FEWEST_BITS, banded.count().bit_length() + SPARE_BITS))
    word, mask = slot(F.col("term"), bits)
    out = [0] * (1 << bits - 6)
    for r in banded.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("mask")).collect():  # a row for each of 2^18 words at most
        out[r["word"]] = r["mask"]
    return out


def _thinned(before: str, level: int) -> Column:
    """The subsets of a level: of each subset of the level before, one term in LEVELS[level], by bits of its hash."""
    step = LEVELS[level].bit_length() - 1
    shift = FIRST_BIT + sum(n.bit_length() - 1 for n in LEVELS[:level])
    return F.transform(before, lambda terms, j: F.filter(terms, lambda t: F.shiftright(t, shift).bitwiseAND(F.lit((1 << step) - 1)) == F.pmod(j, F.lit(1 << step))))


def with_parts(df: DataFrame, text: Column, bitmap: list[int], out: str) -> DataFrame:
    """Add the fingerprint parts of a text as an array of 32-bit numbers in longs; 0 stands for no terms.

    A text with fewer than FEWEST terms of the lexicon uses all of its terms.  Membership in the randomised
    subsets is read from bits of a term's hash, so each term is hashed once.
    """
    bits = F.from_json(F.lit(json.dumps(bitmap)), "array<bigint>")

    def keep(t: Column) -> Column:
        word, mask = slot(t, (64 * len(bitmap)).bit_length() - 1)
        return F.get(bits, word.cast("int")).bitwiseAND(mask) == mask

    digest = lambda a: F.when(F.size(a) == 0, F.lit(0)).otherwise(F.xxhash64(a).bitwiseAND(F.lit(0xFFFFFFFF)))
    df = df.withColumn("_all", term_hashes(text))
    df = df.withColumn("_in", F.filter("_all", keep))
    df = df.withColumn("_s", F.array_sort(F.when(F.size("_in") < FEWEST, F.col("_all")).otherwise(F.col("_in")))).drop("_all", "_in")
    df = df.withColumn("_0", F.array_repeat("_s", WIDTH))
    for level in range(len(LEVELS)):
        df = df.withColumn(f"_{level + 1}", _thinned(f"_{level}", level))
    parts = F.concat(F.array(digest(F.col("_s"))), *[F.transform(f"_{level + 1}", digest) for level in range(len(LEVELS))])
    return df.withColumn(out, parts).drop("_s", *[f"_{level}" for level in range(len(LEVELS) + 1)])


def as_text(parts: Column) -> Column:
    """A fingerprint as text: 8 hex digits a part."""
    return F.array_join(F.transform(parts, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing parts, of those that either text has terms in; 1 for two texts without terms."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(None)).otherwise((x == y).cast("int")))
    known = F.filter(pairs, lambda p: p.isNotNull())
    total = F.aggregate(known, F.lit(0), lambda s, p: s + p)
    return F.when(F.size(known) == 0, F.lit(1.0)).otherwise(total.cast("double") / F.size(known))


def blocks_before(blocks: DataFrame) -> DataFrame:
    """(block, before): the block that precedes each of the distinct blocks; the first follows the last.

    The blocks are dealt out by range.  Only one row for each of these ranges is ordered in a single task.
    """
    dealt = written(blocks.repartitionByRange(F.col("block")).select("block", F.spark_partition_id().alias("range")), "block-ranges")
    ends = dealt.groupBy("range").agg(F.max("block").alias("last"))
    everywhere = Window.orderBy("range")
    all_ranges = everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = written(ends.select("range", F.coalesce(F.lag("last").over(everywhere), F.max("last").over(all_ranges)).alias("end_before")), "range-ends")
    within = Window.partitionBy("range").orderBy("block")
    return dealt.join(ends, "range").select("block", F.coalesce(F.lag("block").over(within), "end_before").alias("before"))


def with_next(docs: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """Add next_<column> of the document with the next larger id; after the last comes the first.

    Ids are cut into blocks.  The first document of each block also stands, as a guest, at the end of the
    block before it, so one shuffle by block and a window within blocks find all successors.  Of rows that
    repeat an id the one with the smallest hash is the next of the document before, and all of them have
    the same next.  Rows with a null id have none, and are nobody's next.
    """
    ids = written(docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")), "ids")
    block = F.floor(F.col(id_col) / BLOCK)
    firsts = written(ids.groupBy(block.alias("block")).agg(F.min(id_col).alias("first")), "blocks")
    guests = written(firsts.join(blocks_before(firsts.select("block")), "block").select("first", F.col("before").alias("host")), "guests")
    repeated = ids.filter("n > 1").select(id_col)
    some_repeated = not repeated.isEmpty()
    rows = docs.filter(F.col(id_col).isNotNull())
    if some_repeated:
        repeated = written(repeated, "repeated-ids")
        again = rows.join(repeated, id_col, "left_semi")
        least = again.groupBy(id_col).agg(F.min_by(F.struct(*carried), F.xxhash64(*carried)).alias("_row")).select(id_col, "_row.*")
        rows = rows.join(repeated, id_col, "left_anti").select(id_col, *carried).unionByName(least)
    own = F.struct(block.alias("block"), F.lit(False).alias("guest"))
    rows = rows.join(guests, F.col(id_col) == F.col("first"), "left").drop("first")
    places = F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("host").alias("block"), F.lit(True).alias("guest"))))
    rows = rows.withColumn("place", F.explode(places)).select("*", "place.block", "place.guest").drop("place", "host")
    order = Window.partitionBy("block").orderBy("guest", id_col)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    rows = rows.filter(~F.col("guest")).select(id_col, *carried, *[f"next_{c}" for c in carried])
    if some_repeated:
        nexts = rows.join(repeated, id_col, "left_semi").select(id_col, *[f"next_{c}" for c in carried])
        rows = rows.join(repeated, id_col, "left_anti").unionByName(again.select(id_col, *carried).join(nexts, id_col).select(rows.columns))
    none = docs.filter(F.col(id_col).isNull()).select(id_col, *carried, *[F.lit(None).cast(docs.schema[c].dataType).alias(f"next_{c}") for c in carried])
    return rows.unionByName(none)


def fingerprints(docs: DataFrame, bitmap: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of every text, as text.

    Returns id, fingerprint: one row per input row.  Null and empty texts, and texts of white space, have
    the all-zero fingerprint.  Equal texts have equal fingerprints; term order and counts play no part.
    """
    chosen = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return with_parts(chosen, F.col("_text"), bitmap, "_parts").select(F.col(id_col), as_text(F.col("_parts")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the next text's beginning.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  Null
    texts are taken as empty; an empty table gives no rows; the only document is its own next.  Rows that
    repeat an id all stay and have one next (see `with_next`); a row with a null id has none, and its
    edited text ends with its first half.  Texts are read whole; other columns are left out.
    """
    bitmap = lexicon(docs, text_col, low, high)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(with_parts(rows, F.col("text"), bitmap, "parts"), "id", ["text", "parts"])
    length = F.char_length("text")
    half = F.floor(length / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), length - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("id", "parts", F.coalesce("next_parts", F.array_repeat(F.lit(0).cast("long"), PARTS)).alias("next_parts"), length.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = with_parts(rows, F.col("edited"), bitmap, "edited_parts")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("parts")).alias("fingerprint"), as_text(F.col("edited_parts")).alias("edited_fingerprint"),
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"), likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
    )
