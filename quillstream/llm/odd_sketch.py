"""Near-duplicate texts by MinHash bands, odd sketches and an exact check.

A text is the set of its distinct shingles of five words.  MinHash samples of the set are banded for
candidates, and folded into an odd sketch: a bitmap in which every sample flips one bit.  The population
count of the XOR of two sketches estimates the size of their samples' difference, precisely where
similarity is high, so it sorts out candidates without the sets.  Candidates that pass, with a margin
of several standard deviations under the threshold, form provisional clusters; within these the full
sets decide every link.

Texts with equal sets are one class from the start, so exact copies never meet in a bucket.  Buckets and
clusters of any size are worked in bounded chunks (`grouping.link_groups`); links between texts that are
in one component already need no test, so a large group of near copies costs about one test a text.  A
bucket with very many texts that are not alike (a common part that fills a band) is dealt out once more by
bands of the samples that the first bands leave: it would take time in proportion to its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow, slices, written
from .grouping import Forest, components, link_groups

WORDS = 5
SAMPLES, BANDS, ROWS, SKETCH_BITS = 256, 32, 4, 512
#: Standard deviations of the sketch's estimate that a candidate may be under the threshold.
MARGIN = 4.5

_seeds = np.random.default_rng(20240229)
_A = _seeds.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_B = _seeds.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a text in UTF-8: A-Z lower-cased, cut at space and U+0009 to U+000D."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~_SPACE[raw]
    if not inside.any():
        return np.zeros(0, dtype=np.uint64)
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    chars = _LOWER[raw[inside]].astype(np.uint64) + np.uint64(1)
    lengths = np.add.reduceat(inside.astype(np.int64), starts)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    longest = int(lengths.max())
    powers = np.full(longest, _POWER, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    # Mixing each character with its place makes the sum depend on the order of the characters.
    return _mix(np.add.reduceat(_mix(chars * powers[place] + place.astype(np.uint64)), first) + lengths.astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of fewer words than a shingle all are one; none without words."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    size = min(WORDS, len(words))
    rolled = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        rolled = rolled * _POWER + words[i : len(words) - size + 1 + i]
    return np.unique(_mix(rolled))


def minhash(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of the sample functions."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(low), 512):
        part = low[start : start + 512]
        best = np.minimum(best, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1))
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band."""
    rows = samples[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * _POWER
    for i in range(ROWS):
        key = _mix(key ^ rows[:, i])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of the samples, as 64-bit words."""
    bits = _mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    odd = (np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def most_differing_bits(similarity: float, margin: float = MARGIN) -> int:
    """How many bits two sketches may differ in, `margin` deviations beyond what `similarity` gives."""
    change = 2 * SAMPLES * (1 - similarity)
    decay = np.exp(-2 * change / SKETCH_BITS)
    variance = 4 * SAMPLES * similarity * (1 - similarity) + SKETCH_BITS / 4 * (1 - decay**2) / decay**2
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-2 * (change + margin * np.sqrt(variance)) / SKETCH_BITS))))


def estimate(differing_bits: int) -> float:
    """Similarity that a number of differing bits stands for."""
    share = min(1 - 2 * differing_bits / SKETCH_BITS, 1.0)
    return max(0.0, 1 + SKETCH_BITS / 2 * np.log(max(share, 1e-9)) / (2 * SAMPLES))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set_key (16 bytes; null for an empty set), sketch (bytes), bands and finer bands of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                counts, keys, sketches, bands, finer = [], [], [], [], []
                for text in part.column("text"):
                    found = shingles(text.as_py())
                    counts.append(len(found))
                    if not len(found):
                        keys.append(None), sketches.append(None), bands.append(None), finer.append(None)
                        continue
                    samples = minhash(found)
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                    sketches.append(odd_sketch(samples).tobytes())
                    bands.append(band_keys(samples))
                    finer.append(band_keys(samples[BANDS * ROWS :]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(finer, pa.list_(pa.int64()))],
                    names=["id", "n_shingles", "set_key", "sketch", "bands", "finer"],
                )

    return map_in_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, n_shingles long, set_key binary, sketch binary, bands array<long>, finer array<long>")


def _by_sketch(most: int):
    """Compares the rows of a bucket by their sketches."""

    def link(table: pa.Table, comp: np.ndarray, probe: np.ndarray) -> Forest:
        forest, words = _start(table, comp)
        rows = np.flatnonzero(probe) if probe.any() else range(len(words) - 1)
        for i in rows:
            rest = np.arange(len(words)) if probe.any() else np.arange(i + 1, len(words))
            near = np.bitwise_count(words[rest] ^ words[i]).sum(axis=1, dtype=np.int64) <= most
            forest.join(i, rest[near & (forest.label[rest] != forest.label[i])])
        return forest

    return link


def _start(table: pa.Table, comp: np.ndarray) -> tuple[Forest, np.ndarray]:
    """A forest in which rows of one component are one already, and the sketches of the rows."""
    forest = Forest(table.column("id").to_numpy())
    forest.label = np.unique(comp, return_inverse=True)[1]
    words = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint64).reshape(-1, SKETCH_BITS // 64)
    return forest, words


def _by_sets(percent: int, most: int):
    """Compares the texts of a cluster: those whose sketches allow a link by their full sets."""

    def link(table: pa.Table, comp: np.ndarray, probe: np.ndarray) -> Forest:
        forest, words = _start(table, comp)
        sets = [shingles(t.as_py()) for t in table.column("text").combine_chunks()]
        sizes = np.array([len(s) for s in sets])
        rows = np.flatnonzero(probe) if probe.any() else range(len(sets) - 1)
        for i in rows:
            rest = np.arange(len(sets)) if probe.any() else np.arange(i + 1, len(sets))
            fits = 100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])
            differ = np.bitwise_count(words[rest] ^ words[i]).sum(axis=1, dtype=np.int64)
            fits &= (differ <= most) & (forest.label[rest] != forest.label[i])
            order = np.argsort(differ[fits], kind="stable")  # likeliest first: what it joins needs no test
            for j in rest[fits][order]:
                if forest.label[i] != forest.label[j]:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                        forest.join(i, [j])
        return forest

    return link


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Components of texts whose shingle sets overlap by `percent` of their union or more.

    Returns id, n_shingles, component_id (smallest id of the component) and kept (id is that): one row
    per input row.  Null texts and texts without words have 0 shingles and link with nothing.  Equal sets
    always link.  Rows that share an id count as one document, so they share a component; a null id links
    with nothing.  Texts are read whole; other columns are left out.
    """
    signed = written(signatures(docs, id_col, text_col), "signatures")
    usable = signed.filter("set_key is not null and id is not null")
    classes = written(usable.groupBy("set_key").agg(F.min("id").alias("id"), F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands"), F.any_value("finer").alias("finer")), "classes")
    keyed = classes.select("id", F.explode("bands").alias("group"))
    shared = written(keyed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group"), "buckets")
    rows = keyed.join(shared, "group").join(classes.select("id", "sketch"), "id").select("group", "id", "sketch", F.lit(SKETCH_BITS // 8).alias("bytes"))
    rows = written(rows, "bucket-rows")
    most = most_differing_bits(percent / 100)
    clusters = written(components(link_groups(rows, _by_sketch(most), ["sketch"], chunk_rows=2048, finer=classes.select("id", F.col("finer").alias("keys")))), "clusters")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    members = clusters.select(F.col("node").alias("id"), F.col("root").alias("group")).join(classes.select("id", "sketch"), "id")
    members = texts.join(members, "id").select("group", "id", "text", "sketch", F.octet_length("text").alias("bytes"))
    links = link_groups(written(members, "cluster-texts"), _by_sets(percent, most), ["text", "sketch"], chunk_rows=1024)
    same = usable.join(classes.select("set_key", F.col("id").alias("first")), "set_key").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    roots = components(links.unionByName(same))
    root = F.coalesce("root", "id")
    return (
        signed.select("id", "n_shingles").join(written(roots, "roots"), F.col("id") == F.col("node"), "left")
        .select(F.col("id").alias(id_col), "n_shingles", root.alias("component_id"), F.coalesce(root == F.col("id"), F.lit(True)).alias("kept"))
    )
