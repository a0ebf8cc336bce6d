"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Equal vectors are one class.  Many trees split the classes again and again by random hyperplanes; what
lies near a hyperplane goes to both sides.  Vectors that share a leaf are compared by cosine in double
precision, every pair in the first tree where it shares one, so counts need no list of pairs.  Links
inside leaves are reduced to what joins components, and the components follow by star contraction.

Splits are fitted on a bounded sample (`SAMPLE` vectors) at medians of its projections; below the
sample's resolution directions come from a keyed generator and pass through the leaf's centre, so
depth follows the table and not the sample.

A dense ball (many vectors within half the linking angle of a centre) cannot be told apart by splits.
By the triangle inequality on angles all its members link with each other, so these links are counted
without comparing, and leaves only compare pairs that are not in one ball.

A loose group (many vectors that link, but lie further apart than a ball) has no such shortcut, and each
split would cut linked pairs of it. It is not split: every pair of it is compared, in blocks, and the
trees are for its links with other vectors. This takes time in proportion to the square of its size, as
its links do.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .grouping import components, map_groups

#: Vectors that the splits are fitted on, and their bytes in double precision at most (20,000 up to 800
#: dimensions); the forest that goes to every task is about twice as large.
SAMPLE, SAMPLE_BYTES = 20_000, 128 << 20
TREES = 12
LEAF = 256
#: Half-width of the spill zone around a split, as a share of a random projection's deviation, which is one
#: over the root of the dimensions for vectors of length 1: so copies and recall hardly depend on them.
SPILL = 0.1
#: Sample vectors that make a dense ball, at least.
BALL = 32
#: A vector is in a loose group if its cosine to the centre is at least the threshold to this power.
LOOSE = 0.75
#: Share of linked pairs that makes a loose group, at least.
LINKED = 0.05
#: Rows of a loose group that are compared at a time.
GROUP_CHUNK = 8192
#: Rows of a leaf that are compared at a time; larger leaves are worked in blocks of so many.
CHUNK = 2048


class Tree(NamedTuple):
    """Nodes of one tree: direction, threshold and children (a negative child is leaf ~child)."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    centres: np.ndarray
    extra: np.ndarray


def fit_tree(sample: np.ndarray, rows: int, seed: int) -> Tree:
    """Split the sample until leaves stand for LEAF of `rows` vectors, as far as the sample resolves."""
    rng = np.random.default_rng(seed)
    directions, thresholds, children, centres, extra = [], [], [], [], []

    def node(at: np.ndarray) -> int:
        share = rows * len(at) / max(1, len(sample))
        if share <= LEAF or len(at) < 16:
            centres.append(sample[at].mean(axis=0) if len(at) else np.zeros(sample.shape[1]))
            extra.append(max(0, int(np.ceil(np.log2(max(1.0, share / LEAF))))))
            return ~(len(centres) - 1)
        direction = rng.standard_normal(sample.shape[1])
        direction /= np.linalg.norm(direction)
        projected = sample[at] @ direction
        middle = float(np.median(projected))
        here = len(directions)
        directions.append(direction), thresholds.append(middle), children.append((0, 0))
        low = projected < middle
        if low.all() or not low.any():
            low = np.arange(len(at)) < len(at) // 2  # all on the plane: both sides get what lies there
        children[here] = (node(at[low]), node(at[~low]))
        return here

    root = node(np.arange(len(sample)))
    size = sample.shape[1]
    if root < 0:
        directions, thresholds, children = [np.zeros(size)], [0.0], [(root, root)]
    return Tree(np.array(directions, dtype=np.float32), np.array(thresholds), np.array(children), np.array(centres, dtype=np.float32), np.array(extra))


def leaves(tree: Tree, number: int, vectors: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf key) pairs of unit vectors in a tree; rows near a split are in several leaves."""
    row, at = np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64)
    done_row, done_leaf = [], []
    while len(row):
        away = np.einsum("ij,ij->i", vectors[row], tree.directions[at]) - tree.thresholds[at]
        both = [(row[side], tree.children[at[side], c]) for c, side in ((0, away < spill), (1, away >= -spill))]
        row, at = (np.concatenate(x) for x in zip(*both))
        end = at < 0
        done_row.append(row[end]), done_leaf.append(~at[end])
        row, at = row[~end], at[~end]
    row, leaf = np.concatenate(done_row), np.concatenate(done_leaf)
    pairs = np.unique(np.stack([row, leaf], axis=1), axis=0)
    row, leaf = pairs[:, 0], pairs[:, 1]
    key = np.array([xxhash.xxh64_intdigest(f"{number}/{x}") >> 2 for x in range(len(tree.centres))], dtype=np.int64)[leaf]
    depth = 0
    while (deeper := tree.extra[leaf] > depth).any():
        # Below the sample's resolution: a direction keyed by the node, through the leaf's centre.
        parts_row, parts_leaf, parts_key = [row[~deeper]], [leaf[~deeper]], [key[~deeper]]
        for k in np.unique(key[deeper]):
            mine = np.flatnonzero(deeper & (key == k))
            direction = np.random.default_rng(int(k)).standard_normal(vectors.shape[1])
            direction /= np.linalg.norm(direction)
            away = (vectors[row[mine]] - tree.centres[leaf[mine]]) @ direction
            for side, chosen in ((0, away < spill), (1, away >= -spill)):
                parts_row.append(row[mine][chosen]), parts_leaf.append(leaf[mine][chosen])
                parts_key.append(np.full(int(chosen.sum()), xxhash.xxh64_intdigest(f"{k}/{side}") >> 2, dtype=np.int64))
        row, leaf, key = (np.concatenate(x) for x in (parts_row, parts_leaf, parts_key))
        depth += 1
    return row, key


def fit_balls(sample: np.ndarray, half_angle: float, least: int = BALL) -> np.ndarray:
    """Centres of dense balls of the sample: most members first, until none has `least`."""
    near, cosine = np.zeros(len(sample), dtype=np.int64), np.cos(half_angle)
    single = sample.astype(np.float32)
    for start in range(0, len(sample), 1000):
        near[start : start + 1000] = (single[start : start + 1000] @ single.T >= cosine).sum(axis=1)
    free, centres = np.ones(len(sample), dtype=bool), []
    for i in np.argsort(-near, kind="stable"):
        if near[i] < least // 2:
            break
        if not free[i]:
            continue
        members = free & (sample @ sample[i] >= cosine)
        if members.sum() < least // 2:
            continue
        centre = sample[members].mean(axis=0)
        centre /= np.linalg.norm(centre)
        members = free & (sample @ centre >= cosine)
        if members.sum() >= least:
            centres.append(centre)
            free &= ~members
    return np.array(centres).reshape(-1, sample.shape[1])


def fit_groups(sample: np.ndarray, threshold: float, free: np.ndarray, least: int = BALL) -> np.ndarray:
    """Centres of loose groups of the `free` sample vectors: most links first, until none has `least`."""
    single, near = sample.astype(np.float32), np.zeros(len(sample), dtype=np.int64)
    for start in range(0, len(sample), 1000):
        near[start : start + 1000] = (single[start : start + 1000] @ single[free].T >= threshold).sum(axis=1)
    free, centres = free.copy(), []
    for i in np.argsort(-near, kind="stable"):
        if near[i] < least:
            break
        if not free[i]:
            continue
        members = free & (sample @ sample[i] >= threshold)
        if members.sum() < least // 2:
            continue
        centre = sample[members].mean(axis=0)
        centre /= np.linalg.norm(centre)
        members = free & (sample @ centre >= threshold**LOOSE)
        some = sample[np.flatnonzero(members)[:512]]
        if members.sum() >= least and (some @ some.T >= threshold).mean() >= LINKED + 1 / len(some):
            centres.append(centre)
            free &= ~members
    return np.array(centres).reshape(-1, sample.shape[1])


def group_key(group: int) -> int:
    """The leaf key of a loose group."""
    return xxhash.xxh64_intdigest(f"group/{group}") >> 2


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    # Scaling by the largest component first keeps squares of very large or small numbers in range.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, trees: int = TREES, seed: int = 5) -> DataFrame:
    """Links at a cosine of `threshold` or more, and their components.

    Returns id, n_links (other vectors linked directly), component_id (smallest id reachable) and kept (id
    is that): one row per input row.  Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing, as do vectors of unlike length.  Repeated rows count as other vectors.
    A null id keeps its links, and its component is that of its vector.  Other columns are left out.
    """
    element = "float" if table.schema[vector_col].dataType.elementType.typeName() == "float" else "double"
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite, F.lit(False))
    clean = F.transform("vector", lambda x: x + F.lit(0).cast(element))  # -0.0 becomes 0.0
    # Two hashes from unlike starts: the constant comes first, as behind the vector it would only hash k1 again.
    rows = rows.select("id", F.when(usable, F.xxhash64(clean)).alias("k1"), F.when(usable, F.xxhash64(F.lit(1), clean)).alias("k2"), F.when(usable, clean).alias("vector"))
    members = written(rows.select("id", "k1", "k2"), "vector-keys")
    classes = rows.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("weight"), F.any_value("vector").alias("vector"))
    classes = classes.withColumn("id", F.monotonically_increasing_id())  # written, so it stays
    classes = written(classes.withColumn("size", F.size("vector")), "vector-classes")
    counts, edges = None, None
    for r in classes.groupBy("size").count().collect():  # one pass for each vector length
        found, joined = _forest(classes.filter(F.col("size") == r["size"]), r["size"], r["count"], threshold, trees, seed)
        counts = found if counts is None else counts.unionByName(found)
        edges = joined if edges is None else edges.unionByName(joined)
    if counts is None:
        return members.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    total = counts.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(edges)
    linked = classes.select("id", "k1", "k2", "first", "weight").join(total, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    linked = written(linked.select("k1", "k2", "first", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")), "vector-links")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    by_key = written(linked.join(least, "root").select("k1", "k2", "n_links", "component_id"), "vector-result")
    component = F.coalesce("component_id", "id")
    return members.join(by_key, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _forest(classes: DataFrame, size: int, rows: int, threshold: float, trees: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(id, n) counts of linked others and (a, b) edges among classes of one vector length."""
    spark = classes.sparkSession
    kind = np.float32 if classes.schema["vector"].dataType.elementType.typeName() == "float" else np.float64
    picked = classes
    most = min(SAMPLE, max(512, SAMPLE_BYTES // (8 * size)))
    if rows > most:
        scale = 1 << 30
        picked = classes.filter(F.pmod(F.xxhash64("k1", F.lit(seed)), F.lit(scale)) < int(scale * most / rows) + 1).orderBy("k1", "k2")
    sample = unit(_matrix(picked.select("vector").toArrow().column(0), size))
    half = np.arccos(threshold) / 2 - 1e-7  # two members of a ball are within the linking angle, rounding included
    centres = fit_balls(sample, half)
    loose = fit_groups(sample, threshold, (sample @ centres.T).max(axis=1, initial=-1.0) < np.cos(half))
    fitted = spark.sparkContext.broadcast(([fit_tree(sample, rows, seed * 1000 + t) for t in range(trees)], centres, loose))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, balls, groups = fitted.value
        for batch in batches:
            if not batch.num_rows:
                continue
            given = _matrix(batch.column("vector"), size)
            vectors = unit(given)
            ball = np.full(len(vectors), -1)
            if len(balls):
                cosine = vectors @ balls.T
                ball = np.where(cosine.max(axis=1) >= np.cos(half), cosine.argmax(axis=1), -1)
            group = np.full(len(vectors), -1)
            if len(groups):
                cosine = vectors @ groups.T
                group = np.where((cosine.max(axis=1) >= threshold**LOOSE) & (ball < 0), cosine.argmax(axis=1), -1)
            inside = np.flatnonzero(group >= 0)
            keys = np.array([group_key(g) for g in range(len(groups))], dtype=np.int64)
            found = [(inside, keys[group[inside]])]  # before all trees
            found += [leaves(tree, t, vectors, SPILL / np.sqrt(size)) for t, tree in enumerate(forest)]
            row = np.concatenate([r for r, _ in found])
            key = np.concatenate([k for _, k in found])
            tree = np.repeat(np.arange(len(found)), [len(r) for r, _ in found])
            order = np.lexsort((key, tree, row))  # one order of leaves for all rows
            ends = np.cumsum(np.bincount(row, minlength=len(vectors)))
            all_leaves = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(key[order], pa.int64()))
            raw = pa.array([v.tobytes() for v in given], pa.binary())  # in its own precision, to keep the shuffle small
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("weight"), pa.array(ball, pa.int32()), pa.array(group, pa.int32()), raw, all_leaves],
                names=["id", "weight", "ball", "loose", "raw", "leaves"],
            )

    placed = classes.select("id", "weight", "vector").mapInArrow(place, "id long, weight long, ball int, loose int, raw binary, leaves array<long>")
    placed = written(placed, "placed")
    in_ball = placed.filter("ball >= 0").groupBy("ball").agg(F.sum("weight").alias("total"), F.min("id").alias("lead"))
    in_ball = placed.filter("ball >= 0").select("id", "weight", "ball").join(written(in_ball, "balls"), "ball")
    whole = in_ball.select("id", (F.col("total") - F.col("weight")).alias("n"))
    stars = in_ball.select(F.col("id").alias("a"), F.col("lead").alias("b"))

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        leaf = table.column("leaf")[0].as_py()
        ids, weight, ball, group = (table.column(c).to_numpy() for c in ("id", "weight", "ball", "loose"))
        whole_group = group[0] >= 0 and group_key(int(group[0])) == leaf
        across = "across" in table.column_names and table.column("across")[0].as_py()  # a pair of blocks
        block = table.column("block").to_numpy() if across else None
        vectors = unit(np.frombuffer(b"".join(table.column("raw").to_pylist()), dtype=kind).reshape(-1, size))
        earlier = None if whole_group else _earlier(table.column("leaves"), leaf)
        n = np.zeros(len(ids), dtype=np.int64)
        label, a, b = np.arange(len(ids)), [], []
        step = 512 if len(ids) <= 2 * CHUNK else 128
        for start in range(0, len(ids), step):
            part = slice(start, start + step)
            near = vectors[part] @ vectors.T >= threshold
            near &= np.arange(len(ids))[None, :] > np.arange(len(ids))[part, None]
            near &= (ball[part, None] != ball[None, :]) | (ball[part, None] < 0)
            if not whole_group:
                near &= (group[part, None] != group[None, :]) | (group[part, None] < 0)
            if block is not None:
                near &= block[part, None] != block[None, :]
            i, j = np.nonzero(near)
            if len(i) and earlier is not None:
                fresh = ~_share(earlier, i + start, j)
                i, j = i[fresh], j[fresh]
            if not len(i):
                continue
            i += start
            n += np.rint(np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))).astype(np.int64)
            rows, firsts = np.unique(i, return_index=True)
            for x, others in zip(rows, np.split(j, firsts[1:])):
                apart = others[label[others] != label[x]]
                if len(apart):
                    merged, at = np.unique(label[apart], return_index=True)
                    a += [int(ids[x])] * len(at)
                    b += ids[apart[at]].tolist()
                    label[np.isin(label, merged)] = label[x]
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(n[some], pa.int64()), pa.nulls(len(some), pa.int64())], names=["id", "n", "b"])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(b, pa.int64())], names=["id", "n", "b"])

    at_leaf = placed.select("id", "weight", "ball", "loose", "raw", "leaves", F.explode("leaves").alias("leaf"))
    sizes = written(placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().filter("count > 1"), "leaves")
    small = at_leaf.join(sizes.filter(F.col("count") <= CHUNK).select("leaf"), "leaf")
    compared = map_groups(small, ["leaf"], compare, "id long, n long, b long")
    large = sizes.filter(F.col("count") > CHUNK)
    if not large.isEmpty():  # every pair of blocks meets once
        blocks = at_leaf.join(large, "leaf").withColumn("blocks", F.ceil(F.col("count") / F.when(F.col("leaf") == F.get("leaves", F.lit(0)), F.when(F.col("loose") >= 0, GROUP_CHUNK).otherwise(CHUNK)).otherwise(CHUNK)).cast("int"))
        blocks = blocks.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
        blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        blocks = blocks.withColumn("pair", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
        blocks = blocks.withColumn("across", F.col("block") != F.col("other"))
        compared = compared.unionByName(map_groups(blocks.drop("count", "blocks", "other"), ["leaf", "pair"], compare, "id long, n long, b long"))
    compared = written(compared, "compared")
    counts = compared.filter("n is not null").select("id", "n").unionByName(whole)
    edges = compared.filter("b is not null").select(F.col("id").alias("a"), "b").unionByName(stars)
    return counts, edges


def _earlier(column: pa.ChunkedArray, leaf: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Leaves that stand before `leaf` in each row's list; all lists have one order, by tree and leaf.

    A pair that has one of these in common is counted there.
    """
    lists = column.combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.flatten().to_numpy()
    values, offsets = values[offsets[0] : offsets[-1]] if len(values) > offsets[-1] - offsets[0] else values, offsets - offsets[0]
    owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
    stop = np.full(len(lists), -1)
    hit = np.flatnonzero(values == leaf)
    stop[owner[hit]] = hit
    before = np.arange(len(values)) < stop[owner]
    if not before.any():
        return None
    names, column_of = np.unique(values[before], return_inverse=True)
    return owner[before], column_of


def _share(earlier: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j have an earlier leaf in common, pair by pair."""
    owner, leaf = earlier
    out = np.zeros(len(i), dtype=bool)
    width = int(leaf.max()) + 1
    words = -(-width // 64)
    bits = np.zeros((int(max(owner.max(), i.max(), j.max())) + 1, words), dtype=np.uint64)
    np.bitwise_or.at(bits, (owner, leaf // 64), np.uint64(1) << (leaf % 64).astype(np.uint64))
    for start in range(0, len(i), 1 << 16):
        part = slice(start, start + (1 << 16))
        out[part] = (bits[i[part]] & bits[j[part]]).any(axis=1)
    return out
