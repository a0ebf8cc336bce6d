"""Mixing sources to target weights by balanced sampling with the cube method.

Every source has a target size: a share of the whole by weight, at most `most` times what the source
holds, with the excess dealt out again.  A document is taken floor(f) whole times, f being target over
source size, and once more with the fractional rest as its inclusion probability.  The cube method
draws these extra copies: the vector of probabilities walks through the null space of the balancing
constraints (document total and token total), each step fixing at least one document at 0 or 1, until
at most two documents of a block are undecided.  The undecided of all blocks form the next, far smaller
level; the last level keeps a few documents of all lengths out of the walk, and these with the
undecided are the landing problem: of all choices the one that misses the totals least.

Blocks are hash groups within a source, so a hot source is many tasks and no task holds more than a
block.  All draws are keyed by seed, level, source and block: reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import word_count, written
from .grouping import map_groups

#: Documents in a block of the flight phase, about.
BLOCK = 2000
#: Documents that the last level keeps for the landing, besides the two that a flight may leave.
LANDING = 10
_EPS = 1e-9


def source_targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Targets of the sources, in code point order with null last, weights repeating.

    `share` times all sizes is dealt out by weight; a target stops at `most` times its source's size and
    the excess goes to the others by weight, until none is above.
    """
    order = sorted((name for name, _ in sizes), key=lambda name: (name is None, name or ""))
    weight = {name: weights[i % len(weights)] for i, name in enumerate(order)}
    cap = {name: most * size for name, size in sizes}
    left, open_, target = share * sum(size for _, size in sizes), set(order), {}
    while open_:
        unit = left / sum(weight[name] for name in open_)
        full = {name for name in open_ if unit * weight[name] > cap[name]}
        if not full:
            target |= {name: unit * weight[name] for name in open_}
            break
        target |= {name: float(cap[name]) for name in full}
        left -= sum(target[name] for name in full)
        open_ -= full
    return target


def flight(prob: np.ndarray, count: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities through the null space of both totals until two at most are fractional."""
    prob = prob.astype(float).copy()
    waiting = iter(np.flatnonzero((prob > _EPS) & (prob < 1 - _EPS)))
    active: list[int] = []
    draws = iter(rng.random(len(prob) + 4))
    while True:
        while len(active) < 3 and (nxt := next(waiting, None)) is not None:
            active.append(int(nxt))
        if len(active) < 3:
            return prob
        i, j, k = active
        a, b = (count[i], count[j], count[k]), (tokens[i], tokens[j], tokens[k])
        move = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
        if not any(move):  # the same tokens a document: one constraint holds both
            move = (a[1], -a[0], 0.0)
        _step(prob, active, move, next(draws))
        active = [x for x in active if _EPS < prob[x] < 1 - _EPS]


def landing(prob: np.ndarray, count: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide the last documents: of all 0/1 choices the one with the smallest miss of both totals.

    The token total counts in full, the document total by a tenth of the mean document; ties are drawn.
    """
    prob = prob.copy()
    open_ = rng.permutation(np.flatnonzero((prob > _EPS) & (prob < 1 - _EPS)))
    if len(open_):
        choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        change = choices - prob[open_]
        miss = np.abs(change @ tokens[open_]) + 0.1 * tokens.mean() * np.abs(change @ count[open_])
        prob[open_] = choices[int(miss.argmin())]
    return np.round(prob)


def _step(prob: np.ndarray, at: list[int], move: Sequence[float], draw: float) -> None:
    """One martingale step along +move or -move to the nearest face of the cube."""
    ahead = min(((1 - prob[x]) / m if m > 0 else prob[x] / -m) for x, m in zip(at, move) if m)
    back = min((prob[x] / m if m > 0 else (1 - prob[x]) / -m) for x, m in zip(at, move) if m)
    length = ahead if draw * (ahead + back) < back else -back
    for x, m in zip(at, move):
        if m:
            value = prob[x] + length * m
            prob[x] = 0.0 if value < _EPS else 1.0 if value > 1 - _EPS else value


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """How many words of each document the mix takes.

    Returns id, source, size, source_size, target, copies, taken: one row per input row.  Null texts have
    size 0 and so take nothing; a null source is a source of its own, the last.  Rows with equal id,
    source and size are taken alike.  An empty table gives no rows; other columns are left out.  Only
    sources, not documents, come to the driver: their number must be that of a configuration.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    units = (
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
        .groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    )
    units = written(units, "mix-units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("size"), F.count(F.lit(1)).alias("n")).collect()
    targets = source_targets([(r["source"], r["size"]) for r in sources], weights, share, most)
    plan = []
    for number, r in enumerate(sorted(sources, key=lambda r: (r["source"] is None, r["source"] or ""))):
        factor = targets[r["source"]] / r["size"] if r["size"] else 0.0
        whole = int(np.floor(factor + _EPS))
        plan.append((r["source"], number, r["size"], targets[r["source"]], whole, max(0.0, factor - whole), r["n"]))
    schema = T.StructType.fromDDL("source string, number int, source_size long, target double, whole int, extra double, n long")
    table = spark.createDataFrame(plan, schema)
    placed = (
        units.alias("u").join(table.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source")))
        .select("u.*", "s.number", F.when(F.col("size") > 0, F.col("s.extra")).otherwise(0.0).alias("prob"))
    )
    fields = [T.StructField("id", id_type), T.StructField("size", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("number", T.IntegerType()), T.StructField("prob", T.DoubleType())]
    out = T.StructType(fields)
    decided, level, most_units = None, 0, max([p[-1] for p in plan], default=0)
    todo = placed.select("id", "size", "rows", "number", "prob")
    while True:
        last = most_units <= BLOCK
        done = _level(todo, out, max(1, -(-most_units // BLOCK)), level, last, seed)
        done = written(done, f"mix-level{level}")
        settled = done if last else done.filter((F.col("prob") == 0) | (F.col("prob") == 1))
        decided = settled if decided is None else decided.unionByName(settled)
        if last:
            break
        todo, level = done.filter((F.col("prob") > 0) & (F.col("prob") < 1)), level + 1
        most_units = max([r["n"] for r in todo.groupBy("number").agg(F.count(F.lit(1)).alias("n")).collect()], default=0)
    copies = (F.col("s.whole") + F.col("d.prob").cast("long")).cast("long")
    return (
        decided.alias("d").join(table.alias("s"), "number")
        .select(F.col("d.id").alias(id_col), F.col("s.source").alias(source_col), "d.size", "s.source_size", "s.target", copies.alias("copies"), (copies * F.col("d.size")).alias("taken"), F.explode(F.sequence(F.lit(1), F.col("d.rows"))).alias("nth"))
        .drop("nth")
    )


def _spread(prob: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Marks LANDING undecided documents, evenly over the ranks by length."""
    open_ = np.flatnonzero((prob > _EPS) & (prob < 1 - _EPS))
    by_size = open_[np.argsort(tokens[open_], kind="stable")]
    held = np.zeros(len(prob), dtype=bool)
    if len(by_size):
        held[by_size[np.unique(np.linspace(0, len(by_size) - 1, LANDING).astype(int))]] = True
    return held


def _level(units: DataFrame, out: T.StructType, blocks: int, level: int, last: bool, seed: int) -> DataFrame:
    """One flight over hash blocks of the sources; at the last level also the landing."""
    names = [f.name for f in out.fields]

    def decide(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("size", "ascending")], null_placement="at_end"))
        number, block = table.column("number")[0].as_py(), table.column("block")[0].as_py()
        rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{seed}/{level}/{number}/{block}"))
        count = table.column("rows").to_numpy().astype(float)
        tokens = table.column("size").to_numpy().astype(float) * count
        order = rng.permutation(table.num_rows)
        prob = np.empty(table.num_rows)
        start, count, tokens = table.column("prob").to_numpy()[order], count[order], tokens[order]
        if last:
            held = _spread(start, tokens)
            moved = flight(np.where(held, 0.0, start), count, tokens, rng)
            prob[order] = landing(np.where(held, start, moved), count, tokens, rng)
        else:
            prob[order] = flight(start, count, tokens, rng)
        decided = table.set_column(table.column_names.index("prob"), "prob", pa.array(prob, pa.float64()))
        yield from decided.select(names).combine_chunks().to_batches()

    block = F.pmod(F.xxhash64("id", "size", F.lit(level)), F.lit(blocks)).cast("int")
    return map_groups(units.select(*names).withColumn("block", block), ["number", "block"], decide, out)
