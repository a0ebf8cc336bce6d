"""Links and components at scale: grouped maps in bounded chunks, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mark, release, written

EDGES = "a long, b long"
EDGES_PER_TASK = 200_000


def map_groups(df: DataFrame, keys: Sequence[str], each: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply `each` to the rows of every group, many small groups to a task.

    Groups are brought together by one shuffle and a sort on the keys; a group is held in memory whole, so
    callers bound their groups.
    """
    first, rest = keys[0], list(keys[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for lo, hi in zip(starts, starts[1:]):
                key = tuple(c[lo] for c in columns)
                if last is not None and key != last:
                    yield from each(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = key
        if held:
            yield from each(pa.Table.from_batches(held))

    return df.repartition(F.col(first), *map(F.col, rest)).sortWithinPartitions(first, *rest).mapInArrow(run, schema)


def edge_batch(a: Sequence[int], b: Sequence[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class Forest:
    """Components of the rows of one group, with the links that join them."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.label = np.arange(len(ids))
        self.a: list[int] = []
        self.b: list[int] = []

    def join(self, i: int, others: np.ndarray) -> None:
        """Link row i with rows that it is similar to; only links between components are noted."""
        for j in others:
            if self.label[i] != self.label[j]:
                self.a.append(int(self.ids[i]))
                self.b.append(int(self.ids[j]))
                self.label[self.label == self.label[j]] = self.label[i]

    def edges(self) -> Iterator[pa.RecordBatch]:
        if self.a:
            yield edge_batch(self.a, self.b)


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) for every node of an edge list (a, b): root is the smallest node of its component.

    Large-star and small-star steps in turn: each hangs the neighbours of a node on the smallest one.  All
    steps are joins and partial aggregates, and each round is written to the shared folder, so no driver
    holds a component and a lost executor costs one round.  The list is read in as many partitions as it
    has EDGES_PER_TASK edges; a short list is one partition, which needs no shuffle.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    start = mark()
    edges = written(edges, tag)
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        edges = edges.coalesce(max(1, -(-state[0] // EDGES_PER_TASK)))
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        hung = F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))
        small = large.join(low, "a").select(F.explode(hung).alias("e")).select("e.a", "e.b").filter("a <> b")
        edges = written(small.distinct(), tag)
        release(start)  # the round before


#: Chunks of stragglers from which on a group is dealt out by finer keys.
CROWDED = 32


def link_groups(rows: DataFrame, link: Callable[[pa.Table, np.ndarray, np.ndarray], Forest], payload: Sequence[str], chunk_rows: int, chunk_bytes: int = 32 << 20, pivots: int = 64, finer: DataFrame | None = None, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) that give the components of "similar and in one group", without emitting all pairs.

    `rows` holds group, id, bytes and the payload columns, a written table, and comp if some rows are known
    to be linked.  `link(table, comp, probe)` looks at the rows of one chunk: with no probe rows at all pairs
    whose `comp` differ, else at pairs of a probe row with any row.  A group that fits a chunk is compared
    whole.  A larger one is dealt into chunks by hash, each with the same few pivots, which joins what is
    alike across chunks; then the rows outside the largest component of their group are compared with every
    chunk, so no link between components is missed and no task holds more than two chunks.

    Where such stragglers fill more than `crowded` chunks, as many unlike texts with a common part do, comparing
    each with all is left out: `finer` (id, keys) deals the rows of such a group out once more by further
    keys, of which similar rows share one but for a stated probability, and these groups are worked alike.
    """
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total"))
    sizes = sizes.select("group", "n", F.greatest(F.ceil(F.col("n") / chunk_rows), F.ceil(F.col("total") / chunk_bytes)).cast("int").alias("chunks"))
    sizes = written(sizes.filter("n > 1"), "group-sizes")
    extra = ["comp", "probe"]

    def each(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows > 1:
            comp = table.column("comp").to_numpy()
            yield from link(table, comp, table.column("probe").to_numpy().astype(bool)).edges()

    def compare(chosen: DataFrame, keys: list[str]) -> DataFrame:
        return map_groups(chosen.select(*keys, "id", *payload, *extra), keys, each, EDGES)

    known = F.col("comp") if "comp" in rows.columns else F.col("id")
    base = rows.join(sizes, "group").withColumns({"comp": known, "probe": F.lit(False)})
    found = compare(base.filter("chunks = 1"), ["group"])
    large = sizes.filter("chunks > 1")
    if large.isEmpty():
        return found
    spread = lambda df, n: df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    own = base.filter("chunks > 1").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks")).cast("int"))
    own = written(own, "group-chunks")
    chosen = F.pmod(F.xxhash64("id", F.lit(11)), F.greatest(F.lit(1), F.floor(F.col("n") / pivots))) == 0
    lead = spread(own.filter(chosen).withColumnRenamed("chunk", "home"), "chunks").filter("chunk <> home").drop("home")
    first = written(compare(own.unionByName(lead), ["group", "chunk"]), "links")
    before = own.select(F.col("id").alias("a"), F.col("comp").alias("b")).filter("a <> b")
    comp = components(first.unionByName(before))
    placed = own.drop("comp").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
    placed = written(placed, "group-placed")
    most = placed.groupBy("group", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("group").agg(F.max_by("comp", F.struct("k", "comp")).alias("giant"))
    rest = written(placed.join(written(most, "giants"), "group").filter("comp <> giant").drop("giant"), "stragglers")
    found = found.unionByName(first)
    if rest.isEmpty():
        return found
    parts = rest.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("parts"))
    parts = written(parts, "parts")
    if finer is not None:
        full, parts = parts.filter(F.col("parts") > crowded).select("group"), parts.filter(F.col("parts") <= crowded)
        if not full.isEmpty():
            found = found.unionByName(_dealt_finer(placed, rest, full, finer, link, payload, chunk_rows, chunk_bytes, pivots))
    probes = spread(rest.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("id", F.lit(13)), F.col("parts")).cast("int")).drop("chunk"), "chunks").withColumn("probe", F.lit(True))
    hosts = placed.join(parts, "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return found.unionByName(compare(hosts.unionByName(probes), ["group", "chunk", "part"]))


def _dealt_finer(placed: DataFrame, rest: DataFrame, full: DataFrame, finer: DataFrame, link: Callable, payload: Sequence[str], chunk_rows: int, chunk_bytes: int, pivots: int) -> DataFrame:
    """Links among the rows of crowded groups that share a finer key; groups without a straggler, or of one component, are passed over."""
    marked = placed.join(full, "group").join(rest.select("group", "id", F.lit(True).alias("late")), ["group", "id"], "left")
    keyed = marked.join(finer, "id").select(F.explode(F.transform("keys", lambda x: F.xxhash64("group", x))).alias("finer"), "id", "comp", "bytes", "late", *payload)
    keyed = written(keyed, "finer-rows")
    worth = keyed.groupBy("finer").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_or(F.coalesce("late", F.lit(False))).alias("some")).filter("lo < hi and some").select("finer")
    rows = keyed.join(written(worth, "finer-groups"), "finer").select(F.col("finer").alias("group"), "id", "comp", "bytes", *payload)
    return link_groups(written(rows, "finer-chosen"), link, payload, chunk_rows, chunk_bytes, pivots)
