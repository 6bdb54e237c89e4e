"""Embedding near-dedup by a subspace pigeonhole join that copies no vector.

Two unit vectors with cosine c are at squared distance 2 - 2c, the budget. After
a rotation the coordinates are cut into blocks, and what two vectors are apart in
the blocks adds up to their distance. A pair within the budget is within its share
in at least one block; more than that, lower bounds in the blocks add up to at
most the budget. A pair for which they do not is no link, and no link is missed.

Equal vectors are one row with a count before anything else. The others are
written once, in parts of some thousands as packed rows, and every two parts meet
by reading the written table again (a product without a shuffle): disk follows
the number of vectors, whatever the number of pairs. A part is halved into cells,
along the direction in which its vectors differ most. Of two cells the balls in
the blocks bound all pairs at once; of two vectors the first coordinates count as
they are and each block of the others by its length, so one narrow matrix product
bounds many pairs. What is left is decided by the cosine of the full vectors in
double precision. Every pair is met in one task only and is never written out: a
task returns how many links each vector has and the edges of a spanning forest.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import FloatType

from demandspark.llm.common import releasing_map, table
from demandspark.llm.components import components
from demandspark.session import BATCH_LIMIT, bound_batches, new_stage_path, stage


@dataclass(frozen=True)
class CosineRules:
    least: float = 0.95
    block_dims: int = 16
    part: int = 32_768
    """Vectors in one part at most."""
    first_grid: int = 10_000
    """Vectors up to which one cut makes the cells of a part; each further one serves three times as many."""

    @property
    def budget(self) -> float:
        return 2 - 2 * self.least


#: Added to every budget, far above rounding and far below any budget.
SLACK = 1e-7
#: The same for cosines in single precision, and for those that a product of matrices gives in double precision.
SINGLE, DOUBLE = 1e-5, 1e-12
#: Bytes of vectors in one part at most; numbers gathered at once for exact cosines; links kept until their rows are joined.
PART_BYTES, GATHERED, WAITING = 8 << 20, 1 << 20, 1 << 18
#: Rows of a tile of pairs that one product bounds, and its pairs at most: they stay in a core's cache. Halvings at most: cells of a full tile.
TILE_ROWS, TILE, MOST_CUTS = 512, 1 << 18, 6
#: A tile with more than one hit in so many pairs gets a product of all coordinates, in single and in double precision.
MANY, FULL = 256, 8
#: Parts that a build task makes, where the table has enough; those of a slice of the table, and those a worker keeps prepared.
BUILT_PARTS, SLICE_PARTS, KEPT_PARTS = 4, 3, 5


@functools.lru_cache(8)
def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(first: int, end: int, rules: CosineRules) -> list[tuple[int, int]]:
    """(first, end) of each block of these coordinates."""
    dims = end - first
    n = min(dims, max(1, round(dims / rules.block_dims)))
    cuts = [first + round(dims * i / n) for i in range(n + 1)] if n else []
    return list(zip(cuts, cuts[1:]))


def turned(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in the rotated space; zeros for those whose length has no double."""
    with np.errstate(all="ignore"):
        unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    unit[~np.isfinite(unit).all(1)] = 0
    return unit @ rotation(vectors.shape[1]).T


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def grid_dims(n: int, rules: CosineRules) -> int:
    return 1 + max(0, math.ceil(math.log(max(n, 1) / rules.first_grid, 3)))


def cell_cuts(n: int, cuts: int) -> list[int]:
    """Where the cells of n rows begin and end that are halved so many times."""
    return [n * i >> cuts for i in range((1 << cuts) + 1)]


def in_cells(vectors: np.ndarray, cuts: int) -> np.ndarray:
    """An order of the rows in which each cell is half of a larger one, by the direction in which its rows differ most."""
    n = len(vectors)
    y, order = turned(vectors).astype(np.float32), np.arange(n)
    for level in range(cuts):
        for i in range(1 << level):
            first, half, end = n * i >> level, n * (2 * i + 1) >> (level + 1), n * (i + 1) >> level
            if not first < half < end:
                continue
            rows = y[order[first:end]]
            rows -= rows.mean(0)
            along = rows[np.argmax(np.einsum("ij,ij->i", rows, rows))]
            for _ in range(4):
                along = rows.T @ (rows @ along)
                along /= max(float(np.sqrt(along @ along)), 1e-30)
            order[first:end] = order[first:end][np.argpartition(rows @ along, half - first)]
    return order


def part_rows(dims: int, width: int, rules: CosineRules) -> int:
    return max(1, min(rules.part, PART_BYTES // (dims * width)))


def _parts(rules: CosineRules, cuts: int, kind: str):
    """Rows of (node, times, vector) as packed parts of vectors of one length, in the order of their cells."""

    def packed(node: np.ndarray, times: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        dims, order = x.shape[1], in_cells(x.astype(np.float64), cuts)
        values = [c[order].tobytes() for c in (node, times, x)]
        return pa.RecordBatch.from_arrays(
            [pa.array([dims], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], names=["dims", "node", "times", "vector"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column("vector")], np.int64)
            for dims in np.unique(sizes).tolist():
                some = batch.take(pa.array(np.flatnonzero(sizes == dims)))
                x = some.column("vector").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)
                held = waiting.setdefault(dims, [])
                held.append((some.column("node").to_numpy(), some.column("times").to_numpy(), x))
                most = part_rows(dims, x.itemsize, rules)
                while sum(len(r[0]) for r in held) >= 2 * most:
                    node, times, x = (np.concatenate(c) for c in zip(*held))
                    yield packed(node[:most], times[:most], x[:most])
                    held[:] = [(node[most:], times[most:], x[most:])]
        for held in waiting.values():  # what is left, in equal parts
            node, times, x = (np.concatenate(c) for c in zip(*held))
            n = -(-len(x) // part_rows(x.shape[1], x.itemsize, rules))
            for i in range(n):
                rows = slice(len(x) * i // n, len(x) * (i + 1) // n)
                yield packed(node[rows], times[rows], x[rows])

    return run


class Part:
    """Vectors of one length, with what bounds their distances."""

    def __init__(self, node: np.ndarray, times: np.ndarray, x: np.ndarray, cuts: int, rules: CosineRules) -> None:
        self.node, self.times, self.x = node, times, x
        wide = x.astype(np.float64)
        self.norm = np.sqrt(np.einsum("ij,ij->i", wide, wide))
        y, dims = turned(wide), x.shape[1]
        single = math.ceil(dims / 3)
        lengths = [np.sqrt(np.square(y[:, a:z]).sum(1))[:, None] for a, z in blocks_of(single, dims, rules)]
        self.bound = np.hstack([y[:, :single], *lengths]).astype(np.float32)
        # The ball of each cell in each block.
        at = cell_cuts(len(x), cuts)
        self.cells = [(a, z) for a, z in zip(at, at[1:]) if a < z]
        blocks = blocks_of(0, dims, rules)
        self.centre = np.array([y[a:z].mean(0) for a, z in self.cells])
        far = lambda rows: [np.sqrt(np.square(rows[:, a:z]).sum(1).max()) for a, z in blocks]
        self.radius = np.array([far(y[a:z] - c) for (a, z), c in zip(self.cells, self.centre)])

    def units(self, rows: tuple[int, int]) -> np.ndarray:
        with np.errstate(all="ignore"):
            return self.x[slice(*rows)] / self.norm[slice(*rows), None]

    def near(self, other: Part, rules: CosineRules) -> np.ndarray:
        """Whether a pair within the budget can be in a cell of this part and one of the other."""
        total = np.zeros((len(self.cells), len(other.cells)))
        for k, (a, z) in enumerate(blocks_of(0, self.x.shape[1], rules)):
            gap = np.sqrt(np.square(self.centre[:, None, a:z] - other.centre[None, :, a:z]).sum(2))
            total += np.square(np.maximum(0, gap - self.radius[:, None, k] - other.radius[None, :, k]))
        return total <= rules.budget + SLACK


class Groups:
    """Rows that links have joined, each known by its first row."""

    def __init__(self, n: int) -> None:
        self.first = np.arange(n)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        self.waiting.append((i, j))
        self.held += len(i)
        if self.held > WAITING:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        i, j = (np.concatenate(c) for c in zip(*self.waiting))
        self.waiting, self.held = [], 0
        while True:
            a, b = self.first[i], self.first[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.first, np.maximum(a, b), np.minimum(a, b))
            while (after := self.first[self.first]).tobytes() != self.first.tobytes():
                self.first = after


def _exact(a: Part, b: Part, i: np.ndarray, j: np.ndarray, rules: CosineRules) -> np.ndarray:
    """Whether the cosine of each of these pairs is large enough."""
    out, step = np.zeros(len(i), bool), max(1, GATHERED // a.x.shape[1])
    for at in range(0, len(i), step):
        p, q = i[at : at + step], j[at : at + step]
        dot = np.einsum("ij,ij->i", a.x[p].astype(np.float64), b.x[q].astype(np.float64))
        with np.errstate(all="ignore"):
            out[at : at + step] = dot / (a.norm[p] * b.norm[q]) >= rules.least
    return out


def lowest_single(columns: int, rules: CosineRules) -> np.float32:
    """A product of so many columns in single precision is not below this for a link."""
    return np.float32(rules.least - SINGLE - 2 * columns * np.finfo(np.float32).eps)


def _tile_links(a: Part, b: Part, rows: tuple[int, int], cols: tuple[int, int], tile: np.ndarray, least: np.float32, rules: CosineRules):
    """(row of a, row of b) of the links in a tile of bounds; pairs are decided one by one if few and by products if many."""
    some = np.flatnonzero(tile.max(1) >= least)
    hit = tile[some] >= least
    if np.count_nonzero(hit) * MANY > tile.size:
        left, right = a.units(rows)[some], b.units(cols)
        hit = left.astype(np.float32) @ right.astype(np.float32).T >= lowest_single(left.shape[1], rules)
    if np.count_nonzero(hit) * FULL > tile.size:
        cosine = left @ right.T
        hit = cosine >= rules.least - DOUBLE
        # The product decides all but those it puts at the least cosine itself.
        i, j = np.nonzero(hit & (cosine <= rules.least + DOUBLE))
        hit[i, j] = _exact(a, b, some[i] + rows[0], j + cols[0], rules)
        i, j = np.nonzero(hit)
        i, j = some[i] + rows[0], j + cols[0]
    else:
        i, j = np.nonzero(hit)
        i, j = some[i] + rows[0], j + cols[0]
        found = _exact(a, b, i, j, rules)
        i, j = i[found], j[found]
    return (i[i < j], j[i < j]) if a is b else (i, j)


def linked(a: Part, b: Part, rules: CosineRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, first node of its group) of the vectors of two parts, or of one given twice, that have links with each other."""
    same = a is b
    after = 0 if same else len(a.node)
    node = a.node if same else np.concatenate([a.node, b.node])
    links, groups = np.zeros(len(node), np.int64), Groups(len(node))
    left, right = a.bound, np.ascontiguousarray(b.bound.T)
    least = lowest_single(len(right), rules)
    buffer, near = np.empty(TILE, np.float32), a.near(b, rules)
    for k, (first, end) in enumerate(a.cells):
        spans: list[list[int]] = []  # of b's rows, cells side by side together
        for m in np.flatnonzero(near[k]).tolist():
            if same and m < k:
                continue
            lo, hi = b.cells[m]
            if spans and spans[-1][1] == lo:
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
        for top in range(first, end, TILE_ROWS):
            rows = (top, min(end, top + TILE_ROWS))
            wide = TILE // (rows[1] - rows[0])
            for lo, hi in spans:
                for at in range(lo, hi, wide):
                    cols = (at, min(hi, at + wide))
                    shape = (rows[1] - rows[0], cols[1] - cols[0])
                    tile = np.matmul(left[slice(*rows)], right[:, slice(*cols)], out=buffer[: shape[0] * shape[1]].reshape(shape))
                    if tile.max() < least:
                        continue
                    i, j = _tile_links(a, b, rows, cols, tile, least, rules)
                    if len(i):
                        links[slice(*rows)] += np.bincount(i - rows[0], b.times[j], shape[0]).astype(np.int64)
                        links[after + cols[0] : after + cols[1]] += np.bincount(j - cols[0], a.times[i], shape[1]).astype(np.int64)
                        groups.join(i, after + j)
    groups.settle()
    touched = np.flatnonzero(links)
    return node[touched], links[touched], node[groups.first[touched]]


def _join_parts(rules: CosineRules, cuts: int, kind: str):
    kept: dict[int, Part] = {}

    def prepared(batch: pa.RecordBatch, k: int, side: str) -> Part:
        row = {c: batch.column(f"{side}_{c}")[k] for c in ("part", "dims", "node", "times", "vector")}
        key = row["part"].as_py()
        part = kept.pop(key, None)
        if part is None:
            node, times, x = (np.frombuffer(row[c].as_buffer(), t).copy() for c, t in (("node", np.int64), ("times", np.int64), ("vector", kind)))
            part = Part(node, times, x.reshape(len(node), row["dims"].as_py()), cuts, rules)
        kept[key] = part  # the one used last stands last
        while len(kept) > KEPT_PARTS:
            del kept[next(iter(kept))]
        return part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("a_dims")[k].as_py() == batch.column("b_dims")[k].as_py():
                    found = linked(prepared(batch, k, "a"), prepared(batch, k, "b"), rules)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["node", "links", "root"])
        kept.clear()

    return run


def digest(vector: str) -> Column:
    """What stands for a vector in a shuffle, the same for equal ones."""
    return F.xxhash64(vector)


def _pairs_of_parts(parts: DataFrame) -> DataFrame:
    """Every two parts once, and each with itself, in one row: no equality, so the written table is read again and nothing is shuffled."""
    a, b = (parts.select(*[F.col(c).alias(f"{side}_{c}") for c in parts.columns]) for side in "ab")
    p, q = F.col("a_part"), F.col("b_part")
    # Which of two comes first is drawn, so that every two slices of the table have work.
    drawn = F.xxhash64(F.least(p, q), F.greatest(p, q)) % 2 == 0
    return a.join(b, (p == q) | (p < q) & drawn | (p > q) & ~drawn)


def _found(nodes: DataFrame, rules: CosineRules) -> DataFrame:
    """(node, links, root), written: links of a node with the vectors of one or two parts, and an edge of their spanning forest."""
    spark, n = nodes.sparkSession, nodes.count()
    kind = "<f4" if isinstance(nodes.schema["vector"].dataType.elementType, FloatType) else "<f8"
    cuts = min(grid_dims(n, rules), MOST_CUTS)
    path = new_stage_path(spark, "stage")
    packed = (
        nodes.select("node", "times", "vector")
        .coalesce(max(1, -(-n // (BUILT_PARTS * rules.part))))
        .mapInArrow(releasing_map(_parts(rules, cuts, kind)), "dims int, node binary, times binary, vector binary")
        .withColumn("part", F.monotonically_increasing_id())
    )
    unbounded = spark.conf.get(BATCH_LIMIT, None) is None
    bound_batches(spark)  # rows of two parts go to Python one by one
    try:
        # A file for each part, so that a task gets a few of them however large its share of the table may be.
        packed.write.option("maxRecordsPerFile", 1).parquet(path)
        parts = spark.read.schema(packed.schema).parquet(path)
        # Two slices of the table are a task: several parts in a slice are read once for more pairs, if tasks enough are left.
        slices, tasks = -(-parts.count() // SLICE_PARTS), 4 * spark.sparkContext.defaultParallelism
        if slices * slices >= tasks:
            parts = parts.coalesce(slices)
        joined = _pairs_of_parts(parts).mapInArrow(releasing_map(_join_parts(rules, cuts, kind)), "node bigint, links bigint, root bigint")
        return stage(joined)
    finally:
        if unbounded:
            spark.conf.unset(BATCH_LIMIT)


def cosine_groups(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rules: CosineRules = CosineRules()
) -> DataFrame:
    """(id_col, n_links, component_id, kept), a row for each input row.

    Ids are integers. Vectors that are null, zero, or hold null or non-finite
    components link with nothing, nor do vectors of different lengths or rows
    with a null id (their component is null, and they are kept). Equal vectors
    link with each other; rows count one by one, and rows that share an id
    share its component.
    """
    slim = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    good = slim.where(usable(F.col("vector")) & F.col("id").isNotNull())
    # Rows that share an id can differ: the vector tells nodes apart, the id names them afterwards.
    nodes = stage(
        good.groupBy("vector")
        .agg(F.min("id").alias("lowest"), F.count(F.lit(1)).alias("times"))
        .select("vector", "lowest", "times", F.monotonically_increasing_id().alias("node"), digest("vector").alias("digest"))
    )
    found = _found(nodes, rules)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))

    # Names: the smallest id of a node; nodes that share an id are joined as well.
    named = nodes.select("node", "lowest")
    pairs = found.where("node != root").select("node", "root").distinct()
    edges = (
        pairs.join(named.select("node", F.col("lowest").alias("u")), "node")
        .join(named.select(F.col("node").alias("root"), F.col("lowest").alias("v")), "root")
        .select("u", "v")
    )
    # Rows find their node by the digest, or by the vector if two different ones share a digest.
    clash = nodes.groupBy("digest").count().where("count > 1").limit(1).count()
    key = "vector" if clash else "digest"
    keyed = good.select("id", "vector") if clash else good.select("id", digest("vector").alias("digest"))
    placed = stage(keyed.join(nodes.select(key, "node", "lowest", "times"), key).select("id", "node", "lowest", "times"))
    shared = placed.where("id != lowest").select(F.col("id").alias("u"), F.col("lowest").alias("v"))
    groups = stage(components(edges.unionByName(shared)))
    counted = stage(links)
    per_id = placed.select("id", "node", "times").join(counted, "node", "left")
    per_id = per_id.select("id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.lit(True).alias("ok"))
    # Unusable rows have no links; every row of the input is one of the two.
    bad = slim.where(~(usable(F.col("vector")) & F.col("id").isNotNull())).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.lit(False).alias("ok")
    )
    out = per_id.unionByName(bad).join(groups.withColumnRenamed("node", "id"), "id", "left")
    component = F.when(F.col("ok"), F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        "n_links",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return cosine_groups(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
low AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
deg AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, e.vec_id = c AS kept
FROM embeddings e JOIN low ON low.x = e.vec_id LEFT JOIN deg ON deg.x = e.vec_id
"""
