"""MinHash near-dedup: many universal hash minima, banding, verification, components.

1. Each text becomes its set of 5-word shingles (64-bit hashes), 160 minima of
   universal hash functions and 32 band keys of five minima. Equal sets are one
   node, the smallest id that has the set.
2. Nodes that share a band key are joined to the smallest of them; the
   components of these stars are the candidate clusters, so any two documents
   of one bucket are in one cluster. At similarity 0.85 a pair misses all bands
   with probability 7e-9, at 0.8 with 3e-6.
3. Within a cluster all pairs are verified: first by how many minima agree (so
   few that a link fails this with a thousandth of the chance that the bands miss
   it), then on the full shingle sets. A large cluster is cut into blocks, and every pair of
   blocks is a task of its own. A task gives the edges of a spanning forest of
   its links, never the links themselves.
4. The components of these edges are the groups.

Copies and near-copies are many in one group at times: equal sets collapse in a
partial aggregate, large clusters are spread over block pairs, and joins on a
key that many rows share stand between written tables, so that adaptive
execution can split them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from demandspark.llm.common import LOWER, byte_views, in_pieces, releasing_group, releasing_map, table, window_hashes, word_hashes
from demandspark.llm.components import components
from demandspark.session import stage


@dataclass(frozen=True)
class NearRules:
    words: int = 5
    percent: int = 80
    """Linked from this Jaccard similarity of the shingle sets, in percent."""
    bands: int = 32
    rows: int = 5
    block: int = 1024
    """Documents of one block of a large cluster."""
    broadcast_members: int = 200_000
    """Rows (id and cluster) up to which the members of clusters are broadcast to read their texts."""

    @property
    def band_miss(self) -> float:
        """Chance that no band is equal for a pair exactly at the threshold."""
        return (1 - (self.percent / 100) ** self.rows) ** self.bands

    @property
    def agreement(self) -> int:
        """Agreeing minima from which a pair is compared on its full sets.

        A pair at the threshold has fewer with a thousandth of the chance that
        the bands miss it, so this test loses next to nothing beyond them.
        """
        s, n, below, k = self.percent / 100, self.bands * self.rows, 0.0, 0
        while k < n:
            below += math.comb(n, k) * s**k * (1 - s) ** (n - k)
            if below > self.band_miss / 1000:
                break
            k += 1
        return k


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """Distinct shingle hashes in ascending order; of fewer words the whole sequence is one."""
    found = text.translate(LOWER).split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = word_hashes(found)
    width = min(words, len(h))
    return np.unique(window_hashes(h, width) ^ np.uint64(width))


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """One row of n minima (32 bits) for each set; no set may be empty."""
    a, b = _factors(n)
    out = np.empty((len(sets), n), np.uint32)
    at = 0
    while at < len(sets):  # pieces that stay in the processor's cache
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 32_768):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.cumsum([0] + [len(s) for s in sets[at : end - 1]])
        for k in range(n):
            h = flat * a[k]
            h += b[k]
            h >>= np.uint64(32)
            out[at:end, k] = np.minimum.reduceat(h, starts)
        at = end
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        part = signatures[:, b * rows : (b + 1) * rows].astype(np.uint64)
        keys[:, b] = window_hashes(part.ravel(), rows)[::rows] ^ np.uint64(b * 0x9E3779B97F4A7C15 & (2**64 - 1))
    return keys.view(np.int64)


def _features(rules: NearRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            sets = [shingles(t, rules.words) for t in byte_views(batch.column("text"))]
            full = [i for i, s in enumerate(sets) if len(s)]
            digests: list[bytes | None] = [None] * len(sets)
            for i in full:
                digests[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
            keys: list = [None] * len(sets)
            if full:
                found = band_keys(minima([sets[i] for i in full], rules.bands * rules.rows), rules.bands, rules.rows)
                for i, k in zip(full, found):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["id", "n", "digest", "bands"],
            )

    return run


def _sets(rules: NearRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            sets = [shingles(t, rules.words) for t in byte_views(batch.column("text"))]
            signatures = minima(sets, rules.bands * rules.rows)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("id", "cluster", "blocks", "block")],
                    pa.array([s.tobytes() for s in signatures], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["id", "cluster", "blocks", "block", "signature", "shingles"],
            )

    return run


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def spanning_links(sets, signatures: np.ndarray, sides: np.ndarray, rules: NearRules) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among these documents.

    With two sides (0 and 1) only pairs across them are compared.
    """
    n, forest, out = len(sets), _Forest(len(sets)), []
    sizes = np.array([len(s) for s in sets])
    least = rules.agreement
    two = sides.any() and not sides.all()
    for i in range(n - 1):
        others = np.arange(i + 1, n)
        if two:
            others = others[sides[i + 1 :] != sides[i]]
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[100 * small >= rules.percent * large]
        if not len(others):
            continue
        others = others[(signatures[others] == signatures[i]).sum(1) >= least]
        mine = forest.root(i)
        others = [j for j in others.tolist() if forest.root(j) != mine]
        if not others:
            continue
        flat = np.concatenate([sets[j] for j in others])
        starts = np.cumsum([0] + [len(sets[j]) for j in others[:-1]])
        place = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
        shared = np.add.reduceat((sets[i][place] == flat).astype(np.int64), starts)
        for j, both in zip(others, shared.tolist()):
            if 100 * both >= rules.percent * (len(sets[i]) + len(sets[j]) - both) and forest.join(i, j):
                out.append((i, j))
    return out


def _verify(rules: NearRules, arrow_id: pa.DataType):
    def run(rows: pa.Table) -> pa.Table:
        clusters = defaultdict(list)
        for i, c in enumerate(rows.column("cluster").to_pylist()):
            clusters[c].append(i)
        ids = rows.column("id").to_pylist()
        blocks = rows.column("block").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in byte_views(rows.column("shingles"))]
        signatures = np.array([np.frombuffer(b, np.uint32) for b in byte_views(rows.column("signature"))])
        u, v = [], []
        for members in clusters.values():
            members.sort(key=lambda i: ids[i])
            sides = blocks[members]
            found = spanning_links([sets[i] for i in members], signatures[members], sides != sides.min(), rules)
            u += [ids[members[a]] for a, _ in found]
            v += [ids[members[b]] for _, b in found]
        return pa.table({"u": pa.array(u, arrow_id), "v": pa.array(v, arrow_id)})

    return run


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: NearRules = NearRules()
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept), a row for each input row.

    Null and empty texts have no shingles and link with nothing. The id is the
    node: rows that repeat an id share its group. A null id links with nothing,
    has a null component and is kept.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = slim.schema["id"].dataType
    name = kind.simpleString()
    features = stage(slim.mapInArrow(releasing_map(_features(rules)), f"id {name}, n bigint, digest binary, bands array<bigint>"))
    full = features.where("digest is not null and id is not null")

    # One node for each set.
    nodes = stage(full.groupBy("digest").agg(F.min("id").alias("node")))
    placed = stage(full.select("id", "digest", "bands").join(nodes, "digest").select("id", "node", F.when(F.col("id") == F.col("node"), F.col("bands")).alias("bands")))
    banded = placed.where("bands is not null").select("node", F.explode("bands").alias("key"))
    leads = stage(
        banded.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead != last").select("key", "lead")
    )
    stars = banded.join(leads, "key").where("node != lead").select("node", "lead").distinct()

    # Candidate clusters, in blocks.
    clusters = stage(components(stars, "node", "lead"))
    sizes = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / rules.block).cast("int").alias("blocks"))
    members = stage(
        clusters.join(stage(sizes), "component").select(
            F.col("node").alias("id"),
            F.col("component").alias("cluster"),
            "blocks",
            F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"),
        )
    )
    n_members = members.count()
    side = F.broadcast(members) if n_members <= rules.broadcast_members else members
    texts = slim.where("text is not null").join(side, "id")
    signed = texts.select("id", "text", "cluster", "blocks", "block").mapInArrow(
        releasing_map(_sets(rules)), f"id {name}, cluster {name}, blocks int, block int, signature binary, shingles binary"
    )
    packs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_members // 2000)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = signed.withColumn("other", other).select(
        "id",
        "cluster",
        "block",
        "signature",
        "shingles",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(packs)).cast("string"))
        .otherwise(F.concat_ws("/", F.col("cluster").cast("string"), F.least("block", "other"), F.greatest("block", "other")))
        .alias("task"),
    )
    links = paired.groupBy("task").applyInArrow(releasing_group(_verify(rules, to_arrow_type(kind))), f"u {name}, v {name}")

    groups = stage(components(links).select(F.col("node"), F.col("component")))
    named = stage(placed.select("id", "node").distinct()).join(groups, "node", "left")
    named = named.select("id", F.coalesce("component", "node").alias("component")).groupBy("id").agg(F.min("component").alias("component"))
    out = features.select("id", "n").join(named, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_groups(docs, rules=NearRules(percent=85))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i : i + 4], ' ') ELSE array_to_string(w, ' ') END AS s
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) r(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL),
link AS (
  SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y
  WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN size s USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON m.x = d.doc_id
"""
