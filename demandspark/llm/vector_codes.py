"""Vector code compression: product codes by Lloyd rounds that touch only what moved.

A vector of integers is cut into parts, and every part position has a small
codebook. A round assigns each part to its nearest entry and moves every entry
to the floored mean of its parts. A part whose entry stayed where it was keeps
its stored exact distance and is compared with the moved entries only; a part
whose entry moved is compared with all. Both leave the entry that a full scan
finds, the lower index on ties.

The state of a round (integers, codes and exact distances of each vector) is a
table in the shared folder; the table before it is deleted once a round is
written, so two of them exist at most and a lost executor costs a re-read. A
batch of vectors also writes its sums for each entry, into a column that is read
alone. The driver holds codebooks and their sums, never vectors.

Sums and distances are exact: 64-bit integers where the values allow it, Python
integers for larger ones (finite floats reach 2^140 after scaling).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from demandspark.llm.common import Generations, hot_lookup, in_pieces, releasing_map, table
from demandspark.session import stage

#: Sums of very large integers travel in limbs of so many bits.
LIMB = 48
#: Sum of squares of differences below this fits 64 bits.
MOST = 1 << 62


@dataclass(frozen=True)
class CodeRules:
    scale: int = 4096
    """A component becomes floor(scale * x)."""
    parts: int = 8
    entries: int = 16
    """Codebook entries of a part position, 256 at most."""
    rounds: int = 6


class Numbers:
    """How integers up to `most` in size are kept: as fixed-width bytes, computed exactly."""

    def __init__(self, most: int, dim: int) -> None:
        self.exact = 4 * (most + 1) ** 2 * max(dim, 1) < MOST
        self.kept = np.dtype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)
        self.width = 1 + (max(most, 1) * 2 + 1).bit_length() // 8
        #: A distance has twice the bits of a component and some for the number of squares.
        self.far = 2 * self.width + 1 + max(dim, 1).bit_length() // 8
        self.limbs = 1 if self.exact else 2 + (8 * self.width + 40) // LIMB

    def scaled(self, values: np.ndarray, scale: int) -> np.ndarray:
        if self.exact:
            return np.floor(values.astype(np.float64) * scale).astype(np.int64)
        out = np.empty(values.shape, object)
        for at, x in np.ndenumerate(values.astype(np.float64)):
            a, b = float(x).as_integer_ratio()
            out[at] = a * scale // b
        return out

    def pack(self, values: np.ndarray, far: bool = False) -> pa.Array:
        """A matrix as one binary value for each row."""
        if self.exact:
            return fixed_binary(np.ascontiguousarray(values, np.int64 if far else self.kept))
        width = self.far if far else self.width
        return pa.array([b"".join(int(x).to_bytes(width, "little", signed=True) for x in row) for row in values], pa.binary())

    def unpack(self, column: pa.Array, far: bool = False) -> np.ndarray:
        data = column.to_pylist()
        if self.exact:
            flat = np.frombuffer(b"".join(data), np.int64 if far else self.kept)
            return flat.reshape(len(data), -1).astype(np.int64)
        width = self.far if far else self.width
        rows = [[int.from_bytes(x[i : i + width], "little", signed=True) for i in range(0, len(x), width)] for x in data]
        return np.array(rows, object).reshape(len(data), -1)

    def split(self, value: int) -> list[int]:
        """Limbs, lowest first; the last one carries the sign."""
        value = int(value)
        low = [(value >> (LIMB * i)) & ((1 << LIMB) - 1) for i in range(self.limbs - 1)]
        return [*low, value >> (LIMB * (self.limbs - 1))]

    def join(self, limbs: list[int]) -> int:
        return sum(int(x) << (LIMB * i) for i, x in enumerate(limbs))


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """A contiguous matrix as a binary column, one value for each row."""
    n, width = len(rows), rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    offsets = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(rows.tobytes())])


def cuts(dim: int, parts: int) -> list[slice]:
    """Consecutive parts, equal where the number of parts divides the dimension."""
    edges = [p * dim // parts for p in range(parts + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _distance(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    return ((x - entry) ** 2).sum(1) if x.shape[1] else np.zeros(len(x), x.dtype)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row and its squared distance, the lower index on ties."""
    best, code = _distance(x, book[0]), np.zeros(len(x), np.uint8)
    for j in range(1, len(book)):
        d = _distance(x, book[j])
        nearer = (d < best).astype(bool)
        best[nearer], code[nearer] = d[nearer], j
    return code, best


def rescan(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, best: np.ndarray) -> None:
    """Bring codes and distances up to date after the entries in `moved` (booleans) changed, in place."""
    if not moved.any():
        return
    whole = moved[code]
    if whole.any():
        code[whole], best[whole] = scan(x[whole], book)
    rest = np.flatnonzero(~whole)
    if not len(rest):
        return
    kept, mine, far = x[rest], code[rest], best[rest]
    for j in np.flatnonzero(moved):
        d = _distance(kept, book[j])
        better = ((d < far) | ((d == far) & (j < mine))).astype(bool)
        far[better], mine[better] = d[better], j
    code[rest], best[rest] = mine, far


def _sums(x: np.ndarray, codes: np.ndarray, slices: list[slice], entries: int, numbers: Numbers) -> list[int]:
    """Count and componentwise sums of each entry, by part and entry, in limbs."""
    out: list[int] = []
    for p, part in enumerate(slices):
        for j in range(entries):
            mine = x[codes[:, p] == j, part]
            for value in (len(mine), *(mine.sum(0).tolist() if len(mine) else [0] * (part.stop - part.start))):
                out.extend(numbers.split(value))
    return out


def _starter(shared, keep: list[str], rules: CodeRules):
    """First assignment: from the given vectors to the state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, books, dim = shared.value
        slices = cuts(dim, rules.parts)
        for batch in in_pieces(batches):
            x = numbers.scaled(batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim), rules.scale)
            found = [scan(x[:, part], book) for part, book in zip(slices, books)]
            yield _state(batch, keep, numbers, x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1), slices, rules)

    return run


def _state(batch, keep, numbers, x, codes, far, slices, rules) -> pa.RecordBatch:
    sums = [_sums(x, codes, slices, rules.entries, numbers), *[None] * (batch.num_rows - 1)]
    return pa.RecordBatch.from_arrays(
        [
            *[batch.column(c) for c in keep],
            numbers.pack(x),
            fixed_binary(np.ascontiguousarray(codes)),
            numbers.pack(far, far=True),
            pa.array(sums, pa.list_(pa.int64())),
        ],
        names=[*keep, "__v", "__code", "__far", "__sums"],
    )


def _updater(shared, keep: list[str], rules: CodeRules, last: bool):
    """Next assignment from the state before; the last one gives codes and errors without the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, books, moved, dim = shared.value
        slices = cuts(dim, rules.parts)
        for batch in in_pieces(batches):
            x, far = numbers.unpack(batch.column("__v")), numbers.unpack(batch.column("__far"), far=True).copy()
            codes = np.frombuffer(b"".join(batch.column("__code").to_pylist()), np.uint8).reshape(batch.num_rows, -1).copy()
            for p, part in enumerate(slices):
                code, best = codes[:, p].copy(), far[:, p].copy()
                rescan(x[:, part], books[p], moved[p], code, best)
                codes[:, p], far[:, p] = code, best
            if not last:
                yield _state(batch, keep, numbers, x, codes, far, slices, rules)
                continue
            errors = [int(e) for e in far.sum(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in keep],
                    pa.array([row.tobytes().hex() for row in codes], pa.string()),
                    pa.array([e if e < 1 << 63 else None for e in errors], pa.int64()),
                ],
                names=[*keep, "__text", "__error"],
            )

    return run


def usable(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    inf = F.lit(float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < inf)), F.lit(False))


def _books(seeds: list, numbers: Numbers, dim: int, rules: CodeRules) -> list[np.ndarray]:
    x = numbers.scaled(np.array([r["__x"] for r in seeds], np.float64).reshape(len(seeds), dim), rules.scale)
    return [x[:, part].copy() for part in cuts(dim, rules.parts)]


def _moved(books: list[np.ndarray], state: DataFrame, numbers: Numbers, dim: int, rules: CodeRules) -> tuple[list, list]:
    """Codebooks after one update, and which entries changed."""
    totals = (
        state.where("__sums is not null")
        .select(F.posexplode("__sums").alias("at", "x"))
        .groupBy("at")
        .agg(F.sum(F.col("x").cast("decimal(19,0)")).alias("x"))
        .collect()
    )
    given = {r.at: r.x for r in totals}
    step, at, new, moved = numbers.limbs, 0, [], []

    def number() -> int:
        nonlocal at
        at += step
        return numbers.join([given[i] for i in range(at - step, at)])

    for book in books:
        after = book.copy()
        for j in range(rules.entries):
            count = number()
            sums = [number() for _ in range(book.shape[1])]
            if count:
                after[j] = [s // count for s in sums]
        new.append(after)
        moved.append((after != book).any(1) if book.shape[1] else np.zeros(len(book), bool))
    return new, moved


@dataclass(frozen=True)
class Coded:
    rows: DataFrame
    """The columns asked for, code and error."""
    books: list[np.ndarray]
    """Final entries of each part position."""

    @property
    def digest(self) -> str:
        numbers = [str(int(x)) for book in self.books for x in book.ravel()]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def encode(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    keep: tuple[str, ...] = (),
    code_col: str = "code",
    error_col: str = "error",
    rules: CodeRules = CodeRules(),
) -> Coded:
    """Codes of all usable vectors, with the id, the columns in `keep`, code and error.

    Vectors that are null or hold a null or non-finite component are dropped.
    The dimension is that of the vector with the smallest id; vectors of
    another length are kept without code or error and shape no codebook. Where
    the parts do not divide the dimension they differ by one component. The
    first entries are the vectors of the smallest ids (null ids last, rows of
    one id by their vectors); with fewer rows than entries the codebook is
    shorter. Repeated rows count as often as they come. An error of 2^63 or
    more is null. An empty table gives no rows and no entries.
    """
    if not 0 < rules.entries <= 256 or rules.parts < 1:
        raise ValueError("1 to 256 entries and at least one part")
    kept = list(dict.fromkeys([id_col, *keep]))
    rest = [c for c in kept if c not in (code_col, error_col)]
    names = [f"__k{i}" for i in range(len(rest))]
    given = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names)], F.col(f"`{id_col}`").alias("__id"), F.col(f"`{vector_col}`").cast("array<double>").alias("__x"))
    given = given.where(usable(F.col("__x")))
    in_order = [F.col("__id").asc_nulls_last(), F.col("__x")]
    first = given.orderBy(*in_order).select("__x").limit(1).collect()
    spark = df.sparkSession
    shape = StructType([*[given.schema[n] for n in names], *StructType.fromDDL("__text string, __error bigint").fields])

    def result(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(n).alias(c) for c, n in zip(rest, names)], F.col("__text").alias(code_col), F.col("__error").alias(error_col))

    if not first:
        return Coded(result(spark.createDataFrame([], shape)), [np.zeros((0, 0), np.int64) for _ in range(rules.parts)])
    dim = len(first[0]["__x"])
    alike, other = given.where(F.size("__x") == dim), given.where(F.size("__x") != dim)
    largest = alike.agg(F.max(F.array_max(F.transform("__x", F.abs)))).first()[0] or 0.0
    ratio = float(largest).as_integer_ratio()
    numbers = Numbers(ratio[0] * rules.scale // ratio[1] + 1, dim)
    books = _books(alike.orderBy(*in_order).select("__x").limit(rules.entries).collect(), numbers, dim, rules)

    sc = spark.sparkContext
    state_schema = StructType([*[given.schema[n] for n in names], *StructType.fromDDL("__v binary, __code binary, __far binary, __sums array<bigint>").fields])
    states = Generations(spark, "codes")
    state = states.write(alike.drop("__id").mapInArrow(releasing_map(_starter(sc.broadcast((numbers, books, dim)), names, rules)), state_schema))
    for turn in range(rules.rounds):
        books, moved = _moved(books, state, numbers, dim, rules)
        step = _updater(sc.broadcast((numbers, books, moved, dim)), names, rules, last=turn == rules.rounds - 1)
        if turn < rules.rounds - 1:
            state = states.write(state.select(*names, "__v", "__code", "__far").mapInArrow(releasing_map(step), state_schema))
        else:
            rows = stage(state.select(*names, "__v", "__code", "__far").mapInArrow(releasing_map(step), shape))
    states.clear()
    strange = other.select(*names, F.lit(None).cast("string").alias("__text"), F.lit(None).cast("bigint").alias("__error"))
    return Coded(result(rows.unionByName(strange)), books)


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), keep=("label",))
    rows = coded.rows
    sums = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"), F.count(F.lit(1)).alias("held"))
    out = hot_lookup(rows, sums, {"label": "label"}, "held", ["label_error"])
    return out.select("vec_id", "code", "error", F.col("label_error").try_cast("bigint").alias("label_error"), F.lit(coded.digest).alias("codebooks_sha256"))


def _sql(rules: CodeRules = CodeRules(), dim: int = 64) -> str:
    """The same rounds as common table expressions, every part scanned in full."""
    d = dim // rules.parts
    steps = [
        f"""
WITH whole AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({rules.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT vec_id, label, p, list_slice(v, p * {d} + 1, p * {d} + {d}) AS x FROM whole, range({rules.parts}) r(p)),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, x AS c FROM part
  WHERE vec_id IN (SELECT vec_id FROM whole ORDER BY vec_id LIMIT {rules.entries}))"""
    ]
    for r in range(rules.rounds + 1):
        steps.append(
            f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, label, p, min(struct_pack(e := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), j := j)) AS best
  FROM part JOIN book{r} USING (p) GROUP BY vec_id, label, p)"""
        )
        if r < rules.rounds:
            steps.append(
                f"""
mean{r} AS MATERIALIZED (
  SELECT p, j, list(m ORDER BY i) AS c FROM (
    SELECT part.p, best.j AS j, i, CAST(floor(CAST(sum(x[i]) AS HUGEINT) / count(*)) AS BIGINT) AS m
    FROM part JOIN near{r} USING (vec_id, p), range(1, {d + 1}) t(i) GROUP BY part.p, best.j, i) GROUP BY p, j),
book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.j, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.j = m.j)"""
            )
    last = rules.rounds
    steps.append(
        f"""
coded AS MATERIALIZED (
  SELECT vec_id, label, string_agg(lpad(to_hex(best.j), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best.e) AS BIGINT) AS error
  FROM near{last} GROUP BY vec_id, label),
labelled AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded GROUP BY label),
written AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM book{last})
SELECT vec_id, lower(code) AS code, error, label_error, codebooks_sha256
FROM coded JOIN labelled ON coded.label IS NOT DISTINCT FROM labelled.label, written
"""
    )
    return ",".join(steps)


SQL = _sql()
