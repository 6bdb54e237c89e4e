"""Small helpers that several of these operators use."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from demandspark.session import new_stage_path

#: ASCII A-Z lower-cased, every other byte as it is.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
UPPER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
#: Text bytes that one chunk of documents should hold.
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8")


def byte_views(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes | None]:
    """The values of a text or binary column as bytes, without decoding them."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    for chunk in chunks:
        if pa.types.is_string(chunk.type):
            chunk = chunk.cast(pa.binary())
        elif pa.types.is_large_string(chunk.type):
            chunk = chunk.cast(pa.large_binary())
        yield from chunk.to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash, on a whole array."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def window_hashes(h: np.ndarray, width: int, factor: np.uint64 = MIX) -> np.ndarray:
    """Hash of every run of `width` consecutive word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= factor
        out += h[j : j + n]
    return mixed(out)


def lowered(column):
    """A-Z lower-cased only, the way the byte operators do it."""
    return F.translate(column, UPPER_LETTERS, UPPER_LETTERS.lower())


def chunk_count(docs: DataFrame, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Chunks needed so that each holds about `chunk_bytes` of text: one pass, one number."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-int(total) // chunk_bytes))


def in_pieces(rows: Iterable[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds at most about `limit` bytes, one row at least."""
    for batch in rows:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * limit / max(batch.nbytes, 1)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def with_field(schema: StructType, name: str, kind: str) -> StructType:
    """A schema with one more field of a type in DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(f"`{name}` {kind}").fields])


# -- memory of Python workers -----------------------------------------------------------
def release_memory() -> None:
    """Gives freed memory back to the system: a worker serves later stages as well."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing_map(run):
    """A mapInArrow function that releases memory when its task ends."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return mapped


def releasing_group(run):
    """The same for applyInArrow, after each group."""

    def grouped(table: pa.Table) -> pa.Table:
        out = run(table)
        release_memory()
        return out

    return grouped


def releasing_cogroup(run):
    """The same for cogrouped tables."""

    def cogrouped(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        release_memory()
        return out

    return cogrouped


# -- written tables that replace each other ---------------------------------------------
class Generations:
    """Written tables of which each one makes the one before it needless.

    A new table is complete before the old one is deleted, so a job that fails
    or loses executors still finds the last complete one.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.path = spark, name, None

    def write(self, df: DataFrame) -> DataFrame:
        path = new_stage_path(self.spark, self.name)
        df.write.parquet(path)
        self.clear()
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        if self.path is not None:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
            self.path = None


#: A key is hot when it holds more than one in so many of the rows.
HOT_SHARE = 10_000


def hot_lookup(rows: DataFrame, side: DataFrame, on: dict[str, str], weight: str, values: list[str]) -> DataFrame:
    """`rows` with the columns `values` of `side`, whose keys `on` names by those of `rows` (nulls equal nulls).

    A key of `side` is there once and `weight` bounds the rows that hold it.
    Hot keys, at most HOT_SHARE of them whatever the tables, are broadcast; the
    others meet their rows in a shuffle that no key can fill. Rows without a
    partner go.
    """
    total = side.agg(F.sum(F.col(weight).cast("decimal(38,0)"))).first()[0] or 0
    side = side.select(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(on.values())], weight, *values)
    names = [f"__s{i}" for i in range(len(on))]

    def equal(left: DataFrame, right: DataFrame):
        tests = [left[a].eqNullSafe(right[b]) for a, b in zip(on, names)]
        return functools.reduce(lambda x, y: x & y, tests)

    is_hot = F.col(weight).cast("decimal(38,0)") * HOT_SHARE > F.lit(total)
    hot, cold = side.where(is_hot).drop(weight), side.where(~is_hot).drop(weight)
    first = rows.join(F.broadcast(hot), equal(rows, hot)).drop(*names)
    rest = rows.join(F.broadcast(hot), equal(rows, hot), "left_anti")
    return first.unionByName(rest.join(cold, equal(rest, cold)).drop(*names))
