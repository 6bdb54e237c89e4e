"""Benchmark decontamination by a Wu-Manber multi-pattern search over words.

Patterns are the 13-word windows of the benchmark items (an item of fewer words
is one pattern). For patterns of one length m, a table says for each block of
two words how far the search may move on: a block that no pattern holds moves
it m - 1 words. Where the block ends a pattern, the bucket of that suffix gives
the patterns, and a comparison of all their words decides.

The documents are searched where they are read: no shuffle. The patterns are
gathered in blocks of at most `BLOCK_PATTERNS` and each block is broadcast; one
block is the usual case. With more, the documents are searched once for each
block and the hits of a document are united by its key, so no size is cut off.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from demandspark.llm.common import byte_views, table, with_field

WINDOW = 13
#: Patterns of one broadcast block; at about 200 bytes each, 60 MB in a worker.
BLOCK_PATTERNS = 300_000
#: Lower-cases A-Z and makes every ASCII byte that is no letter or digit a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def windows_of(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The patterns of an item."""
    if len(words) < width:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


class WuManber:
    """Tables for patterns (tuples of words) that share one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], length: int) -> None:
        self.length = length
        self.block = 2 if length > 1 else 1
        self.most = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[tuple[list[bytes], list[str]]]] = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = b" ".join(words[end - self.block : end])
                move = length - end
                if move < self.shift.get(key, self.most):
                    self.shift[key] = move
            self.bucket[b" ".join(words[-self.block :])].append((list(words), items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, items) of every occurrence."""
        n, m, most, shift, bucket = len(words), self.length, self.most, self.shift, self.bucket
        at = m - 1
        if self.block == 1:
            while at < n:
                for _, items in bucket.get(words[at], ()):
                    yield at, items
                at += 1
            return
        while at < n:
            key = words[at - 1] + b" " + words[at]
            move = shift.get(key, most)
            if move:
                at += move
                continue
            start = at - m + 1
            here = words[start : at + 1]
            for pattern, items in bucket[key]:
                if pattern == here:
                    yield start, items
            at += 1


def search_tables(patterns: list[tuple[tuple[bytes, ...], str]]) -> list[WuManber]:
    """One searcher for each pattern length."""
    lengths: dict[int, dict[tuple[bytes, ...], list[str]]] = defaultdict(lambda: defaultdict(list))
    for words, item in patterns:
        items = lengths[len(words)][words]
        if item not in items:
            items.append(item)
    return [WuManber(found, m) for m, found in sorted(lengths.items())]


def spans_of(words: list[bytes], searchers: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged hit spans (start, end) in words, and the items with an occurrence."""
    spans, items = [], set()
    for s in searchers:
        for start, found in s.find(words):
            spans.append((start, start + s.length))
            items.update(found)
    return merge_spans(spans), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


HITS = "struct<n_words:bigint,spans:array<struct<`start`:bigint,`end`:bigint>>,items:array<string>>"


def _searcher(shared, columns: list[str], text_col: str, out_col: str):
    tables: list[WuManber] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tables:
            tables.extend(search_tables(shared.value))
        kind = pa.struct(
            [
                ("n_words", pa.int64()),
                ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ("items", pa.list_(pa.string())),
            ]
        )
        for batch in batches:
            found = []
            for text in byte_views(batch.column(text_col)):
                words = words_of(text)
                spans, items = spans_of(words, tables)
                found.append(
                    {"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(items)}
                )
            arrays = [batch.column(c) for c in columns] + [pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, out_col])

    return run


def pattern_blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int = BLOCK_PATTERNS):
    """Lists of (words, item) of at most `most` patterns, one after another."""
    block: list[tuple[tuple[bytes, ...], str]] = []
    for item, text in benchmark.select(F.col(item_col).cast("string"), text_col).toLocalIterator():
        if item is None:
            continue
        for words in windows_of(words_of(None if text is None else text.encode())):
            block.append((words, item))
            if len(block) >= most:
                yield block
                block = []
    yield block


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    out_col: str = "hits",
    block_patterns: int = BLOCK_PATTERNS,
    key_col: str = "doc_id",
) -> DataFrame:
    """`docs` with a column of HITS: words, merged hit spans, items found.

    Null and empty texts have no words. Items with a null id are left out, ones
    without words match nothing; repeated items count once. `out_col` replaces
    a column of that name. `key_col` is used with several blocks only; rows
    that share a key keep their own hits.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != out_col]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = with_field(docs.schema, out_col, HITS)
    parts = [spark.sparkContext.broadcast(b) for b in pattern_blocks(benchmark, item_col, item_text_col, block_patterns)]
    if len(parts) == 1:
        return docs.mapInArrow(_searcher(parts[0], keep, text_col, out_col), schema)
    narrow = docs.select(F.col(key_col).alias("__key"), F.xxhash64(text_col).alias("__text"), F.col(text_col).alias("__body"))
    lean = with_field(narrow.schema, out_col, HITS)
    hits = None
    for part in parts:
        one = narrow.mapInArrow(_searcher(part, narrow.columns, "__body", out_col), lean)
        one = one.where(F.size(f"{out_col}.items") > 0).select("__key", "__text", out_col)
        hits = one if hits is None else hits.unionByName(one)
    united = hits.groupBy("__key", "__text").agg(
        F.array_sort(F.flatten(F.collect_set(f"{out_col}.spans"))).alias("__spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(f"{out_col}.items")))).alias("__items"),
    )
    same = F.col(f"`{key_col}`").eqNullSafe(F.col("__key")) & (F.xxhash64(f"`{text_col}`") == F.col("__text"))
    both = docs.join(united, same, "left")
    start = F.array().cast("array<struct<`start`:bigint,`end`:bigint>>")
    # Spans in order: one that begins within the last is drawn into it.
    merged = F.aggregate(
        F.coalesce("__spans", start),
        start,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    cleaned = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\x00", " ")
    n_words = F.size(F.filter(F.split(F.regexp_replace(cleaned, r"[\x01-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), " "), lambda x: x != ""))
    hit = F.struct(
        n_words.cast("long").alias("n_words"),
        merged.alias("spans"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("items"),
    )
    return both.select(*[F.col(f"`{c}`") for c in keep], hit.alias(out_col))


def n_hit(hits: str):
    return F.aggregate(F.col(f"{hits}.spans"), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def contaminated(hits: str):
    """At least one hit word, and hit words are a twentieth of all or more."""
    return (n_hit(hits) > 0) & (20 * n_hit(hits) >= F.col(f"{hits}.n_words"))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit("hits").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        contaminated("hits").alias("contaminated"),
    )


SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
pat AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
  FROM iw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) r(i) WHERE len(w) > 0),
win AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS s
  FROM dw, (SELECT DISTINCT m FROM pat) k, unnest(range(1, len(w) - m + 2)) r(i) WHERE len(w) >= m),
hit AS (SELECT DISTINCT doc_id, i, m, item_id FROM win JOIN pat USING (m, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM hit, unnest(range(i, i + m)) r(p) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM dw d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named a ON a.doc_id = d.doc_id
"""
