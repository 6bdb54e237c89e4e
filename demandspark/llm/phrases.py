"""Phrase collocations by partitioning (SON): shards first, then one exact count.

A phrase that comes `support` times in the corpus comes at least
support / shards times in one of `shards` shards. So each shard is mined
completely at that lowered support, length by length: a phrase can only reach it
when the two phrases that are one word shorter do. The union of what is frequent
in any shard is then counted exactly, by text, over all documents: a task sends the
phrases of each part of the hashes as sorted lines, and the part sums them.

A shard is mined by many tasks: a task counts the different phrases of a chunk of
texts and sends their hashes and counts to the parts of the shard, one packed
message of ascending hashes for each part, three to four bytes a phrase. The number
of parts follows the amount of text, so a part that is summed holds no more than a
fixed size. Which hashes are frequent somewhere is kept as a bitmap of fixed size,
so what is broadcast does not grow with the corpus; two phrases on one bit, like
two of one hash, only add a phrase to the exact count, which tells them apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from demandspark.llm.chunks import from_steps, numbers, packed, planes, steps, unpacked
from demandspark.llm.common import LOWER, MIX, byte_views, chunk_count, hot_lookup, in_pieces, mixed, releasing_group, releasing_map, table, word_hashes
from demandspark.session import stage

#: Ends of pieces; spaces and tabs end words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z lower-cased, tabs as spaces and every end of a piece as a comma: no other white space is left, and no comma in a word.
PLAIN = LOWER.translate(bytes.maketrans(BREAKS + b"\t", b"," * len(BREAKS) + b" "))
BREAK = b","
NO_LANGUAGE = "und"
#: The bitmap has this many bits, as rows of 4 KB.
BITMAP_BITS = 1 << 27
ROW_BITS = 1 << 15
#: Bits of a hash that are counted while mining; phrases that agree in them only add to the exact count.
HASH_BITS = 40
#: Text bytes of a shard for each part of its hashes, which bounds what a task sums at once.
PART_BYTES = 8 << 20
#: Hashes that a task holds before it sends them.
HELD_HASHES = 1 << 19


@dataclass(frozen=True)
class PhraseRules:
    longest: int = 3
    """Words of a phrase, at least two."""
    support: int = 10
    """A candidate comes at least so often in its language."""
    shards: int = 3
    """Shards that are mined on their own, 8 at most; fewer than the support, so that a single occurrence is not enough."""
    scale: int = 1_000_000
    covered: int = 50
    """A candidate goes when a longer one that holds it has this percentage of its count."""
    top: int = 2000
    """Phrases reported for each language."""
    chunk_bytes: int = 6 << 20
    """Text of a task that is counted at once."""
    salts: int = 64
    """Parts of a language whose best phrases are found on their own."""


class _Ids(dict):
    """Numbers for words as they come; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Chunk:
    """Texts of one language, as word numbers."""

    def __init__(self) -> None:
        self.words = _Ids({BREAK: 0})
        self.parts: list[np.ndarray] = []

    def add(self, text: bytes) -> None:
        tokens = text.translate(PLAIN).replace(BREAK, b" , ").split()
        tokens.append(BREAK)
        self.parts.append(np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens)))

    def ids(self) -> np.ndarray:
        ids, self.parts = np.concatenate(self.parts), []
        return ids


def _levels(ids: np.ndarray, n_words: int, first: np.ndarray, wanted, longest: int):
    """Different phrases of a chunk, length by length: (length, counts, hashes, prefix, last word).

    `prefix` numbers the phrases of the length before, `first` are the hashes of
    words. `wanted(length, hashes)` says which phrases may be part of a longer one.
    """
    start = np.flatnonzero(ids)
    number = ids[start]
    counts = np.bincount(number, minlength=n_words)
    hashes = mixed(first + np.uint64(1))
    present = np.flatnonzero(counts)
    yield 1, counts[present], hashes[present], None, present
    if longest == 1:
        return
    # `number` of each start is its phrase among those of one length; -1 where none is wanted.
    place = np.full(len(ids) + 1, -1, np.int64)
    dense = np.zeros(n_words, np.int64)
    dense[present] = np.arange(len(present))
    ok = wanted(1, hashes[present])
    place[start] = np.where(ok[dense[number]], dense[number], -1)
    hashes = hashes[present]
    for length in range(2, longest + 1):
        begin = np.flatnonzero((place[:-1] >= 0) & (place[1:] >= 0))
        if not len(begin):
            return
        code = place[begin] * np.int64(n_words) + ids[begin + length - 1]
        different, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
        prefix, last = different // n_words, different % n_words
        hashes = mixed(hashes[prefix] * MIX + first[last] + np.uint64(length))
        yield length, counts, hashes, prefix, last
        if length == longest:
            return
        ok = wanted(length, hashes)
        place = np.full(len(ids) + 1, -1, np.int64)
        place[begin] = np.where(ok[inverse], inverse, -1)


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[str, Chunk]]:
    held: dict[str, Chunk] = {}
    size = 0
    for batch in in_pieces(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), byte_views(batch.column("text"))):
            if text:
                if lang not in held:
                    held[lang] = Chunk()
                held[lang].add(text)
                size += len(text) + 1
        if size >= chunk_bytes:
            yield from held.items()
            held, size = {}, 0
    yield from held.items()


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BITMAP_BITS - 1)).astype(np.int64)


def _in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _bits(hashes)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _language(lang: str, hashes: np.ndarray) -> np.ndarray:
    """Word hashes that differ by language."""
    return mixed(hashes ^ word_hashes([lang.encode()])[0])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in ascending order, and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def _messages(keys: np.ndarray, counts: np.ndarray, shard: int, parts: int) -> pa.RecordBatch:
    """(part, payload): the hashes of each part, a range of them, with their counts."""
    keys, counts = _summed(keys, counts)
    cuts = np.searchsorted(keys, np.array([(i << HASH_BITS) // parts for i in range(parts + 1)], np.uint64)).tolist()
    sent = [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
    blobs = [packed(steps(keys[a:b], 8), planes(counts[a:b], 8), level=1) for _, a, b in sent]
    numbered = pa.array([shard * parts + p for p, _, _ in sent], pa.int64())
    return pa.RecordBatch.from_arrays([numbered, pa.array(blobs, pa.binary())], names=["part", "payload"])


def _miner(shared, length: int, rules: PhraseRules, parts: int):
    """Messages with the phrases of one length whose shorter parts may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value if shared else None
        shard = TaskContext.get().partitionId() % rules.shards
        keys, sums, held = [], [], 0
        for lang, chunk in _chunks(batches, rules.chunk_bytes):
            ids, words = chunk.ids(), list(chunk.words)
            first = _language(lang, word_hashes(words))
            for n, counts, hashes, _, _ in _levels(ids, len(words), first, lambda _, h: _in_bitmap(bitmap, h), length):
                if n == length:
                    keys.append(hashes & np.uint64((1 << HASH_BITS) - 1))
                    sums.append(counts.astype(np.uint64))
                    held += len(hashes)
            if held >= HELD_HASHES:
                yield _messages(np.concatenate(keys), np.concatenate(sums), shard, parts)
                keys, sums, held = [], [], 0
        if held:
            yield _messages(np.concatenate(keys), np.concatenate(sums), shard, parts)

    return run


def _often(local: int):
    """The hashes of a part that come `local` times or more."""

    def run(rows: pa.Table) -> pa.Table:
        found = [unpacked(blob) for blob in byte_views(rows.column("payload"))]
        keys = np.concatenate([from_steps(blob, 8) for blob, _ in found])
        keys, counts = _summed(keys, np.concatenate([numbers(blob, 8) for _, blob in found]))
        return pa.table({"key": pa.array(keys[counts >= local].view(np.int64))})

    return run


def _counter(shared, rules: PhraseRules, parts: int):
    """Messages with the candidates of each language and their counts; the empty phrase counts all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        held: dict[str, list[pa.Table]] = {}
        size = 0
        for lang, chunk in _chunks(batches, rules.chunk_bytes):
            ids, words = chunk.ids(), list(chunk.words)
            first = _language(lang, word_hashes(words))
            mine = held.setdefault(lang, [])
            mine.append(_found([b""], np.zeros(1, np.uint64), np.array([(ids > 0).sum()]), parts))
            texts: list[bytes | None] = []
            for length, counts, hashes, prefix, last in _levels(ids, len(words), first, lambda _, h: _in_bitmap(bitmap, h), rules.longest):
                good = np.flatnonzero(_in_bitmap(bitmap, hashes))
                ends = last[good].tolist()
                made = [words[w] for w in ends] if length == 1 else [texts[p] + b" " + words[w] for p, w in zip(prefix[good].tolist(), ends)]
                texts = [None] * len(counts)
                for at, text in zip(good.tolist(), made):
                    texts[at] = text
                mine.append(_found(made, hashes[good], counts[good], parts))
                size += len(good)
            if size >= HELD_HASHES:
                yield _phrase_messages(held)
                held, size = {}, 0
        if held:
            yield _phrase_messages(held)

    return run


def _found(texts: list[bytes], hashes: np.ndarray, counts: np.ndarray, parts: int) -> pa.Table:
    part = (hashes & np.uint64((1 << HASH_BITS) - 1)) * np.uint64(parts) >> np.uint64(HASH_BITS)
    return pa.table({"part": pa.array(part.astype(np.int64)), "phrase": pa.array(texts, pa.binary()), "n": pa.array(counts.astype(np.int64))})


def _phrase_messages(held: dict[str, list[pa.Table]]) -> pa.RecordBatch:
    """(part, payload): phrases of one language and part in ascending order, a line each, with their counts."""
    numbered, blobs = [], []
    for lang, tables in held.items():
        summed = pa.concat_tables(tables).group_by(["part", "phrase"], use_threads=False).aggregate([("n", "sum")])
        summed = summed.sort_by([("part", "ascending"), ("phrase", "ascending")])
        part, counts = summed["part"].to_numpy(), summed["n_sum"].to_numpy().astype(np.uint64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            numbered.append(int(part[a]))
            lines = b"\n".join(summed["phrase"].slice(a, b - a).to_pylist())
            blobs.append(packed(lang.encode(), lines, planes(counts[a:b], 8)))
    return pa.RecordBatch.from_arrays([pa.array(numbered, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "payload"])


def _counted(support: int):
    """(lang, phrase, words, f) of the phrases of a part that come `support` times or more, and of the empty ones."""

    def run(rows: pa.Table) -> pa.Table:
        tables = []
        for blob in byte_views(rows.column("payload")):
            lang, lines, counts = unpacked(blob)
            lines = lines.split(b"\n")
            tables.append(pa.table({"lang": pa.repeat(lang.decode(), len(lines)), "phrase": pa.array(lines, pa.binary()), "n": pa.array(numbers(counts, 8).astype(np.int64))}))
        summed = pa.concat_tables(tables).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
        phrase, f = summed["phrase"], summed["n_sum"]
        empty = pc.equal(pc.binary_length(phrase), 0)
        words = pc.if_else(empty, 0, pc.add(pc.count_substring(phrase, " "), 1)).cast(pa.int32())
        out = pa.table({"lang": summed["lang"], "phrase": phrase, "words": words, "f": f}).filter(pc.or_(empty, pc.greater_equal(f, support)))
        return out.set_column(1, "phrase", out["phrase"].cast(pa.string()))

    return run


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: PhraseRules = PhraseRules()) -> DataFrame:
    """(lang, phrase, words, f) of every phrase of up to `longest` words that comes `support` times or more.

    One row of zero words and an empty phrase for each language has all its word
    occurrences in f, whatever the support.
    """
    if not 1 <= rules.shards <= 8 or rules.longest < 1:
        raise ValueError("1 to 8 shards and at least one word")
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    sc = docs.sparkSession.sparkContext
    local = -(-rules.support // rules.shards)
    parts = -(-chunk_count(texts, "text", PART_BYTES) // rules.shards)
    bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)
    shared = None
    for length in range(1, rules.longest + 1):
        mined = texts.mapInArrow(releasing_map(_miner(shared, length, rules, parts)), "part bigint, payload binary")
        often = mined.groupBy("part").applyInArrow(releasing_group(_often(local)), "key bigint")
        bit = F.col("key").bitwiseAND(F.lit(BITMAP_BITS - 1))
        rows = often.groupBy(F.bitmap_bucket_number(bit + 1).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit + 1)).alias("bits"))
        for row, bits in rows.toLocalIterator():
            at = (row - 1) * (ROW_BITS // 8)
            bitmap[at : at + ROW_BITS // 8] |= np.frombuffer(bytes(bits), np.uint8)
        if shared:
            shared.unpersist()
        shared = sc.broadcast(bitmap)
    counted = texts.mapInArrow(releasing_map(_counter(shared, rules, rules.shards * parts)), "part bigint, payload binary")
    return counted.groupBy("part").applyInArrow(releasing_group(_counted(rules.support)), "lang string, phrase string, words int, f bigint")


def _join_words(words: Column, at, n) -> Column:
    return F.array_join(F.slice(words, at, n), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: PhraseRules = PhraseRules()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best `top` phrases of each language.

    Null texts have no words and null languages are `und`, together with rows
    that are labelled so. Repeated rows count as often as they come. Equal
    scores go by count and then by the bytes of the phrase. Scores are exact
    while counts stay below 10^15. An empty table, or one without a phrase that
    comes often enough, gives no rows.
    """
    found = stage(frequent_phrases(docs, text_col, lang_col, rules))
    parts = found.where("words > 0").select("lang", "phrase", "words", "f")
    totals = found.where("words = 0").select("lang", F.col("f").alias("n"))
    given = parts.where("words >= 2").withColumn("w", F.split("phrase", " ", -1))
    cut = given.select("lang", "phrase", "words", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _join_words(F.col("w"), F.lit(1), F.col("k")).alias("first"), _join_words(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest")
    )
    # A part that comes f times is the beginning of at most f / support phrases of a length, so f bounds its rows.
    side = parts.where(F.col("words") < rules.longest).select("lang", "phrase", "f", F.col("f").alias("value"))
    cut = hot_lookup(cut, side, {"lang": "lang", "first": "phrase"}, "f", ["value"]).withColumnRenamed("value", "l")
    cut = hot_lookup(cut, side, {"lang": "lang", "rest": "phrase"}, "f", ["value"]).withColumnRenamed("value", "r")
    wide = {c: F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r")}
    top = wide["a"] * wide["a"] * F.lit(rules.scale).cast("decimal(7,0)")
    cut = cut.withColumn("top", top.cast("decimal(38,0)")).withColumn("below", wide["l"] * wide["r"])
    cut = cut.withColumn("score", F.expr("top div below"))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = given.where("words > 2").select("lang", "f", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("len"))
    inside = inside.select("lang", "f", "w", "len", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("len") + 1)).alias("at"))
    longer = inside.groupBy("lang", _join_words(F.col("w"), F.col("at"), F.col("len")).alias("phrase")).agg(F.max("f").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("a") * rules.covered)

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(rules.salts)).alias("salt"))
    near = flat.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= rules.top)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= rules.top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
worded AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
counted AS MATERIALIZED (
  SELECT lang, phrase, m, count(*) AS f FROM (
    SELECT lang, 1 AS m, unnest(w) AS phrase FROM worded
    UNION ALL SELECT lang, 2, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2])) FROM worded WHERE len(w) >= 2
    UNION ALL SELECT lang, 3, unnest(list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda z: z[1] || ' ' || z[2] || ' ' || z[3])) FROM worded WHERE len(w) >= 3)
  GROUP BY ALL),
candidate AS MATERIALIZED (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE m >= 2 AND f >= 10),
part AS MATERIALIZED (SELECT lang, phrase, f FROM counted WHERE f >= 10),
halves AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS head, array_to_string(list_slice(w, k + 1, m), ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidate)),
cut AS (
  SELECT h.lang, h.phrase, h.a, k, x.f AS l, y.f AS r,
    CAST(1000000::HUGEINT * h.a * h.a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM halves h JOIN part x ON x.lang = h.lang AND x.phrase = h.head
  JOIN part y ON y.lang = h.lang AND y.phrase = h.tail),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(list_slice(w, 1, 2), ' '), array_to_string(list_slice(w, 2, 3), ' ')]) AS phrase
    FROM candidate WHERE m = 3) GROUP BY ALL),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
  WHERE g.longer IS NULL OR 100 * g.longer < 50 * b.a)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
