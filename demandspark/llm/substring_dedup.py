"""Substring dedup over word windows with a count-min prefilter.

Pass 1 counts: every chunk of documents makes a count-min sketch of its
13-word windows (two rows of counters, cut into shards by hash, kept sparse,
saturated at two). Shards add the sketches of all chunks up. A merged counter is
never below the true count, so a window whose smaller counter is one is unique.
The chunk learns for each of its counters whether it reached two.

Pass 2 is exact: the windows estimated repeated, and no others, go to the shards
with two 64-bit hashes and the smallest document id of the chunk; the shard gives
back the smallest id of all. A window is a repeat where that id is below its own
document's.

A window that every document has is one entry for each chunk, never a row for
each occurrence. The number of shards follows the amount of text, so a shard's
counters stay within a fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from demandspark.llm import chunks as C
from demandspark.llm.common import MIX2, chunk_count, mixed, releasing_cogroup, releasing_group, releasing_map, table, window_hashes, word_hashes

WINDOW = 13
#: Counters of a sketch row in one shard; a shard gets the windows of about 16 MB of text.
CELL_BITS = 24
SHARD_BYTES = 16 << 20


class Windows:
    """All windows of a chunk, by hash; documents in the order of their ids.

    A window is known by its place, the number of its first word in the chunk.
    """

    def __init__(self, docs: C.Docs, shards: int, width: int) -> None:
        known = np.flatnonzero(docs.known)
        self.order = known[np.argsort(docs.ids[known], kind="stable")]
        self.ids = docs.ids[self.order]
        self.width, self.shards = width, shards
        parts = [word_hashes(docs.texts[i].split()) for i in self.order.tolist()]
        self.counts = np.array([len(p) for p in parts], np.int64)
        self.words = np.concatenate([*parts, np.empty(0, np.uint64)])
        self.doc = np.repeat(np.arange(len(parts), dtype=np.int32), self.counts)
        h = window_hashes(self.words, width)
        place = np.flatnonzero(self.doc[: len(h)] == self.doc[len(self.words) - len(h) :])  # within one document
        h = h[place]
        order = np.argsort(h)
        self.hash, self.place = h[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = self.hash[1:] != self.hash[:-1]
        self.group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.distinct = self.hash[first]
        self.more = np.diff(np.append(first, len(h))) > 1
        # The leading part of a hash says its shard and its counter of the first row, so both ascend with it.
        n, low = np.uint64(shards), np.uint64(0xFFFFFFFF)
        lead = (self.distinct >> np.uint64(32)) * n + (((self.distinct & low) * n) >> np.uint64(32))
        self.cuts = np.searchsorted(lead >> np.uint64(32), np.arange(shards + 1, dtype=np.uint64))
        self.cell = ((lead & low) >> np.uint64(32 - CELL_BITS)).astype(np.uint32)

    def second_cell(self) -> np.ndarray:
        return (mixed(self.distinct + MIX2) & np.uint64((1 << CELL_BITS) - 1)).astype(np.uint32)


def _sketch(shards: int, width: int):
    """What a chunk tells each shard: its counters of both rows, in the order of its windows."""

    def ask(docs: C.Docs) -> Iterator[tuple[int, bytes]]:
        w = Windows(docs, shards, width)
        second = w.second_cell()
        for s in range(shards):
            mine = slice(w.cuts[s], w.cuts[s + 1])
            if mine.start < mine.stop:
                yield s, C.packed(C.steps(w.cell[mine]), C.planes(second[mine]), C.bits(w.more[mine]), level=1)

    return ask


def _merge(bodies: list[bytes]) -> list[bytes]:
    """Adds the sketches up; of which windows of each chunk both counters are at two or more."""
    asked = []
    for body in bodies:
        first, second, more = C.unpacked(body)
        first = C.from_steps(first)
        asked.append((first, C.numbers(second), C.flags(more, len(first)).astype(np.uint32) + np.uint32(1)))
    found = [np.ones(len(x[0]), bool) for x in asked]
    for row in (0, 1):
        total = np.zeros(1 << CELL_BITS, np.uint32)
        for sketch in asked:
            np.add.at(total, sketch[row], sketch[2])
        for hit, sketch in zip(found, asked):
            hit &= total[sketch[row]] > 1
    return [C.bits(hit) for hit in found]


class Repeats:
    """The windows of a chunk estimated to occur twice or more, one entry for each different one."""

    def __init__(self, w: Windows, replies: dict[int, bytes]) -> None:
        maybe = np.zeros(len(w.distinct), bool)
        for s in range(w.shards):
            a, b = w.cuts[s], w.cuts[s + 1]
            if a < b:
                if s not in replies:
                    raise C.missing(s)
                maybe[a:b] = C.flags(replies[s], b - a)
        chosen = np.flatnonzero(maybe[w.group])
        h1, place = w.hash[chosen], w.place[chosen]
        h2 = window_hashes(w.words, w.width, MIX2)[place]
        same = h1[1:] == h1[:-1]
        if (same & (h2[1:] != h2[:-1])).any():  # two windows share the first hash
            order = np.lexsort((h2, h1))
            h1, h2, place = h1[order], h2[order], place[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = np.flatnonzero(new)
        self.place, self.entry = place, np.cumsum(new) - 1
        self.h1, self.h2 = h1[first], h2[first]
        lowest = np.minimum.reduceat(place, first) if len(first) else place
        self.lowest = w.ids[w.doc[lowest]]
        n = np.uint64(w.shards)
        lead = (self.h1 >> np.uint64(32)) * n + (((self.h1 & np.uint64(0xFFFFFFFF)) * n) >> np.uint64(32))
        self.cuts = np.searchsorted(lead >> np.uint64(32), np.arange(w.shards + 1, dtype=np.uint64))


def _ask_exact(shards: int, width: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        replies = C.replies_of(right, C.REPLY)
        for key, _, blob in C.messages(left, C.CHUNK):
            r = Repeats(Windows(C.Docs.of(blob), shards, width), replies)
            for s in range(shards):
                mine = slice(r.cuts[s], r.cuts[s + 1])
                if mine.start < mine.stop:
                    body = C.packed(
                        C.steps(r.h1[mine], 8), C.planes(r.h2[mine], 8), C.planes(r.lowest[mine].view(np.uint64), 8), level=1
                    )
                    found.append((f"x{s}", C.ASK_EXACT, s, C.packed(key.encode(), body, level=1)))
        return C.rows(found)

    return run


def _group(bodies: list[bytes]) -> list[bytes]:
    """The smallest document id of every window, for each chunk in its order."""
    parts = []
    for body in bodies:
        h1, h2, ids = C.unpacked(body)
        parts.append((C.from_steps(h1, 8), C.numbers(h2, 8), C.numbers(ids, 8).view(np.int64)))
    h1, h2, ids = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    lowest = np.empty(len(order), np.int64)
    lowest[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    ends = np.cumsum([len(p[0]) for p in parts])
    # As differences to the chunk's own smallest: zero for most.
    return [C.packed(C.planes((own - low).view(np.uint64), 8), level=1) for (_, _, own), low in zip(parts, np.split(lowest, ends[:-1]))]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window that begins at one of the (different) starts."""
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1
    edge[starts + width] -= 1
    return np.cumsum(edge[:n]) > 0


def _remove(shards: int, width: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, n_words, n_removed, kept = [], [], [], []
        replies, exact = C.replies_of(right, C.REPLY), C.replies_of(right, C.REPLY_EXACT)
        for _, _, blob in C.messages(left, C.CHUNK):
            docs = C.Docs.of(blob)
            w = Windows(docs, shards, width)
            r = Repeats(w, replies)
            lowest = r.lowest.copy()
            for s in range(shards):
                a, b = r.cuts[s], r.cuts[s + 1]
                if a < b:
                    if s not in exact:
                        raise C.missing(s)
                    lowest[a:b] -= C.numbers(C.unpacked(exact[s])[0], 8).view(np.int64)
            repeated = r.place[lowest[r.entry] < w.ids[w.doc[r.place]]]
            gone = covered(repeated, width, len(w.words))
            ends = np.cumsum(w.counts)
            lost = np.concatenate([[0], np.cumsum(gone)])
            lost = lost[ends] - lost[ends - w.counts]
            for j, i in enumerate(w.order.tolist()):
                words = docs.texts[i].split()
                if lost[j]:
                    out = gone[ends[j] - w.counts[j] : ends[j]].tolist()
                    words = [x for x, g in zip(words, out) if not g]
                ids.append(int(docs.ids[i]))
                n_words.append(int(w.counts[j]))
                n_removed.append(int(lost[j]))
                kept.append(b" ".join(words).decode("utf-8"))
            for i in np.flatnonzero(~docs.known).tolist():
                words = docs.texts[i].split()
                ids.append(None)
                n_words.append(len(words))
                n_removed.append(0)
                kept.append(b" ".join(words).decode("utf-8"))
        return pa.table(
            {
                "id": pa.array(ids, pa.int64()),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept": pa.array(kept, pa.string()),
            }
        )

    return run


def drop_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, pack_bytes: int = C.PACK_BYTES
) -> DataFrame:
    """(id_col, n_words, n_removed, kept): the words outside repeats, joined by a space.

    A row for each input row; ids are integers. A null text has no words. A row
    with a null id keeps its words and makes no other text a repeat. Rows that
    share an id never make each other repeats.
    """
    shards = max(8, chunk_count(docs, text_col, SHARD_BYTES))
    slim = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    cut = slim.mapInArrow(releasing_map(C.cutter(_sketch(shards, width), pack_bytes)), C.EXCHANGE)
    whole = cut.groupBy("key")
    sketched = whole.applyInArrow(releasing_group(C.answer(C.ASK, C.REPLY, _merge)), C.EXCHANGE)
    asked = cut.groupBy("key").cogroup(sketched.groupBy("key")).applyInArrow(releasing_cogroup(_ask_exact(shards, width)), C.EXCHANGE)
    exact = asked.groupBy("key").applyInArrow(releasing_group(C.answer(C.ASK_EXACT, C.REPLY_EXACT, _group)), C.EXCHANGE)
    both = sketched.unionByName(exact)
    out = cut.groupBy("key").cogroup(both.groupBy("key")).applyInArrow(
        releasing_cogroup(_remove(shards, width)), "id bigint, n_words bigint, n_removed bigint, kept string"
    )
    return out.withColumnRenamed("id", id_col)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_windows(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM words, unnest(range(1, len(w) - 11)) r(i) WHERE len(w) >= 13),
low AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS p FROM win JOIN low USING (s) WHERE first < doc_id GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(w) AS n, CASE WHEN p IS NULL THEN w ELSE
    list_filter(w, lambda x, k: NOT list_contains(p, k)) END AS k
  FROM words d LEFT JOIN gone g ON d.doc_id = g.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
