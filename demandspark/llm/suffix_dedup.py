"""Suffix dedup: repeated 100-byte strings found by merging Burrows-Wheeler transforms.

1. Anchors. Of every 100-byte window the 32-byte string with the smallest hash
   is its anchor, so equal windows have equal anchors at equal offsets. Chunks
   send the hashes of their anchors to shards and learn which of them occur
   twice. A window whose anchor occurs once is unique and needs no suffixes.
2. Reads. A repeated anchor gives one read, the bytes of all windows that hold
   it (168 at most). Equal reads are one, the earliest, in a chunk and again in
   its bucket; later ones are repeats as a whole. Reads go to the bucket of
   their anchor, and an anchor with one read left has nothing to compare.
3. Merge. In a bucket the reads of each source make a multi-string BWT. Its
   symbols are strings of ten bytes, so that ten refinements reach 100 bytes.
   The transforms are merged by refining their interleave: each round reads the
   symbols of the transforms in the order of the interleave and moves the
   sources by a stable sort on them. The suffixes themselves are not sorted
   again. Neighbours in the merged order give the common prefixes; runs of
   100 bytes or more are the repeated intervals.
   An anchor with more than HOT_READS places in all (a common phrase with ever
   new surroundings) has no reads. Its windows, the equal ones of a chunk as
   one, go to the bucket of their own hash and meet there as bytes, so they
   spread over all buckets.
4. The smallest (document, start) of an interval stays, every other window of it
   is a repeat. Chunks get a mask for each read and drop the covered bytes.

Nothing is a row for each suffix, and no task holds more than the reads of one
bucket. A passage that all documents share is one read for each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from demandspark.llm import chunks as C
from demandspark.llm.common import MIX, chunk_count, mixed, releasing_cogroup, releasing_group, releasing_map, table
from demandspark.llm.substring_dedup import covered

WIDTH = 100
GRAM = 32
STEP = 10
#: Windows that hold a given anchor.
SPREAD = WIDTH - GRAM + 1
#: Text of one shard of anchors or bucket of reads.
SHARD_BYTES = 16 << 20
#: Places of one anchor up to which its reads stay together in one merge.
HOT_READS = 4096
#: Reads merged at once (an anchor's reads stay together), and transforms of one merge.
MERGE_READS = 500
TRANSFORMS = 4
#: Text for which anchors are found at once, in the processor's cache.
PIECE_BYTES = 1 << 17
FACTORS = np.array([0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of every 32 consecutive bytes, never zero.

    Different strings with one hash only make more reads, never a wrong repeat.
    """
    n = len(text)
    words = np.empty(n - 7, np.uint64)  # eight bytes at every place
    for r in range(min(8, len(words))):
        words[r::8] = text[r : r + (n - r) // 8 * 8].view("<u8")
    words *= MIX
    words ^= words >> np.uint64(32)
    m = n - GRAM + 1
    h = words[:m] * FACTORS[0]
    for k in (1, 2, 3):
        h += words[8 * k : 8 * k + m] * FACTORS[k]
    h ^= h >> np.uint64(32)
    h *= MIX
    return h | np.uint64(1)


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every `width` consecutive values."""
    size = 1
    while size * 2 <= width:
        a = pick(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return pick(a[:-rest], a[rest:]) if rest else a


def anchors(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of documents laid end to end; bounds: their starts and the end."""
    n = len(text)
    if n < WIDTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(text)
    low = _sliding(h, SPREAD, np.minimum)
    inside = np.zeros(n + 1, np.int32)  # windows that do not cross a document's end
    starts, ends = bounds[:-1], bounds[1:] - WIDTH + 1
    whole = ends > starts
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, ends[whole], -1)
    low[np.cumsum(inside[: len(low)]) == 0] = 0
    edge = np.zeros(SPREAD - 1, np.uint64)
    high = _sliding(np.concatenate([edge, low, edge]), SPREAD, np.maximum)
    at = np.flatnonzero(high == h)
    return at, h[at]


class Anchored:
    """A chunk with its documents in the order of their ids, and all anchors."""

    def __init__(self, docs: C.Docs, shards: int) -> None:
        order = np.flatnonzero(docs.known)
        self.order = order[np.argsort(docs.ids[order], kind="stable")]
        self.ids = docs.ids[self.order]
        texts = [docs.texts[i] for i in self.order]
        self.blob = b"".join(texts)
        self.text = np.frombuffer(self.blob, np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
        places, hashes, first = [], [], 0
        while first < len(texts):
            last = first + 1
            while last < len(texts) and self.bounds[last + 1] - self.bounds[first] <= PIECE_BYTES:
                last += 1
            a, b = self.bounds[first], self.bounds[last]
            at, h = anchors(self.text[a:b], self.bounds[first : last + 1] - a)
            places.append(at + a)
            hashes.append(h)
            first = last
        self.at = np.concatenate(places) if places else np.empty(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        shard = mixed(self.hash) % np.uint64(shards)
        self.key = (shard << np.uint64(32)) | (self.hash >> np.uint64(32))
        self.keys, self.which, self.times = np.unique(self.key, return_inverse=True, return_counts=True)
        self.cuts = np.searchsorted(self.keys >> np.uint64(32), np.arange(shards + 1, dtype=np.uint64))


def _ask_anchors(shards: int):
    def ask(docs: C.Docs) -> Iterator[tuple[int, bytes]]:
        a = Anchored(docs, shards)
        keys = (a.keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for s in range(shards):
            mine = slice(a.cuts[s], a.cuts[s + 1])
            if mine.start < mine.stop:
                yield s, C.packed(C.steps(keys[mine]), C.planes(a.times[mine].astype(np.uint32)), level=1)

    return ask


def _count_anchors(hot_reads: int):
    """Which anchors of each chunk occur twice or more, and more than `hot_reads` times, in all chunks together."""

    def count(bodies: list[bytes]) -> list[bytes]:
        asked = [C.unpacked(body) for body in bodies]
        keys = [C.from_steps(k) for k, _ in asked]
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.concatenate([C.numbers(t) for _, t in asked])
        total = np.bincount(which, weights=times, minlength=len(distinct))[which]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        return [C.packed(C.bits(x > 1), C.bits(x > hot_reads), level=1) for x in np.split(total, ends)]

    return count


def _window_hashes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(text, WIDTH) if len(starts) else None
    for at in range(0, len(starts), 1 << 16):
        part, h = windows[starts[at : at + (1 << 16)]], out[at : at + (1 << 16)]
        for k in [*range(0, WIDTH - 7, 8), WIDTH - 8]:
            h[:] = mixed(h * MIX + np.ascontiguousarray(part[:, k : k + 8]).view("<u8").ravel())
    return out


class HotWindows:
    """The windows that hold a hot anchor of a chunk; equal ones are one, the earliest."""

    def __init__(self, a: Anchored, hot: np.ndarray, shards: int) -> None:
        at = a.at[hot[a.which]]
        doc = np.searchsorted(a.bounds, at, "right") - 1
        low, high = np.maximum(at - SPREAD + 1, a.bounds[doc]), np.minimum(at, a.bounds[doc + 1] - WIDTH)
        n = np.maximum(high - low + 1, 0)
        self.start = np.unique(np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        doc = np.searchsorted(a.bounds, self.start, "right") - 1
        self.ids, self.places = a.ids[doc], self.start - a.bounds[doc]
        h = _window_hashes(a.text, self.start)
        order = np.lexsort((self.places, self.ids, h))
        lead = np.maximum.accumulate(np.where(np.diff(h[order], prepend=h[order][:1] + np.uint64(1)) != 0, np.arange(len(h)), 0))
        self.first = np.empty(len(h), np.int64)
        self.first[order] = order[lead]
        windows = np.lib.stride_tricks.sliding_window_view(a.text, WIDTH) if len(h) else None
        others = np.flatnonzero(self.first != np.arange(len(h)))
        for i in range(0, len(others), 1 << 16):  # other bytes with the same hash stand for themselves
            mine = others[i : i + (1 << 16)]
            unlike = mine[(windows[self.start[mine]] != windows[self.start[self.first[mine]]]).any(1)]
            self.first[unlike] = unlike
        self.sent = np.flatnonzero(self.first == np.arange(len(h)))
        bucket = (mixed(h[self.sent]) % np.uint64(shards)).astype(np.int64)
        self.by_bucket = self.sent[np.argsort(bucket, kind="stable")]
        self.cuts = np.searchsorted(np.sort(bucket), np.arange(shards + 1))

    def repeats(self, later: np.ndarray) -> np.ndarray:
        """Starts of all windows that are repeats; later: which of the windows sent are (one flag for each window)."""
        own = (self.ids == self.ids[self.first]) & (self.places == self.places[self.first])
        return self.start[np.where(own, later[self.first], True)]


def _replied(a: Anchored, replies: dict[int, bytes], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors of a chunk are repeated and not hot, and which are hot."""
    repeated, hot = np.zeros(len(a.keys), bool), np.zeros(len(a.keys), bool)
    for s in range(shards):
        if a.cuts[s] < a.cuts[s + 1]:
            if s not in replies:
                raise C.missing(s)
            for out, x in zip((repeated, hot), C.unpacked(replies[s])):
                out[a.cuts[s] : a.cuts[s + 1]] = C.flags(x, a.cuts[s + 1] - a.cuts[s])
    return repeated & ~hot, hot


class Reads:
    """The reads of a chunk's repeated anchors that are not hot; equal ones are one."""

    def __init__(self, a: Anchored, repeated: np.ndarray, shards: int) -> None:
        chosen = np.flatnonzero(repeated[a.which])
        at = a.at[chosen]
        self.doc = np.searchsorted(a.bounds, at, "right") - 1
        self.start = np.maximum(at - SPREAD + 1, a.bounds[self.doc])
        self.end = np.minimum(at + WIDTH, a.bounds[self.doc + 1])
        self.offset = at - self.start
        # The earliest of equal reads stands for them; rows with one id are one document.
        self.id, self.place = a.ids[self.doc], self.start - a.bounds[self.doc]
        seen: dict[tuple[int, bytes], int] = {}
        blob, entry, first = a.blob, np.empty(len(at), np.int64), []
        starts, ends, offsets = self.start.tolist(), self.end.tolist(), self.offset.tolist()
        for i in np.lexsort((self.place, self.id)).tolist():
            x, y, o = starts[i], ends[i], offsets[i]
            e = seen.setdefault((o, blob[x:y]), len(first))
            if e == len(first):
                first.append(i)
            entry[i] = e
        self.entry, self.first = entry, np.array(first, np.int64)
        bucket = (mixed(a.hash[chosen][self.first] + MIX) % np.uint64(shards)).astype(np.int64)
        self.by_bucket = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[self.by_bucket], np.arange(shards + 1))
        self.texts = [text for _, text in seen]


def _ask_reads(shards: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found, replies = [], C.replies_of(right, C.REPLY)
        for key, _, blob in C.messages(left, C.CHUNK):
            a = Anchored(C.Docs.of(blob), shards)
            repeated, hot = _replied(a, replies, shards)
            r, w = Reads(a, repeated, shards), HotWindows(a, hot, shards)
            windows = np.lib.stride_tricks.sliding_window_view(a.text, WIDTH) if len(w.sent) else np.empty((0, WIDTH), np.uint8)
            ids, start = a.ids[r.doc[r.first]], (r.start - a.bounds[r.doc])[r.first]
            for s in range(shards):
                mine = r.by_bucket[r.cuts[s] : r.cuts[s + 1]]
                more = w.by_bucket[w.cuts[s] : w.cuts[s + 1]]
                if not len(mine) and not len(more):
                    continue
                texts = [r.texts[i] for i in mine.tolist()]
                body = C.packed(
                    b"".join(texts),
                    C.planes(np.array([len(t) for t in texts], np.uint32)),
                    C.planes(r.offset[r.first[mine]].astype(np.uint32)),
                    C.planes(ids[mine].view(np.uint64), 8),
                    C.planes(start[mine].astype(np.uint64), 8),
                    windows[w.start[more]].tobytes(),
                    C.planes(w.ids[more].view(np.uint64), 8),
                    C.planes(w.places[more].astype(np.uint64), 8),
                )
                found.append((f"x{s}", C.ASK_EXACT, s, C.packed(key.encode(), body, level=1)))
        return C.rows(found)

    return run


# -- transforms and their merge -----------------------------------------------------------
def _order(symbols: np.ndarray, most: int) -> np.ndarray:
    """Stable order of symbols up to `most`, by digits of 16 bits."""
    order = np.argsort(symbols.astype(np.uint16, copy=False), kind="stable")
    if most > 0xFFFF:
        order = order[np.argsort((symbols >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def ten_bytes(text: np.ndarray) -> np.ndarray:
    """Ranks from 1 on of the ten bytes at every place (the last nine places get none)."""
    n = len(text) - STEP + 1
    wide = np.lib.stride_tricks.sliding_window_view(text, 8)[:n]
    eight = np.ascontiguousarray(wide).view(">u8").ravel().astype(np.uint64)
    _, rank = np.unique(eight, return_inverse=True)
    two = text[8 : 8 + n].astype(np.int64) * 256 + text[9 : 9 + n]
    _, rank = np.unique(rank.astype(np.int64) * 65536 + two, return_inverse=True)
    return rank + 1


class Strings:
    """Reads as strings of ten-byte symbols, ten for each read: nodes, symbols, neighbours.

    A node is a place with ten bytes before the read's end; each string has one
    more node for its end, with symbol 0. Ends come in the order of the places
    before them, which makes the order of equal suffixes the same all along.
    """

    def __init__(self, rank: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        count = lengths - STEP + 1
        self.read = np.repeat(np.arange(len(starts)), count)
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        self.inner = inner
        n = len(inner)
        last = inner + STEP >= count[self.read]
        ends = np.flatnonzero(last)
        self.n, self.total = n, n + len(ends)
        self.symbol = np.zeros(self.total, np.int64)
        self.symbol[:n] = rank[starts[self.read] + inner]
        self.next = np.arange(self.total)
        self.next[:n] = np.minimum(np.arange(n) + STEP, self.total - 1)
        self.next[ends] = n + np.arange(len(ends))
        self.before = np.full(self.total, -1)
        self.before[self.next[:n]] = np.arange(n)

    def transform(self) -> tuple[np.ndarray, np.ndarray]:
        """(suffix array, BWT): all nodes by their suffix, and the symbol before each."""
        _, rank = np.unique(self.symbol, return_inverse=True)
        jump, depth = self.next, 1
        while depth < 16:  # a read has at most 16 symbols before its end
            _, rank = np.unique(rank * np.int64(self.total + 1) + rank[jump], return_inverse=True)
            jump = jump[jump]
            depth *= 2
        order = np.argsort(rank.astype(np.int64) * self.total + np.arange(self.total))
        bwt = np.where(self.before[order] >= 0, self.symbol[self.before[order]], 0)
        return order, bwt


def merge_transforms(bwts: list[np.ndarray], rounds: int) -> np.ndarray:
    """Interleave of the transforms: the source of every row, ordered by `rounds` symbols."""
    kind = np.uint8 if len(bwts) < 256 else np.uint16
    source = np.repeat(np.arange(len(bwts), dtype=kind), [len(b) for b in bwts])
    every = np.concatenate(bwts)
    most = int(every.max()) if len(every) else 0
    every = every.astype(np.uint16 if most <= 0xFFFF else np.uint32)
    symbols = np.empty_like(every)
    for _ in range(rounds):
        symbols[np.argsort(source, kind="stable")] = every
        source = source[_order(symbols, most)]
    return source


def repeated_windows(
    text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray, ids: np.ndarray, places: np.ndarray
) -> np.ndarray:
    """A mask (reads, SPREAD) of windows that also start earlier, at a smaller (id, place)."""
    out = np.zeros((len(starts), SPREAD), bool)
    rank = ten_bytes(text)
    sources = np.unique(group)
    parts, bwts = [], []
    for g in sources.tolist():
        mine = np.flatnonzero(group == g)
        s = Strings(rank, starts[mine], lengths[mine])
        order, bwt = s.transform()
        parts.append((order, s, mine))
        bwts.append(bwt)
    source = merge_transforms(bwts, WIDTH // STEP)
    # The suffix arrays, read in the order of the interleave.
    read, inner = np.full(len(source), -1), np.full(len(source), -1)
    rows = np.argsort(source, kind="stable")
    at = 0
    for order, s, mine in parts:
        where = rows[at : at + s.total]
        real = order < s.n
        read[where[real]] = mine[s.read[order[real]]]
        inner[where[real]] = s.inner[order[real]]
        at += s.total
    whole = (read >= 0) & (inner + WIDTH <= lengths[read])
    read, inner = read[whole], inner[whole]
    if not len(read):
        return out
    node = starts[read] + inner
    same = np.ones(len(node) - 1, bool)  # a common prefix of 100 bytes with the row above
    for k in range(0, WIDTH, STEP):
        symbol = rank[node + k]
        same &= symbol[1:] == symbol[:-1]
    interval = np.concatenate([[0], np.cumsum(~same)])
    doc, place = ids[read], places[read] + inner
    order = np.lexsort((place, doc, interval))
    first = order[np.concatenate([[True], np.diff(interval[order]) > 0])]
    later = (doc > doc[first][interval]) | ((doc == doc[first][interval]) & (place > place[first][interval]))
    out[read[later], inner[later]] = True
    return out


def _merge_bucket(bodies: list[bytes]) -> list[bytes]:
    """The masks of all reads of a bucket, and flags of its windows of hot anchors, for each chunk in its order."""
    parts = [C.unpacked(body) for body in bodies]
    later = _merge_windows([p[5:] for p in parts])
    masks = _merge_reads([p[:5] for p in parts])
    return [C.packed(C.bits(m.ravel()), C.bits(x), level=1) for m, x in zip(masks, later)]


def _merge_windows(bodies: list[list[bytes]]) -> list[np.ndarray]:
    """Which windows also start earlier, at a smaller (id, place)."""
    seen: dict[bytes, int] = {}
    entry = np.array([seen.setdefault(t[k : k + WIDTH], len(seen)) for t, _, _ in bodies for k in range(0, len(t), WIDTH)], np.int64)
    ids = np.concatenate([C.numbers(d, 8).view(np.int64) for _, d, _ in bodies])
    places = np.concatenate([C.numbers(p, 8).view(np.int64) for _, _, p in bodies])
    order = np.lexsort((places, ids, entry))
    first = order[np.flatnonzero(np.diff(entry[order], prepend=-1))][entry] if len(entry) else entry
    later = (ids != ids[first]) | (places != places[first])
    return np.split(later, np.cumsum([len(t) // WIDTH for t, _, _ in bodies])[:-1])


def _merge_reads(bodies: list[list[bytes]]) -> list[np.ndarray]:
    if not any(text for text, *_ in bodies):
        return [np.zeros((0, SPREAD), bool) for _ in bodies]
    texts, lengths, offsets, ids, places, group, counts = [], [], [], [], [], [], []
    for i, body in enumerate(bodies):
        text, n, o, d, p = body
        texts.append(text)
        lengths.append(C.numbers(n).astype(np.int64))
        offsets.append(C.numbers(o).astype(np.int64))
        ids.append(C.numbers(d, 8).view(np.int64))
        places.append(C.numbers(p, 8).view(np.int64))
        counts.append(len(lengths[-1]))
        group.append(np.full(counts[-1], i))
    text = np.frombuffer(b"".join(texts), np.uint8)
    del texts
    lengths, offsets, ids, places, group = map(np.concatenate, (lengths, offsets, ids, places, group))
    starts = np.cumsum(lengths) - lengths
    # Equal reads are one: the earliest goes on, later ones are repeats as a whole.
    blob, seen = text.tobytes(), {}
    entry = np.fromiter(
        (seen.setdefault((o, blob[a : a + n]), len(seen)) for a, n, o in zip(starts.tolist(), lengths.tolist(), offsets.tolist())),
        np.int64,
        len(starts),
    )
    del blob, seen
    order = np.lexsort((places, ids, entry))
    own = order[np.flatnonzero(np.diff(entry[order], prepend=-1))]
    every, twin = (lengths, ids, places), own[entry]
    starts, lengths, offsets, ids, places, group = (x[own] for x in (starts, lengths, offsets, ids, places, group))
    grams = np.lib.stride_tricks.sliding_window_view(text, GRAM)[starts + offsets]
    key = np.zeros(len(starts), np.uint64)
    for k in range(0, GRAM, 8):
        key = mixed(key * MIX + np.ascontiguousarray(grams[:, k : k + 8]).view("<u8").ravel())
    order = np.argsort(key, kind="stable")
    mask = np.zeros((len(starts), SPREAD), bool)
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(key[order].astype(np.uint64)) != 0, [True]]))
    # An anchor with one read has nothing to compare; the reads of another stay together.
    sizes = np.diff(cuts)
    order = order[np.repeat(sizes > 1, sizes)]
    cuts = np.concatenate([[0], np.cumsum(sizes[sizes > 1])])
    at = 0
    while at < len(cuts) - 1:
        end = at + 1
        while end < len(cuts) - 1 and cuts[end + 1] - cuts[at] <= MERGE_READS:
            end += 1
        mine = np.sort(order[cuts[at] : cuts[end]])
        n = lengths[mine]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        part = text[np.repeat(starts[mine], n) + inner]
        # Chunks in turn, at most TRANSFORMS of them apart.
        _, source = np.unique(group[mine], return_inverse=True)
        mask[mine] = repeated_windows(part, np.cumsum(n) - n, n, source % TRANSFORMS, ids[mine], places[mine])
        at = end
    mask = mask[entry]
    n, doc, place = every
    later = (doc != doc[twin]) | (place != place[twin])
    mask[later] = np.arange(SPREAD) <= (n[later] - WIDTH)[:, None]
    return np.split(mask, np.cumsum(counts)[:-1])


def _remove(shards: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, sizes, removed, spans, kept = [], [], [], [], []
        replies, masks = C.replies_of(right, C.REPLY), C.replies_of(right, C.REPLY_EXACT)
        for _, _, blob in C.messages(left, C.CHUNK):
            docs = C.Docs.of(blob)
            a = Anchored(docs, shards)
            repeated, hot = _replied(a, replies, shards)
            r, w = Reads(a, repeated, shards), HotWindows(a, hot, shards)
            later = np.zeros(len(w.start), bool)
            mask = np.zeros((len(r.first), SPREAD), bool)
            for s in range(shards):
                mine = r.by_bucket[r.cuts[s] : r.cuts[s + 1]]
                more = w.by_bucket[w.cuts[s] : w.cuts[s + 1]]
                if len(mine) or len(more):
                    if s not in masks:
                        raise C.missing(s)
                    reads, windows = C.unpacked(masks[s])
                    mask[mine] = C.flags(reads, len(mine) * SPREAD).reshape(-1, SPREAD)
                    later[more] = C.flags(windows, len(more))
            # A read at the (id, start) of the earliest equal one is no copy of it.
            lead = r.first[r.entry]
            same = (r.id == r.id[lead]) & (r.place == r.place[lead])
            own, copies = np.flatnonzero(same), np.flatnonzero(~same)
            row, inner = np.nonzero(mask[r.entry[own]])
            starts = [r.start[own[row]] + inner, w.repeats(later)]
            n = r.end[copies] - r.start[copies] - WIDTH + 1
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            starts.append(np.repeat(r.start[copies], n) + step)
            gone = covered(np.unique(np.concatenate(starts)), WIDTH, len(a.text))
            for j, i in enumerate(a.order.tolist()):
                x, y = a.bounds[j], a.bounds[j + 1]
                out = gone[x:y]
                ids.append(int(docs.ids[i]))
                sizes.append(int(y - x))
                removed.append(int(out.sum()))
                spans.append(int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()) if removed[-1] else 0)
                kept.append(a.text[x:y][~out].tobytes() if removed[-1] else docs.texts[i])
            for i in np.flatnonzero(~docs.known).tolist():
                ids.append(None)
                sizes.append(len(docs.texts[i]))
                removed.append(0)
                spans.append(0)
                kept.append(docs.texts[i])
        return pa.table(
            {
                "id": pa.array(ids, pa.int64()),
                "n_bytes": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    return run


def drop_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pack_bytes: int = C.PACK_BYTES, hot_reads: int = HOT_READS
) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept binary), a row for each input row.

    Ids are integers; a null text is empty. A row with a null id keeps its bytes
    and makes no other text a repeat. Rows that share an id count as one
    document: of two windows the one with the smaller start is earlier, and
    with equal starts neither is. `kept` is binary, as a cut may split a
    character.
    """
    shards = max(8, chunk_count(docs, text_col, SHARD_BYTES))
    slim = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    cut = slim.mapInArrow(releasing_map(C.cutter(_ask_anchors(shards), pack_bytes)), C.EXCHANGE)
    counted = cut.groupBy("key").applyInArrow(releasing_group(C.answer(C.ASK, C.REPLY, _count_anchors(hot_reads))), C.EXCHANGE)
    asked = cut.groupBy("key").cogroup(counted.groupBy("key")).applyInArrow(releasing_cogroup(_ask_reads(shards)), C.EXCHANGE)
    merged = asked.groupBy("key").applyInArrow(releasing_group(C.answer(C.ASK_EXACT, C.REPLY_EXACT, _merge_bucket)), C.EXCHANGE)
    both = counted.unionByName(merged)
    out = cut.groupBy("key").cogroup(both.groupBy("key")).applyInArrow(
        releasing_cogroup(_remove(shards)), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )
    return out.withColumnRenamed("id", id_col)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_bytes(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as two hexadecimal digits each, so that text functions count bytes.
SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (
  SELECT doc_id, p, substr(x, 2 * p + 1, 200) AS s FROM h, unnest(range(0, len(x) // 2 - 99)) r(p) WHERE len(x) >= 200),
low AS (SELECT s, min(struct_pack(d := doc_id, p := p)) AS first FROM win GROUP BY s),
late AS (
  SELECT doc_id, w.p, w.p - lag(w.p) OVER (PARTITION BY doc_id ORDER BY w.p) AS step
  FROM win w JOIN low USING (s) WHERE first < struct_pack(d := doc_id, p := w.p)),
runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (
    SELECT *, sum(CASE WHEN step <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM late) GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs),
kept AS (
  SELECT doc_id, count(*) AS n, sum(b - a) AS gone, max(b) AS stop,
    string_agg(substr((SELECT x FROM h WHERE h.doc_id = g.doc_id), 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS x
  FROM gaps g GROUP BY doc_id)
SELECT h.doc_id, CAST(len(h.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k.x, '') || substr(h.x, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN kept k ON k.doc_id = h.doc_id
"""
