"""Chunks of documents, and the messages between chunks and shards.

Several operators need an answer from the whole corpus for each small piece of
a text. A row for each piece would be larger than the texts, so pieces travel
packed: documents are packed into chunks, a chunk sends each shard one blob with
what it asks, and the shard answers with one blob in the same order. Chunks and
first questions share one exchange, which the plan reads again for the next
steps instead of building it anew.

A chunk is known by the digest of its content. A recomputed task of the same
input gives the same chunks; if the input changed between attempts, the answer
is missing and the task fails loudly instead of returning wrong rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

EXCHANGE = "key string, kind int, shard int, payload binary"
CHUNK, ASK, REPLY, ASK_EXACT, REPLY_EXACT = range(5)
#: Text bytes of one chunk.
PACK_BYTES = 8 << 20


def planes(a: np.ndarray, width: int = 4) -> bytes:
    """Numbers of `width` bytes, the low byte of all first: packs better."""
    a = np.ascontiguousarray(a, f"<u{width}")
    return a.view(np.uint8).reshape(-1, width).T.tobytes()


def numbers(data: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def steps(a: np.ndarray, width: int = 4) -> bytes:
    """Ascending numbers as differences."""
    return planes(np.diff(a, prepend=a.dtype.type(0)), width)


def from_steps(data: bytes, width: int = 4) -> np.ndarray:
    return np.cumsum(numbers(data, width), dtype=f"<u{width}")


def packed(*parts: bytes, level: int = 3) -> bytes:
    head = np.array([len(parts), *map(len, parts)], "<u8").tobytes()
    return zstandard.compress(head + b"".join(parts), level)


def unpacked(blob: bytes) -> list[bytes]:
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, "<u8", 1)[0])
    at, out = 8 + 8 * n, []
    for size in np.frombuffer(data, "<u8", n, 8).tolist():
        out.append(data[at : at + size])
        at += size
    return out


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


class Docs:
    """The documents of a chunk: integer ids, which of them are null, texts as bytes."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, texts: list[bytes]) -> None:
        self.ids, self.known, self.texts = ids, known, texts

    def blob(self) -> bytes:
        sizes = np.array([len(t) for t in self.texts], np.uint64)
        return packed(planes(self.ids.view(np.uint64), 8), bits(self.known), planes(sizes, 8), b"".join(self.texts))

    @classmethod
    def of(cls, blob: bytes) -> Docs:
        ids, known, sizes, text = unpacked(blob)
        ids = numbers(ids, 8).view(np.int64)
        ends = np.cumsum(numbers(sizes, 8).astype(np.int64)).tolist()
        return cls(ids, flags(known, len(ids)), [text[a:b] for a, b in zip([0, *ends], ends)])


def rows(found: list[tuple[str, int, int, bytes]]) -> pa.Table:
    keys, kinds, shards, blobs = zip(*found) if found else ((), (), (), ())
    return pa.table(
        {
            "key": pa.array(keys, pa.string()),
            "kind": pa.array(kinds, pa.int32()),
            "shard": pa.array(shards, pa.int32()),
            "payload": pa.array(blobs, pa.binary()),
        }
    )


def cutter(ask: Callable[[Docs], Iterator[tuple[int, bytes]]], pack_bytes: int = PACK_BYTES):
    """For mapInArrow over (id bigint, text): chunk rows, and what `ask` asks of shards."""

    def chunk(ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        docs = Docs(
            np.array([0 if i is None else i for i in ids], np.int64), np.array([i is not None for i in ids], bool), texts
        )
        blob = docs.blob()
        key = "c" + xxhash.xxh3_128_hexdigest(blob)
        found = [(key, CHUNK, -1, blob)]
        found += [(f"s{s}", ASK, s, packed(key.encode(), body, level=1)) for s, body in ask(docs)]
        yield from rows(found).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            column = batch.column("text").cast(pa.binary())
            for i in range(batch.num_rows):
                ids.append(batch.column("id")[i].as_py())
                texts.append(column[i].as_py() or b"")
                size += len(texts[-1])
                if size >= pack_bytes:
                    yield from chunk(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield from chunk(ids, texts)

    return run


def messages(table: pa.Table, kind: int) -> list[tuple[str, int, bytes]]:
    """(key, shard, payload) of the rows of one kind.

    Chunks of equal content share a key; each of them asks, and any answer serves them all.
    """
    rows_of = zip(*(table.column(c) for c in ("key", "kind", "shard", "payload")))
    return [(key.as_py(), shard.as_py(), payload.as_py()) for key, k, shard, payload in rows_of if k.as_py() == kind]


def answer(kind: int, reply_kind: int, work: Callable[[list[bytes]], list[bytes]]):
    """For applyInArrow over a shard's rows: one reply for each chunk that asked.

    `work` gets the bodies of all chunks and gives one body for each.
    """

    def run(table: pa.Table) -> pa.Table:
        asked = [(shard, unpacked(blob)) for _, shard, blob in messages(table, kind)]
        if not asked:
            return rows([])
        replies = work([body for _, (_, body) in asked])
        return rows(
            [(key.decode(), reply_kind, shard, packed(body, level=1)) for (shard, (key, _)), body in zip(asked, replies)]
        )

    return run


def replies_of(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {shard: unpacked(blob)[0] for _, shard, blob in messages(table, kind)}


def missing(shard: int) -> ValueError:
    return ValueError(f"no answer of shard {shard}: the chunk was recomputed from other rows")
