"""Byte-level BPE: every distinct pre-token of the corpus is encoded once.

Chunks of documents are cut into pre-tokens. A chunk keeps, for each document,
the positions as numbers of its own distinct pre-tokens, and sends each distinct
pre-token to the shard of its hash. A shard sees a pre-token from all chunks,
encodes it once and answers every chunk with the ids; the chunk puts them in
place by position. Decoding looks every id up in the table of token bytes. The
number of shards follows the amount of text (one pass over its lengths), so a
shard holds no more than a fixed size, whatever the shuffle partitions are.

One exchange carries chunks and pre-tokens and is read twice (the plan reuses
it), a second one carries the answers. Positions are never single rows, so the
shuffle is about as large as the compressed text, and a frequent word costs one
entry for each chunk that has it, however often it occurs. A chunk is known by
the digest of its content, so a recomputed task gives the same keys; an answer
that is missing raises an error.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from demandspark.llm.common import chunk_count, releasing_cogroup, releasing_group, releasing_map, table

#: Text bytes of one chunk.
PACK_BYTES = 8 << 20
#: Text bytes for each shard of pre-tokens, which bounds what a shard holds.
SHARD_BYTES = 16 << 20
TOKENIZER = "byte_bpe_multi_50k.tiktoken"

# Letters and numbers of the first 256 code points, and white space, as Unicode has them.
_LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = r"\t-\r \x85\xa0"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@functools.cache
def _patterns():
    """The pattern for any text, and one for texts of the first 256 code points (several times faster)."""
    import public_tokenizers
    import regex

    whole = public_tokenizers.PATTERN
    short = whole.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{_LETTER}{_NUMBER}]")
    short = short.replace(r"\p{L}", f"[{_LETTER}]").replace(r"\p{N}", f"[{_NUMBER}]")
    short = short.replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
    strict = whole.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    return regex.compile(strict), re.compile(short)


def pre_tokens(text: str) -> list[str]:
    strict, short = _patterns()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return strict.findall(text)
    return short.findall(text)


@functools.cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.cache
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


def encode_piece(piece: bytes, path: str) -> list[int]:
    return _encoder(path)._encode_single_piece(piece)


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    out = [b""] * (max(_ranks(path).values()) + 1)
    for piece, i in _ranks(path).items():
        out[i] = piece
    return out


# -- blobs ------------------------------------------------------------------------------
def _planes(a: np.ndarray) -> bytes:
    """Numbers with their low bytes first, then the next ones: packs better."""
    a = np.ascontiguousarray(a, "<u4")
    return a.view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _packed(*parts: bytes) -> bytes:
    head = np.array([len(p) for p in parts], "<u8").tobytes()
    return zstandard.compress(np.array([len(parts)], "<u8").tobytes() + head + b"".join(parts), 3)


def _unpacked(blob: bytes) -> list[bytes]:
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, "<u8", 1)[0])
    at, out = 8 + 8 * n, []
    for size in np.frombuffer(data, "<u8", n, 8).tolist():
        out.append(data[at : at + size])
        at += size
    return out


def _ipc(ids: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays([ids], ["id"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


_EXCHANGE = "key string, kind int, shard int, payload binary"


def _chunk_rows(ids: list[pa.Array], lengths: list[int], places: list[np.ndarray], seen: dict[str, int], shards: int):
    """The row of a chunk, and one row for each shard with the pre-tokens it gets."""
    words = [w.encode() for w in seen]
    shard = (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(shards)).astype(np.uint32)
    where = np.concatenate(places) if places else np.empty(0, np.uint32)
    id_blob = _ipc(pa.concat_arrays(ids))
    body = _packed(id_blob, _planes(np.array(lengths, np.uint32)), _planes(where), _planes(shard))
    key = "c" + xxhash.xxh3_128_hexdigest(body)
    yield key, 0, -1, body
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        mine = order[cuts[s] : cuts[s + 1]]
        if len(mine):
            part = [words[i] for i in mine.tolist()]
            sizes = _planes(np.array([len(w) for w in part], np.uint32))
            yield f"s{s}", 1, s, _packed(key.encode(), sizes, b"".join(part))


def _cutter(id_col: str, text_col: str, shards: int, pack_bytes: int):
    def rows(found) -> pa.RecordBatch:
        keys, kinds, parts, blobs = zip(*found)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())],
            names=["key", "kind", "shard", "payload"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, places, seen, size = [], [], [], {}, 0
        for batch in batches:
            texts = batch.column(text_col)
            first = 0
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                found = pre_tokens(text)
                for w in found:
                    if w not in seen:
                        seen[w] = len(seen)
                places.append(np.fromiter(map(seen.__getitem__, found), np.uint32, len(found)))
                lengths.append(len(found))
                size += len(text)
                if size >= pack_bytes:
                    ids.append(batch.column(id_col).slice(first, i + 1 - first))
                    yield rows(_chunk_rows(ids, lengths, places, seen, shards))
                    ids, lengths, places, seen, size, first = [], [], [], {}, 0, i + 1
            if first < batch.num_rows:
                ids.append(batch.column(id_col).slice(first))
        if ids:
            yield rows(_chunk_rows(ids, lengths, places, seen, shards))

    return run


def _cut_words(sizes: bytes, blob: bytes) -> list[bytes]:
    ends = np.cumsum(_numbers(sizes), dtype=np.int64).tolist()
    return [blob[a:b] for a, b in zip([0, *ends], ends)]


def _encode_shard(path: str):
    def run(rows: pa.Table) -> pa.Table:
        known: dict[bytes, list[int]] = {}
        keys, shards, blobs = [], [], []
        for kind, shard, payload in zip(*(rows.column(c) for c in ("kind", "shard", "payload"))):
            if kind.as_py() != 1:
                continue
            chunk, sizes, blob = _unpacked(payload.as_py())
            words = _cut_words(sizes, blob)
            for w in words:
                if w not in known:
                    known[w] = encode_piece(w, path)
            found = [known[w] for w in words]
            flat = np.fromiter((i for x in found for i in x), np.uint32)
            keys.append(chunk.decode())
            shards.append(shard.as_py())
            blobs.append(_packed(_planes(np.fromiter(map(len, found), np.uint32, len(found))), _planes(flat)))
        return pa.table({"key": pa.array(keys, pa.string()), "shard": pa.array(shards, pa.int32()), "payload": pa.array(blobs, pa.binary())})

    return run


def _token_lists(chunks: pa.Table, answers: pa.Table) -> Iterator[tuple[object, np.ndarray]]:
    """(id, token ids) of every document of a chunk: each position gets the ids of its pre-token."""
    replies = {s.as_py(): p for s, p in zip(answers.column("shard"), answers.column("payload"))}
    for kind, payload in zip(chunks.column("kind"), chunks.column("payload")):
        if kind.as_py() != 0:
            continue
        id_blob, lengths, places, shard = _unpacked(payload.as_py())
        ids = pa.ipc.open_stream(id_blob).read_all().column("id").to_pylist()
        ends, places, shard = np.cumsum(_numbers(lengths), dtype=np.int64), _numbers(places), _numbers(shard)
        counts, starts = np.zeros(len(shard), np.int64), np.zeros(len(shard), np.int64)
        flat, at = [np.empty(0, np.uint32)], 0
        for s in np.unique(shard).tolist():
            if s not in replies:
                raise ValueError(f"no answer of shard {s}: the chunk was recomputed from other rows")
            sizes, tokens = map(_numbers, _unpacked(replies[s].as_py()))
            mine = np.flatnonzero(shard == s)
            counts[mine] = sizes
            starts[mine] = at + np.cumsum(sizes, dtype=np.int64) - sizes
            flat.append(tokens)
            at += len(tokens)
        flat = np.concatenate(flat)
        for i, a, b in zip(ids, [0, *ends.tolist()], ends.tolist()):
            n = counts[places[a:b]]
            stop = np.cumsum(n)
            source = np.repeat(starts[places[a:b]] - (stop - n), n)
            yield i, flat[source + np.arange(len(source))]


def _tables(kind: pa.DataType):
    """What is done with the token lists of a chunk: the ids themselves, or their round trip."""

    def ids_of(found) -> pa.Table:
        found = list(found)
        lists = pa.array([x.astype(np.int32) for _, x in found], pa.list_(pa.int32()))
        return pa.table({"id": pa.array([i for i, _ in found], kind), "ids": lists})

    def digests_of(found, pieces: list[bytes]) -> pa.Table:
        rows = [(i, len(x), *digests(x, pieces)) for i, x in found]
        ids, n, sums, texts = zip(*rows) if rows else ((), (), (), ())
        return pa.table(
            {
                "id": pa.array(ids, kind),
                "n_tokens": pa.array(n, pa.int64()),
                "ids_sha256": pa.array(sums, pa.string()),
                "decoded_sha256": pa.array(texts, pa.string()),
            }
        )

    return ids_of, digests_of


def digests(ids: np.ndarray, pieces: list[bytes]) -> tuple[str, str]:
    """sha256 of the ids as little-endian 32-bit numbers, and of the bytes they decode to."""
    decoded = hashlib.sha256(decode_ids(ids, pieces)).hexdigest()
    return hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), decoded


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    out_col: str = "ids",
    pack_bytes: int = PACK_BYTES,
) -> DataFrame:
    """(id_col, out_col array<int>): the token ids of every row's text.

    One row for each input row, repeated and null ids included; a null text is
    an empty one. Other columns are left out; join them by id.
    """
    return _encoded(docs, id_col, text_col, path, pack_bytes, False).select(
        F.col("id").alias(id_col), F.col("ids").alias(out_col)
    )


def round_trip(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pack_bytes: int = PACK_BYTES
) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, and decoded again where it was put together."""
    return _encoded(docs, id_col, text_col, path, pack_bytes, True).withColumnRenamed("id", id_col)


def _encoded(docs: DataFrame, id_col: str, text_col: str, path: str | None, pack_bytes: int, decoded: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    path = path or default_path()
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    shards = max(8, chunk_count(slim, "text", SHARD_BYTES))
    kind = slim.schema["id"].dataType
    ids_of, digests_of = _tables(to_arrow_type(kind))

    def put(chunks: pa.Table, replies: pa.Table) -> pa.Table:
        found = _token_lists(chunks, replies)
        return digests_of(found, token_bytes(path)) if decoded else ids_of(found)

    cut = slim.mapInArrow(releasing_map(_cutter("id", "text", shards, pack_bytes)), _EXCHANGE)
    answers = cut.groupBy("key").applyInArrow(releasing_group(_encode_shard(path)), "key string, shard int, payload binary")
    made = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if decoded else "ids array<int>"
    return cut.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(releasing_cogroup(put), f"id {kind.simpleString()}, {made}")


def decode_ids(ids: np.ndarray, pieces: list[bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, ids.tolist()))


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded binary); null ids decode to nothing."""
    path = path or default_path()
    slim = encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = token_bytes(path)
        for batch in batches:
            n, sums, texts = [], [], []
            lists = batch.column("ids")
            flat = lists.values.to_numpy(zero_copy_only=False)
            ends = lists.offsets.to_numpy()
            for i in range(batch.num_rows):
                mine = flat[ends[i] : ends[i + 1]] if lists[i].is_valid else flat[:0]
                n.append(len(mine))
                sums.append(hashlib.sha256(mine.astype("<u4").tobytes()).hexdigest())
                texts.append(decode_ids(mine, pieces))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.binary())],
                names=["id", "n_tokens", "ids_sha256", "decoded"],
            )

    kind = slim.schema["id"].dataType.simpleString()
    out = slim.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded binary")
    return out.withColumnRenamed("id", id_col)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
