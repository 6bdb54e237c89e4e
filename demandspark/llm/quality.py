"""Quality classifier: random-indexing word vectors, pooled, under a small network.

Every word has a fixed sparse index vector of +1 and -1. The vector of a word is
the sum of the index vectors of the words near it, over all texts: one pass, no
matrix to factor, and sums of whole numbers that do not depend on how rows are
dealt to tasks. Words share `buckets` rows by their hash, so the table has a
fixed size (4 MB as floats) for any corpus and can be broadcast.

A text is the mean and the deviation of the vectors of its words, and their
number. A network of
two layers, written in numpy, learns from them on the driver, from a bounded
sample of labelled rows; a part of the sample that the network does not see sets
the temperature that makes its probabilities fit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from demandspark.llm.common import in_pieces, releasing_map, table, word_hashes
from demandspark.llm.language_id import held_out
from demandspark.session import stage

#: Letters (other than ASCII ones too), digits, or other signs, as they stand.
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\s]+")
#: The kind of token that a byte stands in, 0 for none.
KINDS = np.array([next((k for k, kind in enumerate((rb"\s", rb"[A-Za-z\x80-\xff]", rb"[0-9]")) if re.match(kind, bytes([b]))), 3) for b in range(256)], np.uint8)
#: A longer text is read token by token; shorter ones are read together up to this size.
LONG_TEXT = 4 << 20
#: Words of long texts whose bucket a task remembers.
REMEMBERED = 500_000
#: Tokens whose neighbours are counted at once.
TOKENS_AT_ONCE = 1 << 19
#: Rows of the vector table that travel together.
BLOCK = 128


@dataclass(frozen=True)
class QualityRules:
    buckets: int = 1 << 15
    """Rows of the table of word vectors, a multiple of 128."""
    size: int = 64
    """Components of a vector."""
    signs: int = 4
    """Components of an index vector that are not zero."""
    window: int = 2
    """Words on each side that are near."""
    sample: int = 20_000
    """Labelled rows that the network learns from at most: those of the smallest hash of the id."""
    calibration: int = 5
    """One in so many of them sets the temperature."""
    hidden: int = 32
    epochs: int = 30
    threshold: float = 0.7
    seed: int = 11


class _Buckets(dict):
    def __init__(self, n: int) -> None:
        self.n = n

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        at = self[word] = xxhash.xxh3_64_intdigest(word) % self.n
        return at


def token_buckets(text: bytes | None, known: _Buckets) -> np.ndarray:
    if not text:
        return np.empty(0, np.int32)
    if len(text) <= LONG_TEXT:
        found = TOKEN.findall(text)
        return np.fromiter(map(known.__getitem__, found), np.int32, len(found))
    return np.fromiter((known[m.group()] for m in TOKEN.finditer(text)), np.int32)


def column_buckets(column: pa.Array, known: _Buckets) -> Iterator[np.ndarray]:
    """`token_buckets` of each text of a column."""
    texts = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + LONG_TEXT, "right")) - 1)
        size = int(ends[last] - ends[first])
        if not size or size > LONG_TEXT:
            yield from (token_buckets(texts[i].as_py(), known) for i in range(first, last))
        else:
            data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(ends[first]))
            yield from _buckets_together(data, ends[first : last + 1] - ends[first], known.n)
        first = last


def _buckets_together(data: np.ndarray, ends: np.ndarray, n: int) -> list[np.ndarray]:
    """Buckets of the tokens of each text; the texts lie in `data` between `ends`. Equal tokens are hashed once."""
    kinds = KINDS[data]
    cut = np.ones(len(data) + 1, bool)
    np.not_equal(kinds[1:], kinds[:-1], out=cut[1:-1])
    cut[ends] = True
    at = np.flatnonzero(cut)
    kept = kinds[at[:-1]] > 0
    runs = pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    found = runs.filter(pa.array(kept)).dictionary_encode()
    own = word_hashes(found.dictionary.to_numpy(zero_copy_only=False)) % np.uint64(n)
    before = np.concatenate([[0], np.cumsum(kept)])
    return np.split(own.astype(np.int32)[found.indices.to_numpy()], before[np.searchsorted(at, ends[1:-1])])


def index_vectors(rules: QualityRules) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the components of each index vector that are not zero."""
    rng = np.random.default_rng(rules.seed)
    shape = (rules.buckets, rules.signs)
    return rng.integers(0, rules.size, shape), rng.integers(0, 2, shape) * 2 - 1


def _add_contexts(total: np.ndarray, tokens: np.ndarray, index: tuple[np.ndarray, np.ndarray], rules: QualityRules) -> None:
    """Adds the index vectors of neighbours to the words' sums, which lie component by component; `window` times -1 stands between texts."""
    places, signs = index
    vectors = np.zeros((rules.size, rules.buckets + 1), np.min_scalar_type(-2 * rules.window * rules.signs - 1))  # the last one, of -1, stays zero
    np.add.at(vectors, (places, np.arange(rules.buckets)[:, None]), signs.astype(vectors.dtype))
    sums, side = total.reshape(rules.size, rules.buckets), np.full(rules.window, -1, tokens.dtype)
    padded = np.concatenate([side, tokens, side])
    for first in range(0, len(tokens), TOKENS_AT_ONCE):
        part = padded[first : first + TOKENS_AT_ONCE + 2 * rules.window].astype(np.int64) % (rules.buckets + 1)
        words = part[rules.window : len(part) - rules.window]
        for component in range(rules.size):
            of = vectors[component].take(part, mode="wrap")  # faster than the check of places, which are right
            near = np.zeros(len(words), of.dtype)
            for shift in range(2 * rules.window + 1):
                if shift != rules.window:
                    near += of[shift : shift + len(words)]
            sums[component] += np.bincount(words, near, rules.buckets + 1)[:-1].astype(np.int64)


def _context_sums(rules: QualityRules):
    """(block, sums) of a task: the sums of BLOCK words, as 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index = _Buckets(rules.buckets), index_vectors(rules)
        total = np.zeros(rules.buckets * rules.size, np.int64)
        gap = np.full(rules.window, -1, np.int32)
        held, size = [], 0
        for batch in in_pieces(batches):
            for tokens in column_buckets(batch.column("text"), known):
                held += [tokens, gap]
                size += len(tokens) + 1
                if size >= TOKENS_AT_ONCE:
                    _add_contexts(total, np.concatenate(held), index, rules)
                    held, size = [], 0
        if held:
            _add_contexts(total, np.concatenate(held), index, rules)
        if total.any():
            rows = total.reshape(rules.size, rules.buckets).T.reshape(-1, BLOCK * rules.size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["block", "sums"]
            )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each block, added as they stream in."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
            if block in total:
                total[block] += np.frombuffer(sums, np.int64)
            else:
                total[block] = np.frombuffer(sums, np.int64).copy()
    for block, sums in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["block", "sums"])


def word_vectors(docs: DataFrame, text_col: str = "text", rules: QualityRules = QualityRules()) -> np.ndarray:
    """(buckets, size) unit vectors, float32, from all texts; buckets without a word have zeros."""
    texts = docs.select(F.col(f"`{text_col}`").alias("text")).where("text is not null")
    kind = "block int, sums binary"
    summed = texts.mapInArrow(releasing_map(_context_sums(rules)), kind).repartition("block").mapInArrow(releasing_map(_added), kind)
    counts = np.zeros((rules.buckets, rules.size))
    for block, sums in summed.toLocalIterator():
        counts[block * BLOCK : (block + 1) * BLOCK] += np.frombuffer(bytes(sums), np.int64).reshape(BLOCK, rules.size)
    unit = counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1)
    used = counts.any(1)
    if used.any():  # what all words have in common tells nothing
        unit[used] -= unit[used].mean(0)
        unit[used] /= np.maximum(np.linalg.norm(unit[used], axis=1, keepdims=True), 1e-9)
    return unit.astype(np.float32)


def pooled(tokens: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the vectors of a text's words, and the logarithm of their number; zeros without words."""
    if not len(tokens):
        return np.zeros(2 * vectors.shape[1] + 1)
    words, counts = np.unique(tokens, return_counts=True)
    share = counts / len(tokens)
    own = vectors[words].astype(np.float64)
    mean = share @ own
    return np.concatenate([mean, np.sqrt(np.maximum(share @ (own * own) - mean * mean, 0)), [np.log1p(len(tokens))]])


@dataclass
class Network:
    """x -> relu -> probability; `mean` and `spread` bring inputs to one scale."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.spread @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.logits(x) / self.temperature)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, rules: QualityRules) -> Network:
    """Two layers by Adam on the logistic loss, with a fixed seed. One class or no rows give its share for every text."""
    n = x.shape[1]
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
        return Network(np.zeros(n), np.ones(n), np.zeros((n, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(rules.seed)
    net = Network(x.mean(0), x.std(0) + 1e-3, rng.standard_normal((n, rules.hidden)) * np.sqrt(2 / n), np.zeros(rules.hidden), rng.standard_normal(rules.hidden) * np.sqrt(1 / rules.hidden), 0.0)
    z = (x - net.mean) / net.spread
    held = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held]
    step = 0
    for _ in range(rules.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            rows = order[at : at + 128]
            a = z[rows] @ held[0] + held[1]
            h = np.maximum(a, 0)
            wrong = (_logistic(h @ held[2] + held[3][0]) - y[rows]) / len(rows)
            back = np.outer(wrong, held[2]) * (a > 0)
            slopes = [z[rows].T @ back + 1e-4 * held[0], back.sum(0), h.T @ wrong + 1e-4 * held[2], np.array([wrong.sum()])]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                held[i] -= 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = held[0], held[1], held[2], float(held[3][0])
    return net


def calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> None:
    """The temperature of the least logistic loss, between 0.05 and 20, by golden section."""
    if not len(y):
        return
    logits = net.logits(x)

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        return float(np.logaddexp(0, z).sum() - (y * z).sum())

    a, b, ratio = np.log(0.05), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    net.temperature = float(np.exp((a + b) / 2))


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    network: Network
    rules: QualityRules


def _pooler(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, rules = shared.value
        known = _Buckets(rules.buckets)
        for batch in in_pieces(batches):
            rows = [pooled(tokens, vectors).tobytes() for tokens in column_buckets(batch.column("text"), known)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(rows, pa.binary())], names=["id", "y", "x"])

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rules: QualityRules = QualityRules(),
) -> QualityModel:
    """Word vectors from all of `docs`; the network from those that `labels` marks 0 or 1.

    Of labels that share an id the lowest counts; null labels and ids are left
    out. Of rows of `docs` that share an id one is learned from, that of the smallest packed vector.
    """
    vectors = word_vectors(docs, text_col, rules)
    spark = docs.sparkSession
    key, y = F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")
    marked = labels.select(key, y).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    # The sample is one of labelled documents, not of labels that may have no document.
    ids = docs.select(key, F.col(f"`{text_col}`").alias("text")).where("id is not null")
    there = ids.select("id").join(marked, "id").groupBy("id", "y").agg(F.count(F.lit(1)).alias("rows"))
    chosen = stage(there.orderBy(F.xxhash64("id"), "id").limit(rules.sample).select("id", "y"))
    sample = ids.join(F.broadcast(chosen), "id").select("id", "y", "text")
    kind = StructType([sample.schema["id"], *StructType.fromDDL("y int, x binary").fields])
    rows = sample.mapInArrow(releasing_map(_pooler(spark.sparkContext.broadcast((vectors, rules)))), kind)
    # One row for each id, so the driver holds the sample and not its copies; a kilobyte each.
    found = sorted(rows.groupBy("id", "y").agg(F.min("x").alias("x")).collect(), key=lambda r: r[0])
    x = np.frombuffer(b"".join(r[2] for r in found), np.float64).reshape(len(found), 2 * rules.size + 1)
    target = np.array([r[1] for r in found], np.float64)
    fold = np.array([xxhash.xxh3_64_intdigest(str(r[0]).encode()) % rules.calibration for r in found], np.int64)
    network = fit(x[fold > 0], target[fold > 0], rules)
    calibrate(network, x[fold == 0], target[fold == 0])
    return QualityModel(vectors, network, rules)


def _scorer(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: QualityModel = shared.value
        known = _Buckets(model.rules.buckets)
        for batch in in_pieces(batches):
            x = np.stack([pooled(tokens, model.vectors) for tokens in column_buckets(batch.column("__text"), known)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(model.network.scores(x))], names=[*columns, "__score"])

    return run


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with the probability of label 1 (it replaces a column of that name).

    Null and empty texts, and those without any sign, have no words: they all get the
    score of a text whose vectors are zero. Every row is scored alone, whole.
    """
    keep = [c for c in docs.columns if c != score_col]
    names = [f"__k{i}" for i in range(len(keep))]
    given = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text_col}`").alias("__text"))
    schema = StructType([*[given.schema[n] for n in names], *StructType.fromDDL("__score double").fields])
    out = given.mapInArrow(releasing_map(_scorer(docs.sparkSession.sparkContext.broadcast(model), names)), schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], F.col("__score").alias(score_col))


def op11_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(docs, labels.where(~held_out()))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= model.rules.threshold).cast("int").alias("predicted"))
