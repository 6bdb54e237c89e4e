"""Language ID: unigram pieces of a fixed public vocabulary, summed over all segmentations.

A word (a space and the lower-cased bytes up to white space) can be cut into
vocabulary pieces in many ways. A language gives each piece a probability; the
probability of a word is the sum over all its segmentations, which a forward
pass over its bytes computes, for all languages at once. A text's score is the
sum of the logarithms over its words.

Training is one expectation step from equal piece probabilities: a forward and
a backward pass give the expected count of each piece in each different word of
a task, and the counts of (language, piece) are summed over the corpus as whole
numbers, so the result does not depend on how rows are dealt to tasks. The
model has at most (languages x pieces) numbers, whatever the corpus holds.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from demandspark.llm.bpe import _ranks, default_path
from demandspark.llm.common import in_pieces, releasing_map, table

#: Words of up to this many bytes are summed with others of their length, longer ones in segments.
WORD_BYTES = 64
#: Bytes of long words taken up at once; the sums at the last bytes, as many as the longest piece has, go over to the next ones.
SEGMENT = 4096
#: Bytes of long words summed side by side, unless one alone has more.
LONG_BYTES = 1 << 20
#: Sums of long words are brought back near 1 every so many bytes, and the power of two is kept.
RESCALED = 16
#: Numbers (words, bytes and languages) that sums of one batch hold.
NUMBERS = 1 << 22
#: Text taken up at once.
PIECE_BYTES = 2 << 20
#: Different words of a task that are scored at once, then forgotten.
WORDS_AT_ONCE = 250_000
#: Expected counts are summed as whole multiples of this.
GRAIN = 1 << 16
#: A probability below this is summed again by its logarithms: a term lost to underflow is far too small for one above it.
TINY = 1e-200
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageRules:
    smoothing: float = 0.05
    """Added to the count of every piece."""
    most_languages: int = 500
    """More different labels than this are an error: labels are no languages then."""


def _beginnings(children: list[list[int]]) -> tuple[np.ndarray, int]:
    """Where each node's children begin so that no two share a place, and how many places there are; children: bytes, ascending."""
    begin = np.zeros(len(children), np.int32)
    span, start = 4096, 256  # places tried at once; no beginning is negative
    free = np.ones(4 * span, bool)
    for i in sorted((i for i, mine in enumerate(children) if len(mine) > 1), key=lambda i: -len(children[i])):
        mine = np.array(children[i]) - children[i][0]
        while True:
            if len(free) < start + span + 256:
                free = np.concatenate([free, np.ones(len(free), bool)])
            fits = free[start : start + span].copy()
            for c in mine[1:].tolist():
                fits &= free[start + c : start + c + span]
            at = int(fits.argmax())
            if fits[at]:
                break
            start += span // 2
        free[start + at + mine] = False
        begin[i] = start + at - children[i][0]
    single = [i for i, mine in enumerate(children) if len(mine) == 1]
    free = np.concatenate([free, np.ones(len(single), bool)])
    places = 256 + np.flatnonzero(free[256:])[: len(single)]
    begin[single] = places - np.array([children[i][0] for i in single], np.int64)
    return begin, max(len(free) - len(single), int(places[-1]) + 1 if len(single) else 0) + 256


class Pieces:
    """The vocabulary as a tree of bytes: nodes with children first.

    The children of all nodes share one array, in which a node has a beginning
    of its own: its child for a byte lies that many places on, if the place
    names the node as its owner. So the tree takes about 20 bytes a node.
    """

    def __init__(self, path: str) -> None:
        known = sorted(_ranks(path))
        self.size = len(known)
        self.longest = max(map(len, known))
        nodes = sorted({p[:n] for p in known for n in range(len(p) + 1)})
        inner = {p[:-1] for p in nodes if p}
        nodes.sort(key=lambda p: p not in inner)
        number = {p: i for i, p in enumerate(nodes)}
        self.inner = len(inner)
        children: list[list[int]] = [[] for _ in range(self.inner)]
        numbers: list[list[int]] = [[] for _ in range(self.inner)]
        for p, i in number.items():
            if p:
                up = number[p[:-1]]
                children[up].append(p[-1])
                numbers[up].append(i)
        self.begin, places = _beginnings(children)
        self.owner, self.child = np.full(places, -1, np.int32), np.full(places, -1, np.int32)
        for i, (mine, their) in enumerate(zip(children, numbers)):
            at = self.begin[i] + np.array(mine)
            self.owner[at], self.child[at] = i, their
        self.first = np.full(256, -1, np.int32)
        self.first[children[0]] = numbers[0]
        self.piece = np.full(len(nodes), self.size, np.int32)
        self.piece[[number[p] for p in known]] = np.arange(self.size)

    def lattice(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For n words of one length: (from, to, piece, cuts) of all pieces in them.

        `from` and `to` are byte * n + word, in the order of `from`; those from
        byte i are cuts[i] to cuts[i + 1].
        """
        length, n = len(words[0]), len(words)
        return self.edges(np.ascontiguousarray(np.frombuffer(b"".join(words), np.uint8).reshape(n, length).T))

    def edges(self, bytes_by_place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for a matrix with a row for each byte and a column for each word."""
        length, n = bytes_by_place.shape
        text = bytes_by_place.ravel()
        at, node = np.arange(length * n, dtype=np.int32), self.first[text]
        begin, end, piece = [], [], []
        for depth in range(1, length + 1):
            ids = self.piece[node]
            is_piece = ids < self.size
            begin.append(at[is_piece])
            end.append(begin[-1] + depth * n)
            piece.append(ids[is_piece])
            goes_on = node < self.inner
            goes_on[np.searchsorted(at, (length - depth) * n) :] = False
            at, node = at[goes_on], node[goes_on]
            place = self.begin[node] + text[at + depth * n]
            has = self.owner[place] == node
            at, node = at[has], self.child[place[has]]
            if not len(at):
                break
        begin, end, piece = map(np.concatenate, (begin, end, piece))
        order = np.argsort(begin, kind="stable")
        begin = begin[order]
        return begin, end[order], piece[order], np.searchsorted(begin, np.arange(length + 1) * n)


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def words_of(text: str | None) -> list[bytes]:
    if not text:
        return []
    return [b" " + w for w in text.lower().encode().split()]


def _by_length(words: list[bytes], languages: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Batches of short words of one length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    most = max(1, min(8192, NUMBERS // (max(1, languages) * (WORD_BYTES + 1))))
    for n in np.unique(lengths[lengths <= WORD_BYTES]).tolist():
        at = np.flatnonzero(lengths == n)
        for first in range(0, len(at), most):
            part = at[first : first + most]
            yield part, [words[i] for i in part.tolist()]


class _Long:
    """Some long words side by side, each padded to the longest: their pieces, segment by segment."""

    def __init__(self, words: list[bytes], vocabulary: Pieces) -> None:
        self.vocabulary, self.n = vocabulary, len(words)
        self.lengths = np.fromiter(map(len, words), np.int64, self.n)
        self.words, self.length = words, int(self.lengths.max())
        #: Sums that a byte can reach or be reached from.
        self.alive = vocabulary.longest + 1

    def starts(self) -> range:
        return range(0, self.length, SEGMENT)

    def segment(self, start: int):
        """(bytes, begin, end, piece, cuts) of the pieces that begin in a segment and end within their word."""
        stop = min(start + SEGMENT, self.length)
        part = [w[start : stop + self.alive].ljust(min(stop + self.alive, self.length) - start) for w in self.words]
        begin, end, piece, cuts = self.vocabulary.lattice(part)
        last = cuts[stop - start]
        begin, end, piece = begin[:last].astype(np.int64), end[:last].astype(np.int64), piece[:last]
        inside = end // self.n + start <= self.lengths[end % self.n]
        begin = begin[inside]
        return stop - start, begin, end[inside], piece[inside], np.searchsorted(begin, np.arange(stop - start + 1) * self.n)


def _long_batches(words: list[bytes], languages: int, vocabulary: Pieces) -> Iterator[tuple[np.ndarray, _Long]]:
    """Long words, those of similar lengths together."""
    at = sorted((i for i, w in enumerate(words) if len(w) > WORD_BYTES), key=lambda i: len(words[i]))
    most = max(1, NUMBERS // (max(1, languages) * (vocabulary.longest + 1)))
    while at:
        k = 1
        while k < min(len(at), most) and (k + 1) * len(words[at[k]]) <= LONG_BYTES:
            k += 1
        yield np.array(at[:k]), _Long([words[i] for i in at[:k]], vocabulary)
        at = at[k:]


def _rescale(rows: np.ndarray, power: np.ndarray) -> None:
    """Multiplies sums by a power of two that brings the largest near 1; `power` keeps what they were multiplied by."""
    shift = -np.frexp(rows.max(0))[1]
    np.ldexp(rows, shift, out=rows)
    power += shift


def _long_scores(batch: _Long, model: np.ndarray) -> np.ndarray:
    """(words, languages): log of the sum over all segmentations of words of any length."""
    n, alive = batch.n, batch.alive
    ring = np.zeros((alive, n, model.shape[1]))
    ring[0] = 1
    power = np.zeros(ring.shape[1:], np.int64)
    out = np.empty(ring.shape[1:])
    for start in batch.starts():
        size, begin, end, piece, cuts = batch.segment(start)
        word, to, chance = begin % n, (end // n + start) % alive, model[piece]
        for i in range(size):
            now = (start + i) % alive
            if i % RESCALED == 0:
                _rescale(ring, power)
            mine = slice(cuts[i], cuts[i + 1])
            ring[to[mine], word[mine]] += ring[now][word[mine]] * chance[mine]
            ring[now] = 0
            done = np.flatnonzero(batch.lengths == start + i + 1)
            if len(done):
                out[done] = np.log(ring[(now + 1) % alive, done]) - power[done] * np.log(2)
    return out


def _long_counts(batch: _Long, counts: np.ndarray, total: np.ndarray) -> None:
    """Adds the expected counts of words of any length; counts: (words, languages).

    The forward sums are kept at the start of each segment and made again
    when the backward pass gets there, so memory does not grow with the words.
    """
    n, alive, weight = batch.n, batch.alive, 1 / 256

    def forward(start: int, carried: np.ndarray, power: np.ndarray):
        size, begin, end, piece, cuts = batch.segment(start)
        fore, powers = np.zeros((size + alive, n)), np.zeros((size + 1, n), np.int64)
        fore[:alive] = carried
        power = power.copy()
        for i in range(size):
            if i % RESCALED == 0:
                _rescale(fore[i : i + alive], power)
            powers[i] = power
            mine = slice(cuts[i], cuts[i + 1])
            fore[end[mine] // n, end[mine] % n] += fore[i, begin[mine] % n] * weight
        powers[size] = power
        return fore, powers, (begin, end, piece, cuts)

    carried, power = np.zeros((alive, n)), np.zeros(n, np.int64)
    carried[0] = 1
    saved, last, last_power = [], np.zeros(n), np.zeros(n, np.int64)
    for start in batch.starts():
        saved.append((start, carried, power))
        fore, powers, _ = forward(start, carried, power)
        size = len(powers) - 1
        carried, power = fore[size:].copy(), powers[size].copy()
        ends = np.flatnonzero((batch.lengths > start) & (batch.lengths <= start + size))
        at = batch.lengths[ends] - start
        last[ends], last_power[ends] = fore[at, ends], powers[at, ends]
    after, back_power = np.zeros((alive, n)), np.zeros(n, np.int64)
    for start, carried, power in reversed(saved):
        fore, powers, (begin, end, piece, cuts) = forward(start, carried, power)
        size = len(powers) - 1
        back, share = np.zeros((size + alive, n)), np.empty(len(piece))
        back[size:] = after
        ends = np.flatnonzero((batch.lengths > start) & (batch.lengths <= start + size))
        back[batch.lengths[ends] - start, ends], back_power[ends] = 1, 0
        for i in range(size - 1, -1, -1):
            if i % RESCALED == 0:
                _rescale(back[i + 1 : i + 1 + alive], back_power)
            mine = slice(cuts[i], cuts[i + 1])
            word = begin[mine] % n
            there = back[end[mine] // n, end[mine] % n] * weight
            share[mine] = np.ldexp(fore[i, word] * there / last[word], last_power[word] - powers[i, word] - back_power[word])
            back[i] += np.bincount(word, there, n)
        after = back[:alive].copy()
        share = np.rint(share * GRAIN)
        for language in range(counts.shape[1]):
            total[language] += np.bincount(piece, share * counts[begin % n, language], len(total[language]))


def expected_counts(words: list[bytes], counts: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """(languages, pieces) expected counts in whole multiples of 1 / GRAIN; counts: (words, languages).

    All pieces are equally likely. Rounded word by word, so sums are exact.
    """
    total = np.zeros((counts.shape[1], vocabulary.size))
    weight = 1 / 256
    for at, batch in _long_batches(words, 1, vocabulary):
        _long_counts(batch, counts[at], total)
    for at, part in _by_length(words, 1):
        length, n = len(part[0]), len(part)
        begin, end, piece, cuts = vocabulary.lattice(part)
        fore, back = np.zeros((length + 1) * n), np.zeros((length + 1) * n)
        fore[:n], back[length * n :] = 1, 1
        for i in range(length):
            mine = slice(cuts[i], cuts[i + 1])
            fore[end[mine]] += fore[begin[mine]] * weight
        for i in range(length - 1, -1, -1):
            mine = slice(cuts[i], cuts[i + 1])
            back[i * n : (i + 1) * n] = np.bincount(begin[mine] - i * n, back[end[mine]] * weight, n)
        word = begin % n
        share = np.rint(fore[begin] * weight * back[end] / fore[length * n + word] * GRAIN)
        for language in range(counts.shape[1]):
            total[language] += np.bincount(piece, share * counts[at[word], language], vocabulary.size)
    return total


def word_scores(words: list[bytes], model: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """(words, languages): log of the sum over all segmentations. model: (pieces + 1, languages), last row zero."""
    out = np.empty((len(words), model.shape[1]))
    for at, batch in _long_batches(words, model.shape[1], vocabulary):
        out[at] = _long_scores(batch, model)
    for at, part in _by_length(words, model.shape[1]):
        length, n = len(part[0]), len(part)
        begin, end, piece, cuts = vocabulary.lattice(part)
        fore = np.zeros(((length + 1) * n, model.shape[1]))
        fore[:n] = 1
        for i in range(length):
            mine = slice(cuts[i], cuts[i + 1])
            fore[end[mine]] += fore[begin[mine]] * model[piece[mine]]
        total = fore[length * n :]
        small = np.flatnonzero((total < TINY).any(1))
        total[small] = 1
        out[at] = np.log(total)
        if len(small):
            out[at[small]] = _log_scores([part[w] for w in small.tolist()], model, vocabulary)
    return out


def _log_scores(words: list[bytes], model: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """The same for words of one length, by sums of logarithms, which cannot underflow."""
    length, n = len(words[0]), len(words)
    begin, end, piece, cuts = vocabulary.lattice(words)
    fore = np.full(((length + 1) * n, model.shape[1]), -np.inf)
    fore[:n] = 0
    with np.errstate(divide="ignore"):
        for i in range(length):
            mine = slice(cuts[i], cuts[i + 1])
            # A word's pieces from one byte end at different bytes, so no place comes twice.
            fore[end[mine]] = np.logaddexp(fore[end[mine]], fore[begin[mine]] + np.log(model[piece[mine]]))
    return fore[length * n :]


def _trainer(path: str, languages: list[str]):
    number = {x: i for i, x in enumerate(languages)}

    def emit(seen: dict[bytes, int], counts: list[np.ndarray]) -> pa.RecordBatch:
        total = expected_counts(list(seen), np.array(counts, np.float64).reshape(len(seen), -1), pieces(path))
        whole = total.astype(np.int64)
        language, piece = np.nonzero(whole)
        return pa.RecordBatch.from_arrays(
            [pa.array(language.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(whole[language, piece])],
            names=["language", "piece", "n"],
        )

    at_once = min(WORDS_AT_ONCE, max(1, 4 * NUMBERS // len(languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        counts = np.zeros((at_once, len(languages)))
        for batch in in_pieces(batches, PIECE_BYTES):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                for w in set(words):
                    if w not in seen:
                        seen[w] = len(seen)
                if len(seen) > len(counts):
                    counts = np.concatenate([counts, np.zeros((len(seen), len(languages)))])
                np.add.at(counts[:, number[label]], np.fromiter(map(seen.__getitem__, words), np.int64, len(words)), 1)
                if len(seen) >= at_once:
                    yield emit(seen, counts[: len(seen)])
                    seen, counts = {}, np.zeros((at_once, len(languages)))
        if seen:
            yield emit(seen, counts[: len(seen)])

    return run


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    logs: np.ndarray
    """Piece probabilities, (pieces + 1, languages), last row zero."""
    prior: np.ndarray
    path: str


def train(
    docs: DataFrame, text_col: str = "text", label_col: str = "lang", path: str | None = None, rules: LanguageRules = LanguageRules()
) -> LanguageModel:
    """Learns from every row with a text and a label; rows without either are left out."""
    path = path or default_path()
    slim = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").alias("label")).where(
        "text is not null and label is not null"
    )
    labels = slim.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").limit(rules.most_languages + 1).collect()
    if len(labels) > rules.most_languages:
        raise ValueError(f"more than {rules.most_languages} different labels")
    languages = [r.label for r in labels]
    size = pieces(path).size
    counts = np.zeros((size + 1, len(languages)))
    if languages:
        summed = slim.mapInArrow(releasing_map(_trainer(path, languages)), "language int, piece int, n bigint").groupBy("language", "piece").agg(F.sum("n").alias("n"))
        for language, piece, n in summed.toLocalIterator():
            counts[piece, language] = n / GRAIN
    model = counts + rules.smoothing
    model[size] = 0
    model /= np.maximum(model.sum(0), 1e-300)
    prior = np.log(np.array([r.n for r in labels], np.float64) / max(1, sum(r.n for r in labels))) if labels else np.zeros(0)
    return LanguageModel(languages, model, prior, path)


def _predictor(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        vocabulary = pieces(model.path)
        seen: dict[bytes, int] = {}
        scores = np.empty((0, len(model.languages)))
        for batch in in_pieces(batches, PIECE_BYTES):
            texts, letters = batch.column("__text").to_pylist(), batch.column("__letters").to_pylist()
            found = [words_of(t) if l else [] for t, l in zip(texts, letters)]
            fresh = list(dict.fromkeys(w for words in found for w in words if w not in seen))
            if fresh:
                seen.update(zip(fresh, range(len(seen), len(seen) + len(fresh))))
                scores = np.concatenate([scores, word_scores(fresh, model.logs, vocabulary)])
            names, sure = [], []
            for words in found:
                if not words or not model.languages:
                    names.append(UNKNOWN)
                    sure.append(0.0)
                    continue
                total = model.prior + scores[np.fromiter(map(seen.__getitem__, words), np.int64, len(words))].sum(0)
                best = int(total.argmax())
                names.append(model.languages[best])
                sure.append(float(1 / np.exp(total - total[best]).sum()))
            if len(seen) * len(model.languages) > 4 * NUMBERS or len(seen) > WORDS_AT_ONCE:
                seen, scores = {}, np.empty((0, len(model.languages)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(names, pa.string()), pa.array(sure, pa.float64())],
                names=[*columns, "__name", "__sure"],
            )

    return run


def predict(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", name_col: str = "lang_pred", score_col: str = "score"
) -> DataFrame:
    """`docs` with the language and its posterior probability (they replace columns of the names).

    A null text, or one without a letter, is `und` with score 0. Of languages
    with equal scores the first by name wins. Words are never cut: a run of any
    length without white space is summed over all its segmentations.
    """
    from pyspark.sql.types import StructType

    keep = [c for c in docs.columns if c not in (name_col, score_col)]
    text = F.col(f"`{text_col}`")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    given = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("__text"), letters.alias("__letters"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*[given.schema[c] for c in keep], *StructType.fromDDL("__name string, __sure double").fields])
    out = given.mapInArrow(releasing_map(_predictor(shared, keep)), schema)
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("__name").alias(name_col), F.col("__sure").alias(score_col))


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(4)) == 2, F.lit(False))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
