"""Quality scores, phrases and vector codes against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from demandspark.llm import phrases as P, quality as Q, vector_codes as V


# -- phrases --------------------------------------------------------------------------------
def plain_phrases(rows, rules):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, rules.longest + 1):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = set()
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) >= 2 and a >= rules.support}
        kept = []
        for p, a in often.items():
            cuts = [(rules.scale * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            longer = [b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= rules.covered * a for b in longer):
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[: rules.top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return out


@pytest.mark.parametrize("rules", [P.PhraseRules(), P.PhraseRules(support=3, longest=4, top=7, shards=2, chunk_bytes=50, salts=3), P.PhraseRules(support=1, shards=1, longest=2)])
def test_phrases_equal_a_plain_version(spark, rules):
    rnd = random.Random(5)
    words = ["a", "B", "é", "É", "\x00x", "c\x85d", "long" * 50, "the", "of", "-"]
    rows = [(rnd.choice(["en", "de", None, "und"]), "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\t", ". ", "\n", " ", " ", "\x0b", "; "]) for _ in range(rnd.randrange(40)))) for _ in range(200)]
    rows += [("en", None), ("en", ""), ("fr", "..."), ("en", " of the " * 300), ("en", "new york city. " * 30)] * 2
    df = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], "doc_id int, lang string, text string, phrase int").repartition(5)
    got = [tuple(r) for r in P.collocations(df, rules=rules).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_phrases(rows, rules)


def test_phrases_that_share_a_bit_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(P, "_bits", lambda h: np.zeros(len(h), np.int64))  # as if the bitmap were full
    monkeypatch.setattr(P, "_in_bitmap", lambda bitmap, h: np.ones(len(h), bool))
    rows = [("en", "a b c " * 12), ("en", "a c " * 9)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert {tuple(r) for r in P.collocations(df).collect()} == plain_phrases(rows, P.PhraseRules())


def test_phrases_of_an_empty_table(spark):
    assert P.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_a_shard_support_below_two_is_not_the_default():
    assert -(-P.PhraseRules().support // P.PhraseRules().shards) >= 2


@pytest.mark.parametrize("held", [1, 5000, P.HELD_HASHES])
def test_mined_phrases_travel_packed_and_in_parts(monkeypatch, held):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 4)

    monkeypatch.setattr(P, "TaskContext", Task)
    monkeypatch.setattr(P, "HELD_HASHES", held)
    rnd = random.Random(8)
    texts = [" ".join(f"w{int(rnd.paretovariate(0.3)) % 50_000}" for _ in range(2000)) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"lang": [rnd.choice(["en", "de"]) for _ in texts], "text": texts})
    rules, parts = P.PhraseRules(chunk_bytes=200_000), 7
    sent = pa.Table.from_batches(P._miner(None, 1, rules, parts)(iter([batch])))
    counts = Counter((lang, w) for lang, t in zip(batch.column("lang").to_pylist(), texts) for w in t.split())
    assert set(sent["part"].to_pylist()) == set(range(parts, 2 * parts))  # task 4 is of the second shard
    if held > 1:
        assert sent["payload"].nbytes < 6 * len(counts)  # a row of hash and count has 16 bytes
    often = [k for part in range(parts, 2 * parts) for k in P._often(4)(sent.filter(pc.equal(sent["part"], part)))["key"].to_pylist()]
    assert len(often) == len(set(often)) == sum(n >= 4 for n in counts.values())
    want = {int(P.mixed(P._language(lang, P.word_hashes([w.encode()])) + np.uint64(1))[0]) & ((1 << P.HASH_BITS) - 1) for (lang, w), n in counts.items() if n >= 4}
    assert set(often) == want


@pytest.mark.parametrize("held", [1, P.HELD_HASHES])
def test_counted_phrases_travel_packed(monkeypatch, held):
    class Full:
        value = np.full(P.BITMAP_BITS // 8, 255, np.uint8)

    monkeypatch.setattr(P, "HELD_HASHES", held)
    rnd = random.Random(10)
    texts = [" ".join(f"word{int(rnd.paretovariate(0.5)) % 5000}" for _ in range(1000)) for _ in range(20)]
    langs = [rnd.choice(["en", "und"]) for _ in texts]
    sent = pa.Table.from_batches(P._counter(Full, P.PhraseRules(chunk_bytes=50_000), 5)(iter([pa.RecordBatch.from_pydict({"lang": langs, "text": texts})])))
    want = Counter()
    for lang, t in zip(langs, texts):
        w = t.split()
        want[lang, "", 0] += len(w)
        want.update((lang, " ".join(w[i : i + n]), n) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    got = [tuple(r.values()) for p in range(5) for r in P._counted(2)(sent.filter(pc.equal(sent["part"], p))).to_pylist()]
    assert sorted(got) == sorted((*k, n) for k, n in want.items() if n >= 2)
    if held > 1:
        assert 3 * sent["payload"].nbytes < sum(len(lang) + len(p) + 12 for lang, p, _ in want)  # rows of (lang, phrase, words, n)


def test_many_parts_give_the_same_phrases(spark, monkeypatch):
    monkeypatch.setattr(P, "PART_BYTES", 50)
    rnd = random.Random(9)
    rows = [(rnd.choice(["en", None]), " ".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(30)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    assert {tuple(r) for r in P.collocations(df).collect()} == plain_phrases(rows, P.PhraseRules())


# -- vector codes ---------------------------------------------------------------------------
def plain_codes(rows, rules=V.CodeRules()):
    """Lloyd with whole scans and Python integers; rows of (id, vector)."""
    good = [(i, [float(x) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(good[0][1])

    def whole(x):
        a, b = x.as_integer_ratio()
        return a * rules.scale // b

    vectors = [(i, [whole(x) for x in v]) for i, v in good if len(v) == dim]
    parts = [(p * dim // rules.parts, (p + 1) * dim // rules.parts) for p in range(rules.parts)]
    books = [[v[a:b] for _, v in vectors[: rules.entries]] for a, b in parts]

    def nearest():
        return [[min((sum((x - y) ** 2 for x, y in zip(v[a:b], c)), j) for j, c in enumerate(book)) for (a, b), book in zip(parts, books)] for _, v in vectors]

    for _ in range(rules.rounds):
        found = nearest()
        for p, (a, b) in enumerate(parts):
            for j in range(len(books[p])):
                mine = [v[a:b] for (_, v), f in zip(vectors, found) if f[p][1] == j]
                if mine:
                    books[p][j] = [sum(col) // len(mine) for col in zip(*mine)]
    out = Counter()
    for (i, _), f in zip(vectors, nearest()):
        error = sum(d for d, _ in f)
        out[i, "".join(f"{j:02x}" for _, j in f), error if error < 1 << 63 else None] += 1
    out.update((i, None, None) for i, v in good if len(v) != dim)
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return out, digest


def _vectors(kind, n=160, dim=16):
    rng = np.random.default_rng(8)
    if kind == "ties":
        return [(i, [float(x) for x in rng.integers(-1, 2, dim) / 4096]) for i in range(n)]
    if kind == "huge":
        return [(i, [float(x) for x in rng.standard_normal(dim) * 10.0 ** rng.choice([0, 12, 30])]) for i in range(n)]
    if kind == "odd":
        return [(i, [float(x) for x in rng.standard_normal(13)]) for i in range(n)]
    return [(i, [float(np.float32(x)) for x in rng.standard_normal(dim) / 8 + (i % 5)]) for i in range(n)]


@pytest.mark.parametrize("kind", ["plain", "ties", "huge", "odd"])
def test_codes_equal_whole_scans(spark, kind):
    rows = _vectors(kind)
    rows += [(1000, None), (1001, [None] + rows[0][1][1:]), (1002, [float("nan")] * 16), (1003, [float("-inf")] * 16)]
    rows += [rows[3], rows[3], (3, rows[4][1]), (None, rows[5][1]), (1004, [1.0, 2.0]), (1005, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, error string").repartition(4)
    got = V.encode(df)
    want, digest = plain_codes(rows)
    assert got.digest == digest
    assert Counter((r.vec_id, r.code, r.error) for r in got.rows.collect()) == want


def test_moved_entries_are_enough():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, book = rng.integers(-3, 4, (200, 3)), rng.integers(-3, 4, (6, 3))
        code, best = V.scan(x, book)
        after = book.copy()
        moved = rng.random(6) < rng.choice([0, 0.3, 1])
        after[moved] += rng.integers(-2, 3, (int(moved.sum()), 3))
        V.rescan(x, after, moved, code, best)
        whole = V.scan(x, after)
        assert (code == whole[0]).all() and (best == whole[1]).all()


def test_codes_of_few_and_no_vectors(spark):
    few = [(2, [0.5] * 8), (1, [0.25] * 8), (7, [0.3] * 8)]
    got = V.encode(spark.createDataFrame(few, "vec_id bigint, embedding array<float>"))
    assert {r.vec_id: r.code for r in got.rows.collect()} == {1: "00" * 8, 2: "01" * 8, 7: "02" * 8}
    empty = V.encode(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    assert empty.rows.columns == ["vec_id", "code", "error"] and empty.rows.count() == 0


def test_errors_of_equal_labels_are_summed(spark, tmp_path):
    rows = [(i, v, None if i % 3 == 0 else i % 3) for i, v in _vectors("plain")]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = V.op13_vector_codes(spark, str(tmp_path)).collect()
    label, sums = {i: x for i, _, x in rows}, Counter()
    for r in got:
        sums[label[r.vec_id]] += r.error
    assert len(got) == len(rows) and all(r.label_error == sums[label[r.vec_id]] for r in got)


# -- quality --------------------------------------------------------------------------------
SMALL = Q.QualityRules(buckets=1024, size=16, sample=400, epochs=20)


def test_context_sums_equal_a_plain_count(spark):
    texts = ["a b c a", "b", "", None, "x " * 40, "a b c a", "Ab, 12 c!"]
    rules = Q.QualityRules(buckets=256, size=8)
    places, signs = Q.index_vectors(rules)
    want = np.zeros((256, 8))
    known = Q._Buckets(256)
    for t in texts:
        tokens = Q.token_buckets(None if t is None else t.encode(), known)
        for i, w in enumerate(tokens):
            for j in range(max(0, i - 2), min(len(tokens), i + 3)):
                if j != i:
                    np.add.at(want[w], places[tokens[j]], signs[tokens[j]])
    unit = want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1)
    used = want.any(1)
    unit[used] -= unit[used].mean(0)
    unit[used] /= np.maximum(np.linalg.norm(unit[used], axis=1, keepdims=True), 1e-9)
    got = [Q.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(n), rules=rules) for n in (1, 3)]
    assert np.allclose(got[0], unit, atol=1e-6) and (got[0] == got[1]).all()


def test_long_texts_are_cut_nowhere(monkeypatch):
    text = b"one two, three " * 50
    whole = Q.token_buckets(text, Q._Buckets(512))
    rules, total = Q.QualityRules(buckets=512, size=8), [np.zeros(512 * 8, np.int64) for _ in range(2)]
    Q._add_contexts(total[0], whole, Q.index_vectors(rules), rules)
    monkeypatch.setattr(Q, "LONG_TEXT", 10)
    monkeypatch.setattr(Q, "TOKENS_AT_ONCE", 7)
    assert (Q.token_buckets(text, Q._Buckets(512)) == whole).all()
    Q._add_contexts(total[1], whole, Q.index_vectors(rules), rules)
    assert (total[0] == total[1]).all()


@pytest.mark.parametrize("limit", [1, 10, 1 << 20])
def test_tokens_of_a_column_are_those_of_its_texts(monkeypatch, limit):
    rnd = random.Random(9)
    parts = [b"a", b"Zz", b"\xc3\xa9", b"\xe4\xb8\xad", b"12", b"0", b"\x00", b"\x00\x00", b"\x1c", b"\x0b", b" ", b"\n\t", b"$-", b"\xc2\x85", b"\xc2\xa0", b"word" * 8]
    texts = [b"".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(300)] + [None, b"", b" ", b"a", b"a", None]
    want = [Q.token_buckets(t, Q._Buckets(512)).tolist() for t in texts]
    monkeypatch.setattr(Q, "LONG_TEXT", limit)
    for kind in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()):
        column = pa.array(texts, pa.binary()).cast(kind)
        for first, last in ((0, 306), (7, 200), (300, 306), (300, 303), (5, 5)):
            found = list(Q.column_buckets(column.slice(first, last - first), Q._Buckets(512)))
            assert [f.tolist() for f in found] == want[first:last] and all(f.dtype == np.int32 for f in found)


def test_neighbours_of_other_texts_are_not_counted():
    rules = Q.QualityRules(buckets=256, size=8, window=3)
    texts = ["a b", "c", "", "d e f g", "a"]
    sums = []
    for batches in ([texts], [[t] for t in texts]):
        total = np.zeros((256, 8), np.int64)
        for batch in batches:
            for rows in Q._context_sums(rules)(iter([pa.record_batch([pa.array(batch)], names=["text"])])):
                total += np.concatenate([np.frombuffer(r, np.int64) for r in rows.column("sums").to_pylist()]).reshape(256, 8)
        sums.append(total)
    assert sums[0].any() and (sums[0] == sums[1]).all()


def test_repeated_words_are_looked_up_once_and_the_sums_gone_through_once(monkeypatch):
    looked, cells, plain = [], [], np.bincount

    class Counting(Q._Buckets):
        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

    def counted(*args):
        cells.append(len(out := plain(*args)))
        return out

    monkeypatch.setattr(Q, "_Buckets", Counting)
    monkeypatch.setattr(np, "bincount", counted)
    rules = Q.QualityRules(buckets=256, size=8)
    batch = pa.record_batch([pa.array(["one two three " * 50] * 20)], names=["text"])
    assert sum(1 for _ in Q._context_sums(rules)(iter([batch]))) == 1
    assert len(looked) <= 3 and sum(cells) <= 2 * rules.buckets * rules.size


def test_quality_of_unseen_texts_and_odd_rows(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(80)]

    def text(good):
        found = [rnd.choice(words) for _ in range(rnd.randrange(5, 60))]
        return " ".join(found if good else [w + rnd.choice(["$$$", "&&&"]) for w in found])

    marks = [rnd.random() < 0.7 for _ in range(600)]
    docs = [(i, text(m), "clash", 0.0) for i, m in enumerate(marks)] + [(600, None, "", 0.0), (601, "", "", 0.0), (602, " \n", "", 0.0), (None, "abc", "", 0.0), (0, "abc", "", 0.0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, __score string, score double")
    labels = [(i, int(m)) for i, m in enumerate(marks) if i % 2] + [(None, 1), (700, 1), (5, None), (1, int(marks[1]))]
    model = Q.train(df, spark.createDataFrame(labels, "doc_id bigint, quality int"), rules=SMALL)
    rows = Q.score(df, model).collect()
    assert len(rows) == len(docs) and rows[0].__fields__ == ["doc_id", "text", "__score", "score"]
    unseen = [(r.score >= 0.5) == marks[r.doc_id] for r in rows if r.doc_id is not None and 0 < r.doc_id < 600 and r.doc_id % 2 == 0]
    assert np.mean(unseen) > 0.95
    assert len({r.score for r in rows if r.doc_id in (600, 601, 602)}) == 1
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert [r.score for r in Q.score(docs, Q.train(docs, none, rules=SMALL)).collect()] == [0.5]
    assert Q.score(docs.limit(0), Q.train(docs.limit(0), none, rules=SMALL)).count() == 0


def test_temperature_lowers_the_loss_and_keeps_the_order():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((800, 5))
    y = (x[:, 0] + rng.standard_normal(800) > 0).astype(float)
    net = Q.fit(x[:400], y[:400], Q.QualityRules(epochs=60))

    def loss():
        p = np.clip(net.scores(x[400:]), 1e-12, 1 - 1e-12)
        return -(y[400:] * np.log(p) + (1 - y[400:]) * np.log(1 - p)).mean()

    before, order = loss(), net.scores(x[400:]).argsort()
    Q.calibrate(net, x[400:], y[400:])
    assert loss() <= before and (net.scores(x[400:]).argsort() == order).all()


def test_held_out_accuracy_of_the_query(spark):
    base = "/root/testdata/sf0.01"
    rows = Q.op11_quality(spark, base).join(spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "quality"), "doc_id")
    right = rows.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right >= 0.93
