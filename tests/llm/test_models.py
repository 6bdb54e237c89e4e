"""Embeddings, URLs, languages, personal data, tokens and suffixes against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from demandspark import session
from demandspark.llm import bpe, embedding_dedup as E, language_id as G, pii, suffix_dedup as X, url_filter as U


# -- embeddings -----------------------------------------------------------------------------
def brute_links(rows, least):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v is not None and not any(x is None or not np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, np.float32).astype(np.float64)
    links, up = Counter(), {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a in good:
        for b in good:
            x, y = good[a], good[b]
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[a] += 1
                p, q = sorted((root(rows[a][0]), root(rows[b][0])))
                up[q] = p
    return [(i, links[k], None if i is None else root(i)) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("part,first", [(32_768, 10_000), (5, 3)])
def test_cosine_groups_equal_brute_force(spark, part, first):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(12):
        base = rng.standard_normal(40)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows) + 10, [float(x) for x in base + rng.standard_normal(40) * rng.choice([0.05, 0.2, 0.3])]))
    rows += [(500 + i, [1.0] * 40) for i in range(15)]  # equal vectors
    rows += [(3, [2.0] * 40), (600, None), (601, [0.0] * 40), (602, [None] + [1.0] * 39), (603, [float("nan")] * 40)]
    rows += [(604, [float("inf")] * 40), (605, []), (606, [1.0, 2.0]), (607, [2.0, 4.0]), (None, [1.0] * 40), rows[0]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("node", F.lit("clash"))
    got = E.cosine_groups(df, rules=E.CosineRules(part=part, first_grid=first)).collect()
    want = brute_links(rows, 0.95)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter(want)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def vectors_in_groups(seed, n, dims):
    """Rows of (id, vector): close groups around few directions, near copies, lone vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims)) * 3
    x = centres[rng.integers(0, 6, n)] + rng.standard_normal((n, dims)) * rng.choice([0.2, 0.6, 1.0], n)[:, None]
    x[: n // 4] = rng.standard_normal((n // 4, dims))
    return [(i * 3 + 1, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]


def test_cosine_groups_write_no_table_that_grows_faster_than_the_vectors(spark, tmp_path, monkeypatch):
    rows = vectors_in_groups(1, 400, 64)
    monkeypatch.setattr(session, "stage_folder", lambda spark: str(tmp_path))
    got = E.cosine_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), rules=E.CosineRules(first_grid=3)).collect()
    by_table = Counter()
    for f in tmp_path.rglob("*.parquet"):
        by_table[f.parent] += pq.read_metadata(f).num_rows
    assert by_table and max(by_table.values()) <= 2 * len(rows)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter(brute_links(rows, 0.95))


def test_parts_meet_without_a_shuffle(spark):
    parts = spark.range(9).selectExpr("1 dims", "cast('x' as binary) node", "cast('y' as binary) times", "cast('z' as binary) vector", "id part")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pairs = E._pairs_of_parts(parts)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        met = [tuple(sorted(r)) for r in pairs.select("a_part", "b_part").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert sorted(met) == [(a, b) for a in range(9) for b in range(a, 9)]


@pytest.mark.parametrize("kind,dims,part", [("float", 64, 30), ("double", 5, 17), ("float", 1, 50), ("double", 100, 1000)])
def test_parts_and_cells_lose_no_link(spark, kind, dims, part):
    rows = vectors_in_groups(dims, 120, dims)
    zero = [-0.0, 1.0, *[0.0] * (dims - 2)][:dims] if dims > 1 else [1.0]
    rows += [(900, zero), (901, [abs(v) for v in zero]), (902, [v * 2 for v in zero]), (903, rows[-1][1]), (903, rows[5][1])]
    limit = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(3)
    got = E.cosine_groups(df, rules=E.CosineRules(part=part, first_grid=4)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter(brute_links(rows, 0.95))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == limit


def test_rows_find_their_vector_where_digests_clash(spark, monkeypatch):
    monkeypatch.setattr(E, "digest", lambda vector: F.lit(7).cast("bigint"))
    rows = [*vectors_in_groups(8, 40, 6), (0, [1.0] * 6), (500, [1.0] * 6)]
    got = E.cosine_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter(brute_links(rows, 0.95))


def part_of(x, cuts, rules):
    x = x[E.in_cells(x.astype(np.float64), cuts)]
    return E.Part(np.arange(len(x)), np.arange(1, len(x) + 1), x, cuts, rules)


@pytest.mark.parametrize("spread", [0.02, 0.03, 0.045, 0.06, 1.0])
def test_links_of_two_parts_equal_all_cosines(spread):
    """Dense and thin tiles, cells that are passed over, links that count more than once."""
    rng, rules, cuts = np.random.default_rng(4), E.CosineRules(), 5
    centres = rng.standard_normal((8, 64))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x, y = (centres[rng.integers(0, 8, 700)] + rng.standard_normal((700, 64)) * spread for _ in range(2))
    a, b = part_of(x, cuts, rules), part_of(y, cuts, rules)
    b.node = b.node + 1000
    if spread < 0.03:
        assert not a.near(b, rules).all()
    for p, q in ((a, b), (a, a)):
        cosine = (p.x / p.norm[:, None]) @ (q.x / q.norm[:, None]).T
        link = cosine >= 0.95
        if p is q:
            np.fill_diagonal(link, False)
            want = dict(enumerate((link @ q.times).tolist()))
        else:
            want = dict(enumerate((link @ q.times).tolist())) | {1000 + k: v for k, v in enumerate((link.T @ p.times).tolist())}
        node, links, root = E.linked(p, q, rules)
        assert dict(zip(node.tolist(), links.tolist())) == {k: v for k, v in want.items() if v}
        # The same groups as all links make.
        groups = E.Groups(2000)
        groups.join(*np.nonzero(link)) if p is q else groups.join(np.nonzero(link)[0], 1000 + np.nonzero(link)[1])
        groups.settle()
        assert root.tolist() == groups.first[node].tolist()


def test_rows_joined_in_a_chain_are_one_group():
    groups, order = E.Groups(5000), np.random.default_rng(2).permutation(4998)
    groups.join(order + 1, order)
    groups.settle()
    assert groups.first.tolist() == [0] * 4999 + [4999]


def test_cosine_groups_of_an_empty_table(spark):
    assert E.cosine_groups(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


# -- URLs -----------------------------------------------------------------------------------
URLS = [
    "http://a.spam.com/x", "http://notspam.com/", "https://SPAM.com", "http://ok.net/en/", "http://example.net/en/1", "http://b.example.net/de",
    "http://x.example.com/de/?q", "http://org/fr/a", "http://a.org/fr", "ftp://page.org/bad#x", "http://page.org/bad/", None, "", "no scheme", "://", "http://?x",
    "http://É.spam.com/\n", "http://" + "a." * 5000 + "spam.com/", "http://net", "http://a..spam.com", "http://spam.com:80/",
]
BLOCKED = ["spam.com", "page.org/bad", None, "spam.com"]


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    rule = verdict = None
    for h, p, v in sorted(U.RULES, key=lambda r: len(r[0] + r[1])):
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            rule, verdict = h + p, v
    bad = any(b and (host == b or host.endswith("." + b) or (host and path and host + path == b)) for b in BLOCKED)
    return host, path, rule, verdict or ("block" if bad else "allow")


@pytest.mark.parametrize("most", [100, 0])
def test_urls_equal_a_plain_version(spark, most):
    rows = [(i, u) for i, u in enumerate(URLS + URLS[:2])]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    listed = spark.createDataFrame([(b,) for b in BLOCKED], "entry string")
    for blocked in ([b for b in BLOCKED if b], listed):
        got = U.filter_urls(df, blocked=blocked, mapped_entries=most).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain_url(u) for i, u in rows}


def test_urls_of_an_empty_table_and_the_default_list(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert U.filter_urls(none).count() == 0
    listed = {r.entry for r in U.default_list(spark).collect()}
    assert len(listed) == U.default_list(spark).count() == len(U.FIRST_WORDS) * len(U.SECOND_WORDS) * 30
    urls = ["http://m.casino-win.example.com/a", "http://spam-farm7.example.org", "http://casino-winner.example.com/", "http://example.com/casino-win.example.com", "http://casino-win.example.com"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    assert [r.verdict for r in U.filter_urls(df).orderBy("page_id").collect()] == ["block", "block", "allow", "allow", "block"]


def test_digest_array_confirms_strings(monkeypatch):
    monkeypatch.setattr(U, "digest", lambda text: len(text) % 3)  # all digests collide
    words = [f"host{i}".encode() for i in range(50)]
    array = U.DigestArray.build(words[::2])
    assert array.holds(words).tolist() == [i % 2 == 0 for i in range(50)]
    assert not U.DigestArray.build([]).holds(words).any()


# -- languages ------------------------------------------------------------------------------
def test_vocabulary_is_a_small_tree():
    ranks = bpe._ranks(bpe.default_path())
    known, nodes = sorted(ranks), {p[:n] for p in ranks for n in range(len(p) + 1)}
    v = G.pieces(bpe.default_path())
    arrays = [a for a in vars(v).values() if isinstance(a, np.ndarray)]
    assert sum(a.nbytes for a in arrays) < 40 * len(nodes)
    words = [b" \xc3\xa4pfel", b"nothing", b"\xff\xff\xff\xff\x00 a", *sorted(nodes)[::300]]
    for word in filter(None, words):
        begin, end, piece, _ = v.lattice([word])
        found = {(a, b, known[p]) for a, b, p in zip(begin.tolist(), end.tolist(), piece.tolist())}
        assert found == {(a, b, word[a:b]) for a in range(len(word)) for b in range(a + 1, len(word) + 1) if word[a:b] in ranks}


def test_forward_sums_all_segmentations():
    path = bpe.default_path()
    v = G.pieces(path)
    known = sorted(bpe._ranks(path))
    number = {p: i for i, p in enumerate(known)}
    model = np.random.default_rng(0).random((v.size + 1, 2))
    model[-1] = 0

    def total(w):
        if not w:
            return np.ones(2)
        return sum((model[number[w[:n]]] * total(w[n:]) for n in range(1, len(w) + 1) if w[:n] in number), np.zeros(2))

    words = [b" the", b" thering", "é".encode(), b"\x00\xff", b" a"]
    assert np.allclose(G.word_scores(words, model, v), [np.log(total(w)) for w in words])
    # Expected counts: every byte of a word is in one piece of each segmentation.
    counts = G.expected_counts(words, np.ones((len(words), 1)), v)[0] / G.GRAIN
    assert np.isclose(sum(len(p) * counts[i] for p, i in number.items()), sum(map(len, words)), rtol=1e-3)


def uncut(word, number, model, weight=None):
    """Logs of forward and backward sums of one word, by logarithms and byte by byte, and its pieces."""
    n, languages = len(word), model.shape[1]
    logs, longest = np.log(np.maximum(model, 1e-300)), max(map(len, number))
    edges = [(i, j, number[word[i:j]]) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1) if word[i:j] in number]
    fore, back = np.full((n + 1, languages), -np.inf), np.full((n + 1, languages), -np.inf)
    fore[0], back[n] = 0, 0
    for i, j, p in edges:
        fore[j] = np.logaddexp(fore[j], fore[i] + logs[p])
    for i, j, p in reversed(edges):
        back[i] = np.logaddexp(back[i], back[j] + logs[p])
    return fore, back, edges, logs


def test_long_words_are_summed_uncut(monkeypatch):
    path = bpe.default_path()
    v, known = G.pieces(path), sorted(bpe._ranks(path))
    number = {p: i for i, p in enumerate(known)}
    rng = np.random.default_rng(5)
    model = rng.random((v.size + 1, 3)) ** 8 * [1e-3, 1e-6, 1e-11]
    model[-1] = 0
    text = "the government of 中文文本没有空格 und überall ═══ 😀 " * 200
    run = b" " + text.replace(" ", "").encode()
    words = [run[:10_000], run[:65], run[:64], run[3:300], run[:4096], run[:4097], " ไทยไม่มีช่องว่าง".encode() * 40, b" the", run[:8000]]
    for segment in (4096, 50):
        monkeypatch.setattr(G, "SEGMENT", segment)
        got = G.word_scores(words, model, v)
        for i, w in enumerate(words):
            assert np.allclose(got[i], uncut(w, number, model)[0][len(w)], rtol=1e-9)
    flat = np.full((v.size + 1, 1), 1 / 256)
    for segment in (4096, 50):
        monkeypatch.setattr(G, "SEGMENT", segment)
        got = G.expected_counts(words, np.arange(1.0, len(words) + 1)[:, None], v)[0] / G.GRAIN
        want = np.zeros(v.size)
        for k, w in enumerate(words, 1):
            fore, back, edges, logs = uncut(w, number, flat)
            for i, j, p in edges:
                want[p] += k * np.exp(fore[i, 0] + logs[p, 0] + back[j, 0] - fore[len(w), 0])
        assert np.allclose(got, want, atol=0.5, rtol=1e-3)


def test_many_languages_take_small_batches():
    words = [b" word%d" % i for i in range(3000)] + [b" " + b"x" * 5000]
    assert max(len(p) for _, p in G._by_length(words, 500)) * 65 * 500 <= G.NUMBERS
    v = G.pieces(bpe.default_path())
    assert all(b.n * b.alive * 500 <= G.NUMBERS for _, b in G._long_batches([b" " + b"y" * 70] * 4000, 500, v))


def test_forward_sums_use_the_whole_vocabulary():
    path = bpe.default_path()
    v = G.pieces(path)
    known = sorted(bpe._ranks(path))
    assert v.size == len(known)
    number = {p: i for i, p in enumerate(known)}
    model = np.random.default_rng(1).random((v.size + 1, 2)) / 1000
    model[-1] = 0

    def ways(w):
        return [[number[w[:n]], *rest] for n in range(1, len(w) + 1) if w[:n] in number for rest in ways(w[n:])] if w else [[]]

    longest = max((p for p in known if p == p.lower() and len(set(p)) > 2 and len(p) < 16), key=len)
    words = [b" government", b" information", longest, b" the", b" a"]
    total = [sum(np.prod(model[x], axis=0) for x in ways(w)) for w in words]
    assert np.allclose(G.word_scores(words, model, v), np.log(total))
    counts = G.expected_counts(words, np.ones((len(words), 1)), v)[0] / G.GRAIN
    assert all(counts[number[w]] > 0.9 for w in (b" government", b" information", longest))


def test_runs_that_no_language_has_seen_do_not_underflow(spark):
    path = bpe.default_path()
    v = G.pieces(path)
    model = np.full((v.size + 1, 2), 0.05 / 1e9)
    model[-1] = 0
    known = {p: i for i, p in enumerate(sorted(bpe._ranks(path)))}
    model[known[b" the"], 0] = model[known[b" das"], 1] = 0.3
    run = "\u2550\U0001f642" * 9 + "\u2550"
    word = run.encode()[:64]
    scores = G.word_scores([word, word[:8]], model, v)
    assert np.isfinite(scores).all() and (scores[0] < np.log(1e-300)).all()
    far = [0.0] + [-np.inf] * len(word)
    for e in range(1, len(word) + 1):
        for b in range(e):
            if word[b:e] in known:
                far[e] = np.logaddexp(far[e], far[b] + np.log(0.05 / 1e9))
    assert np.allclose(scores[0], far[-1], rtol=1e-12)
    learned = G.LanguageModel(["de", "en"], model[:, ::-1].copy(), np.log([0.5, 0.5]), path)
    rows = [(1, "das das " + run * 4), (2, "the the " + run * 4), (3, "x " + run * 4)]
    got = {r.doc_id: r for r in G.predict(spark.createDataFrame(rows, "doc_id bigint, text string"), learned).collect()}
    assert [got[i].lang_pred for i in (1, 2)] == ["de", "en"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1].score > 0.99 and abs(got[3].score - 0.5) < 1e-6


def test_languages_learned_and_odd_texts(spark):
    docs = [(i, " ".join(["the house and the garden"] * 3), "en") for i in range(20)]
    docs += [(20 + i, " ".join(["das haus und der garten"] * 3), "de") for i in range(20)]
    docs += [(90, None, "en"), (91, "the", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    model = G.train(df)
    assert model.languages == ["de", "en"]
    odd = [(1, None), (2, ""), (3, "12 !!"), (4, "the garden and"), (5, "und der"), (6, "the " * 50_000), (7, "x" * 5000), (4, "the garden and")]
    got = G.predict(spark.createDataFrame(odd, "doc_id bigint, text string").withColumn("score", F.lit("clash")), model).collect()
    found = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == len(odd) and [found[i][0] for i in (1, 2, 3, 4, 5, 6)] == ["und"] * 3 + ["en", "de", "en"]
    assert found[1][1] == 0 and all(0 <= s <= 1 for _, s in found.values())
    again = G.train(df.repartition(7))
    assert np.array_equal(again.logs, model.logs)
    none = G.train(df.limit(0))
    assert G.predict(df.select("text"), none).where("lang_pred != 'und'").count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = G.predict(docs.where(G.held_out()), G.train(docs.where(~G.held_out())))
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count() > 100


# -- personal data --------------------------------------------------------------------------
CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def strict(text):
    out = []
    for kind, p in CONTRACT.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(x) < 256 for x in m.group().split(".")) if kind == "ip" else False,
                "card": 13 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_strict_spans_equal_the_contract(spark):
    rng = random.Random(2)
    bits = ["a@b.c", "@", ".", "_", "1", "23", "255.", "1.2.3.4", "+1", "(", ")", " ", "-", "é", "🙂", "4111111111111111",
            "4111 1111 1111 1111", "x", "-com", "\n", "555-123-4567", "0"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "a" * 100_000), (5003, "a.a@" + "b." * 20_000 + "c"), (5004, "1 " * 20_000)]
    rows += [(5005, "+1" + "(" * 50_000), (5006, "1." * 20_000), (None, "a@b.c"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("base", F.lit("clash"))
    got = pii.find_personal_data(df).select("text", pii._joined(F.col("base")).alias("b"), "base", "spans").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.b == strict(r.text)
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
        assert all(r.text[s.start : s.stop] == s.text for s in r.spans)


def test_labelers_are_weighed_and_spans_added(spark):
    rows = [(i, f"call +1 (212) 555-{1000 + i} or mail me{i}@mail.net now. order 4111111111111{i % 1000:03d} id") for i in range(300)]
    rows += [(1000 + i, f"my phone: 415-555-{2000 + i}, ok") for i in range(100)] + [(2000 + i, f"serial 415-555-{3000 + i}x9") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.find_personal_data(df)
    added = {r.doc_id: len(r.spans) - len(r.base) for r in found.collect()}
    assert sum(added[1000 + i] for i in range(100)) >= 90
    assert sum(added[2000 + i] for i in range(100)) <= 10
    shown = pii.redact(found.where("doc_id = 1000")).first().text
    assert shown == "my phone: [phone], ok"
    good = pii.estimate([("card", "21121", 50), ("card", "01010", 50), ("phone", "22121", 10)])
    assert good["card", "21121"] > 0.9 > 0.1 > good["card", "01010"]
    assert pii.find_personal_data(df.limit(0)).count() == 0


# -- tokens ---------------------------------------------------------------------------------
@pytest.mark.parametrize("pack", [1 << 20, 300])
def test_tokens_equal_the_library(spark, pack):
    rng = random.Random(3)
    bits = "ab'sS \n\t\r\x0b\x1c\x1f\x85\xa0é²½ªß1２٣世。—🙂  　'lld'LLÿ"
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "word " * 20_000), (303, " " * 5000), (None, "null id"), rows[0], (5, "same id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit("clash")).repartition(4)
    got = bpe.decode(bpe.encode(df, pack_bytes=pack))
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, bytes(r.decoded)) for r in got.collect())
    library = bpe._encoder(bpe.default_path())
    want = Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), (t or "").encode()] += 1
    assert got == want
    trip = bpe.round_trip(df, pack_bytes=pack).collect()
    assert Counter(map(tuple, trip)) == Counter({(i, n, s, hashlib.sha256(t).hexdigest()): k for (i, n, s, t), k in want.items()})
    assert bpe.encode(df.limit(0)).count() == bpe.round_trip(df.limit(0)).count() == 0


def test_shards_of_pre_tokens_follow_the_text_and_not_the_partitions(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(150))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    size = sum(len(t) for _, t in rows)
    seen = []
    cutter = bpe._cutter
    monkeypatch.setattr(bpe, "_cutter", lambda i, t, shards, pack: seen.append(shards) or cutter(i, t, shards, pack))
    monkeypatch.setattr(bpe, "SHARD_BYTES", 2000)
    got = {r.doc_id: r.ids for r in bpe.encode(df, pack_bytes=9000).collect()}
    assert seen == [-(-size // 2000)] and seen[0] > int(spark.conf.get("spark.sql.shuffle.partitions"))
    library = bpe._encoder(bpe.default_path())
    assert got == {i: library.encode_ordinary(t) for i, t in rows}


# -- suffixes -------------------------------------------------------------------------------
def removed_bytes(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 99) if i is not None else ():
            w = b[p : p + 100]
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99) if i is not None else ():
            if first[b[p : p + 100]] < (i, p):
                gone[p : p + 100] = b"\1" * 100
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)] += 1
    return out


@pytest.mark.parametrize("seed,pack", [(1, 1 << 20), (2, 4000), (3, 1)])
def test_suffix_dedup_equals_brute_force(spark, seed, pack):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab") for _ in range(300)) for _ in range(4)] + ["a" * 700, "ab" * 400, "é🙂" * 60]
    rows = []
    for i in rng.sample(range(500), 60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            b = rng.choice(base)
            a = rng.randint(0, 120)
            parts.append(rng.choice([b[a : a + rng.randint(50, 400)], "".join(rng.choice("abc é") for _ in range(rng.randint(0, 120)))]))
        rows.append((i, "".join(parts)))
    rows += [(900, None), (901, ""), (902, "x" * 99), (903, "y" * 3000), (None, base[0]), rows[0], (rows[1][0], base[1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit("clash")).repartition(3)
    got = X.drop_repeated_bytes(df, pack_bytes=pack).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == removed_bytes(rows)
    assert X.drop_repeated_bytes(df.limit(0)).count() == 0


@pytest.mark.parametrize("pack,hot", [(1 << 20, 0), (4000, 2), (4000, 40)])
def test_windows_of_hot_anchors_equal_brute_force(spark, pack, hot):
    rng = random.Random(pack + hot)
    phrase = "licensed under the terms that this one common line of text gives to all who read it, with no warranty "
    rows = []
    for i in range(80):
        about = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90))) for _ in range(3)]
        cut = phrase[: rng.choice([50, 70, 99, 100, 103])]
        rows.append((i, about[0] + cut + about[1] + cut + rng.choice(["", about[0], "same tail " * 9]) + about[2]))
    rows += [(200, phrase * 4), (201, phrase * 4), (None, phrase * 3), (202, "z" * 700), (203, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = X.drop_repeated_bytes(df, pack_bytes=pack, hot_reads=hot).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == removed_bytes(rows)


@pytest.mark.parametrize("pack", [1 << 20, 1])
def test_rows_of_one_id_are_one_document(spark, pack):
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefgh") for _ in range(300))
    rows = [(1, "x" * 40 + text), (1, text), (1, text), (2, text), (3, "y" + text[:150])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = X.drop_repeated_bytes(df, pack_bytes=pack).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == removed_bytes(rows)


def test_no_merge_holds_a_hot_anchor():
    rng = random.Random(5)
    phrase = b"this line, which is shorter than a window is wide, is in every document of the whole corpus!"
    texts = [bytes(rng.randrange(256) for _ in range(120)) + phrase + bytes(rng.randrange(256) for _ in range(120)) for _ in range(300)]
    a = X.Anchored(X.C.Docs(np.arange(300), np.ones(300, bool), texts), 4)
    counted = {s: X._count_anchors(50)([body])[0] for s, body in X._ask_anchors(4)(X.C.Docs(np.arange(300), np.ones(300, bool), texts))}
    repeated, hot = X._replied(a, counted, 4)
    reads, windows = X.Reads(a, repeated, 4), X.HotWindows(a, hot, 4)
    key = a.key[np.isin(a.at, reads.start[reads.first] + reads.offset[reads.first])]
    assert hot.any() and np.unique(key, return_counts=True)[1].max(initial=0) <= 50
    assert np.diff(windows.cuts).max() < 0.3 * len(windows.sent)  # spread over the buckets


def test_merged_transforms_are_in_order():
    rng = random.Random(1)
    for _ in range(30):
        base = "".join(rng.choice("ab") for _ in range(60))
        reads = [base[a : a + n].encode() for a, n in ((rng.randint(0, 20), rng.choice([30, 35, 40])) for _ in range(6))]
        lengths = np.array([len(r) for r in reads])
        starts = np.cumsum(lengths) - lengths
        rank = X.ten_bytes(np.frombuffer(b"".join(reads), np.uint8))
        parts = [X.Strings(rank, starts[k::2], lengths[k::2]) for k in (0, 1)]
        made = [s.transform() for s in parts]

        def suffix(s, x):
            out = []
            while x < s.n:
                out.append(int(s.symbol[x]))
                x = int(s.next[x])
            return [*out, 0]

        sorted_ = [[suffix(s, x) for x in order] for s, (order, _) in zip(parts, made)]
        assert all(x == sorted(x) for x in sorted_)
        for rounds in (1, 2, 4):
            turn = [iter(x) for x in sorted_]
            merged = [next(turn[k])[:rounds] for k in X.merge_transforms([b for _, b in made], rounds)]
            assert merged == sorted(merged)
