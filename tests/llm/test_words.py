"""Operators on words: substring dedup, decontamination, line dedup, near-dedup."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandspark.llm import components, decontamination as D, line_dedup as L, minhash as M, substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "lang " * 3000


def corpus(seed: int, n: int = 120) -> list[tuple]:
    """Ids out of order, shared passages, copies, null and empty texts, repeated rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "o o", "🙂"]
    passages = [[rng.choice(words) for _ in range(40)] for _ in range(6)]
    out = []
    for i in rng.sample(range(1000), n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, 20)
                parts += p[a : a + rng.randint(5, 40)]
            else:
                parts += [rng.choice(words) for _ in range(rng.randint(0, 25))]
        out.append((i, rng.choice([" ", "\t", "\n", "  "]).join(parts)))
    out += [(2000, None), (2001, ""), (2002, " \t "), (2003, LONG), (2004, LONG), (None, " ".join(passages[0]))]
    return out


def frame(spark, rows, parts: int = 3):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.repartition(parts).withColumn("key", F.lit("clash")).withColumn("n_words", F.lit(-1))


def removed_words(rows, width: int = 13):
    first: dict[tuple, int] = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for a in range(len(w) - width + 1):
                k = tuple(w[a : a + width])
                first[k] = min(i, first.get(k, i))
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for a in range(len(w) - width + 1):
                if first[tuple(w[a : a + width])] < i:
                    gone |= set(range(a, a + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("seed,pack", [(1, 1 << 20), (2, 2000), (3, 1)])
def test_substring_dedup_equals_brute_force(spark, seed, pack):
    rows = corpus(seed)
    rows += rows[:3]  # repeated rows
    got = S.drop_repeated_windows(frame(spark, rows), pack_bytes=pack).collect()
    assert Counter(map(tuple, got)) == Counter(removed_words(rows))


def test_substring_dedup_splits_a_shared_first_hash(spark, monkeypatch):
    """With a first hash of few values all windows collide; the second hash still tells them apart."""
    real = S.window_hashes
    rows = corpus(5)
    docs = S.C.Docs(np.array([r[0] for r in rows if r[0] is not None]), np.ones(len(rows) - 1, bool), [(r[1] or "").encode() for r in rows if r[0] is not None])
    monkeypatch.setattr(S, "window_hashes", lambda h, w, *second: real(h, w, *second) if second else real(h, w) % np.uint64(3))
    w = S.Windows(docs, 1, 13)
    r = S.Repeats(w, {0: S.C.bits(np.ones(len(w.distinct), bool))})
    distinct = {tuple(WORD.findall(t or "")[a : a + 13]) for i, t in rows if i is not None for a in range(len(WORD.findall(t or "")) - 12)}
    assert len(r.h1) == len(distinct) and len(w.distinct) <= 3


def test_substring_dedup_of_an_empty_table(spark):
    assert S.drop_repeated_windows(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


# -- decontamination ------------------------------------------------------------------------
NAMES = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(text, items, width=13):
    words = NAMES.findall((text or "").translate(AZ))
    hit, found = set(), set()
    for item, body in items:
        w = NAMES.findall((body or "").translate(AZ))
        windows = [w[a : a + width] for a in range(len(w) - width + 1)] if len(w) >= width else [w] if w else []
        for p in windows:
            for a in range(len(words) - len(p) + 1):
                if words[a : a + len(p)] == p:
                    hit |= set(range(a, a + len(p)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [10**6, 25])
def test_decontamination_equals_brute_force(spark, block):
    rng = random.Random(4)
    words = ["a", "b", "Cc", "é", "9", "zZ"]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 5, 13, 14, 40, 0, 20, 20])]
    items += [(77, items[5][1]), (78, None), (5, items[5][1])]
    docs = []
    for i in range(80):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            p = items[rng.choice([3, 4, 5, 7])][1].split()
            a = rng.randint(0, 6)
            parts[10:10] = p[a:]
        docs.append((i, rng.choice([" ", "-", "\n", "\x00"]).join(parts)))
    docs += [(90, None), (91, ""), (92, "--"), (93, "a " * 4000), docs[0]]
    found = D.find_benchmark(
        frame(spark, docs).withColumn("hits", F.lit("clash")), spark.createDataFrame(items, "item_id bigint, text string"), block_patterns=block
    )
    got = found.select("doc_id", "hits.n_words", D.n_hit("hits").alias("n"), "hits.items", D.contaminated("hits").alias("c")).collect()
    assert len(got) == len(docs)
    texts = dict(docs)
    for i, n_words, n, names, bad in got:
        want = hits(texts[i], items)
        assert (n_words, n, sorted(names)) == want
        assert bad == (want[1] > 0 and 20 * want[1] >= want[0])


def test_decontamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    out = D.find_benchmark(frame(spark, [(1, "a b")]), none).select("hits.n_words", "hits.spans").collect()
    assert [tuple(r) for r in out] == [(2, [])]
    assert D.find_benchmark(frame(spark, [(1, "a")]).limit(0), none).count() == 0


# -- line dedup -----------------------------------------------------------------------------
@pytest.mark.parametrize("rows_broadcast", [100_000, 0])
def test_line_dedup_equals_brute_force(spark, rows_broadcast):
    rng = random.Random(8)
    menu = {h: [f"menu {h} {i}" for i in range(3)] for h in ("a", "b", None)}
    docs = []
    for i in range(150):
        host = rng.choice(["a", "a", "a", "b", None, f"small{i}"])
        lines = [f"own {i} {k}" for k in range(rng.randint(0, 3))] + [""]
        lines += [x for x in menu.get(host, []) if rng.random() < 0.5]
        if rng.random() < 0.1:
            lines += lines
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines), host))
    docs += [(200, None, "a"), (201, "", "b"), (202, "menu a 0", "a"), (203, "x\n" * 20_000, "a")]
    rules = L.LineRules(max_ratio=0.3, min_pages=4, broadcast_rows=rows_broadcast, salts=3)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("line", F.lit("clash"))
    out = L.drop_boilerplate(df, rules=rules, n_lines="n_lines", n_removed="n_removed")
    assert out.columns == ["doc_id", "text", "source", "line", "n_lines", "n_removed"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()}
    pages, count = Counter(h for _, _, h in docs), Counter()
    for _, t, h in docs:
        count.update((h, x) for x in set((t or "").split("\n")) if t is not None and x.strip(" "))
    for i, t, h in docs:
        if t is None:
            assert got[i] == (None, 0, 0)
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not (count[h, x] >= 4 and count[h, x] > 0.3 * pages[h])]
        assert got[i] == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert any(v[2] for v in got.values())


def test_small_sites_are_judged_by_the_ratio(spark):
    docs = [(1, "menu\nown\nown", "a"), (2, "menu\nother", "a"), (3, "alone", "b"), (4, "x\ny", "c"), (4, "x\ny", "c")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    assert sorted((r.doc_id, r.text) for r in L.drop_boilerplate(df).collect()) == [(1, "own\nown"), (2, "other"), (3, "alone"), (4, ""), (4, "")]


def test_line_dedup_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert L.drop_boilerplate(none).count() == 0


# -- near-dedup -----------------------------------------------------------------------------
def brute_groups(rows, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(AZ))
        sets.setdefault(i, []).append({tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set())
    up = {i: i for i in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(up)
    for k, i in enumerate(ids):
        for j in ids[k:]:
            for a in sets[i]:
                for b in sets[j]:
                    if a and b and 100 * len(a & b) >= percent * len(a | b):
                        x, y = sorted((root(i), root(j)))
                        up[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("block", [1024, 7])
def test_near_groups_equal_brute_force(spark, block):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 60, 100]))]
        for _ in range(rng.choice([1, 2, 30])):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((rng.choice([5000, 0]) + len(rows), rng.choice([" ", "\n"]).join(t).upper()))
    rows += [(900, None), (901, ""), (902, LONG), (903, LONG), (None, rows[0][1]), rows[1], (rows[2][0], "another text of the same id here")]
    rules = M.NearRules(percent=80, block=block, broadcast_members=0 if block == 7 else 1000)
    got = M.near_groups(frame(spark, rows), rules=rules).collect()
    assert len(got) == len(rows)
    want = brute_groups(rows, 80)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == want[r.doc_id])
    assert sum(not r.kept for r in got) > 20
    assert {r.doc_id: r.n_shingles for r in got}[901] == 0


def test_links_at_the_threshold_are_found_and_none_below(spark):
    rows = []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(104)]  # 100 shingles; a text without its last words is a subset
        rows += [(3 * g, " ".join(words)), (3 * g + 1, " ".join(words[:89])), (3 * g + 2, " ".join(words[20:]))]
    got = {r.doc_id: r.component_id for r in M.near_groups(frame(spark, rows), rules=M.NearRules(percent=85)).collect()}
    assert got == {i: i - 1 if i % 3 == 1 else i for i, _ in rows}


def test_the_agreement_test_loses_less_than_the_bands():
    for percent in (50, 80, 85, 95):
        rules = M.NearRules(percent=percent)
        s, n = percent / 100, rules.bands * rules.rows
        assert sum(math.comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(rules.agreement)) <= rules.band_miss / 1000


def test_near_groups_of_an_empty_table(spark):
    assert M.near_groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (3, None)]
    edges += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    got = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect())
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near[a].add(b), near[b].add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y), todo.append(y)
        assert got[start] == min(seen)
    assert set(got) == set(near)
