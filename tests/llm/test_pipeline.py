"""The pipeline against a plain version, and the queries against their SQL."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from demandspark.llm import bpe, queries
from oracle.compare import compare, connect
from tests.llm.test_words import brute_groups, hits

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_duckdb(spark, con, name):
    note = compare(spark, con, FOLDER, queries.QUERIES[name], queries.ORACLE[name])
    assert note is None or note.startswith("equal")


def plain(docs, items):
    """The stages one after another; every text here is clearly of its language."""
    docs = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    pages, count = Counter(d[3] for d in docs), Counter()
    for _, text, _, source, _ in docs:
        count.update((source, x) for x in set(text.split("\n")) if x.strip(" "))
    bad = {k for k, n in count.items() if n >= 2 and n > 0.1 * pages[k[0]]}
    docs = [(d[0], "\n".join(x for x in d[1].split("\n") if (d[3], x) not in bad)) for d in docs]
    groups = brute_groups(docs, 80)
    docs = [d for d in docs if groups[d[0]] == d[0]]
    clean = []
    for i, text in docs:
        words, hit, _ = hits(text, items)
        if not (hit and 20 * hit >= words):
            clean.append((i, text))
    out = {}
    for i, text in clean:
        ids = bpe._encoder(bpe.default_path()).encode_ordinary(text)
        out[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    return out


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(12)
    words = {"en": "the house and garden of that with this from they were".split(), "de": "das haus und der garten mit dieser von sie waren nicht".split()}
    items = [(i, " ".join(rng.choice(words["en"]) + str(rng.randint(0, 99)) for _ in range(30))) for i in range(5)]
    docs = []

    def add(text, lang, source=None):
        docs.append((len(docs), text, lang, source or f"site{rng.randint(0, 2)}", len(text or "")))

    for k in range(90):
        lang = rng.choice(["en", "de"])
        lines = [" ".join(f"{rng.choice(words[lang])}{'' if rng.random() < 0.5 else rng.choice('xyz')}" for _ in range(rng.randint(8, 20))) for _ in range(3)]
        if rng.random() < 0.7:
            lines.insert(rng.randint(0, 3), "the menu of this house")
        add("\n".join(lines), lang)
        if k % 9 == 0:
            add("\n".join(lines), lang)  # a copy
            add("\n".join([*lines[:-1], lines[-1] + " waren"]), lang)  # a near copy
        if k % 15 == 0:
            add(items[k % 5][1] + " the end", "en")
    for odd in (None, "", "123 456", "!"):
        add(odd, "en")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(
        str(tmp_path / "documents.parquet")
    )
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = plain(docs, items)
    assert got == want and 60 < len(want) < len(docs) - 20


def test_rows_reach_python_in_batches_of_bounded_bytes(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(i, "word " * 20_000, "en", "s", 100_000) for i in range(200)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(1)

    def largest(step):
        spark.conf.unset(limit)
        step(spark, docs.limit(0), FOLDER)
        sizes = docs.select("text").mapInArrow(lambda batches: (b.from_pydict({"n": [b.nbytes]}) for b in batches), "n bigint")
        return sizes.agg({"n": "max"}).first()[0]

    try:
        for name, step in corpus_pipeline.STAGES:
            assert name == "line_dedup" or largest(step) < 5 << 20, name
        spark.conf.set(limit, "8m")
        corpus_pipeline.tokenize(spark, docs, FOLDER)
        assert spark.conf.get(limit) == "8m"
    finally:
        spark.conf.unset(limit)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, FOLDER).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]
    empty = docs.limit(0)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, empty, FOLDER).count() == 0, name
