"""Corpus pipeline: from `documents` to token ids, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and gives
a DataFrame. All but the last give the columns of `documents`, with extra ones
as they come. `run` writes what a stage gives to the shared folder and reads it
again for the next one, so a lost executor never costs more than one stage. The
stages that run Python bound the bytes of a batch of rows in the session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from demandspark.llm import bpe, decontamination, language_id, line_dedup, minhash
from demandspark.llm.common import table
from demandspark.session import bound_batches, stage

#: Documents whose best language has a smaller posterior probability go.
LEAST_SCORE = 0.5
#: Removed ids up to which they are broadcast, at about 30 bytes each.
BROADCAST_IDS = 500_000


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, null ones, and those of no clear language; a null `lang` gets the prediction."""
    bound_batches(spark)
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.predict(docs, model, name_col="__lang", score_col="__score")
    kept = found.where((F.col("__lang") != language_id.UNKNOWN) & (F.col("__score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that their source repeats; `n_chars` follows the text."""
    out = line_dedup.drop_boilerplate(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-copies; rows that share an id stay or go together."""
    bound_batches(spark)
    groups = minhash.near_groups(docs.select("doc_id", "text"))
    gone = stage(groups.where("not kept").select(F.col("doc_id").alias("__gone")).distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, docs["doc_id"] == side["__gone"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents a twentieth or more of whose words are in benchmark passages go."""
    bound_batches(spark)
    found = decontamination.find_benchmark(docs, table(spark, sf_dir, "benchmark"), out_col="__hits")
    return found.where(~decontamination.contaminated("__hits")).drop("__hits")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that stayed."""
    bound_batches(spark)
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("line_dedup", drop_site_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: SQL can express neither the language model nor the tokenizer; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
