"""Line dedup by site-relative frequency [native].

A line is boilerplate on a site when the share of the site's pages that hold it
exceeds a ratio. Everything here is DataFrame functions: one shuffle of
(host, line digest) partial counts, one of page totals, no Python on executors.

Lines are told apart by their 128-bit MD5 digest, so the shuffle carries 16
bytes a line and not the text. A site has at most (its mean number of lines a
page / ratio) boilerplate lines, which bounds the digest list of a host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from demandspark.llm.common import table
from demandspark.session import stage


@dataclass(frozen=True)
class LineRules:
    max_ratio: float = 0.1
    """A line on a larger share of the site's pages goes."""
    min_pages: int = 2
    """A page's own lines stay: a line on one page is no boilerplate, whatever the ratio."""
    broadcast_rows: int = 100_000
    """Boilerplate lines up to which their table (about 60 bytes a row) is broadcast."""
    salts: int = 32
    """Beyond that: copies of each host's list, so that a large site is spread."""


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, text_col: str, host_col: str, rules: LineRules = LineRules()) -> DataFrame:
    """(host, digest, pages, site_pages) of every line over the ratio.

    A page counts once for a line that it repeats. Blank lines are never
    boilerplate. A null host is a site of its own; null texts count as pages
    without lines, and repeated rows as pages each.
    """
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("site_pages"))
    held = pages.select(
        "host",
        F.explode(F.array_distinct(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""))).alias("line"),
    )
    counts = (
        held.select("host", _digest(F.col("line")).alias("digest"))
        .groupBy("host", "digest")
        .agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= rules.min_pages)
    )
    same = counts["host"].eqNullSafe(totals["host"])
    return (
        counts.join(totals, same)
        .select(counts["host"], "digest", "pages", "site_pages")
        .where(F.col("pages") > F.lit(rules.max_ratio) * F.col("site_pages"))
    )


def drop_boilerplate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    rules: LineRules = LineRules(),
    n_lines: str | None = None,
    n_removed: str | None = None,
) -> DataFrame:
    """`docs` with the boilerplate lines of each site removed from the text.

    Rows and columns stay as they are, the text loses lines; a text all of
    whose lines go becomes empty, a null text stays null. `n_lines` and
    `n_removed` name columns to add (they replace columns of that name).
    """
    bad = stage(boilerplate(docs, text_col, host_col, rules))
    few = bad.count() <= rules.broadcast_rows
    lists = bad.groupBy(F.col("host").alias("__host")).agg(F.collect_list("digest").alias("__bad"))
    left = docs
    if few:
        same = left[host_col].eqNullSafe(lists["__host"])
        both = left.join(F.broadcast(lists), same, "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(rules.salts - 1)))
        lists = lists.select("*", salts.alias("__part"))
        left = left.withColumn("__salt", F.pmod(F.xxhash64(id_col, text_col), F.lit(rules.salts)).cast("int"))
        same = left[host_col].eqNullSafe(lists["__host"]) & (left["__salt"] == lists["__part"])
        both = left.join(lists, same, "left")
    lines = _lines(F.col(text_col))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__bad"), _digest(x)))
    text = F.when(F.col("__bad").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    whole = F.coalesce(F.size(lines), F.lit(0))
    out = both.withColumn("__text", text)
    if n_lines:
        out = out.withColumn("__n", F.when(F.col(text_col).isNull(), 0).otherwise(whole).cast("long"))
    if n_removed:
        gone = F.when(F.col(text_col).isNull() | F.col("__bad").isNull(), 0).otherwise(whole - F.size(kept))
        out = out.withColumn("__gone", gone.cast("long"))
    added = {k: F.col(v) for k, v in ((n_lines, "__n"), (n_removed, "__gone")) if k}
    names = [c for c in docs.columns if c not in added]
    return out.select(
        *[F.col("__text").alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        *[c.alias(k) for k, c in added.items()],
    )


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = drop_boilerplate(docs, n_lines="n_lines", n_removed="n_removed")
    return out.select("doc_id", "source", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH page AS (
  SELECT doc_id, source, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
total AS (SELECT source, count(*) AS site_pages FROM page GROUP BY source),
held AS (
  SELECT source, unnest(list_distinct(list_filter(lines, lambda x: trim(x, ' ') <> ''))) AS line FROM page),
bad AS (
  SELECT h.source, h.line FROM (SELECT source, line, count(*) AS pages FROM held GROUP BY ALL) h
  JOIN total t ON h.source IS NOT DISTINCT FROM t.source
  WHERE pages >= 2 AND pages > 0.1::DOUBLE * site_pages),
lists AS (SELECT source, list(line) AS bad FROM bad GROUP BY source)
SELECT p.doc_id, p.source, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(list_filter(lines, lambda x: list_contains(coalesce(l.bad, []), x))) AS BIGINT) AS n_removed,
  sha256(CASE WHEN text IS NULL THEN '' ELSE
    array_to_string(list_filter(lines, lambda x: NOT list_contains(coalesce(l.bad, []), x)), chr(10)) END) AS kept_sha256
FROM page p LEFT JOIN lists l ON p.source IS NOT DISTINCT FROM l.source
"""
