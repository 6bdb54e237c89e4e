"""URL filter: rules first, then a blocklist kept as a sorted digest array.

The blocklist (domains, or domain and path) is held as 64-bit xxhash keys in
ascending order beside the full strings. Tasks memory-map the arrays, probe all
candidate keys of a batch with one vectorised binary search and compare the
stored string of every hit, so a collision of digests cannot block a URL.

Up to `MAPPED_ENTRIES` entries the arrays are one set of files in the shared
folder that Spark ships to each executor once; URLs are then judged where they
are read, without a shuffle. A longer list stays distributed: list and distinct
probe strings meet by digest shard, each shard is an array of the same form.
"""

from __future__ import annotations

import itertools
import math
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from demandspark.llm.common import lowered, table, with_field
from demandspark.session import new_stage_path

#: Entries up to which the list is shipped to every executor, at about 40 bytes each.
MAPPED_ENTRIES = 5_000_000
SHARD_ENTRIES = 1_000_000

# The rules of the contract, (host, path prefix, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
# The default blocklist is a table made from a rule: two words of advertising, gambling, pills, spam or adult pages
# with a hyphen, bare or numbered 1 to 9, under each zone.
FIRST_WORDS = "ads adult banner bets bonus casino cheap click crypto dating diet discount fake fast free gamble loan lotto lucky poker popup slots spam xxx".split()
SECOND_WORDS = "bets bonus cam cash chat club coins deals farm feed girls jackpot mall offers pharma pills pop shop spins sites track traffic win x".split()
ZONES = ["example.com", "example.net", "example.org"]
NUMBERED = 10


def default_list(spark: SparkSession) -> DataFrame:
    """(entry): every pair of words, bare and numbered, in every zone."""
    sizes = [len(FIRST_WORDS), len(SECOND_WORDS), NUMBERED, len(ZONES)]
    rest, picked = F.col("id"), []
    for n in sizes:
        picked.append((rest % n + 1).cast("int"))
        rest = F.floor(rest / n)
    first, second, number, zone = picked
    word = [F.element_at(F.array(*map(F.lit, words)), at) for words, at in ((FIRST_WORDS, first), (SECOND_WORDS, second), (ZONES, zone))]
    digit = F.when(number > 1, (number - 1).cast("string")).otherwise("")
    return spark.range(math.prod(sizes)).select(F.concat(word[0], F.lit("-"), word[1], digit, F.lit("."), word[2]).alias("entry"))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(lowered(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null if none does.

    Of two rules of one length the first by name wins.
    """
    rule = verdict = F.lit(None).cast("string")
    ranked = sorted(RULES if rules is None else rules, key=lambda r: (len(r[0]) + len(r[1]), [-ord(c) for c in r[0] + r[1]]))
    for name, prefix, what in ranked:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


# -- the digest array -----------------------------------------------------------------
def digest(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


class DigestArray:
    """Sorted keys, and the stored strings in the same order."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray, strings) -> None:
        self.keys, self.ends, self.strings = keys, ends, strings

    @classmethod
    def build(cls, entries: list[bytes]) -> DigestArray:
        ranked = sorted((digest(e), e) for e in set(entries))
        keys = np.array([k for k, _ in ranked], np.uint64)
        ends = np.cumsum(np.array([len(e) for _, e in ranked], np.int64), dtype=np.int64)
        return cls(keys, ends, b"".join(e for _, e in ranked))

    @classmethod
    def mapped(cls, stem: str) -> DigestArray:
        def read(part, kind):
            path = f"{stem}.{part}"
            return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)

        return cls(read("keys", np.uint64), read("ends", np.int64), read("strings", np.uint8))

    def stored(self, at: int) -> bytes:
        return bytes(self.strings[int(self.ends[at - 1]) if at else 0 : int(self.ends[at])])

    def holds(self, probes: list[bytes]) -> np.ndarray:
        """Whether each probe is in the list: binary search, then the stored string."""
        want = np.fromiter(map(digest, probes), np.uint64, len(probes))
        first = np.searchsorted(self.keys, want, "left")
        hit = np.zeros(len(probes), bool)
        inside = first < len(self.keys)
        same = np.zeros(len(probes), bool)
        same[inside] = self.keys[first[inside]] == want[inside]
        for i in np.flatnonzero(same):
            at = int(first[i])
            while at < len(self.keys) and self.keys[at] == want[i]:  # strings that share a digest
                if self.stored(at) == probes[i]:
                    hit[i] = True
                    break
                at += 1
        return hit


def probes_of(host: bytes, path: bytes, labels: int) -> list[bytes]:
    """The host, its parent domains of at most `labels` labels, and host with path."""
    if not host:
        return []
    parts = host.split(b".")
    out = [b".".join(parts[i:]) for i in range(max(0, len(parts) - labels), len(parts))]
    if path:
        out.append(host + path)
    return out


def _ship(spark: SparkSession, entries: list[bytes]) -> str:
    """Writes the arrays to the shared folder and has Spark give them to all executors."""
    array = DigestArray.build(entries)
    name = f"urls-{uuid.uuid4().hex}"
    folder = new_stage_path(spark, name)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for part, data in (("keys", array.keys.tobytes()), ("ends", array.ends.tobytes()), ("strings", array.strings)):
        target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.{part}")
        out = target.getFileSystem(conf).create(target)
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
        out.close()
        spark.sparkContext.addFile(target.toString())
    return name


def _judge(name: str, labels: int, columns: list[str], out_col: str):
    opened: list[DigestArray] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not opened:
            opened.append(DigestArray.mapped(SparkFiles.get(name)))
        for batch in batches:
            hosts, paths = batch.column("__host").to_pylist(), batch.column("__path").to_pylist()
            probes, owner = [], []
            for i, (h, p) in enumerate(zip(hosts, paths)):
                found = probes_of(h.encode(), p.encode(), labels)
                probes += found
                owner += [i] * len(found)
            blocked = np.zeros(len(hosts), bool)
            if probes:
                blocked[np.array(owner)[opened[0].holds(probes)]] = True
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(blocked)], names=[*columns, out_col]
            )

    return run


def _sharded(urls: DataFrame, entries: DataFrame, labels: int, shards: int, out_col: str) -> DataFrame:
    """The same for a list of any length: probe strings and list meet by digest shard."""
    parts = F.split(F.col("__host"), r"\.", -1)
    n = F.size(parts)
    # Parent domains by their number of labels, at most `labels` of them.
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), ".")
    )
    full = F.when(F.col("__path") != "", F.array(F.concat("__host", "__path"))).otherwise(F.array().cast("array<string>"))
    probes = F.when(F.col("__host") == "", F.array().cast("array<string>")).otherwise(F.concat(suffixes, full))
    shard = F.pmod(F.xxhash64("probe"), F.lit(shards)).cast("int")
    places = urls.select("__host", "__path").distinct().withColumn("probe", F.explode(probes))
    asked = places.select("probe").distinct().withColumn("shard", shard)
    listed = entries.select(F.col("entry").alias("probe")).withColumn("shard", shard)

    def probe(asked: pa.Table, listed: pa.Table) -> pa.Table:
        want = [x.encode() for x in asked.column("probe").to_pylist()]
        array = DigestArray.build([x.encode() for x in listed.column("probe").to_pylist()])
        with tempfile.TemporaryDirectory() as folder:  # this task's own, gone with it
            for part, data in (("keys", array.keys), ("ends", array.ends), ("strings", np.frombuffer(array.strings, np.uint8))):
                data.tofile(f"{folder}/list.{part}")
            hits = DigestArray.mapped(f"{folder}/list").holds(want)
        return pa.table({"probe": pa.array([w.decode() for w, h in zip(want, hits) if h], pa.string())})

    hits = asked.groupBy("shard").cogroup(listed.groupBy("shard")).applyInArrow(probe, "probe string")
    bad = places.join(hits, "probe").select(F.col("__host").alias("__h"), F.col("__path").alias("__p")).distinct()
    same = (urls["__host"] == bad["__h"]) & (urls["__path"] == bad["__p"])
    return urls.join(bad, same, "left").withColumn(out_col, F.col("__h").isNotNull()).drop("__h", "__p")


def filter_urls(
    pages: DataFrame,
    url_col: str = "url",
    blocked: DataFrame | list[str] | None = None,
    rules: list[tuple[str, str, str]] | None = None,
    mapped_entries: int = MAPPED_ENTRIES,
) -> DataFrame:
    """`pages` with host, path, rule and verdict (these replace columns of the names).

    `blocked` is the blocklist: a list, or a DataFrame whose first column has
    the entries (`default_list` if none is given). Null entries are left out,
    repeated ones count once. A null URL, or one without `://`, has an empty
    host and path, no rule, and passes. Every row is judged alone, whole and
    however long, so repeated rows get equal verdicts; an empty table gives
    none.
    """
    spark = pages.sparkSession
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    url = F.col(f"`{url_col}`")
    urls = pages.select(*[F.col(f"`{c}`") for c in keep], host_of(url).alias("__host"), path_of(url).alias("__path"))
    if blocked is None:
        blocked = default_list(spark)
    if isinstance(blocked, list):
        entries, n, labels = None, len(blocked), max([b.count(".") + 1 for b in blocked if b], default=1)
    else:
        entries = blocked.select(F.col(f"`{blocked.columns[0]}`").alias("entry")).where("entry is not null").distinct()
        dots = F.size(F.split("entry", r"\.", -1))
        n, labels = entries.agg(F.count(F.lit(1)), F.coalesce(F.max(dots), F.lit(1))).first()
    if n <= mapped_entries:
        found = blocked if entries is None else (r[0] for r in entries.toLocalIterator())
        name = _ship(spark, [x.encode() for x in itertools.islice(found, mapped_entries + 1) if x is not None])
        judged = urls.mapInArrow(_judge(name, labels, urls.columns, "__blocked"), with_field(urls.schema, "__blocked", "boolean"))
    else:
        if entries is None:
            entries = spark.createDataFrame([(x,) for x in set(blocked)], "entry string")
        judged = _sharded(urls, entries, labels, max(1, -(-n // SHARD_ENTRIES)), "__blocked")
    rule, verdict = best_rule(F.col("__host"), F.col("__path"), rules)
    method = F.when(F.col("__blocked"), "block").otherwise("allow")
    return judged.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        rule.alias("rule"),
        F.coalesce(verdict, method).alias("verdict"),
    )


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "url")


SQL = """
WITH entry AS MATERIALIZED (
  SELECT a || '-' || b || n || '.' || z AS d
  FROM (SELECT unnest([{first}]) AS a), (SELECT unnest([{second}]) AS b),
    (SELECT CASE WHEN k > 0 THEN CAST(k AS VARCHAR) ELSE '' END AS n FROM range({numbered}) r(k)), (SELECT unnest([{zones}]) AS z)),
cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
part AS MATERIALIZED (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
place AS (SELECT DISTINCT host, path, string_split(host, '.') AS w FROM part),
probe AS (
  SELECT host, path, unnest(list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[i:], '.'))) AS d FROM place
  UNION ALL SELECT host, path, host || path FROM place),
listed AS (SELECT DISTINCT host, path FROM probe JOIN entry USING (d)),
judged AS (
  SELECT part.*, CASE
    WHEN (part.host = 'example.net' OR suffix(part.host, '.example.net')) AND prefix(part.path, '/en/') THEN 'example.net/en/'
    WHEN (part.host = 'example.com' OR suffix(part.host, '.example.com')) AND prefix(part.path, '/de/') THEN 'example.com/de/'
    WHEN (part.host = 'org' OR suffix(part.host, '.org')) AND prefix(part.path, '/fr/') THEN 'org/fr/'
    WHEN (part.host = 'net' OR suffix(part.host, '.net')) AND prefix(part.path, '/') THEN 'net/' END AS rule,
    l.host IS NOT NULL AS listed
  FROM part LEFT JOIN listed l ON l.host = part.host AND l.path = part.path)
SELECT page_id, url, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM judged
""".format(numbered=NUMBERED, **{k: ", ".join(f"'{w}'" for w in words) for k, words in (("first", FIRST_WORDS), ("second", SECOND_WORDS), ("zones", ZONES))})
