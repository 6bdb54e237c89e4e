"""Written tables in slices, replaced and merged atomically.

A write puts its rows into a folder of its own (a generation), partitioned by
the slice columns. Which generation holds each slice stands in a manifest, a
small file with a number; writing the next manifest is the one step that makes a
change visible. A write that fails or loses executors before that step leaves
the table as it was, a reader sees one whole version, and a frame that reads the
table may be written into it. Old generations stay until `vacuum`.

The driver holds one line for each slice, never rows. Two writers that start
from the same version cannot both commit: a manifest is created, never
overwritten, so the second one fails and its rows are never seen.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from demandspark.operators.facts import one_per_key
from demandspark.session import stage

MANIFESTS = "_manifests"
#: What Spark writes for a null in a folder name.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: Tasks that write one slice at most, so that a hot slice is spread.
TASKS_PER_SLICE = 32


class ConflictingWrite(RuntimeError):
    """Another writer committed a version first."""


class SlicedTable:
    """A table in the folder `path`, in slices by the columns `slice_by`."""

    def __init__(self, spark: SparkSession, path: str, slice_by: list[str]) -> None:
        self.spark, self.path, self.slice_by = spark, path, list(slice_by)

    # -- files ----------------------------------------------------------------------------
    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    @property
    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        folder = self._at(*parts)
        if not self._files.exists(folder):
            return []
        return [f.getPath().getName() for f in self._files.listStatus(folder)]

    def _text(self, *parts: str) -> str:
        stream = self._files.open(self._at(*parts))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _slices_in(self, generation: str) -> list[str]:
        """Folders of the slices of a generation, as Spark named them."""
        found = [""]
        for column in self.slice_by:
            deeper = [(f, name) for f in found for name in self._names(generation, *filter(None, [f]))]
            found = [f"{f}/{name}" if f else name for f, name in deeper if name.startswith(f"{column}=")]
        return found

    @staticmethod
    def _values(folder: str) -> tuple[str | None, ...]:
        raw = (part.split("=", 1)[1] for part in folder.split("/"))
        return tuple(None if v == NO_VALUE else unquote(v) for v in raw)

    # -- versions -------------------------------------------------------------------------
    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self._names(MANIFESTS) if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, slices: folder -> generation} of a version, the last one by default."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "schema": None, "slices": {}}
        return json.loads(self._text(MANIFESTS, f"{version:012d}.json"))

    def _commit(self, base: dict, schema: StructType, slices: dict[str, str]) -> int:
        """Makes a new version visible: its manifest is written aside and moved to its place, where none may be."""
        version = base["version"] + 1
        body = json.dumps({"version": version, "schema": schema.json(), "slices": slices}, sort_keys=True)
        place, aside = self._at(MANIFESTS, f"{version:012d}.json"), self._at(MANIFESTS, f".{uuid.uuid4().hex}")
        files = self._files
        stream = files.create(aside, False)
        try:
            stream.write(bytearray(body.encode()))
        finally:
            stream.close()
        if files.exists(place) or not files.rename(aside, place):
            files.delete(aside, False)
            raise ConflictingWrite(f"version {version} of {self.path} was written by someone else")
        return version

    # -- reads ----------------------------------------------------------------------------
    def _rows(self, manifest: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        if not folders:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{manifest['slices'][f]}/{f}" for f in folders]
        typed = StructType([*schema.fields, *StructType.fromDDL("generation string").fields])
        return self.spark.read.schema(typed).option("basePath", self.path).parquet(*paths).select(*[F.col(f"`{c}`") for c in schema.names])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version; a table never written is an error."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise FileNotFoundError(f"no table in {self.path}")
        return self._rows(manifest, sorted(manifest["slices"]))

    # -- writes ---------------------------------------------------------------------------
    def _write(self, df: DataFrame, schema: StructType) -> str:
        generation = f"generation={uuid.uuid4().hex}"
        rest = [F.col(f"`{c}`") for c in schema.names if c not in self.slice_by]
        salt = F.pmod(F.xxhash64(*rest) if rest else F.rand(0).cast("long"), F.lit(TASKS_PER_SLICE))
        spread = df.select(*[F.col(f"`{c}`") for c in schema.names]).repartition(*[F.col(f"`{c}`") for c in self.slice_by], salt)
        spread.write.partitionBy(*self.slice_by).parquet(f"{self.path}/{generation}")
        return generation

    def _schema(self, df: DataFrame, base: dict) -> StructType:
        """The columns of the table; those of `df` must be the same."""
        if missing := [c for c in self.slice_by if c not in df.columns]:
            raise ValueError(f"no such slice columns: {', '.join(missing)}")
        if base["schema"] is None:
            order = [*[f for f in df.schema.fields if f.name not in self.slice_by], *[df.schema[c] for c in self.slice_by]]
            return StructType(order)
        schema = StructType.fromJson(json.loads(base["schema"]))
        here, there = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (df.schema, schema))
        if here != there:
            raise ValueError(f"columns differ from those of the table: {here} and {there}")
        return schema

    def replace(self, df: DataFrame, slices: list[tuple] | None = None) -> int:
        """Replace whole slices; a re-run gives the same table. Returns the new version.

        Without `slices` those that `df` has rows of are replaced. With
        `slices` exactly these are: one without rows becomes empty, and rows
        outside them are an error. Null is a slice value like others. Slices
        that are not replaced keep their files.
        """
        base = self.manifest()
        schema = self._schema(df, base)
        gone: set[tuple[str | None, ...]] = set()
        if slices is not None:
            wanted = self.spark.createDataFrame(list(slices), StructType([schema[c] for c in self.slice_by]))
            same = [df[c].eqNullSafe(wanted[c]) for c in self.slice_by]
            if df.join(F.broadcast(wanted), same, "left_anti").limit(1).count():
                raise ValueError("rows outside the slices that are replaced")
            gone = {tuple(r) for r in wanted.select(*[F.col(f"`{c}`").cast("string") for c in self.slice_by]).collect()}
        generation = self._write(df, schema)
        kept = {f: g for f, g in base["slices"].items() if self._values(f) not in gone}
        return self._commit(base, schema, kept | {f: generation for f in self._slices_in(generation)})

    def upsert(self, df: DataFrame, key: list[str]) -> int:
        """Rows of `df` replace those of the same key, wherever these are, or are added. Returns the new version.

        Only slices that hold a key of `df`, or get a row of it, are written
        again; the others keep their files. Of rows of `df` that share a key
        the first in the order of the other columns counts; a null in a key
        equals a null.
        """
        base = self.manifest()
        schema = self._schema(df, base)
        new = stage(one_per_key(df, key).select(*schema.names))
        keys = new.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(key)])

        def same(rows: DataFrame):
            return [rows[c].eqNullSafe(keys[f"__{i}"]) for i, c in enumerate(key)]

        def names(rows: DataFrame) -> set[tuple[str | None, ...]]:
            return {tuple(r) for r in rows.select(*[F.col(f"`{c}`").cast("string") for c in self.slice_by]).distinct().collect()}

        touched = names(new)
        if base["slices"] and not set(self.slice_by) <= set(key):
            rows = self._rows(base, sorted(base["slices"])).select(*{*key, *self.slice_by})
            touched |= names(rows.join(keys, same(rows), "left_semi"))
        folders = [f for f in sorted(base["slices"]) if self._values(f) in touched]
        merged = new
        if folders:
            old = self._rows(base, folders)
            merged = old.join(keys, same(old), "left_anti").unionByName(new)
        generation = self._write(merged, schema)
        kept = {f: g for f, g in base["slices"].items() if f not in folders}
        return self._commit(base, schema, kept | {f: generation for f in self._slices_in(generation)})

    def vacuum(self, keep_versions: int = 1) -> None:
        """Delete what the last `keep_versions` versions do not need. Not while someone writes or reads older ones."""
        if keep_versions < 1:
            raise ValueError("the last version stays")
        known = self.versions()
        needed = {g for v in known[-keep_versions:] for g in self.manifest(v)["slices"].values()}
        for version in known[:-keep_versions]:
            self._files.delete(self._at(MANIFESTS, f"{version:012d}.json"), False)
        for name in self._names():
            if name.startswith("generation=") and name not in needed:
                self._files.delete(self._at(name), True)
