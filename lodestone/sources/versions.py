"""Versioned tables and exports that become visible as a whole, by optimistic commits on a shared file system.

A versioned table is a folder with data folders, one for each commit, and a small manifest for each version: which data
folder holds each bucket of keys. A commit rewrites the buckets of the keys that it replaces, checks that nothing that it
relies on has changed meanwhile, and makes its manifest visible by one rename that fails if another writer has taken the
number. Until then readers see nothing of it, and after a failure its data goes. Buckets that are not touched are shared by
versions, so a backup or a restored version is a manifest. Manifests have BUCKETS entries, whatever the table's size; a
table of N rows rewrites about N / BUCKETS rows for each bucket touched, so choose more buckets for a larger table.

The rename must be atomic and refuse an existing name, as in HDFS; on a local disk, two writers of one machine could meet
between its check and its rename.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class Refused(RuntimeError):
    """A commit that must not happen: its base, source or report is not what it should be. Nothing of it is visible."""


class Folder:
    """The few file-system calls that commits need, by Hadoop's API, so for any store that Spark can read."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.hadoop = spark, path.rstrip("/"), spark._jvm.org.apache.hadoop.fs
        self.fs = self._of("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _of(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._of(name))) if self.fs.exists(self._of(name)) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._of(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._of(name), True)

    def read(self, name: str) -> dict:
        stream = self.fs.open(self._of(name))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        stream = self.fs.create(self._of(name), True)
        try:
            stream.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> None:
        """Makes what was written under a hidden name visible; Refused if the name is taken."""
        context = self.hadoop.FileContext.getFileContext(self._of("").toUri(), self.spark._jsc.hadoopConfiguration())
        option = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        try:
            context.rename(self._of(old), self._of(new), option)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                raise Refused(f"{new} is there already: another writer was faster") from error
            raise


def _manifest_name(version: int) -> str:
    return f"_versions/{version:012d}.json"


def latest(spark: SparkSession, path: str) -> int:
    """The newest version; 0 if there is none."""
    return max((int(x[:12]) for x in Folder(spark, path).names("_versions") if re.fullmatch(r"\d{12}\.json", x)), default=0)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """Of a version, the newest by default: version, base, key, n_buckets, schema, parts (data folder by bucket), about."""
    version = latest(spark, path) if version is None else version
    folder = Folder(spark, path)
    if not version or not folder.exists(_manifest_name(version)):
        raise ValueError(f"{path} has no version {version}")
    return folder.read(_manifest_name(version))


def as_of(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table's rows in a version, the newest by default. Rows are as they were committed, also in an empty version."""
    return _rows(spark, path, manifest(spark, path, version))


def _rows(spark: SparkSession, path: str, held: dict, buckets: list[str] | None = None) -> DataFrame:
    parts = [f"{path.rstrip('/')}/{x}" for b, x in sorted(held["parts"].items()) if buckets is None or b in buckets]
    schema = T.StructType.fromJson(held["schema"])
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def _same(a: DataFrame, b: DataFrame) -> bool:
    names = sorted(a.columns)
    if names != sorted(b.columns):
        return False
    count = lambda df: df.groupBy(*names).count()
    return count(a).exceptAll(count(b)).isEmpty() and count(b).exceptAll(count(a)).isEmpty()


def commit(
    rows: DataFrame, path: str, key: str, keys: DataFrame | None = None, base: int | None = None, source: DataFrame | None = None, source_now: Callable[[], DataFrame] | None = None,
    report: DataFrame | None = None, everything: bool = False, n_buckets: int = BUCKETS, about: dict | None = None,
) -> int:
    """Replaces all rows of some keys, as a new version, whose number is returned.

    keys: a table of one column, the keys to replace (default: those of rows); one without rows disappears. Rows of other
    keys than these are not allowed. everything: all keys are replaced. base: the version that the caller has worked from
    (default: the newest); if there is a newer one by now, the commit is Refused. source, source_now: the source's identity
    when the work began, as a table that does not change (see readers.identities and store.kept), and how to read it
    again; it must be the same just before the commit. report: one row whose `valid` must be true.

    A null key is a key like any other. n_buckets counts for the first version only. Empty rows make an empty version.
    """
    spark = rows.sparkSession
    folder, now = Folder(spark, path), latest(spark, path)
    base = now if base is None else base
    held = manifest(spark, path, base) if base else {"parts": {}, "n_buckets": n_buckets, "key": key, "schema": json.loads(rows.schema.json())}
    old_schema = T.StructType.fromJson(held["schema"])
    if held["key"] != key or [(f.name, f.dataType) for f in old_schema] != [(f.name, f.dataType) for f in rows.schema]:
        raise ValueError("key and columns must be those of the version before")
    if report is not None and not report.select("valid").first()[0]:
        raise Refused("the report is not valid")
    bucket = F.pmod(F.xxhash64(key), F.lit(held["n_buckets"])).cast("string")
    work = f"_data/{uuid.uuid4().hex}"
    try:
        if everything:
            parts, fresh = {}, rows
        else:
            given = keys is not None
            keys = (keys if given else rows.select(key)).toDF(key).distinct()
            touched = [r[0] for r in keys.select(bucket).distinct().collect()]
            keys, same = keys.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))
            if given and not rows.join(keys, same, "left_anti").isEmpty():
                raise ValueError("there are rows of keys that are not to be replaced")
            parts = {b: x for b, x in held["parts"].items() if b not in touched}
            old = _rows(spark, path, held, touched)
            fresh = old.join(keys, same, "left_anti").unionByName(rows)
        fresh.withColumn("_bucket", bucket).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{work}")
        made = [x for x in folder.names(work) if x.startswith("_bucket=")]
        parts |= {x.removeprefix("_bucket="): f"{work}/{x}" for x in made}
        told = {"version": base + 1, "base": base, "key": key, "n_buckets": held["n_buckets"], "schema": held["schema"], "parts": parts, "about": about or {}}
        folder.write(pending := f"{work}/_manifest.json", told)
        if source is not None and source_now is not None and not _same(source, source_now()):
            raise Refused("the source has changed since the work began")
        if latest(spark, path) != base:
            raise Refused(f"version {base} is not the newest any more")
        folder.fs.mkdirs(folder._of("_versions"))
        folder.rename(pending, _manifest_name(base + 1))
    except BaseException:
        folder.delete(work)
        raise
    return base + 1


def restored(spark: SparkSession, path: str, version: int) -> int:
    """A new version with the rows of an earlier one; no data is copied."""
    held, now = manifest(spark, path, version), latest(spark, path)
    folder, pending = Folder(spark, path), f"_data/{uuid.uuid4().hex}.json"
    folder.write(pending, held | {"version": now + 1, "base": now, "about": {"restored": version}})
    folder.fs.mkdirs(folder._of("_versions"))
    folder.rename(pending, _manifest_name(now + 1))
    return now + 1


def vacuumed(spark: SparkSession, path: str, keep: list[int]) -> list[int]:
    """Deletes all versions but the newest and those to keep (backups), and the data that only they had; those deleted.

    No commit may run meanwhile: its data would not be known yet.
    """
    folder, newest = Folder(spark, path), latest(spark, path)
    versions = [int(x[:12]) for x in folder.names("_versions") if re.fullmatch(r"\d{12}\.json", x)]
    kept = {newest, *keep} & {*versions}
    used = {x for v in kept for x in manifest(spark, path, v)["parts"].values()}
    for v in {*versions} - kept:
        folder.delete(_manifest_name(v))
    for work in folder.names("_data"):
        inside = [f"_data/{work}/{x}" for x in folder.names(f"_data/{work}") if x.startswith("_bucket=")]
        for x in inside:
            if x not in used:
                folder.delete(x)
        if not used & {*inside}:
            folder.delete(f"_data/{work}")
    return sorted({*versions} - kept)


# --- exports ----------------------------------------------------------------------------------------------------------


def export_together(tables: dict[str, DataFrame], path: str, name: str, about: dict | None = None, report: DataFrame | None = None) -> dict:
    """Writes several tables as JSON lines below path/name, visible all at once or not at all; what the history says of it.

    A name that is there already, and an export without a row in its first table, are Refused. about: fields of the
    history's entry. Spark writes each table in parts; a column `document` alone is written as it is, a document a line.
    """
    first = next(iter(tables.values()))
    spark = first.sparkSession
    folder, work = Folder(spark, path), f"_building-{uuid.uuid4().hex}"
    if folder.exists(name):
        raise Refused(f"{name} is there already")
    try:
        counts = {}
        for k, rows in tables.items():
            rows.write.mode("error").option("ignoreNullFields", False).format("text" if rows.columns == ["document"] else "json").save(f"{path}/{work}/{k}")
            counts[k] = spark.read.text(f"{path}/{work}/{k}").count()
        if not counts[next(iter(tables))]:
            raise Refused("there is nothing to export")
        entry = {"export": name, "counts": counts, **(about or {})}
        folder.write(f"{work}/about.json", entry)
        folder.rename(work, name)
    except BaseException:
        folder.delete(work)
        raise
    return entry


def exported(spark: SparkSession, path: str, name: str, table: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table of an export; without a schema, its documents as text."""
    return spark.read.schema(schema).json(f"{path}/{name}/{table}") if schema else spark.read.text(f"{path}/{name}/{table}").withColumnRenamed("value", "document")


def export_history(spark: SparkSession, path: str) -> DataFrame:
    """(export, n_rows, about as JSON) of all exports that became visible, by name; n_rows: of the first table."""
    folder = Folder(spark, path)
    found = [folder.read(f"{x}/about.json") for x in folder.names() if not x.startswith("_") and folder.exists(f"{x}/about.json")]
    rows = [(x["export"], next(iter(x["counts"].values())), json.dumps(x, ensure_ascii=False, sort_keys=True)) for x in found]
    return spark.createDataFrame(rows, "export string, n_rows long, about string").orderBy("export")
