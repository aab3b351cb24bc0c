"""Tables that are replaced as a whole: new data goes to a fresh folder, then one small pointer file is swapped.

A reader sees the old tables or the new ones, never a mixture and never a gap, and a job that fails leaves the old ones in
place.  Several tables of one root are replaced together.  Data of the last but one commit stays for readers that have
begun; older data is removed.  One writer at a time per root.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

POINTER = "_current"
FORMATS = ("parquet", "json", "text")


class Root:
    """A folder of versions with its pointer file, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _place(self, name: str):
        return self._jvm.Path(f"{self.root}/{name}")

    def _files(self):
        return self._jvm.Path(self.root).getFileSystem(self._conf)

    def manifest(self) -> dict | None:
        """What the pointer file says; None before the first commit."""
        if not self._files().exists(self._place(POINTER)):
            return None
        stream = self._files().open(self._place(POINTER))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _swap(self, manifest: dict) -> None:
        fresh = self._place(f"{POINTER}-{uuid.uuid4().hex}")
        stream = self._files().create(fresh, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.Options.Rename, 1)
        options[0] = self._jvm.Options.Rename.OVERWRITE
        context = self._jvm.FileContext.getFileContext(self._files().getUri(), self._conf)
        context.rename(fresh, self._place(POINTER), options)

    def remove(self, version: str) -> None:
        self._files().delete(self._place(version), True)

    def commit(self, tables: dict[str, DataFrame], formats: dict[str, str]) -> None:
        """Write all tables, then let them take the place of the former ones at once."""
        unknown = set(formats.values()) - set(FORMATS)
        if unknown:
            raise ValueError(f"unknown formats {sorted(unknown)}")
        before, version = self.manifest(), f"v-{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                writer = df.write.option("ignoreNullFields", True) if formats[name] == "json" else df.write
                writer.format(formats[name]).save(f"{self.root}/{version}/{name}")
            schemas = {name: df.schema.jsonValue() for name, df in tables.items()}
            self._swap({"version": version, "before": before and before["version"], "formats": formats, "schemas": schemas})
        except BaseException:
            self.remove(version)
            raise
        if before and before.get("before"):
            self.remove(before["before"])


def commit_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame], formats: dict[str, str] | str = "parquet") -> None:
    """Replace the tables under `root` by these, all at once. `formats`: one for all, or one per table."""
    Root(spark, root).commit(tables, dict.fromkeys(tables, formats) if isinstance(formats, str) else formats)


def table_names(spark: SparkSession, root: str) -> list[str]:
    manifest = Root(spark, root).manifest()
    return sorted(manifest["formats"]) if manifest else []


def read_table(spark: SparkSession, root: str, name: str = "data") -> DataFrame:
    """The table as the last commit left it; the plan keeps reading that version."""
    manifest = Root(spark, root).manifest()
    if manifest is None or name not in manifest["formats"]:
        raise FileNotFoundError(f"no table {name!r} under {root}")
    schema = StructType.fromJson(manifest["schemas"][name])
    return spark.read.schema(schema).format(manifest["formats"][name]).load(f"{root.rstrip('/')}/{manifest['version']}/{name}")
