"""Table writers.  Parquet is canonical; JSON lines drop null fields.  Tables are replaced atomically (`tables`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cidrloom.functions.fields import text_of
from cidrloom.session import cut_lineage
from cidrloom.sources.tables import commit_tables, read_table

TABLE = "data"


def write_parquet(df: DataFrame, path: str) -> None:
    commit_tables(df.sparkSession, path, {TABLE: df})


def write_json_lines(df: DataFrame, path: str, skip_empty: bool = False) -> bool:
    """Whole-table overwrite; with `skip_empty` an empty table leaves the old one in place."""
    if skip_empty and df.isEmpty():
        return False
    commit_tables(df.sparkSession, path, {TABLE: df}, "json")
    return True


def write_text_lines(df: DataFrame, path: str) -> None:
    """Plain text files for other programs, no versions."""
    df.select("value").write.mode("overwrite").text(path)


def write_enriched(enriched: DataFrame, root: str, project=None) -> None:
    """Raw records as lines, and projected ones when a projection is given, as tables `raw` and `projected` of `root`.

    The joined records are written once and the projection reads that table, so the join runs once.  Both tables change
    together; without a projection there is no table `projected` any more.
    """
    stored = cut_lineage(enriched)
    tables = {"raw": stored.select(text_of(stored, "record").alias("value"))}
    if project is not None:
        tables["projected"] = project(stored).select(F.col("record").alias("value"))
    commit_tables(enriched.sparkSession, root, tables, "text")


__all__ = ["read_table", "write_enriched", "write_json_lines", "write_parquet", "write_text_lines"]
