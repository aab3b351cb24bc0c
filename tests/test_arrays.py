"""JSON array files: quotes and depth of pieces, and arrays that are written element by element."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from cidrloom.sources import arrays
from workload import q_sources


def plain_change(piece):
    parts = re.sub(r"(?s)\\.", "", piece).split('"')
    depth = lambda text: sum(map(text.count, "[{")) - sum(map(text.count, "]}"))
    return {"quotes": len(parts) - 1, "out": depth("".join(parts[::2])), "in": depth("".join(parts[1::2]))}


@pytest.mark.parametrize("limit", [2_000_000, 50])
def test_changes_of_pieces(monkeypatch, limit):
    monkeypatch.setattr(arrays, "CHANGE_BYTES", limit)
    rng = random.Random(1)
    pieces = ["".join(rng.choice('\\\\"[]{}a \u00e9\U0001f600') for _ in range(rng.randrange(12))) for _ in range(3000)] + ["[" * 200]
    assert arrays.changes_column(pa.array(["zz", *pieces])[1:]).to_pylist() == [plain_change(p) for p in pieces]
    assert arrays.changes_column(pa.array([], pa.string())).to_pylist() == []


def test_no_row_holds_a_whole_array(spark, tmp_path, monkeypatch):
    n = 3000
    events = spark.range(n).select(F.col("id").alias("event_id"), F.lit(1).cast("bigint").alias("user_id"), F.lit("view").alias("event_type"), F.lit(0.5).alias("value"), F.when(F.col("id") != 5, F.lit('{"k": 1}')).alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    longest, write = [], DataFrameWriter.text

    def spied(self, path, *args, **options):
        longest.append(self._df.agg(F.max(F.length("value"))).first()[0])
        write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "text", spied)
    rows = q_sources.read_log_arrays(spark, str(tmp_path)).collect()
    assert sorted(r.id for r in rows) == [i for i in range(n) if i != 5]
    assert len(longest) == 1 and longest[0] < 1000
