"""Tables that are replaced at once, array files over many tasks, and resumed streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cidrloom.functions.fields import ProjectedField
from cidrloom.functions.ip import parse_cidr
from cidrloom.plans.enrich import project_logs
from cidrloom.session import staging_path
from cidrloom.sources import arrays, sinks
from cidrloom.sources.readers import read_logs
from cidrloom.sources.tables import Root, commit_tables, read_table, table_names
from cidrloom.streaming.flows import append_traces


def lines(spark, root, name):
    return sorted(r.value for r in read_table(spark, root, name).collect())


def test_a_failing_second_table_leaves_both_old_ones(spark):
    root = staging_path(spark, "root")
    logs = spark.createDataFrame([(1, '{"a":1.0}')], "log_id long, record string")
    project = lambda t: project_logs(t, [ProjectedField("a", "b")])
    sinks.write_enriched(logs, root, project)
    old_raw, old_projected = lines(spark, root, "raw"), lines(spark, root, "projected")
    assert (old_raw, old_projected) == (['{"a":1.0}'], ['{"b":1.0}'])
    held = read_table(spark, root, "raw")
    newer = spark.createDataFrame([(2, '{"a":2}')], "log_id long, record string")
    broken = lambda t: t.withColumn("record", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        sinks.write_enriched(newer, root, broken)
    assert lines(spark, root, "raw") == old_raw and lines(spark, root, "projected") == old_projected
    sinks.write_enriched(newer, root)
    assert lines(spark, root, "raw") == ['{"a":2}'] and table_names(spark, root) == ["raw"]
    assert [r.value for r in held.collect()] == old_raw  # a reader that began before the swap goes on
    with pytest.raises(FileNotFoundError):
        read_table(spark, root, "projected")


def test_versions_before_the_last_but_one_are_removed(spark):
    root = staging_path(spark, "root")
    versions = []
    for i in range(4):
        commit_tables(spark, root, {"data": spark.range(i)})
        versions.append(Root(spark, root).manifest()["version"])
    files = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(root))
    assert sorted(f.getPath().getName() for f in files) == sorted(["_current", *versions[-2:]])
    assert read_table(spark, root).count() == 3
    empty = staging_path(spark, "root")
    sinks.write_json_lines(spark.createDataFrame([(1, None)], "a int, b string"), empty)
    assert not sinks.write_json_lines(spark.createDataFrame([], "a int, b string"), empty, skip_empty=True)
    assert [tuple(r) for r in read_table(spark, empty).collect()] == [(1, None)]


def write(spark, text, name="array"):
    """One file with exactly this text."""
    path = staging_path(spark, name) + ".json"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-0.json")
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    stream.write(bytearray(text.encode()))
    stream.close()
    return path


def elements(spark, path):
    return [json.loads(r.record) for r in read_logs(spark, path).orderBy("log_id").collect()]


def test_array_files_are_read_in_order_by_many_tasks(spark):
    rng = random.Random(2)
    values = [{"i": i, "s": rng.choice(['a,b', '],[', '\\",', "é{", '"', "\\"]) * rng.randrange(4), "l": [[1, 2], {"x": [",", []]}][: rng.randrange(3)]} for i in range(3000)] + ["x,y", 5, None, [], {}]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for indent in (None, 1):
            path = write(spark, " \n" + json.dumps(values, indent=indent, ensure_ascii=False) + "\n ")
            assert spark.read.option("lineSep", ",").text(path).rdd.getNumPartitions() > 10
            assert elements(spark, path) == values
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_odd_arrays(spark):
    for text, want in (("[]", []), (" [ \n ] ", []), ("[1]", [1]), ('["a,b"]', ["a,b"]), ("[[],[1,2]]", [[], [1, 2]]), ('[{"a":1,"a":2}]', [{"a": 2}])):
        assert elements(spark, write(spark, text)) == want
    for text, where in (("[1,,2]", "byte 3"), ("[1,2,]", "byte"), ('{"a":1}', "no JSON array at byte 0"), ("[1,2", "byte 3"), ('[1,{"a":tru},3]', "byte 3"), ("[1],[2]", "byte 0"), ("", None), ('["a', "byte 0")):
        if where:
            with pytest.raises(Exception, match=where):
                elements(spark, write(spark, text))
    files = write(spark, "[1,2]")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{files}/part-1.json")
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    stream.write(bytearray(b'[3,[4,5],"]"]'))
    stream.close()
    assert elements(spark, files) == [1, 2, 3, [4, 5], "]"]
    assert arrays.array_elements(spark, files).filter("last").count() == 2


def test_repeated_documents_are_appended_once_over_batches_and_runs(spark):
    targets = spark.createDataFrame([("203.0.113.0/24", 3405803777), ("203.0.113.0/30", 3405803777), ("203.0.113.0/24", 3405803786)], "t string, ip long").select(parse_cidr(F.col("t")).alias("net"), "ip")
    source, sink, state = (staging_path(spark, x) for x in ("docs", "traces", "state"))

    def land(*destinations):
        docs = [json.dumps({"type": "trace", "src": "a", "dst": d, "stop_reason": "x", "start": {"sec": 0}, "hops": []}) for d in destinations]
        spark.createDataFrame([(d,) for d in docs], "value string").coalesce(1).write.mode("append").text(source)

    for batch in (["203.0.113.1", "203.0.113.1"], ["203.0.113.10", "203.0.113.1"], ["203.0.113.10", "203.0.113.99", "203.0.113.1"]):
        land(*batch)
        append_traces(spark, source, sink, state, files_per_batch=1, every=None, targets=targets).awaitTermination()
    rows = spark.read.parquet(sink).select("range", "destination").collect()
    assert sorted(map(tuple, rows)) == [("203.0.113.0/24", "203.0.113.10"), ("203.0.113.0/30", "203.0.113.1")]
