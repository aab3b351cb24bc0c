"""Canonical JSON text, its nodes and projections, against plain Python."""

import json
import random

from pyspark.sql import functions as F

from cidrloom.functions.fields import ProjectedField, flatten_display, flatten_fields, node_at, project_record
from cidrloom.functions.jsontext import canonical, nodes, set_member

BAD = ["", " ", "{", '{"a":', '{"a":1,}', "[1 2]", '{"a":01}', "{1:2}", "{1 :2}", "{'a':1}", "nul", '{"a":1} x', '{"a":1}{"b":2}', "[1,2", "NaN", '{"a":NaN}', "[1,]", "truefalse", "1,2", "1}", '{"a":"\x01"}', '{"k":1e400}', "[-]", "[+1]", "[.5]", "[1.]"]


def canon(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.c for r in df.select("i", canonical(F.col("t")).alias("c")).orderBy("i").collect()]


def dumps(value):
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def test_texts_that_are_no_json_are_refused(spark):
    assert canon(spark, BAD) == [None] * len(BAD)


def test_numbers_are_spelled_out(spark):
    texts = ["1.0", "1e3", "2.50", "100", "-0", "0.1000", "1E-7", "1e21", "1e16", "1e15", "123456789012345678901", "18446744073709551615", "-9223372036854775809", "0.00001", "0.000001", "1.5e300", "12345678.9", "-2.0", "[0,0.0,10]"]
    want = ["1.0", "1000.0", "2.5", "100", "-0.0", "0.1", "1e-7", "1e21", "1e16", "1000000000000000.0", "123456789012345680000.0", "18446744073709551615", "-9223372036854775808.0", "0.00001", "1e-6", "1.5e300", "12345678.9", "-2.0", "[0,0.0,10]"]
    want[10], want[12] = "1.2345678901234568e20", "-9.223372036854775808e18"
    got = canon(spark, texts)
    assert [g for k, g in enumerate(got) if k != 12] == [w for k, w in enumerate(want) if k != 12]
    assert float(got[12]) == -9223372036854775809.0


def test_repeated_keys_at_every_depth_keep_the_last_value(spark):
    text = '{"b":1,"a":{"x":1,"y":[{"p":1,"q":[],"p":2},{"p":3}],"x":{"r":1,"r":2.0}},"b":{"c":[1,{"d":0,"d":{}}]},"a b":"\\"x:1,","e":null}'
    assert canon(spark, [text]) == [dumps(json.loads(text))]


def random_value(rng, depth):
    kind = rng.randrange(8 if depth else 5)
    if kind < 5:
        return [None, True, rng.randrange(-99, 99), rng.choice(["", "a,b", '"', "\\", "{}[]:1.0", "é☃", "\n\t", "\u0001", "\u00015", "x\u0001"]), rng.randrange(1, 999) / 8][kind]
    if kind == 5:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "c.d", "", "e f", '"', "z\\", "é", "1"]): random_value(rng, depth - 1) for _ in range(rng.randrange(5))}


def walk(value, path, depth, out):
    """Nodes as the rules say: objects are listed unless their path is empty, then entered in key order."""
    if isinstance(value, dict):
        if path:
            out.append((path, "object", None, depth))
        for k in sorted(value, key=lambda k: k.encode()):
            walk(value[k], f"{path}.{k}" if path else k, depth + 1, out)
        return out
    tag = "list" if isinstance(value, list) else "null" if value is None else "bool" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"
    out.append((path, tag, dumps(value), depth))
    return out


def test_random_records(spark):
    rng = random.Random(5)
    values = [random_value(rng, 4) for _ in range(400)]
    texts = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for v in values]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("c", canonical(F.col("t")))
    rows = df.select("i", "c", nodes(F.col("c")).alias("n")).orderBy("i").collect()
    assert [json.loads(r.c) for r in rows] == values
    assert [r.c for r in rows] == [dumps(v) for v in values]
    assert [[tuple(n) for n in r.n] for r in rows] == [walk(v, "", 0, []) for v in values]
    merged = df.select("i", set_member(F.col("c"), "mmdb", F.lit('{"q":1.0}')).alias("m")).orderBy("i").collect()
    assert [json.loads(r.m) for r in merged] == [{**v, "mmdb": {"q": 1.0}} if isinstance(v, dict) else v for v in values]


def test_deep_records_need_no_job_to_plan(spark):
    text = "1"
    for k in range(60):
        text = f'{{"k{k}":{text}}}'
    df = spark.createDataFrame([(1, text)], "id int, r string")
    tracker = spark.sparkContext.statusTracker()
    before = tracker.getJobIdsForGroup(None)
    plan = flatten_fields(df, "r", ["id"])
    assert tracker.getJobIdsForGroup(None) == before
    assert plan.count() == 60
    assert "Exchange" not in project_record(df, "r", "id", [ProjectedField("k59")])._jdf.queryExecution().toString()


def test_stream_of_records(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.createDataFrame([(1, '{"a":{"b":1.0}}')], "id long, r string").write.parquet(source)
    flat = flatten_display(spark.readStream.schema("id long, r string").parquet(source), "r", ["id"])
    flat.writeStream.format("memory").queryName("flat").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.sql("SELECT key, text FROM flat").collect()] == [("a.b", "1.0")]


def test_projection_rules(spark):
    record = {"a": 1.0, "a.b": 5, "t": [1, None, "x", True, [2]], "o": {"p": "7", "q": {"r": "Yes"}, "s": [{"u": 1}]}, "n": None, "big": 2**63, "plus": "+5"}
    fields = [ProjectedField("a", "num", "string"), ProjectedField("a", "raw", "integer"), ProjectedField("t", "joined", "array_join"), ProjectedField("o", "x", "bool"), ProjectedField("o.p", None, "integer"), ProjectedField("o.s", None, "array_join"),
              ProjectedField("n", "none", "string"), ProjectedField("big", None, "integer"), ProjectedField("plus", None, "integer"), ProjectedField("gone"), ProjectedField("plus", "num"), ProjectedField("o.q", "q\"")]
    df = spark.createDataFrame([(1, json.dumps(record))], "k int, r string").withColumn("r", canonical(F.col("r")))
    out = json.loads(project_record(df, "r", "k", fields).first().record)
    assert out == {"num": "+5", "raw": 1.0, "joined": "1, null, x, true, ", "x.q.r": True, "o.p": 7, "o.s": [{"u": 1}], "none": "null", "big": 2**63, "plus": 5, 'q".r': "Yes"}
    node = df.select(node_at(F.col("r"), "o.q").alias("n"), node_at(F.col("r"), "o.z").alias("z"), node_at(F.col("r"), "a.b").alias("d")).first()
    assert tuple(node.n) == ("object", '{"r":"Yes"}') and node.z is None and node.d is None
