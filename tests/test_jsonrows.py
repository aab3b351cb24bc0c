"""The Python pass over JSON text against the expressions, and its cost."""

import random
import time

from pyspark.sql import functions as F

from cidrloom.functions.jsonrows import UNSETTLED, canonical_text
from cidrloom.functions.jsontext import canonical, nodes, worked_out

ODD = [
    None, "", " ", "null", " true\n", '"x"', "\ufeff{}", "[1,]", "{,}", '{"a":1}{', "[NaN]", "[-Infinity]", '"\t"', '"\\x"', '"\\u12g4"', "'a'", "[01]", "[1.]", "[.5]", "[-]", "[1e]", "1\x0b",
    "-0", "[-0,-0.0,0.0,0.00,100,1.50]", "[1e3,1E+2,2.5e-3,1e-5,1e-7,1e15,1e16,1e21,1e22,8.41e21,2e-44,1e400,-1e400]", "[1e3,0.00001,0.000010]", "[0.1234567890123456,0.30000000000000004,123456789012345.6,1234567890123456.7]",
    "[9007199254740993,18446744073709551615,18446744073709551616,-9223372036854775808,-9223372036854775809,123456789012345678901234567890]", "[1" + "0" * 400 + "]", "[0." + "1" * 1200 + "]",
    '{"b":1,"a":2,"b":{"d":1,"c":[{"x":1,"x":{"y":1,"y":2}}],"d":1e3}}', '{"":1,"":{"":2}}', '{"a\\u0062":1,"ab":2}', '{"\\u0000":1,"a":2}', '{"\\u0000":1,"\\u0000":2}', '["\\u0000x"]',
    '["\\u0001","\\u00015","\\u0001\\u00015","a\\"\\u00015","\\u0001-0"]', '{"\\u0001":1,"\\u0001":2e3}', '["\\u001f\\u000b\\u0008\\u007f\x7f","\\\\u001f"]', '["\\/\\b\\f\\n\\r\\t\\""]',
    '["\\ud83d\\ude00","\U0001f600","\\ud800","\\udc00x"]', '{"\uffee":1,"\U0001f600":2,"\\ue000":3,"a":{"\U00010000":1,"\uffff":[{"\U0001f600":2,"\uff00":1.50}]}}', '{"\\ud800":1,"b":2}', '["\u2028\u00e9"]',
    "[" * 350 + "]" * 350, "[" * 600 + "1" + "]" * 600, "[" * 1200 + "]" * 1200, "[" + "{}," * 700 + "{}]", '{"' + "k" * 30_000 + '":1}', '{"' + "k" * 60_000 + '":1}', '["' + "v" * 60_000 + '"]', '{"a":"' + "\\u00e9" * 9_000 + '","a":1e3}',
]


def test_texts_are_settled_as_the_expressions_do(spark):
    rng = random.Random(11)
    pieces = list('{}[],:" \\0123456789eE+-.') + ['"a"', '"b":', '"a":', "null", "true", "1e3", "\\u0041", "é", "\\n", "0.50", '"\\u0001']
    texts = ODD + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    texts += ["{" + ",".join(f'"{rng.choice("ab")}":{rng.choice(["1", "1.0", "[]", "{}", "1e-9", "[1e3]", "-0", "tru"])}' for _ in range(rng.randrange(4))) + "}" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    rows = df.select("i", canonical(F.col("t")).alias("now"), worked_out(F.col("t")).alias("want")).orderBy("i").collect()
    assert [(texts[r.i], r.now) for r in rows if r.now != r.want] == []
    assert sum(r.now is not None for r in rows) > 150


def test_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(0, bytearray(b'["\xff\xc3"]')), (1, bytearray(b"[\xff]")), (2, bytearray(b'{"a":1e3}'))], "i int, b binary").select("i", F.expr("cast(b AS string)").alias("t"))
    rows = df.select("i", canonical(F.col("t")).alias("now"), worked_out(F.col("t")).alias("want")).collect()
    assert [r.now for r in rows] == [r.want for r in rows] and rows[2].now == '{"a":1000.0}'


def test_usual_records_are_settled_in_python():
    usual = ['{"id":1,"deep":{"z":"v","x":{"y":-1,"y":2},"z":"w"},"tags":["a",null,1.50,1e3,0.30000000000000004,1e300]}', '["\\u0001","\U0001f600"]', "[" + "{}," * 5000 + "1]"]
    assert UNSETTLED not in [canonical_text(t) for t in usual]


def test_cost_of_a_record(spark):
    """Log records with repeated keys took about a millisecond each, and their nodes half as much."""
    line = F.concat(F.lit('{"id":'), "id", F.lit(',"ip":"198.51.100.7","n":1e3,"tags":["a",1,null],"deep":{"z":"v","x":{"y":-1,"y":3},"z":"w"},"p":{"a":1,"b":{"c":2,"d":"e"}}}'))

    def seconds(rows, column):
        df = spark.range(0, rows, 1, 1).select(column(line).alias("c"))
        df.limit(10).write.format("noop").mode("overwrite").save()
        start = time.time()
        df.write.format("noop").mode("overwrite").save()
        return (time.time() - start) / rows

    slow = seconds(2_000, worked_out)
    assert seconds(20_000, canonical) < slow / 4
    assert seconds(20_000, lambda t: nodes(canonical(t))) < slow / 4
