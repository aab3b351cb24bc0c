"""Keys of sheet rows, with the rules run once per combination of texts."""

from pyspark.sql import functions as F

from cidrloom.functions.patterns import INTERFACE_NORMALIZER, Normalizer
from cidrloom.operators import match as M
from cidrloom.sources.readers import parse_sheet_lines

COLUMNS = {"host": "device", "name": "device", "port": "interface"}
RULES = {"device": Normalizer(), "interface": INTERFACE_NORMALIZER}


def test_sheet_keys_of_repeated_rows(spark):
    some = ['"host":"R1","port":"GigE1/0"', '"host":"r1","port":"gi-1-0"', '"host":"R1","name":"r1"', '"host":"R1","name":"R2"', '"port":5', '"host":null,"port":"xe-1"']
    lines = [(f'{{"_source":{{"file":"f","sheet":"s","row_index":{i}{kind}}},{text}}}', i) for i in range(40) for text, kind in [(some[i % 6], ',"sheettype":"hosting"' if i % 20 == 0 else "")]]
    rows = parse_sheet_lines(spark.createDataFrame(lines, "value string, line_ord long"))
    keys = M.sheet_ptr_keys(rows, COLUMNS, RULES)
    assert keys.schema["matches"].dataType.simpleString() == "bigint"
    got = {(r.key.fields, *r.key["values"]): (r.first["row_index"], r.matches) for r in keys.collect()}
    i = range(40)
    both = [k for k in i if k % 6 in (0, 1) and k % 20]
    alone = [k for k in i if k % 6 == 2 and k % 20]
    port = [k for k in i if k % 6 == 5 and k % 20]
    assert got == {("interface,device", "gi-1-0", "r1"): (min(both), len(both)), ("device", "r1"): (min(alone), len(alone)), ("interface", "xe-1"): (min(port), len(port))}


def test_rules_run_once_per_combination(spark, monkeypatch):
    lines = [(f'{{"_source":{{"file":"f","sheet":"s","row_index":{i}}},"host":"h{i % 5}","port":"ge-{i % 2}"}}', i) for i in range(500)]
    rows = parse_sheet_lines(spark.createDataFrame(lines, "value string, line_ord long"))
    stored, cut = [], M.cut_lineage

    def counted(df):
        stored.append(cut(df))
        return stored[-1]

    monkeypatch.setattr(M, "cut_lineage", counted)
    assert M.sheet_ptr_keys(rows, COLUMNS, RULES).agg(F.sum("matches")).first()[0] == 500
    assert stored[0].count() == 10
