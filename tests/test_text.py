import json

from pyspark.sql import functions as F

from graphloom.functions.text import ext_language, extension, repair_json


def repair(spark, raws):
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    return [r.fixed for r in df.select(repair_json("raw").alias("fixed")).collect()]


def test_json_repair_cases(spark):
    raws = ['```json\n{"a": 1}\n```',
            '{"s": "line1\nline2\tx"}',
            '{"s": "keep \\n escaped", "t": "q\\"uote"}',
            '{"code": """def f():\n    return "x\\\\y"\n"""}',
            '```\n{"a": [1, 2]}']
    fixed = repair(spark, raws)
    parsed = [json.loads(f) for f in fixed]
    assert parsed[0] == {"a": 1}
    assert parsed[1] == {"s": "line1\nline2\tx"}
    assert parsed[2] == {"s": "keep \n escaped", "t": 'q"uote'}
    assert parsed[3]["code"] == 'def f():\n    return "x\\\\y"\n'
    assert parsed[4] == {"a": [1, 2]}


def test_long_string_value(spark):
    big = "x" * 70000
    fixed = repair(spark, ['{"v": "' + big + '\nend"}'])
    assert json.loads(fixed[0])["v"] == big + "\nend"


def test_extension_language(spark):
    df = spark.createDataFrame([("a/b.py",), ("x.tsx",), ("y.weird",), ("noext",)], "p string")
    got = [(r.e, r.l) for r in df.select(extension("p").alias("e"),
                                         ext_language(extension("p")).alias("l")).collect()]
    assert got == [("py", "python"), ("tsx", "typescript"), ("weird", "weird"), ("", "")]
