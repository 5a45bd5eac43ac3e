"""Engines' answers, by hand."""

from lodestone.operators import vendors

POLY = "[[3,1],[5,1],[5,9.5],[3,9]]"


def test_shapes_and_faults(spark):
    rows = [
        ("fields", '{"images":[{"fields":[{"inferText":" a ","inferConfidence":0.5,"boundingPoly":{"vertices":[{"x":3,"y":1},{"y":9.5}]}},{}]},{}]}'),
        ("fields", "{}"), ("fields", "[1]"),
        ("pages", f'[[[{POLY},["one",0.5]],[{POLY},["",1]]],null]'), ("pages", "null"), ("pages", f'[[[{POLY},["one"]]]]'), ("pages", "{}"),
        ("lines", f'[[{POLY},"two\\n",0.25]]'), ("lines", "[]"), ("lines", '[[[],"x",1]]'), ("lines", f'[[{POLY},"x"]]'),
        ("regions", '[{"bbox":[1,2,3,4],"type":"table","res":[{"text":"p"},{"no":1},3,{"text":"q"}],"confidence":0.75},{"type":"figure","res":"r"}]'), ("regions", "[3]"),
        ("other", "{}"), (None, "{}"), ("lines", "not json"), ("lines", None),
    ]
    df = spark.createDataFrame([(k, *r, "kept") for k, r in enumerate(rows)], "k long, shape string, answer string, extra string").repartition(2)
    got = {r.k: r for r in vendors.decoded(df).collect()}
    blocks = lambda k: [(b.text, b.bbox, b.confidence, b.block_type) for b in got[k].blocks]
    assert blocks(0) == [("a", [0.0, 1.0, 3.0, 9.5], 0.5, "text"), ("", [0.0] * 4, 0.0, "text")] and got[0].plain_text == "a"
    assert blocks(3) == [("one", [3.0, 1.0, 5.0, 9.5], 0.5, "text"), ("", [3.0, 1.0, 5.0, 9.5], 1.0, "text")]
    assert blocks(7) == [("two", [3.0, 1.0, 5.0, 9.5], 0.25, "text")]
    assert blocks(11) == [("p  q", [1.0, 2.0, 3.0, 4.0], 0.75, "table"), ("r", [0.0] * 4, 0.0, "unknown")] and got[11].plain_text == "p  q\nr"
    assert [got[k].error for k in range(17)] == [None, None, "MALFORMED", None, None, "MALFORMED", "MALFORMED", None, None, "MALFORMED", "MALFORMED", None, "MALFORMED", "UNKNOWN_SHAPE", "UNKNOWN_SHAPE", "NOT_JSON", "NO_ANSWER"]
    assert all(not r.blocks and r.plain_text == "" for r in got.values() if r.error) and got[0].extra == "kept"


def test_an_empty_table(spark):
    assert vendors.decoded(spark.createDataFrame([], "shape string, answer string")).collect() == []
