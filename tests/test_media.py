import json

from pyspark.sql import functions as F

from verbarium.functions import media as M


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr).first()[0]


def test_media(spark):
    for u, want in (("https://y.t/watch?v=abcdefghijk&x=1", "abcdefghijk"), ("https://youtu.be/ABCDEF-_123", "ABCDEF-_123"), ("https://y.t/shorts/abcdefghijkl", None), ("x", None), (None, None)):
        assert one(spark, u, M.video_id(F.col("v"))) == want
    assert one(spark, 125.7, M.clock(F.col("v")), "double") == "2:05"
    seg = "array<struct<start:double,end:double,text:string>>"
    moved = one(spark, [(1.0, 2.0, " b "), (0.25, 1.0, "a")], M.shift_segments(F.col("v"), F.lit(2)), seg)
    assert [(r["start"], r["end"]) for r in moved] == [(61.0, 62.0), (60.25, 61.0)]
    assert one(spark, [(1.0, 2.0, " b "), (0.25, 1.0, "a")], M.transcript(F.col("v")), seg) == "a b"
    df = spark.createDataFrame([(1, [("Ka", 5.0, 6.0), ("ka", 1.0, 1.5), ("ka", 0.0, 0.1), ("o", 0.0, 1.0)])], "id int, w array<struct<word:string,start:double,end:double>>")
    assert [tuple(r) for r in M.first_words(df, "id", "w").collect()] == [(1, "ka", 1.0, 1.5)]


def test_fenced_json(spark):
    got = one(spark, 'Here:\n```json\n{"a": 1}\n```\nok', M.fenced_json(F.col("v")))
    assert json.loads(got) == {"a": 1}
    assert json.loads(one(spark, 'text [1, 2] end', M.fenced_json(F.col("v")))) == [1, 2]
    assert one(spark, "{broken", M.fenced_json(F.col("v"))) is None and one(spark, None, M.fenced_json(F.col("v"))) is None
