import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultloom.functions import logs, names, text
from faultloom.operators import vsm


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_tokens_split_identifiers(spark):
    got = one(spark, text.tokens(F.col("t")), t="public void readHTTPHeader_fooBar2(int x) été the readHTTPHeader")
    assert got == ["read", "http", "header", "foo", "bar", "x", "t"]
    assert one(spark, text.tokens(F.col("t")), t=None) == []


def test_tokens_are_those_of_single_words(spark):
    def by_word(t):
        words = [w for w in re.findall(r"\w+", t) if w.lower() not in text.KEYWORDS["java"]]
        parts = [c.lower() for w in words for p in w.split("_") for c in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", p)]
        return [p for p in parts if p not in text.STOP_WORDS]

    rng = random.Random(3)
    bits = ["for", "For", "brea\u212a", "cla\u017fs", "the", "The", "HTTPServer", "été", "x1y", "_", "__", " ", "  ", ".", "ñ", "\u0301", "9", "newFoo", "new", "\n", "İf", "if"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in made], "t string").select("t", text.tokens(F.col("t")).alias("d"), text.tokens(F.col("t"), distinct=False).alias("a"))
    for r in df.collect():
        want = by_word(unicodedata.normalize("NFC", r["t"]) if False else r["t"].replace("\u0301", "é"))
        assert r["a"] == want and r["d"] == list(dict.fromkeys(want)), r["t"]


def test_segments(spark):
    df = spark.createDataFrame([("a", [str(i) for i in range(1700)]), ("b", [])], "m string, tokens array<string>")
    rows = text.segments(df).orderBy("segment_no").collect()
    assert [(r["m"], r["segment_no"], len(r["tokens"])) for r in rows] == [("a", 0, 800), ("a", 1, 800), ("a", 2, 100)]


def test_comments_and_names(spark):
    assert one(spark, text.without_comments(F.col("t")), t="a; // b\nc /* d\n e */ f").split() == ["a;", "c", "f"]
    assert one(spark, names.signature_key(F.col("t")), t="p.C.m(List<A>, Map<B,C>)") == "p.C#m"
    assert one(spark, names.simple_key(F.col("t")), t="p.q.C$In#m") == "In#m"
    assert one(spark, names.truth_list(F.col("t")), t=" a.B#m, ,c/D#n,") == ["a.B#m", "c/D#n"]
    assert one(spark, names.layout_of(F.col("t")), t="hadoop-0.22.0") == "zookeeper"


def test_frames(spark):
    kept = lambda line: one(spark, logs.frame_is_kept(F.col("t"), F.lit("hadoop")), t=line)
    assert kept("at org.apache.hadoop.A$B.run(A.java:3)")
    assert not kept("at org.apache.hadoop.A$1.run(A.java:3)")
    assert not kept("at org.apache.hadoop.A.run(Native Method)")
    assert not kept("at java.lang.Thread.run(Thread.java)")
    assert kept("at x.thrift.A.run(A.java:3)")
    assert one(spark, logs.frame_method(F.col("t")), t="at a.B$C.<init>(B.java:1)") == "a.B$C#<init>"


def test_causes_first(spark):
    got = one(spark, logs.causes_first(F.col("t")), t="head\n at a\nCaused by: x\n at b\nCaused by: y")
    assert got == "Caused by: x\n at b\n\nCaused by: y\nhead\n at a"
    assert one(spark, logs.causes_first(F.col("t")), t="head") == "head"


def test_zookeeper_fields(spark):
    f = lambda t: one(spark, logs.log_fields(F.col("t"), F.lit("zookeeper")), t=t).asDict()
    assert f("2011-11-08 10:00:00,123 [myid:1] - INFO  [main:Learner@5] - hello") == {"class": "Learner", "type": "INFO", "content": "hello", "line": "5"}
    assert f("2011-11-08 10:00:00,123 WARN org.apache.zk.Quorum: text") == {"class": "Quorum", "type": "WARN", "content": "text", "line": None}
    assert f("nothing here")["class"] == "UNKNOWN" and f("nothing here")["content"] == "nothing here"


def test_template_like(spark):
    like = logs.template_like(F.lit("50% of {} in a_b"))
    assert spark.range(1).select(F.expr("'50% of x y in a_b!'").alias("c"), like.alias("l")).filter("c LIKE l").count() == 1
    assert spark.range(1).select(F.expr("'500 of x y in aab'").alias("c"), like.alias("l")).filter("c LIKE l").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 30), st.integers(0, 30), st.integers(1, 30))
def test_similarity_closed_form(a, b, c):
    """Against TF-IDF fitted on the two sets, with unit vectors."""
    own, both = math.log(3 / 2) + 1, math.log(3 / 3) + 1
    dot, x, y = c * both**2, math.sqrt(c * both**2 + a * own**2), math.sqrt(c * both**2 + b * own**2)
    closed = c / math.sqrt((c + a * vsm.OWN) * (c + b * vsm.OWN))
    assert abs(dot / (x * y) - closed) < 1e-12


def test_log_lines_match_known_layouts():
    rule = re.compile(logs.IS_LOG)
    assert rule.match("2012-01-01 10:00:00,123 INFO org.apache.hadoop.hdfs.X: text")
    assert rule.match("INFO [main] 2012-01-01 10:00:00,123 A.java (line 3) text")
    assert not rule.match("plain text about INFO")
    assert re.match(logs.IS_STACK, "  at a.b.C.d(C.java:1)") and re.match(logs.IS_STACK, "... 12 more")


def test_every_layout_and_shape_has_its_line():
    stamp, rule, stack = "2012-01-01 10:00:00,123", re.compile(logs.IS_LOG), re.compile(logs.IS_STACK)
    lines = {
        "level class": "WARN a.b.C: text", "level thread stamp": f"INFO [main] {stamp} text", "- level thread": " - INFO [main:Q@1] text", "stamp level class": f"{stamp} INFO a.b.C: text",
        "stamp level thread": f"12/01/01 10:00:00,123 ERROR [main] text", "stamp - level thread": f"{stamp} - INFO [main:Q@1] - text", "stamp thread - level thread -": f"{stamp} [id:1] - INFO [main:Q@1] - text",
        "stamp | field | level |": f"{stamp}|main|INFO|text", "thread stamp level": f"[junit] {stamp} DEBUG text", "file stamp - level": f"zoo.log.1-host:{stamp} - INFO text", "date owner level": "Jan 02, 2012 10:00:00 AM a.b.C INFO text",
    }
    assert set(lines) == set(logs.LAYOUTS)
    for layout, line in lines.items():
        assert re.match(r"(?i)\s*" + logs._layout(layout), line) and rule.match(line), layout
    for line in ("INFORMATION a.b.C: text", f"{stamp} text INFO", "text", "the class a.b.C: ERROR"):
        assert not rule.match(line), line
    shapes = {"frame": "\tat a.B.c(B.java:1)", "exception": "a.QException: text", "cause": "Caused by: a.b.QException", "thread": 'Exception in thread "main" a.QException: x', "left out": "... 3 more", "archive": " ~[a.jar:1]"}
    assert set(shapes) == set(logs.STACK_SHAPES) and all(map(stack.match, shapes.values()))
    assert not any(map(stack.match, ("at last", "three more", "QException thrown here", "Caused by nothing")))
