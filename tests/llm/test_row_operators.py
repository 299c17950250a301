"""Operators that SQL can express, the secret scan, and the hard rows of each."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from faultloom.llm import exact_dedup, line_dedup, mixing, queries, secret_scan

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    text = lambda names, data: sorted(repr([round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in sorted(range(len(names)), key=names.__getitem__)]) for r in data)
    assert text(df.columns, [tuple(r) for r in df.collect()]) == text(columns, want.fetchall())


def hard_rows(spark, n=0):
    rows = [(1, "Abc É", "en", "s", 5), (2, "aBC É", None, None, 5), (3, "abc é", "en", "s", 5), (4, None, None, None, None), (5, "", "en", "s", 0), (6, "x" * 300_000, "de", "t", 1), (7, "Abc É", "en", "s", 5), (7, "Abc É", "en", "s", 5)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("digest", "salt", "size", "key", "host_pages", "keep_id", "text_sha256"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_exact_dedup_hard_rows(spark):
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(hard_rows(spark)).collect())
    assert got == [(1, 7, 4, False), (2, 7, 4, False), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True), (7, 7, 4, True), (7, 7, 4, True)]
    low = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(hard_rows(spark), keep="min").collect()}
    assert low[7] == 1 and low[5] == 4
    assert exact_dedup.exact_dedup(hard_rows(spark).limit(0)).count() == 0


def test_exact_dedup_sorts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = exact_dedup.sorted_texts(docs, "doc_id", "text", "max", 64)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [head" in plan and "rangepartitioning(head" in plan and "HashAggregate" not in plan


def test_exact_dedup_runs_over_partitions(spark):
    """Runs longer than a partition and a batch, of which only the ends meet other texts."""
    text = F.when(F.col("id") < 3000, "b Hot Text").when(F.col("id") < 3010, "a").otherwise(F.concat(F.lit("c"), (F.col("id") % 50).cast("string")))
    df = spark.range(4000).select(F.col("id").alias("doc_id"), text.alias("text")).repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keep, best in (("max", max), ("min", min)):
            groups = {}
            for r in df.collect():
                groups.setdefault(r["text"].lower(), []).append(r["doc_id"])
            want = sorted((i, best(ids), len(ids), i == best(ids)) for ids in groups.values() for i in ids)
            got = exact_dedup.exact_dedup(df, keep=keep)
            assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_exact_dedup_hot_group(spark):
    df = spark.range(1, 1201).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same Text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = exact_dedup.exact_dedup(df).cache()
    assert got.filter("group_size = 800 AND keep_id = 1199").count() == 800 and got.filter("kept").count() == 401


def test_line_dedup_hot_site(spark):
    """One site with most pages and many boilerplate lines, as one hash table."""
    text = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("menu "), i.cast("string"))), "\n"), F.lit("\nbody "), F.col("id").cast("string"))
    df = spark.range(3000).select("id", text.alias("text"), F.when(F.col("id") < 2900, "hot").otherwise("cold").alias("host"))
    got = line_dedup.drop_site_lines(df, "text", "host").groupBy("n_lines", "n_dropped").count().collect()
    assert [tuple(r) for r in got] == [(101, 100, 3000)]


def test_line_dedup_hard_rows(spark):
    rows = [(i, f"menu\nbody {i}\n\nmenu ", "h") for i in range(20)] + [(20, None, "h"), (21, "", "h"), (22, "menu\nmenu", None), (23, "alone", "q")]
    df = spark.createDataFrame(rows, "page long, text string, host string").withColumn("site", F.lit(1)).withColumn("hash", F.lit(2)).withColumn("n_lines", F.lit(3))
    got = {r["page"]: r for r in line_dedup.drop_site_lines(df, "text", "host", ratio=0.5).collect()}
    assert got[0]["text"] == "body 0\n" and (got[0]["n_lines"], got[0]["n_dropped"], got[0]["host_pages"]) == (4, 2, 22)
    assert got[20]["text"] is None and got[20]["n_lines"] == 0 and got[21]["text"] == ""
    assert got[22]["text"] == "menu\nmenu" and got[23]["text"] == "alone"
    assert line_dedup.drop_site_lines(df.limit(0), "text", "host").count() == 0
    page = spark.createDataFrame([("<head><title>T</title><script>x<p>y</script></head><p>a&amp;b <b>c</b><br>d", "http://u:p@Ho.st:80/x"), (None, None)], "html string, url string")
    out = [tuple(r) for r in page.select(line_dedup.html_text(F.col("html")), line_dedup.url_host(F.col("url"))).collect()]
    assert out == [("T\na&b c\nd", "ho.st"), ("", "")]


def test_mixing_hard_rows(spark):
    got = mixing.mix(hard_rows(spark)).collect()
    assert len(got) == 8 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in mixing.mix(hard_rows(spark)).collect())
    assert mixing.mix(hard_rows(spark).limit(0)).count() == 0
    empty = mixing.mix(spark.createDataFrame([(1, None, None, "s", 0)], DOCS)).first()
    assert (empty["size"], empty["target"], empty["taken"]) == (0, 0.0, 0)


def test_mixing_targets(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") < 2000, "a").when(F.col("id") < 2900, "b").otherwise("c").alias("source"))
    rows = mixing.mix(df).groupBy(F.when(F.col("doc_id") < 2000, "a").when(F.col("doc_id") < 2900, "b").otherwise("c").alias("s")).agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect()
    total = sum(r["size"] for r in rows)
    assert abs(sum(r["target"] for r in rows) - total) < 1e-6
    assert all(abs(r["t"] - r["target"]) <= 7 and r["target"] <= 3 * r["size"] + 1e-6 for r in rows)


def test_secrets_against_python(spark):
    texts = ["", None, "é token = 'abcdef1' x", "secret=token:abcdef PASSWORD: \"hunter22\"", "AKIAAKIA" + "B" * 12 + " AKIA12", "g" + "a1" * 12 + "g " + "ab" * 11, "api_key=short api-key=abcdefgh apikey='Zz9+/_.=-'", "k " * 5000 + "passwd=123456", "id " + "q7Zp2LxV9mKt4RbW8sYc1Nd6" + " end"]
    rule = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(df).select("doc_id", secret_scan.spans_text(F.col("base")).alias("b"), secret_scan.spans_text(F.col("found")).alias("f")).collect()}
    for i, t in enumerate(t or "" for t in texts):
        spans = [(m.start(), 0, m.end()) for m in rule.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert got[i]["b"] == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)), t
    assert got[8]["f"] == "entropy:3:27" and got[8]["b"] == ""
    assert secret_scan.scan_secrets(df.limit(0)).count() == 0


def test_window_entropy(spark):
    import math
    from collections import Counter

    for token in ("abcdefghij0123456789", "aaaaabbbbbccccc11111", "q7Zp2LxV9mKt4RbW8sYc1Nd6aaaaaaaaaaaaaaaa"):
        best = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(token[i : i + 20]).values()) for i in range(len(token) - 19))
        assert abs(spark.range(1).select(secret_scan.window_bits(F.lit(token)).alias("b")).first()["b"] - best) < 1e-9


def test_long_tokens_are_candidates(spark):
    import random
    import string

    rng = random.Random(4)
    draw = lambda n: "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(n))
    texts = ["key " + draw(512) + " end", "key " + draw(513) + " end", "key " + draw(6000) + ".", draw(60_000), "a1" * 5000 + "q7Zp2LxV9mKt4RbW8sYc1Nd6", "a-" * 20_000 + "b7", "ab/" * 20_000 + "c1"]
    assert not any(w in t.lower() for t in texts for w in ("xxxx", "lorem", "dummy", "sample"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["f"] for r in secret_scan.scan_secrets(df).select("doc_id", secret_scan.spans_text(F.col("found")).alias("f")).collect()}
    assert [got[i] for i in range(4)] == ["entropy:4:516", "entropy:4:517", "entropy:4:6004", "entropy:0:60000"]
    assert [got[i] for i in range(5, 7)] == ["", ""]
    # the run of hex digits is a finding of its own, which an entropy finding may not overlap
    assert got[4] == "hex:0:10000"


def scanned_by_hand(text):
    """All spans of a text, by regular expressions and entropies worked out window by window."""
    import math
    from collections import Counter

    rule = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    base = [(m.start(), 0, m.end()) for m in rule.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    found = list(base)
    for m in re.finditer(r"[A-Za-z0-9+/_-]+", text):
        token = m[0]
        if len(token) < 20 or not (re.search("[0-9]", token) and re.search("[A-Za-z]", token)) or any(re.search(p, token) for p in secret_scan.ALLOWED):
            continue
        windows = (Counter(token[i : i + 20]) for i in range(len(token) - 19))
        best = max(-sum(c / 20 * math.log2(c / 20) for c in w.values()) for w in windows)
        least = secret_scan.HEX_BITS if re.fullmatch("[0-9a-f-]+|[0-9A-F-]+", token) else secret_scan.BASE64_BITS
        if best >= least - 1e-12 and not any(a < m.end() and m.start() < b for a, _, b in base):
            found.append((m.start(), 3, m.end()))
    show = lambda spans: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return show(base), show(found)


def test_secret_query_against_brute_force(spark):
    import hashlib

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in queries.op7_secret_scan(spark, SF).collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        base, found = scanned_by_hand(text)
        kinds = [x.split(":")[0] for x in base.split(",")]
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(kinds.count(k) for k in secret_scan.KINDS[:3])
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and got[i]["spans"] == found


def test_secret_scan_of_made_up_texts(spark):
    import random

    rng = random.Random(9)
    parts = ["token=", "secret: '", "AKIA", "deadbeef0123", "-", "/", "é", " ", "example", "q7Zp2LxV9mKt4RbW8sYc1Nd6", "0123456789abcdef", "ABCDEF0123456789", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice((5, 20, 300)))) for _ in range(40)] + ["token=abcdef " * 1000, "passwd=a1b2c3d4\n" * 65]
    df = spark.createDataFrame([(7, t, "clash") for t in texts], "doc_id long, text string, found string").withColumn("base", F.lit(1))
    got = sorted(tuple(r) for r in secret_scan.scan_secrets(df).select(secret_scan.spans_text(F.col("base")), secret_scan.spans_text(F.col("found"))).collect())
    assert got == sorted(map(scanned_by_hand, texts))
