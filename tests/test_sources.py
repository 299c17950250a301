import io
import json
import zipfile

from pyspark.sql import functions as F

from faultloom.config import LocalizationConfig
from faultloom.functions.logs import log_fields
from faultloom.plans.localize import Inputs, localize
from faultloom.sources import javasrc, readers, writers
from faultloom.streaming.logs import log_stream

JAVA = {
    "src/p/A.java": """
        package p; import q.Util; import static q.Util.x; import w.*;
        /** not { a class */ public class A {
          private static final String NAME = "disk"; private Util util = new Util();
          public void open(String file, Conn c) throws IOException {
            if (file == null) { return; }
            LOG.info("opening " + file + " on " + NAME);
            util.check(file); c.peer().send(file); this.close();
          }
          void close() { LOG.warn(String.format("closing %s", NAME)); for (int i = 0; i < 3; i++) { open("}", null); } }
          static class In { int run() { LOG.error("bad {} of {}", 1, 2); return 1; } }
        }""",
    "src/q/Util.java": "package q; public class Util { boolean check(String f) { LOG.debug(\"checked {}\", f); return true; } }",
    "src/p/Conn.java": "package p; public class Conn { Peer peer() { return null; } } ",
    "src/p/Peer.java": "package p; class Peer { void send(String s) { } }",
}


def sources(spark):
    return spark.createDataFrame([("proj-1", p, c) for p, c in JAVA.items()], "project string, path string, content string")


def test_java_methods_and_templates(spark):
    found = javasrc.facts(sources(spark)).cache()
    got = {r["method_path"] for r in javasrc.methods(found).collect()}
    assert got == {"src.p.A#open", "src.p.A#close", "src.p.A$In#run", "src.q.Util#check", "src.p.Conn#peer", "src.p.Peer#send"}
    logs = {(r["method"], r["level"], r["template"]) for r in javasrc.log_templates(found).collect()}
    assert logs == {("p.A#open", "info", "opening {} on disk"), ("p.A#close", "warn", "closing {}"), ("p.A$In#run", "error", "bad {} of {}"), ("q.Util#check", "debug", "checked {}")}


def test_java_calls(spark):
    edges = {(r["method"], r["callee"]) for r in javasrc.call_edges(javasrc.facts(sources(spark)).cache()).collect()}
    assert {("p.A#open", "q.Util#check"), ("p.A#open", "p.A#close"), ("p.A#close", "p.A#open")} <= edges


def test_docx_and_xlsx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Ti</w:t></w:r><w:r><w:t>tle</w:t></w:r></w:p><w:p/></w:body></w:document>')
    (tmp_path / "R-1.docx").write_bytes(blob.getvalue())
    (tmp_path / "R-2.docx").write_bytes(b"no zip")
    got = {r["file"]: r["paras"] for r in readers.docx_reports(spark, str(tmp_path)).collect()}
    assert got == {"R-1.docx": ["Title", ""], "R-2.docx": []}
    x = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{x}"><sheetData><row>{cell("A1", "title")}{cell("B1", "Methods")}</row><row>{cell("A2", "R-1")}{cell("B2", "a/B#m, ,c")}</row></sheetData></worksheet>')
    (tmp_path / "truth.xlsx").write_bytes(blob.getvalue())
    assert [tuple(r) for r in readers.truth_xlsx(spark, str(tmp_path / "truth.xlsx")).collect()] == [("R-1", ["a/B#m", "c"])]


def test_call_graph_scores_and_yaml(spark, tmp_path):
    tree = {"p.A": {"location": {"file": "A.java", "line": 1}, "methods": [{"p.A#m": {"location": {"file": "A.java", "line": 2}, "calls": [{"callee": "p.B#k", "line": 3}], "logs": [{"template": "x {}", "level": "info", "line": 4}]}}]}}
    (tmp_path / "v-1.json").write_text(json.dumps(tree, indent=1))
    methods, calls, logs = readers.call_graph_json(spark, str(tmp_path / "v-1.json"))
    assert methods.first()["method"] == "p.A#m" and methods.first()["version"] == "v-1"
    assert (calls.first()["callee"], logs.first()["template"]) == ("p.B#k", "x {}")
    (tmp_path / "R-1_vsm.txt").write_text("a.B#m: 0.5\nbroken\na.B#m: 0.75\na.B#m: 0.25\n")
    assert [tuple(r) for r in readers.scores_text(spark, str(tmp_path / "R-1_vsm.txt"), "vsm").collect()] == [("R-1", "vsm", "a.B#m", 0.25)]
    (tmp_path / "c.yml").write_text("llm:\n  model: 'x'\n  url: http://a:1 # note\ntop: 3\n")
    assert readers.yaml_config(spark, str(tmp_path / "c.yml")) == {"llm": {"model": "x", "url": "http://a:1"}, "": {"top": "3"}}


def test_coverage_csv_and_writers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "zk-1.csv").write_text("filePath,methodSig,internalCovered,internalTotal,coveringTest\nf,\"a.m(B, C)\",1,2,t@3\n")
    row = readers.coverage_csv(spark, str(tmp_path / "in")).first()
    assert (row["version"], row["methodSig"], row["internalTotal"]) == ("zk-1", "a.m(B, C)", 2)
    scores = spark.createDataFrame([("R-1", "m", 0.123456), ("R-1", "n", 0.9)], "title string, method string, score double")
    writers.score_lines(scores, str(tmp_path / "out"), 4)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["n: 0.9000", "m: 0.1235"]


def test_readers_of_folders(spark, tmp_path):
    for name, content in {"reports/a.json": '{"title": "R-1", "logs": ["x"]}', "reports/b.json": "{broken", "src/main/A.java": "class A {}", "src/test/B.java": "class B {}", "src/main/CTest.java": "class C {}", "src/main/d.txt": "text\nof d"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    assert {(r["title"], tuple(r["logs"] or ())) for r in readers.reports_json(spark, f"{tmp_path}/reports").collect() if r["title"]} == {("R-1", ("x",))}
    assert [(r["path"].rsplit("/", 1)[-1], r["text"]) for r in readers.texts(spark, f"{tmp_path}/src", "*.txt").collect()] == [("d.txt", "text\nof d")]
    java = lambda skip: {(r["project"], r["path"], r["content"]) for r in readers.java_sources(spark, f"{tmp_path}/src", skip=skip).collect()}
    assert java("test_dirs") == {("src", "main/A.java", "class A {}"), ("src", "main/CTest.java", "class C {}")}
    assert java("test_files") == {("src", "main/A.java", "class A {}"), ("src", "test/B.java", "class B {}")}
    (tmp_path / "links.tsv").write_text("A\thttp://a\nbroken\nB\thttp://b\n")
    assert {tuple(r) for r in readers.links_tsv(spark, f"{tmp_path}/links.tsv").collect()} == {("A", "http://a"), ("B", "http://b")}
    (tmp_path / "R-1-classes.json").write_text('[{"class": "A", "type": "INFO", "content": "x", "line": null}, {"class": "B", "type": "WARN", "content": "y"}]')
    assert {(r["title"], r["class"], r["type"]) for r in readers.cached_events(spark, f"{tmp_path}/R-1-classes.json").collect()} == {("R-1", "A", "INFO"), ("R-1", "B", "WARN")}


def test_writers_of_folders(spark, tmp_path):
    tokens = spark.createDataFrame([("R-1", 1, ["c"]), ("R-1", 0, ["a", "b"]), ("R-2", 0, [])], "title string, segment_no int, tokens array<string>")
    writers.token_lines(tokens, f"{tmp_path}/tokens")
    assert (tmp_path / "tokens" / "title=R-1").exists() and [r["value"] for r in spark.read.text(f"{tmp_path}/tokens/title=R-1").collect()] == ["a", "b", "c"]
    writers.documents_by_name(spark.createDataFrame([("a/b", "{}")], "name string, text string"), f"{tmp_path}/docs", "20240101_000000")
    assert [tuple(r) for r in spark.read.text(f"{tmp_path}/docs").select("name", "value").collect()] == [("20240101_000000_a_b", "{}")]
    raw = spark.createDataFrame([("g", "b.m()", 1, 2, "t@1"), ("f", "a.m(B, C)", 0, 1, "t@2"), ("f", "a.m(B, C)", 0, 1, "s@2")], "filePath string, methodSig string, internalCovered int, internalTotal int, coveringTest string")
    writers.coverage_csv(raw, f"{tmp_path}/coverage")
    back = readers.coverage_csv(spark, f"{tmp_path}/coverage").drop("version")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, raw.collect()))
    ranking = spark.createDataFrame([("R-1", i, f"m{i}", 1.0 / i) for i in range(1, 8)], "title string, rank int, method string, score double")
    writers.total_scores(ranking, f"{tmp_path}/total")
    row = spark.read.json(f"{tmp_path}/total").first()
    assert row["title"] == "R-1" and [m["method"] for m in row["methods"]] == ["m1", "m2", "m3", "m4", "m5"]
    writers.json_files(ranking, f"{tmp_path}/json", by="title")
    writers.parquet_by(ranking, f"{tmp_path}/parquet", "title")
    assert spark.read.json(f"{tmp_path}/json").count() == spark.read.parquet(f"{tmp_path}/parquet").count() == 7
    metrics = spark.createDataFrame([("Overall", 3, 0.5, 0.25), ("A", 1, 1.0, 1.0)], "system string, count long, accuracy_at_n double, mrr double")
    assert [r["value"] for r in writers.metric_lines(metrics).collect()] == ["A: Accuracy@N 1.0000, MRR 1.0000, reports 1", "Overall: Accuracy@N 0.5000, MRR 0.2500, reports 3"]


def test_outline(spark):
    html = "<p>top</p><h1>One</h1><p>a&nbsp; b</p><h2>Two</h2><p>c<p>d</p><h1>Three</h1><p></p>"
    got = [(r["path"], r["text"]) for r in readers.page_outline(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).orderBy("para_no").collect()]
    assert got == [([], "top"), (["One"], "a b"), (["One", "Two"], "c"), (["One", "Two"], "d"), (["Three"], "")]


def test_log_stream(spark, tmp_path):
    (tmp_path / "a.log").write_text("2012-01-01 10:00:00,123 INFO org.apache.hadoop.X: hello\nnoise\n")
    q = log_stream(spark, str(tmp_path), F.lit("hadoop")).writeStream.format("memory").queryName("lines").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["class"], r["type"], r["content"]) for r in spark.table("lines").collect()] == [("org.apache.hadoop.X", "INFO", "hello")]
    assert spark.range(1).select(log_fields(F.lit("x"), F.lit("hadoop")).alias("e")).first()["e"] is None


def test_small_project_end_to_end(spark):
    p = "org.apache.hadoop."
    reports = spark.createDataFrame(
        [("f", "HDFS-1", "hadoop-1.0", "opening disk fails", [f"2012-01-01 10:00:00,123 INFO {p}A: opening f on disk"], [f"x.E\n at {p}B.check(B.java:1)\n at {p}A.open(A.java:2)"])],
        "file string, title string, version string, description string, logs array<string>, stack_traces array<string>",
    )
    methods = spark.createDataFrame([("hadoop-1.0", f"{p}A#open", "opening disk file"), ("hadoop-1.0", f"{p}B#check", "other words"), ("hadoop-1.0", f"{p}C#far", "disk")], "project string, method_path string, code string")
    calls = spark.createDataFrame([("v", 0, 0, 0, f"{p}A#open", f"{p}B#check", 1), ("v", 2, 0, 0, f"{p}C#far", f"{p}A#open", 1)], "version string, class_ord int, method_ord int, call_ord int, method string, callee string, line int")
    entries = spark.createDataFrame([("v", i, 0, f"{p}{c}", f"{p}{m}", "", 0) for i, (c, m) in enumerate((("A", "A#open"), ("B", "B#check"), ("C", "C#far")))], "version string, class_ord int, method_ord int, class string, method string, file string, line int")
    templates = spark.createDataFrame([(f"{p}A", f"{p}A#open", "opening {} on disk", "info", 0, 0)], "class string, method string, template string, level string, class_ord int, method_ord int")
    covered = spark.createDataFrame([("v", f"{p}A.open(int)", 1.0, ["t"]), ("v", f"{p}B.check()", 1.0, ["t", "u"])], "version string, method_sig string, coverage double, covering_tests array<string>")
    ranking = localize(Inputs(reports, methods, calls, entries, templates, covered), LocalizationConfig()).orderBy("rank").collect()
    assert {r["method"] for r in ranking} == {f"{p}A#open", f"{p}B#check", f"{p}C#far"}
    assert [r["rank"] for r in ranking] == [1, 2, 3] and ranking[-1]["method"] == f"{p}C#far"


def test_java_files_of_one_part_are_scanned_by_all_cores(spark):
    one = spark.range(3000).coalesce(1).selectExpr("'p' AS project", "concat('P', id, '.java') AS path", "concat('class P', id, ' { void run() { LOG.info(1); } }') AS content")
    assert one.rdd.getNumPartitions() == 1
    assert javasrc.facts(one).rdd.getNumPartitions() > 1
    assert javasrc.facts(one).count() == 9000 and javasrc.facts(one, ("log",)).count() == 3000
    empty = javasrc.facts(one.limit(0))
    assert empty.count() == 0 and javasrc.call_edges(empty).count() == 0


def test_java_sources_are_scanned_once_for_calls(spark):
    """A scan of a file is counted; calls, types and owners all read its facts."""
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            scans.add(b.num_rows)
            yield b

    sources = spark.createDataFrame([("p", "A.java", "package a; class A { B b; void run() { b.go(); } }"), ("p", "B.java", "package a; class B { void go() { } }")], "project string, path string, content string")
    found = javasrc.facts(sources.mapInArrow(counted, sources.schema))
    assert [(r["method"], r["callee"]) for r in javasrc.call_edges(found).collect()] == [("a.A#run", "a.B#go")]
    assert scans.value == 2
