import itertools
import random
import re

from pyspark.sql import functions as F

from faultloom.functions import logs
from faultloom.operators import coverage, evaluate, graph, matching, resolve, scoring


def test_minmax_equal_scores_are_one(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 1.0), ("b", 3.0)], "t string, score double")
    assert sorted((r["t"], r["score"]) for r in scoring.minmax(df, ["t"]).collect()) == [("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 1.0)]


def test_rank_decay(spark):
    df = spark.createDataFrame([("r", 0, i, f"m{i}") for i in range(12)] + [("r", 1, 0, "m5")], "title string, trace int, pos int, method string")
    got = {r["method"]: r["score"] for r in scoring.stack_rank_scores(df).collect()}
    assert got["m0"] == 1.0 and got["m5"] == 1.0 and got["m1"] == 0.5 and got["m11"] == 0.1


def test_fuse_without_a_channel(spark):
    shape = "title string, method string, score double"
    log = spark.createDataFrame([("r", "a$B#m", 2.0), ("r", "a.C#m", 1.0)], shape)
    similar = spark.createDataFrame([("r", "mod.src.java.a.B#m", 1.0), ("r", "z.Z#m", 0.0)], shape)
    got = {r["method"]: round(r["score"], 3) for r in scoring.fuse(log, log.limit(0), similar).collect()}
    assert got == {"a.B#m": 1.12, "a.C#m": 0.0}


def test_metrics(spark):
    ranking = spark.createDataFrame([("HDFS-1", 1, "a.B#m"), ("HDFS-1", 2, "a.C#m"), ("ZK-1", 1, "a.B#m")], "title string, rank int, method string")
    truth = spark.createDataFrame([("HDFS-1", "x/C#m"), ("ZK-1", "y/Q#m"), ("ZK-2", "y/Q#m")], "title string, method string")
    got = {r["system"]: (r["count"], r["accuracy_at_n"], r["mrr"]) for r in evaluate.metrics(evaluate.first_hits(ranking, truth), F.split_part("title", F.lit("-"), F.lit(1)), 5).collect()}
    assert got == {"HDFS": (1, 1.0, 0.5), "ZK": (2, 0.0, 0.0), "Overall": (3, 1 / 3, 0.5 / 3)}


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    got = graph.closure(e, spark.createDataFrame([(1,), (4,)], "node long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (1, 3), (1, 4), (4, 4)]


def test_pagerank_against_plain_loop(spark):
    edges = [("t", "a", "b"), ("t", "b", "c"), ("t", "c", "a"), ("t", "a", "d"), ("u", "x", "y")]
    got = {(r["title"], r["method"]): r["pagerank"] for r in graph.pagerank(spark.createDataFrame(edges, "title string, src string, dst string")).collect()}
    for title in ("t", "u"):
        own = [(s, d) for t, s, d in edges if t == title]
        nodes = sorted({n for e in own for n in e})
        rank = dict.fromkeys(nodes, 1 / len(nodes))
        for _ in range(200):
            loose = sum(rank[n] for n in nodes if not any(s == n for s, _ in own))
            rank = {n: 0.15 / len(nodes) + 0.85 * (sum(rank[s] / sum(a == s for a, _ in own) for s, d in own if d == n) + loose / len(nodes)) for n in nodes}
        for n in nodes:
            assert abs(got[title, n] - rank[n]) < 1e-5
        assert abs(sum(v for (t, _), v in got.items() if t == title) - 1) < 1e-9


def test_upstream_and_greedy_chains(spark):
    edges = spark.createDataFrame([("p", "m"), ("q", "p"), ("m", "p")], "caller string, callee string")
    got = {tuple(r["chain"]) for r in graph.upstream_chains(spark.createDataFrame([("m",)], "target string"), edges, 2).collect()}
    assert got == {("m",), ("p", "m"), ("q", "p", "m")}
    chains = spark.createDataFrame([("t", 0, ["p", "m"]), ("t", 0, ["m"]), ("t", 1, ["m", "x"]), ("t", 1, ["z", "x"])], "title string, log_pos int, chain array<string>")
    assert sorted(tuple(r["chain"]) for r in graph.accepted_chains(chains).collect()) == [("p", "m"), ("z", "x")]


def test_execution_edges(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("x", "c")], "src string, dst string")
    roots = spark.createDataFrame([("t", "a"), ("t", "c")], "title string, method string")
    assert sorted(map(tuple, graph.execution_edges(e, roots).collect())) == [("t", "a", "b"), ("t", "b", "c")]


def test_templates(spark):
    tp = spark.createDataFrame(
        [("p.A", "p.A#m", "open {} now", "info", 0, 0), ("p.A", "p.A#n", "open {}", "info", 0, 1), ("p.B", "p.B#k", "close {}", "warn", 1, 0), ("p.B", "p.B#e", "{}", "warn", 1, 1)],
        "class string, method string, template string, level string, class_ord int, method_ord int",
    )
    ev = spark.createDataFrame([(1, "x.A", "INFO", "open f now"), (2, "x.Z", "WARN", "close it"), (3, "x.Z", "UNKNOWN", "open q"), (4, "x.A", "ERROR", "open f")], "event_id int, class string, type string, content string")
    assert {r["event_id"]: r["method"] for r in matching.match_templates(ev, tp).collect()} == {1: "p.A#n", 2: "p.B#k", 3: "p.A#n"}


def test_templates_against_all_pairs(spark):
    rng = random.Random(5)
    line = lambda bits, n: "".join(rng.choice(bits) for _ in range(rng.randint(0, n)))
    tp = [(f"p.{rng.choice('ABC')}", f"m{i}", rng.choice([None, line(["{}", " ", "open", "at", "%", "_", "x ", "\\"], 5)]), rng.choice(["info", "WARN"]), i // 5, i % 5) for i in range(60)]
    ev = [(i, f"q.{rng.choice('ABZ')}", rng.choice(["INFO", "warn", "UNKNOWN", "ERROR"]), line([" ", "open", "at", "%", "_", "x ", "y", "\\"], 6)) for i in range(300)]
    want = {}
    for key, owner, kind, content in ev:
        fits = []
        for of, method, template, level, *at in tp:
            template = "{}" if template is None else template
            pattern = ".*".join(map(re.escape, template.strip(" ").split("{}"))) + ".*"
            if template and kind in ("UNKNOWN", level.upper(), level.lower()) and re.fullmatch(pattern, content.strip(" "), re.S):
                own = of[-1] == owner[-1]
                if own or len(template.replace("{}", "").strip(" ")) >= 2:
                    fits.append((own, at, method))
        if fits:
            want[key] = max(fits)[2]
    events = spark.createDataFrame(ev, "event_id int, class string, type string, content string")
    templates = spark.createDataFrame(tp, "class string, method string, template string, level string, class_ord int, method_ord int")
    assert {r["event_id"]: r["method"] for r in matching.match_templates(events, templates).collect()} == want


def test_islands_against_state_machine(spark):
    rng = random.Random(3)
    docs = {d: [rng.choice("LSCx") for _ in range(rng.randint(0, 15))] for d in range(150)}
    want = set()
    for d, lines in docs.items():
        opened = False
        for i, k in enumerate(lines):
            if k == "L":
                want.add((d, i, "log"))
                opened = False
            elif k == "S" or (k == "C" and opened):
                want.add((d, i, "stack"))
                opened = True
    df = spark.createDataFrame([(d, i, k) for d, ls in docs.items() for i, k in enumerate(ls)], "d int, i int, k string")
    c = F.col("k")
    assert {(r["d"], r["i"], r["kind"]) for r in logs.line_islands(df, "d", "i", c == "L", c == "S", c == "C").collect()} == want


def test_coverage(spark):
    raw = spark.createDataFrame([("f", "a.C.m(int)", 1, 4, "t@1"), ("f", "a.C.m(int)", 0, 0, "u@2"), ("f", "a.C.m(int)", 2, 4, "t@9")], "filePath string, methodSig string, internalCovered int, internalTotal int, coveringTest string")
    made = coverage.method_coverage(raw)
    assert made.first().asDict() == {"method_sig": "a.C.m(int)", "coverage": 0.5, "covering_tests": ["t", "u"]}
    methods = spark.createDataFrame([("r", "z.C#m"), ("r", "z.D#m")], "title string, method string")
    got = {r["method"]: r["score"] for r in coverage.inverse_coverage(methods, made).collect()}
    assert abs(got["z.C#m"] - (1 - 3 / 5)) < 1e-12 and abs(got["z.D#m"] - (1 - 1 / 5)) < 1e-12


def test_qualifiers(spark):
    calls = spark.createDataFrame([("p.A", "p.A#m", q, "go") for q in (None, "this", "v", "f", "T", "v.next", "zzz")], "class string, scope string, qualifier string, member string")
    t = lambda rows, shape: spark.createDataFrame(rows, shape)
    got = resolve.resolve_qualifiers(
        calls, t([("p.A#m", "v", "p.V")], "scope string, name string, type string"), t([("p.A", "f", "p.F")], "class string, name string, type string"),
        t([("p.A", "T", "q.T")], "class string, name string, resolved string"), t([("p.V", "next", "p.N")], "owner string, name string, type string"),
    )
    assert {r["qualifier"]: r["callee"] for r in got.collect()} == {
        None: "p.A#go", "this": "p.A#go", "v": "p.V#go", "f": "p.F#go", "T": "q.T#go", "v.next": "p.N#go", "zzz": "p.A.unknown#go",
    }


def test_long_qualifiers_are_walked_to_the_end(spark):
    chain = lambda n: ".".join(["v", *(f"m{i}" for i in range(1, n))])
    calls = spark.createDataFrame([("p.A", "p.A#m", q, "go") for q in (chain(5), chain(6), chain(7), chain(19), "v.m1.zzz.m2.m3.m4.m5", None)], "class string, scope string, qualifier string, member string")
    t = lambda rows, shape: spark.createDataFrame(rows, shape)
    tables = (
        t([("p.A#m", "v", "p.T0")], "scope string, name string, type string"), t([], "class string, name string, type string"),
        t([], "class string, name string, resolved string"), t([(f"p.T{i - 1}", f"m{i}", f"p.T{i}") for i in range(1, 30)], "owner string, name string, type string"),
    )
    got = {r["qualifier"]: r["callee"] for r in resolve.resolve_qualifiers(calls, *tables).collect()}
    assert got == {chain(5): "p.T4#go", chain(6): "p.T5#go", chain(7): "p.T6#go", chain(19): "p.T18#go", "v.m1.zzz.m2.m3.m4.m5": "p.T1#go", None: "p.A#go"}
    assert resolve.resolve_qualifiers(calls.limit(0), *tables).count() == 0


def test_camel_case_rewrite_is_equal(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abABC1") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    plain = F.regexp_extract_all("w", F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), F.lit(0))
    spaced = F.regexp_extract_all(F.regexp_replace("w", "([A-Z]+)([A-Z][a-z])", "$1 $2"), F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0))
    assert df.filter(plain != spaced).count() == 0
    assert list(itertools.islice(words, 1))


def test_structured_reports(spark):
    from faultloom.operators.reports import structured_reports, totals

    paras = ["T ", "D", "INFO org.apache.hadoop.X: a", "words", "  at a.B.c(B.java:1)", "see SomeError", "x Caused by: y", "Caused by: z.QException: q", "WARN org.apache.hadoop.Y: b", "at lone words", "at d.E.f(E.java)"]
    out = structured_reports(spark.createDataFrame([("f", paras), ("g", ["only"]), ("h", [])], "file string, paras array<string>")).cache()
    got = {r["file"]: r for r in out.collect()}
    assert (got["f"]["title"], got["f"]["description"]) == ("T", "D") and got["g"]["title"] == ""
    assert got["f"]["logs"] == ["INFO org.apache.hadoop.X: a", "WARN org.apache.hadoop.Y: b"]
    assert got["f"]["stack_traces"] == ["at a.B.c(B.java:1)\nsee SomeError\nCaused by: z.QException: q", "at d.E.f(E.java)"]
    assert tuple(totals(out).first()) == (3, 2, 2)


def test_execution_edges_of_many_titles(spark):
    """Against brute force; a title's own leaves are never paired with the titles that share its method."""
    draw = random.Random(5)
    pairs = sorted({(draw.randrange(14), draw.randrange(14)) for _ in range(24)})
    logs_of = {f"r{t}": sorted(draw.sample(range(14), draw.choice([1, 1, 2, 3]))) for t in range(40)}
    reach = {n: {n} for n in range(14)}
    for _ in range(14):
        for s, d in pairs:
            for seen in reach.values():
                if s in seen:
                    seen.add(d)
    want = {(t, s, d) for t, ms in logs_of.items() for s, d in pairs if any(s in reach[m] for m in ms) and any(m in reach[d] for m in ms)}
    edges = spark.createDataFrame(pairs, "src int, dst int")
    logged = spark.createDataFrame([(t, m) for t, ms in logs_of.items() for m in ms], "title string, method int")
    got = [tuple(r) for r in graph.execution_edges(edges, logged).select("title", "src", "dst").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_leaves_do_not_meet_titles(spark):
    """2 000 titles log from one method with 2 000 leaves: 4 000 000 pairs of a title and a node if they met."""
    edges = spark.range(2000).selectExpr("'m' AS src", "concat('leaf', id) AS dst").union(spark.createDataFrame([("m", "m")], "src string, dst string"))
    logged = spark.range(2000).selectExpr("id AS title", "'m' AS method")
    assert graph.between(edges, logged.select(F.col("method").alias("node"))).count() == 1
    assert graph.execution_edges(edges, logged).filter("src = 'm' AND dst = 'm'").count() == 2000


def _summary_by_force(callables, sites):
    """``coverage_summary`` of callables (id, class, name, file, start_line, is_main, is_test) and sites (id, enclosing, callee)."""
    edges = {(s[1], s[2]) for s in sites}
    tests = [c for c in callables if c[6]]
    reach = {t[0]: {t[0]} for t in tests}
    while any([not seen >= (more := {d for s, d in edges if s in seen}) and not seen.update(more) for seen in reach.values()]):
        pass
    called = {d for s, d in edges if s in reach}
    out = set()
    for t in tests:
        for m in callables:
            if m[5] and m[0] in reach[t[0]]:
                own = {s for s in sites if s[1] == m[0]}
                out.add((m[3], f"{m[1]}.{m[2]}()", sum(s[2] in called for s in own), len(own), f"{t[1]}.{t[2]}@{t[4]}"))
    return out


def test_coverage_summary_by_force(spark, monkeypatch):
    """Cycles, equal labels and signatures, tests that call nothing, callables both main and test, repeated sites."""
    shape = "id long, class string, name string, file string, start_line int, is_main boolean, is_test boolean"
    for seed in range(2):
        draw = random.Random(seed)
        callables = [(i, f"C{i % 3}", f"m{draw.randrange(9)}", f"F{i % 2}", draw.randrange(2), draw.random() < 0.6, draw.random() < 0.4) for i in range(36)]
        sites = [(draw.randrange(50), draw.randrange(18), draw.randrange(36)) for _ in range(40)]
        given = spark.createDataFrame(callables, shape).withColumn("signature", F.concat("name", F.lit("()")))
        places = spark.createDataFrame(sites, "id long, enclosing long, callee long")
        monkeypatch.setattr(coverage, "BROADCAST_LABELS", 100 * seed)
        got = coverage.coverage_summary(given, places, coverage.direct_edges(places, places.limit(3))).select("filePath", "methodSig", "internalCovered", "internalTotal", "coveringTest")
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == _summary_by_force(callables, sites)


def test_coverage_summary_closes_over_callers_only(spark, monkeypatch):
    """Two tests, one of which calls the other, and 5 000 leaves: the closure has three rows, not 10 000."""
    callables = spark.range(5002).selectExpr("id", "'C' AS class", "concat('m', id) AS name", "concat('m', id, '()') AS signature", "'F' AS file", "1 AS start_line", "id > 1 AS is_main", "id < 2 AS is_test")
    sites = spark.range(2, 5002).selectExpr("id", "1L AS enclosing", "id AS callee").union(spark.createDataFrame([(0, 0, 1)], "id long, enclosing long, callee long"))
    seen, closure = [], coverage.closure
    monkeypatch.setattr(coverage, "closure", lambda *a: seen.append(closure(*a)) or seen[-1])
    assert coverage.coverage_summary(callables, sites, coverage.direct_edges(sites, sites.limit(0))).count() == 10_000
    assert seen[0].count() == 3
