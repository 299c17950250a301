"""A lexical scanner for Java: classes, methods, symbols, calls and log templates.

Token level, without a grammar: strings and comments are told apart, braces matched.
``scan`` gives one record per fact; ``facts`` runs it over a table of sources, and the
other functions turn facts into the tables that the resolving joins need.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.logs import PLACEHOLDER

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*")|(?P<char>'(?:\\.|[^'\\\n])*')"""
    r"""|(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>.)""",
    re.S,
)
LOG_METHODS = {"debug", "info", "warn", "error", "trace", "fatal"}
MODIFIERS = set("public protected private static final abstract native synchronized transient volatile strictfp default".split())
NOT_METHODS = set("if for while switch catch synchronized return new throw else do try assert super this instanceof case".split())
#: The facts that calls are resolved by.
SYMBOL_KINDS = ("class", "inner", "import", "field", "variable", "method", "call")
FACTS = "kind string, package string, class string, method string, name string, value string, extra string, line int, ord int"


class _Scanner:
    def __init__(self, code: str) -> None:
        self.kinds, self.words, self.lines, line = [], [], [], 1
        for m in TOKEN.finditer(code):
            if m.lastgroup != "skip":
                self.kinds.append(m.lastgroup)
                self.words.append(m[0])
                self.lines.append(line)
            line += m[0].count("\n")
        self.code, self.facts, self.package = code, [], ""
        self.strings: dict[str, str] = {}
        self.close = self._pairs()

    def _pairs(self) -> dict[int, int]:
        out, stack = {}, []
        for i, w in enumerate(self.words):
            if self.kinds[i] != "mark":
                continue
            if w in "({[":
                stack.append(i)
            elif w in ")}]" and stack:
                out[stack.pop()] = i
        return out | {i: len(self.words) for i in stack}

    def add(self, kind: str, owner: str, method: str, name: str, value: str = "", extra: str = "", at: int = 0) -> None:
        line = self.lines[at] if at < len(self.lines) else 0
        self.facts.append((kind, self.package, owner, method, name, value, extra, line, len(self.facts)))

    def dotted(self, i: int) -> tuple[str, int]:
        """A dotted name from token ``i`` on, and the token after it."""
        parts = []
        while i < len(self.words) and (self.kinds[i] == "word" or self.words[i] == "*"):
            parts.append(self.words[i])
            i += 1
            if i < len(self.words) and self.words[i] == ".":
                i += 1
            else:
                break
        return ".".join(parts), i

    def run(self) -> list[tuple]:
        i = 0
        while i < len(self.words):
            w = self.words[i]
            if w == "package" and self.kinds[i] == "word":
                self.package, i = self.dotted(i + 1)
            elif w == "import":
                static = self.words[i + 1 : i + 2] == ["static"]
                path, end = self.dotted(i + 1 + static)
                self.add("import", "", "", path, "wildcard" if path.endswith("*") else "", "static" if static else "", i)
                i = end
            elif w in ("class", "interface", "enum") and self.kinds[i] == "word" and i + 1 < len(self.words) and self.words[i - 1 : i] != ["."]:
                i = self.type_at(i, "")
            else:
                i += 1
        return self.facts

    def type_at(self, i: int, outer: str) -> int:
        name = self.words[i + 1]
        full = f"{outer}${name}" if outer else f"{self.package}.{name}" if self.package else name
        self.add("inner" if outer else "class", outer or full, "", name, full, "", i)
        while i < len(self.words) and self.words[i] != "{":
            i += 1
        end = self.close.get(i, len(self.words))
        i += 1
        while i < end:
            w = self.words[i]
            if w in ("class", "interface", "enum") and self.kinds[i] == "word" and self.words[i - 1] != ".":
                i = self.type_at(i, full)
                continue
            if w == "(" and self.kinds[i - 1] == "word" and self.words[i - 1] not in NOT_METHODS:
                after = self.close.get(i, end) + 1
                if self.words[after : after + 1] == ["throws"]:
                    while after < end and self.words[after] not in "{;":
                        after += 1
                if self.words[after : after + 1] == ["{"]:
                    i = self.method_at(i, after, full)
                    continue
                i = after
                continue
            if w == "{" or w == "[":
                i = self.close.get(i, end) + 1
                continue
            if w in "=;" and self.kinds[i] == "mark" and self.kinds[i - 1] == "word":
                kind = self.type_before(i - 1)
                if kind:
                    self.add("field", full, "", self.words[i - 1], kind, "", i - 1)
                    self.constant(i, full)
                while i < end and self.words[i] != ";":
                    i = self.close.get(i, i) + 1 if self.words[i] in "({[" and self.kinds[i] == "mark" else i + 1
            i += 1
        return end + 1

    def type_before(self, i: int) -> str:
        """The simple type written before the name at ``i``; empty if there is none."""
        j = i - 1
        while j >= 0 and self.words[j] in "[]" and self.kinds[j] == "mark":
            j -= 1
        if j >= 0 and self.words[j] == ">":
            depth = 0
            while j >= 0:
                depth += {">": 1, "<": -1}.get(self.words[j], 0)
                j -= 1
                if depth == 0:
                    break
        word = self.words[j] if j >= 0 and self.kinds[j] == "word" else ""
        return "" if word in MODIFIERS | NOT_METHODS else word

    def constant(self, i: int, scope: str) -> None:
        if self.words[i] == "=" and i + 2 < len(self.words) and self.kinds[i + 1] == "string" and self.words[i + 2] == ";":
            self.strings[self.words[i - 1]] = self.words[i + 1][1:-1]
            self.add("constant", scope, "", self.words[i - 1], self.words[i + 1][1:-1], "", i)

    def method_at(self, paren: int, brace: int, owner: str) -> int:
        name, end = self.words[paren - 1], self.close.get(brace, len(self.words))
        full = f"{owner}#{name}"
        self.add("method", owner, full, name, self.type_before(paren - 1), self.body(brace, end), paren - 1)
        for j in range(paren + 1, self.close.get(paren, end)):
            if self.kinds[j] == "word" and self.words[j + 1] in ",)":
                self.add("variable", owner, full, self.words[j], self.type_before(j), "", j)
        for j in range(brace + 1, end):
            if self.kinds[j] != "word":
                continue
            following = self.words[j + 1 : j + 2]
            if following and following[0] in ("=", ";", ":") and self.type_before(j) and self.words[j - 1] != ".":
                self.add("variable", owner, full, self.words[j], self.type_before(j), "", j)
                self.constant(j + 1, full)
            elif following == ["("] and self.words[j] not in NOT_METHODS:
                if self.words[j - 1] == "new":
                    self.add("call", owner, full, "<init>", self.words[j], "new", j)
                    continue
                k = j
                while k >= 2 and self.words[k - 1] == "." and self.kinds[k - 2] == "word":
                    k -= 2
                qualifier = ".".join(self.words[k:j:2])
                args = self.arguments(j + 1)
                if qualifier and self.words[j] in LOG_METHODS and args:
                    self.add("log", owner, full, self.words[j], self.template(args, self.words[j]), "", j)
                else:
                    self.add("call", owner, full, self.words[j], qualifier, "", j)
        return end + 1

    def body(self, brace: int, end: int) -> str:
        return " ".join(self.words[brace : end + 1])

    def arguments(self, paren: int) -> list[tuple[int, int]]:
        """(from, to) of the arguments in the brackets at ``paren``."""
        end, out, start, j = self.close.get(paren, len(self.words)), [], paren + 1, paren + 1
        while j < end:
            if self.words[j] in "({[" and self.kinds[j] == "mark":
                j = self.close.get(j, end)
            elif self.words[j] == "," and self.kinds[j] == "mark":
                out.append((start, j))
                start = j + 1
            j += 1
        return [*out, (start, end)] if end > paren + 1 else []

    def template(self, args: list[tuple[int, int]], level: str) -> str:
        """The text a log call writes, ``{}`` for what is not constant.

        Further arguments fill the placeholders one by one, but for level error.
        """
        text = self.part(*args[0])
        if len(args) > 1:
            text = re.sub(PLACEHOLDER, "{}", text)
            for a in args[1:] if level != "error" else ():
                text = text.replace("{}", self.part(*a), 1)
        return text

    def part(self, a: int, b: int) -> str:
        pieces, start, j = [], a, a
        while j < b:
            if self.words[j] in "({[" and self.kinds[j] == "mark":
                j = self.close.get(j, b)
            elif self.words[j] == "+" and self.kinds[j] == "mark":
                pieces.append((start, j))
                start = j + 1
            j += 1
        if pieces:
            return "".join(self.part(*p) for p in [*pieces, (start, b)])
        if b - a == 1 and self.kinds[a] == "string":
            return self.words[a][1:-1]
        if b - a == 1 and self.kinds[a] == "word":
            return self.strings.get(self.words[a], "{}")
        if self.words[a : a + 4] == ["String", ".", "format", "("]:
            inner = self.arguments(a + 3)
            return re.sub(PLACEHOLDER, "{}", self.part(*inner[0])) if inner else "{}"
        return "{}"


def scan(code: str) -> list[tuple]:
    """The facts of one source file; see ``FACTS``."""
    return _Scanner(code or "").run()


def facts(sources: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """``project, path`` and the facts of each source file, of some ``kinds`` only if they are named.

    A table of sources can lie in few file parts, as small rows may make them up: files are
    dealt out by their path first, so that all cores scan; the count is given, as AQE would
    merge parts by bytes, and here a byte costs far more than elsewhere.
    """
    session = sources.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 3 * session.sparkContext.defaultParallelism)
    shape = f"project string, path string, {FACTS}"
    types = [pa.int32() if x.endswith(" int") else pa.string() for x in shape.split(", ")]
    names = [x.split()[0] for x in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = [c.to_pylist() for c in b.slice(at, 256).columns]
                rows = [(project, path, *fact) for project, path, content in zip(*some, strict=True) for fact in scan(content) if not kinds or fact[0] in kinds]
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return sources.select("project", "path", "content").repartition(parts, "project", "path").mapInArrow(run, shape)


def methods(found: DataFrame) -> DataFrame:
    """``project, method_path, class_name, method_name, code`` for tokenising."""
    folder = F.regexp_replace(F.regexp_replace("path", r"/?[^/]*$", ""), "/", ".")
    simple = F.substring_index("class", ".", -1)
    path = F.concat_ws(".", F.when(folder != "", folder), F.concat_ws("#", simple, F.col("name")))
    return found.filter("kind = 'method'").select("project", path.alias("method_path"), simple.alias("class_name"), F.col("name").alias("method_name"), F.col("extra").alias("code"))


def log_templates(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'log'").select("project", "class", "method", F.col("value").alias("template"), F.col("name").alias("level"), "line", "ord")


def symbols(found: DataFrame) -> dict[str, DataFrame]:
    """The tables that ``operators.resolve`` needs, and the calls to resolve."""
    of = lambda kind: found.filter(F.col("kind") == kind)
    owners = of("class").select("project", "path", F.col("class").alias("owner"))
    classes = found.filter("kind IN ('class', 'inner')")
    per_file = lambda df: df.join(owners, ["project", "path"]).select(F.col("owner").alias("class"), *[c for c in df.columns if c not in ("class", "project", "path")])
    return {
        "inner": of("inner").select("class", "name"),
        "declared": per_file(of("class").select("project", "path", "name")),
        "imports": per_file(of("import").select("project", "path", F.col("name").alias("path_name"), (F.col("value") == "wildcard").alias("wildcard"), (F.col("extra") == "static").alias("static"))).withColumnRenamed("path_name", "path"),
        "project": classes.select("package", "name").distinct(),
        "fields": of("field").select("class", "name", F.col("value").alias("type")),
        "variables": of("variable").select(F.col("method").alias("scope"), "name", F.col("value").alias("type")),
        "returns": of("method").select(F.col("class").alias("owner"), "name", F.col("value").alias("type")),
        "calls": of("call").select("class", "package", F.col("method").alias("scope"), F.col("value").alias("qualifier"), F.col("name").alias("member"), "line"),
    }


def call_edges(found: DataFrame) -> DataFrame:
    """``method, callee, line`` of all calls, resolved to full names, each callee once."""
    from ..operators.graph import cut
    from ..operators.resolve import resolve_qualifiers, resolve_types

    # read for every table: sources are scanned once, and bodies are not kept
    found = cut(found.filter(F.col("kind").isin(*SYMBOL_KINDS)).withColumn("extra", F.when(F.col("kind") == "import", F.col("extra"))))
    s = symbols(found)
    simple = (
        s["calls"].select("class", "package", F.element_at(F.split("qualifier", r"\."), 1).alias("name"))
        .union(s["fields"].join(found.select("class", "package").distinct(), "class").select("class", "package", "type"))
        .union(s["variables"].select(F.substring_index("scope", "#", 1).alias("class"), F.col("type").alias("name")).join(found.select("class", "package").distinct(), "class").select("class", "package", "name"))
        .filter("name <> ''").distinct()
    )
    types = cut(resolve_types(simple, s["inner"], s["declared"], s["imports"], s["project"]).select("class", "name", "resolved"))
    full = lambda df, on: df.join(types.withColumnRenamed("name", "type"), [*on, "type"]).drop("type").withColumnRenamed("resolved", "type")
    variables = full(s["variables"].withColumn("class", F.substring_index("scope", "#", 1)), ["class"]).groupBy("scope", "name").agg(F.max("type").alias("type"))
    fields = full(s["fields"], ["class"]).groupBy("class", "name").agg(F.max("type").alias("type"))
    owners = found.select(F.col("class").alias("owner"), F.col("class")).distinct()
    returns = full(s["returns"].join(owners, "owner"), ["class"]).groupBy("owner", "name").agg(F.max("type").alias("type"))
    done = resolve_qualifiers(s["calls"].drop("package"), variables, fields, types, returns)
    return done.groupBy(F.col("scope").alias("method"), "callee").agg(F.min("line").alias("line"))
