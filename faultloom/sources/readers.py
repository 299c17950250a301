"""Readers of reports, sources, coverage, pages, scores and ground truth."""

from __future__ import annotations

import html.parser
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import names


def reports_json(spark: SparkSession, path: str) -> DataFrame:
    """Structured reports; files that are no JSON give no usable row."""
    return spark.read.schema(schemas.REPORT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole files as ``path, text``."""
    r = spark.read.option("recursiveFileLookup", True)
    r = r.option("pathGlobFilter", glob) if glob else r
    return r.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def java_sources(spark: SparkSession, path: str, suffix: str = ".java", skip: str = "test_dirs") -> DataFrame:
    """``project, path, content``: ``skip`` leaves out folders named test, or files whose name has Test."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    root = path.rstrip("/").split("/")[-1]
    relative = F.substring_index(F.col("path"), f"/{root}/", -1)
    out = rows.select(F.lit(root).alias("project"), relative.alias("path"), F.col("content").cast("string").alias("content"))
    if skip == "test_dirs":
        return out.filter(~F.array_contains(F.split("path", "/"), "test"))
    return out.filter(~F.contains(F.substring_index("path", "/", -1), F.lit("Test")))


def coverage_csv(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files of a folder with ``version``, the name of the file."""
    rows = spark.read.schema(schemas.COVERAGE_RAW).option("header", True).csv(path)
    return rows.withColumn("version", F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", ""))


def cached_events(spark: SparkSession, path: str) -> DataFrame:
    """Log events extracted before: one JSON array per ``<title>-classes.json``."""
    rows = spark.read.schema(schemas.LOG_EVENT).option("multiLine", True).json(path)
    return rows.withColumn("title", F.regexp_replace(F.col("_metadata.file_name"), r"-classes\.json$", ""))


def prefer_cached(parsed: DataFrame, cached: DataFrame) -> DataFrame:
    """Cached events for the titles that have any, parsed ones for the others."""
    return cached.unionByName(parsed.join(cached.select("title").distinct(), "title", "left_anti"), allowMissingColumns=True)


def call_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Methods, calls and log templates of call-graph files, with their order."""
    rows = spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("version"), F.from_json("value", schemas.CALL_GRAPH).alias("tree")
    )
    classes = rows.select("version", F.posexplode(F.map_entries("tree")).alias("class_ord", "c"))
    entries = classes.select("version", "class_ord", F.col("c.key").alias("class"), F.posexplode("c.value.methods").alias("method_ord", "m"))
    methods = entries.select("version", "class_ord", "class", "method_ord", F.explode(F.map_entries("m")).alias("e")).select(
        "version", "class_ord", "method_ord", "class", F.col("e.key").alias("method"), F.col("e.value").alias("v")
    )
    place = ["version", "class_ord", "method_ord"]
    calls = methods.select(*place, "method", F.posexplode("v.calls").alias("call_ord", "x")).select(*place, "call_ord", "method", "x.callee", "x.line")
    logs = methods.select(*place, "method", F.posexplode("v.logs").alias("log_ord", "x")).select(*place, "log_ord", "method", "x.template", "x.level", "x.line")
    return methods.select(*place, "class", "method", "v.location.file", "v.location.line"), calls, logs


def scores_text(spark: SparkSession, path: str, channel: str) -> DataFrame:
    """``name: score`` lines; of a name's lines the last counts."""
    rows = spark.read.text(path, wholetext=True).select(
        names.report_id(F.col("_metadata.file_name")).alias("title"), F.posexplode(F.split("value", "\n")).alias("pos", "line")
    )
    whole = r"^(.*):\s*(\S+)\s*$"
    parsed = rows.select(
        "title", "pos", F.trim(F.regexp_extract("line", whole, 1)).alias("method"), F.regexp_extract("line", whole, 2).try_cast("double").alias("score")
    ).filter("score IS NOT NULL")
    return parsed.groupBy("title", "method").agg(F.max_by("score", "pos").alias("score")).select("title", F.lit(channel).alias("channel"), "method", "score")


def links_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``title, link`` lines; malformed ones are dropped."""
    return spark.read.schema("title string, link string").option("sep", "\t").option("mode", "DROPMALFORMED").csv(path).filter("link IS NOT NULL")


def yaml_config(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """A two-level ``section: key: value`` file, read on the driver (it is settings, not data)."""
    out: dict[str, dict[str, str]] = {}
    section = ""
    for row in spark.read.text(path).collect():
        line = row["value"].split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        key, _, value = line.strip().partition(":")
        value = value.strip().strip("\"'")
        if line[0] not in " \t" and not value:
            section = key
            out.setdefault(section, {})
        elif line[0] in " \t":
            out.setdefault(section, {})[key] = value
        else:
            out.setdefault("", {})[key] = value
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_paragraphs(content: bytes) -> list[str]:
    """Paragraph texts of a Word document; none if it cannot be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    return ["".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p")]


def xlsx_rows(content: bytes) -> list[list[str]]:
    """Cell texts of the first sheet of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_X}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_X}si")]
        sheet = ElementTree.fromstring(z.read(sorted(n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml", n))[0]))
    rows = []
    for row in sheet.iter(f"{_X}row"):
        cells: dict[int, str] = {}
        for c in row.iter(f"{_X}c"):
            at = 0
            for letter in re.match(r"[A-Z]*", c.get("r", "A"))[0]:
                at = at * 26 + ord(letter) - 64
            value = c.find(f"{_X}v")
            text = "".join(t.text or "" for t in c.iter(f"{_X}t")) if c.get("t") == "inlineStr" else (value.text if value is not None else "")
            cells[at] = shared[int(text)] if c.get("t") == "s" and text else text or ""
        rows.append([cells.get(i, "") for i in range(1, max(cells, default=0) + 1)])
    return rows


def docx_reports(spark: SparkSession, path: str) -> DataFrame:
    """``file, paras`` of all Word files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{docx,doc}").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file": b["path"].map(lambda p: p.rsplit("/", 1)[-1]), "paras": b["content"].map(docx_paragraphs)})

    return rows.select("path", "content").mapInPandas(run, "file string, paras array<string>")


def truth_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """``title, methods`` of a workbook with the columns title and Methods."""
    rows = spark.read.format("binaryFile").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                head, *body = xlsx_rows(content)
                if not {"title", "Methods"} <= set(head):
                    raise ValueError("the columns title and Methods are needed")
                t, m = head.index("title"), head.index("Methods")
                yield pd.DataFrame({"title": [r[t] for r in body if len(r) > max(t, m)], "listed": [r[m] for r in body if len(r) > max(t, m)]})

    return rows.select("content").mapInPandas(run, "title string, listed string").select("title", names.truth_list(F.col("listed")).alias("methods"))


def page_links(html: Column, containing: str) -> Column:
    """``href`` values of links that contain a text, in order."""
    hrefs = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return F.filter(hrefs, lambda h: F.contains(h, F.lit(containing)))


#: White space at the ends of a piece of text, and the blanks of Unicode at the ends of a whole one.
_BLANKS, _SPACES = " \t\n\r\xa0", " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


class _Outline(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[list[str], str]] = []
        self.path: list[tuple[int, str]] = []
        self.open, self.text = "", []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if re.fullmatch(r"h[1-6]|p", tag):
            self._close()
            self.open, self.text = tag, []

    def handle_endtag(self, tag: str) -> None:
        if tag == self.open:
            self._close()

    def handle_data(self, data: str) -> None:
        if self.open:
            self.text.append(data.strip(_BLANKS))

    def _close(self) -> None:
        text = re.sub(f"[{_BLANKS}\f]+", " ", "".join(self.text)).strip(_SPACES)
        if self.open == "p":
            self.found.append(([h for _, h in self.path], text))
        elif self.open:
            level = int(self.open[1])
            self.path = [x for x in self.path if x[0] < level] + [(level, text)]
        self.open = ""


def page_outline(pages: DataFrame, key: str = "url", html_col: str = "html", entities: tuple[str, ...] | None = None) -> DataFrame:
    """Paragraphs of pages with the headings above them: ``doc, path, para_no, text``.

    A heading closes those of its level and below.  White space is collapsed.  Character
    references are read as browsers do, ``&amp`` without semicolon too; with ``entities``
    only those names, closed by a semicolon, are read and all other text is as it stands.
    """
    other = entities and re.compile(rf"&(?!(?:{'|'.join(entities)});)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, content in zip(b["doc"], b["html"], strict=True):
                parser = _Outline()
                parser.feed(other.sub("&amp;", content or "") if other else content or "")
                parser.close()
                parser._close()
                rows += [(doc, path, i, text) for i, (path, text) in enumerate(parser.found)]
            yield pd.DataFrame(rows, columns=["doc", "path", "para_no", "text"])

    return pages.select(F.col(key).cast("string").alias("doc"), F.col(html_col).alias("html")).mapInPandas(run, schemas.OUTLINE)
